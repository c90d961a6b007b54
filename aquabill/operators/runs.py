"""Line states of files of any size: each file is cut into runs of lines, which are reduced and combined.

A run is a contiguous piece of a file: some lines of a whole text, or of one split of a file that is read by lines. Its state
transition is a row (what it holds last of each value, for both states it can be entered with); the transitions of a file
are combined in the order of its runs, which says how each run is entered, and then the run's own lines are replayed with that. So a
file is spread over as many tasks as it has runs, and only one row a run meets the others of its file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Lines of a run.
LINES = 20_000
RUN = ["path", "run"]


def split_lines(docs: DataFrame, size: int = LINES) -> DataFrame:
    """docs with line_no, line and run (a struct that orders the runs of a file) in place of content."""
    kept = [c for c in docs.columns if c != "content"]
    return docs.select(*kept, F.posexplode(F.split("content", "\n")).alias("line_no", "line")).withColumn("run", run(F.lit(0), F.floor(F.col("line_no") / size)))


def run(at: Column, piece: Column) -> Column:
    """The run of a line, by where its split begins in the file and its piece of the split."""
    return F.struct(at.cast("long").alias("at"), piece.cast("long").alias("piece"))


def within(last: int = 0):
    """The lines of a run from its first up to `last` rows from the current one."""
    return W.partitionBy(*RUN).orderBy("line_no").rowsBetween(W.unboundedPreceding, last)


def latest(value: Column, last: int = 0) -> Column:
    """The last non-null value of the run up to `last` rows from the current one."""
    return F.last(value, ignorenulls=True).over(within(last))


def ending(value: Column) -> Column:
    """Aggregate over a run: its last non-null value."""
    return F.max(F.when(value.isNotNull(), F.struct(F.col("line_no"), value.alias("value"))))["value"]


def before():
    """The runs of a file before the current one."""
    return W.partitionBy("path").orderBy("run").rowsBetween(W.unboundedPreceding, -1)


def entered(value: Column, default: Column | None = None) -> Column:
    """What the runs before hold last of a value; default without any."""
    got = F.last(value, ignorenulls=True).over(before())
    return got if default is None else F.coalesce(got, default)


def counted(n: Column) -> Column:
    """The sum over the runs before."""
    return F.coalesce(F.sum(n).over(before()), F.lit(0))
