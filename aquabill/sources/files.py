"""Text scan with lineage, register, CSV."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from aquabill.operators import runs
from aquabill.schema import BILL, REGISTER, REGISTER_ALIASES, STORED


def scratch(spark: SparkSession, name: str = "bills") -> str:
    """A new path in the folder of spark.checkpoint.dir, which all machines share; a temporary one on a single machine without it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a scratch folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def decoded(content: Column) -> Column:
    """CRLF and CR -> LF; the text source has turned invalid UTF-8 into U+FFFD already."""
    return F.regexp_replace(content, "\r\n?", "\n")


def _unescaped(path: Column) -> Column:
    # metadata paths are percent-encoded but leave a plus sign bare
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def qualified(spark: SparkSession, root: str) -> str:
    """root as an absolute path of its file system, without scheme and host."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri().getPath()


def with_lineage(raw: DataFrame, root: str, *more: Column) -> DataFrame:
    """DOC rows of a whole-text read of root, and root: its own name; and more.

    dir is the file's folder below root, with all folders on the way; the whole folder if root is a glob.
    """
    path, top = _unescaped(F.col("_metadata.file_path")), qualified(raw.sparkSession, root).rstrip("/")
    folder = F.regexp_extract(F.regexp_replace(path, r"^[A-Za-z][\w+.-]*:(//[^/]*)?", ""), "^(.*)/[^/]*$", 1)
    below = F.when(folder == top, "").when(folder.startswith(top + "/"), F.substring(folder, len(top) + 2, 1 << 20)).otherwise(F.ltrim(folder, F.lit("/")))
    name = F.lit(re.sub(r"^.*/", "", top))
    return raw.select(path.alias("path"), _unescaped(F.col("_metadata.file_name")).alias("file_name"), below.alias("dir"), decoded(F.col("value")).alias("content"), name.alias("root"), *more)


def skipped_texts(spark: SparkSession, root: str) -> int:
    """How many *.txt files under root Spark does not read since their name, or a folder's, begins with _ or a dot.

    The names are walked on the driver, one at a time.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    listed, top, n = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True), qualified(spark, root).rstrip("/"), 0
    while listed.hasNext():
        names = listed.next().getPath().toUri().getPath().removeprefix(top).split("/")
        n += names[-1].lower().endswith(".txt") and any(x.startswith((".", "_")) for x in names)
    return n


def scan_texts(spark: SparkSession, root: str) -> DataFrame:
    """DOC rows of every *.txt file (in any case) under root. Names that begin with _ or . are skipped, as Spark does; skipped_texts counts them."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.[tT][xX][tT]")
    return with_lineage(reader.text(root, wholetext=True), root)


def scan_lines(spark: SparkSession, root: str, size: int = runs.LINES) -> DataFrame:
    """The lines of every *.txt file under root with their files' names (DOC without content, and root), run and line_no.

    Files are read split by split, so that one may be larger than a task or a row can hold; line_no counts within a run.
    """
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.[tT][xX][tT]")
    at = F.monotonically_increasing_id()  # rows of a split stand in one task, in order
    raw = reader.text(root).select("value", "_metadata", at.alias("line_no"))
    piece = runs.run(F.col("_metadata.file_block_start"), F.floor(F.col("line_no") / size))
    return with_lineage(raw, root, F.col("line_no"), piece.alias("run")).withColumnRenamed("content", "line")


def stamp() -> Column:
    """The run's timestamp, one value a query."""
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")


def read_register(spark: SparkSession, path: str) -> DataFrame | None:
    """The account register, a JSON array of objects; None if there is none. Both spellings of its columns are read."""
    wide = StructType([*REGISTER.fields])  # add() changes the list that it is given
    for name, other in REGISTER_ALIASES.items():
        wide = wide.add(other, REGISTER[name].dataType)
    try:
        raw = spark.read.schema(wide).option("multiLine", True).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return raw.select(*[F.coalesce(c, F.col(f"`{REGISTER_ALIASES[c]}`")).alias(c) if c in REGISTER_ALIASES else F.col(c) for c in REGISTER.names])


def stored_columns(bills: DataFrame) -> DataFrame:
    """bills in the columns of STORED; those that bills lack are null."""
    return bills.select(*[F.col(f.name) if f.name in bills.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in STORED.fields])


def export_csv(bills: DataFrame, path: str) -> None:
    """Semicolon CSV with a header, one folder an issuer, in the columns of STORED that bills have; nulls are empty fields."""
    bills.select(*[c for c in STORED.names if c in bills.columns]).write.mode("overwrite").partitionBy("EMPRESA").option("sep", ";").option("header", True).option("emptyValue", "").csv(path)


def read_csv(spark: SparkSession, path: str, schema: StructType = BILL) -> DataFrame:
    """Semicolon CSV under a fixed schema, so that keys keep their leading zeros."""
    return spark.read.schema(schema).option("sep", ";").option("header", True).csv(path)


def read_csv_checked(spark: SparkSession, path: str, schema: StructType = BILL) -> tuple[DataFrame, DataFrame]:
    """The rows of read_csv() whose lines fit the schema, and (file, line) of those that lack fields, have too many, or hold no number where there must be one."""
    wide = StructType([*schema.fields]).add("csv_rejected", "string")
    reader = spark.read.schema(wide).option("sep", ";").option("header", True).option("columnNameOfCorruptRecord", "csv_rejected")
    rows = reader.csv(path).select("*", F.col("_metadata.file_path").alias("csv_file"))
    # always true: a line is judged by the fields that are read, so all are, whichever are selected later
    rows = rows.where(F.xxhash64(*schema.names) >= F.lit(-(1 << 63)))
    good, bad = rows.where("csv_rejected is null").select(*schema.names), rows.where("csv_rejected is not null")
    return good, bad.select(_unescaped(F.col("csv_file")).alias("file"), F.col("csv_rejected").alias("line"))
