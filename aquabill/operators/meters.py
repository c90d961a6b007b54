"""Meter reports, and the exact-then-latest relation of bills to meters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from aquabill.functions import text as T
from aquabill.operators import runs
from aquabill.operators.runs import split_lines
from aquabill.operators.route import METERS

# Patterns of the report.
FILE_MONTH, ACCOUNT, METER = r"(\d{2})[_\.\-](\d{4})", r"CONTA\s*N.*?(\d+)\s*-\s*(\d+)", r"HIDR.*?METRO.*?:\s*([A-Z0-9]+)"
#: What Spark makes up of the name of a file that it writes; a month in there is a chance match.
PART_NAME = r"^part-\d+-.*?[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}"
_EXACT = "(?udU)"


def last_in_block(lines: DataFrame, starts, value, keys: list[str], order: list) -> DataFrame:
    """Per keys and block (a row where starts holds opens one): the last non-null value, as `value`; blocks without one go.

    lines before the first block are ignored. Columns: keys, block, value, and at: the order of the value's row.
    """
    frame = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    numbered = lines.withColumn("block", F.sum(F.when(starts, 1).otherwise(0)).over(frame)).where("block > 0")
    at = F.struct(*order)
    return numbered.withColumn("value", value).where("value is not null").groupBy(*keys, "block").agg(F.max_by("value", at).alias("value"), F.max(at).alias("at"))


def extract(docs: DataFrame, size: int = runs.LINES) -> DataFrame:
    """METER rows (and path, line_no) of routed docs that are meter reports, in runs of size lines."""
    return extract_lines(split_lines(docs.where(F.col("EMPRESA") == METERS), size))


def extract_lines(read: DataFrame) -> DataFrame:
    """METER rows (and path, line_no) of the routed lines of files, as split_lines() or files.scan_lines() give them.

    A run is reduced to its blocks; the block that is open where a run begins is put together with that block of the runs before.
    """
    lines = read.where(F.col("EMPRESA") == METERS).withColumn("u", F.upper(T.strip(F.col("line"))))
    opens, own = F.col("u").rlike(_EXACT + ACCOUNT), runs.within()
    account = F.when(opens, F.concat_ws(" ", F.regexp_extract("u", _EXACT + ACCOUNT, 1), F.regexp_extract("u", _EXACT + ACCOUNT, 2)))
    meter = F.when(~opens & F.col("u").rlike(_EXACT + METER), F.regexp_extract("u", _EXACT + METER, 1))
    told = lines.withColumns({"account": account, "meter": meter})
    told = told.select("*", F.count("account").over(own).alias("block"), F.row_number().over(own).alias("place"))
    pieces = told.groupBy(*runs.RUN, "block", "file_name", "dir").agg(
        F.count("*").alias("n"), F.max("account").alias("account"), F.max(F.when(F.col("meter").isNotNull(), F.struct("place", "meter"))).alias("last"),
    )
    came = pieces.groupBy(*runs.RUN).agg(F.sum("n").alias("n"), F.max("block").alias("blocks")).select(*runs.RUN, runs.counted(F.col("n")).alias("lines_in"), runs.counted(F.col("blocks")).alias("blocks_in"))
    at = F.when(F.col("last").isNotNull(), F.struct((F.col("lines_in") + F.col("last.place") - 1).cast("int").alias("line_no"), F.col("last.meter").alias("meter")))
    whole = pieces.join(came, runs.RUN).select("path", "file_name", "dir", "account", (F.col("blocks_in") + F.col("block")).alias("block"), at.alias("at"))
    blocks = whole.where("block > 0").groupBy("path", "file_name", "dir", "block").agg(F.max("account").alias("account"), F.max("at").alias("at")).where("at is not null")
    name = F.regexp_replace("file_name", PART_NAME, "")
    month = F.concat_ws("/", F.regexp_extract(name, FILE_MONTH, 1), F.regexp_extract(name, FILE_MONTH, 2))
    return blocks.select(
        "path", "at.line_no", F.col("account").alias("CONTA_DV"), F.when(month == "/", "").otherwise(month).alias("MES_ANO_REF"),
        F.col("at.meter").alias("NUM_HIDROMETRO_EXTRAIDO"), F.col("file_name").alias("ARQUIVO_ORIGEM"), F.col("dir").alias("PASTA_ORIGEM"),
    )


def keep_first(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per keys, the first in order (not an arbitrary one, as dropDuplicates would keep). Orders ascend, nulls first.

    An aggregate, so that each task sends on one row a key: a key of any number of rows is met in no task at once.
    """
    others = [c for c in rows.columns if c not in keys]
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    first = F.min_by(F.struct(*others), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(by)]))
    return rows.groupBy(*keys).agg(first.alias("keep_first_row")).select(*[c if c in keys else F.col("keep_first_row").getField(c).alias(c) for c in rows.columns])


def newest_first(date: Column) -> Column:
    """An order in which later times come first and null last."""
    return F.coalesce(-F.unix_micros(date.cast("timestamp")), F.lit((1 << 63) - 1))


def latest(meters: DataFrame) -> DataFrame:
    """(key, latest): each account's meter of the latest month ever; bad months come last."""
    order = [newest_first(T.month_date(F.col("MES_ANO_REF"))), "path", "line_no"]
    return keep_first(meters, ["key"], order).select("key", F.col("NUM_HIDROMETRO_EXTRAIDO").alias("latest"))


def exact_then_latest(left: DataFrame, exact: DataFrame, fallback: DataFrame, on: list[str], key: str, value: str) -> DataFrame:
    """left with `value` from exact (one row per `on`), or where that is missing from fallback (one row per key)."""
    hit = exact.select(*on, F.col(value).alias("exact_value"))
    last = fallback.select(key, F.col(value).alias("fallback_value"))
    out = left.join(hit, on, "left").join(last, key, "left")
    return out.withColumn(value, F.coalesce(F.when(~T.missing(F.col("exact_value")), F.col("exact_value")), F.col("fallback_value"))).drop("exact_value", "fallback_value")


def relate(bills: DataFrame, meters: DataFrame) -> DataFrame:
    """bills with NUM_HIDROMETRO from the same account and month, else from the account's latest month, else null.

    Without any meter row the bills stay as they are.
    """
    month = lambda df: F.coalesce(T.squeeze(df["MES_ANO_REF"]), F.lit(""))
    m = meters.withColumn("key", T.account_key(F.col("CONTA_DV"))).withColumn("month", month(meters))
    exact = keep_first(m, ["key", "month"], ["path", "line_no"]).withColumnRenamed("NUM_HIDROMETRO_EXTRAIDO", "meter")
    last = latest(m).withColumnRenamed("latest", "meter")
    # meter rows always have an account; bills without one match nothing and are dealt evenly instead of to one task
    account, spread = T.account_key(F.col("CONTA_DV")), F.concat(F.lit("\0"), F.pmod(F.xxhash64(*bills.columns), F.lit(10_000)).cast("string"))
    b = bills.withColumn("key", F.when(T.missing(account), spread).otherwise(account)).withColumn("month", month(bills))
    out = exact_then_latest(b, exact, last, ["key", "month"], "key", "meter")
    some = meters.limit(1).agg(F.count("*") > 0).scalar()  # a part of the query, not a job of its own
    return out.withColumn("NUM_HIDROMETRO", F.when(some, F.col("meter")).otherwise(F.col("NUM_HIDROMETRO"))).select(bills.columns)
