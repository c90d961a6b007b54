r"""Mixing sources to target weights by systematic sampling.

A document's size is its number of words. Sources, in the order of their code points with null last, weigh WEIGHTS in turn and
share all words by weight; a target stops at MOST times its source's words, and what is left over is shared again by
weight until no target is above.

Every document of a source is expected target / words times, in units of 1 / UNIT. The prefix sum of these expectations within
the source, plus one random offset a source, crosses an integer once for each copy that is taken; so a document is taken
the whole number of times below or above its expectation, MOST times at most. Documents stand in the order of their sizes
(then of a hash of seed and doc_id), hence the words taken differ from the target by less than twice the source's largest document, plus
one UNIT-th of its words.

Places in that order come without a group in one task: rows are range-partitioned by source, size and hash, so a source
of any share is spread over many tasks; each task numbers its own rows and the counts of the tasks, one row for each task
and source, give where each begins. Everything is integer arithmetic up to the target, so reruns agree.

Defined results: null and empty texts have size 0. A source without a word has target 0 and its documents are taken 0 times, and so are
documents of size 0, whose copies hold no word. Null is a source of its own. Rows that repeat are documents of their own; of rows
that are equal in source, size and doc_id either may be taken once more than the other. An empty table gives an empty result.
Other columns are not read by op13; `mix` returns them as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from aquabill.llm import common

WEIGHTS = [5, 2, 1]
MOST = 3
#: Expected copies are whole numbers of 1 / UNIT; places up to 2 ** 37 stay exact in 64 bits.
UNIT = 1 << 24
SEED = 0
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _hash(value: Column) -> Column:
    return F.conv(F.substring(F.md5(value), 1, 15), 16, 10).cast("long")


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """rows with `name`: 1, 2, ... within each value of `by` (null is one), in `order`; no group of rows is put into one task.

    The rows are written to the shared folder on the way, so that counts and places see one and the same partitioning.
    """
    keys = [*by, *order]
    spread = rows.repartitionByRange(_partitions(rows), *[F.col(c).asc_nulls_last() for c in keys]) if keys else rows
    placed = common.materialise(spread.withColumn("number_part", F.spark_partition_id()), "numbered")
    counts = placed.groupBy("number_part", *by).agg(F.count("*").alias("number_rows"))
    before = F.sum("number_rows").over(W.partitionBy(*by).orderBy("number_part").rowsBetween(W.unboundedPreceding, -1))
    starts = counts.select(F.col("number_part").alias("start_part"), *[F.col(c).alias(f"start_{c}") for c in by], F.coalesce(before, F.lit(0)).alias("start_rows"))
    same = F.col("number_part") == F.col("start_part")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"start_{c}"))
    own = F.row_number().over(W.partitionBy("number_part", *by).orderBy(*[F.col(c).asc_nulls_last() for c in order]))
    out = placed.withColumn("number_own", own).join(starts, same)
    return out.select(*rows.columns, (F.col("number_own") + F.col("start_rows")).cast("long").alias(name))


def _partitions(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _sated(shared: int, of: int, most: int) -> Column:
    """Whether a source's part of the words shared among weights `of` is more than its bound; exact for any number of words."""
    return F.col("weight").cast("decimal(38,0)") * shared > (F.col("source_size") * most).cast("decimal(38,0)") * of


def targets(sizes: DataFrame, weights: list[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) of rows (source, size). Each round of sharing is one aggregate of the sources' table."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = numbered(totals, [], ["source"], "rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("long")
    own = common.materialise(ranked.select("source", "source_size", weight.alias("weight")), "sources")
    # a source is full if its share reaches its bound; the share of one unit of weight only grows from round to round
    share, shared, of = None, 0, 1
    while True:
        full = F.lit(False) if share is None else _sated(shared, of, most)
        row = own.agg(
            F.sum("source_size").alias("all"), F.coalesce(F.sum(F.when(full, F.col("source_size"))), F.lit(0)).alias("full"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("weight"), F.count_if(full).alias("n"),
        ).first()
        shared, of = (row["all"] or 0) - most * row["full"], max(row["weight"], 1)
        if row["n"] == share:
            break
        share = row["n"]
    got = F.when(_sated(shared, of, most), (F.col("source_size") * most).cast("double")).otherwise((F.col("weight") * shared).cast("double") / of)
    return own.select("source", "source_size", got.alias("target"))


def copies(docs: DataFrame, weights: list[int] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """docs, which hold source, size and doc_id, with source_size, target and mix_copies: how many times each is taken."""
    sources = targets(docs.select("source", "size"), weights, most)
    keyed = docs.withColumn("mix_key", _hash(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))))
    placed = numbered(keyed, ["source"], ["size", "mix_key"], "mix_place")
    step = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * UNIT)).otherwise(0).cast("long")
    offset = F.pmod(_hash(F.concat(F.lit(f"{seed}:source:"), F.coalesce("source", F.lit("null")))), F.lit(UNIT))
    told = sources.select(F.col("source").alias("mix_source"), "source_size", "target", step.alias("mix_step"), offset.alias("mix_offset"))
    crossed = lambda place: F.shiftright(place * F.col("mix_step") + F.col("mix_offset"), UNIT.bit_length() - 1)
    out = placed.join(told, F.col("source").eqNullSafe(F.col("mix_source")))
    return out.select(*docs.columns, "source_size", "target", (crossed(F.col("mix_place")) - crossed(F.col("mix_place") - 1)).alias("mix_copies"))


def mix(docs: DataFrame, weights: list[int] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """docs (doc_id, text, source and any others), each row as often as the mix takes it."""
    row = docs.select("doc_id", "source", words(F.col("text")).alias("size"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    taken = copies(row, weights, most, seed).where("mix_copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int")))).select("row.*")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", words(F.col("text")).alias("size"))
    out = copies(common.materialise(sized, "sizes"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("mix_copies")).alias("taken"))


# A source is full if its bound is below its share when it and all sources of smaller bounds for their weight are taken as full.
ORACLE = f"""with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size from documents),
s as (select source, sum(size)::bigint as n from d group by 1),
w as (select *, {WEIGHTS}[1 + (row_number() over (order by source nulls last) - 1) % {len(WEIGHTS)}]::bigint as weight from s),
r as (select *, {MOST} * n / weight as ratio, sum(n) over () as whole, coalesce(sum(n) over smaller, 0) as sated, sum(weight) over () - coalesce(sum(weight) over smaller, 0) as rest
  from w window smaller as (order by {MOST} * n / weight range between unbounded preceding and current row exclude group)),
t as (select *, {MOST} * n * rest < weight * (whole - {MOST} * sated) as is_full from r),
f as (select sum(n)::bigint - {MOST} * coalesce(sum(n) filter (where is_full), 0)::bigint as shared, greatest(coalesce(sum(weight) filter (where not is_full), 0), 1)::bigint as of from t),
g as (select source, n, case when is_full then ({MOST} * n)::double else (weight * shared)::double / of end as target,
  (('0x' || md5('{SEED}:source:' || coalesce(source, 'null'))[1:15])::bigint) % {UNIT} as o from t, f),
h as (select *, case when n > 0 then floor(target / n * {UNIT})::bigint else 0 end as step from g),
p as (select *, row_number() over (partition by source order by size, ('0x' || md5('{SEED}:' || coalesce(doc_id::varchar, 'null'))[1:15])::bigint) as k from d)
select doc_id, size, n as source_size, target, size * (((k * step + o) >> {UNIT.bit_length() - 1}) - (((k - 1) * step + o) >> {UNIT.bit_length() - 1})) as taken
from p join h on p.source is not distinct from h.source"""
