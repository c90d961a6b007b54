"""Shared helpers: durable intermediate tables and joins that survive hot keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with this many rows is joined by broadcast instead of being dealt to one task.
HOT_ROWS = 1000
#: Hot keys that are broadcast for each shuffle partition, at most (largest first); all other keys take the shuffle.
HOT_KEYS = 10
#: Bytes of text that a Python worker takes from an Arrow batch at once.
PART_BYTES = 1_000_000
#: ASCII white space, as `[\x20\x09-\x0D]`.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset on a single machine (tests), one is made and set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back, which cuts the lineage durably."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that materialise() has written and nothing reads any more."""
    for t in tables:
        if found := t.inputFiles():
            remove(t.sparkSession, found[0].rpartition("/")[0])


def text_parts(texts: pa.Array, size: int = PART_BYTES) -> Iterator[tuple[int, int, list[str]]]:
    """(start, stop, texts with '' for null) of slices of about size bytes; one longer text is a slice of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + size, "right")))
        yield a, b, [t or "" for t in texts.slice(a, b - a).to_pylist()]
        a = b


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, nothing else; text without other letters takes the fast way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def join_by_key(rows: DataFrame, table: DataFrame, key: list[str], n: str) -> DataFrame:
    """Inner join of many rows with a table of one row per key that also holds the key's row count in column n.

    The most frequent keys (HOT_KEYS for each shuffle partition at most, HOT_ROWS rows or more each) are broadcast, so any other
    key has less than a tenth of a mean partition's rows, and the broadcast grows with the partitions only. Their rows then go through the
    shuffle of the others spread by a salt instead of their key, so that rows is computed once and no task gets a whole hot
    key. Null keys match nothing.
    """
    values = [c for c in table.columns if c not in key]
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = table.where(F.col(n) >= HOT_ROWS).orderBy(F.desc(n), *key).limit(HOT_KEYS * max(partitions, 100))
    cold = table.join(F.broadcast(hot.select(*key)), key, "left_anti")
    marked = rows.join(F.broadcast(hot.select(*key, F.struct(*values).alias("join_hot"))), key, "left")
    marked = marked.withColumn("join_salt", F.when(F.col("join_hot").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(*rows.columns)))
    others = cold.select(*key, F.struct(*values).alias("join_cold"), F.lit(0).cast("long").alias("join_salt"))
    both = marked.join(others, [*key, "join_salt"], "left").withColumn("join_found", F.coalesce("join_hot", "join_cold"))
    return both.where("join_found is not null").select(*rows.columns, *[F.col("join_found").getField(v).alias(v) for v in values])


def text_hash(text: Column) -> list[Column]:
    """Two 64-bit hashes of a string column, 128 bits in all."""
    return [F.xxhash64(text), F.xxhash64(F.lit("second"), text)]
