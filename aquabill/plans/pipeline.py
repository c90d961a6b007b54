"""Documents to bills: route, extract, relate, enrich."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aquabill.operators import blocks, enrich, grouped, meters, route
from aquabill.plans.load import REPORT, revise, routing_report, take_bills, take_meters
from aquabill.schema import BILL
from aquabill.sources import files
from aquabill.sources.store import BUCKETS, Load, Manifest, Store


def staged(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Routed docs, written once (to path, a scratch folder) with a folder an issuer: each extraction then reads its own issuers' texts only."""
    spark, routed = docs.sparkSession, route.route(docs)
    path = path or files.scratch(spark, "routed")
    routed.write.partitionBy("EMPRESA").parquet(path)
    return spark.read.schema(routed.schema).parquet(path)


def bills_of_routed(routed: DataFrame, told: DataFrame, register: DataFrame | None = None, redistribute: bool = False, scratch: str | None = None) -> DataFrame:
    """BILL rows of routed docs related to the meter rows told, with the register's columns if there is one."""
    bills = blocks.extract_each(routed).unionByName(meters.relate(grouped.extract(routed, scratch=scratch), told)).select(*BILL.names)
    out = enrich.enrich(bills, register)
    return enrich.redistribute(out) if redistribute and register is not None else out


def bills_of(docs: DataFrame, register: DataFrame | None = None, redistribute: bool = False) -> DataFrame:
    """BILL rows of DOC rows, with the register's columns if there is one; texts and meter rows are written once on the way."""
    routed = staged(docs)
    path = files.scratch(docs.sparkSession, "meters")
    told = meters.extract(routed)
    told.write.parquet(path)
    return bills_of_routed(routed, docs.sparkSession.read.schema(told.schema).parquet(path), register, redistribute, files.scratch(docs.sparkSession, "lines"))


def take(own: Load, docs: DataFrame, register: DataFrame | None, redistribute: bool = False, dedupe_batch: bool = False, known: Manifest | None = None) -> list[dict]:
    """Adds meter rows and unseen bills of DOC rows to a load, revises stored bills, and returns the report. The scratch copy of the texts goes."""
    spark = docs.sparkSession
    path = files.scratch(spark, "routed")
    try:
        routed = staged(docs, f"{path}/texts")
        take_meters(own, meters.extract(routed))
        rows = take_bills(own, bills_of_routed(routed, own.meters(), register, redistribute, f"{path}/lines"), dedupe_batch, known)
        revise(own)
        return rows
    finally:
        files.remove(spark, path)


def run(spark: SparkSession, root: str, store: str, register_path: str | None = None, redistribute: bool = False, dedupe_batch: bool = False, buckets: int = BUCKETS) -> DataFrame:
    """Loads the unseen bills of all texts under root into the store, with their account's columns of the register, as one version.

    A new store is made with so many buckets of accounts and keys. Meter rows are kept in the store: bills are related to those of earlier runs too, and stored bills to new ones.
    Returns one row an issuer: EMPRESA, documents, parsed (whether there is a layout for it), and what the load did with its
    bills. Documents of nobody count as UNKNOWN, files that are not read as SKIPPED, and accounts that the register repeats as REPEATED.
    """
    register = files.read_register(spark, register_path) if register_path else None
    docs, own = files.scan_texts(spark, root), Store(spark, store, buckets).begin()
    rows = take(own, docs, register, redistribute, dedupe_batch)
    own.commit(rows)
    # names only: no text is read again
    told = routing_report(docs.drop("content"))
    more = [("SKIPPED", files.skipped_texts(spark, root)), ("REPEATED", enrich.repeated_accounts(register).count() if register is not None else 0)]
    if more := [(name, n, False) for name, n in more if n]:
        told = told.unionByName(spark.createDataFrame(more, told.schema))
    out = told.join(spark.createDataFrame(rows, REPORT), "EMPRESA", "left")
    counts = ["bills", "added", "ignored", "files", "no_total"]
    return out.select("EMPRESA", "documents", "parsed", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts])
