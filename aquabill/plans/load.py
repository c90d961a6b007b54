"""Incremental load and report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aquabill.functions import text as T
from aquabill.operators import grouped, meters, route
from aquabill.operators.meters import keep_first
from aquabill.schema import KEYS, METER_ROW
from aquabill.sources.store import BUCKETS, INDEX, Load, Manifest, Store, bucket, in_buckets, index_key

REPORT = "EMPRESA string, bills long, added long, ignored long, files long, no_total long"


def new_rows(rows: DataFrame, store: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Rows whose keys the store does not hold; null, '' and the not-found text of older stores are the same key.

    Duplicates inside rows stay.
    """
    # the issuer is compared as it is, so that the store's folders can be pruned by it
    key = lambda k: F.col(k) if k == "EMPRESA" else T.found(F.col(k).cast("string"))
    known = store.select(*[key(k).alias(f"known_{k}") for k in keys])
    return rows.join(known, [key(k) == F.col(f"known_{k}") for k in keys], "left_anti")


def unseen(batch: DataFrame, store: Store, manifest: Manifest) -> DataFrame:
    """Rows of batch whose keys a version of the store does not hold, by its key index: only the batch is shuffled.

    Of the index the batch's issuers are read; their number is that of the layouts.
    """
    issuers = [r["EMPRESA"] for r in batch.select("EMPRESA").distinct().collect()]
    own = batch.withColumns({f"own_{k}": index_key(k, c) for k, c in INDEX.items()})
    known = store.keys(manifest, issuers)
    return own.join(known, [own[f"own_{k}"] == known[k] for k in INDEX], "left_anti").select(batch.columns)


def union_by_name(*frames: DataFrame) -> DataFrame:
    """Rows of all frames by column name; columns that a frame lacks are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def report(batch: DataFrame, added: DataFrame) -> DataFrame:
    """(EMPRESA, bills, added, ignored, files, no_total): what a load did, by issuer."""
    seen = batch.groupBy("EMPRESA").agg(F.count("*").alias("bills"), F.count_distinct("PASTA_ORIGEM", "ARQUIVO_ORIGEM").alias("files"), F.count_if(F.col("VALOR_TOTAL") == 0).alias("no_total"))
    new = added.groupBy("EMPRESA").agg(F.count("*").alias("added"))
    out = seen.join(new, "EMPRESA", "left").withColumn("added", F.coalesce("added", F.lit(0)))
    return out.select("EMPRESA", "bills", "added", (F.col("bills") - F.col("added")).alias("ignored"), "files", "no_total")


def routing_report(docs: DataFrame) -> DataFrame:
    """(EMPRESA, documents, parsed): what the router did with DOC rows, unknown and layout-less issuers included."""
    issuer = F.coalesce(route.first_match(route.names(docs), route.ISSUERS), F.lit("UNKNOWN"))
    parsed = ~F.col("EMPRESA").isin("UNKNOWN", *route.UNPARSED)
    return docs.select(issuer.alias("EMPRESA")).groupBy("EMPRESA").agg(F.count("*").alias("documents")).withColumn("parsed", parsed)


def file_report(bills: DataFrame) -> DataFrame:
    """(EMPRESA, PASTA_ORIGEM, ARQUIVO_ORIGEM, bills, total): one row a file that gave bills."""
    return bills.groupBy("EMPRESA", "PASTA_ORIGEM", "ARQUIVO_ORIGEM").agg(F.count("*").alias("bills"), F.round(F.sum("VALOR_TOTAL"), 2).alias("total"))


def take_meters(own: Load, told: DataFrame) -> None:
    """Adds the meter rows that the store does not hold to a load."""
    stored = own.store.meters(own.base)
    own.add_meters(new_rows(told, stored, METER_ROW.names))


def take_bills(own: Load, batch: DataFrame, dedupe_batch: bool = False, known: Manifest | None = None, persist: bool = True) -> list[dict]:
    """Adds the batch's bills that a version of the store (the load's own base) does not hold to a load, and returns its report.

    The batch is read three times: from a persisted copy, or anew without persist, as is better if it comes from files as it is.
    """
    batch = batch.persist() if persist else batch
    try:
        added = unseen(batch, own.store, known or own.base)
        if dedupe_batch:
            added = keep_first(added, KEYS, ["PASTA_ORIGEM", "ARQUIVO_ORIGEM"])
        own.add_bills(added)
        return [r.asDict() for r in report(batch, own.own_bills()).collect()]  # one row an issuer
    finally:
        if persist:
            batch.unpersist()


def revise(own: Load) -> None:
    """Relates stored bills anew to the load's meter rows: those of accounts that it brings meter rows for.

    The buckets of these accounts are read, and of them only those in which a meter changes are written, under new names. A load without
    new meter rows reads no bills.
    """
    if not (buckets := own.meter_buckets()):
        return
    accounts = own.own_meters().select(T.account_key(F.col("CONTA_DV")).alias("told_key")).distinct()
    told = own.meters(buckets)
    key = T.account_key(F.col("CONTA_DV")) == F.col("told_key")
    n, store = own.base.buckets, own.store
    grouped_folders = [f for f in own.base.data if f"/EMPRESA={grouped.GROUPED}/" in f]

    def related(folders: list[str]) -> tuple[DataFrame, DataFrame]:
        """Bills of the accounts with what they hold now as `held`, and all other bills."""
        stored = store.bills(folders=folders)
        theirs = stored.join(accounts, key, "left_semi").withColumn("held", F.col("NUM_HIDROMETRO"))
        return meters.relate(theirs, told.join(accounts, key, "left_semi")), stored.join(accounts, key, "left_anti")

    theirs, _ = related(in_buckets(grouped_folders, buckets))
    changed = theirs.where(~F.col("held").eqNullSafe(F.nullif("NUM_HIDROMETRO", F.lit("")))).select(bucket(F.col("CONTA_DV"), n).alias("b")).distinct()
    if touched := in_buckets(grouped_folders, [r["b"] for r in changed.collect()]):
        theirs, others = related(touched)
        own.replace_bills(touched, theirs.drop("held").unionByName(others))


def load(batch: DataFrame, path: str, dedupe_batch: bool = False, buckets: int = BUCKETS, persist: bool = True) -> DataFrame:
    """Adds the batch's new bills to the store at path (made with so many buckets) as a version of its own, and returns the report.

    persist=False is for a batch that is read from files as it is; no copy of it is then kept in memory and on disk meanwhile.
    """
    own = Store(batch.sparkSession, path, buckets).begin()
    rows = take_bills(own, batch, dedupe_batch, persist=persist)
    own.commit(rows)
    return batch.sparkSession.createDataFrame(rows, REPORT)
