"""The incremental load as a stream: new text files become bills, and unseen ones join the store."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from aquabill.plans.pipeline import take
from aquabill.sources import files
from aquabill.sources.store import BUCKETS, Store

#: Spark deletes the shuffle files of a query when it ends, not when the driver next collects its garbage; what is lost later is made anew.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _identity(spark: SparkSession, checkpoint: str) -> str:
    """The stream's name, which its checkpoint keeps."""
    text = spark.read.text(f"{checkpoint.rstrip('/')}/metadata", wholetext=True).first()["value"]
    return json.loads(text)["id"]


def load_stream(
    spark: SparkSession, root: str, store: str, checkpoint: str, max_files: int = 1000, register_path: str | None = None, redistribute: bool = False, buckets: int = BUCKETS,
    keep: int | None = None,
) -> StreamingQuery:
    """Starts the stream over what root holds now. Each micro-batch is a version of the store; `store.history` tells what it did.

    The store then holds what one batch over the same files would have given, in however many micro-batches they come:
    bills are related to all meter rows so far, stored bills to those that come after them, and only bills whose keys the
    store's version at the start holds are left out. A manifest names the last epoch of each stream, so a micro-batch that is replayed
    after a failure adds nothing; a stream that is started again after one leaves out what was stored before it.

    Each micro-batch with new meter rows writes stored bills anew, and older versions keep the former ones. With keep, only the last
    `keep` versions are kept, as by Store.vacuum after each micro-batch; no other load may then be running, and nobody read older ones.
    """
    if keep is not None and keep < 1:
        raise ValueError("keep must be 1 or more")
    known = Store(spark, store, buckets).begin().base

    def add(batch: DataFrame, epoch: int) -> None:
        session = batch.sparkSession  # the stream's own
        session.conf.set(CLEANUP, "true")
        own, stream = Store(session, store, buckets).begin(), _identity(session, checkpoint)
        if own.base.epochs.get(stream, -1) < epoch:
            register = files.read_register(session, register_path) if register_path else None
            own.commit(take(own, batch, register, redistribute, known=known), stream, epoch)
        if keep is not None:
            own.store.vacuum(keep)

    # wholetext must be given as an argument; an option of that name is overridden by the argument's default
    raw = spark.readStream.option("recursiveFileLookup", True).option("pathGlobFilter", "*.[tT][xX][tT]").option("maxFilesPerTrigger", max_files).text(root, wholetext=True)
    return files.with_lineage(raw, root).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
