"""The store of bills: load folders, an index of keys, and a manifest for each version.

    <path>/data/load=../EMPRESA=../bucket=../   bills; those of the grouped layout are dealt to buckets by account
    <path>/meters/load=../bucket=../            meter rows, dealt likewise
    <path>/keys/EMPRESA=../load=../             keys of the bills, in hash buckets
    <path>/versions/<n>.json                    what belongs to version n

A load writes folders of its own name and then publishes one manifest that lists them. Readers take the newest manifest and
read what it lists only, so a load that fails before it is published has left nothing that anyone sees, and a revised bucket takes
the place of the old one in the same moment. Folders are never overwritten; `vacuum` deletes those that no manifest to be kept lists.

A manifest also holds the last epoch of each stream, so that an epoch that is replayed adds nothing, and what its load did, by issuer.
Two loads that publish the same version at once: the second one fails, and can be run again.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aquabill.functions import text as T
from aquabill.operators.route import GROUPED
from aquabill.schema import KEYS, METER_ROW, STORED
from aquabill.sources.files import qualified, stored_columns

#: Buckets of a new store's accounts and keys; a large store is made with more.
BUCKETS = 8
INDEX = {"issuer": "EMPRESA", "number": "NUM_FATURA", "month": "MES_ANO_REF", "account": "CONTA_DV"}
HISTORY = "version long, load string, report array<struct<EMPRESA string, bills long, added long, ignored long, files long, no_total long>>"


@dataclass
class Manifest:
    """What belongs to a version: folders below data and meters, loads, and the last epoch of each stream."""

    version: int = 0
    buckets: int = BUCKETS
    data: list[str] = field(default_factory=list)
    meters: list[str] = field(default_factory=list)
    loads: list[str] = field(default_factory=list)
    epochs: dict[str, int] = field(default_factory=dict)
    load: str = ""
    report: list[dict] = field(default_factory=list)
    whole: bool = True  # the last entry: a manifest that is still being written has none


class Store:
    """The store at path. buckets counts when it is made; later the manifest says how many there are."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _hadoop(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _names(self, pattern: str) -> list[str]:
        """Folders and files that fit a pattern, below path."""
        top = qualified(self.spark, self.path)
        return [f.getPath().toUri().getPath().removeprefix(top + "/") for f in self._fs.globStatus(self._hadoop(pattern)) or []]

    def versions(self) -> list[int]:
        return sorted(int(n.rpartition("/")[2].removesuffix(".json")) for n in self._names("versions/[0-9]*.json"))

    def manifest(self, version: int | None = None) -> Manifest:
        """The newest whole one up to version."""
        for v in reversed(self.versions()):
            if version is None or v <= version:
                stream = self._fs.open(self._hadoop(f"versions/{v:012d}.json"))
                try:
                    text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
                finally:
                    stream.close()
                try:
                    if (got := json.loads(text)).get("whole"):
                        return Manifest(**got)
                except json.JSONDecodeError:  # still being written, or its writer died
                    pass
        return Manifest(buckets=self.buckets)

    def publish(self, manifest: Manifest) -> None:
        """Makes it the newest version; fails where another load has published that version."""
        stream = self._fs.create(self._hadoop(f"versions/{manifest.version:012d}.json"), False)
        try:
            stream.write(bytearray(json.dumps(asdict(manifest)).encode()))
        finally:
            stream.close()

    def _parquet(self, kind: str, folders: list[str], schema) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.path}/{kind}/{f}" for f in folders]
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{kind}").parquet(*paths).select(*schema.names)

    def bills(self, manifest: Manifest | None = None, folders: list[str] | None = None) -> DataFrame:
        """Bills of a version (the newest one), or of some of its folders only. The issuer is a partition column."""
        order = [*[c for c in STORED.names if c != "EMPRESA"], "EMPRESA"]
        schema = type(STORED)([STORED[c] for c in order])
        return self._parquet("data", (manifest or self.manifest()).data if folders is None else folders, schema)

    def meters(self, manifest: Manifest | None = None, buckets: list[int] | None = None) -> DataFrame:
        """Meter rows of a version, or of some buckets only."""
        own = (manifest or self.manifest()).meters
        return self._parquet("meters", own if buckets is None else in_buckets(own, buckets), METER_ROW)

    def _table(self, buckets: int) -> str:
        """The catalog's name of the key index, which is made known to this session if it is not yet."""
        name = f"bill_keys_{uuid.uuid5(uuid.NAMESPACE_URL, qualified(self.spark, self.path)).hex}"
        if not self.spark.catalog.tableExists(name):
            self._fs.mkdirs(self._hadoop("keys"))
            keys = ", ".join(INDEX)
            self.spark.sql(
                f"CREATE TABLE IF NOT EXISTS {name} ({', '.join(f'{k} STRING' for k in INDEX)}, EMPRESA STRING, load STRING) USING parquet "
                f"PARTITIONED BY (EMPRESA, load) CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {buckets} BUCKETS LOCATION '{self.path}/keys'"
            )
            self.spark.catalog.recoverPartitions(name)
        return name

    def keys(self, manifest: Manifest, issuers: list[str]) -> DataFrame:
        """Keys (INDEX) of a version's bills of some issuers, in hash buckets: a join on all of them shuffles the other side only."""
        known = self.spark.table(self._table(manifest.buckets))
        return known.where(F.col("EMPRESA").isin(issuers) & F.col("load").isin(manifest.loads)).select(*INDEX)

    def begin(self) -> Load:
        """A load on the newest version. Bills of a folder an issuer at path, as older stores keep them, become its first version."""
        if not self.versions() and (old := self._names("EMPRESA=*")):
            first = Load(self)
            first.add_bills(self.spark.read.schema(STORED).option("basePath", self.path).parquet(*[f"{self.path}/{f}" for f in old]))
            first.commit()
        return Load(self)

    def vacuum(self, keep: int = 1) -> int:
        """Deletes what none of the last `keep` versions lists; returns how many folders went. No load may be running."""
        kept = [self.manifest(v) for v in self.versions()[-keep:]]
        live = {f"data/{f}" for m in kept for f in m.data} | {f"meters/{f}" for m in kept for f in m.meters}
        loads, gone = {x for m in kept for x in m.loads}, 0
        for name in [*self._names("data/*/*/bucket=*"), *self._names("meters/*/bucket=*"), *self._names("keys/*/load=*")]:
            if name.rpartition("load=")[2] not in loads if name.startswith("keys/") else name not in live:
                gone += self._fs.delete(self._hadoop(name), True)
        return gone


class Load:
    """What one load writes; nothing of it is seen before commit()."""

    def __init__(self, store: Store):
        self.store, self.base, self.id = store, store.manifest(), uuid.uuid4().hex
        self.dropped: set[str] = set()

    def _write(self, rows: DataFrame, kind: str, by: list[str]) -> None:
        rows.hint("rebalance", *[F.col(c) for c in by]).write.mode("append").partitionBy(*by).parquet(f"{self.store.path}/{kind}/load={self.id}")

    def add_bills(self, bills: DataFrame) -> None:
        """New bills, and their keys."""
        self.replace_bills([], bills)
        keys = self.own_bills().select(*[index_key(k, c) for k, c in INDEX.items()], "EMPRESA", F.lit(self.id).alias("load"))
        n = self.base.buckets
        dealt = keys.repartition(n, *INDEX).write.mode("append").partitionBy("EMPRESA", "load").bucketBy(n, *INDEX).sortBy(*INDEX)
        dealt.saveAsTable(self.store._table(n))

    def replace_bills(self, folders: list[str], bills: DataFrame) -> None:
        """Bills that take the place of those in some folders of the version that the load began with."""
        self.dropped |= set(folders)
        dealt = F.when(F.col("EMPRESA") == GROUPED, bucket(F.col("CONTA_DV"), self.base.buckets)).otherwise(0)
        # a missing meter is null, whether there were meter rows or not when the bill came
        rows = stored_columns(bills).withColumns({"bucket": dealt, "NUM_HIDROMETRO": F.nullif("NUM_HIDROMETRO", F.lit(""))})
        self._write(rows, "data", ["EMPRESA", "bucket"])

    def add_meters(self, meters: DataFrame) -> None:
        self._write(meters.select(*METER_ROW.names).withColumn("bucket", bucket(F.col("CONTA_DV"), self.base.buckets)), "meters", ["bucket"])

    def own_bills(self) -> DataFrame:
        return self.store.bills(folders=self._own("data"))

    def own_meters(self) -> DataFrame:
        return self.store._parquet("meters", self._own("meters"), METER_ROW)

    def meters(self, buckets: list[int] | None = None) -> DataFrame:
        """Meter rows of the version that the load began with and of the load."""
        every = self.base.meters + self._own("meters")
        return self.store._parquet("meters", every if buckets is None else in_buckets(every, buckets), METER_ROW)

    def meter_buckets(self) -> list[int]:
        """Buckets for which the load brings meter rows."""
        return sorted({int(f.rpartition("bucket=")[2]) for f in self._own("meters")})

    def _own(self, kind: str) -> list[str]:
        """The load's folders; written whole, since the writer has ended."""
        levels = "EMPRESA=*/bucket=*" if kind == "data" else "bucket=*"
        return [n.removeprefix(f"{kind}/") for n in self.store._names(f"{kind}/load={self.id}/{levels}")]

    def commit(self, report: list[dict] | None = None, stream: str | None = None, epoch: int = 0) -> Manifest:
        """Publishes the next version."""
        b = self.base
        epochs = b.epochs | ({stream: epoch} if stream else {})
        out = Manifest(b.version + 1, b.buckets, [f for f in b.data if f not in self.dropped] + self._own("data"), b.meters + self._own("meters"), [*b.loads, self.id], epochs, self.id, report or [])
        self.store.publish(out)
        return out


def index_key(name: str, column: str) -> Column:
    """A key column as the index holds it; null, '' and the not-found text of older stores are the same."""
    return (F.col(column) if name == "issuer" else T.found(F.col(column).cast("string"))).alias(name)


def bucket(account: Column, n: int) -> Column:
    """The bucket of a bill or meter row by its account."""
    return F.pmod(F.xxhash64(F.coalesce(T.account_key(account), F.lit(""))), F.lit(n)).cast("int")


def in_buckets(folders: list[str], buckets: list[int]) -> list[str]:
    own = {f"bucket={b}" for b in buckets}
    return [f for f in folders if own & set(f.split("/"))]


def history(spark: SparkSession, path: str) -> DataFrame:
    """(version, EMPRESA, bills, added, ignored, files, no_total): what each load and each micro-batch did."""
    try:
        told = spark.read.schema(HISTORY).json(f"{path.rstrip('/')}/versions")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        told = spark.createDataFrame([], HISTORY)
    return told.select("version", F.explode("report").alias("r")).select("version", "r.*")
