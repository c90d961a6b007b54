r"""Line dedup on levelled sorted runs of line hashes.

A line's key is the line stripped of ASCII white space at both ends, with A-Z lower-cased. Each batch of documents aggregates
its own keys, merge-anti-joins them with the runs to find keys that need a new holder (the batch's largest doc_id), and adds a
new sorted run. When a level has `fanout` runs they are merged into one run of the next level. Keys are 128-bit hashes, so a
run costs 40 bytes a distinct line. Runs lie in a folder, from which a later batch can go on.

Defined results: null or empty text is one empty line. Each row counts as a document, also where doc_ids repeat; all rows
with the holder's doc_id keep the line. A null doc_id counts below all others. Lines of key length under `min_chars`
always stay. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aquabill.llm import common

KEY = ["h1", "h2"]
RUN = "h1 bigint, h2 bigint, n bigint, holder bigint"
MANIFEST = "version long, buckets int, level int, place int, name string"
SORTED_SCANS = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def line_key(line: Column) -> Column:
    return common.lower_ascii(F.btrim(line, F.lit(common.ASCII_SPACE)))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _hashes(text: Column, min_chars: int) -> Column:
    """Per line a struct of the key's hashes, null for short keys."""
    keys = F.transform(split_lines(text), line_key)
    return F.transform(keys, lambda k: F.when(F.length(k) >= min_chars, F.struct(*[h.alias(n) for h, n in zip(common.text_hash(k), KEY)])))


class LineRuns:
    """Sorted runs under root, a folder of the shared one if none is given; a later call with that root goes on from its runs.

    A run is a table bucketed and sorted by key, all with the same number of buckets, so joins of runs and a batch merge bucket
    by bucket: only the batch's own aggregate is shuffled, and nothing is sorted again. The driver holds only the runs' names.
    """

    def __init__(self, spark: SparkSession, min_chars: int = 40, fanout: int = 2, root: str | None = None):
        self.spark, self.min_chars, self.fanout = spark, min_chars, fanout
        self.root = (root or common.new_path(spark, "line-runs")).rstrip("/")
        self.levels: dict[int, list[str]] = {}
        self.merged_away: list[str] = []
        self.version, self.buckets = 0, int(spark.conf.get("spark.sql.shuffle.partitions"))
        if known := self._manifest():
            self.version, self.buckets = known[0]["version"], known[0]["buckets"]
            for r in known:
                if r["name"]:
                    self.levels.setdefault(r["level"], []).append(r["name"])

    def _manifest(self) -> list:
        """The runs of the latest version; there are few, since their number grows as a logarithm of the batches."""
        try:
            every = self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        latest = every.agg(F.max("version")).first()[0]
        return every.where(F.col("version") == latest).orderBy("level", "place").collect()

    def _save(self) -> None:
        self.version += 1
        rows = [(self.version, self.buckets, level, i, name) for level, names in self.levels.items() for i, name in enumerate(names)]
        self.spark.createDataFrame(rows or [(self.version, self.buckets, 0, 0, None)], MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")
        for name in self.merged_away:  # no version to come reads them
            self._drop(name)
        self.merged_away = []

    def _drop(self, name: str) -> None:
        self.spark.sql(f"drop table if exists {name}")
        common.remove(self.spark, f"{self.root}/{name}")

    def drop(self) -> None:
        """Deletes all runs and the manifest."""
        for names in self.levels.values():
            for name in names:
                self._drop(name)
        common.remove(self.spark, self.root)

    def _write(self, level: int, run: DataFrame) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        before = self.spark.conf.get(SORTED_SCANS)
        self.spark.conf.set(SORTED_SCANS, "true")  # a bucket is one file, so its order holds for the whole bucket
        try:
            run.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", f"{self.root}/{name}").saveAsTable(name)
        finally:
            self.spark.conf.set(SORTED_SCANS, before)
        self.levels.setdefault(level, []).append(name)

    def _read(self, name: str) -> DataFrame:
        if not self.spark.catalog.tableExists(name):  # written by another session
            keys, place = ", ".join(KEY), f"{self.root}/{name}".replace("'", "\\'")
            self.spark.sql(f"create table {name} ({RUN}) using parquet clustered by ({keys}) sorted by ({keys}) into {self.buckets} buckets location '{place}'")
        return self.spark.table(name)

    def runs(self) -> list[DataFrame]:
        return [self._read(name) for names in self.levels.values() for name in names]

    def add(self, batch: DataFrame) -> None:
        """Adds a batch (doc_id, text) as a new run. Only keys that no run holds, or holds for smaller doc_ids, bring a holder."""
        # distinct within a row first: one count per document, and the shuffle needs one partial aggregate only
        hashes = F.explode(F.array_distinct(_hashes(F.col("text"), self.min_chars)))
        lines = batch.select(F.col("doc_id").cast("long").alias("doc_id"), hashes.alias("k")).where("k is not null")
        own = lines.select("k.*", "doc_id").groupBy(*KEY).agg(F.count("*").alias("n"), F.max("doc_id").alias("holder"))
        known = []
        for i, run in enumerate(self.runs()):
            known.append(f"known{i}")
            own = own.join(run.select(*KEY, F.col("holder").alias(known[-1])).hint("merge"), KEY, "left")
        seen = F.greatest(F.lit(None).cast("long"), F.lit(None).cast("long"), *known)
        holder = F.when(seen.isNull() | (F.col("holder") > seen), F.col("holder"))
        self._write(0, own.select(*KEY, "n", holder.alias("holder")))
        self.compact()
        self._save()

    def compact(self) -> None:
        """Merges the runs of each full level, two by two, into one run of the next."""
        for level in range(len(self.levels) + 1):
            if len(self.levels.get(level, [])) >= self.fanout:
                self._merge(self.levels.pop(level), level + 1)

    def _merge(self, names: list[str], level: int) -> None:
        while len(names) > 1:
            self._write(level, self.merged(self._read(names[0]), self._read(names[1])))
            self.merged_away += names[:2]
            names = [*names[2:], self.levels[level].pop()]
        self.levels.setdefault(level, []).extend(names)

    @staticmethod
    def merged(a: DataFrame, b: DataFrame) -> DataFrame:
        """Two runs as one, by a merge join of their buckets."""
        b = b.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("n").alias("m"), F.col("holder").alias("other")).hint("merge")
        both = a.join(b, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "full")
        zero = F.lit(0).cast("long")
        return both.select(
            F.coalesce("h1", "g1").alias("h1"), F.coalesce("h2", "g2").alias("h2"), (F.coalesce("n", zero) + F.coalesce("m", zero)).alias("n"),
            F.greatest("holder", "other").alias("holder"),
        )

    def frequent(self, min_docs: int) -> DataFrame:
        """(h1, h2, n, holder) of the keys found in at least min_docs documents. All runs are merged into one first."""
        names = [name for level in sorted(self.levels) for name in self.levels[level]]
        if len(names) > 1:
            level = max(self.levels) + 1
            self.levels = {}
            self._merge(names, level)
            self._save()
        return self.runs()[0].where(F.col("n") >= min_docs)


def index(docs: DataFrame, n_batches: int, min_chars: int, root: str | None = None) -> LineRuns:
    """Feeds the table to LineRuns in batches of descending doc_id ranges of about equal size."""
    runs = LineRuns(docs.sparkSession, min_chars, root=root)
    cuts = docs.select(F.percentile_approx(F.col("doc_id").cast("long"), [i / n_batches for i in range(1, n_batches)], 10000)).first()[0] or []
    low, d = sorted(set(cuts)), F.col("doc_id").cast("long")
    for i in range(len(low), -1, -1):
        part = d >= low[i - 1] if i else d.isNull() | (d < low[0]) if low else F.lit(True)
        if 0 < i < len(low):
            part = part & (d < low[i])
        runs.add(docs.select("doc_id", "text").where(part))
    return runs


def dropped_lines(docs: DataFrame, frequent: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, t1, t2, drops): per distinct row, the numbers of its lines that go."""
    t1, t2 = common.text_hash(F.coalesce(F.col("text"), F.lit("")))
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), t1.alias("t1"), t2.alias("t2"), F.posexplode(_hashes(F.col("text"), min_chars)).alias("line", "k"))
    lines = every.where("k is not null").select("doc_id", "t1", "t2", "line", "k.*")
    gone = common.join_by_key(lines, frequent, KEY, "n").where(~F.col("doc_id").eqNullSafe(F.col("holder")))
    return gone.groupBy("doc_id", "t1", "t2").agg(F.collect_set("line").alias("drops"))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, n_batches: int = 4) -> DataFrame:
    """docs (doc_id, text and any other columns) with text replaced by the kept lines, plus n_lines and n_dropped.

    Columns of docs that are called n_lines or n_dropped are replaced. n_batches sets only the size of a batch.
    """
    runs = index(docs, n_batches, min_chars)
    frequent = common.materialise(runs.frequent(min_docs), "frequent-lines")
    runs.drop()
    drops = dropped_lines(docs, frequent, min_chars)
    t1, t2 = common.text_hash(F.coalesce(F.col("text"), F.lit("")))
    cols = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    left = docs.select(F.struct(*cols).alias("row"), "text", F.col("doc_id").cast("long").alias("d"), t1.alias("a"), t2.alias("b"))
    r = drops.select(F.col("doc_id").alias("rd"), F.col("t1").alias("ra"), F.col("t2").alias("rb"), "drops")
    joined = left.join(r, F.col("d").eqNullSafe(F.col("rd")) & (F.col("a") == F.col("ra")) & (F.col("b") == F.col("rb")), "left")
    lines = split_lines(F.col("text"))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("drops"))
    text = F.when(F.col("drops").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    return joined.select(
        *[text.alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in cols],
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = r"""
with docs as (select row_number() over () as rid, doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
lines as (select rid, doc_id, ls[i] as line, i from (select *, unnest(range(1, len(ls) + 1)) as i from docs)),
keyed as (select *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from lines),
freq as (select k, max(doc_id) as holder from keyed where length(k) >= 40 group by k having count(distinct rid) >= 5),
marked as (select keyed.*, freq.k is not null and keyed.doc_id is distinct from freq.holder as gone from keyed left join freq on keyed.k = freq.k)
select any_value(doc_id) as doc_id, count(*)::bigint as n_lines, count(*) filter (where gone)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256
from marked group by rid
"""
