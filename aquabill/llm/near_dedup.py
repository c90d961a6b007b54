r"""MinHash near-dedup: exact Jaccard links between word-shingle sets, found by banded minima, and their components.

1. Each text is sketched once: number of distinct shingles, a 128-bit hash of its words, `HASHES` universal hash minima,
   and a hash of each band of `ROWS` minima.
2. Texts with equal words are one node, named by the smallest doc_id, so a group of copies costs one node. Where a doc_id has
   several texts, their nodes are linked.
3. Nodes that share a band hash are in one bucket. A bucket never emits all its pairs: every member is paired with the
   bucket's smallest node and, in buckets of more than `SUB` nodes, with the leader of a random subgroup of about SUB.
4. Pairs are confirmed on the full shingle sets, and the links' components come from alternating large-star and small-star.
5. In buckets of three or more nodes that still hold several components, members outside of the bucket's largest component
   are compared with all others, block against block: pairs of different components whose signatures agree in `cut` of
   their minima or more are confirmed there and then on the full sets, and only links leave the task. With these links
   the components are final, since every pair of two components that shares a bucket has been judged.

A pair at the threshold t shares no band with probability (1 - t^4)^25, 2e-6 at 0.8 and 9e-9 at 0.85. The cut lies six standard
deviations of the agreement below the threshold (0.56 for 0.8, 0.63 for 0.85), so a pair that no bucket leader found is lost
there with about 1e-8. Shingles are compared by 64-bit hashes.

Step 5 compares each unlinked member with its bucket, so its work is quadratic in what is alike and yet no link or chain of
links connects; its memory is bounded by the blocks, and no pairs are emitted.

Defined results: A-Z are lower-cased, words are runs without ASCII white space. Fewer words than a shingle has give one
shingle; null text or text without words has none and is linked with nothing. Rows with one doc_id are one document, whose texts
are all compared and linked. Rows without a doc_id are linked with nothing. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aquabill.llm import common

BANDS, ROWS = 25, 4
HASHES = BANDS * ROWS
#: Nodes of a subgroup; nodes and shingles of a block.
SUB, BLOCK, BLOCK_SHINGLES = 64, 1024, 500_000
MAX_WORDS = 100_000
_LOWER = bytes.maketrans(common.UPPER.encode(), common.LOWER.encode())
_random = np.random.default_rng(20240601)
_A = _random.integers(1, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _random.integers(0, 1 << 63, HASHES, np.uint64)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def shingles(own: list[bytes], k: int, hashes: _WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles. hashes keeps those of words, about MAX_WORDS of them."""
    if not own:
        return np.zeros(0, np.uint64)
    if len(hashes) > MAX_WORDS:
        hashes.clear()
    h = np.fromiter(map(hashes.__getitem__, own), np.uint64, len(own))
    k = min(k, len(own))
    s = np.zeros(len(own) - k + 1, np.uint64)
    for j in range(k):
        s = _mixed(s * _MIX[0] + h[j : len(h) - k + 1 + j])
    return np.unique(s)


def whole_hash(own: list[bytes]) -> int:
    """128-bit hash of a text's words."""
    return xxhash.xxh3_128_intdigest(b" ".join(own))


def minima(s: np.ndarray) -> np.ndarray:
    """The upper halves of the HASHES minima."""
    out = np.full(HASHES, np.iinfo(np.uint64).max)
    for a in range(0, len(s), 2048):
        out = np.minimum(out, (s[None, a : a + 2048] * _A[:, None] + _B[:, None]).min(axis=1))
    return (out >> np.uint64(32)).astype(np.uint32)


def band_hashes(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each band of each signature; the band's number is part of it."""
    rows = signatures.reshape(-1, BANDS, ROWS).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2])
    for r in range(ROWS):
        h = _mixed(h * _MIX[0] + rows[:, :, r])
    return h.view(np.int64)


def sketch(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, w1, w2, n_shingles, bands array<long>, signature binary) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            n = len(batch)
            keys, sizes, signatures = np.zeros((n, 2), np.uint64), np.zeros(n, np.int64), np.zeros((n, HASHES), np.uint32)
            for i, t in enumerate(batch.column("text")):
                own = words(t.as_py())
                s = shingles(own, k, hashes)
                whole = whole_hash(own)
                keys[i], sizes[i], signatures[i] = (whole >> 64, whole & ((1 << 64) - 1)), len(s), minima(s)
            flat = np.ascontiguousarray(band_hashes(signatures)).ravel()
            bands = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * BANDS, pa.int32()), pa.array(flat))
            w1, w2 = (pa.array(np.ascontiguousarray(keys[:, k]).view(np.int64)) for k in range(2))
            columns = [batch.column("doc_id"), w1, w2, pa.array(sizes), bands, pa.array([x.tobytes() for x in signatures], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "w1", "w2", "n_shingles", "bands", "signature"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, w1 long, w2 long, n_shingles long, bands array<long>, signature binary")


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """(doc, w1, s): the distinct shingle hashes of each row, sorted, and w1 as in sketch()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            texts = batch.column("text")
            for a in range(0, len(batch), 500):
                own = [words(t.as_py()) for t in texts.slice(a, 500)]
                sets = [np.sort(shingles(w, k, hashes).view(np.int64)) for w in own]
                w1 = np.array([whole_hash(w) >> 64 for w in own], np.uint64).view(np.int64)
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([batch.column("doc").slice(a, 500), pa.array(w1), lists], ["doc", "w1", "s"])

    return docs.select(F.col("doc_id").cast("long").alias("doc"), "text").mapInArrow(run, "doc long, w1 long, s array<long>")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= percent * union. The pairs of a leader a are dealt to parts of about BLOCK, each with a copy of its set."""
    parts = pairs.groupBy("a").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / BLOCK).cast("int"))
    dealt = common.join_by_key(pairs, parts, ["a"], "n").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    copies = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    left = sets.select(F.col("doc").alias("a"), F.col("s").alias("sa")).join(parts, "a").select("a", "sa", copies)  # of every text of a doc_id
    right = sets.select(F.col("doc").alias("b"), F.col("s").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return dealt.join(right, "b").join(left, ["a", "part"]).where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in links (a, b); component is its smallest node.

    Large-star: each node's larger neighbours move to its smallest neighbour (or itself). Small-star: its smaller
    neighbours do. Alternated until nothing moves; every round is written, so a lost executor costs no earlier round.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        if large:
            both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("low"), F.count("*").alias("n")).persist()
        at = common.join_by_key(both, low, ["a"], "n")
        movers = at.where("b > a").select("b", "low") if large else at.select("b", "low").unionByName(low.select(F.col("a").alias("b"), "low"))
        moved = movers.select(F.col("b").alias("a"), F.col("low").alias("b"))
        out = common.materialise(moved.where("a <> b").distinct(), "star-edges")
        low.unpersist()
        return out

    def mark(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    ordered = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = common.materialise(ordered.distinct(), "star-edges")
    before = mark(edges)
    while before[0]:
        half = star(edges, large=True)
        last, edges = edges, star(half, large=False)
        common.discard(last, half)
        if (now := mark(edges)) == before:
            break
        before = now
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())


def _labelled(members: DataFrame, found: DataFrame) -> DataFrame:
    """members with each one's component so far, itself if it has none."""
    parts = found.select(F.col("node").alias("doc"), F.col("component").alias("comp"))
    return members.join(parts, "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))


def unresolved_links(members: DataFrame, found: DataFrame, signatures: DataFrame, sets: DataFrame, percent: int, cut: float) -> DataFrame:
    """Links (a, b) of different components in one bucket, of the pairs whose signatures agree in a share of cut or more."""
    # buckets of two nodes have had their only pair judged
    at = common.materialise(_labelled(members.where("size > 2"), found), "near-members")
    parts = at.groupBy("h", "comp").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    largest = parts.groupBy("h").agg(
        F.max_by("comp", F.struct("n", "comp")).alias("main"), F.count("*").alias("parts"),
        F.sum("n").alias("all"), F.max("n").alias("most"), F.sum("s").alias("s"),
    )
    table = common.materialise(largest.where("parts > 1"), "near-buckets")
    open_ = common.join_by_key(at, table, ["h"], "all")
    blocks = lambda n: F.greatest(F.ceil(n / BLOCK), F.ceil(F.col("s") * n / F.col("all") / BLOCK_SHINGLES)).cast("int")
    n_members, n_asking = blocks(F.col("all")), blocks(F.col("all") - F.col("most"))
    block = lambda n: F.pmod(F.xxhash64("doc"), n).cast("int")
    # every member meets every asking block of its bucket, in one block of members; no task holds more than both
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    own = ["h", "band", "doc", "comp"]
    told = open_.select(*own, F.lit(False).alias("asks"), every(n_asking).alias("x"), block(n_members).alias("y"))
    asking = open_.where("comp <> main").select(*own, F.lit(True).alias("asks"), block(n_asking).alias("x"), every(n_members).alias("y"))
    rows = told.unionByName(asking).join(signatures.join(sets, ["doc", "w1"]).drop("w1"), "doc")

    def compare(table):
        asks = table.column("asks").to_numpy()
        doc, comp = table.column("doc").to_numpy(), table.column("comp").to_numpy()
        sig = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint32).reshape(-1, HASHES)
        own = [x.values.to_numpy() for x in table.column("s")]
        band, a, b = table.column("band")[0].as_py(), [], []
        other = np.flatnonzero(~asks)
        for i in np.flatnonzero(asks):
            same = sig[other] == sig[i]
            # a pair is judged in the first bucket that it shares
            alike = (np.count_nonzero(same, axis=1) >= cut * HASHES) & (comp[other] != comp[i])
            rest = same[alike].reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == band
            for j in other[alike][rest]:
                mine, its = own[i], own[j]
                both = np.count_nonzero(its[np.minimum(np.searchsorted(its, mine), len(its) - 1)] == mine)
                if 100 * both >= percent * (len(mine) + len(its) - both):
                    a.append(min(doc[i], doc[j]))
                    b.append(max(doc[i], doc[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("h", "x", "y").applyInArrow(compare, "a long, b long").distinct()


def own_links(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Links (a, b) of each doc_id that has several texts to the nodes of its texts."""
    several = rows.groupBy("doc_id").agg(F.min("w1").alias("low"), F.max("w1").alias("high"), F.count("*").alias("doc_rows")).where("low <> high")
    texts = common.join_by_key(rows.select("doc_id", "w1", "w2"), several, ["doc_id"], "doc_rows").select("doc_id", "w1", "w2")
    return common.join_by_key(texts, groups, ["w1", "w2"], "n").select(F.col("doc_id").alias("a"), F.col("doc").alias("b")).distinct()


def near_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id): one row per row of docs."""
    own = common.materialise(sketch(docs, k).withColumn("row", F.monotonically_increasing_id()), "near-sketches")
    some, none = own.where("n_shingles > 0 and doc_id is not null"), own.where("n_shingles = 0 or doc_id is null")
    copies = some.groupBy("w1", "w2").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.count("*").alias("n"))
    groups = common.materialise(copies.select("w1", "w2", F.col("first.doc_id").alias("doc"), F.col("first.row").alias("row"), "n"), "near-groups")
    nodes = some.join(groups.select("row"), "row", "left_semi").withColumnRenamed("doc_id", "doc")  # one row a node
    entries = nodes.select("doc", "n_shingles", F.posexplode("bands").alias("band", "h"))
    buckets = common.materialise(entries.groupBy("h").agg(F.count("*").alias("size"), F.min("doc").alias("lead")).where("size > 1"), "near-buckets")
    members = common.materialise(common.join_by_key(entries, buckets, ["h"], "size"), "near-members")
    signatures = nodes.join(members.select("doc").distinct(), "doc", "left_semi").select("doc", "w1", "signature")
    asked = members.select(F.col("doc").alias("doc_id")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(asked, "doc_id", "left_semi")
    sets = common.materialise(shingle_sets(texts, k).dropDuplicates(["doc", "w1"]), "near-sets")

    big = members.where(F.col("size") > SUB).withColumn("sub", F.pmod(F.xxhash64("doc", "h"), F.ceil(F.col("size") / SUB)))
    heads = big.groupBy("h", "sub").agg(F.min_by("doc", F.xxhash64("h", "doc")).alias("head"))
    led = big.join(heads, ["h", "sub"]).select(F.least("head", "doc").alias("a"), F.greatest("head", "doc").alias("b"))
    pairs = members.select(F.col("lead").alias("a"), F.col("doc").alias("b")).unionByName(led)
    pairs = common.materialise(pairs.where("a <> b").distinct(), "near-pairs")
    links = common.materialise(confirm(pairs, sets, percent).unionByName(own_links(some, groups)), "near-links")
    found = common.materialise(components(links), "near-components")
    cut = percent / 100 - 6 * (percent / 100 * (1 - percent / 100) / HASHES) ** 0.5
    more = common.materialise(unresolved_links(members, found, signatures, sets, percent, cut), "near-links")
    if not more.isEmpty():
        # the stars found so far stand for their links
        found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))

    named = groups.join(found.withColumnRenamed("node", "doc"), "doc", "left")
    table = common.materialise(named.select("w1", "w2", "n", F.coalesce("component", "doc").alias("component_id")), "near-table")
    common.discard(buckets, members, sets, pairs, links, more)
    linked = common.join_by_key(some.select("doc_id", "n_shingles", "w1", "w2"), table, ["w1", "w2"], "n").select("doc_id", "n_shingles", "component_id")
    return linked.unionByName(none.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs without the rows whose doc_id is not the smallest of its component."""
    gone = near_components(docs, k, percent).where("component_id <> doc_id").select(F.col("doc_id").alias("near_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["near_gone"], "left_anti")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), k=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


ORACLE = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sh as (select distinct doc_id, unnest(case when len(w) = 0 then []::varchar[] when len(w) < 3 then [array_to_string(w, ' ')]
  else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as s from d),
n as (select doc_id, count(*) as n from sh group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
e as (select a, b from l union all select b, a from l),
r as (select doc_id as x, doc_id as y from n union select r.x, e.b from r join e on e.a = r.y),
c as (select x, min(y) as c from r group by 1)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(c.c, d.doc_id) as component_id, coalesce(c.c, d.doc_id) = d.doc_id as kept
from d left join n on n.doc_id = d.doc_id left join c on c.x = d.doc_id
"""
