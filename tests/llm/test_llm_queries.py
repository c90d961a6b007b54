import functools

import pytest
from oracle import same
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from aquabill.llm import bpe, common, queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    same(spark, sf_dir, entry.queries()[name], queries.oracle_sql()[name])


@pytest.mark.parametrize("name", ["op1_secret_scan", "op7_quality_rules"])
def test_query_runs(spark, sf_dir, name):
    assert entry.queries()[name](spark, sf_dir).count() > 0


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.materialise(stage(spark, docs, sf_dir), f"test-{name}")
        kept = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert kept <= ids and docs.count() == len(kept)
        if name != "bpe":
            assert docs.columns == columns
        ids = kept
    assert {"doc_id", "ids", "decoded", "n_tokens"} == set(docs.columns)
    assert docs.where("n_tokens <> size(ids)").count() == 0


def test_stages_equal_plain_models(spark, sf_dir):
    """What each stage keeps of its input, and the texts that it gives, against plain loops over all rows."""
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    docs, outs = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.materialise(stage(spark, docs, sf_dir), f"model-{name}")
        outs[name] = {r["doc_id"]: r["text"] if name != "bpe" else (r["ids"], r["decoded"]) for r in docs.collect()}

    want = {d: t for d, t in rows.items() if t and any(c.isalpha() for c in t)}  # the table has no text of another language
    assert outs["language_id"] == want

    keys = lambda t: [x.strip(common.ASCII_SPACE).translate(str.maketrans(common.UPPER, common.LOWER)) for x in t.split("\n")]
    holders = {}
    for d, t in want.items():
        for k in {k for k in keys(t) if len(k) >= 40}:
            holders.setdefault(k, []).append(d)
    gone = {k: max(own) for k, own in holders.items() if len(own) >= 5}
    want = {d: "\n".join(x for x, k in zip(t.split("\n"), keys(t)) if gone.get(k, d) == d) for d, t in want.items()}
    assert outs["line_dedup"] == want and gone

    def shingles(t):
        w = t.translate(str.maketrans(common.UPPER, common.LOWER)).split(None)
        return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()

    sets, low = {d: shingles(t) for d, t in want.items()}, {d: d for d in want}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in range(len(low)):
        before = dict(low)
        for a, b in pairs:
            low[a] = low[b] = min(low[a], low[b])
        if low == before:
            break
    want = {d: t for d, t in want.items() if low[d] == d}
    assert outs["near_dedup"] == want and len(want) < len(low)

    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    dropped = want.keys() - outs["decontaminate"].keys()
    verbatim = {d for d, t in want.items() if any(x[a : a + 50] in t for x in items.values() if x for a in range(max(len(x) - 49, 1)))}
    assert outs["decontaminate"] == {d: t for d, t in want.items() if d not in dropped} and verbatim and verbatim <= dropped
    for d in dropped - verbatim:  # an edited passage keeps some long part
        assert any(x[a : a + 16] in want[d] for x in items.values() if x for a in range(max(len(x) - 15, 1)))

    coder = bpe.Coder(bpe.load())
    for d, t in outs["decontaminate"].items():
        ids = coder.encode([t])[0].tolist()
        assert outs["bpe"][d] == (ids, coder.decode(ids))


def test_pipeline_on_odd_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 60").withColumns({"n_lines": F.lit("mine"), "language_id_result": F.lit(1), "row": F.lit(2)})
    odd = docs.limit(1).select([F.col(c) for c in docs.columns])
    odd = odd.withColumn("lang", F.lit(None).cast("string"))  # unlabelled rows teach nothing
    extra = [odd.withColumn("doc_id", F.lit(i).cast("long")).withColumn("text", F.lit(t)) for i, t in ((9001, None), (9002, ""), (9003, " \n\n"), (9004, "12 34"), (9006, "hjkasdhf jkashdf kjashd fkjahs dfkjh asdkjfh qzx"))]
    extra += [docs, docs.where("doc_id = 7"), odd.withColumn("doc_id", F.lit(None).cast("long")), docs.where("doc_id = 8").withColumns({"text": F.repeat("text", 300), "doc_id": F.lit(9005).cast("long")})]
    whole = functools.reduce(DataFrame.unionByName, extra)
    for start in (whole, whole.limit(0)):
        now = start
        for name, stage in corpus_pipeline.STAGES:
            now = common.materialise(stage(spark, now, sf_dir), f"test-{name}")
            if name != "bpe":
                assert now.columns == whole.columns and now.where("n_lines <> 'mine' or language_id_result <> 1").count() == 0
        ids = {r["doc_id"] for r in now.collect()}
        assert not ids & {9001, 9002, 9003, 9004, 9006} and bool(ids) == (start is whole)
