"""Mixing sources: targets by a plain loop, bounds of the taken words, odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from aquabill.llm import mixture


def plain_targets(sizes, weights=mixture.WEIGHTS, most=mixture.MOST):
    """Shares by weight; those above their bound stop there and the rest is shared again."""
    names = sorted([s for s in sizes if s is not None]) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, whole = set(), sum(sizes.values())
    while True:
        left, of = whole - most * sum(sizes[s] for s in full), sum(w for s, w in weight.items() if s not in full)
        over = {s for s in names if s not in full and weight[s] * left / of > most * sizes[s]}
        if not over:
            return {s: float(most * sizes[s]) if s in full else weight[s] * left / of for s in names}
        full |= over


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}é"[: 2 + i % 2]: int(10 ** rng.uniform(0, 5)) for i in range(10)} | {None: 17, "": 3, "none": 0}
    got = mixture.targets(spark.createDataFrame(list(sizes.items()), "source string, size long"))
    want = plain_targets(sizes)
    assert {r["source"]: (r["source_size"], pytest.approx(r["target"])) for r in got.collect()} == {s: (n, want[s]) for s, n in sizes.items()}


def test_taken_words_are_near_the_target(spark):
    rng = random.Random(3)
    rows = [(i, f"s{i % 4 if i % 3 else 0}", int(10 ** rng.uniform(0, 3))) for i in range(4000)]
    got = [r.asDict() for r in mixture.copies(spark.createDataFrame(rows, "doc_id long, source string, size long")).collect()]
    assert len(got) == len(rows)
    for s in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == s]
        each = own[0]["target"] / own[0]["source_size"]
        assert abs(sum(r["size"] * r["mix_copies"] for r in own) - own[0]["target"]) <= 2 * max(r["size"] for r in own)
        assert {r["mix_copies"] for r in own} <= {int(each), int(each) + 1}


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t\x0b\n", "a"), (4, "one two\x00three\xa0x", None), (None, "no id", None), (6, "w " * 5000, "b"), (7, "x y", "b"), (7, "x y", "b"), (8, "z", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"size": F.lit("mine"), "mix_copies": F.lit(1), "row": F.lit(2), "target": F.lit(3)})
    mixed = mixture.mix(docs)
    assert mixed.columns == docs.columns and mixed.where("size <> 'mine' or row <> 2").count() == 0
    assert mixture.mix(docs).orderBy("doc_id", "text").collect() == mixed.orderBy("doc_id", "text").collect()
    assert mixed.where("doc_id = 6").count() <= 3
    assert mixed.where("doc_id in (1, 2, 3)").count() == 0  # a source without words
    assert mixture.mix(docs.limit(0)).count() == 0


def test_a_source_of_copies(spark):
    """One source holds nearly all rows, all of one size: they are numbered in many tasks."""
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 50 == 0, "b").otherwise("a").alias("source"), F.lit(7).cast("long").alias("size"))
    out = mixture.copies(rows).groupBy("source").agg(F.sum(F.col("size") * F.col("mix_copies")).alias("taken"), F.max("target").alias("target"), F.max("mix_copies").alias("most"))
    for r in out.collect():
        assert abs(r["taken"] - r["target"]) <= 14 and r["most"] <= 3
