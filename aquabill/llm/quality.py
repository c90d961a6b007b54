r"""Quality rules by weak supervision.

Rules look at one document each and vote keep (1), drop (0) or abstain (-1). Votes of all documents are counted by pattern
(at most 3^rules patterns, whatever the input), and expectation-maximisation on these counts estimates how often documents
are good and how often each rule is right on good and on bad ones. A document is kept when its posterior probability of
being good is at least `min_posterior`; a single failed rule does not drop it.

Words are maximal runs without ASCII white space, whole texts are read, and counts are in code points.

Defined results: null text is text without words. Without words all rules abstain but the word count, which votes drop.
Rows are judged one by one, so repeated rows repeat; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aquabill.llm import common

#: Fixed values.
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: What the scan measures.
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclaim", "n_ended_lines", "n_distinct", "n_letters", "n_marked", "n_bare"]
ENDS = tuple(".?…\"')")
_ASCII, _LETTERS = bytes(range(128)), (common.UPPER + common.LOWER).encode()
_SYMBOLS = SYMBOLS.encode()


def repeated_words(ids: list[int], distinct: int) -> int:
    """Words that lie in a 3-word window found twice or more."""
    n = len(ids)
    if n < 4:
        return 0
    a = np.array(ids)
    pair = np.unique(a[:-1] * distinct + a[1:], return_inverse=True)[1]
    _, which, counts = np.unique(pair[:-1] * distinct + a[2:], return_inverse=True, return_counts=True)
    again = counts[which] > 1
    inside = np.zeros(n, bool)
    for k in range(3):
        inside[k : n - 2 + k] |= again
    return int(inside.sum())


def marked_words(ids: list[int], index: dict[bytes, int]) -> tuple[int, int]:
    """Words that end in a symbol, and words of nothing but symbols."""
    n = np.bincount(np.array(ids, np.int64), minlength=len(index))
    marked = [i for w, i in index.items() if w[-1] in _SYMBOLS]
    bare = [i for w, i in index.items() if w[-1] in _SYMBOLS and not w.strip(_SYMBOLS)]
    return int(n[marked].sum()), int(n[bare].sum())


def measure(text: str) -> tuple[int, ...]:
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # bytes are split at ASCII white space only
    index: dict[bytes, int] = {}
    ids = [index.setdefault(w, len(index)) for w in words]
    others = len(data.translate(None, _ASCII))  # bytes of other characters than ASCII
    letters = len(data) - len(data.translate(None, _LETTERS)) + len(text) - (len(data) - others)
    seen, dups, lines, ended = set(), 0, 0, 0
    for line in text.split("\n"):
        bare = line.strip(common.ASCII_SPACE)
        if bare:
            lines += 1
            ended += bare.endswith(ENDS)
            dups += line in seen
            seen.add(line)
    symbols = sum(map(text.count, SYMBOLS))
    return (
        len(words), len(text) - sum(map(text.count, common.ASCII_SPACE)), symbols, dups, repeated_words(ids, len(index)),
        lines, len(data) - len(data.translate(None, common.UPPER.encode())), text.count("!"), ended, len(index), letters,
        *(marked_words(ids, index) if symbols else (0, 0)),
    )


def features(docs: DataFrame) -> DataFrame:
    """doc_id and FEATURES of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(t.as_py() or "") for t in batch.column("text")]
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * len(FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *FEATURES])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{f} long" for f in FEATURES))


def rules() -> dict[str, Column]:
    """Each rule's vote: 1, 0 or -1, from FEATURES."""
    c = {f: F.col(f).cast("double") for f in FEATURES}
    share = lambda a, b: c[a] / F.when(c[b] > 0, c[b])

    def vote(keep: Column, drop: Column) -> Column:
        return F.when(keep, 1).when(drop, 0).otherwise(-1)

    length = share("word_chars", "n_words")
    symbols, dups, repeats = share("n_symbols", "n_words"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words")
    upper, exclaim, ended = share("n_upper", "word_chars"), share("n_exclaim", "n_words"), share("n_ended_lines", "n_lines")
    marked, bare = share("n_marked", "n_words"), share("n_bare", "n_words")
    distinct, letters = share("n_distinct", "n_words"), share("n_letters", "word_chars")
    return {
        "words": vote(c["n_words"] >= 50, c["n_words"] < 20),
        "word_length": vote(length.between(3, 10), (length < 2.5) | (length > 12)),
        "symbols": vote(symbols < 0.05, symbols > 0.25),
        "dup_lines": vote(dups < 0.1, dups > 0.3),
        "repeats": vote(repeats < 0.15, repeats > 0.4),
        "upper": vote(upper < 0.15, upper > 0.4),
        "exclaim": vote(exclaim < 0.05, exclaim > 0.3),
        "ended": vote(ended > 0.5, ended < 0.1),
        "letters": vote(letters > 0.85, letters < 0.75),
        "marked": vote(marked < 0.05, marked > 0.2),
        "bare": vote(bare < 0.02, bare > 0.1),
        "distinct": vote((distinct > 0.25) | (c["n_words"] >= 1000) & (distinct > 0.1), distinct < 0.05),
    }


def pattern_code(votes: list[Column]) -> Column:
    """The votes as digits of base 3."""
    code = F.lit(0)
    for v in votes:
        code = code * 3 + v + 1
    return code


def posteriors(counts: dict[int, int], n_rules: int, steps: int = 100) -> dict[int, float]:
    """P(good) of each vote pattern, by expectation-maximisation over pattern counts.

    Rules are taken as independent given the truth, and abstaining as saying nothing. The prior on each rule's rates
    (keep votes on 0.98 of the good and on 0.7 of the bad documents, since each rule knows one kind of bad) keeps the classes
    from changing places. No rule counts as right on more than 0.97 of the good documents, so that one drop vote among keep
    votes never decides.
    """
    if not counts:
        return {}
    codes = np.array(sorted(counts))
    n = np.array([counts[c] for c in codes], float)
    votes = np.stack([codes // 3**k % 3 - 1 for k in reversed(range(n_rules))], axis=1)
    good, bad, prior = np.full(n_rules, 0.97), np.full(n_rules, 0.7), 0.8  # P(vote keep | good), P(vote keep | bad)
    weight = 0.01 * n.sum() + 1
    for _ in range(steps):
        logit = math.log(prior / (1 - prior)) + np.where(votes == 1, np.log(good / bad), np.where(votes == 0, np.log((1 - good) / (1 - bad)), 0)).sum(axis=1)
        p = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
        prior = float(np.clip((p * n).sum() / n.sum(), 0.02, 0.98))

        def rate(w: np.ndarray, start: float) -> np.ndarray:
            kept, told = (w[:, None] * (votes == 1)).sum(axis=0), (w[:, None] * (votes >= 0)).sum(axis=0)
            return np.clip((kept + weight * start) / (told + weight), 0.001, 0.999)

        good, bad = np.minimum(rate(p * n, 0.98), 0.97), rate((1 - p) * n, 0.7)
        bad = np.minimum(bad, good)  # a rule is no better than chance at worst
    return dict(zip(codes.tolist(), p.tolist()))


def judge(docs: DataFrame, min_posterior: float = 0.5) -> DataFrame:
    """doc_id, FEATURES and posterior of each row, and good: whether the posterior reaches min_posterior."""
    votes = list(rules().values())
    measured = common.materialise(features(docs).withColumn("pattern", pattern_code(votes)), "quality-features")
    counts = {r["pattern"]: r["count"] for r in measured.groupBy("pattern").count().collect()}  # at most 3^rules rows
    p = posteriors(counts, len(votes))
    table = docs.sparkSession.createDataFrame(list(p.items()), "pattern int, posterior double")
    return measured.join(F.broadcast(table), "pattern").withColumn("good", F.col("posterior") >= min_posterior)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return judged.select("doc_id", *FEATURES[:5], failed.alias("base_failed"), (~failed & F.col("good")).alias("kept"))


ORACLE = r"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
g as (select rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select rid, w, unnest(range(1, len(w) - 1)) as i from w)),
again as (select rid, i from (select *, count(*) over (partition by rid, g) as c from g) where c > 1),
inside as (select rid, count(distinct p) as n from (select rid, unnest([i, i + 1, i + 2]) as p from again) group by 1)
select doc_id, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
  coalesce(n, 0)::bigint as n_repeat_words, len(w) < 50 or 100 * coalesce(n, 0) > 50 * len(w) as base_failed
from w left join inside using (rid)
"""
