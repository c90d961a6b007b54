r"""Secret scans: fixed patterns, and character Markov models for strings that no pattern knows.

Two first-order Markov models over ASCII characters are trained from labelled samples: random strings (hex, base64 and
upper-case keys made from digests, and values that the patterns catch) and ordinary identifiers (words of a bounded
sample of documents, joined as snake_case, kebab-case, plain, paths and queries, some with a number, and dates and
numbers). A run of `[A-Za-z0-9+/_=-]` is a secret when the log-likelihood ratio of the two models reaches `min_llr` in some part of it of
`min_chars` characters or more; the whole run is the span, so a key behind a long path is found with its path.

Everything is DataFrame functions, and the work for a text grows as its length and the number of its matches. The driver holds only bigram counts, at most 2 x 128 x 128 numbers.

Defined results: null text is empty text. Positions are code points, ends exclusive. A Markov span that overlaps a span of
a pattern is not reported again. Rows are judged one by one, so repeated rows repeat and an empty table stays empty.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed patterns (name, pattern, shortest match or value).
ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 12, 18, 16
KINDS = ["assign", "access", "hex", "markov"]
MARKOV = KINDS.index("markov")
#: Places of a text's matches that are gathered at once.
BLOCK = 128
CANDIDATE = r"[A-Za-z0-9+/_=-]+"
SPAN = "array<struct<start:int,kind:int,end:int>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def running(values: Column, step: Callable[[Column, Column], Column], zero: Column) -> Column:
    """What folding an array by an associative step has given up to each place.

    An array that grows in a fold is copied at every place, so places are folded in blocks of BLOCK, each from the fold of
    the blocks before it: n places cost n * BLOCK / 2 copies, not n * n / 2.
    """
    fold = lambda array, start: F.aggregate(array, start, step)
    block = lambda array, i: F.slice(array, i * BLOCK + 1, F.lit(BLOCK))

    def places(array: Column, start: Column) -> Column:
        first = F.struct(start.alias("last"), F.array().cast("array<int>").alias("out"))
        grow = lambda acc, x: let(step(acc["last"], x), lambda y: F.struct(y.alias("last"), F.concat(acc["out"], F.array(y)).alias("out")))
        return F.aggregate(array, first, grow, lambda acc: acc["out"])

    def blocks(array: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(array) - 1) / BLOCK).cast("int"))
        totals = F.transform(numbers, lambda i: fold(block(array, i), zero))
        return let(totals, lambda t: F.flatten(F.transform(numbers, lambda i: places(block(array, i), fold(F.slice(t, F.lit(1), i), zero)))))

    return let(values, lambda array: F.when(F.size(array) > 0, blocks(array)).otherwise(F.array().cast("array<int>")))


def find(text: Column, gate: str, pattern: str, kind: int, keep) -> Column:
    """Leftmost non-overlapping matches as an array of (start, kind, end).

    Texts without a match of `gate` are not taken apart. `keep` judges a match's text; failing matches are dropped.
    """

    def spans(hits: Column) -> Column:
        gaps = F.slice(F.transform(F.split(text, pattern), lambda p: F.length(p)), F.lit(1), F.size(hits))
        ends = running(F.zip_with(gaps, hits, lambda gap, hit: gap + F.length(hit)), lambda a, b: a + b, F.lit(0))
        span = lambda end, hit: F.when(keep(hit), F.struct((end - F.length(hit)).alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
        return F.filter(F.zip_with(ends, hits, span), lambda s: s.isNotNull())

    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(text.rlike(gate), let(hits, spans)).otherwise(F.array()).cast(SPAN)


def without_overlaps(base: Column, more: Column) -> Column:
    """Both arrays of spans in order, without those of more that overlap one of base; each span meets its neighbours only."""

    def kept(every: Column) -> Column:
        own = lambda s: s["kind"] == MARKOV
        before = running(F.transform(every, lambda s: F.when(own(s), 0).otherwise(s["end"])), lambda a, b: F.greatest(a, b), F.lit(0))
        top = F.lit((1 << 31) - 1)
        after = F.reverse(running(F.reverse(F.transform(every, lambda s: F.when(own(s), top).otherwise(s["start"]))), lambda a, b: F.least(a, b), top))
        near = F.arrays_zip(every.alias("s"), before.alias("before"), after.alias("after"))
        clear = F.filter(near, lambda x: ~own(x["s"]) | (x["before"] <= x["s"]["start"]) & (x["after"] >= x["s"]["end"]))
        return F.transform(clear, lambda x: x["s"])

    return F.when(F.size(more) == 0, base).when(F.size(base) == 0, more).otherwise(let(F.array_sort(F.concat(base, more)), kept))


def pattern_spans(text: Column) -> list[Column]:
    """Spans of the fixed patterns, one array a kind."""
    return [
        find(text, ASSIGN, ASSIGN, 0, lambda m: F.length(F.regexp_extract(m, "(?s)^" + ASSIGN, 2)) >= MIN_ASSIGN),
        # a run is matched whole or not at all, so the length can be part of the pattern
        find(text, f"AKIA[A-Z0-9]{{{MIN_ACCESS - 4},}}", f"AKIA[A-Z0-9]{{{MIN_ACCESS - 4},}}", 1, lambda m: F.lit(True)),
        find(text, f"[0-9a-f]{{{MIN_HEX},}}", f"[0-9a-f]{{{MIN_HEX},}}", 2, lambda m: F.lit(True)),
    ]


def labelled_samples(docs: DataFrame, max_docs: int = 2000, n_random: int = 3000) -> DataFrame:
    """(token, random): labelled strings. max_docs bounds the documents that identifiers and caught values come from."""
    spark = docs.sparkSession
    ids = docs.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi")
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]{2,}"), F.lit(0))
    w = sample.select(words.alias("w")).where(F.size("w") >= 3)
    part = lambda i, k: F.get("w", i + k)
    joined = [F.concat_ws(sep, *[part(F.col("i"), k) for k in range(3)]) for sep in ("_", "-", "", "/", "=", "+")]
    joined += [F.concat_ws(sep, part(F.col("i"), 0), (F.col("i") % 100).cast("string")) for sep in ("_", "-", "")]
    triples = w.select("w", F.explode(F.sequence(F.lit(0), F.size("w") - 3, F.lit(3))).alias("i"))
    ordinary = triples.select(F.explode(F.array(*joined, F.get("w", F.col("i")))).alias("token"))
    day = F.date_add(F.lit("1970-01-01").cast("date"), (F.col("id") * 7).cast("int")).cast("string")
    numbers = spark.range(n_random).select(F.explode(F.array(day, F.abs(F.xxhash64("id")).cast("string"))).alias("token"))
    ordinary = ordinary.unionByName(numbers)
    digest = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 256)
    base64 = F.base64(F.unhex(digest))
    forms = [F.substring(digest, 1, 40), base64, F.regexp_replace(F.upper(base64), "[^A-Z0-9]", ""), F.translate(base64, "+/", "-_")]
    made = spark.range(n_random).select(F.explode(F.array(*forms)).alias("token"))
    values = sample.select(F.explode(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2))).alias("token"))
    caught = values.where((F.length("token") >= MIN_ASSIGN) & F.col("token").rlike("[0-9]"))
    return ordinary.withColumn("random", F.lit(False)).unionByName(made.unionByName(caught).withColumn("random", F.lit(True)))


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio of each character pair, as a flat 128 x 128 table; position 0 stands for the start."""
    chars = F.split("token", "")
    pairs = F.transform(chars, lambda c, i: F.struct(F.when(i == 0, 0).otherwise(F.ascii(F.get(chars, i - 1))).alias("a"), F.ascii(c).alias("b")))
    ascii_pairs = samples.select("random", F.explode(pairs).alias("p")).where("p.a between 0 and 127 and p.b between 1 and 127")
    counts = ascii_pairs.groupBy("random", "p.a", "p.b").count().collect()  # at most 2 x 128 x 128 rows
    n = [[[0.0] * 128 for _ in range(128)] for _ in range(2)]
    for r in counts:
        n[r["random"]][r["a"]][r["b"]] = float(r["count"])

    def log_p(row: list[float], b: int) -> float:
        # smoothed over the 66 characters of a candidate
        return math.log((row[b] + 0.5) / (sum(row) + 0.5 * 66))

    return [round(log_p(n[1][a], b) - log_p(n[0][a], b), 6) for a in range(128) for b in range(128)]


def llr(token: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of random over ordinary of an ASCII string column."""
    table = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")  # folded to one constant
    codes = F.transform(F.split(token, ""), lambda c: F.ascii(c))
    add = lambda acc, c: F.struct((acc["s"] + F.get(table, acc["prev"] * 128 + c)).alias("s"), c.alias("prev"))
    return F.aggregate(codes, F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("prev")), add, lambda acc: acc["s"])


def best_llr(token: Column, model: list[float], min_chars: int) -> Column:
    """The highest log-likelihood ratio of the parts of min_chars characters or more of an ASCII string column.

    A part's first character is given; that of the string counts where it raises the ratio, so no string has less than llr().
    """
    table = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")
    codes = F.transform(F.split(token, ""), lambda c: F.ascii(c))
    # state: the sum up to this character, the sum up to the last one that a part may begin with, and the least of those
    zero = F.lit(0.0)
    start = F.struct(zero.alias("s"), F.lit(0).alias("prev"), F.lit(0).alias("i"), zero.alias("lag"), F.lit(0).alias("lag_prev"), zero.alias("low"), F.lit(float("-inf")).alias("best"))
    pair = lambda a, b: F.get(table, a * 128 + b)

    def step(acc: Column, x: Column) -> Column:
        c, old = x["c"], x["old"]
        s = acc["s"] + pair(acc["prev"], c)
        lag = F.when(old.isNull(), zero).otherwise(acc["lag"] + pair(acc["lag_prev"], F.coalesce(old, F.lit(0))))
        low = F.least(acc["low"], lag)
        best = F.when(acc["i"] + 1 >= min_chars, F.greatest(acc["best"], s - low)).otherwise(acc["best"])
        return F.struct(s.alias("s"), c.alias("prev"), (acc["i"] + 1).alias("i"), lag.alias("lag"), F.coalesce(old, F.lit(0)).alias("lag_prev"), low.alias("low"), best.alias("best"))

    early = F.concat(F.array_repeat(F.lit(None).cast("int"), min_chars - 1), codes)
    both = F.slice(F.arrays_zip(codes.alias("c"), early.alias("old")), F.lit(1), F.size(codes))
    return F.aggregate(both, start, step, lambda acc: acc["best"])


def markov_spans(text: Column, model: list[float], min_chars: int, min_llr: float) -> Column:
    pattern = CANDIDATE[:-1] + f"{{{min_chars},}}"
    return find(text, pattern, pattern, 3, lambda m: best_llr(m, model, min_chars) >= min_llr)


def scan(docs: DataFrame, model: list[float], min_chars: int = min(MIN_ASSIGN, MIN_ACCESS, MIN_HEX), min_llr: float = 12.0) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base, spans): base and spans are arrays of (start, kind, end), sorted."""
    text = F.coalesce(F.col("text"), F.lit(""))
    kinds = [*pattern_spans(text), markov_spans(text, model, min_chars, min_llr)]
    found = docs.select("doc_id", *[c.alias(f"s{i}") for i, c in enumerate(kinds)])
    out = found.withColumn("base", F.array_sort(F.concat("s0", "s1", "s2")))
    return out.select(
        "doc_id", *[F.size(f"s{i}").cast("long").alias(f"n_{KINDS[i]}") for i in range(3)], "base",
        without_overlaps(F.col("base"), F.col("s3")).alias("spans"),
    )


def spelled(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs, train(labelled_samples(docs)))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(spelled("base"), 256).alias("base_sha256"), spelled("spans").alias("spans"))


_ASSIGN_SQL = ASSIGN.replace("'", "''")
ORACLE = rf"""
with d as (select doc_id, coalesce(text, '') as t from documents),
m as (select *, string_split_regex(t, '{_ASSIGN_SQL}') as ag, regexp_extract_all(t, '{_ASSIGN_SQL}') as ah, string_split_regex(t, 'AKIA[A-Z0-9]+') as kg,
  regexp_extract_all(t, 'AKIA[A-Z0-9]+') as kh, string_split_regex(t, '[0-9a-f]+') as hg, regexp_extract_all(t, '[0-9a-f]+') as hh from d),
s as (select doc_id, k, g, h, unnest(range(1, len(h) + 1)) as i from (
  select doc_id, 0 as k, ag as g, ah as h from m union all select doc_id, 1, kg, kh from m union all select doc_id, 2, hg, hh from m)),
good as (select *, h[i] as hit from s where case k when 0 then length(regexp_extract(h[i], '{_ASSIGN_SQL}', 2)) >= 12 when 1 then length(h[i]) >= 18 else length(h[i]) >= 16 end),
placed as (select doc_id, k, length(hit) as n, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0) as pos from good),
told as (select doc_id, count(*) filter (where k = 0) as a, count(*) filter (where k = 1) as c, count(*) filter (where k = 2) as x,
  string_agg(['assign', 'access', 'hex'][k + 1] || ':' || pos::bigint || ':' || (pos + n)::bigint, ',' order by pos, k) as spans from placed group by 1)
select doc_id, coalesce(a, 0)::bigint as n_assign, coalesce(c, 0)::bigint as n_access, coalesce(x, 0)::bigint as n_hex, sha256(coalesce(spans, '')) as base_sha256
from d left join told using (doc_id)
"""
