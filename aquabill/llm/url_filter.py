r"""URL filters: host and path rules, and a logistic regression on hashed character n-grams for URLs without a rule.

The model is trained by full-batch gradient descent from a small labelled URL table, by default a bounded sample of URLs
that the rules decide. Each URL becomes the n-grams of its host and of its path, hashed to `dims` weights. Gradients are
DataFrame aggregates; the driver holds the weights only (dims numbers).

Defined results: a null URL or one without `://` has an empty host and path, no rule and the model's verdict on nothing
but the bias. Among rules of equal length the first listed wins. URLs are judged row by row; repeats repeat. With no
labelled URL of one class the weights stay at zero, and a score of 0.5 or less allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aquabill.llm import common

#: Fixed rules (host, path, verdict).
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
NGRAMS = (3, 4)


def host(url: Column) -> Column:
    got = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(got, common.UPPER, common.LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule's text and verdict, null without one."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(reversed(rules), key=lambda r: len(r[0] + r[1])):  # the last one applied wins
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(v)).otherwise(verdict)
    return text, verdict


def char_ngrams(text: Column, n: int) -> Column:
    """The n-grams of a string, from shifted character arrays, so that a long URL costs its length only."""
    chars = F.split(text, "")
    grams = F.transform(chars, lambda c, i: F.concat(*[F.get(chars, i + k) for k in range(n)]))
    return F.filter(grams, lambda g: g.isNotNull())


def features(host: Column, path: Column, dims: int) -> Column:
    """Distinct hashed n-grams of host and path, each marked by its part and padded at both ends."""

    def hashed(mark: str, part: Column, n: int) -> Column:
        padded = F.concat(F.lit("^"), part, F.lit("$"))
        return F.transform(char_ngrams(padded, n), lambda g: F.pmod(F.xxhash64(F.lit(mark), g), F.lit(dims)).cast("int"))

    return F.array_distinct(F.concat(*[hashed(mark, part, n) for mark, part in (("h", host), ("p", path)) for n in NGRAMS]))


def margin(feats: Column, weights: list[float], bias: float) -> Column:
    """Bias plus the mean-scaled sum of the features' weights."""
    table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")  # folded to one constant
    total = F.aggregate(feats, F.lit(0.0), lambda acc, f: acc + F.get(table, f))
    return total / F.sqrt(F.greatest(F.size(feats), F.lit(1))) + F.lit(bias)


def probability(m: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-m))


def labelled_urls(pages: DataFrame, rules=RULES, max_urls: int = 2000) -> DataFrame:
    """(host, path, block): at most max_urls distinct host and path pairs that a rule decides, by hash order."""
    url = F.col("url")
    sides = pages.select(host(url).alias("host"), path(url).alias("path"))
    known = sides.withColumn("verdict", rule(F.col("host"), F.col("path"), rules)[1]).where("verdict is not null").distinct()
    return known.orderBy(F.xxhash64("host", "path"), "host", "path").limit(max_urls).select("host", "path", (F.col("verdict") == "block").cast("double").alias("block"))


def train(labelled: DataFrame, dims: int = 4096, steps: int = 12, rate: float = 8.0) -> tuple[list[float], float]:
    """Weights and bias of P(block) by gradient descent with momentum; labelled must be a small table."""
    data = labelled.select(features(F.col("host"), F.col("path"), dims).alias("f"), "block").persist()
    n = data.agg(F.count("*"), F.sum("block")).first()
    weights, bias, speed, bias_speed = [0.0] * dims, 0.0, [0.0] * dims, 0.0
    if n[0] and 0 < n[1] < n[0]:
        for _ in range(steps):
            error = probability(margin(F.col("f"), weights, bias)) - F.col("block")
            wrong = data.select("f", error.alias("e"), F.sqrt(F.greatest(F.size("f"), F.lit(1))).alias("scale"))
            parts = wrong.select(F.explode(F.concat("f", F.array(F.lit(-1)))).alias("k"), (F.col("e") / F.col("scale")).alias("g"), "e")
            rows = parts.groupBy("k").agg(F.sum("g").alias("g"), F.sum("e").alias("e")).collect()  # at most dims + 1 rows
            grad = [0.0] * dims
            bias_grad = 0.0
            for r in rows:
                if r["k"] < 0:
                    bias_grad = r["e"] / n[0]
                else:
                    grad[r["k"]] = r["g"] / n[0]
            speed = [0.8 * s - rate * g for s, g in zip(speed, grad)]
            bias_speed = 0.8 * bias_speed - 0.5 * bias_grad
            weights, bias = [w + s for w, s in zip(weights, speed)], bias + bias_speed
    data.unpersist()
    return [round(w, 6) for w in weights], round(bias, 6)


def judge(pages: DataFrame, model: tuple[list[float], float], rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, p_block): the rule's verdict, else the model's."""
    sides = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    text, verdict = rule(F.col("host"), F.col("path"), rules)
    p = probability(margin(features(F.col("host"), F.col("path"), len(model[0])), *model))
    out = sides.select("page_id", "host", "path", text.alias("rule"), verdict.alias("v"), p.alias("p_block"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("v", F.when(F.col("p_block") > 0.5, "block").otherwise("allow")).alias("verdict"), "p_block")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, train(labelled_urls(pages))).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
with s as (select page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
t as (select *, '.' || host as h from s),
u as (select page_id, host, path, case when ends_with(h, '.example.org') and starts_with(path, '/en/1') then 'example.org/en/1'
  when ends_with(h, '.example.org') and starts_with(path, '/es/') then 'example.org/es/' when ends_with(h, '.com') and starts_with(path, '/fr/') then 'com/fr/'
  when ends_with(h, '.com') and starts_with(path, '/de/') then 'com/de/' when ends_with(h, '.org') and starts_with(path, '/') then 'org/' end as rule from t)
select *, case when rule in ('org/', 'com/fr/') then 'allow' when rule is not null then 'block' end as verdict from u
"""
