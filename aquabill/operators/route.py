"""Router: the first rule that fits the folded file and folder names decides the issuer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aquabill.functions.text import fold

METERS = "SANEAGO_ANALITICA"
GROUPED = "SANEAGO"
#: Fixed values, in order: issuer, words that must occur, words that must not.
ISSUERS = [
    (METERS, ["saneago", "analitica"], []),
    (GROUPED, ["saneago"], []),
    ("CODEGO", ["codego"], []),
    ("IPAMERI", ["ipameri"], []),
    ("BURITI_ALEGRE", ["buriti alegre"], []),
    ("DEMAE", ["demae"], []),
    ("SAAE_ABADIANIA", ["abadiania"], []),
    ("SAAE_CORUMBA", ["corumba"], []),
    ("SAAE_MINEIROS", ["mineiros"], []),
    ("SANESC", ["sanesc"], []),
    ("CHESP", ["chesp"], []),
    ("SAE", ["sae"], ["saae"]),
]
#: Routed and counted, but without a layout.
UNPARSED = ["SANESC", "CHESP"]


def first_match(text: Column, rules: list[tuple[str, list[str], list[str]]]) -> Column:
    """The first rule's name whose words all occur and whose other words do not; null without one."""
    out = F.lit(None).cast("string")
    for name, words, others in reversed(rules):
        fits = F.lit(True)
        for w in words:
            fits = fits & F.contains(text, F.lit(w))
        for w in others:
            fits = fits & ~F.contains(text, F.lit(w))
        out = F.when(fits, F.lit(name)).otherwise(out)
    return out


def names(docs: DataFrame) -> Column:
    """What the rules look at: the folded names of the file and of its folders, the scanned one included."""
    return fold(F.concat_ws(" ", "file_name", *(["root"] if "root" in docs.columns else []), "dir"))


def route(docs: DataFrame, rules=ISSUERS) -> DataFrame:
    """docs with EMPRESA; documents that no rule fits are dropped.

    The names are folded once a document: a generated column is not put into the filters and projections above it.
    """
    issuer = F.transform(F.array(names(docs)), lambda text: first_match(text, rules))
    return docs.select("*", F.explode(F.filter(issuer, lambda x: x.isNotNull())).alias("EMPRESA"))
