"""Scalar functions on columns: folding, trimming, Brazilian numbers, months. All are JVM expressions."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Portuguese months.
MONTH_NAMES = {
    "Janeiro": "01", "Fevereiro": "02", "Março": "03", "Marco": "03", "Abril": "04", "Maio": "05", "Junho": "06",
    "Julho": "07", "Agosto": "08", "Setembro": "09", "Outubro": "10", "Novembro": "11", "Dezembro": "12",
}
MONTH_ABBREVIATIONS = {"JAN": "01", "FEV": "02", "MAR": "03", "ABR": "04", "MAI": "05", "JUN": "06", "JUL": "07", "AGO": "08", "SET": "09", "OUT": "10", "NOV": "11", "DEZ": "12"}
#: Fixed value: what older stores hold where a field was not found.
NOT_FOUND = "NÃO ACHOU"
#: Unicode white space.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


@cache
def _folds() -> tuple[str, str]:
    """Characters of the first plane that are one base character without their marks, and those."""
    pairs = []
    for i in range(0x10000):
        bare = [c for c in unicodedata.normalize("NFD", chr(i)) if unicodedata.category(c) != "Mn"]
        if len(bare) == 1 and bare[0] != chr(i):
            pairs.append((chr(i), bare[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold(text: Column) -> Column:
    """Lower case without accents, for matching."""
    source, target = _folds()
    return F.regexp_replace(F.translate(F.lower(text), source, target), r"\p{Mn}", "")


def strip(text: Column) -> Column:
    """Without white space at both ends, form feeds and no-break spaces included."""
    return F.btrim(text, F.lit(SPACE))


def squeeze(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def br_number(text: Column) -> Column:
    """1.234,56 -> 1234.56; empty or bad text -> 0."""
    return F.coalesce(_dotted(text).try_cast("double"), F.lit(0.0))


def br_decimal(text: Column) -> Column:
    """As br_number, exact."""
    return F.coalesce(_dotted(text).try_cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)"))


def _dotted(text: Column) -> Column:
    return F.replace(F.replace(strip(text), F.lit("."), F.lit("")), F.lit(","), F.lit("."))


def _lookup(name: Column, table: dict[str, str]) -> Column:
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), name), name)


def month_by_name(name: Column) -> Column:
    """Full month name in any case -> two digits; unknown names come back in title case."""
    return _lookup(F.initcap(name), MONTH_NAMES)


def month_by_abbreviation(name: Column) -> Column:
    """Three-letter month -> two digits; unknown names stay."""
    return _lookup(F.upper(name), MONTH_ABBREVIATIONS)


def pad2(digits: Column) -> Column:
    return F.when(F.length(digits) < 2, F.lpad(digits, 2, "0")).otherwise(digits)


def month_date(month: Column) -> Column:
    """MM/yyyy -> timestamp; anything else -> null."""
    return F.try_to_timestamp(month, F.lit("MM/yyyy"))


def missing(text: Column) -> Column:
    return text.isNull() | text.isin("", "nan")


def found(text: Column) -> Column:
    """The not-found sentinel of older stores and null -> ''."""
    return F.coalesce(F.nullif(text, F.lit(NOT_FOUND)), F.lit(""))


def residual_fee(total: Column, water: Column, sewage: Column) -> Column:
    """What is neither water nor sewage; may be negative."""
    return F.round(total - water - sewage, 2)


def base(water: Column, sewage: Column) -> Column:
    return F.round(water + sewage, 2)


def account_key(account: Column) -> Column:
    """Accounts are compared with their white space squeezed."""
    return squeeze(account.cast("string"))
