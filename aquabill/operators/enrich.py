"""Register join and value redistribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aquabill.functions import text as T
from aquabill.operators.meters import keep_first

SERVICES = {"AGUA": "VALOR_AGUA", "ESGOTO": "VALOR_ESGOTO", "SMRSU": "VALOR_TAXAS_EXTRAS"}


def unique_register(register: DataFrame) -> DataFrame:
    """One row per normalised account (column key); of equal ones the smallest id_CONTA stays."""
    known = register.withColumn("key", T.account_key(F.col("CONTA_DV")))
    return keep_first(known, ["key"], [F.col("id_CONTA").isNull(), "id_CONTA", F.struct(*register.columns)])


def repeated_accounts(register: DataFrame) -> DataFrame:
    """(key, n): accounts that the register holds more than once."""
    return register.groupBy(T.account_key(F.col("CONTA_DV")).alias("key")).agg(F.count("*").alias("n")).where("n > 1")


def enrich(bills: DataFrame, register: DataFrame | None) -> DataFrame:
    """bills with the register's columns, null where the account is unknown; the bills alone without a register.

    The join is left to the optimizer, which broadcasts the register only while it is small.
    """
    if register is None:
        return bills
    r = unique_register(register).drop("CONTA_DV")
    return bills.withColumn("key", T.account_key(F.col("CONTA_DV"))).join(r, "key", "left").drop("key")


def redistributed(values: list[Column], flags: list[Column]) -> list[Column]:
    """The positive values in order, handed in order to the services whose flag holds; the rest get 0.

    Without a flag that holds (null is no) the values stay as they are.
    """
    positive = F.filter(F.array(*values), lambda v: v > 0)
    on = [F.coalesce(f, F.lit(False)) for f in flags]
    rank, out = F.lit(0), []
    for value, flag in zip(values, on):
        share = F.when(flag, F.coalesce(F.get(positive, rank), F.lit(0.0))).otherwise(0.0)
        out.append(F.when(F.greatest(*on), share).otherwise(value))
        rank = rank + flag.cast("int")
    return out


def redistribute(bills: DataFrame) -> DataFrame:
    """Applies redistributed() to bills that carry the register's flags, and renews the base."""
    new = redistributed([F.col(v) for v in SERVICES.values()], [F.col(f) for f in SERVICES])
    return bills.withColumns(dict(zip(SERVICES.values(), new))).withColumn("BASE_CALCULO", T.base(F.col("VALOR_AGUA"), F.col("VALOR_ESGOTO")))
