"""Bills of the block and whole-file layouts: one narrow stage, no shuffle; each row runs its own layout's patterns only."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aquabill.functions import text as T
from aquabill.operators.layouts import FLAGS, LAYOUTS, Layout
from aquabill.schema import BILL
from aquabill.sources.files import stamp

#: Shorter blocks are page rests.
MIN_BLOCK = 100
NUMBERS = ["CONSUMO_M3", "VALOR_AGUA", "VALOR_ESGOTO", "VALOR_TOTAL"]
TEXTS = ["NUM_FATURA", "MES_ANO_REF", "VENCIMENTO", "CONTA_DV", "NOME_CLIENTE", "LOGRADOURO"]


def long_enough(block: Column) -> Column:
    return F.length(T.strip(block)) >= MIN_BLOCK


def by_issuer(layouts: list[Layout], value: Callable[[Layout], Column]) -> Column:
    """value of the row's layout; only that branch is evaluated. Rows are of one of the layouts."""
    if len(layouts) == 1:
        return value(layouts[0])
    out = None
    for x in layouts:
        out = F.when(F.col("EMPRESA") == x.issuer, value(x)) if out is None else out.when(F.col("EMPRESA") == x.issuer, value(x))
    return out


def split_blocks(docs: DataFrame, layouts: list[Layout] = LAYOUTS) -> DataFrame:
    """docs with block_no and block: texts cut at their layout's separator, which is dropped; short blocks go."""
    parts = by_issuer(layouts, lambda x: F.split("content", FLAGS + x.split) if x.split else F.array("content"))
    known = docs.where(F.col("EMPRESA").isin([x.issuer for x in layouts]))
    out = known.select("*", F.posexplode(parts).alias("block_no", "block"))
    whole = [x.issuer for x in layouts if x.split is None]
    return out.where(F.col("EMPRESA").isin(whole) | long_enough(F.col("block"))) if whole else out.where(long_enough(F.col("block")))


def extract(docs: DataFrame, layouts: list[Layout] = LAYOUTS) -> DataFrame:
    """BILL rows (and path, block_no) of routed docs. Bills with neither number nor account are dropped."""
    blocks = split_blocks(docs, layouts)
    rule = lambda name: by_issuer(layouts, lambda x: x.rules[name](F.col("block")) if name in x.rules else F.lit(""))
    values = blocks.select("path", "block_no", "file_name", "dir", "EMPRESA", by_issuer(layouts, lambda x: F.lit(x.name)).alias("CONCESSIONARIA"), *[rule(n).alias(n) for n in TEXTS], *[T.br_number(rule(n)).alias(n) for n in NUMBERS])
    kept = values.where((F.col("NUM_FATURA") != "") | (F.col("CONTA_DV") != ""))
    made = {
        "BASE_CALCULO": T.base(F.col("VALOR_AGUA"), F.col("VALOR_ESGOTO")),
        "VALOR_TAXAS_EXTRAS": T.residual_fee(F.col("VALOR_TOTAL"), F.col("VALOR_AGUA"), F.col("VALOR_ESGOTO")),
        **{c: F.lit("") for c in ("COD_ORGAO_AGRUPADOR", "COD_ORGAO_PAGADOR", "NOME_ORGAO_AGRUPADOR")},
        "NUM_HIDROMETRO": F.lit(None),
        "DATA_PROCESSAMENTO": stamp(),
        "ARQUIVO_ORIGEM": F.col("file_name"),
        "PASTA_ORIGEM": F.col("dir"),
    }
    return kept.select("path", "block_no", *[made.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in BILL.fields])


def extract_each(routed: DataFrame, layouts: list[Layout] = LAYOUTS) -> DataFrame:
    """extract() of routed docs that lie in a folder an issuer: each layout's patterns over its own folder, pruned to it.

    So no generated method holds the patterns of several layouts. Docs that are not stored would be made anew for each.
    """
    parts = [extract(routed.where(F.col("EMPRESA") == x.issuer), [x]) for x in layouts]
    return functools.reduce(DataFrame.unionByName, parts)
