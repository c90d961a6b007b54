"""Renders rows of other tables as bill texts, to feed the extraction with as much text as there are rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aquabill.functions.text import MONTH_ABBREVIATIONS, MONTH_NAMES
from aquabill.operators.layouts import LAYOUTS

#: What stands between blocks, and a rest that is too short for a bill.
SEPARATORS = {"IPAMERI": "AUTENTICAÇÂO NO VERSO", "BURITI_ALEGRE": "AUTENTICAÇÃO NO VERSO", "DEMAE": "autenticação no verso", "SAAE_ABADIANIA": "AUTENTICAÇÃO NO VERSO", "SAAE_CORUMBA": "Autenticação Mecênica", "SAAE_MINEIROS": "Autenticação Mecânica", "CODEGO": "PREFERENCIALMENTE  NAS CASAS LOTERICAS ATE O VALOR LIMITE"}
FILE_NAMES = {"IPAMERI": "Águas de Ipameri", "BURITI_ALEGRE": "Buriti Alegre", "DEMAE": "DEMAE", "SAAE_ABADIANIA": "SAAE Abadiânia", "SAAE_CORUMBA": "SAAE Corumbá", "SAAE_MINEIROS": "SAAE Mineiros", "CODEGO": "Codego", "SAE": "SAE Catalão"}


#: Orders of a rendered file, about: files grow in number with the orders, not in size.
FILE_ORDERS = 5_000


def part(n: Column, key: Column, size: int = FILE_ORDERS) -> Column:
    """The file that a row goes to, of as many as n rows need."""
    return F.pmod(F.xxhash64(key), F.ceil(n / size))


def br(number: Column) -> Column:
    """1234.5 -> 1.234,50"""
    return F.translate(F.format_number(number, 2), ",.", ".,")


def _month(table: dict[str, str], date: Column) -> Column:
    names = [n for n, _ in sorted({v: k for k, v in reversed(table.items())}.items(), key=lambda x: x[0])]
    by_number = {v: k for k, v in reversed(table.items())}
    return F.element_at(F.array(*[F.lit(by_number[n]) for n in names]), F.month(date))


def order_fields(orders: DataFrame) -> DataFrame:
    """The bill that an order stands for: number, account, date, name and amounts.

    Rows are dealt out first, since a small file of orders becomes much text.
    """
    return orders.repartition(orders.sparkSession.sparkContext.defaultParallelism).select(
        "o_orderkey", "o_custkey", F.lpad(F.col("o_orderkey").cast("string"), 9, "0").alias("number"), F.lpad(F.col("o_custkey").cast("string"), 7, "0").alias("account"),
        (F.col("o_custkey") % 10).cast("string").alias("digit"), "o_orderdate", F.concat(F.lit("CLIENTE "), F.col("o_orderpriority")).alias("name"),
        (F.col("o_orderkey") % 100).alias("m3"), F.floor("o_totalprice").cast("double").alias("water"), F.floor(F.col("o_totalprice") / 4).cast("double").alias("sewage"), F.col("o_totalprice").alias("total"),
    )


def text(issuer: str) -> Column:
    """One bill of the issuer over order_fields()."""
    d = lambda f: F.date_format("o_orderdate", f)
    month, due, water, sewage, total = d("MM/yyyy"), d("dd/MM/yyyy"), br(F.col("water")), br(F.col("sewage")), br(F.col("total"))
    number, account, digit, name, m3 = F.col("number"), F.col("account"), F.col("digit"), F.col("name"), F.col("m3").cast("string")
    one = F.month("o_orderdate").cast("string")
    lines = {
        "IPAMERI": [("MATRÍCULA:  ", account, "       DÍGITO:  ", digit), ("NOME:  ", name, "          CATEGORIA: PUBLICA"), ("Mês/Ano Faturamento:  ", month), ("Consumo Faturado:  ", m3), ("FATURAMENTO AGUA         ", water), ("ESGOTO    ", sewage), ("VENCIMENTO:  ", due, "   VALOR (R$):  ", total), ("FATURA:  ", month, "  Nº  ", number)],
        "BURITI_ALEGRE": [("MATRÍCULA:  ", account, "       DÍGITO:  ", digit), ("NOME:  ", name, "          CATEGORIA: PUBLICA"), ("Mês/Ano Faturamento:  ", month), ("Consumo Faturado:  ", m3), ("TARIFA AGUA - ", water), ("ESGOTO    ", sewage), ("VENCIMENTO:  ", due, "   VALOR (R$):  ", total), ("FATURA:  ", month, "  Nº  ", number)],
        "DEMAE": [("Fatura nº: ", number, "      Matrícula: ", account, "-", digit), ("Data de Vencimento: ", due, "    Referência: ", month), ("MORADOR:  ", name), (month, " (Atual)          Lido        2394      ", m3), ("FATURAMENTO AGUA            ", water), ("ESGOTO     ", sewage), ("TOTAL A PAGAR          ", total)],
        "SAAE_ABADIANIA": [("NOME: ", name, "   LOCALIZAÇÃO: 01.02"), ("MAR/21       ", m3, "       000 034"), ("TARIFA DE AGUA(0000 a 0010 - 5,43 * 0010     ", water), ("TARIFA DE ESGOTO (50%)       ", sewage), (account, ".", digit, "     ", _month(MONTH_ABBREVIATIONS, F.col("o_orderdate")), d("/yyyy"), "     ", number, "      ", due, " ", total)],
        "SAAE_CORUMBA": [("N.       ", number, "   Parcela 1"), ("Nº Conta: ", account, "      Referência  ", one, " / ", d("yyyy")), ("Nome: ", name, "        CPF"), ("Vencimento:    ", due), ("Consumo do mês: ", m3), ("TARIFA DE AGUA    ", water), ("ESGOTO   ", sewage), ("(-) Valor do Pagamento",), ("       Declaração:        R$ ", total)],
        "SAAE_MINEIROS": [("N. Duam:", number), ("Nº Conta: ", account, "       Referência:  ", one, " / ", d("yyyy")), ("Nome: ", name, "        CPF"), ("Vencimento:",), (" ", due), ("Consumo do mês: ", m3), ("SERV. DE CAPTACAO E DIST. AGUA       ", water), ("SERV. DE COLETA E AFASTAMENTO DE ESG      ", sewage), ("(-) Valor do Pagamento",), ("R$ ", total)],
        "CODEGO": [("R$ ", total, "   ", due, "   ", d("yyyy"), "/", number), (" Pagador   ", name, "   Código de Baixa",), (" 123456789012345678 RUA ", account, " 10",), (" CEP: 75000-000 CIDADE -GO",), ("Hidrometro: A", account, "   Leitura"), ("  ", _month(MONTH_NAMES, F.col("o_orderdate")), d("/yyyy")), ("Consumo: M³ ", m3), ("Agua: ", water), ("Coleta/Esgoto: ", sewage)],
        "SAE": [(name,), ("VIA DO CONTRIBUINTE",), ("(123) RUA ", account, ",  S/N",), ("CIDADE   CEP: 75700-000",), ("Matrícula: ", account, " - ", digit, "    FATURA Nº ", number), ("Mês/Ano Faturamento: ", month), ("Vencimento    Valor",), (" ", due, "   ", total), ("Consumo Faturado: ", m3), ("FATURAMENTO AGUA - ", water), ("FATURAMENTO ESGOTO - ", sewage), ("TOTAL A PAGAR ", total)],
    }[issuer]
    rows = [F.concat(*[F.lit(x) if isinstance(x, str) else x for x in line]) for line in lines]
    return F.concat(F.array_join(F.array(*rows), "\n"), F.lit("\n"))


def documents(orders: DataFrame, issuers: list[str] | None = None) -> DataFrame:
    """DOC rows: each order as one file of one of the issuers, with a short rest after the separator."""
    known = issuers or [x.issuer for x in LAYOUTS]
    fields = order_fields(orders)
    which = F.element_at(F.array(*map(F.lit, known)), (F.col("o_orderkey") % len(known) + 1).cast("int"))
    content, folder = None, None
    for x in known:
        own = F.concat(text(x), F.lit(f"{SEPARATORS[x]}\nfim")) if x in SEPARATORS else text(x)
        content = F.when(F.col("which") == x, own) if content is None else content.when(F.col("which") == x, own)
        folder = F.when(F.col("which") == x, F.lit(FILE_NAMES[x])) if folder is None else folder.when(F.col("which") == x, F.lit(FILE_NAMES[x]))
    name = F.concat(F.lit("f"), F.col("o_orderkey").cast("string"), F.lit(".txt"))
    made = fields.withColumn("which", which).select("o_orderkey", folder.alias("dir"), name.alias("file_name"), content.alias("content"))
    return made.select(F.concat_ws("/", "dir", "file_name").alias("path"), "file_name", "dir", "content")


def grouped_documents(orders: DataFrame) -> DataFrame:
    """DOC rows: one file of the grouped layout a customer, a table row for each of their orders."""
    fields = order_fields(orders)
    row = F.concat_ws("   ", F.concat_ws(" ", F.col("number"), F.col("digit")), F.col("name"), F.concat(F.lit("RUA "), F.col("account")), F.col("m3").cast("string"), br(F.col("water")), br(F.col("sewage")), br(F.col("total")))
    rows = fields.groupBy("o_custkey", "account").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", row.alias("row")))), lambda x: x["row"]), "\n").alias("rows"))
    key = F.col("account")
    content = F.concat(
        F.lit("Nº FATURA: "), key, F.lit("\nMÊS/ANO REF: 03/2021   VENCIMENTO: 10/04/2021\nNOME DO ÓRGÃO AGRUPADOR      CÓD ÓRG AGRUP   CÓD ÓRG PAG\n"),
        F.lit("TRIBUNAL "), key, F.lit("\nSEGUNDA LINHA   1234   "), key, F.lit("\n99 1   ANTES DA TABELA   1   1,00\nCONTA DV   NOME CLIENTE   LOGRADOURO   CONSUMO   AGUA   ESGOTO   SMRSU\n"),
        F.col("rows"), F.lit("\nTOTAL   3   1,00\n99 9   FORA DA TABELA   1   1,00\n"),
    )
    name = F.concat(F.lit("fatura_"), key, F.lit(".txt"))
    return rows.select(F.concat_ws("/", F.lit("Saneago"), name).alias("path"), name.alias("file_name"), F.lit("Saneago").alias("dir"), content.alias("content"))


def meter_documents(orders: DataFrame, size: int = FILE_ORDERS) -> DataFrame:
    """DOC rows: meter reports of a month and about size orders, a block of two meters for each (the last one wins)."""
    month = F.date_format("o_orderdate", "MM-yyyy").alias("month")
    counts = orders.groupBy(month).agg(F.count("*").alias("n"))
    fields = order_fields(orders).select("*", month).join(counts, "month")
    block = F.concat(F.lit("Conta Nº: "), F.col("number"), F.lit("-"), F.col("digit"), F.lit("\nHidrômetro: X1\nlinha\nHidrometro: M"), F.col("account"), F.lit("\n"))
    months = fields.groupBy("month", part(F.col("n"), F.col("o_orderkey"), size).alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", block.alias("b")))), lambda x: x["b"]), "").alias("blocks"))
    name = F.concat(F.lit("saneago_analitica_"), F.col("month"), F.lit("_"), F.col("part").cast("string"), F.lit(".txt"))
    return months.select(F.concat_ws("/", F.lit("Saneago"), name).alias("path"), name.alias("file_name"), F.lit("Saneago").alias("dir"), F.concat(F.lit("Hidrômetro: X0\n"), F.col("blocks"), F.lit("Conta Nº 1-1\nsem medidor\n")).alias("content"))
