import random
import re
import time

import pytest
from pyspark.sql import functions as F

from aquabill.functions import text as T
from aquabill.operators import blocks, grouped, layouts as L, meters, route
from aquabill.sources import files

TEXTS = {
    ("DEMAE", "f.txt"): """Fatura nº: 6827883      Matrícula: 21544-9
Data de Vencimento: 20/04/2021    Referência: 03/2021
MORADOR:  ORGAO EXEMPLO DO ESTADO
03/2021 (Atual)                   Lido              2394          63
FATURAMENTO AGUA                                  497,84
TOTAL A PAGAR                                     536,69
AUTENTICAÇÂO NO VERSO
""",
    ("Águas de Ipameri/2023", "fatura.txt"): """MATRÍCULA:  9945       DÍGITO:  7
NOME:  ORGAO EXEMPLO DO ESTADO          CATEGORIA: PUBLICA
Mês/Ano Faturamento:  11/2023
Consumo Faturado:  48
FATURAMENTO AGUA                                   501,43
VENCIMENTO:  11/12/2023   VALOR (R$):  491,78
FATURA:  11/2023  Nº  119044
AUTENTICAÇÂO NO VERSO
fim
""",
    ("Buriti Alegre", "f.TXT"): """MATRÍCULA:  120       DÍGITO:  3
NOME:  FORUM EXEMPLO          CATEGORIA: PUBLICA
Mês/Ano Faturamento:  05/2022
Consumo Faturado:  31
TARIFA AGUA - 282,53
ESGOTO   100,00
VENCIMENTO:  10/06/2022   VALOR (R$):  1.390,03
FATURA:  05/2022  Nº  4411
AUTENTICAÇÃO NO VERSO
""",
    ("SAAE Abadiânia", "f.txt"): """NOME: FORUM DE EXEMPLO   LOCALIZAÇÃO: 01.02
MAR/21       04       000 034
TARIFA DE AGUA(0000 a 0010 - 5,43 * 0010                     54,30
TARIFA DE ESGOTO (50%)                                       27,15
0001255.2     MAR/2021     210006761      23/03/2021 81,45
AUTENTICAÇÃO NO VERSO
""",
    ("SAAE Corumbá", "f.txt"): """N.       605732   Parcela 1
Nº Conta: 2338      Referência  1 / 2021
Nome: FORUM DE EXEMPLO        CPF
Vencimento:    10/01/2022
Consumo do mês: 35
TARIFA DE AGUA    187,25
(-) Valor do Pagamento
       Declaração:                                R$ 165,92
Autenticação Mecênica
""",
    ("SAAE Mineiros", "f.txt"): """N. Duam:11141179
Nº Conta: 030285       Referência:  2 / 2026
Nome: ORGAO EXEMPLO DO ESTADO        CPF
Vencimento:
 10/03/2026
Consumo do mês: 51
SERV. DE CAPTACAO E DIST. AGUA                   524,67
SERV. DE COLETA E AFASTAMENTO DE ESG             262,34
(-) Valor do Pagamento
R$ 843,20
Autenticação Mecânica
""",
    ("codego", "f.txt"): """R$ 1.234,56   15/04/2021   2021/0099-1
 Pagador   ORGAO EXEMPLO   Código de Baixa
 123456789012345678 RUA EXEMPLO 10
 CEP: 75000-000 CIDADE -GO
Hidrometro: A12B345   Leitura
  Março/2021
Consumo: M³ 77
Agua: 800,00
Coleta/Esgoto: 400,00
PREFERENCIALMENTE  NAS CASAS LOTERICAS ATE O VALOR LIMITE
R$ 10,00   15/05/2021   2021/0100-1
 Pagador   ORGAO EXEMPLO   Código de Baixa
 RUA EXEMPLO 10 CEP: 75000-000 CIDADE -GO
Hidrometro: A12B345   Leitura
  Abril/2021
Consumo: M3 5
Agua: 8,00
Coleta/Esgoto: ,50
""",
    ("SAE", "f.txt"): """ORGAO EXEMPLO DO ESTADO
VIA DO CONTRIBUINTE
(123) RUA EXEMPLO,  S/N
CIDADE   CEP: 75700-000
Matrícula: 12345 - 6    FATURA Nº 987654
Mês/Ano Faturamento: 02/2022
Vencimento    Valor
 10/03/2022   210,10
Consumo Faturado: 22
FATURAMENTO AGUA - 120,00
FATURAMENTO ESGOTO - 60,05
TOTAL A PAGAR 210,10
""",
    ("CHESP", "f.txt"): "nothing " * 20,
    ("SAAE Outra", "f.txt"): "nothing " * 20,
}
BILLS = {
    ("DEMAE", "6827883", "03/2021", "20/04/2021", "21544-9", "ORGAO EXEMPLO DO ESTADO", "", 63.0, 497.84, 0.0, 38.85, 536.69),
    ("IPAMERI", "119044", "11/2023", "11/12/2023", "9945-7", "ORGAO EXEMPLO DO ESTADO", "", 48.0, 501.43, 0.0, -9.65, 491.78),
    ("BURITI_ALEGRE", "4411", "05/2022", "10/06/2022", "120-3", "FORUM EXEMPLO", "", 31.0, 282.53, 100.0, 1007.5, 1390.03),
    ("SAAE_ABADIANIA", "210006761", "03/2021", "23/03/2021", "0001255.2", "FORUM DE EXEMPLO", "", 4.0, 54.3, 27.15, 0.0, 81.45),
    ("SAAE_CORUMBA", "605732", "01/2021", "10/01/2022", "2338", "FORUM DE EXEMPLO", "", 35.0, 187.25, 0.0, -21.33, 165.92),
    ("SAAE_MINEIROS", "11141179", "02/2026", "10/03/2026", "030285", "ORGAO EXEMPLO DO ESTADO", "", 51.0, 524.67, 262.34, 56.19, 843.2),
    ("CODEGO", "2021/0099-1", "03/2021", "15/04/2021", "A12B345", "ORGAO EXEMPLO", "RUA EXEMPLO 10 CEP: 75000-000 CIDADE -GO", 77.0, 800.0, 400.0, 34.56, 1234.56),
    ("CODEGO", "2021/0100-1", "04/2021", "15/05/2021", "A12B345", "ORGAO EXEMPLO", "RUA EXEMPLO 10 CEP: 75000-000 CIDADE -GO", 5.0, 8.0, 0.5, 1.5, 10.0),
    ("SAE CATALÃO", "987654", "02/2022", "10/03/2022", "12345 6", "ORGAO EXEMPLO DO ESTADO", "RUA EXEMPLO, S/N CIDADE CEP: 75700-000", 22.0, 120.0, 60.05, 30.05, 210.1),
}
COLUMNS = ["CONCESSIONARIA", "NUM_FATURA", "MES_ANO_REF", "VENCIMENTO", "CONTA_DV", "NOME_CLIENTE", "LOGRADOURO", "CONSUMO_M3", "VALOR_AGUA", "VALOR_ESGOTO", "VALOR_TAXAS_EXTRAS", "VALOR_TOTAL"]
GROUPED = """Nº FATURA: 555
MÊS/ANO REF: 03/2021   VENCIMENTO: 10/04/2021
NOME DO ÓRGÃO AGRUPADOR      CÓD ÓRG AGRUP   CÓD ÓRG PAG
TRIBUNAL EXEMPLO   1234   5678
CONTA DV   NOME CLIENTE   LOGRADOURO   CONSUMO   AGUA   ESGOTO   SMRSU
12345 6   FORUM A   RUA B   48   501,43   0,00   12,00
77 2   FORUM SEM RUA   5   1.000,50
88 3   FORUM C   RUA D   100   7   2,00
TOTAL   3   1.515,93
99 9   FORA DA TABELA   1   1,00
"""
REPORT = """Hidrômetro: X0
Conta Nº: 12345-6
Hidrômetro: A1
Hidrometro: A2
Conta N. 77 - 2
sem medidor
Conta Nº 88-3
HIDRÔMETRO N: B9
"""


def docs(spark, texts):
    rows = [(f"{d}/{f}", f, d, t) for (d, f), t in texts.items()]
    return route.route(spark.createDataFrame(rows, "path string, file_name string, dir string, content string"))


def test_layouts(spark):
    assert {tuple(r) for r in blocks.extract(docs(spark, TEXTS)).select(COLUMNS).collect()} == BILLS


def test_bills_without_number_and_account_go(spark):
    assert blocks.extract(docs(spark, {("DEMAE", "f.txt"): "x" * 200, ("SAE", "f.txt"): ""})).count() == 0
    empty = docs(spark, TEXTS).limit(0)
    assert blocks.extract(empty).count() == grouped.extract(empty).count() == meters.extract(empty).count() == 0


def test_grouped(spark):
    got = grouped.extract(docs(spark, {("Saneago", "fatura.txt"): GROUPED}))
    head = {tuple(r) for r in got.select("NUM_FATURA", "MES_ANO_REF", "VENCIMENTO", "COD_ORGAO_AGRUPADOR", "COD_ORGAO_PAGADOR", "NOME_ORGAO_AGRUPADOR").collect()}
    assert head == {("555", "03/2021", "10/04/2021", "1234", "5678", "TRIBUNAL EXEMPLO")}
    rows = {tuple(r) for r in got.select("CONTA_DV", "NOME_CLIENTE", "LOGRADOURO", "CONSUMO_M3", "VALOR_AGUA", "VALOR_ESGOTO", "BASE_CALCULO", "VALOR_TAXAS_EXTRAS", "VALOR_TOTAL").collect()}
    assert rows == {
        ("12345 6", "FORUM A", "RUA B", 48.0, 501.43, 0.0, 501.43, 12.0, 513.43),
        ("77 2", "FORUM SEM RUA", "", 5.0, 1000.5, 0.0, 1000.5, 0.0, 1000.5),
        ("88 3", "FORUM C", "RUA D", 100.0, 2.0, 0.0, 2.0, 0.0, 2.0),
    }


def model(text):
    """The same line states, one line after the other."""
    out, capturing, table, parts, name = [], False, False, [], None
    number = None
    for line in text.split("\n"):
        s = line.strip()
        u = s.upper()
        if m := re.search(r"N[º°Oo]?\s*FATURA:\s*(\d+)", line, re.I):
            number = m[1]
        if re.search(r"NOME.*?DO.*?[OÓ]RG[AÃ]O.*?AGRUPADOR", u):
            capturing, parts = True, []
            continue
        if capturing:
            if s == "" or re.search(r"C[OÓ]D.*?[OÓ]RG", u):
                continue
            if m := re.search(r"^(.*?)\s+(\d{3,})\s+(\d{3,})\s*$", s):
                name, capturing = " ".join([*parts, m[1]]), False
            else:
                parts.append(s)
        if re.search(r"CONTA.*?DV.*?NOME.*?CLIENTE", u):
            table = True
        elif any(x in u for x in ("TOTAL", "INFORMAÇÕES", "RETENÇÕES", "FATURADO")):
            table = False
        elif table and (m := re.match(r"^(\d+\s\d)", s)):
            out.append((m[1], number or "", name or ""))
    return out


def test_grouped_states_equal_a_model(spark):
    rnd = random.Random(7)
    lines = ["NOME DO ÓRGÃO AGRUPADOR", "CÓD ÓRG", "", "ABC  123  456", "parte", "CONTA DV NOME CLIENTE", "TOTAL", "12 3  A  B  1  2,00", "77 1  X  5", "Nº FATURA: 12", "N FATURA: 99", "\f 5 5  Y  1,00 ", "INFORMAÇÕES"]
    files = {("Saneago", f"f{i}.txt"): "\n".join(rnd.choice(lines) for _ in range(rnd.randint(0, 25))) for i in range(200)}
    got = grouped.extract(docs(spark, files)).select("ARQUIVO_ORIGEM", "block_no", "CONTA_DV", "NUM_FATURA", "NOME_ORGAO_AGRUPADOR").collect()
    found = {}
    for r in sorted(got):
        found.setdefault(r[0], []).append(tuple(r[2:]))
    assert found == {f: m for (_, f), t in files.items() if (m := model(t))}


@pytest.mark.parametrize("size", [1, 3, 7])
def test_runs_of_any_length_give_the_same(spark, size):
    rnd = random.Random(8)
    grouped_lines = ["NOME DO ÓRGÃO AGRUPADOR", "CÓD ÓRG", "", "ABC  123  456", "parte", "CONTA DV NOME CLIENTE", "TOTAL", "12 3  A  B  1  2,00", "77 1  X  5", "Nº FATURA: 12", "MÊS/ANO REF: 01/2020", "VENCIMENTO: 1/1/2020"]
    meter_lines = ["CONTA Nº: 12 - 3", "Conta N. 5-1", "HIDROMETRO: A1", "Hidrômetro: B2", "x", ""]
    texts = {("Saneago", f"f{i}.txt"): "\n".join(rnd.choice(grouped_lines) for _ in range(rnd.randint(0, 40))) for i in range(80)}
    texts |= {("Saneago", f"analitica_0{1 + i % 9}-2021_{i}.txt"): "\n".join(rnd.choice(meter_lines) for _ in range(rnd.randint(0, 30))) for i in range(80)}
    routed = docs(spark, texts)
    for module in (grouped, meters):
        shown = lambda df: sorted(map(str, df.drop("DATA_PROCESSAMENTO").collect()))
        assert len(want := shown(module.extract(routed))) > 50 and shown(module.extract(routed, size)) == want


def test_a_file_read_by_lines_in_many_tasks(spark, tmp_path):
    """One file of many lines, in splits of a task each, gives what the whole text gives."""
    rnd, lines = random.Random(9), []
    for i in range(3_000):
        lines += [f"Nº FATURA: {i}"] if rnd.random() < 0.2 else []
        lines += ["NOME DO ÓRGÃO AGRUPADOR", f"TRIBUNAL {i}", "LINHA  1234  5678"] if rnd.random() < 0.2 else []
        lines += ["CONTA DV NOME CLIENTE"] if rnd.random() < 0.5 else []
        lines += [f"{i} 1   NOME   RUA   3   1,00   2,00"] * 20
        lines += ["TOTAL"] if rnd.random() < 0.5 else []
    (tmp_path / "Saneago").mkdir()
    (tmp_path / "Saneago" / "fatura.txt").write_text("\n".join(lines))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300000")
    try:
        read = route.route(files.scan_lines(spark, str(tmp_path), 5_000))
        assert read.rdd.getNumPartitions() >= 8 and read.select("run").distinct().count() > 12
        got = grouped.extract_lines(read).drop("DATA_PROCESSAMENTO", "path").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    want = grouped.extract(route.route(files.scan_texts(spark, str(tmp_path))), 10**9).drop("DATA_PROCESSAMENTO", "path").collect()
    assert len(want) > 20_000 and sorted(map(str, got)) == sorted(map(str, want))


def test_a_long_capture_costs_its_length(spark):
    lines = ["Nº FATURA: 1", "NOME DO ÓRGÃO AGRUPADOR"] + [f"PARTE {i}" for i in range(100_000)]
    end = ["FIM   1234   5678", "CONTA DV   NOME CLIENTE", "12345 6   NOME   RUA   3   1,00   2,00   3,00"]
    docs = spark.createDataFrame([("a", "a", "a", "\n".join(lines), "SANEAGO"), ("b", "b", "b", "\n".join(lines + end), "SANEAGO")], "path string, file_name string, dir string, content string, EMPRESA string")
    start = time.perf_counter()
    (row,) = grouped.extract(docs).collect()
    assert time.perf_counter() - start < 60  # a quadratic one takes many minutes
    assert (row["ARQUIVO_ORIGEM"], row["COD_ORGAO_PAGADOR"], len(row["NOME_ORGAO_AGRUPADOR"])) == ("b", "5678", sum(len(x) + 1 for x in lines[2:]) + 3)


def test_meter_report(spark):
    got = meters.extract(docs(spark, {("Saneago", "saneago_analitica_03-2021.txt"): REPORT}))
    assert {tuple(r) for r in got.select("CONTA_DV", "MES_ANO_REF", "NUM_HIDROMETRO_EXTRAIDO").collect()} == {("12345 6", "03/2021", "A2"), ("88 3", "03/2021", "B9")}


@pytest.mark.parametrize(
    ("file", "folder", "issuer"),
    [("analítica_03-2021.txt", "SANEAGO", "SANEAGO_ANALITICA"), ("f.TXT", "Saneago", "SANEAGO"), ("f.txt", "SAAE Corumbá", "SAAE_CORUMBA"), ("f.txt", "SAE Catalão", "SAE"), ("f.txt", "SAAE Outra", None), ("f.txt", "CHESP", "CHESP")],
)
def test_router(spark, file, folder, issuer):
    got = [r["EMPRESA"] for r in docs(spark, {(folder, file): ""}).collect()]
    assert got == ([issuer] if issuer else [])


def test_text_functions(spark):
    row = spark.range(1).select(
        T.fold(F.lit("ÁÇÃO é İ")).alias("fold"), T.strip(F.lit("\f  a b \n")).alias("strip"), T.squeeze(F.lit("  a \t b ")).alias("squeeze"),
        T.br_number(F.lit("1.234,56")).alias("n"), T.br_number(F.lit(",50")).alias("half"), T.br_number(F.lit("x")).alias("bad"), T.br_number(F.lit("1,2,3")).alias("worse"),
        T.br_decimal(F.lit("1.005,10")).cast("string").alias("d"), T.month_by_name(F.lit("MARÇO")).alias("m"), T.month_by_name(F.lit("xyz")).alias("x"),
        T.month_by_abbreviation(F.lit("dez")).alias("dez"), T.pad2(F.lit("7")).alias("p"), T.month_date(F.lit("13/2023")).alias("none"), T.found(F.lit("NÃO ACHOU")).alias("gone"),
        T.residual_fee(F.lit(10.1), F.lit(3.05), F.lit(8.0)).alias("fee"),
    ).first()
    assert row.asDict() == {"fold": "acao e i", "strip": "a b", "squeeze": "a b", "n": 1234.56, "half": 0.5, "bad": 0.0, "worse": 0.0, "d": "1005.10", "m": "03", "x": "Xyz", "dez": "12", "p": "07", "none": None, "gone": "", "fee": -0.95}


def test_month_of_a_report_is_not_read_from_a_made_up_name(spark):
    """Part files of Spark hold random hexadecimal digits, which can look like a month."""
    names = {"part-00000-33441278-2021-4123-8271-590212345678-c000.txt": "", "part-00071-5902ab31-8652-4f03-a871-590212345678.c001.txt": "", "part-03-2021.txt": "03/2021"}
    names |= {"part-7-tid-12-2021-33441278-2021-4123-8271-590212345678-c000.txt": "", "abril 04.2021 part-00000.txt": "04/2021"}
    got = meters.extract(docs(spark, {("Saneago analitica", n): REPORT for n in names})).select("ARQUIVO_ORIGEM", "MES_ANO_REF").distinct().collect()
    assert {tuple(r) for r in got} == set(names.items())


def test_groups_read_from_the_match_alone(spark):
    stub = "1.2  JAN/2021  12345678  05/02/2021  9,50"
    texts = [None, "", "none", f"x {stub}\n3.4 FEV/2022 87654321 01/02/2022 1,00", f"1.2 JAN/202 {stub}1. 7", f"0 {stub}"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, block string")
    pair = r"Referência\s*(\d{1,2})\s*/\s*(\d{4})"
    df = df.unionByName(spark.createDataFrame([(10, "Referência 3 / 20219 Referência 4/2022"), (11, "REFERÊNCIA12/2021"), (12, "Referência 123/2021")], df.schema))
    for g in range(1, 6):
        got = df.select(L.of_match(L.STUB, g)(F.col("block")).alias("a"), L.first(L.STUB, g)(F.col("block")).alias("b")).collect()
        assert all(r["a"] == r["b"] for r in got)
    got = df.orderBy("i").select(L.joined(pair, "/", T.pad2)(F.col("block")).alias("a")).collect()
    assert [r["a"] for r in got] == [None, "", "", "", "", "", "03/2021", "12/2021", ""]
