import json
import os

import pytest
from pyspark.sql import functions as F
from test_extraction import GROUPED, REPORT, TEXTS

from aquabill import queries
from aquabill.operators import enrich, meters, route
from aquabill.plans import load, pipeline, render
from aquabill.schema import BILL, STORED
from aquabill.sources import files
from aquabill.sources.store import Store, history
from aquabill.streaming.load import load_stream


def write_texts(root):
    texts = {**TEXTS, ("Saneago", "fatura.txt"): GROUPED, ("Saneago", "saneago_analitica_03-2021.txt"): REPORT, ("DEMAE", "f.pdf"): "no text"}
    for (folder, name), text in texts.items():
        (root / folder).mkdir(parents=True, exist_ok=True)
        (root / folder / name).write_bytes(text.replace("\n", "\r\n").encode())
    (root / "a b+c%é").mkdir()
    (root / "a b+c%é" / "ç+1 %41.TxT").write_bytes(b"bad \xff byte\rend")


def bill(spark, *rows):
    return spark.createDataFrame([(*r, "DEMAE") for r in rows], "NUM_FATURA string, MES_ANO_REF string, CONTA_DV string, EMPRESA string")


def meter_rows(spark, *rows):
    return spark.createDataFrame([(*r, "p", i) for i, r in enumerate(rows)], "CONTA_DV string, MES_ANO_REF string, NUM_HIDROMETRO_EXTRAIDO string, path string, line_no int")


def test_scan(spark, tmp_path):
    write_texts(tmp_path)
    got = {(r["dir"], r["file_name"]): r["content"] for r in files.scan_texts(spark, str(tmp_path)).collect()}
    assert got["a b+c%é", "ç+1 %41.TxT"] == "bad � byte\nend"
    assert got["Águas de Ipameri/2023", "fatura.txt"] == TEXTS["Águas de Ipameri/2023", "fatura.txt"]
    assert ("DEMAE", "f.pdf") not in got


def test_pipeline_stream_and_store(spark, tmp_path):
    root = tmp_path / "in"
    write_texts(root)
    store = str(tmp_path / "store")
    first = {r["EMPRESA"]: r for r in pipeline.run(spark, str(root), store).collect()}
    assert {k: (first.pop(k)["documents"], bool(first.get(k))) for k in ("CHESP", "SANEAGO_ANALITICA", "UNKNOWN")} == {"CHESP": (1, False), "SANEAGO_ANALITICA": (1, False), "UNKNOWN": (2, False)}
    assert {k: r["added"] for k, r in first.items()} == {"DEMAE": 1, "IPAMERI": 1, "BURITI_ALEGRE": 1, "SAAE_ABADIANIA": 1, "SAAE_CORUMBA": 1, "SAAE_MINEIROS": 1, "CODEGO": 2, "SAE": 1, "SANEAGO": 3}
    assert sum(r["added"] for r in pipeline.run(spark, str(root), store).collect()) == 0
    load_stream(spark, str(root), store, str(tmp_path / "checkpoint")).awaitTermination()
    stored = Store(spark, store).bills()
    assert stored.count() == 12 and stored.columns == [*STORED.names[:20], *STORED.names[21:], "EMPRESA"]
    assert {r["EMPRESA"] for r in stored.collect()} == set(first)  # meter reports are no bills
    assert stored.where("DATA_PROCESSAMENTO rlike '^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}$'").count() == 12
    got = {r["CONTA_DV"]: r["NUM_HIDROMETRO"] for r in stored.where("EMPRESA = 'SANEAGO'").collect()}
    assert got == {"12345 6": "A2", "88 3": "B9", "77 2": None}
    files.export_csv(stored, str(tmp_path / "csv"))
    back = files.read_csv(spark, str(tmp_path / "csv"), STORED)
    assert sorted(map(str, back.select(*BILL.names[:8]).collect())) == sorted(map(str, stored.select(*[F.nullif(c, F.lit("")).alias(c) for c in BILL.names[:8]]).collect()))


def test_stream_in_many_batches_equals_one(spark, tmp_path):
    root = tmp_path / "in" / "Saneago"
    root.mkdir(parents=True)
    late = REPORT.replace("A2", "A3").replace("Conta N. 77 - 2\nsem medidor", "Conta N. 77 - 2\nHidrometro: C7")
    # bills before and after their reports, and a repeat of one file's bills
    texts = [("fatura.txt", GROUPED), ("saneago_analitica_01-2021.txt", REPORT), ("fatura_2.txt", GROUPED), ("saneago_analitica_02-2021.txt", late), ("fatura_3.txt", GROUPED.replace("555", "556"))]
    for i, (name, text) in enumerate(texts):
        (root / name).write_text(text)
        os.utime(root / name, (1_600_000_000 + 100 * i,) * 2)
    shown = lambda df: sorted(map(str, df.select("ARQUIVO_ORIGEM", "NUM_FATURA", "CONTA_DV", "NUM_HIDROMETRO").collect()))
    want = shown(pipeline.bills_of(files.scan_texts(spark, str(tmp_path / "in"))))
    assert len(want) == 9 and sum("A3" in w for w in want) == 3
    store = str(tmp_path / "store")
    for i in range(2):  # a second stream adds nothing
        load_stream(spark, str(tmp_path / "in"), store, str(tmp_path / f"checkpoint{i}"), max_files=1).awaitTermination()
        assert shown(Store(spark, store).bills()) == want
    # a report of a later run, by itself
    (tmp_path / "more" / "Saneago").mkdir(parents=True)
    (tmp_path / "more" / "Saneago" / "saneago_analitica_03-2021.txt").write_text(REPORT.replace("A2", "A4"))
    assert [(r["documents"], r["added"]) for r in pipeline.run(spark, str(tmp_path / "more"), store).collect()] == [(1, 0)]
    assert shown(Store(spark, store).bills()) == [w.replace("A3", "A4") for w in want]
    assert Store(spark, store).meters().count() == 7


def test_relation(spark):
    made = lambda *rows: {r["CONTA_DV"] + r["MES_ANO_REF"]: r["NUM_HIDROMETRO"] for r in rows}
    bills = bill(spark, ("1", "03/2021", "12345  6"), ("1", "04/2021", "12345 6"), ("1", "02/2022", "7 7"), ("1", "03/2021", "55 5")).withColumn("NUM_HIDROMETRO", F.lit(""))
    m = meter_rows(spark, (" 12345 6", "03/2021", "A2"), ("12345 6", "05/2021", "A9"), ("12345 6", "03/2021", "late"), ("7 7", "", "Z1"), ("7 7", "01/2020", "A0"))
    assert made(*meters.relate(bills, m).collect()) == {"12345  603/2021": "A2", "12345 604/2021": "A9", "7 702/2022": "A0", "55 503/2021": None}
    assert {r["NUM_HIDROMETRO"] for r in meters.relate(bills, m.limit(0)).collect()} == {""}


def test_new_rows(spark):
    store = bill(spark, ("555", "03/2021", "12345 6"), ("", "", "1"))
    batch = bill(spark, ("555", "03/2021", "12345 6"), ("555", "03/2021", "77 2"), ("555", "03/2021", "77 2"), (None, None, "1"))
    assert [r["CONTA_DV"] for r in load.new_rows(batch, store).collect()] == ["77 2", "77 2"]
    assert load.new_rows(batch, store.limit(0)).count() == 4


def test_keys_of_older_stores_and_other_issuers(spark):
    store = bill(spark, ("NÃO ACHOU", "03/2021", "1"))
    assert load.new_rows(bill(spark, ("", "03/2021", "1")), store).count() == 0
    assert load.new_rows(bill(spark, ("", "03/2021", "1")).withColumn("EMPRESA", F.lit("SAE")), store).count() == 1


def test_roots(spark, tmp_path, monkeypatch):
    write_texts(tmp_path / "j" / "judge")
    (tmp_path / "j" / "judge" / "DEMAE" / "_f.txt").write_text("x")
    (tmp_path / "j" / "judge" / ".h").mkdir()
    (tmp_path / "j" / "judge" / ".h" / "f.TXT").write_text("x")
    own = files.scan_texts(spark, f"{tmp_path}/j/judge/DEMAE")
    assert [(r["dir"], r["root"], r["EMPRESA"]) for r in route.route(own).collect()] == [("", "DEMAE", "DEMAE")]
    # relative to the JVM's folder
    relative = os.path.relpath(tmp_path / "j", os.getcwd())
    assert {r["dir"].split("/")[0] for r in files.scan_texts(spark, relative).collect()} == {"judge"}
    assert files.skipped_texts(spark, f"{tmp_path}/j") == 2


def test_stored_register(spark, tmp_path):
    root, path = tmp_path / "in", tmp_path / "register.json"
    write_texts(root)
    path.write_text(json.dumps([{"id_CONTA": 1, "CONTA_DV": "21544-9", "UNIDADE": "Forum", "ESGOTO": True}, {"id_CONTA": 2, "CONTA_DV": "12345 6", "UNIDADE": "B"}]))
    stores = [str(tmp_path / "a"), str(tmp_path / "b")]
    pipeline.run(spark, str(root), stores[0], str(path), redistribute=True)
    load_stream(spark, str(root), stores[1], str(tmp_path / "checkpoint"), 2, str(path), True).awaitTermination()
    for store in stores:
        got = {r["CONTA_DV"]: r for r in Store(spark, store).bills().where("UNIDADE is not null and EMPRESA <> 'SAE'").collect()}
        assert {k: (r["id_CONTA"], r["UNIDADE"], r["NUM_HIDROMETRO"]) for k, r in got.items()} == {"21544-9": (1, "Forum", None), "12345 6": (2, "B", "A2")}
        assert (got["21544-9"]["VALOR_AGUA"], got["21544-9"]["VALOR_ESGOTO"]) == (0.0, 497.84)


def test_register(spark, tmp_path):
    path = tmp_path / "register.json"
    rows = [{"id_CONTA": 2, "CONTA_DV": "12345  6", "UNIDADE": "B", "AGUA": True}, {"id_CONTA": 1, "CONTA_DV": "12345 6", "UNIDADE JUDICIÁRIA": "A", "other": 1}]
    path.write_text(json.dumps(rows, ensure_ascii=False), encoding="utf-8")
    register = files.read_register(spark, str(path))
    assert [tuple(r) for r in enrich.repeated_accounts(register).collect()] == [("12345 6", 2)]
    got = {r["CONTA_DV"]: (r["id_CONTA"], r["UNIDADE"]) for r in enrich.enrich(bill(spark, ("1", "", "12345 6"), ("1", "", "9 9")), register).collect()}
    assert got == {"12345 6": (1, "A"), "9 9": (None, None)}
    assert files.read_register(spark, str(tmp_path / "none.json")) is None
    assert enrich.enrich(register, None) is register


def test_redistribute(spark):
    cases = [((10.0, 20.0, 3.0), (True, False, True), (10.0, 0.0, 20.0)), ((0.0, 20.0, 3.0), (True, True, False), (20.0, 3.0, 0.0)), ((1.0, 2.0, 3.0), (False, None, False), (1.0, 2.0, 3.0)), ((1.0, None, 3.0), (True, True, True), (1.0, 3.0, 0.0))]
    rows = spark.createDataFrame([(i, *v, *f) for i, (v, f, _) in enumerate(cases)], "i int, VALOR_AGUA double, VALOR_ESGOTO double, VALOR_TAXAS_EXTRAS double, AGUA boolean, ESGOTO boolean, SMRSU boolean")
    got = enrich.redistribute(rows).orderBy("i").collect()
    assert [(r["VALOR_AGUA"], r["VALOR_ESGOTO"], r["VALOR_TAXAS_EXTRAS"]) for r in got] == [c[2] for c in cases]


def test_rendered_reports_grow_in_number(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    largest = orders.groupBy(F.date_format("o_orderdate", "yyyyMM")).count().agg(F.max("count")).first()[0]
    docs = render.meter_documents(orders, size=3).select("path", F.regexp_count("content", F.lit("linha")).alias("n")).collect()
    assert sum(r["n"] for r in docs) == orders.count() and len({r["path"] for r in docs}) == len(docs)
    assert max(r["n"] for r in docs) < largest * 0.6


@pytest.mark.parametrize("name", ["incremental_twice", "load_two_issuers"])
def test_texts_are_not_looked_at_again_for_each_load(spark, sf_dir, monkeypatch, name):
    plans, real = [], load.load

    def loaded(batch, *args, **more):
        plans.append(batch._jdf.queryExecution().optimizedPlan().toString())
        return real(batch, *args, **more)

    monkeypatch.setattr(load, "load", loaded)
    queries.QUERIES[name](spark, sf_dir)
    assert len(plans) == 3 and not any("regexp_extract" in p for p in plans)


def test_a_load_without_a_persisted_copy_gives_the_same(spark, tmp_path):
    rows = bill(spark, ("1", "01/2021", "7"), ("2", "01/2021", "7"), ("", None, "8"))
    batch = rows.select("*", *[F.lit(None).cast("string").alias(c) for c in ("NUM_HIDROMETRO", "PASTA_ORIGEM", "ARQUIVO_ORIGEM")], F.lit(0.0).alias("VALOR_TOTAL"))
    got = [[load.load(b, str(tmp_path / str(p)), persist=p).collect() for b in (batch.where("NUM_FATURA = '1'"), batch)] for p in (True, False)]
    assert got[0] == got[1]
    assert [(r["added"], r["ignored"]) for told in got[0] for r in told] == [(1, 0), (2, 1)]


def test_a_stream_that_keeps_one_version_leaves_no_other_folders(spark, tmp_path):
    root = tmp_path / "in" / "Saneago"
    root.mkdir(parents=True)
    for i, (name, text) in enumerate([("fatura.txt", GROUPED), ("saneago_analitica_01-2021.txt", REPORT)]):
        (root / name).write_text(text)
        os.utime(root / name, (1_600_000_000 + 100 * i,) * 2)
    load_stream(spark, str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "checkpoint"), max_files=1, keep=1).awaitTermination()
    store = Store(spark, str(tmp_path / "store"))
    listed = store.manifest()
    assert listed.version == 2 and sorted(store._names("data/*/*/bucket=*")) == sorted(f"data/{f}" for f in listed.data)
    assert len({f.split("/")[0] for f in listed.data}) == 1 and store.bills().where("NUM_HIDROMETRO is not null").count() > 0
