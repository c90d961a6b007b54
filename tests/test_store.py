import pytest
from pyspark.sql import functions as F

from aquabill.plans import load
from aquabill.sources.store import BUCKETS, Load, Store, history, in_buckets
from aquabill.streaming.load import load_stream

BILL = "EMPRESA string, NUM_FATURA string, MES_ANO_REF string, CONTA_DV string, NUM_HIDROMETRO string, VALOR_TOTAL double, PASTA_ORIGEM string, ARQUIVO_ORIGEM string"
METER = "CONTA_DV string, MES_ANO_REF string, NUM_HIDROMETRO_EXTRAIDO string, ARQUIVO_ORIGEM string, PASTA_ORIGEM string, path string, line_no int"


def bills(spark, *rows):
    return spark.createDataFrame([(issuer, number, "01/2020", account, None, 1.0, "p", "f") for issuer, number, account in rows], BILL)


def told(spark, *rows):
    return spark.createDataFrame([(account, month, meter, "f", "p", "p", i) for i, (account, month, meter) in enumerate(rows)], METER)


def numbers(frame):
    return sorted(r["NUM_FATURA"] for r in frame.collect())


def test_a_load_that_fails_before_it_is_published_is_not_seen(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    load.load(bills(spark, ("DEMAE", "1", "a")), path)

    def fails(self, *args):
        raise RuntimeError("the driver died")

    with monkeypatch.context() as m:
        m.setattr(Load, "commit", fails)
        with pytest.raises(RuntimeError):
            load.load(bills(spark, ("DEMAE", "2", "a"), ("SAE", "3", "b")), path)
    store = Store(spark, path)
    assert numbers(store.bills()) == ["1"] and store.versions() == [1]
    assert numbers(load.unseen(bills(spark, ("DEMAE", "2", "a")), store, store.manifest())) == ["2"]  # its keys do not count either
    report = load.load(bills(spark, ("DEMAE", "2", "a"), ("DEMAE", "1", "a")), path).collect()
    assert [(r["bills"], r["added"], r["ignored"]) for r in report] == [(2, 1, 1)] and numbers(store.bills()) == ["1", "2"]
    assert store.vacuum() > 0 and store.vacuum() == 0 and numbers(store.bills()) == ["1", "2"]
    # a manifest that its writer left half written
    (tmp_path / "store" / "versions" / "000000000003.json").write_text('{"version": 3, "data": [')
    assert numbers(store.bills()) == ["1", "2"]


def test_two_loads_at_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    one, other = store.begin(), store.begin()
    for own, number in ((one, "1"), (other, "2")):
        own.add_bills(bills(spark, ("DEMAE", number, "a")))
    one.commit()
    with pytest.raises(Exception, match="exist"):
        other.commit()
    assert numbers(store.bills()) == ["1"]


def test_only_buckets_of_new_meters_are_revised(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    accounts = [f"{i} 1" for i in range(200)]
    load.load(bills(spark, *[("SANEAGO", str(i), a) for i, a in enumerate(accounts)]), path)
    store = Store(spark, path)
    before = store.manifest()

    def revised(*rows):
        own = store.begin()
        load.take_meters(own, told(spark, *rows))
        load.revise(own)
        return own.commit()

    first = revised(("7 1", "01/2020", "A"), ("7 1", "03/2020", "B"), ("no bill", "01/2020", "C"))
    gone, came = set(before.data) - set(first.data), set(first.data) - set(before.data)
    assert len(gone) == len(came) == 1 and len(before.data) == BUCKETS
    held = {r["CONTA_DV"]: r["NUM_HIDROMETRO"] for r in store.bills().collect()}
    assert held == {a: "A" if a == "7 1" else None for a in accounts}
    # the same rows again, and rows that change nothing, read no bills or write none
    with monkeypatch.context() as m:
        m.setattr(Store, "bills", lambda *a, **k: pytest.fail("bills were read"))
        assert revised(("7 1", "01/2020", "A"), ("7 1", "03/2020", "B"), ("no bill", "01/2020", "C")).data == first.data
    assert revised(("7 1", "01/2019", "Z")).data == first.data
    assert len(in_buckets(first.data, [0, 1])) == 2 and store.bills(before).where("NUM_HIDROMETRO is not null").count() == 0


def test_a_replayed_epoch_adds_nothing(spark, tmp_path):
    from test_extraction import TEXTS

    (tmp_path / "in" / "DEMAE").mkdir(parents=True)
    (tmp_path / "in" / "DEMAE" / "f.txt").write_text(TEXTS["DEMAE", "f.txt"])
    path, checkpoint = str(tmp_path / "store"), tmp_path / "checkpoint"
    load_stream(spark, str(tmp_path / "in"), path, str(checkpoint)).awaitTermination()
    store = Store(spark, path)
    first = store.manifest()
    assert list(first.epochs.values()) == [0] and store.bills().count() == 1
    # the failure came after the manifest and before the stream's own commit
    for f in (checkpoint / "commits").iterdir():
        f.unlink()
    load_stream(spark, str(tmp_path / "in"), path, str(checkpoint)).awaitTermination()
    assert store.manifest() == first
    assert [(r["version"], r["EMPRESA"], r["bills"], r["added"]) for r in history(spark, path).collect()] == [(1, "DEMAE", 1, 1)]


def test_index_is_pruned_and_not_shuffled(spark, tmp_path):
    path = str(tmp_path / "store")
    for issuer in ("DEMAE", "SAE"):
        load.load(bills(spark, *[(issuer, str(i), "a") for i in range(50)]), path)
    store = Store(spark, path)
    known = store.keys(store.manifest(), ["SAE"])
    assert known.count() == 50
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        new = load.unseen(bills(spark, ("SAE", "7", "a"), ("SAE", "77", "a")), store, store.manifest())
        assert numbers(new) == ["77"]
        plan = new._jdf.queryExecution().toString().partition("== Physical Plan ==")[2].partition("== Initial Plan ==")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    assert "PartitionFilters: []" not in plan and "EMPRESA" in plan.partition("PartitionFilters: [")[2].partition("]")[0]


def test_an_older_store_becomes_the_first_version(spark, tmp_path):
    path = str(tmp_path / "store")
    bills(spark, ("DEMAE", "1", "a"), ("SANEAGO", "2", "b")).write.partitionBy("EMPRESA").parquet(path)
    report = load.load(bills(spark, ("DEMAE", "1", "a"), ("SANEAGO", "3", "b")), path).collect()
    assert sorted((r["EMPRESA"], r["added"]) for r in report) == [("DEMAE", 0), ("SANEAGO", 1)]
    store = Store(spark, path)
    assert numbers(store.bills()) == ["1", "2", "3"] and store.versions() == [1, 2]
    assert store.bills().where(F.col("EMPRESA") == "SANEAGO").count() == 2
