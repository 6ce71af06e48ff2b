from datetime import datetime, timedelta
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from pageframe.operators import pages, store

T0 = datetime(2026, 1, 1)
DDL = "id string, updated_at timestamp, expires_at timestamp"


def jobs(spark, ages):
    return spark.createDataFrame([(f"j{k:03}", T0 - timedelta(seconds=s), T0 - timedelta(seconds=s) + timedelta(days=30)) for k, s in enumerate(ages)], DDL)


def test_retention(spark):
    now = F.lit(T0)
    assert store.retained(jobs(spark, range(205)), now).count() == 200
    old = jobs(spark, [40 * 86400, 0])
    assert [r["id"] for r in store.retained(old, now).collect()] == ["j001"]
    assert [r["id"] for r in store.expired(old, now).collect()] == ["j000"]
    assert store.retained(jobs(spark, [0]).limit(0), now).count() == 0


def test_latest_and_upsert(spark):
    rows = spark.createDataFrame([("a", T0, 1), ("a", T0 + timedelta(1), 2), ("a", T0 + timedelta(1), 2), ("b", None, 3)], "id string, updated_at timestamp, n int")
    assert sorted((r["id"], r["n"]) for r in store.latest(rows, "id", "updated_at").collect()) == [("a", 2), ("b", 3)]
    new = spark.createDataFrame([("b", T0, 9), ("c", T0, 4)], rows.schema)
    assert sorted((r["id"], r["n"]) for r in store.upsert(store.latest(rows, "id", "updated_at"), new, "id").collect()) == [("a", 2), ("b", 9), ("c", 4)]


def test_cascade_and_reuse(spark):
    p = spark.createDataFrame([("a", 1, "pdf-text"), ("a", 2, "pdf-text"), ("b", 1, "scanned"), ("b", 2, "pdf-text")], "job_id string, page_number int, source_kind string")
    assert {r["job_id"] for r in store.cascade(p, spark.createDataFrame([("a",)], "id string")).collect()} == {"a"}
    assert {r["job_id"]: r["reuse_original"] for r in store.pass_through(p).collect()} == {"a": True, "b": False}


def test_merging(spark):
    ddl = "job_id string, page_number int, result_id bigint, rank double"
    r = spark.createDataFrame([("a", 1, 1, 0.5), ("a", 1, 2, 0.5), ("a", 1, 3, 0.4), ("a", 2, 4, None), ("a", 2, 5, 0.1), ("b", 1, 6, None)], ddl)
    best = pages.best_of(r, ["job_id", "page_number"], F.col("rank"), "result_id").collect()
    assert sorted((x["job_id"], x["page_number"], x["result_id"]) for x in best) == [("a", 1, 1), ("a", 2, 5)]
    new = spark.createDataFrame([("a", 1, 9, 0.0)], ddl)
    assert sorted(x["result_id"] for x in pages.overlay(r.where("result_id in (1, 5)"), new, ["job_id", "page_number"]).collect()) == [5, 9]


def test_filters_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([("a", 1, "pdf-text", bytearray(b"x")), ("a", 2, "scanned", bytearray(b"y"))], "job_id string, page_number int, source_kind string, bytes binary").write.parquet(f"{tmp_path}/p")
    df = pages.to_recognise(spark.read.parquet(f"{tmp_path}/p").select("job_id", "page_number", "source_kind"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "source_kind" in plan and "bytes" not in plan and df.count() == 1


def test_ranks_of_a_large_job(spark, monkeypatch):
    monkeypatch.setattr("pageframe.operators.pages.SPAN", 7)
    rows = [("a", n) for n in range(3, 90) if n % 4] + [("b", 1), ("b", 50), (None, 2)]
    df = spark.createDataFrame(rows, "job_id string, page_number int")
    got = {(r["job_id"], r["page_number"]): (r["completed"], r["total"]) for r in pages.progress(df, "job_id", "page_number").collect()}
    a = sorted(n for j, n in rows if j == "a")
    assert got == {("a", n): (k + 1, len(a)) for k, n in enumerate(a)} | {("b", 1): (1, 2), ("b", 50): (2, 2), (None, 2): (1, 1)}
    texts = {r["page_number"]: r["text"] for r in pages.cycled(df.where("job_id = 'a'"), "page_number", ["x", "y", "z"]).collect()}
    assert texts == {n: "xyz"[k % 3] for k, n in enumerate(a)}
    assert pages.progress(df.limit(0), "job_id", "page_number").count() == 0


def test_selection_and_saved_form(spark):
    df = spark.createDataFrame([(k,) for k in range(4)], "page_index int")
    assert sorted(r[0] for r in pages.selected(df, [-1, 2, 0, 9]).collect()) == [0, 2]
    ddl = "id int, text string, regions array<struct<text:string,x:double,y:double,w:double,h:double,confidence:double>>, quality_flags array<string>"
    got = pages.normalised(spark.createDataFrame([(1, "t", [("r", 1.0, 2.0, 3.0, 4.0, 0.5)], ["f"]), (2, None, None, None)], ddl)).orderBy("id").collect()
    assert got[0]["regions"][0].asDict() == {"text": "r", "x": 1.0, "y": 2.0, "w": 3.0, "h": 4.0} and (got[1]["text"], got[1]["regions"], got[1]["quality_flags"]) == ("", [], [])


def test_lineage_is_cut_in_the_shared_folder(spark, monkeypatch):
    from pageframe import runtime

    kept = runtime.materialise(spark.range(5))
    assert kept.count() == 5 and "ExistingRDD" in kept._jdf.queryExecution().executedPlan().toString()

    class Context:
        master = "spark://host:7077"

        class _jsc:  # noqa: N801
            @staticmethod
            def sc():
                return SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isEmpty=lambda: True))

        @staticmethod
        def getConf():  # noqa: N802
            return {}

    frame = SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=Context))
    with pytest.raises(ValueError, match="all machines share"):
        runtime.materialise(frame)
