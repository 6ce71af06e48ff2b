import os

import duckdb
import pytest

from pageframe.plans import queries as core

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(map(str, (tuple("null" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in frame.astype(object).itertuples(index=False))))


@pytest.mark.parametrize("name", ["text_counts", "quality_by_language", "best_attempts", "export_regions", "page_columns", "retained_jobs", "loaded_jobs", "best_runs", "otsu_thresholds", "benchmark_grid"])
def test_equals_sql(spark, con, name):
    ours, theirs = core.queries()[name](spark, DATA).toPandas(), con.sql(core.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    ours = ours.astype({c: "float64" for c in ours.columns if str(ours[c].dtype).lower().startswith(("int", "float"))})
    theirs = theirs.astype({c: "float64" for c in theirs.columns if str(theirs[c].dtype).lower().startswith(("int", "float"))})
    assert rows(ours) == rows(theirs)


def test_every_sql_has_a_query():
    assert set(core.oracle_sql()) <= set(core.queries())


def test_whole_grid(spark, con):
    ours, theirs = core.queries()["benchmark_whole_grid"](spark, DATA).toPandas(), con.sql(core.oracle_sql()["benchmark_whole_grid"]).df()
    assert rows(ours) == rows(theirs)
    part = core.queries()["benchmark_grid"](spark, DATA).toPandas()
    assert len(ours) == ours.engine.nunique() * ours.fixture.nunique() * ours.preprocess.nunique() > len(part) > 0
    assert rows(ours[ours.shard == 1].drop(columns="shard")) == rows(part)
