"""Every registered query of the linkage engine against its oracle, on the smallest tables."""

import math
import os
from collections import Counter

import duckdb
import pytest

from linkloom import catalog

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
SLOW = {"stage1_scores", "stage2_scores", "learning_curve", "unseen_country", "feature_ablation"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "customer", "part"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def _text(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(v)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - SLOW))
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, FOLDER)
    assert not [t for _, t in df.dtypes if t.startswith(("decimal", "array", "struct", "map"))]
    sql = catalog.oracle_sql().get(name)
    columns = sorted(df.columns)
    got = Counter(tuple(map(_text, r)) for r in df.select(*columns).collect())
    if sql is None:
        return
    q = con.execute(sql)
    at = [[x[0] for x in q.description].index(c) for c in columns]
    assert got == Counter(tuple(_text(r[k]) for k in at) for r in q.fetchall())


def test_matchers(spark):
    rows = catalog.queries()["stage1_scores"](spark, FOLDER).collect()
    assert rows and all(0 <= r.p1 <= 1 for r in rows)
    yes, no = [[r.p1 for r in rows if r.y == y] for y in (True, False)]
    assert sum(yes) / len(yes) > sum(no) / len(no)
    rows2 = catalog.queries()["stage2_scores"](spark, FOLDER).collect()
    assert len(rows2) == len(rows) and {r.fold for r in rows2} == {0, 1}


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["learning_curve", "unseen_country", "feature_ablation"])
def test_experiments(spark, name):
    rows = catalog.queries()[name](spark, FOLDER).collect()
    assert rows and all(r.auc is None or 0 <= r.auc <= 1 for r in rows)


def test_experiments_compute_their_rows_once(spark, monkeypatch):
    from pyspark.sql import functions as F

    from linkloom.operators import experiments

    ws, seen, made = catalog.workspace(spark, FOLDER), spark.sparkContext.accumulator(0), experiments.stage1_features

    def features(ws):
        look = F.udf(lambda u: seen.add(1) or u, "double").asNondeterministic()
        return made(ws).withColumn("u", look("u"))

    monkeypatch.setattr(experiments, "stage1_features", features)
    ws.built.pop("experiment_rows", None)
    for name in ("learning_curve", "unseen_country", "feature_ablation"):
        catalog.queries()[name](spark, FOLDER).collect()
    assert seen.value == made(ws).count()


def test_measured_against_brute_force(spark):
    from linkloom.operators.experiments import _measured

    rows = [(k % 3 == 0, p) for k, p in enumerate([0.1, 0.9, 0.9, 0.4, 0.4, 0.4, 0.7, 0.2, 0.9, 0.5])]
    yes, no = [p for y, p in rows if y], [p for y, p in rows if not y]
    auc, loss = _measured(spark.createDataFrame(rows, "y boolean, p double"))
    assert math.isclose(auc, sum((a > b) + (a == b) / 2 for a in yes for b in no) / len(yes) / len(no))
    assert math.isclose(loss, sum(-math.log(p if y else 1 - p) for y, p in rows) / len(rows))
