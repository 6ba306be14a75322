"""Every registered query runs, and equals its SQL where it has any."""

import numpy as np
import pytest

from kinetrail.plans.queries import ORACLE, QUERIES
from tests.oracle import differences, views


@pytest.fixture(scope="module")
def con(small):
    return views(small)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, small, con, name):
    assert differences(spark, con, QUERIES[name], ORACLE[name], small) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, small, name):
    """Rows there are, none without a number that should have one, and labels and shares keep their rules."""
    rows = QUERIES[name](spark, small).toPandas()
    assert len(rows) > 0
    if name.endswith("_labels"):
        n = spark.read.parquet(f"{small}/{'events' if 'event_id' in rows else 'embeddings'}.parquet").count()
        assert len(rows) == n and rows["label"].dropna().min() >= 0
        assert rows["label"].nunique() > 1 or name == "mean_shift_labels"  # all rows may rise to one mode
    if name.endswith("_transform"):
        assert np.isfinite(rows["v"]).all() and rows.groupby("i")["v"].std().min() > 0
    if name in ("bayesian_msm", "bootstrap_msm") and "population" in rows:
        assert np.allclose(rows.groupby(rows.columns[0])["population"].sum(), 1)
    if name == "rate_matrix":
        assert np.allclose(rows.groupby("src")["rate"].sum(), 0, atol=1e-9) and (rows.loc[rows["src"] != rows["dst"], "rate"] >= 0).all()
    if name == "tpt_states":
        assert rows["committor"].between(0, 1).all() and rows["mfpt"].min() == 0 and {0.0, 1.0} <= set(rows["committor"].round(9))
    if name == "lumping_states":
        assert (rows.groupby("kind")["macro"].nunique() == 2).all()


def test_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_plans_prune_and_share_one_window(spark, small):
    plan = QUERIES["msm_counts_multilag"](spark, small)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.split("\n") if "ReadSchema" in line]
    assert len(scans) == 1 and "props" not in scans[0]
    assert plan.count("Window ") == 1
