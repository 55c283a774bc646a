"""Every registered query against its DuckDB oracle at sf0.01 (the driver's gate)."""

import pytest

import __spark_entry__ as entry
from conftest import SF01
from oracle_compare import compare, duck
from polysafe.plans.oracle import ORACLE
from polysafe.plans.queries import REGISTRY as QUERIES


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, con, name):
    r = compare(spark, name, QUERIES[name], ORACLE[name], SF01, con)
    assert r["cols_ok"], (r["spark_cols"], r["oracle_cols"])
    assert r["rows_ok"], (r["spark_rows"], r["oracle_rows"])
    assert r["values_ok"], r.get("first_diff")


def test_every_query_has_oracle_or_is_model_based():
    rows_only = set(QUERIES) - set(ORACLE)
    assert rows_only <= {"pca_projection", "standardize_2d", "probe_metrics",
                         "decision_grid", "layer_sweep", "html_decode", "probe_metrics_svm"}


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert set(df.columns) >= {"model", "prompt_type", "language", "language_response", "refusal"}
