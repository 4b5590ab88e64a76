"""Every registered query runs, and agrees with its SQL where it has one."""

import pytest

import __spark_entry__ as entry
from tools import check_oracles


@pytest.fixture(scope="module")
def connection(testdata):
    return check_oracles.connect(testdata)


def test_oracles_name_registered_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    row = entry.entry(spark).first()
    assert row["n_loans"] == 150 and row["expected_loss_rate"] > 0


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_agrees_with_sql(spark, connection, testdata, name):
    status, _, _ = check_oracles.compare(spark, connection, testdata, name)
    assert status == "ok"


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql()) - {"fit_loan_classifier", "fit_segment_model", "fit_hazard", "tree_attributions", "fused_ablation", "retrain_and_gate", "drift_triggered_retrain"}))
def test_query_without_sql_returns_rows(spark, testdata, name):
    assert entry.queries()[name](spark, testdata).limit(1).count() == 1
