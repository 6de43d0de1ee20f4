import pytest

from __spark_entry__ import SMOKE_DIR, entry, oracle_sql, queries
from checks.compare import connect, difference

FAST = (
    "sub_indices",
    "feature_table",
    "feature_table_clock",
    "supervised_rows",
    "residual_intervals",
    "walk_forward_folds",
    "psi_by_feature",
    "feature_upsert",
    "leaderboard_history",
    "forecast_hours",
    "scenario_features",
    "sequence_windows",
    "range_chunks",
)


@pytest.fixture(scope="module")
def second_engine():
    return connect(SMOKE_DIR)


def test_every_twin_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert len(entry(spark).columns) == 74


@pytest.mark.parametrize("name", FAST)
def test_query_equals_its_twin(spark, second_engine, name):
    assert difference(spark, second_engine, name, SMOKE_DIR) == ""
