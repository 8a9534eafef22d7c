"""Every registered query against its DuckDB oracle (the driver's gate)."""
import pytest

import __spark_entry__ as E
from encore.plans import registry
from tests.conftest import SF_MID, SF_SMALL
from tests.harness import compare, duck

ORACLE = E.oracle_sql()
NAMES = sorted(ORACLE)
#: Enough groups a task to make aggregates spill or fall back.
LARGE = ["view_artist_stats", "view_track_stats", "view_session_behavior", "session_metrics", "view_artist_tiers"]


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.fixture(scope="module")
def con_mid():
    return duck(SF_MID)


def test_every_query_has_oracle():
    """The training-data queries without SQL are accounted for in tests/llm."""
    assert set(registry.queries()) <= set(ORACLE) <= set(E.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    ok, msg = compare(E.queries()[name](spark, SF_SMALL), ORACLE[name], con)
    assert ok, msg


@pytest.mark.parametrize("name", LARGE)
def test_views_match_oracle_on_more_rows(spark, con_mid, name):
    ok, msg = compare(E.queries()[name](spark, SF_MID), ORACLE[name], con_mid)
    assert ok, msg


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "session_type" in df.columns
