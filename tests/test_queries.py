"""Every reference query against its SQL at the smallest scale."""

import pytest

from framewright import registry
from tests.compare import connect, same

ORACLES = registry.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, small, con, name):
    df = registry.queries()[name](spark, small)
    if name in ORACLES:
        same(df, con, ORACLES[name])
    else:
        assert name == "frame_cuts"  # held against a walk in test_frames
        assert df.columns == ["stream_id", "cut_idx", "score", "dissolve"] and all(0 <= r.score <= 1 for r in df.collect())


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(registry.queries())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
