"""Every query against DuckDB on the smallest tables; those without SQL must run."""

import oracle
import pytest
from oracle import SMALL

from shelfspark.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    if name in SQL:
        assert oracle.difference(df, con, SQL[name]) == ""
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["id", "path", "hash", "perceptual_hash", "media_type", "width", "height", "duration_ms", "created_at", "captured_at", "indexed_at", "favorite", "rating", "color_label", "thumbnail_path", "camera", "lens", "deleted_at"]
