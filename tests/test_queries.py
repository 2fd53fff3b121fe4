"""Every registered query equals its SQL at the smallest scale."""
import pytest

import __spark_entry__ as entry_point
from tests.oracle import connect, difference

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry_point.queries(), entry_point.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in SQL:
        assert difference(df, con, SQL[name]) is None
    else:
        assert df.count() > 0


def test_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    df = entry_point.entry(spark)
    assert df.columns == ["type", "id", "label", "count", "confidence", "description"]
    assert df.count() > 0


@pytest.mark.parametrize("name", ["detect_escalations", "detect_bursts", "cluster_labels", "group_clusters"])
@pytest.mark.parametrize("parts", ["1", "3"])
def test_shuffle_partitions_do_not_matter(spark, con, name, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert difference(QUERIES[name](spark, SF), con, SQL[name]) is None
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
