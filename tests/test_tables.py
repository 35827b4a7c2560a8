"""Scan spreading is asked for by the session, never decided from the input."""

from factlens.sources.tables import raw, spread
from tests.conftest import SF_SMALL


def test_spread_only_where_the_session_asks(spark):
    par = spark.sparkContext.defaultParallelism
    d = raw(spark, SF_SMALL, "documents")
    s = spread(d)
    assert s.rdd.getNumPartitions() == par
    assert sorted(r[0] for r in s.select("doc_id").collect()) == sorted(r[0] for r in d.select("doc_id").collect())
    spark.conf.set("spark.factlens.spread", "false")
    try:
        assert spread(d) is d
    finally:
        spark.conf.set("spark.factlens.spread", "true")
