"""Seeded sampling: exactness vs a single-window rank, partition independence,
fold balance, split completeness, quantile bins with ties, odd shortfall."""

import hashlib

import pandas as pd
from pyspark.sql import functions as F

from factlens.operators import sampling as S
from tests.conftest import SF_SMALL


def _py_rank(df: pd.DataFrame, label, idc, seed=42):
    df = df.assign(_k=[hashlib.md5(f"{i}:{seed}".encode()).hexdigest() for i in df[idc]])
    df = df.sort_values([label, "_k", idc])
    df["rank"] = df.groupby(label).cumcount() + 1
    return dict(zip(df[idc], df["rank"]))


def test_two_level_rank_equals_single_window(spark):
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet").select("o_orderkey", "o_orderstatus")
    exp = _py_rank(o.toPandas(), "o_orderstatus", "o_orderkey")
    for hexd in (1, 2, 4):
        got = {r[0]: r[1] for r in S.seeded_rank(o, ["o_orderstatus"], "o_orderkey", bucket_hex=hexd)
               .select("o_orderkey", "rank").collect()}
        assert got == exp


def test_sample_independent_of_partitioning(spark):
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet").select("o_orderkey", "o_orderstatus")
    a = S.stratified_exact_sample(o.repartition(1), "o_orderstatus", "o_orderkey", 50)
    b = S.stratified_exact_sample(o.repartition(7), "o_orderstatus", "o_orderkey", 50)
    assert sorted(a.select("o_orderkey").collect()) == sorted(b.select("o_orderkey").collect())
    assert {r[0]: r[1] for r in a.groupBy("o_orderstatus").count().collect()} == {"F": 50, "O": 50, "P": 50}


def test_folds_balanced_and_split_complete(spark):
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet").select("o_orderkey", "o_orderstatus")
    f = S.balanced_folds(o, "o_orderstatus", "o_orderkey", 4, 30)
    c = f.groupBy("fold", "o_orderstatus").count().collect()
    assert len(c) == 12 and {r["count"] for r in c} == {30}
    sp = S.stratified_split(o, "o_orderstatus", "o_orderkey", 0.1)
    n = o.count()
    sizes = {r[0]: r[1] for r in sp.groupBy("split").count().collect()}
    assert sizes["test"] == int(n * 0.1) and sizes["val"] == int(n * 0.1) and sum(sizes.values()) == n
    assert sp.select("o_orderkey").distinct().count() == n


def test_quantile_bins_with_ties(spark):
    vals = [1] * 50 + [2] * 30 + [3] * 5 + [100]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id int, x int")
    got = {r["id"]: r["bin"] for r in S.quantile_bins(df, "x", 9).collect()}
    exp = pd.qcut(pd.Series(vals), q=9, labels=False, duplicates="drop")
    assert [got[i] for i in range(len(vals))] == exp.tolist()


def test_balance_with_relabel_odd_shortfall(spark):
    rows = [(i, "A") for i in range(40)] + [(100 + i, "B") for i in range(40)] + [(200 + i, "C") for i in range(13)]
    df = spark.createDataFrame(rows, "id int, label string")
    out = S.balance_with_relabel(df, "label", "id", 20, "C", ("A", "B"))
    c = {r[0]: r[1] for r in out.groupBy("label").count().collect()}
    assert c == {"A": 20, "B": 20, "C": 20}
    relab = {r[0]: r[1] for r in out.where("relabelled").groupBy(F.expr("id div 100")).count().collect()}
    assert relab == {0: 3, 1: 4}   # shortfall 7: 3 from A, 4 (half + odd one) from B
    assert out.select("id").distinct().count() == 60


def test_with_replacement_counts(spark):
    rows = [(i, "big") for i in range(30)] + [(100 + i, "rare") for i in range(4)]
    df = spark.createDataFrame(rows, "id int, label string")
    out = S.sample_with_replacement(df, "label", "id")
    c = {r[0]: r[1] for r in out.groupBy("label").count().collect()}
    assert c == {"big": 8, "rare": 8}
