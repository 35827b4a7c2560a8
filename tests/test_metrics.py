"""Metrics: a class never predicted, tied scores in AUC, a single class."""

import itertools

from factlens.operators import stats as ST


def _auc_brute(a, s):
    pos = [x for x, y in zip(s, a) if y == 1]
    neg = [x for x, y in zip(s, a) if y != 1]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in itertools.product(pos, neg))
    return tot / (len(pos) * len(neg))


def test_binary_metrics_ties(spark):
    a = [1, 0, 1, 0, 1, 1, 0, 0, 1, 0]
    p = [1, 0, 0, 0, 1, 1, 1, 0, 1, 0]
    s = [0.9, 0.1, 0.5, 0.5, 0.7, 0.7, 0.7, 0.2, 0.3, 0.3]
    df = spark.createDataFrame(list(zip(a, p, s)), "a int, p int, s double")
    r = ST.binary_metrics(df, "a", "p", "s").first()
    assert (r.tp, r.fp, r.tn, r.fn) == (4, 1, 4, 1)
    assert abs(r.roc_auc - _auc_brute(a, s)) < 1e-6
    assert abs(r.mcc - 0.6) < 1e-6


def test_class_never_predicted_and_single_class(spark):
    df = spark.createDataFrame([("x", "x"), ("y", "x"), ("z", "x")], "a string, p string")
    r = ST.classification_metrics(df, "a", "p").first()
    assert abs(r.accuracy - 1 / 3) < 1e-6 and abs(r.precision - 1 / 9) < 1e-6 and abs(r.recall - 1 / 3) < 1e-6
    one = spark.createDataFrame([(1, 1, 0.5), (1, 1, 0.7)], "a int, p int, s double")
    r1 = ST.binary_metrics(one, "a", "p", "s").first()
    assert r1.roc_auc is None and r1.mcc == 0.0


def test_length_stats_mode_smallest_on_tie(spark):
    df = spark.createDataFrame([(v,) for v in [3, 3, 5, 5, 9]], "x int")
    r = ST.length_stats(df, "x").first()
    assert r["mode"] == 3 and r["median"] == 5.0 and r["n"] == 5
