"""k-NN where vectors have no structure: items pass by the queries, and what is written stays linear in both."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from factlens.operators import pivots as P
from factlens.operators import retrieve as R
from factlens.session import ensure_checkpoint_dir


def _tables(spark, x, q, kind, name):
    items = [(name(n), v.tolist()) for n, v in enumerate(x)]
    items += [items[5], (items[7][0], items[900][1]), (None, items[3][1])]  # ids that repeat, and none
    asked = items[:-1:13] + [(name(10 ** 6), v.tolist()) for v in q]
    return (spark.createDataFrame(items, f"item_id {kind}, v array<double>").checkpoint(eager=True), items,
            spark.createDataFrame(asked, f"qid {kind}, v array<double>").checkpoint(eager=True), asked)


def _brute(asked, items, k, exclude):
    X, out = np.array([v for _, v in items]), set()
    for qid, v in dict(asked).items():
        acc = np.zeros(len(X))
        for j in range(X.shape[1]):
            acc += (X[:, j] - v[j]) ** 2
        s = 1.0 - acc
        order = sorted(range(len(X)), key=lambda j: (-s[j], items[j][0] is not None, items[j][0]))
        some = [j for j in order if not (exclude and items[j][0] in (qid, None))][:k]
        out |= {(qid, items[j][0], s[j]) for j in some}
    return out


@pytest.mark.parametrize("kind, scale, move", [("long", 1, 0), ("string", 1, 1000.0), ("long", 1e-7, 0), ("long", 1e9, 0)])
def test_items_passing_by_equal_brute_force(spark, monkeypatch, kind, scale, move):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 12))
    x[:300] = x[0]  # many equal vectors, and some nearly equal ones
    x[300:340] = x[300] + 1e-9 * rng.normal(size=(40, 12))
    x, q = x * scale + move, rng.normal(size=(1, 12)) * scale + move
    name = (lambda n: 7 * n - 50) if kind == "long" else (lambda n: f"i{n % 97}_{n}")
    stored, items, queries, asked = _tables(spark, x, q, kind, name)
    monkeypatch.setattr(P, "HEAD", 64)
    monkeypatch.setattr(P, "WIDE", 200)
    for i_block, exclude in ((300, True), (32768, False)):
        got = {tuple(r) for r in P.passing(P.pivot_index(stored, i_block), queries, 5, exclude, 64).select("qid", "item_id", "score").collect()}
        assert got == _brute(asked, items, 5, exclude)


def _bytes(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names)


def test_what_is_written_does_not_grow_with_the_product(spark):
    """Regression: vectors without structure sent every query to every block, on disk."""
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    rng = np.random.default_rng(5)
    stored = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(rng.normal(size=(4000, 16)))], "item_id long, v array<double>").checkpoint(eager=True)
    asked = stored.where("item_id % 2 = 0").select(F.col("item_id").alias("qid"), "v").checkpoint(eager=True)
    index = P.pivot_index(stored, 100)
    assert index.n_blocks > 30
    before = _bytes(folder)
    hits = P.nearest(index, asked, 5, True, R._tile_topk, 8192)
    assert hits.count() == 5 * 2000
    assert _bytes(folder) - before < 1.5 * 4000 * 16 * 8  # the items once (packed); was 2.8 times, although each block's copy of a query packs well


@pytest.mark.parametrize("query", ["m3_score_batch", "m5_pseudo_label"])
def test_documents_are_embedded_once(spark, monkeypatch, query):
    """Regression: texts were shuffled for their labels, and embedded in two steps (m3: the labelled ones twice)."""
    from factlens.plans import q_verify as QV

    made, embed = [], R.embed_text
    monkeypatch.setattr(R, "embed_text", lambda *a, **b: made.append(a) or embed(*a, **b))
    assert getattr(QV, query)(spark, "/root/testdata/sf0.001").count() > 0 and len(made) == 1
