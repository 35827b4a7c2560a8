"""The pivot index (J5) and the stored inverted index (J7, J8) against brute force, in many blocks and segments."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from factlens.operators import inverted as INV
from factlens.operators import keywords as KW
from factlens.operators import pivots as P
from factlens.operators import retrieve as R

VEC = "id string, embedding array<double>"


def clustered(rng, n, dim=12, clusters=20):
    centers = rng.normal(size=(clusters, dim)) * 4
    x = centers[rng.integers(clusters, size=n)] + rng.normal(size=(n, dim)) * 0.3
    x[: n // 3] = x[0]  # a third of all vectors is one vector
    return np.round(x, 3)


def brute_knn(q, items, k, exclude_self):
    out = {}
    X = np.array([v for _, v in items])
    for qid, v in q:
        s = [1.0 - sum((a - b) * (a - b) for a, b in zip(x, v)) for x in X]
        order = sorted(range(len(items)), key=lambda j: (-s[j], items[j][0]))
        out[qid] = [(items[j][0], round(s[j], 9)) for j in order if not (exclude_self and items[j][0] == qid)][:k]
    return out


def got_knn(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        out[r.qid].append((r.item_id, round(r.score, 9)))
    return dict(out)


@pytest.mark.parametrize("i_block, q_block", [(131072, 8192), (64, 8192), (50, 16)])
def test_pivot_knn_equals_brute_force(spark, i_block, q_block):
    rng = np.random.default_rng(7)
    x = clustered(rng, 600)
    items = [(f"i{n:04d}", v.tolist()) for n, v in enumerate(x)]
    queries = [(f"q{n}", v.tolist()) for n, v in enumerate(clustered(rng, 90))] + items[::40]
    df = spark.createDataFrame(items, VEC).withColumn("embedding", F.col("embedding"))
    stored = df.select(F.col("id").alias("item_id"), F.col("embedding").alias("v")).checkpoint(eager=True)
    asked = spark.createDataFrame(queries, VEC).select(F.col("id").alias("qid"), F.col("embedding").alias("v")).checkpoint(eager=True)
    index = P.pivot_index(stored, i_block)
    assert (index.n_blocks > 5) == (i_block < 1000)
    for exclude in (False, True):
        got = got_knn(P.nearest(index, asked, 5, exclude, R._tile_topk, q_block))
        assert got == brute_knn(queries, items, 5, exclude)


def test_knn_string_ids_empty_blocks_and_few_items(spark):
    """Regression: a tile without queries or items must give typed rows, whatever the type of the ids."""
    for metric in ("l2sq", "cosine"):
        q = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], VEC)
        items = spark.createDataFrame([(f"i{n}", [float(n), 1.0]) for n in range(10)] + [("none", None)], VEC)
        out = R.knn_join(q, items, k=3, metric=metric, q_id="id", i_id="id", q_block=1, i_block=3).collect()
        assert Counter(r.qid for r in out) == {"a": 3, "b": 3}
        few = R.knn_join(q, items.where("id in ('i1', 'none')"), k=3, metric=metric, q_id="id", i_id="id").collect()
        assert Counter(r.qid for r in few) == {"a": 1, "b": 1}
        for a, b in ((q.limit(0), items), (q, items.limit(0)), (q.limit(0), items.limit(0))):
            assert R.knn_join(a, b, k=3, metric=metric, q_id="id", i_id="id").collect() == []


def test_pivots_skip_cells(spark):
    x = clustered(np.random.default_rng(1), 2000)
    stored = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(x)], "item_id long, v array<double>").checkpoint(eager=True)
    index = P.pivot_index(stored, 100)
    g = index.geometry()
    d = g.distances(x[::20])
    kth = np.sort(np.array([((x - q) ** 2).sum(axis=1) for q in x[::20]]), axis=1)[:, 4]
    open_cells = g.open_cells(d, kth)
    assert open_cells.mean() < 0.3  # structure is used: most cells are never visited
    nearest_cell = d.argmin(axis=1)
    assert open_cells[np.arange(len(d)), nearest_cell].all()


# inverted index

def brute_search(claims, docs, limit=None):
    tok = {i: Counter(t for t in regex.split(r"[^\p{L}\p{N}]+", (x or "").lower()) if t) for i, x in docs if i is not None}
    out = {}
    for key, words in claims.items():
        hits = sorted((-sum(c[w] for w in words), i) for i, c in tok.items() if all(c[w] for w in words))
        if hits:
            out[key] = [(i, -s) for s, i in hits][:limit]
    return out


def corpus(rng, n):
    words = [f"w{i}" for i in range(60)]
    return [(f"d{i:04d}", " ".join(rng.choices(words, weights=[200 / (j + 1) for j in range(60)], k=rng.randrange(0, 60)))) for i in range(n)] + [
        ("empty", ""), ("null", None), (None, "w0 w1"), ("Case", "W0, w1; W2-w3!"), ("long", "w5 " * 5000)]


@pytest.mark.parametrize("tokens, docs", [(1 << 20, 1 << 16), (300, 1 << 16), (1 << 20, 7)])
def test_inverted_search_equals_brute_force(spark, tokens, docs):
    rng = random.Random(4)
    rows = corpus(rng, 300)
    df = spark.createDataFrame([(i, t, "en" if n % 3 else "de") for n, (i, t) in enumerate(rows)], "doc_id string, text string, lang string").repartition(3)
    index = INV.build(df, scope=("lang",), segment_tokens=tokens, segment_docs=docs)
    claims = {n: sorted(set(rng.choices(range(62), weights=[60 / (j + 1) for j in range(62)], k=rng.randrange(1, 4)))) for n in range(40)}
    claims = {n: [f"w{j}" for j in ws] for n, ws in claims.items()}  # w60 and w61 stand nowhere
    asked = spark.createDataFrame([(n, w.upper() if n % 2 else w) for n, ws in claims.items() for w in ws], "claim_id long, term string")
    for limit in (None, 1, 5):
        got = defaultdict(list)
        for r in sorted(INV.search(index, asked, ["claim_id"], limit).collect(), key=lambda r: r["rank"]):
            got[r.claim_id].append((r.doc, r.score))
        assert dict(got) == brute_search(claims, rows, limit)
    german = [r for n, r in enumerate(rows) if n % 3 == 0]
    got = defaultdict(list)
    for r in sorted(INV.search(INV.load(spark, index.path), asked, ["claim_id"], 3, F.col("lang") == "de").collect(), key=lambda r: r["rank"]):
        got[r.claim_id].append((r.doc, r.score))
    assert dict(got) == brute_search(claims, german, 3)


def test_index_is_read_not_the_documents(spark):
    df = spark.createDataFrame([(1, "alpha beta beta"), (2, "alpha"), (3, "beta alpha alpha alpha")], "doc_id long, text string")
    index = INV.build(df)
    kw = spark.createDataFrame([(7, 0, "Alpha Beta"), (7, 1, "gamma"), (8, 0, "nothing here")], "doc_id long, kw_idx int, keyword string")
    out = KW.keyword_backoff(kw, index, ((2, 5), (1, 1)))
    assert [(r.claim_id, r.level, r.doc, r.score) for r in out.collect()] == [(7, 1, 3, 4)]
    same = KW.keyword_backoff(kw, df, ((2, 5), (1, 1)))
    assert sorted(map(tuple, same.select("claim_id", "level", "doc", "score").collect())) == [(7, 1, 3, 4)]
    assert INV.search(INV.build(df.limit(0)), kw.select(F.col("doc_id").alias("claim_id"), F.col("keyword").alias("term")), ["claim_id"], 3).collect() == []
