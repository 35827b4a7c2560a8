"""k-NN join equals brute force; multi-query keeps the best score; evidence selection;
keyword AND search equals brute force."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from factlens.operators import keywords as KW
from factlens.operators import retrieve as R
from tests.conftest import SF_SMALL


def test_knn_equals_brute_force(spark):
    e = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    pdf = e.toPandas()
    X = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
    ids = pdf["vec_id"].to_numpy()
    got = {}
    for r in R.knn_join(e, e, k=5, q_id="vec_id", i_id="vec_id", exclude_self=True, i_block=64).collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["item_id"], r["score"]))
    for qi, q in enumerate(X):
        d = ((X - q) ** 2).sum(axis=1)
        order = sorted((-(1 - d[j]), ids[j]) for j in range(len(ids)) if j != qi)[:5]
        mine = sorted(got[ids[qi]])
        assert [m[1] for m in mine] == [o[1] for o in order]
        assert np.allclose([m[2] for m in mine], [-o[0] for o in order], atol=1e-9)


def test_multi_query_best_score_and_selection(spark):
    q = spark.createDataFrame([(1, 0, "claim", [1.0, 0.0]), (1, 1, "evidence", [0.0, 1.0])],
                              "claim_id long, query_idx int, query_type string, embedding array<double>")
    items = spark.createDataFrame([(10, [1.0, 0.0]), (11, [0.0, 1.0]), (12, [0.7071, 0.7071]), (13, [-1.0, 0.0])],
                                  "chunk_id long, embedding array<double>")
    r = R.multi_query_retrieve(q, items, k=2).collect()
    got = {x["chunk_id"]: (x["query_idx"], x["rank"]) for x in r}
    assert got[10] == (0, 1) and got[11] == (1, 2) and 12 in got and 13 not in got
    labels = spark.createDataFrame([(1, "NOT ENOUGH INFO")], "claim_id long, label string")
    sel = R.select_evidence(R.multi_query_retrieve(q, items, k=4), labels, k=2)
    assert sorted(x["chunk_id"] for x in sel.collect()) == [12, 13]   # the two lowest


def test_embed_text_is_unit_norm(spark):
    df = spark.createDataFrame([(1, "Hello hello world"), (2, "   ")], "id long, text string")
    out = {r["id"]: r["embedding"] for r in R.embed_text(df, "id", "text", 16).collect()}
    assert out[2] is None and abs(sum(v * v for v in out[1]) - 1) < 1e-12


def test_keyword_and_search_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    words = ["the", "and", "ouen", "eau"]
    claims = spark.createDataFrame([(1, words[0]), (1, words[1]), (2, words[2]), (2, words[3])],
                                   "claim_id long, term string")
    got = {(r["claim_id"], r["doc"]) for r in KW.keyword_search(claims, docs).collect()}
    import regex
    exp = set()
    for r in docs.collect():
        toks = set(t for t in regex.split(r"[^\p{L}\p{N}]+", r["text"].lower()) if t)
        for cid, ws in ((1, words[:2]), (2, words[2:])):
            if all(w in toks for w in ws):
                exp.add((cid, r["doc_id"]))
    assert got == exp


def test_knn_many_exact_ties(spark):
    """20 identical vectors (more than the candidate margin): ties broken by id."""
    rows = [(i, [1.0, 0.0]) for i in range(20)] + [(100, [0.0, 1.0]), (101, [0.6, 0.8])]
    items = spark.createDataFrame(rows, "item_id long, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "qid long, embedding array<double>")
    got = {}
    for r in R.knn_join(q, items, k=12).collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["item_id"]))
    assert [i for _, i in sorted(got[1])] == list(range(12))
    assert [i for _, i in sorted(got[2])][:2] == [100, 101]


def test_keyword_search_scope(spark):
    """Domains, language and dates narrow what is searched."""
    docs = spark.createDataFrame([
        (1, "tax vote", "https://a.example/1", "English", "2024-05-20"),
        (2, "tax vote", "https://news.a.example/2", "English", "2024-05-20"),
        (3, "tax vote", "https://b.example/3", "English", "2024-05-20"),
        (4, "tax vote", "https://a.example/4", "Spanish", "2024-05-20"),
        (5, "tax vote", "https://a.example/5", "English", "2024-01-01"),
        (6, "tax", "https://a.example/6", "English", "2024-05-20"),
    ], "doc_id long, text string, url string, language string, day string").withColumn("published_at", F.to_timestamp("day"))
    terms = spark.createDataFrame([(7, "tax"), (7, "Vote")], "claim_id long, term string")

    def found(**kw):
        return sorted(r["doc"] for r in KW.keyword_search(terms, docs, **kw).collect())

    assert found() == [1, 2, 3, 4, 5]
    assert found(include=["a.example"], lang="English", as_of=dt.datetime(2024, 6, 1)) == [1, 2]
    assert found(exclude=["a.example"]) == [3]
