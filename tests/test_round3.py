"""Findings of the third round: inputs on which a query failed, and memory that grew with the input."""

import tracemalloc

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from factlens.operators import pivots as P
from factlens.operators import retrieve as R
from factlens.plans import q_evidence as QE


def _peak_mb(fn):
    """What ``fn`` returns and the MB that it held at most."""
    tracemalloc.start()
    out = fn()
    mb = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return out, mb


def test_evidence_claims_of_documents_without_a_sentence(spark, tmp_path):
    docs = [(1, "A first sentence here. And a second one.", "en"), (2, "ab", "en"), (3, "", "de"), (4, None, "es")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(1, 5)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    claims = {r.id: r.claim for r in QE.raw_claims(spark, str(tmp_path)).collect()}
    assert claims == {1: "A first sentence here", 2: None, 3: None, 4: None}
    refs = QE.s4_read_evidence_jsonl(spark, str(tmp_path)).groupBy("id").agg(F.count(F.lit(1)).alias("n")).collect()
    assert {r.id: r.n for r in refs} == {1: 3, 2: 3, 3: 3, 4: 3}


def _is_a_vote(rows, k=5):
    """Confidences are shares of k votes (the linear classifier's are not)."""
    return bool(rows) and all(abs(r.confidence * k - round(r.confidence * k)) < 1e-5 for r in rows if r.confidence is not None)


def test_documents_are_scored_by_their_nearest_neighbours(spark):
    from factlens.plans import q_verify as QV

    assert _is_a_vote(QV.m3_score_batch(spark, "/root/testdata/sf0.001").collect())


def test_posts_and_sentences_are_scored_by_their_nearest_neighbours(spark):
    from factlens.plans import q_verify as QV

    rows = QV.a12_post_rollup(spark, "/root/testdata/sf0.001").collect()
    assert rows and all(abs(r.confidence * 5 * max(r.n_sentences, 1) - round(r.confidence * 5 * max(r.n_sentences, 1))) < 1e-3 for r in rows)


def test_pseudo_labels_are_unanimous_votes(spark):
    from factlens.plans import q_verify as QV

    rows = QV.m5_pseudo_label(spark, "/root/testdata/sf0.01").collect()
    assert rows and _is_a_vote(rows) and {r.confidence for r in rows} == {1.0}


def test_knn_tasks_hold_a_bounded_number_of_distances():
    rng = np.random.default_rng(0)
    X, Q = rng.random((R.I_BLOCK, 8)), rng.random((1024, 8))
    (q, i, s), mb = _peak_mb(lambda: R._tile_topk(np.arange(len(Q)), Q, np.arange(len(X)), X, 5, "l2sq", False))
    assert mb < 120 and len(q) == 5 * len(Q)
    want = np.argsort(((X - Q[7]) ** 2).sum(axis=1), kind="stable")[:5]
    assert sorted(i[q == 7].tolist()) == sorted(want.tolist())
    n = 1024
    ones, far = np.ones(n, dtype=np.int64), np.full((n, P.NEAR), np.inf)
    geometry = P.Geometry(rng.random((n, 8)), ones * 0.0, ones * 1.0, far, ones, np.arange(n) // 8, ones)
    (row, block), mb = _peak_mb(lambda: geometry.blocks(np.ones((P.ROWS, n), dtype=bool)))
    assert mb < 20 and len(row) == P.ROWS * n // 8 and sorted(set(block.tolist())) == list(range(n // 8))


def test_texts_are_embedded_in_slices():
    texts = pd.Series([None, "", *(f"Word{i} and more words " * 500 for i in range(800)), "Last one"])
    got, mb = _peak_mb(lambda: R._embed_batch(texts, 64))
    assert mb < 60 and len(got) == len(texts) and got[0] is None and got[1] is None
    assert all(np.array_equal(got[i], R._embed_slice(texts.iloc[[i]], 64)[0]) for i in (2, 400, 802))
    assert [len(t) for t in R.text_slices(pd.Series(["ab", "c", "defgh", None, "i"]), 3)] == [2, 1, 2]
    assert [len(t) for t in R.text_slices(pd.Series([], dtype=object))] == [0]


def test_tokens_are_annotated_in_slices():
    import pyarrow as pa

    from factlens.operators import annotate as AN

    words = [["The", "Big", "Bank", "is", "here", "."] * 2000] * 60 + [None, []]
    gaps = [None if w is None else [0] + [1] * len(w) for w in words]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(words))), pa.array(words), pa.array(gaps)], names=["doc_id", "t", "g"])
    out = list(AN._annotations(iter([batch])))
    assert max(len(b.column(1).flatten()) for b in out) <= AN.SLICE_TOKENS
    rows = [r for b in out for r in b.to_pylist()]
    assert [r["doc_id"] for r in rows] == list(range(len(words))) and all(r["toks"] == rows[0]["toks"] and r["ents"] == rows[0]["ents"] for r in rows[:60])
    assert rows[60]["toks"] == rows[61]["toks"] == []


def test_a_session_sends_bounded_batches_of_texts(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        R.embed_text(spark.createDataFrame([(1, "a b")], "id int, text string"), "id", "text")
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == R.BATCH_ROWS
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_the_linear_classifier_counts_in_slices(spark):
    from factlens.operators import ml as ML

    rows = [(i, f"tax vote senate number{i} " * 400 if i % 2 else f"cat dog garden number{i} " * 400, "a" if i % 2 else "b") for i in range(300)] + [(300, None, "a"), (301, "tax cat", None)]
    df = spark.createDataFrame(rows, "id int, text string, label string").coalesce(1)
    assert sum(len(r[1] or "") for r in rows) > 4 * R.SLICE_CHARS  # several slices
    clf = ML.LinearClassifier(df, "text", "label")
    labels, weights = clf.model
    assert labels == ["a", "b"]
    n = np.zeros((ML.LINEAR_DIM, 2))
    for _, text, label in rows:
        if text and label:
            _, bucket = ML._token_buckets(pd.Series([text]), ML.LINEAR_DIM)
            np.add.at(n[:, labels.index(label)], bucket, 1)
    assert np.allclose(weights, np.log((n + 1) / (n.sum(axis=0) + ML.LINEAR_DIM)))
    got = {r.id: r.label for r in clf.score(df, "id", "text").collect()}
    assert got[300] is None and all(got[i] == ("a" if i % 2 else "b") for i in range(300))


def test_a_feed_of_several_files_a_range_gives_the_same_stream(spark, monkeypatch):
    from factlens.plans import q_streaming as QS

    sf = "/root/testdata/sf0.01"
    want = sorted(QS.x3_trending_stream(spark, sf).collect())
    writes, feed = [], QS._feed
    monkeypatch.setattr(QS, "_feed", lambda table, part, path, files: writes.append((files, path)) or feed(table, part, path, files))
    monkeypatch.setattr(QS, "FILE_BYTES", QS._bytes(spark, f"{sf}/events.parquet") // 12)
    assert sorted(QS.x3_trending_stream(spark, sf).collect()) == want
    files, path = writes[-1]
    assert files > 1 and len(QS._list_files(spark, path, "part-")) == files * QS.BATCHES
    monkeypatch.setattr(QS, "FILE_BYTES", max(1, QS._bytes(spark, "/root/testdata/sf0.001/pages.parquet") // 400))  # more files than rows
    assert QS._stream(spark, "/root/testdata/sf0.001", "pages", "page_id").isStreaming
    files, path = writes[-1]
    assert spark.read.parquet(path).count() == spark.read.parquet("/root/testdata/sf0.001/pages.parquet").count()


def test_a_tile_is_scored_in_one_array():
    rng = np.random.default_rng(1)
    X, Q = rng.random((R.I_BLOCK, 16)), rng.random((128, 16))
    X[900:940], Q[3] = X[900], X[900]  # more equal items than candidates
    for metric in ("l2sq", "cosine", "ip"):
        (q, i, s), mb = _peak_mb(lambda: R._tile_topk(np.arange(len(Q)), Q, np.arange(len(X)), X, 5, metric, True))  # noqa: B023
        assert mb < 50 and len(q) == 5 * len(Q)
        norms = np.linalg.norm(X, axis=1)
        for n in (0, 3, 77):
            sims = {"l2sq": 1 - ((X - Q[n]) ** 2).sum(axis=1), "ip": X @ Q[n], "cosine": X @ Q[n] / (norms * np.linalg.norm(Q[n]))}[metric]
            sims[n] = -np.inf
            assert np.allclose(np.sort(sims)[::-1][:5], s[q == n]) and (n != 3 or metric != "l2sq" or i[q == n].tolist() == list(range(900, 905)))
    wide = np.repeat(X, 8, axis=1)
    v = pd.Series(list(wide))
    m, mb = _peak_mb(lambda: P._matrix(v))
    assert np.array_equal(m, wide) and mb < 1.6 * wide.nbytes / 1e6


def test_a_text_classifier_scores_in_a_session_that_has_observed(spark):
    from pyspark.sql import Observation

    from factlens.operators import ml as ML

    rows = [(i, "tax vote senate" if i % 2 else "cat dog garden", "a" if i % 2 else "b") for i in range(12)]
    df = spark.createDataFrame(rows, "id int, text string, label string")
    seen = Observation("seen")  # from now on the session holds what cannot be sent to a task
    df.observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get == {"n": 12}
    clf = ML.train_text_classifier(df, "text", "label")
    assert {r.id: r.label for r in clf.score(df, "id", "text").collect()} == {i: label for i, _, label in rows}
    assert clf.labels == ["a", "b"]


def test_a_text_classifier_is_fitted_on_a_split_written_once(spark):
    from factlens.plans import q_verify as QV

    out = QV.m4_train_text_classifier(spark, "/root/testdata/sf0.001")
    read = out.inputFiles()
    assert read and all("text-split" in f for f in read)  # no join with the whole documents is left
    row = out.first()
    assert (row.accuracy, row.precision, row.recall, row.f1, row.n) == (0.875, 0.765625, 0.875, 0.816667, 8)  # as with the joined tables


def test_a_text_classifier_takes_null_texts(spark):
    from factlens.operators import ml as ML

    rows = [(i, "tax vote senate" if i % 2 else "cat dog garden", "a" if i % 2 else "b") for i in range(12)]
    df = spark.createDataFrame(rows + [(12, None, "a"), (13, "", "a")], "id int, text string, label string")
    got = {r.id: (r.label, r.confidence) for r in ML.train_text_classifier(df, "text", "label").score(df, "id", "text").collect()}
    assert len(got) == 14 and got[12] == got[13] and all(got[i][0] == label for i, _, label in rows)
