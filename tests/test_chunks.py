"""Chunking (U2/U3), adjacent merge (W1/W2) and the idempotent store append (K3)."""

import pytest
from pyspark.sql import functions as F

from factlens.operators import chunks as C
from tests.conftest import SF_SMALL


def py_chunks(text, size, overlap):
    """Independent restatement of the window rule."""
    if not text:
        return []
    words = text.split()
    out = []
    for i in range(0, len(words), size - overlap):
        out.append(" ".join(words[i:i + size]))
        if i + size >= len(words):
            break
    return out


def _chunk(spark, texts, size, overlap):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = {}
    for r in C.chunk_words(df, ["id"], "text", size, overlap).orderBy("id", "chunk_index").collect():
        got.setdefault(r["id"], []).append(r["content"])
    return [got.get(i, []) for i in range(len(texts))]


def test_golden_windows(spark):
    w = " ".join(f"w{i}" for i in range(10))
    texts = ["", "   \n ", " ".join(f"w{i}" for i in range(4)), " ".join(f"w{i}" for i in range(5)), w]
    assert _chunk(spark, texts, 4, 1) == [py_chunks(t, 4, 1) for t in texts]
    assert _chunk(spark, texts, 4, 0) == [py_chunks(t, 4, 0) for t in texts]
    assert _chunk(spark, [w], 4, 1)[0] == ["w0 w1 w2 w3", "w3 w4 w5 w6", "w6 w7 w8 w9"]


@pytest.mark.parametrize("size,overlap", [(4, 4), (4, 5), (4, -1)])
def test_invalid_overlap(spark, size, overlap):
    df = spark.createDataFrame([(1, "a b")], "id int, text string")
    with pytest.raises(ValueError):
        C.chunk_words(df, ["id"], "text", size, overlap)


def test_documents_equal_python_rule(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    got = {}
    for r in C.chunk_words(docs, ["doc_id"], "text", 64, 8).collect():
        got.setdefault(r["doc_id"], {})[r["chunk_index"]] = r["content"]
    for r in docs.collect():
        exp = py_chunks(r["text"], 64, 8)
        assert [got.get(r["doc_id"], {}).get(i) for i in range(len(exp))] == exp


def test_merging_all_chunks_restores_text(spark):
    """Property: merging every chunk of a document gives back its collapsed text."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    ch = C.chunk_words(docs, ["doc_id"], "text", 64, 8)
    r = ch.select("doc_id", F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("url"), "chunk_index",
                  "content", F.col("chunk_index").alias("rank"), F.lit(1.0).alias("score"))
    merged = {x["doc_id"]: x["text"] for x in C.merge_adjacent(r, ["doc_id"], 8).collect()}
    for d in docs.collect():
        if d["text"].split():
            assert merged[d["doc_id"]] == " ".join(d["text"].split())


def test_merge_golden(spark):
    rows = [  # claim, url, chunk_index, content, rank, score
        (1, "a", 0, "a b c d", 3, 0.1), (1, "a", 1, "c d e f", 1, 0.9), (1, "a", 3, "x y z w", 2, 0.5),
        (1, None, 5, "lost", 4, 0.2),
        (2, "b", 0, "p q r s", 1, 0.4), (2, "b", 1, "r s", 2, 0.4),      # last chunk no longer than overlap
        (3, "c", 7, "only one", 1, 0.3),
    ]
    df = spark.createDataFrame(rows, "claim int, url string, chunk_index int, content string, rank int, score double")
    b = C.merge_adjacent(df, ["claim"], overlap=2)
    got = sorted((r["claim"], r["block_no"], r["text"], r["n_chunks"]) for r in b.collect())
    assert got == [(1, 1, "a b c d e f", 2), (1, 2, "x y z w", 1), (2, 1, "p q r s", 2), (3, 1, "only one", 1)]
    s = {(r["claim"], r["score_rank"]): r["chunk_range"] for r in C.merge_adjacent_scored(b, ["claim"]).collect()}
    assert s[(1, 1)] == "0-1" and s[(1, 2)] == "3-3"


def test_append_is_idempotent(spark, tmp_path):
    arts = spark.createDataFrame([("u1", "one two three"), ("u2", "four five"), ("u1", "one two three")],
                                 "url string, full_content string")
    path = str(tmp_path / "store")
    batch = C.chunk_articles(C.dedupe_articles(arts, ["url"]), 2, 1)
    C.append_chunks(spark, path, batch)
    once = sorted(map(tuple, spark.read.parquet(path).select("chunk_id", "content").collect()))
    C.append_chunks(spark, path, batch)
    twice = sorted(map(tuple, spark.read.parquet(path).select("chunk_id", "content").collect()))
    assert once == twice and len(once) == 3
