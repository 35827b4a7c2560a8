"""Registered queries: embeddings, k-NN, multi-query retrieval, evidence selection and
chunk merging (M7, J5, J6, W3, L1, W1, W2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from factlens.operators import chunks as C
from factlens.operators import retrieve as R
from factlens.operators.sentences import split_sentences
from factlens.plans.catalog import register
from factlens.plans.q_chunks import doc_chunks
from factlens.plans.sqlparts import doc_chunks_cte, embed_cte, l2sim
from factlens.functions.text import SENTENCE_BREAK_RE, sql_py_strip
from factlens.session import ensure_checkpoint_dir
from factlens.sources.tables import Tables

DIM = 64
K = 10


# ---- shared Spark building blocks -------------------------------------------------

def claim_labels(spark, sf_dir):
    """Stand-in verdict label per benchmark claim, from the labels table."""
    t = Tables(spark, sf_dir)
    lab = t.labels.select(F.col("doc_id").alias("claim_id"), "quality", "toxic")
    return t.benchmark.select(F.col("item_id").alias("claim_id")).join(lab, "claim_id", "left").select(
        "claim_id",
        F.when(F.col("quality").isNull(), "NOT ENOUGH INFO")
        .when((F.col("quality") == 1) & (F.col("toxic") == 0), "SUPPORTS")
        .otherwise("REFUTES").alias("label"))


def vector_store(spark, sf_dir):
    """The chunk store with its vectors (what an ingest job maintains), built once
    per query and checkpointed so retrieval, metadata and labels read it back
    instead of re-chunking and re-embedding."""
    ensure_checkpoint_dir(spark)
    ch = doc_chunks(spark, sf_dir)
    store = R.embed_text(ch, "chunk_id", "content", DIM, keep_text=True).checkpoint(eager=True)
    return store.where(F.col("embedding").isNotNull())


def chunk_vectors(spark, sf_dir, store=None):
    return (store if store is not None else vector_store(spark, sf_dir)).select("chunk_id", "embedding")


def claim_queries(spark, sf_dir):
    """Query 0 is the claim; queries 1.. are its sentences (the evidence list)."""
    b = Tables(spark, sf_dir).benchmark.select(F.col("item_id").alias("claim_id"), "text")
    claim = b.select("claim_id", F.lit(0).alias("query_idx"), F.lit("claim").alias("query_type"), "text")
    sents = split_sentences(b, "claim_id", "text").select(
        "claim_id", (F.col("sent_idx") + 1).alias("query_idx"), F.lit("evidence").alias("query_type"), "text")
    q = claim.unionByName(sents)
    return R.embed_text(q, "claim_id", "text", DIM)


def retrieval(spark, sf_dir, k=K):
    """J6 result joined back to chunk metadata: claim_id, chunk_id, url, chunk_index,
    content, score, query_idx, query_type, rank."""
    store = vector_store(spark, sf_dir)
    hits = R.multi_query_retrieve(claim_queries(spark, sf_dir), chunk_vectors(spark, sf_dir, store), k=k,
                                  items_materialized=True)
    # read by several consumers (selection, merge, judge, reports): run the k-NN once
    return hits.join(store.select("chunk_id", "doc_id", "url", "chunk_index", "content"),
                     "chunk_id").checkpoint(eager=True)


# ---- shared SQL -----------------------------------------------------------------------

CLAIM_LABELS_SQL = """claim_labels AS (
  SELECT b.item_id AS claim_id, CASE WHEN l.quality IS NULL THEN 'NOT ENOUGH INFO'
         WHEN l.quality = 1 AND l.toxic = 0 THEN 'SUPPORTS' ELSE 'REFUTES' END AS label
  FROM benchmark b LEFT JOIN labels l ON l.doc_id = b.item_id)"""

_STRIP = sql_py_strip("s")
QUERIES_SQL = f"""
sp AS (SELECT item_id AS claim_id, unnest(regexp_split_to_array(text, '{SENTENCE_BREAK_RE}')) AS s,
              unnest(range(len(regexp_split_to_array(text, '{SENTENCE_BREAK_RE}')))) AS pos FROM benchmark),
sk AS (SELECT claim_id, pos, {_STRIP} AS s FROM sp),
sents AS (SELECT claim_id, CAST(row_number() OVER (PARTITION BY claim_id ORDER BY pos) AS INTEGER) AS query_idx,
                 s AS text FROM sk WHERE length(s) >= 6),
q AS (SELECT claim_id, 0 AS query_idx, 'claim' AS query_type, text FROM benchmark b(claim_id, text)
      UNION ALL SELECT claim_id, query_idx, 'evidence', text FROM sents),
qk AS (SELECT claim_id * 1048576 + query_idx AS qkey, * FROM q),
{embed_cte('qk', 'qkey', 'text', DIM, 'qe')},
{doc_chunks_cte(64, 8)},
{embed_cte('chunks', 'chunk_id', 'content', DIM, 'ce')}"""

RETRIEVAL_SQL = QUERIES_SQL + f""",
pairs AS (SELECT qk.claim_id, qk.query_idx, qk.query_type, ce.id AS chunk_id, {l2sim('qe.v', 'ce.v')} AS score
          FROM qe JOIN qk ON qk.qkey = qe.id CROSS JOIN ce),
per_q AS (SELECT *, row_number() OVER (PARTITION BY claim_id, query_idx ORDER BY score DESC, chunk_id) AS r FROM pairs),
best AS (SELECT *, row_number() OVER (PARTITION BY claim_id, chunk_id ORDER BY score DESC, query_idx) AS b
         FROM per_q WHERE r <= {K}),
retrieval AS (SELECT b.claim_id, b.chunk_id, b.score, CAST(b.query_idx AS INTEGER) AS query_idx, b.query_type,
                     CAST(row_number() OVER (PARTITION BY b.claim_id ORDER BY b.score DESC, b.chunk_id) AS INTEGER) AS rank,
                     c.url, c.chunk_index, c.content
              FROM best b JOIN chunks c ON c.chunk_id = b.chunk_id WHERE b.b = 1)"""


# ---- queries -------------------------------------------------------------------------

def _vec_digest(col):
    return F.md5(F.array_join(F.transform(col, lambda x: F.round(x * 1e6).cast("bigint").cast("string")), ","))


@register("m7_embed_text", sql="WITH " + embed_cte("benchmark", "item_id", "text", DIM, "e") + """
SELECT id AS item_id, CAST(len(list_filter(v, lambda x: x > 0)) AS INTEGER) AS n_nonzero,
       md5(array_to_string(list_transform(v, lambda x: CAST(round(x * 1e6) AS BIGINT)), ',')) AS vec_md5
FROM e""")
def m7_embed_text(spark, sf_dir):
    b = Tables(spark, sf_dir).benchmark
    e = R.embed_text(b, "item_id", "text", DIM).where(F.col("embedding").isNotNull())
    return e.select("item_id", F.size(F.filter("embedding", lambda x: x > 0)).alias("n_nonzero"),
                    _vec_digest(F.col("embedding")).alias("vec_md5"))


@register("j5_knn_join", sql="""
WITH p AS (SELECT a.vec_id AS qid, b.vec_id AS item_id,
                  1 - list_sum(list_transform(list_zip(a.embedding, b.embedding),
                               lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))) AS s
           FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
r AS (SELECT qid, item_id, s, row_number() OVER (PARTITION BY qid ORDER BY s DESC, item_id) AS rank FROM p)
SELECT qid, item_id, round(s, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def j5_knn_join(spark, sf_dir):
    """Every embedding against all others (self excluded): 5 nearest by 1 - squared L2."""
    e = Tables(spark, sf_dir).embeddings
    res = R.knn_join(e, e, k=5, q_id="vec_id", i_id="vec_id", exclude_self=True)
    return res.select("qid", "item_id", F.round("score", 6).alias("score"), "rank")


@register("j5_knn_text", sql="WITH " + embed_cte("benchmark", "item_id", "text", DIM, "qe") + "," +
          doc_chunks_cte(64, 8) + "," + embed_cte("chunks", "chunk_id", "content", DIM, "ce") + f""",
p AS (SELECT qe.id AS qid, ce.id AS item_id, {l2sim('qe.v', 'ce.v')} AS s FROM qe CROSS JOIN ce),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, item_id) AS rank FROM p)
SELECT qid, item_id, round(s, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def j5_knn_text(spark, sf_dir):
    """Benchmark claims against all document chunks (64/8): 5 nearest."""
    q = R.embed_text(Tables(spark, sf_dir).benchmark, "item_id", "text", DIM)
    res = R.knn_join(q, chunk_vectors(spark, sf_dir), k=5, q_id="item_id", i_id="chunk_id")
    return res.select("qid", "item_id", F.round("score", 6).alias("score"), "rank")


@register("j6_multi_query_retrieve", sql="WITH " + RETRIEVAL_SQL + """
SELECT claim_id, chunk_id, round(score, 6) AS score, query_idx, query_type, rank FROM retrieval""")
def j6_multi_query_retrieve(spark, sf_dir):
    r = R.multi_query_retrieve(claim_queries(spark, sf_dir), chunk_vectors(spark, sf_dir), k=K)
    return r.select("claim_id", "chunk_id", F.round("score", 6).alias("score"),
                    F.col("query_idx").cast("int").alias("query_idx"), "query_type", F.col("rank").cast("int"))


@register("w3_top_k_per_claim", sql="WITH " + RETRIEVAL_SQL + """
SELECT claim_id, chunk_id, round(score, 6) AS score, rank FROM retrieval WHERE rank <= 3""")
def w3_top_k_per_claim(spark, sf_dir):
    r = R.multi_query_retrieve(claim_queries(spark, sf_dir), chunk_vectors(spark, sf_dir), k=K)
    top = R.top_k_per_group(r.drop("rank"), ["claim_id"], "score", "chunk_id", 3)
    return top.select("claim_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("int"))


SELECT_SQL = RETRIEVAL_SQL + """,
""" + CLAIM_LABELS_SQL + """,
rl AS (SELECT r.*, l.label, count(*) OVER (PARTITION BY r.claim_id) AS n,
              row_number() OVER (PARTITION BY r.claim_id, r.score > {min_score} ORDER BY r.rank) AS pos_rank
       FROM retrieval r JOIN claim_labels l USING (claim_id)),
selected AS (SELECT * FROM rl WHERE CASE WHEN label IN ('SUPPORTS', 'REFUTES') THEN score > {min_score} AND pos_rank <= 5
                                   WHEN label = 'NOT ENOUGH INFO' THEN rank > n - 5 ELSE rank <= 5 END)"""

MIN_SCORE = 0.0


def selected_evidence(spark, sf_dir):
    return R.select_evidence(retrieval(spark, sf_dir), claim_labels(spark, sf_dir), k=5, min_score=MIN_SCORE)


@register("l1_select_evidence", sql="WITH " + SELECT_SQL.replace("{min_score}", repr(MIN_SCORE)) + """
SELECT claim_id, label, chunk_id, round(score, 6) AS score, rank FROM selected""")
def l1_select_evidence(spark, sf_dir):
    s = selected_evidence(spark, sf_dir)
    return s.select("claim_id", "label", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("int"))


MERGE_SQL = """,
rr AS (SELECT *, chunk_index - row_number() OVER (PARTITION BY {g}, url ORDER BY chunk_index, rank) AS isl,
              min(rank) OVER (PARTITION BY {g}, url) AS url_first FROM {src} WHERE url IS NOT NULL),
rp AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY {g}, url, isl ORDER BY chunk_index, rank) = 1 THEN content
                      WHEN len(string_split(content, ' ')) > 8
                      THEN array_to_string(list_slice(string_split(content, ' '), 9, 1073741824), ' ') END AS piece
       FROM rr),
blocks AS (SELECT {g}, url, isl, min(chunk_index) AS start_index, max(chunk_index) AS end_index, count(*) AS n_chunks,
                  max(score) AS max_score, min(rank) AS first_rank, min(url_first) AS url_first,
                  array_to_string(list(piece ORDER BY chunk_index, rank) FILTER (WHERE piece IS NOT NULL), ' ') AS text
           FROM rp GROUP BY {g}, url, isl),
merged AS (SELECT {g}, CAST(row_number() OVER (PARTITION BY {g} ORDER BY url_first, start_index) AS INTEGER) AS block_no,
                  url, start_index, end_index, n_chunks, max_score, first_rank, text FROM blocks)"""


@register("w1_merge_adjacent", sql="WITH " + RETRIEVAL_SQL + MERGE_SQL.format(g="claim_id", src="retrieval") + """
SELECT claim_id, block_no, url, start_index, end_index, n_chunks, round(max_score, 6) AS max_score, text FROM merged""")
def w1_merge_adjacent(spark, sf_dir):
    b = C.merge_adjacent(retrieval(spark, sf_dir), ["claim_id"], overlap=C.LIVE_OVERLAP)
    return b.select("claim_id", F.col("block_no").cast("int"), "url", "start_index", "end_index", "n_chunks",
                    F.round("max_score", 6).alias("max_score"), "text")


@register("w2_merge_adjacent_scored", sql="WITH " + RETRIEVAL_SQL + MERGE_SQL.format(g="claim_id", src="retrieval") + """
SELECT claim_id, CAST(row_number() OVER (PARTITION BY claim_id ORDER BY max_score DESC, block_no) AS INTEGER) AS score_rank,
       url, CAST(start_index AS VARCHAR) || '-' || CAST(end_index AS VARCHAR) AS chunk_range, n_chunks,
       round(max_score, 6) AS max_score, md5(text) AS text_md5 FROM merged""")
def w2_merge_adjacent_scored(spark, sf_dir):
    b = C.merge_adjacent(retrieval(spark, sf_dir), ["claim_id"], overlap=C.LIVE_OVERLAP)
    s = C.merge_adjacent_scored(b, ["claim_id"])
    return s.select("claim_id", F.col("score_rank").cast("int"), "url", "chunk_range", "n_chunks",
                    F.round("max_score", 6).alias("max_score"), F.md5("text").alias("text_md5"))
