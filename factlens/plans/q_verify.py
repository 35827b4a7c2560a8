"""Registered queries: classifier hooks, gates, judge, verdicts, reports and the
flagship end-to-end verification (M3-M11, F3, F5-F9, F11, J2, A12, A14-A17, A19)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from factlens.functions import text as T
from factlens.operators import chunks as C
from factlens.operators import filters as FL
from factlens.operators import ml as ML
from factlens.operators import retrieve as R
from factlens.operators import sentences as SE
from factlens.plans.catalog import register
from factlens.plans.q_chunks import doc_chunks
from factlens.plans.q_retrieval import (CLAIM_LABELS_SQL, MERGE_SQL, RETRIEVAL_SQL, SELECT_SQL, claim_labels,
                                        retrieval, selected_evidence)
from factlens.plans.q_sampling import S as SAMPLING
from factlens.plans.sqlparts import embed_cte, l2sim
from factlens.plans.q_stats import rnd
from factlens.session import ensure_checkpoint_dir
from factlens.sources.tables import Tables, spread

K_VOTE = 5


# ---- classifiers over the driver tables ------------------------------------------------

def _train_docs(spark, sf_dir, label_expr):
    t = Tables(spark, sf_dir)
    return spread(t.labels.join(t.documents.select("doc_id", "text"), "doc_id").select(
        "doc_id", "text", label_expr.alias("label")))


def topic_classifier(spark, sf_dir):
    lab = F.when(F.col("quality") == 1, SE.POLITICAL).otherwise(SE.NON_POLITICAL)
    return ML.LinearClassifier(_train_docs(spark, sf_dir, lab), "text", "label")


def claim_classifier(spark, sf_dir):
    lab = F.when(F.col("toxic") == 0, "claim").otherwise("other")
    return ML.LinearClassifier(_train_docs(spark, sf_dir, lab), "text", "label")


def _topic():
    return F.when(F.col("quality") == 1, SE.POLITICAL).otherwise(SE.NON_POLITICAL)


def topic_voters(spark, sf_dir, exclude_self):
    """The topic classifier by vote: the nearest labelled documents decide."""
    return ML.KnnVoteClassifier(_train_docs(spark, sf_dir, _topic()), "doc_id", "text", "label", K_VOTE, exclude_self=exclude_self)


def document_vectors(spark, sf_dir):
    """Every document embedded once and stored (doc_id, embedding): texts are neither shuffled nor embedded again for the labelled ones."""
    ensure_checkpoint_dir(spark)
    return R.embed_text(Tables(spark, sf_dir).documents.select("doc_id", "text"), "doc_id", "text", ML.DIM).checkpoint(eager=True)


def document_voters(spark, sf_dir, vectors, label_expr, exclude_self):
    """The classifier by vote of the labelled ones of ``document_vectors``."""
    labelled = Tables(spark, sf_dir).labels.join(vectors.where("embedding is not null"), "doc_id").select(F.col("doc_id").alias("id"), "embedding", label_expr.alias("label"))
    return ML.KnnVoteClassifier.from_vectors(labelled.checkpoint(eager=True), "label", K_VOTE, ML.DIM, exclude_self)


TOPIC_TRAIN_SQL = """(SELECT l.doc_id AS id, d.text, CASE WHEN l.quality = 1 THEN 'POLITICAL' ELSE 'NON_POLITICAL' END AS label
                      FROM labels l JOIN documents d USING (doc_id))"""
CLAIM_TRAIN_SQL = """(SELECT l.doc_id AS id, d.text, CASE WHEN l.toxic = 0 THEN 'claim' ELSE 'other' END AS label
                      FROM labels l JOIN documents d USING (doc_id))"""


def linear_sql(train_sql: str, target_sql: str, name: str) -> str:
    """CTE ``{name}`` (id, label, confidence): the default classifier's scores of target rows (id, text)."""
    tokens = f"unnest(string_split_regex(lower(text), '{R.TOKEN_SPLIT_RE}'))"
    bucket = f"('0x' || substr(md5(tok), 1, 8))::BIGINT % {ML.LINEAR_DIM}"
    return f"""
{name}_t AS (SELECT label, {bucket} AS b FROM (SELECT label, {tokens} AS tok FROM {train_sql}) WHERE tok <> ''),
{name}_c AS (SELECT label, count(*) AS total FROM {name}_t GROUP BY label),
{name}_w AS (SELECT label, b, ln((n + 1) / (total + {ML.LINEAR_DIM})) AS w FROM (SELECT label, b, count(*) AS n FROM {name}_t GROUP BY ALL) JOIN {name}_c USING (label)),
{name}_g AS (SELECT id, {bucket} AS b, count(*) AS n FROM (SELECT id, {tokens} AS tok FROM {target_sql}) WHERE tok <> '' GROUP BY ALL),
{name}_s AS (SELECT g.id, c.label, sum(g.n * coalesce(w.w, ln(1 / (c.total + {ML.LINEAR_DIM})))) / sum(g.n) AS s
             FROM {name}_g g CROSS JOIN {name}_c c LEFT JOIN {name}_w w ON w.b = g.b AND w.label = c.label GROUP BY g.id, c.label),
{name} AS (SELECT id, label, confidence FROM (
             SELECT id, label, 1 / sum(exp({ML.SHARPNESS} * (s - m))) OVER (PARTITION BY id) AS confidence, row_number() OVER (PARTITION BY id ORDER BY s DESC, label) AS r
             FROM (SELECT *, max(s) OVER (PARTITION BY id) AS m FROM {name}_s)) WHERE r = 1)"""


def knn_vote_sql(train_sql: str, target_sql: str, name: str, exclude_self: bool, k: int = K_VOTE) -> str:
    """CTE ``{name}`` (id, label, confidence) = k-NN vote of target rows (id, text)."""
    cond = "tg.id <> tr.id" if exclude_self else "true"
    return f"""
{name}_trs AS {train_sql},
{name}_tgs AS {target_sql},
{embed_cte(f'{name}_trs', 'id', 'text', 64, f'{name}_tre')},
{embed_cte(f'{name}_tgs', 'id', 'text', 64, f'{name}_tge')},
{name}_p AS (SELECT tg.id AS qid, tr.id AS item_id, {l2sim('tg.v', 'tr.v')} AS s
             FROM {name}_tge tg JOIN {name}_tre tr ON {cond}),
{name}_r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, item_id) AS rank FROM {name}_p)
             WHERE rank <= {k}),
{name}_v AS (SELECT r.qid, t.label, count(*) AS votes, min(r.rank) AS best FROM {name}_r r JOIN {name}_trs t ON t.id = r.item_id
             GROUP BY r.qid, t.label),
{name} AS (SELECT qid AS id, label, votes / n AS confidence FROM (
             SELECT *, sum(votes) OVER (PARTITION BY qid) AS n,
                    row_number() OVER (PARTITION BY qid ORDER BY votes DESC, best) AS rr FROM {name}_v) WHERE rr = 1)"""


@register("m3_score_batch", sql="WITH " + knn_vote_sql(TOPIC_TRAIN_SQL, "(SELECT doc_id AS id, text FROM documents)",
                                                       "tv", True) + """
SELECT d.doc_id, tv.label, round(tv.confidence, 6) AS confidence FROM documents d LEFT JOIN tv ON tv.id = d.doc_id""")
def m3_score_batch(spark, sf_dir):
    """Every document scored by the vote of its nearest labelled documents (a document never votes for itself)."""
    d = document_vectors(spark, sf_dir)
    s = ML.score_batch(d, "doc_id", "text", document_voters(spark, sf_dir, d, _topic(), True))
    return s.select("doc_id", "label", F.round("confidence", 6).alias("confidence"))


POSTS_TOPIC_SQL = linear_sql(TOPIC_TRAIN_SQL, "(SELECT item_id AS id, text FROM benchmark)", "pt")


@register("f6_topic_gate", sql="WITH " + POSTS_TOPIC_SQL + f"""
SELECT b.item_id AS post_id, pt.label = 'POLITICAL' AS is_political,
       CASE WHEN pt.label = 'POLITICAL' OR (pt.confidence < 0.75 AND length({T.sql_py_strip('b.text')}) >= 5)
            THEN 'POLITICAL' ELSE 'NON_POLITICAL' END AS classification,
       round(pt.confidence, 6) AS confidence
FROM benchmark b JOIN pt ON pt.id = b.item_id""")
def f6_topic_gate(spark, sf_dir):
    b = Tables(spark, sf_dir).benchmark.select(F.col("item_id").alias("post_id"), "text")
    s = ML.score_batch(b, "post_id", "text", topic_classifier(spark, sf_dir)).where(F.col("label").isNotNull())
    s = s.withColumn("status", SE.min_length_status("text"))
    g = SE.topic_gate(s)
    return g.select("post_id", "is_political", "classification", F.round("confidence", 6).alias("confidence"))


def sents_sql(src: str, id_col: str) -> str:
    """(id, post_id, sent_idx, text) of the sentences of ``src`` (id_col, text)."""
    return f"""(SELECT {id_col} || ':' || pos AS id, {id_col} AS post_id, pos AS sent_idx, s AS text FROM (
   SELECT {id_col}, s, CAST(row_number() OVER (PARTITION BY {id_col} ORDER BY p) - 1 AS INTEGER) AS pos FROM (
     SELECT {id_col}, {T.sql_py_strip('s0')} AS s, p FROM (
       SELECT {id_col}, unnest(regexp_split_to_array(text, '{T.SENTENCE_BREAK_RE}')) AS s0,
              unnest(range(len(regexp_split_to_array(text, '{T.SENTENCE_BREAK_RE}')))) AS p FROM {src}))
   WHERE length(s) >= 6))"""


_SENTS_SQL = sents_sql("benchmark", "item_id")


def _post_sentences(spark, sf_dir):
    b = Tables(spark, sf_dir).benchmark.select(F.col("item_id").alias("post_id"), "text")
    s = SE.split_sentences(b, "post_id", "text")
    return s.select(F.concat_ws(":", "post_id", "sent_idx").alias("id"), "post_id", "sent_idx", "text")


@register("f7_claim_gate", sql="WITH sents AS " + _SENTS_SQL + "," + linear_sql(
    CLAIM_TRAIN_SQL, "(SELECT id, text FROM sents)", "cv") + """
SELECT s.post_id, CAST(s.sent_idx AS INTEGER) AS sent_idx, s.text, round(cv.confidence, 6) AS confidence,
       true AS is_factual_claim
FROM sents s JOIN cv ON cv.id = s.id WHERE length(s.text) >= 11 AND (cv.label = 'claim' OR cv.confidence < 0.8)""")
def f7_claim_gate(spark, sf_dir):
    s = _post_sentences(spark, sf_dir)
    scored = ML.score_batch(s, "id", "text", claim_classifier(spark, sf_dir)).where(F.col("label").isNotNull())
    g = SE.claim_gate(scored)
    return g.select("post_id", F.col("sent_idx").cast("int"), "text", F.round("confidence", 6).alias("confidence"),
                    "is_factual_claim")


@register("a12_post_rollup", sql="WITH sents AS " + _SENTS_SQL + "," + knn_vote_sql(
    TOPIC_TRAIN_SQL, "(SELECT item_id AS id, text FROM benchmark)", "pt", False) + "," + knn_vote_sql(
    TOPIC_TRAIN_SQL, "(SELECT id, text FROM sents)", "st", False) + """,
agg AS (SELECT s.post_id, avg(CASE WHEN st.label = 'POLITICAL' THEN 1.0 ELSE 0.0 END) AS ratio, avg(st.confidence) AS mc,
               bool_or(st.label = 'POLITICAL' AND st.confidence > 0.8) AS strong, count(*) AS n
        FROM sents s JOIN st ON st.id = s.id GROUP BY s.post_id)
SELECT pt.id AS post_id, coalesce(agg.ratio > 0.5 OR agg.strong, pt.label = 'POLITICAL') AS is_political,
       round(coalesce(agg.mc, pt.confidence), 6) AS confidence, round(agg.ratio, 6) AS political_ratio,
       coalesce(agg.n, 0) AS n_sentences
FROM pt LEFT JOIN agg ON agg.post_id = pt.id""")
def a12_post_rollup(spark, sf_dir):
    b = Tables(spark, sf_dir).benchmark.select(F.col("item_id").alias("post_id"), "text")
    topic = topic_voters(spark, sf_dir, False)  # embedded once for both
    posts = ML.score_batch(b, "post_id", "text", topic).where(F.col("label").isNotNull())
    s = _post_sentences(spark, sf_dir)
    ss = ML.score_batch(s, "id", "text", topic).where(F.col("label").isNotNull())
    r = SE.post_rollup(ss, posts, "post_id")
    return r.select("post_id", "is_political", F.round("confidence", 6).alias("confidence"),
                    F.round("political_ratio", 6).alias("political_ratio"), "n_sentences")


@register("m5_pseudo_label", sql="WITH " + knn_vote_sql(
    "(SELECT l.doc_id AS id, d.text, 'LABEL_' || CAST(l.quality AS VARCHAR) AS label FROM labels l JOIN documents d USING (doc_id))",
    "(SELECT doc_id AS id, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))", "pl", False) + """
SELECT id AS doc_id, CASE label WHEN 'LABEL_0' THEN 'SUPPORTS' WHEN 'LABEL_1' THEN 'REFUTES'
                                WHEN 'LABEL_2' THEN 'NOT ENOUGH INFO' ELSE label END AS label,
       round(confidence, 6) AS confidence FROM pl WHERE confidence > 0.9995""")
def m5_pseudo_label(spark, sf_dir):
    """Unlabelled documents pseudo-labelled by a model trained on the labelled ones;
    only unanimous (confidence > 0.9995) votes are kept."""
    labels = Tables(spark, sf_dir).labels.select("doc_id", F.concat(F.lit("LABEL_"), F.col("quality").cast("string")).alias("label"), F.lit(True).alias("labelled"))
    docs = document_vectors(spark, sf_dir).join(labels, "doc_id", "left").checkpoint(eager=True)
    train = docs.where("labelled").select(F.col("doc_id").alias("id"), "embedding", "label")
    clf = ML.KnnVoteClassifier.from_vectors(train, "label", K_VOTE, ML.DIM, exclude_self=False)
    p = ML.pseudo_label(docs.where("labelled is null").select("doc_id", "embedding"), "doc_id", "text", clf)
    return p.select("doc_id", "label", F.round("confidence", 6).alias("confidence"))


@register("m6_topic_label", sql="""
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'political' ELSE 'other' END AS topic, 'political' AS constant_topic,
       CASE WHEN doc_id % 2 = 1 THEN 'claim' ELSE 'other' END AS claim_topic FROM documents""")
def m6_topic_label(spark, sf_dir):
    """Three rules: names of the labels (every fifth source is marked as news), a set of one topic, and 1/0 flags."""
    source = F.when(F.col("doc_id") % 5 == 0, F.concat("source", F.lit("_news_room"))).otherwise(F.col("source"))
    d = Tables(spark, sf_dir).documents.select("doc_id", F.array("lang", source).alias("labels"), (F.col("doc_id") % 2).alias("flag"))
    return d.select("doc_id", ML.topic_label("labels").alias("topic"), ML.constant_label().alias("constant_topic"), ML.claim_topic("flag").alias("claim_topic"))


M8_SQL = """
p AS (SELECT a.vec_id AS qid, b.vec_id AS item_id, b.label,
             1 - list_sum(list_transform(list_zip(a.embedding, b.embedding),
                          lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))) AS s
      FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, item_id) AS rank FROM p) WHERE rank <= 5),
v AS (SELECT qid, label, count(*) AS votes, min(rank) AS best FROM r GROUP BY qid, label),
pred AS (SELECT qid AS vec_id, label AS predicted, votes / n AS confidence FROM (
           SELECT *, sum(votes) OVER (PARTITION BY qid) AS n,
                  row_number() OVER (PARTITION BY qid ORDER BY votes DESC, best) AS rr FROM v) WHERE rr = 1),
m8 AS (SELECT e.vec_id, e.label AS actual, p.predicted, p.confidence FROM embeddings e JOIN pred p USING (vec_id))"""


def _m8(spark, sf_dir):
    e = Tables(spark, sf_dir).embeddings
    v = ML.knn_vote(e.select(F.col("vec_id").alias("id"), "embedding", "label"),
                    e.select(F.col("vec_id").alias("id"), "embedding"), K_VOTE, exclude_self=True)
    return e.select("vec_id", F.col("label").alias("actual")).join(
        v.select(F.col("id").alias("vec_id"), F.col("label").alias("predicted"), "confidence"), "vec_id")


@register("m8_judge_vote", sql="WITH " + M8_SQL + """
SELECT vec_id, actual, predicted, round(confidence, 6) AS confidence FROM m8""")
def m8_judge_vote(spark, sf_dir):
    """Each labelled vector judged by the vote of its 5 nearest labelled neighbours."""
    return _m8(spark, sf_dir).select("vec_id", "actual", "predicted", F.round("confidence", 6).alias("confidence"))


@register("a10_multiclass_metrics", sql="WITH " + M8_SQL + f""",
cls AS (SELECT actual AS c FROM m8 UNION SELECT predicted FROM m8),
per AS (SELECT c, (SELECT count(*) FROM m8 WHERE actual = c) AS support, (SELECT count(*) FROM m8 WHERE predicted = c) AS npred,
               (SELECT count(*) FROM m8 WHERE actual = c AND predicted = c) AS tp FROM cls),
mm AS (SELECT *, CASE WHEN npred > 0 THEN tp / npred ELSE 0.0 END AS pr, CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS rc FROM per),
f AS (SELECT *, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END AS f1 FROM mm)
SELECT {rnd('sum(tp) / sum(support)', 6)} AS accuracy, {rnd('sum(pr * support) / sum(support)', 6)} AS precision,
       {rnd('sum(rc * support) / sum(support)', 6)} AS recall, {rnd('sum(f1 * support) / sum(support)', 6)} AS f1,
       CAST(sum(support) AS BIGINT) AS n FROM f""")
def a10_multiclass_metrics(spark, sf_dir):
    from factlens.operators.stats import classification_metrics

    return classification_metrics(_m8(spark, sf_dir), "actual", "predicted")


# ---- retrieval-based verdicts and reports ----------------------------------------------

DOC_LABELS_SQL = """doc_labels AS (SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'SUPPORTS' WHEN toxic = 1 THEN 'REFUTES'
                    ELSE 'NOT ENOUGH INFO' END AS label FROM labels)"""


def evidence_labels(spark, sf_dir, chunks=None):
    """Chunk -> verdict label of its labelled source document (unlabelled ones do not
    vote). ``chunks`` (chunk_id, doc_id) defaults to re-chunking the documents."""
    lab = Tables(spark, sf_dir).labels.select(
        "doc_id", F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "SUPPORTS")
        .when(F.col("toxic") == 1, "REFUTES").otherwise("NOT ENOUGH INFO").alias("label"))
    ch = chunks if chunks is not None else doc_chunks(spark, sf_dir)
    return ch.select("chunk_id", "doc_id").distinct().join(lab, "doc_id").select("chunk_id", "label")


@register("m9_verdict_status", sql="WITH " + RETRIEVAL_SQL + ",\n" + DOC_LABELS_SQL + """,
v0 AS (SELECT r.claim_id, dl.label, count(*) AS votes, min(r.rank) AS best FROM retrieval r
       JOIN doc_labels dl ON 'doc:' || dl.doc_id = r.url GROUP BY ALL),
v AS (SELECT claim_id, label AS verdict, votes / n AS confidence FROM (
        SELECT *, sum(votes) OVER (PARTITION BY claim_id) AS n,
               row_number() OVER (PARTITION BY claim_id ORDER BY votes DESC, best) AS rr FROM v0) WHERE rr = 1),
rc AS (SELECT claim_id, count(*) AS n_rows, count(*) FILTER (WHERE content IS NOT NULL AND content <> '') AS n_text
       FROM retrieval GROUP BY claim_id)
SELECT b.item_id AS claim_id,
       CASE WHEN coalesce(rc.n_rows, 0) = 0 THEN 'NO_EVIDENCE_FOUND'
            WHEN rc.n_text = 0 OR v.verdict IS NULL THEN 'INSUFFICIENT_EVIDENCE' ELSE v.verdict END AS verdict,
       round(CASE WHEN coalesce(rc.n_rows, 0) = 0 OR rc.n_text = 0 OR v.verdict IS NULL THEN 0.0 ELSE v.confidence END, 6)
       AS confidence, coalesce(rc.n_text, 0) AS evidence_count
FROM benchmark b LEFT JOIN rc ON rc.claim_id = b.item_id LEFT JOIN v ON v.claim_id = b.item_id""")
def m9_verdict_status(spark, sf_dir):
    r = retrieval(spark, sf_dir)
    verdicts = ML.judge(r, evidence_labels(spark, sf_dir, r))
    claims = Tables(spark, sf_dir).benchmark.select(F.col("item_id").alias("claim_id"))
    s = ML.verdict_status(claims, r, verdicts)
    return s.select("claim_id", "verdict", F.round("confidence", 6).alias("confidence"), "evidence_count")


def evidence_bundle(r):
    """Evidence texts in rank order, distinct urls in first-seen order, count; hits without text are left out."""
    r = r.where(F.coalesce(F.col("content"), F.lit("")) != "")
    first = r.groupBy("claim_id", "url").agg(F.min("rank").alias("_f"))
    urls = first.groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("_f", "url")))["url"].alias("source_urls"))
    ev = r.groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("rank", "content")))["content"].alias("evidence"),
                                   F.count(F.lit(1)).alias("evidence_count"))
    return ev.join(urls, "claim_id")


@register("a16_evidence_bundle", sql="WITH " + RETRIEVAL_SQL + """,
r0 AS (SELECT claim_id, url, rank, CASE WHEN rank % 4 = 0 THEN '' ELSE content END AS content FROM retrieval),
t AS (SELECT * FROM r0 WHERE content <> ''),
u AS (SELECT claim_id, url, min(rank) AS f FROM t GROUP BY ALL)
SELECT r.claim_id, count(*) AS evidence_count, md5(string_agg(r.content, '\n' ORDER BY r.rank)) AS evidence_md5,
       (SELECT string_agg(url, '|' ORDER BY f) FROM u WHERE u.claim_id = r.claim_id) AS source_urls
FROM t r GROUP BY r.claim_id""")
def a16_evidence_bundle(spark, sf_dir):
    """Every fourth hit loses its text, so that hits without text are met."""
    r = retrieval(spark, sf_dir).withColumn("content", F.when(F.col("rank") % 4 == 0, "").otherwise(F.col("content")))
    b = evidence_bundle(r)
    return b.select("claim_id", "evidence_count", F.md5(F.array_join("evidence", "\n")).alias("evidence_md5"),
                    F.array_join("source_urls", "|").alias("source_urls"))


@register("a14_retrieval_report", sql="WITH " + RETRIEVAL_SQL + ",\n" + CLAIM_LABELS_SQL + """,
per AS (SELECT l.claim_id, l.label, count(r.chunk_id) AS n, max(r.score) AS top, min(r.score) AS low,
               count(DISTINCT r.url) AS pages FROM claim_labels l LEFT JOIN retrieval r USING (claim_id) GROUP BY ALL)
SELECT label, count(*) AS searches, count(*) FILTER (WHERE n > 0) AS successes, count(*) FILTER (WHERE n = 0) AS failures,
       round(100.0 * count(*) FILTER (WHERE n > 0) / count(*), 6) AS success_pct, round(avg(n), 6) AS avg_evidence,
       round(min(low), 6) AS min_similarity, round(max(top), 6) AS max_similarity, round(avg(pages), 6) AS avg_pages
FROM per GROUP BY label""")
def a14_retrieval_report(spark, sf_dir):
    r = retrieval(spark, sf_dir)
    per = claim_labels(spark, sf_dir).join(r, "claim_id", "left").groupBy("claim_id", "label").agg(
        F.count("chunk_id").alias("n"), F.max("score").alias("top"), F.min("score").alias("low"),
        F.countDistinct("url").alias("pages"))
    return per.groupBy("label").agg(
        F.count(F.lit(1)).alias("searches"), F.count_if(F.col("n") > 0).alias("successes"),
        F.count_if(F.col("n") == 0).alias("failures"),
        F.round(100.0 * F.count_if(F.col("n") > 0) / F.count(F.lit(1)), 6).alias("success_pct"),
        F.round(F.avg("n"), 6).alias("avg_evidence"), F.round(F.min("low"), 6).alias("min_similarity"),
        F.round(F.max("top"), 6).alias("max_similarity"), F.round(F.avg("pages"), 6).alias("avg_pages"))


@register("a17_distinct_pages", sql="WITH " + RETRIEVAL_SQL + " SELECT DISTINCT url FROM retrieval")
def a17_distinct_pages(spark, sf_dir):
    return retrieval(spark, sf_dir).select("url").distinct()


@register("a19_page_coverage", sql="WITH " + RETRIEVAL_SQL + """,
u AS (SELECT claim_id, url, min(rank) AS f FROM retrieval GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY f) AS pi FROM u),
store AS (SELECT DISTINCT 'doc:' || CAST(doc_id AS VARCHAR) AS url FROM documents WHERE lang = 'en')
SELECT p.claim_id, count(*) AS checked, count(store.url) AS in_store FROM p LEFT JOIN store USING (url)
WHERE p.pi <= 3 GROUP BY p.claim_id""")
def a19_page_coverage(spark, sf_dir):
    """First three referenced pages of each claim checked against the English store."""
    r = retrieval(spark, sf_dir)
    u = r.groupBy("claim_id", "url").agg(F.min("rank").alias("f"))
    u = u.withColumn("pi", F.row_number().over(Window.partitionBy("claim_id").orderBy("f"))).where("pi <= 3")
    store = Tables(spark, sf_dir).documents.where(F.col("lang") == "en").select(
        F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("url"), F.lit(1).alias("_in")).distinct()
    j = u.join(store, "url", "left")
    return j.groupBy("claim_id").agg(F.count(F.lit(1)).alias("checked"), F.count("_in").alias("in_store"))


@register("m11_build_judge_dataset", sql="WITH " + SELECT_SQL.replace("{min_score}", "0.0") + ",\n" + f"""
ec AS (SELECT claim_id, count(*) AS evidence_count FROM selected GROUP BY claim_id)""" + MERGE_SQL.format(
    g="claim_id", src="selected") + f""",
mev AS (SELECT claim_id, list(text ORDER BY block_no) AS ev FROM merged GROUP BY claim_id),
osp AS (SELECT item_id, unnest(regexp_split_to_array(text, '{T.SENTENCE_BREAK_RE}')) AS s0,
              unnest(range(len(regexp_split_to_array(text, '{T.SENTENCE_BREAK_RE}')))) AS p FROM benchmark),
orig AS (SELECT item_id AS claim_id, list(s ORDER BY p) AS ev FROM (
           SELECT item_id, p, {T.sql_py_strip('s0')} AS s FROM osp) WHERE length(s) >= 6 GROUP BY item_id)
SELECT b.item_id AS claim_id, cl.label, coalesce(ec.evidence_count, 0) AS evidence_count,
       CAST(len(coalesce(mev.ev, orig.ev, [])) AS INTEGER) AS n_evidence,
       md5('[CLS] CLAIM: ' || b.text || ' [SEP] EVIDENCE: ' || array_to_string(coalesce(mev.ev, orig.ev, []), ' ') || ' [SEP]')
       AS model_input_md5
FROM benchmark b JOIN claim_labels cl ON cl.claim_id = b.item_id LEFT JOIN ec ON ec.claim_id = b.item_id
LEFT JOIN mev ON mev.claim_id = b.item_id LEFT JOIN orig ON orig.claim_id = b.item_id""")
def m11_build_judge_dataset(spark, sf_dir):
    """Per labelled claim: multi-query retrieval -> label-aware selection -> adjacent
    merge (falling back to the claim's own evidence sentences) -> model input."""
    sel = selected_evidence(spark, sf_dir)
    ec = sel.groupBy("claim_id").agg(F.count(F.lit(1)).alias("evidence_count"))
    merged = C.merged_evidence(C.merge_adjacent(sel, ["claim_id"], C.LIVE_OVERLAP), ["claim_id"])
    b = Tables(spark, sf_dir).benchmark.select(F.col("item_id").alias("claim_id"), "text")
    orig = b.select("claim_id", SE.sentence_array("text").alias("orig"))
    j = (b.join(claim_labels(spark, sf_dir), "claim_id").join(ec, "claim_id", "left")
         .join(merged, "claim_id", "left").join(orig, "claim_id"))
    ev = F.coalesce("evidence", "orig")
    return j.select("claim_id", "label", F.coalesce("evidence_count", F.lit(0)).alias("evidence_count"),
                    F.size(ev).alias("n_evidence"),
                    F.md5(T.wrap_claim_evidence("text", ev)).alias("model_input_md5"))


# ---- simple filters and joins on the driver tables ------------------------------------------

@register("j2_merge_on_id", sql="""
SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id)""")
def j2_merge_on_id(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "inner")


@register("f5_nonempty_evidence", sql="WITH " + SELECT_SQL.replace("{min_score}", "0.0") + """
SELECT DISTINCT claim_id FROM selected""")
def f5_nonempty_evidence(spark, sf_dir):
    sel = selected_evidence(spark, sf_dir)
    per = sel.groupBy("claim_id").agg(F.collect_list("chunk_id").alias("ev"))
    return FL.nonempty(per, "ev").select("claim_id")


@register("f8_domain_filter", sql=r"""
SELECT page_id, url FROM pages
WHERE (lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) = 'example.com'
       OR ends_with(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)), '.example.com'))
  AND regexp_extract(url, '^[a-z]+://[^/]+/([a-z][a-z])/', 1) = 'en'""")
def f8_domain_filter(spark, sf_dir):
    """Pages on example.com sub-domains whose path language is English."""
    p = Tables(spark, sf_dir).pages.select("page_id", "url").withColumn(
        "language", F.regexp_extract("url", r"^[a-z]+://[^/]+/([a-z][a-z])/", 1))
    return FL.domain_filter(p, "url", include=["example.com"], lang="en").select("page_id", "url")


@register("f9_date_window", sql="""
SELECT event_id, ts FROM events WHERE ts BETWEEN (SELECT max(ts) FROM events) - INTERVAL 30 DAY AND (SELECT max(ts) FROM events)""")
def f9_date_window(spark, sf_dir):
    """Events of the 30 days up to the latest event (the as-of time is explicit)."""
    e = Tables(spark, sf_dir).events
    as_of = e.agg(F.max("ts")).first()[0] or dt.datetime(1970, 1, 1)
    return FL.date_window(e, "ts", as_of, 30).select("event_id", "ts")


@register("f11_rows_of_label", sql="SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def f11_rows_of_label(spark, sf_dir):
    return FL.rows_of_label(Tables(spark, sf_dir).orders, "F", "o_orderstatus").select("o_orderkey", "o_totalprice")


@register("f3_confidence_band", sql="WITH " + linear_sql(TOPIC_TRAIN_SQL, "(SELECT doc_id AS id, text FROM documents)",
                                                          "tv") + """
SELECT id AS doc_id, label FROM tv WHERE confidence > 0.9995""")
def f3_confidence_band(spark, sf_dir):
    d = Tables(spark, sf_dir).documents.select("doc_id", "text")
    s = ML.score_batch(d, "doc_id", "text", topic_classifier(spark, sf_dir))
    return FL.confidence_band(s).select("doc_id", "label")


@register("m4_train_text_classifier")
def m4_train_text_classifier(spark, sf_dir):
    """Logistic regression on hashed TF-IDF fitted on the train split of the labelled
    documents, evaluated on the test split (weighted metrics). The split is written once: each step of the fit reads it anew."""
    from factlens.operators.stats import classification_metrics
    from factlens.session import scratch_path

    t = Tables(spark, sf_dir)
    d = t.labels.join(t.documents.select("doc_id", "text"), "doc_id").select(
        "doc_id", "text", F.when(F.col("quality") == 1, "claim").otherwise("other").alias("label"))
    sp, path = SAMPLING.stratified_split(d, "label", "doc_id", 0.1, 42), scratch_path(spark, "text-split")
    sp.write.partitionBy("split").parquet(path)
    sp = spark.read.schema(sp.schema).parquet(path)
    clf = ML.train_text_classifier(sp.where(F.col("split") == "train"), "text", "label")
    test = sp.where(F.col("split") == "test")
    pred = clf.score(test, "doc_id", "text").join(test.select("doc_id", F.col("label").alias("actual")), "doc_id")
    return classification_metrics(pred, "actual", "label")


RESPONSES_SQL = """,
n AS (SELECT post_id, count(*) AS n FROM claims GROUP BY post_id)
SELECT g.post_id, g.classification = 'POLITICAL' AND g.is_political AS is_political, g.classification = 'POLITICAL' AND coalesce(n.n, 0) > 0 AS success,
       CASE WHEN g.classification <> 'POLITICAL' THEN 'Non political content detected.' WHEN coalesce(n.n, 0) = 0 THEN 'No factual claims detected.' END AS message,
       CAST(CASE WHEN g.classification = 'POLITICAL' THEN coalesce(n.n, 0) ELSE 0 END AS INTEGER) AS n_results
FROM gate g LEFT JOIN n USING (post_id)"""


# ---- flagship -------------------------------------------------------------------------------

# articles come from three channels, by number
CHANNELS = ("news", "index", "wiki")


def article_table(spark, sf_dir):
    """Documents as articles of the evidence loop; the store starts with the English ones."""
    d = Tables(spark, sf_dir).documents
    return d.select(F.col("doc_id").alias("doc"), F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("url"), "lang",
                    F.element_at(F.array(*map(F.lit, CHANNELS)), (F.col("doc_id") % 3 + 1).cast("int")).alias("channel"), F.col("text").alias("full_content"))


def url_labels(spark, sf_dir):
    """Verdict label per article url (unlabelled articles do not vote)."""
    return Tables(spark, sf_dir).labels.select(
        F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("url"),
        F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "SUPPORTS").when(F.col("toxic") == 1, "REFUTES").otherwise("NOT ENOUGH INFO").alias("label"))


def verified_posts(spark, sf_dir):
    from factlens.plans.verify import Articles, verify_posts
    from factlens.session import scratch_path

    t = Tables(spark, sf_dir)
    posts = t.benchmark.select(F.col("item_id").alias("post_id"), "text")
    table = article_table(spark, sf_dir)
    path = scratch_path(spark, "evidence-store")
    start = C.chunk_articles(table.where(F.col("lang") == "en"))
    start = R.embed_text(start, "chunk_id", "content", 64, keep_text=True)
    start.where(F.col("embedding").isNotNull()).write.parquet(f"{path}/version=0")
    return verify_posts(posts, None, url_labels(spark, sf_dir), topic=topic_classifier(spark, sf_dir), claim=claim_classifier(spark, sf_dir),
                        articles=Articles.of(table), store_path=path, version=1)


def flat_response(r):
    """One plain row per post: counts and digests in place of the nested lists."""
    micro = lambda c: F.round(c * 1e6).cast("bigint").cast("string")
    claims = F.transform("extracted_claims", lambda c: F.concat_ws("|", c["text"], micro(c["confidence"])))
    results = F.transform("fact_check_results", lambda x: F.concat_ws("|", x["claim"], x["verdict"], micro(x["confidence"]), x["evidence_count"].cast("string"),
                                                                      F.array_join(x["source_urls"], ",")))
    return r.select("post_id", "is_political", "classification", "success", "message", F.size("extracted_claims").alias("n_claims"),
                    F.md5(F.array_join(claims, "\n")).alias("claims_md5"), F.md5(F.array_join(results, "\n")).alias("results_md5"))


FLAT_SQL = """
ec AS (SELECT post_id, count(*) AS n, string_agg(text || '|' || CAST(round(confidence * 1e6) AS BIGINT), '\n' ORDER BY sent_idx) AS c FROM claims GROUP BY post_id),
fr AS (SELECT post_id, string_agg(text || '|' || verdict || '|' || CAST(round(vconf * 1e6) AS BIGINT) || '|' || evidence_count || '|' || urls, '\n' ORDER BY sent_idx) AS r
       FROM results GROUP BY post_id)
SELECT g.post_id, g.classification = 'POLITICAL' AND g.is_political AS is_political, g.classification, g.classification = 'POLITICAL' AND coalesce(n, 0) > 0 AS success,
       CASE WHEN g.classification <> 'POLITICAL' THEN 'Non political content detected.' WHEN coalesce(n, 0) = 0 THEN 'No factual claims detected.' END AS message,
       CAST(CASE WHEN g.classification = 'POLITICAL' THEN coalesce(n, 0) ELSE 0 END AS INTEGER) AS n_claims,
       md5(CASE WHEN g.classification = 'POLITICAL' THEN coalesce(c, '') ELSE '' END) AS claims_md5,
       md5(CASE WHEN g.classification = 'POLITICAL' THEN coalesce(r, '') ELSE '' END) AS results_md5
FROM gate g LEFT JOIN ec USING (post_id) LEFT JOIN fr USING (post_id)"""


def _claims_sql() -> str:
    """Gates, pronouns and claims of the benchmark posts: CTEs gate and claims."""
    from factlens.plans.q_keywords import coref_ctes

    return f"""WITH {POSTS_TOPIC_SQL},
gate AS (SELECT b.item_id AS post_id, b.text, coalesce(pt.label, 'NON_POLITICAL') = 'POLITICAL' AS is_political,
         CASE WHEN pt.label = 'POLITICAL' OR (coalesce(pt.confidence, 0) < 0.75 AND length({T.sql_py_strip('b.text')}) >= 5) THEN 'POLITICAL' ELSE 'NON_POLITICAL' END AS classification
         FROM benchmark b LEFT JOIN pt ON pt.id = b.item_id),
pol AS (SELECT post_id AS doc_id, text FROM gate WHERE classification = 'POLITICAL'),
{coref_ctes('pol', 'priority', 'r')},
sents AS {sents_sql('r_resolved', 'doc_id')},
{linear_sql(CLAIM_TRAIN_SQL, '(SELECT id, text FROM sents)', 'cv')},
claims AS (SELECT s.id AS claim_id, s.post_id, s.sent_idx, s.text, cv.confidence FROM sents s JOIN cv ON cv.id = s.id
           WHERE length(s.text) >= 11 AND (cv.label = 'claim' OR cv.confidence < 0.8))"""


def _loop_sql() -> str:
    from factlens.operators import keywords as KW
    from factlens.plans.q_keywords import annot_sql, m1_sql
    from factlens.plans.sqlparts import doc_chunks_cte

    levels = ", ".join(f"('{c}', {i}, {n}, {lim})" for c, t in zip(CHANNELS, (KW.NEWS_LEVELS, KW.INDEX_LEVELS, KW.WIKI_LEVELS)) for i, (n, lim) in enumerate(t))
    return f"""{_claims_sql()},
{annot_sql('claims', 'claim_id', 'text', 'k')}{m1_sql('k')},
kd AS (SELECT doc_id AS claim_id, lower(keyword) AS keyword, row_number() OVER (PARTITION BY doc_id ORDER BY min(kw_idx)) - 1 AS kw_idx FROM k_kw GROUP BY doc_id, lower(keyword)),
lv AS (SELECT * FROM (VALUES {levels}) t(channel, level, n_words, lim)),
ct AS (SELECT DISTINCT claim_id, channel, level, term FROM (SELECT claim_id, channel, level, unnest(string_split(keyword, ' ')) AS term FROM kd JOIN lv ON kw_idx < n_words) WHERE term <> ''),
need AS (SELECT claim_id, channel, level, count(*) AS n FROM ct GROUP BY ALL),
dt AS (SELECT doc, channel, term, count(*) AS tf FROM (
         SELECT doc_id AS doc, ['news', 'index', 'wiki'][doc_id % 3 + 1] AS channel, unnest(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS term FROM documents)
       WHERE term IN (SELECT term FROM ct) GROUP BY ALL),
found0 AS (SELECT claim_id, channel, level, doc, count(*) AS m, sum(tf) AS score FROM ct JOIN dt USING (channel, term) GROUP BY ALL),
found1 AS (SELECT f.*, row_number() OVER (PARTITION BY claim_id, channel, level ORDER BY score DESC, doc) AS rank FROM found0 f JOIN need USING (claim_id, channel, level) WHERE m = n),
found2 AS (SELECT f.*, min(level) OVER (PARTITION BY claim_id, channel) AS best FROM found1 f JOIN lv USING (channel, level) WHERE rank <= lim),
{doc_chunks_cte(64, 8, 'every')},
store AS (SELECT * FROM every WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en') OR doc_id IN (SELECT doc FROM found2 WHERE level = best)),
{embed_cte('store', 'chunk_id', 'content', 64, 'ce')},
{embed_cte('claims', 'claim_id', 'text', 64, 'qe')},
p AS (SELECT qe.id AS claim_id, ce.id AS chunk_id, {l2sim('qe.v', 'ce.v')} AS s FROM qe CROSS JOIN ce),
hit AS (SELECT p.claim_id, s.url, s.content, row_number() OVER (PARTITION BY p.claim_id ORDER BY p.s DESC, p.chunk_id) AS rank FROM p JOIN store s USING (chunk_id) QUALIFY rank <= 5),
{DOC_LABELS_SQL},
v0 AS (SELECT h.claim_id, dl.label, count(*) AS votes, min(h.rank) AS best FROM hit h JOIN doc_labels dl ON 'doc:' || dl.doc_id = h.url GROUP BY ALL),
v AS (SELECT claim_id, label AS verdict, votes / n AS confidence FROM (SELECT *, sum(votes) OVER (PARTITION BY claim_id) AS n,
        row_number() OVER (PARTITION BY claim_id ORDER BY votes DESC, best) AS rr FROM v0) WHERE rr = 1),
u AS (SELECT claim_id, string_agg(url, ',' ORDER BY f) AS urls FROM (SELECT claim_id, url, min(rank) AS f FROM hit GROUP BY ALL) GROUP BY claim_id),
rc AS (SELECT claim_id, count(*) AS n_rows FROM hit GROUP BY claim_id),
results AS (SELECT c.*, CASE WHEN n_rows IS NULL THEN 'NO_EVIDENCE_FOUND' WHEN v.verdict IS NULL THEN 'INSUFFICIENT_EVIDENCE' ELSE v.verdict END AS verdict,
            coalesce(v.confidence, 0.0) AS vconf, coalesce(n_rows, 0) AS evidence_count, coalesce(urls, '') AS urls
            FROM claims c LEFT JOIN rc USING (claim_id) LEFT JOIN v USING (claim_id) LEFT JOIN u USING (claim_id)),
{FLAT_SQL}"""


@register("m10_verify_posts", sql=_loop_sql())
def m10_verify_posts(spark, sf_dir):
    """The whole check of the benchmark posts with the evidence loop: the store starts with the English articles, what the
    claims' keywords find in three channels is appended as version 1, and the claims are judged by versions 0 and 1."""
    return flat_response(verified_posts(spark, sf_dir))


@register("m10_gathered_articles", sql=_loop_sql().split("ec AS (SELECT post_id")[0].rstrip().rstrip(",") + """
SELECT claim_id, channel, doc FROM found2 WHERE level = best""")
def m10_gathered_articles(spark, sf_dir):
    """The search half of the loop alone: the articles that every claim sentence of the political posts finds, by channel."""
    from factlens.operators import annotate as AN
    from factlens.operators import coref as CR
    from factlens.plans.verify import Articles, gather_articles

    b = Tables(spark, sf_dir).benchmark.select(F.col("item_id").alias("doc_id"), "text")
    scored = ML.score_batch(b, "doc_id", "text", topic_classifier(spark, sf_dir)).withColumn("status", SE.min_length_status("text"))
    gate = SE.topic_gate(scored.withColumn("confidence", F.coalesce("confidence", F.lit(0.0))).withColumn("label", F.coalesce("label", F.lit(SE.NON_POLITICAL))))
    pol = gate.where(F.col("classification") == SE.POLITICAL).select("doc_id", "text")
    resolved = CR.resolve_pronouns(pol, *AN.annotate(pol))
    s = SE.split_sentences(resolved.select("doc_id", "resolved_text"), "doc_id", "resolved_text").select(F.concat_ws(":", "doc_id", "sent_idx").alias("claim_id"), "text")
    claims = SE.claim_gate(ML.score_batch(s, "claim_id", "text", claim_classifier(spark, sf_dir)).where(F.col("label").isNotNull()))
    return gather_articles(claims, Articles.of(article_table(spark, sf_dir)))


@register("a15_assemble_response", sql="WITH s AS " + _SENTS_SQL + """,
k AS (SELECT *, (post_id * 31 + sent_idx) % 5 AS k FROM s),
gate AS (SELECT item_id AS post_id, text, item_id % 4 <> 1 AS is_political, CASE WHEN item_id % 4 = 0 THEN 'NON_POLITICAL' ELSE 'POLITICAL' END AS classification FROM benchmark),
claims AS (SELECT id AS claim_id, post_id, sent_idx, text, (sent_idx % 4) / 4 AS confidence FROM k WHERE post_id % 4 <> 2),
results AS (SELECT c.*, ['NO_EVIDENCE_FOUND', 'INSUFFICIENT_EVIDENCE', 'ERROR', 'INSUFFICIENT_EVIDENCE', 'SUPPORTS'][k.k + 1] AS verdict,
            CASE WHEN k.k = 4 THEN 0.75 ELSE 0.0 END AS vconf, CASE WHEN k.k IN (3, 4) THEN 2 ELSE 0 END AS evidence_count,
            CASE WHEN k.k IN (0, 2) THEN '' ELSE 'u' || (k.sent_idx % 3) || ',u' || ((k.sent_idx + 1) % 3) END AS urls
            FROM claims c JOIN k ON k.id = c.claim_id),
""" + FLAT_SQL)
def a15_assemble_response(spark, sf_dir):
    """Responses of posts that meet every message and every status: by the number of post and sentence a claim has no hits, hits
    without text, a judge that fails, a judge without a verdict, or a verdict."""
    from factlens.plans.verify import assemble_response, claim_results

    b = Tables(spark, sf_dir).benchmark.select(F.col("item_id").alias("post_id"), "text")
    gate = b.select("post_id", (F.col("post_id") % 4 != 1).alias("is_political"), F.when(F.col("post_id") % 4 == 0, SE.NON_POLITICAL).otherwise(SE.POLITICAL).alias("classification"))
    kind = (F.col("post_id") * 31 + F.col("sent_idx")) % 5
    s = _post_sentences(spark, sf_dir).withColumnRenamed("id", "claim_id").withColumn("k", kind).where(F.col("post_id") % 4 != 2)
    claims = s.withColumn("confidence", (F.col("sent_idx") % 4) / 4).withColumn("is_factual_claim", F.lit(True))
    url = lambda i: F.concat(F.lit("u"), ((F.col("sent_idx") + i) % 3).cast("string"))
    content = F.when(F.col("k") == 1, "").otherwise(F.col("text"))
    hits = claims.where("k <> 0").select("claim_id", F.explode(F.array(*(F.struct(F.lit(i + 1).alias("rank"), url(i).alias("url")) for i in range(2)))).alias("h"), content.alias("content"))
    hits = hits.select("claim_id", "h.*", "content")
    verdicts = claims.where("k >= 2").select("claim_id", F.when(F.col("k") == 4, "SUPPORTS").alias("verdict"), F.lit(0.75).alias("confidence"), (F.col("k") == 2).alias("failed"))
    return flat_response(assemble_response(b, gate, claims, claim_results(claims, hits, verdicts)))


@register("a14_evidence_count_distribution", sql="WITH " + RETRIEVAL_SQL + ",\n" + CLAIM_LABELS_SQL + """,
per AS (SELECT l.claim_id, count(r.chunk_id) AS evidence_count FROM claim_labels l LEFT JOIN retrieval r USING (claim_id)
        GROUP BY l.claim_id)
SELECT evidence_count, count(*) AS claims FROM per GROUP BY evidence_count""")
def a14_evidence_count_distribution(spark, sf_dir):
    """How many claims got 0, 1, 2, ... evidence chunks (part of the retrieval report)."""
    r = retrieval(spark, sf_dir)
    per = claim_labels(spark, sf_dir).join(r, "claim_id", "left").groupBy("claim_id").agg(
        F.count("chunk_id").alias("evidence_count"))
    return per.groupBy("evidence_count").agg(F.count(F.lit(1)).alias("claims"))
