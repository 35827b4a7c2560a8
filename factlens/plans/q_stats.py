"""Registered queries: profiles and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from factlens.functions import text as T
from factlens.operators import stats as ST
from factlens.plans.catalog import register
from factlens.plans.q_chunks import ARTICLES_SQL, articles
from factlens.sources.tables import Tables


def rnd(x: str, d: int) -> str:
    """Spark rounds the shortest decimal form of a double half-up; so does this."""
    return f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 12)), {d}) AS DOUBLE)"


def _len_stats_sql(src: str, by: list[str]) -> str:
    g = ", ".join(by)
    gsel = (g + ", ") if by else ""
    part = f"PARTITION BY {g}" if by else ""
    join = f"USING ({g})" if by else "ON true"
    grp = f"GROUP BY {g}" if by else ""
    return f"""
WITH s AS ({src}),
mc AS (SELECT {gsel}x, count(*) AS c FROM s GROUP BY {gsel}x),
md AS (SELECT {gsel}x AS mode FROM (SELECT *, row_number() OVER ({part} ORDER BY c DESC, x) AS r FROM mc) WHERE r = 1),
a AS (SELECT {gsel}count(*) AS n, avg(x::DOUBLE) AS mean, quantile_cont(x::DOUBLE, [0.5, 0.25, 0.75, 0.9, 0.95]) AS p,
             stddev_samp(x::DOUBLE) AS std, min(x) AS min, max(x) AS max FROM s {grp})
SELECT {gsel}n, {rnd('mean', 2)} AS mean, {rnd('p[1]', 2)} AS median, mode, {rnd('std', 2)} AS std,
       {rnd('p[2]', 2)} AS p25, {rnd('p[3]', 2)} AS p75, {rnd('p[4]', 2)} AS p90, {rnd('p[5]', 2)} AS p95, min, max
FROM a JOIN md {join}"""


@register("a1_value_counts", sql="SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def a1_value_counts(spark, sf_dir):
    return ST.value_counts(Tables(spark, sf_dir).events, "event_type")


@register("a2_text_length_stats", sql=_len_stats_sql("SELECT CAST(length(text) AS BIGINT) AS x FROM documents", []))
def a2_text_length_stats(spark, sf_dir):
    d = Tables(spark, sf_dir).documents.select(F.char_length("text").cast("bigint").alias("x"))
    return ST.length_stats(d, "x")


@register("a3_length_stats_by_label", sql=_len_stats_sql(
    "SELECT unnest([lang, source]) AS label, CAST(length(text) AS BIGINT) AS x FROM documents", ["label"]))
def a3_length_stats_by_label(spark, sf_dir):
    """Two labels per document (language and source), exploded, stats per label."""
    d = Tables(spark, sf_dir).documents.select(F.explode(F.array("lang", "source")).alias("label"),
                                               F.char_length("text").cast("bigint").alias("x"))
    return ST.length_stats(d, "x", ["label"])


@register("a4_token_profile", sql=f"""
WITH t AS (SELECT CAST(len({T.sql_words('text')}) AS BIGINT) AS n FROM documents),
a AS (SELECT count(*) AS count, avg(n::DOUBLE) AS mean, stddev_pop(n::DOUBLE) AS std, min(n) AS min, max(n) AS max,
             quantile_cont(n::DOUBLE, [0.25, 0.5, 0.75, 0.9, 0.95, 0.99]) AS p,
             avg(CASE WHEN n > 256 THEN 1.0 ELSE 0.0 END) AS o256, avg(CASE WHEN n > 512 THEN 1.0 ELSE 0.0 END) AS o512,
             avg(CASE WHEN n > 768 THEN 1.0 ELSE 0.0 END) AS o768, avg(CASE WHEN n > 1024 THEN 1.0 ELSE 0.0 END) AS o1024,
             avg(CASE WHEN n > 2048 THEN 1.0 ELSE 0.0 END) AS o2048 FROM t)
SELECT count, {rnd('mean', 6)} AS mean, {rnd('p[2]', 6)} AS median, {rnd('std', 6)} AS std, min, max,
       {rnd('p[1]', 6)} AS p25, {rnd('p[2]', 6)} AS p50, {rnd('p[3]', 6)} AS p75, {rnd('p[4]', 6)} AS p90,
       {rnd('p[5]', 6)} AS p95, {rnd('p[6]', 6)} AS p99,
       {rnd('o256 * 100', 6)} AS pct_over_256, {rnd('o512 * 100', 6)} AS pct_over_512, {rnd('o768 * 100', 6)} AS pct_over_768,
       {rnd('o1024 * 100', 6)} AS pct_over_1024, {rnd('o2048 * 100', 6)} AS pct_over_2048,
       CAST(CASE WHEN p[5] <= 256 THEN 256 WHEN p[5] <= 512 THEN 512 WHEN p[4] <= 512 THEN 512 WHEN p[5] <= 1024 THEN 1024
            ELSE CAST(trunc(p[5]) AS INTEGER) END AS INTEGER) AS recommended_max_length FROM a""")
def a4_token_profile(spark, sf_dir):
    """Whitespace tokens per document stand in for model tokens."""
    d = Tables(spark, sf_dir).documents.select(T.word_count("text").cast("bigint").alias("n"))
    return ST.token_profile(d, "n")


@register("a5_histogram", sql="""
WITH l AS (SELECT CAST(length(text) AS BIGINT) AS x FROM documents), m AS (SELECT min(x) AS lo, max(x) AS hi FROM l)
SELECT CAST(least(floor((x - lo) * 50 / greatest(hi - lo, 1)), 49) AS INTEGER) AS bin, count(*) AS n FROM l, m GROUP BY 1""")
def a5_histogram(spark, sf_dir):
    d = Tables(spark, sf_dir).documents.select(F.char_length("text").cast("bigint").alias("x"))
    return ST.histogram(d, "x", ST.HIST_BINS)


@register("a5_ecdf", sql=f"""
WITH c AS (SELECT CAST(len({T.sql_words('text')}) AS BIGINT) AS n_words, count(*) AS n FROM documents GROUP BY 1)
SELECT n_words, n, {rnd('sum(n) OVER (ORDER BY n_words) / (SELECT sum(n) FROM c)', 9)} AS cdf FROM c""")
def a5_ecdf(spark, sf_dir):
    d = Tables(spark, sf_dir).documents.select(T.word_count("text").cast("bigint").alias("n_words"))
    e = ST.ecdf(d, "n_words")
    return e.select("n_words", "n", F.round("cdf", 9).alias("cdf"))


@register("a5_boxplot", sql=f"""
WITH l AS (SELECT lang, CAST(length(text) AS DOUBLE) AS x FROM documents),
q AS (SELECT lang, quantile_cont(x, [0.25, 0.5, 0.75]) AS p FROM l GROUP BY lang),
j AS (SELECT l.lang, x, p[1] AS q1, p[2] AS median, p[3] AS q3 FROM l JOIN q USING (lang))
SELECT lang, {rnd('q1', 6)} AS q1, {rnd('median', 6)} AS median, {rnd('q3', 6)} AS q3, {rnd('q3 - q1', 6)} AS iqr,
       min(x) FILTER (WHERE x >= q1 - 1.5 * (q3 - q1) AND x <= q3 + 1.5 * (q3 - q1)) AS whisker_low,
       max(x) FILTER (WHERE x >= q1 - 1.5 * (q3 - q1) AND x <= q3 + 1.5 * (q3 - q1)) AS whisker_high,
       count(*) FILTER (WHERE NOT (x >= q1 - 1.5 * (q3 - q1) AND x <= q3 + 1.5 * (q3 - q1))) AS outliers
FROM j GROUP BY lang, q1, median, q3""")
def a5_boxplot(spark, sf_dir):
    d = Tables(spark, sf_dir).documents.select("lang", F.char_length("text").alias("x"))
    return ST.boxplot(d, "x", ["lang"])


@register("a6_null_profile", sql=f"""WITH {ARTICLES_SQL}
SELECT * FROM (SELECT 'doc_id' AS "column", count(*) FILTER (WHERE doc_id IS NULL) AS nulls FROM articles
  UNION ALL SELECT 'url', count(*) FILTER (WHERE url IS NULL) FROM articles
  UNION ALL SELECT 'source', count(*) FILTER (WHERE source IS NULL) FROM articles
  UNION ALL SELECT 'lang', count(*) FILTER (WHERE lang IS NULL) FROM articles
  UNION ALL SELECT 'full_content', count(*) FILTER (WHERE full_content IS NULL) FROM articles)""")
def a6_null_profile(spark, sf_dir):
    return ST.null_profile(articles(spark, sf_dir))


_DESC_COLS = ("l_quantity", "l_extendedprice", "l_discount")


def _desc_sql():
    parts = []
    for c in _DESC_COLS:
        for stat, e in (("count", f"CAST(count({c}) AS DOUBLE)"), ("mean", f"avg({c})"), ("std", f"stddev_samp({c})"),
                        ("min", f"min({c})"), ("25%", f"quantile_cont({c}, 0.25)"), ("50%", f"quantile_cont({c}, 0.5)"),
                        ("75%", f"quantile_cont({c}, 0.75)"), ("max", f"max({c})")):
            parts.append(f"SELECT '{c}' AS \"column\", '{stat}' AS stat, {rnd(f'CAST({e} AS DOUBLE)', 6)} AS value FROM lineitem")
    return "\nUNION ALL ".join(parts)


@register("a7_describe", sql=_desc_sql())
def a7_describe(spark, sf_dir):
    return ST.describe(Tables(spark, sf_dir).lineitem, list(_DESC_COLS))


# the reference's terms do not occur in the invented prose; these do
TERMS = (*ST.POLITICAL_TERMS, "the", "license", "que")


def _kw_sql():
    parts = [f"SELECT lang, '{t}' AS term, count(*) FILTER (WHERE contains(lower(text), '{t}')) AS \"rows\" "
             f"FROM documents GROUP BY lang" for t in TERMS]
    return "\nUNION ALL ".join(parts)


@register("a8_keyword_presence", sql=_kw_sql())
def a8_keyword_presence(spark, sf_dir):
    return ST.keyword_presence(Tables(spark, sf_dir).documents, "text", "lang", TERMS)


PRED_SQL = """(SELECT l.doc_id, l.quality AS actual, CASE WHEN d.n_chars > 2000 THEN 1 ELSE 0 END AS predicted,
                     d.n_chars AS score FROM labels l JOIN documents d USING (doc_id))"""


def _predictions(spark, sf_dir):
    """Quality labels as actuals; a length rule as the predictor, length as its score."""
    t = Tables(spark, sf_dir)
    return t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").select(
        "doc_id", F.col("quality").alias("actual"),
        F.when(F.col("n_chars") > 2000, 1).otherwise(0).alias("predicted"), F.col("n_chars").alias("score"))


@register("a9_confusion_matrix", sql=f"SELECT actual, predicted, count(*) AS n FROM {PRED_SQL} GROUP BY ALL")
def a9_confusion_matrix(spark, sf_dir):
    return ST.confusion_matrix(_predictions(spark, sf_dir), "actual", "predicted")


@register("a10_classification_metrics", sql=f"""
WITH p AS {PRED_SQL},
cls AS (SELECT actual AS c FROM p UNION SELECT predicted FROM p),
per AS (SELECT c, (SELECT count(*) FROM p WHERE actual = c) AS support, (SELECT count(*) FROM p WHERE predicted = c) AS npred,
               (SELECT count(*) FROM p WHERE actual = c AND predicted = c) AS tp FROM cls),
m AS (SELECT *, CASE WHEN npred > 0 THEN tp / npred ELSE 0.0 END AS pr,
             CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS rc FROM per),
f AS (SELECT *, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END AS f1 FROM m)
SELECT {rnd('sum(tp) / sum(support)', 6)} AS accuracy, {rnd('sum(pr * support) / sum(support)', 6)} AS precision,
       {rnd('sum(rc * support) / sum(support)', 6)} AS recall, {rnd('sum(f1 * support) / sum(support)', 6)} AS f1,
       CAST(sum(support) AS BIGINT) AS n FROM f""")
def a10_classification_metrics(spark, sf_dir):
    return ST.classification_metrics(_predictions(spark, sf_dir), "actual", "predicted")


@register("a10_classification_report", sql=f"""
WITH p AS {PRED_SQL},
cls AS (SELECT actual AS c FROM p UNION SELECT predicted FROM p),
per AS (SELECT c, (SELECT count(*) FROM p WHERE actual = c) AS support, (SELECT count(*) FROM p WHERE predicted = c) AS npred,
               (SELECT count(*) FROM p WHERE actual = c AND predicted = c) AS tp FROM cls),
m AS (SELECT *, CASE WHEN npred > 0 THEN tp / npred ELSE 0.0 END AS pr, CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS rc FROM per),
f AS (SELECT *, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END AS f1 FROM m),
r AS (SELECT CAST(c AS VARCHAR) AS class, pr AS precision, rc AS recall, f1, support FROM f
      UNION ALL SELECT 'accuracy', NULL, NULL, sum(tp) / sum(support), sum(support)::BIGINT FROM f
      UNION ALL SELECT 'macro avg', avg(pr), avg(rc), avg(f1), sum(support)::BIGINT FROM f
      UNION ALL SELECT 'weighted avg', sum(pr * support) / sum(support), sum(rc * support) / sum(support), sum(f1 * support) / sum(support), sum(support)::BIGINT FROM f)
SELECT class, {rnd('precision', 6)} AS precision, {rnd('recall', 6)} AS recall, {rnd('f1', 6)} AS f1, support FROM r""")
def a10_classification_report(spark, sf_dir):
    return ST.classification_report(_predictions(spark, sf_dir), "actual", "predicted")


@register("a10_binary_metrics", sql=f"""
WITH p AS {PRED_SQL},
c AS (SELECT count(*) FILTER (WHERE actual = 1 AND predicted = 1) AS tp, count(*) FILTER (WHERE actual <> 1 AND predicted = 1) AS fp,
             count(*) FILTER (WHERE actual <> 1 AND predicted <> 1) AS tn, count(*) FILTER (WHERE actual = 1 AND predicted <> 1) AS fn FROM p),
rk AS (SELECT actual, avg(r) OVER (PARTITION BY score) AS ar FROM (SELECT *, row_number() OVER (ORDER BY score) AS r FROM p)),
a AS (SELECT (sum(ar) FILTER (WHERE actual = 1) - count(*) FILTER (WHERE actual = 1) * (count(*) FILTER (WHERE actual = 1) + 1) / 2.0)
             / (count(*) FILTER (WHERE actual = 1) * count(*) FILTER (WHERE actual <> 1)) AS auc FROM rk)
SELECT tp, fp, tn, fn,
       {rnd('CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0 THEN (tp * tn - fp * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)) ELSE 0.0 END', 6)} AS mcc,
       {rnd('auc', 6)} AS roc_auc FROM c, a""")
def a10_binary_metrics(spark, sf_dir):
    return ST.binary_metrics(_predictions(spark, sf_dir), "actual", "predicted", "score", 1)


@register("a11_class_weights", sql=f"""
WITH c AS (SELECT o_orderstatus, count(*) AS count FROM orders GROUP BY 1)
SELECT o_orderstatus, count, {rnd('(SELECT sum(count) FROM c) / ((SELECT count(*) FROM c) * count)', 6)} AS weight FROM c""")
def a11_class_weights(spark, sf_dir):
    return ST.class_weights(Tables(spark, sf_dir).orders, "o_orderstatus")


@register("a18_claim_length_summary", sql=f"""
WITH c AS (SELECT b.item_id, length(b.text) AS n, CASE WHEN l.quality IS NULL THEN 'NOT ENOUGH INFO'
                  WHEN l.quality = 1 AND l.toxic = 0 THEN 'SUPPORTS' ELSE 'REFUTES' END AS label
           FROM benchmark b LEFT JOIN labels l ON l.doc_id = b.item_id)
SELECT label, count(*) AS claims, {rnd('avg(n)', 6)} AS avg_len, CAST(min(n) AS BIGINT) AS min_len,
       CAST(max(n) AS BIGINT) AS max_len FROM c GROUP BY label""")
def a18_claim_length_summary(spark, sf_dir):
    from factlens.plans.q_retrieval import claim_labels

    b = Tables(spark, sf_dir).benchmark.select(F.col("item_id").alias("claim_id"),
                                               F.char_length("text").cast("bigint").alias("n"))
    j = b.join(claim_labels(spark, sf_dir), "claim_id")
    return j.groupBy("label").agg(F.count(F.lit(1)).alias("claims"), F.round(F.avg("n"), 6).alias("avg_len"),
                                  F.min("n").alias("min_len"), F.max("n").alias("max_len"))
