"""Registered queries: sampling, balancing, folds, splits and set operations
(W4, W5, L4-L12, J4, O1-O3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from factlens.functions import text as T
from factlens.operators import sampling as S
from factlens.plans.catalog import register
from factlens.sources.tables import Tables

SEED = 42


def _rk(label, id_):
    return f"row_number() OVER (PARTITION BY {label} ORDER BY md5(CAST({id_} AS VARCHAR) || ':{SEED}'), {id_})"


@register("w4_stratified_exact_sample", sql=f"""
SELECT o_orderkey, o_orderstatus, rank FROM (
  SELECT o_orderkey, o_orderstatus, {_rk('o_orderstatus', 'o_orderkey')} AS rank FROM orders) WHERE rank <= 1000""")
def w4_stratified_exact_sample(spark, sf_dir):
    o = Tables(spark, sf_dir).orders.select("o_orderkey", "o_orderstatus")
    return S.stratified_exact_sample(o, "o_orderstatus", "o_orderkey", 1000, SEED).select(
        "o_orderkey", "o_orderstatus", F.col("rank").cast("bigint").alias("rank"))


@register("l12_mini_set", sql=f"""
SELECT event_id, event_type FROM (
  SELECT event_id, event_type, {_rk('event_type', 'event_id')} AS rank FROM events) WHERE rank <= 100""")
def l12_mini_set(spark, sf_dir):
    e = Tables(spark, sf_dir).events.select("event_id", "event_type")
    return S.mini_set(e, "event_type", "event_id", 100, SEED).select("event_id", "event_type")


@register("j4_unused_rows", sql=f"""
SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (
  SELECT o_orderkey FROM (SELECT o_orderkey, {_rk('o_orderstatus', 'o_orderkey')} AS rank FROM orders) WHERE rank <= 1000)""")
def j4_unused_rows(spark, sf_dir):
    o = Tables(spark, sf_dir).orders.select("o_orderkey", "o_orderstatus")
    used = S.stratified_exact_sample(o, "o_orderstatus", "o_orderkey", 1000, SEED)
    return S.unused_rows(o, used, "o_orderkey")


BINARY_LABELS_SQL = "(SELECT doc_id, CASE WHEN quality = 1 THEN 'claim' ELSE 'other' END AS label FROM labels)"


def _binary_labels(spark, sf_dir):
    lab = Tables(spark, sf_dir).labels
    return lab.select("doc_id", F.when(F.col("quality") == 1, "claim").otherwise("other").alias("label"))


@register("l4_balance_down", sql=f"""
WITH b AS {BINARY_LABELS_SQL}, m AS (SELECT min(c) AS n FROM (SELECT count(*) AS c FROM b GROUP BY label))
SELECT doc_id, label FROM (SELECT doc_id, label, {_rk('label', 'doc_id')} AS rank FROM b), m WHERE rank <= m.n""")
def l4_balance_down(spark, sf_dir):
    return S.balance_down(_binary_labels(spark, sf_dir), "label", "doc_id", SEED).select("doc_id", "label")


@register("l5_balance_over_under", sql=f"""
WITH b AS {BINARY_LABELS_SQL},
n AS (SELECT count(*) AS n_min, CAST(round_even(0.2 * count(*), 0) AS BIGINT) AS n_extra FROM b WHERE label = 'other'),
r AS (SELECT doc_id, label, {_rk('label', 'doc_id')} AS rank FROM b)
SELECT doc_id, label, 0 AS copy FROM b WHERE label = 'other'
UNION ALL SELECT doc_id, label, 1 FROM r, n WHERE label = 'other' AND rank <= n.n_extra
UNION ALL SELECT doc_id, label, 0 FROM r, n WHERE label = 'claim' AND rank <= n.n_min + n.n_extra""")
def l5_balance_over_under(spark, sf_dir):
    out = S.balance_over_under(_binary_labels(spark, sf_dir), "label", "doc_id", "other", "claim", 0.2, SEED)
    return out.select("doc_id", "label", "copy")


@register("l6_balance_with_relabel", sql=f"""
WITH d AS (SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'fr', 'es')),
c AS (SELECT count(*) FILTER (WHERE lang = 'es') AS s, least(count(*) FILTER (WHERE lang = 'en'),
             count(*) FILTER (WHERE lang = 'fr')) AS m FROM d),
p AS (SELECT (s + m) // 2 AS n, greatest((s + m) // 2 - s, 0) AS need FROM c),
r AS (SELECT doc_id, lang, {_rk('lang', 'doc_id')} AS rank FROM d WHERE lang IN ('en', 'fr'))
SELECT doc_id, lang, false AS relabelled FROM r, p WHERE rank <= p.n
UNION ALL SELECT doc_id, lang, false FROM d WHERE lang = 'es'
UNION ALL SELECT doc_id, 'es', true FROM r, p
  WHERE rank > p.n AND rank <= p.n + CASE WHEN lang = 'en' THEN p.need // 2 ELSE p.need // 2 + p.need % 2 END""")
def l6_balance_with_relabel(spark, sf_dir):
    """Languages as three labels: 'es' is short; the target n sits halfway between its
    count and the smaller donor's, so the shortfall is filled from unused en/fr rows."""
    d = Tables(spark, sf_dir).documents.select("doc_id", "lang")
    counts = S.label_counts(d.where(F.col("lang").isin("en", "fr", "es")), "lang")
    n = (counts.get("es", 0) + min(counts.get("en", 0), counts.get("fr", 0))) // 2
    out = S.balance_with_relabel(d, "lang", "doc_id", n, "es", ("en", "fr"), SEED)
    return out.select("doc_id", "lang", "relabelled")


@register("l7_balanced_folds", sql=f"""
WITH n AS (SELECT min(c) // 4 AS n FROM (SELECT count(*) AS c FROM orders GROUP BY o_orderstatus)),
r AS (SELECT o_orderkey, o_orderstatus, {_rk('o_orderstatus', 'o_orderkey')} AS rank FROM orders)
SELECT o_orderkey, o_orderstatus, CAST((rank - 1) // n.n AS INTEGER) AS fold FROM r, n WHERE rank <= 4 * n.n""")
def l7_balanced_folds(spark, sf_dir):
    o = Tables(spark, sf_dir).orders.select("o_orderkey", "o_orderstatus")
    n = min(S.label_counts(o, "o_orderstatus").values()) // 4
    return S.balanced_folds(o, "o_orderstatus", "o_orderkey", 4, n, SEED).select("o_orderkey", "o_orderstatus", "fold")


def _lr_sql(counts_cte: str, total: str, name: str) -> str:
    """Largest-remainder allocation of ``total`` over labels in SQL."""
    return f"""{name}_b AS (SELECT label, c, (c * {total}) // nn AS base, (c * {total}) % nn AS rem
           FROM {counts_cte}, (SELECT sum(c) AS nn FROM {counts_cte})),
{name}_l AS (SELECT {total} - sum(base) AS lft FROM {name}_b),
{name} AS (SELECT label, base + CASE WHEN row_number() OVER (ORDER BY rem DESC, label) <= lft THEN 1 ELSE 0 END AS q
          FROM {name}_b, {name}_l)"""


@register("l8_stratified_split", sql=f"""
WITH cnt AS (SELECT o_orderstatus AS label, count(*) AS c FROM orders GROUP BY 1),
sz AS (SELECT CAST(floor(sum(c) * 0.1) AS BIGINT) AS size FROM cnt),
{_lr_sql('cnt', '(SELECT size FROM sz)', 'tq')},
rest AS (SELECT cnt.label, cnt.c - tq.q AS c FROM cnt JOIN tq USING (label)),
{_lr_sql('rest', '(SELECT size FROM sz)', 'vq')},
r AS (SELECT o_orderkey, o_orderstatus AS label, {_rk('o_orderstatus', 'o_orderkey')} AS rank FROM orders)
SELECT o_orderkey, r.label AS o_orderstatus, CASE WHEN rank <= tq.q THEN 'test' WHEN rank <= tq.q + vq.q THEN 'val'
       ELSE 'train' END AS split
FROM r JOIN tq USING (label) JOIN vq USING (label)""")
def l8_stratified_split(spark, sf_dir):
    o = Tables(spark, sf_dir).orders.select("o_orderkey", "o_orderstatus")
    return S.stratified_split(o, "o_orderstatus", "o_orderkey", 0.1, SEED).select("o_orderkey", "o_orderstatus", "split")


BINS_SQL = """
lens AS (SELECT doc_id, CAST(length(text) AS DOUBLE) AS x FROM documents),
qs AS (SELECT list_distinct(list_transform(quantile_cont(x, [0.0, 1/9, 2/9, 3/9, 4/9, 5/9, 6/9, 7/9, 8/9, 1.0]),
                                           lambda e: round(e, 9))) AS edges FROM lens),
bins AS (SELECT doc_id, x, CAST(greatest(len(list_filter(edges, lambda t: t < x)) - 1, 0) AS INTEGER) AS bin
         FROM lens, qs)"""


def _doc_bins(spark, sf_dir):
    d = Tables(spark, sf_dir).documents.select("doc_id", F.char_length("text").alias("n"))
    return S.quantile_bins(d, "n", 9)


@register("w5_quantile_bins", sql=f"WITH {BINS_SQL} SELECT doc_id, bin FROM bins")
def w5_quantile_bins(spark, sf_dir):
    return _doc_bins(spark, sf_dir).select("doc_id", "bin")


@register("l9_quota_sample", sql=f"""WITH {BINS_SQL},
g AS (SELECT doc_id, CASE WHEN bin IN (0, 1) THEN 0 WHEN bin IN (2, 3) THEN 1 WHEN bin IN (4, 5) THEN 2
                          WHEN bin IN (6, 7) THEN 3 WHEN bin = 8 THEN 4 END AS quota_group FROM bins),
p AS (SELECT (SELECT count(*) FROM documents) // 2 AS cnt, (SELECT count(*) FROM documents) // 2 // 5 AS size,
             (SELECT count(*) FROM g WHERE quota_group = 4) AS last_rows),
z AS (SELECT cnt, size, CASE WHEN CAST(size * 1.25 AS BIGINT) < last_rows THEN CAST(size * 1.25 AS BIGINT)
                             WHEN CAST(size * 1.15 AS BIGINT) < last_rows THEN CAST(size * 1.15 AS BIGINT)
                             WHEN CAST(size * 1.05 AS BIGINT) < last_rows THEN CAST(size * 1.05 AS BIGINT) END AS boosted
      FROM p),
qz AS (SELECT CASE WHEN boosted IS NULL THEN [size, size, size, size, cnt - size * 4]
                   ELSE [cnt - (boosted + size * 3), size, size, size, boosted] END AS quotas FROM z),
r AS (SELECT doc_id, quota_group, {_rk('quota_group', 'doc_id')} AS rank FROM g WHERE quota_group IS NOT NULL)
SELECT doc_id, quota_group FROM r, qz WHERE rank <= quotas[quota_group + 1]""")
def l9_quota_sample(spark, sf_dir):
    """Half the documents, stratified by pairs of length bins."""
    b = _doc_bins(spark, sf_dir)
    count = Tables(spark, sf_dir).documents.count() // 2
    return S.quota_sample(b, "bin", "doc_id", count, SEED).select("doc_id", "quota_group")


THREE_LABELS_SQL = """(SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'SUPPORTS' WHEN toxic = 1 THEN 'REFUTES'
                      ELSE 'NOT ENOUGH INFO' END AS label FROM labels)"""


@register("l10_sample_with_replacement", sql=f"""
WITH d AS {THREE_LABELS_SQL},
c AS (SELECT label, count(*) AS c FROM d GROUP BY label), n AS (SELECT 2 * min(c) AS n FROM c),
r AS (SELECT doc_id, label, {_rk('label', 'doc_id')} AS rank FROM d),
draws AS (SELECT label, c.c, unnest(range(1, n.n + 1)) AS draw FROM c, n WHERE c.c < n.n),
dr AS (SELECT label, draw, ('0x' || substr(md5(CAST(draw AS VARCHAR) || ':{SEED}:' || label), 1, 15))::BIGINT % c + 1 AS rank
       FROM draws)
SELECT r.doc_id, r.label, r.rank AS draw FROM r JOIN c USING (label), n WHERE c.c >= n.n AND r.rank <= n.n
UNION ALL SELECT r.doc_id, r.label, dr.draw FROM dr JOIN r USING (label, rank)""")
def l10_sample_with_replacement(spark, sf_dir):
    lab = Tables(spark, sf_dir).labels
    d = lab.select("doc_id", F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "SUPPORTS")
                   .when(F.col("toxic") == 1, "REFUTES").otherwise("NOT ENOUGH INFO").alias("label"))
    out = S.sample_with_replacement(d, "label", "doc_id", SEED)
    return out.select("doc_id", "label", F.col("draw").cast("bigint").alias("draw"))


@register("l11_shuffle", sql=f"""
SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR) || ':{SEED}'), doc_id) AS position FROM documents""")
def l11_shuffle(spark, sf_dir):
    d = Tables(spark, sf_dir).documents.select("doc_id")
    return S.shuffle_order(d, "doc_id", SEED).select("doc_id", F.col("position").cast("bigint"))


@register("o1_union_by_name", sql="""
SELECT 'documents' AS origin, CAST(doc_id AS VARCHAR) AS id, md5(text) AS text_md5, lang AS label FROM documents
UNION ALL SELECT 'conversations', CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR), md5(text), role FROM conversations
UNION ALL SELECT 'benchmark', CAST(item_id AS VARCHAR), md5(text), 'benchmark' FROM benchmark""")
def o1_union_by_name(spark, sf_dir):
    """Three heterogeneous sets projected to (id, text, label) and unioned by name."""
    t = Tables(spark, sf_dir)
    a = t.documents.select(F.lit("documents").alias("origin"), F.col("doc_id").cast("string").alias("id"),
                           "text", F.col("lang").alias("label"))
    b = t.conversations.select(F.col("role").alias("label"), "text", F.lit("conversations").alias("origin"),
                               F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"))
    c = t.benchmark.select(F.col("item_id").cast("string").alias("id"), "text",
                           F.lit("benchmark").alias("label"), F.lit("benchmark").alias("origin"))
    u = a.unionByName(b).unionByName(c)
    return u.select("origin", "id", F.md5("text").alias("text_md5"), "label")


@register("o2_except_by_key", sql="SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def o2_except_by_key(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return S.unused_rows(t.documents.select("doc_id"), t.labels.select("doc_id"), "doc_id")


@register("o3_distinct_hosts", sql=r"""
SELECT DISTINCT regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1) AS host FROM pages""")
def o3_distinct_hosts(spark, sf_dir):
    return Tables(spark, sf_dir).pages.select(T.url_host("url").alias("host")).distinct()
