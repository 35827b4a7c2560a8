"""Registered queries: evidence-set build and file sources / sinks
(S1, S2, S4-S5 via derived records, U4, U5, J1, F4, K1, K4).

The page store and the claim records are derived from the driver tables, so their
size follows the data: every document becomes a page ``doc_<id>`` whose sentences
are its U1 sentences; every labelled document becomes a claim that cites sentences
0 and 2 of its own page, sentence 1 of the next page id (which may not exist) and a
table cell (a kind that is skipped).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from factlens.functions import text as T
from factlens.operators import evidence as EV
from factlens.operators import sampling as S
from factlens.operators.filters import challenge_filter
from factlens.operators.sentences import sentence_array
from factlens.plans.catalog import register
from factlens.session import scratch_path
from factlens.sources import readers as RD
from factlens.sources import sinks as SK
from factlens.sources.tables import Tables, spread


def wiki_store(spark, sf_dir):
    """S5 shape: pages stored as (id, JSON text) and read back as a map column."""
    d = Tables(spark, sf_dir).documents.select("doc_id", sentence_array("text").alias("s"))
    keys = F.transform(F.sequence(F.lit(0), F.size("s") - 1), lambda i: F.concat(F.lit("sentence_"), i.cast("string")))
    m = F.when(F.size("s") > 0, F.map_from_arrays(keys, "s")).otherwise(F.create_map().cast("map<string,string>"))
    stored = d.select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("id"), F.to_json(m).alias("data"))
    return RD.read_wiki_store(stored)


def raw_claims(spark, sf_dir):
    t = Tables(spark, sf_dir)
    d = spread(t.labels.join(t.documents.select("doc_id", "lang", "text"), "doc_id"))

    def ref(doc, n, kind="sentence"):
        return F.concat(F.lit("doc_"), doc.cast("string"), F.lit(f"_{kind}_{n}"))

    ev = F.array(
        F.struct(F.array(ref(F.col("doc_id"), 0), ref(F.col("doc_id"), 2)).alias("content"),
                 F.lit(None).cast("string").alias("context")),
        F.struct(F.array(ref(F.col("doc_id") + 1, 1), ref(F.col("doc_id"), "0_1", "cell")).alias("content"),
                 F.lit(None).cast("string").alias("context")))
    label = (F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "SUPPORTS")
             .when(F.col("toxic") == 1, "REFUTES").otherwise("NOT ENOUGH INFO"))
    challenge = F.when(F.col("lang") == "es", F.lit(" Numerical Reasoning ")).when(F.col("lang") == "de", F.lit("")) \
        .otherwise(F.col("lang"))
    return d.select(F.col("doc_id").alias("id"), F.get(sentence_array("text"), F.lit(0)).alias("claim"),
                    label.alias("label"), challenge.alias("challenge"), ev.alias("evidence"))


_SENTS = f"""
sp AS (SELECT doc_id, unnest(regexp_split_to_array(text, '{T.SENTENCE_BREAK_RE}')) AS s0,
              unnest(range(len(regexp_split_to_array(text, '{T.SENTENCE_BREAK_RE}')))) AS p FROM documents),
sk AS (SELECT doc_id, p, {T.sql_py_strip('s0')} AS s FROM sp),
sents AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS INTEGER) AS n, s
          FROM sk WHERE length(s) >= 6),
refs AS (SELECT doc_id AS id, 0 AS ev_idx, 0 AS c_idx, doc_id AS page_doc, 0 AS n FROM labels
         UNION ALL SELECT doc_id, 0, 1, doc_id, 2 FROM labels
         UNION ALL SELECT doc_id, 1, 0, doc_id + 1, 1 FROM labels)"""


@register("j1_resolve_evidence", sql=f"""WITH {_SENTS},
res AS (SELECT r.id, r.ev_idx, r.c_idx, {T.sql_strip_wiki_links('s.s')} AS s FROM refs r
        JOIN sents s ON s.doc_id = r.page_doc AND s.n = r.n)
SELECT id, count(*) AS n_evidence, md5(string_agg(s, '\n' ORDER BY ev_idx, c_idx)) AS evidence_md5
FROM res GROUP BY id""")
def j1_resolve_evidence(spark, sf_dir):
    r = EV.resolve_evidence(raw_claims(spark, sf_dir), wiki_store(spark, sf_dir))
    return r.select("id", F.size("evidence").cast("bigint").alias("n_evidence"),
                    F.md5(F.array_join("evidence", "\n")).alias("evidence_md5"))


_REFS_SQL = """
SELECT doc_id AS id, 0 AS ev_idx, 0 AS c_idx, 'doc_' || CAST(doc_id AS VARCHAR) AS page, 'sentence_0' AS sentence_key FROM labels
UNION ALL SELECT doc_id, 0, 1, 'doc_' || CAST(doc_id AS VARCHAR), 'sentence_2' FROM labels
UNION ALL SELECT doc_id, 1, 0, 'doc_' || CAST(doc_id + 1 AS VARCHAR), 'sentence_1' FROM labels"""


@register("u4_explode_evidence_refs", sql=_REFS_SQL)
def u4_explode_evidence_refs(spark, sf_dir):
    r = EV.explode_evidence_refs(raw_claims(spark, sf_dir))
    return r.select("id", F.col("ev_idx").cast("int"), F.col("c_idx").cast("int"), "page", "sentence_key")


@register("s4_read_evidence_jsonl", sql=_REFS_SQL)
def s4_read_evidence_jsonl(spark, sf_dir):
    """Claim records written as JSON lines, read back (S4) and their references listed."""
    path = scratch_path(spark, "claims")
    raw_claims(spark, sf_dir).write.json(path)
    r = EV.explode_evidence_refs(RD.read_evidence_jsonl(spark, path))
    return r.select("id", F.col("ev_idx").cast("int"), F.col("c_idx").cast("int"), "page", "sentence_key")


@register("u5_extract_titles", sql="""
SELECT doc_id AS id, array_to_string(list_distinct_ordered, '|') AS titles, array_to_string(list_distinct_ordered, '|') AS pages
FROM (SELECT doc_id, CASE WHEN doc_id + 1 = doc_id THEN [] ELSE
        ['doc_' || CAST(doc_id AS VARCHAR), 'doc_' || CAST(doc_id + 1 AS VARCHAR)] END AS list_distinct_ordered FROM labels)""")
def u5_extract_titles(spark, sf_dir):
    t = EV.extract_titles(raw_claims(spark, sf_dir))
    return t.select("id", F.array_join("titles", "|").alias("titles"), F.array_join("pages", "|").alias("pages"))


@register("f4_challenge_filter", sql="""
SELECT l.doc_id AS id, d.lang AS challenge FROM labels l JOIN documents d USING (doc_id) WHERE d.lang NOT IN ('es', 'de')""")
def f4_challenge_filter(spark, sf_dir):
    return challenge_filter(raw_claims(spark, sf_dir)).select("id", "challenge")


@register("k1_s1_shard_roundtrip", sql="""
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders""")
def k1_s1_shard_roundtrip(spark, sf_dir):
    """orders written as bounded shards (K1) and read back by prefix."""
    path = scratch_path(spark, "shards")
    o = Tables(spark, sf_dir).orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                            "o_orderpriority")
    SK.write_shards(o, path, rows_per_file=5000)
    return RD.read_shards(spark, path, "part-")


@register("s3_read_json_array", sql="""
SELECT c_custkey, c_name, CASE WHEN c_nationkey % 2 = 0 THEN CAST(c_acctbal AS DOUBLE) END AS c_acctbal,
       CASE WHEN c_nationkey % 3 = 0 THEN 'k' || c_custkey ELSE CAST(c_custkey AS VARCHAR) END AS mixed FROM customer""")
def s3_read_json_array(spark, sf_dir):
    """Customers written as one JSON array a nation, with fields that only some files have and a field of two types, read back as one table."""
    path = scratch_path(spark, "json-arrays")
    c = Tables(spark, sf_dir).customer
    text = lambda *fields: F.to_json(F.struct("c_custkey", "c_name", *fields))
    balance = F.col("c_acctbal").cast("double").alias("c_acctbal")
    key = F.col("c_custkey")
    even, third = F.col("c_nationkey") % 2 == 0, F.col("c_nationkey") % 3 == 0
    mixed = F.concat(F.lit("k"), key.cast("string")).alias("mixed")
    obj = (F.when(even & third, text(balance, mixed)).when(even, text(balance, key.alias("mixed"))).when(third, text(mixed)).otherwise(text(key.alias("mixed"))))
    arrays = c.groupBy("c_nationkey").agg(F.concat(F.lit("["), F.concat_ws(",", F.collect_list(obj)), F.lit("]")).alias("value"))
    arrays.repartition("c_nationkey").write.partitionBy("c_nationkey").text(path)
    r = RD.read_json_array(spark, [f"{path}/*/*.txt"])
    return r.select(F.col("c_custkey").cast("bigint"), "c_name", F.col("c_acctbal").cast("double"), F.col("mixed").cast("string"))


@register("s2_read_delimited", sql="""
SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS label, o_orderpriority AS statement FROM orders""")
def s2_read_delimited(spark, sf_dir):
    """orders exported as headerless TSV and read back with declared columns."""
    path = scratch_path(spark, "tsv")
    o = Tables(spark, sf_dir).orders.select(F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority")
    o.write.option("sep", "\t").csv(path)
    return RD.read_delimited(spark, path, ("id", "label", "statement"))


@register("k2_export", sql="""
SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS label, o_orderpriority AS statement FROM orders""")
def k2_export(spark, sf_dir):
    """orders exported as CSV with a header (K2) and read back."""
    o = Tables(spark, sf_dir).orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("label"),
                                            F.col("o_orderpriority").alias("statement"))
    path = SK.export(o, scratch_path(spark, "export"), "orders")
    return RD.read_delimited(spark, path, ("id", "label", "statement"), sep=",", header=True)


@register("s6_flatten_payload", sql="""
SELECT 'https://' || source || '.example/' || CAST(doc_id AS VARCHAR) AS url, lang AS title, source,
       md5(text) AS content_md5 FROM documents""")
def s6_flatten_payload(spark, sf_dir):
    """Every document as a landed news response (JSON text), flattened to article rows."""
    d = Tables(spark, sf_dir).documents
    url = F.concat(F.lit("https://"), "source", F.lit(".example/"), F.col("doc_id").cast("string"))
    article = F.struct(F.struct(F.col("source").alias("name")).alias("source"), url.alias("url"), F.col("lang").alias("title"),
                       F.col("text").alias("content"))
    payload = F.to_json(F.struct(F.array(article).alias("articles")))
    r = RD.flatten_api_payload(d.select(payload.alias("payload")), "news")
    return r.select("url", "title", "source", F.md5("content").alias("content_md5"))


@register("k4_fold_files", sql="""
WITH n AS (SELECT min(c) // 4 AS n FROM (SELECT count(*) AS c FROM orders GROUP BY o_orderstatus)),
r AS (SELECT o_orderkey, o_orderstatus,
             row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(CAST(o_orderkey AS VARCHAR) || ':42'), o_orderkey) AS rank
      FROM orders)
SELECT o_orderkey, o_orderstatus, CAST((rank - 1) // n.n AS INTEGER) AS fold FROM r, n WHERE rank <= 4 * n.n""")
def k4_fold_files(spark, sf_dir):
    """Balanced folds (L7) written one folder per fold (K4) and read back."""
    o = Tables(spark, sf_dir).orders.select("o_orderkey", "o_orderstatus")
    n = min(S.label_counts(o, "o_orderstatus").values()) // 4
    path = scratch_path(spark, "folds")
    SK.write_partitioned_by_fold(S.balanced_folds(o, "o_orderstatus", "o_orderkey", 4, n, 42), path)
    return spark.read.parquet(path).select("o_orderkey", "o_orderstatus", F.col("fold").cast("int"))
