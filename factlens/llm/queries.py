"""Registered queries of the llm operators: thin, each over its whole intended table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factlens.llm.tables import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factlens.llm.substring_dedup import substring_dedup

    return substring_dedup(read(spark, sf_dir, "documents"), with_text=False)


@query
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factlens.llm.decontaminate import decontaminate

    return decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("items", "spans")


_ALNUM = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE["op3_decontaminate"] = f"""
WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
b AS (SELECT item_id, {_ALNUM} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, unnest(range(len(w) - least(10, len(w)) + 1)) AS i, w FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i + 1, i + n), ' ') AS t FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i + 1, i + n), ' ') AS t
       FROM (SELECT doc_id, n, w, unnest(range(greatest(len(w) - n + 1, 0))) AS i FROM d, (SELECT DISTINCT n FROM win))),
h AS (SELECT doc_id, n, i, item_id FROM dw JOIN win USING (n, t)),
p AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS q FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN m USING (doc_id)"""


@query
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factlens.llm.licenses import scan_licenses

    return scan_licenses(read(spark, sf_dir, "documents")).drop("notices")


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from factlens.llm.quality_rules import BASE, ledger, mask, passes

    x = ledger(read(spark, sf_dir, "documents").select("doc_id", "text"))
    m = F.col("quality_ledger")
    return x.select("doc_id", *(m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
                    (m["failed"].bitwiseAND(F.lit(mask(BASE))) != 0).alias("base_failed"), passes().alias("kept"), m["failed"].alias("failed_bits"))


_LEDGER_SQL = r"""
l0 AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
              list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
l1 AS (SELECT doc_id, t, w, ls, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
              length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
              length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) AS n_upper, length(regexp_replace(t, '[^\p{L}]+', '', 'g')) AS n_letters FROM l0),
l2 AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c
       FROM (SELECT doc_id, i, array_to_string(list_slice(w, i + 1, i + 5), ' ') AS g FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 4, 0))) AS i FROM l1))),
l3 AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM l2 WHERE c > 1) GROUP BY doc_id),
l4 AS (SELECT l1.*, coalesce(n_repeat_words, 0) AS n_repeat_words FROM l1 LEFT JOIN l3 USING (doc_id)),
l5 AS (SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
       + (CASE WHEN 100 * n_symbols > 5 * word_chars THEN 4 ELSE 0 END) + (CASE WHEN 100 * n_dup_lines > 60 * n_lines THEN 8 ELSE 0 END)
       + (CASE WHEN 100 * n_upper > 70 * n_letters AND n_letters > 0 THEN 16 ELSE 0 END) + (CASE WHEN 100 * n_letters < 40 * word_chars THEN 32 ELSE 0 END)
       + (CASE WHEN word_chars > 40 * n_words THEN 64 ELSE 0 END) AS f FROM l4)"""

ORACLE["op7_quality_rules"] = f"""WITH {_LEDGER_SQL}
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, f & 3 <> 0 AS base_failed, f = 0 AS kept, f::BIGINT AS failed_bits FROM l5"""


@query
def llm_quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factlens.llm.quality_rules import ablation, ledger

    return ablation(ledger(read(spark, sf_dir, "documents").select("doc_id", "text")))


ORACLE["llm_quality_ablation"] = f"""WITH {_LEDGER_SQL},
r AS (SELECT * FROM (VALUES ('few_words', 1), ('repeated_words', 2), ('symbols', 4), ('repeated_lines', 8), ('shouting', 16), ('few_letters', 32), ('long_words', 64)) t(rule, bit))
SELECT rule, bit::BIGINT AS bit, count(*) FILTER (f & bit <> 0) AS n_failed, count(*) FILTER (f = bit) AS n_only, count(*) FILTER (f & (127 - bit) = 0) AS n_kept_without
FROM l5, r GROUP BY rule, bit"""


@query
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factlens.llm.quality_classifier import classify

    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).drop("difference")


@query
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factlens.llm.jaccard_join import jaccard_classes

    return jaccard_classes(read(spark, sf_dir, "documents"))


KEY = "surrogate-key-of-this-corpus"  # for tests only


def surrogate_key(spark: SparkSession) -> str:
    """The secret that surrogates are drawn with: a deployment sets spark.factlens.surrogate.key."""
    return spark.conf.get("spark.factlens.surrogate.key", KEY)


@query
def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factlens.llm.pii import pseudonymize

    return pseudonymize(read(spark, sf_dir, "documents").select("doc_id", "text"), surrogate_key(spark), count_col="n_entities")


TARGETS = {"source": 0.5, "lang": {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15}, "topic": 0.7}


@query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factlens.llm.mixing import sample

    return sample(read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), TARGETS).drop("text")


@query
def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from factlens.llm import chat

    text = "\\### Assistant: </turn> ok"
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    out = chat.format_chats(chat.records_of(rows.unionByName(extra)), "record")
    turns = chat.read_back(F.col("formatted"))
    digest = lambda ts: F.sha2(F.array_join(F.transform(ts, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)
    learned = chat.masked(F.col("formatted"), F.col("loss"))
    back = chat.let(turns, lambda ts: F.struct(F.size(ts).cast("long").alias("n"), digest(ts).alias("sha")))
    loss = chat.let(learned, lambda t: F.struct(F.char_length(t).cast("long").alias("n"), F.sha2(t, 256).alias("sha")))
    return out.select("conv_id", back.alias("b"), loss.alias("l"), F.char_length("formatted").cast("long").alias("formatted_chars"), "layout").select(
        "conv_id", F.col("b.n").alias("n_turns"), F.col("b.sha").alias("turns_sha256"), F.col("l.n").alias("loss_chars"), F.col("l.sha").alias("loss_sha256"), "formatted_chars")


ORACLE["op4_chat_format"] = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') AS x FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       sum(4 + length(role) + 2 + length(x) + 9)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""


@query
def op2_html_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from factlens.llm.html_layout import render_pages

    text = render_pages(read(spark, sf_dir, "pages"))
    return text.withColumn("n_lines", F.size(F.split("text", "\n")).cast("long")).withColumn("n_chars", F.char_length("text").cast("long"))


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factlens.llm.prefix_trie import prefix_trie, sequences, with_shared_starts

    return prefix_trie(with_shared_starts(sequences(read(spark, sf_dir, "conversations"))))


def crc32_sql(codes: str) -> str:
    """DuckDB: the unsigned crc32 of a list of byte values; -1 stands for one step of the division."""
    steps = f"flatten(list_transform({codes}, lambda b: [b, -1, -1, -1, -1, -1, -1, -1, -1]))"
    fold = "lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {steps}), {fold}), 4294967295)"


_CRC_ID = crc32_sql("list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)")

ORACLE["op11_prefix_trie"] = f"""
WITH t AS (SELECT conv_id, md5(coalesce(role, '') || chr(10) || coalesce(text, '')) AS k, length(coalesce(text, '')) AS s,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, {_CRC_ID} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, n, k, s FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 AND n <= h
      UNION ALL SELECT c.conv_id, n, k, s FROM c JOIN t USING (conv_id) WHERE n > h),
l AS (SELECT conv_id, coalesce(ks, []) AS ks, ss FROM (SELECT DISTINCT conv_id FROM t)
      LEFT JOIN (SELECT conv_id, list(k ORDER BY n) AS ks, list(s ORDER BY n) AS ss FROM r GROUP BY conv_id) USING (conv_id)),
p AS (SELECT conv_id, ks, ss, unnest(range(len(ks) + 1)) AS d FROM l),
nodes AS (SELECT array_to_string(list_slice(ks, 1, d), ',') AS path, d, min(conv_id) AS conv_id, any_value(list_slice(ks, 1, d)) AS ks, count(*) AS n_convs,
                 coalesce(any_value(ss[d]), 0) AS size, string_agg(CASE WHEN len(ks) = d THEN conv_id END, ',' ORDER BY conv_id) AS ends FROM p GROUP BY 1, 2),
kids AS (SELECT array_to_string(list_slice(ks, 1, d - 1), ',') AS path, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1, 2),
own AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids USING (path, d)),
up AS (SELECT ks, n_children, (n_convs - 1) * size AS saved, unnest(range(d + 1)) AS d FROM own),
below AS (SELECT array_to_string(list_slice(ks, 1, d), ',') AS path, d, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved FROM up GROUP BY 1, 2)
SELECT o.conv_id, o.d::BIGINT AS depth, par.conv_id AS parent_conv_id, o.n_convs, o.n_children, n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(o.ends, '')) AS ends_sha256
FROM own o JOIN below USING (path, d) LEFT JOIN nodes par ON par.d = o.d - 1 AND par.path = array_to_string(list_slice(o.ks, 1, o.d - 1), ',')"""


@query
def op12_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factlens.llm.importance import importance_resample

    return importance_resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_CRC_WORD = crc32_sql("list_transform(range(octet_length(encode(w))), lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::BIGINT)")

ORACLE["op12_importance_resample"] = f"""
WITH d AS (SELECT doc_id, {_ALNUM} AS ws, row_number() OVER () AS r FROM documents),
b AS (SELECT unnest({_ALNUM}) AS w FROM benchmark),
dw AS (SELECT r, unnest(ws) AS w FROM d),
v AS (SELECT w, {_CRC_WORD} % 10000 AS bucket FROM (SELECT w FROM dw UNION SELECT w FROM b)),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN v USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM b JOIN v USING (w) GROUP BY bucket),
n AS (SELECT (SELECT count(*) FROM dw) AS sn, (SELECT count(*) FROM b) AS tn),
g AS (SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * (sn + 10000)) / ((s + 1)::DOUBLE * (tn + 10000)))) AS gain FROM s LEFT JOIN t USING (bucket), n),
x AS (SELECT r, count(*) AS k, floor(sum(gain) / count(*)) AS weight FROM dw JOIN v USING (w) JOIN g USING (bucket) GROUP BY r),
y AS (SELECT doc_id, coalesce(k, 0) AS n_features, coalesce(weight, 0)::BIGINT AS weight, ('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT AS h
      FROM d LEFT JOIN x USING (r)),
z AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM y),
q AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS place, count(*) FILTER (n_features >= 20) OVER () AS able FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * able // 100 THEN place END AS rank FROM q"""


@query
def op13_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factlens.llm.odd_sketch import odd_sketch_components

    return odd_sketch_components(read(spark, sf_dir, "documents"))


ORACLE["op13_odd_sketch"] = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id,
     regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(list_slice(w, i + 1, i + 5), ' ') AS g FROM (SELECT r, w, unnest(range(greatest(len(w) - 4, least(len(w), 1)))) AS i FROM d)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
o AS (SELECT a.r AS u, b.r AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY 1, 2),
e AS (SELECT u, v FROM o JOIN n x ON x.r = u JOIN n y ON y.r = v WHERE 100 * c >= 85 * (x.n + y.n - c)),
m(r, root) AS (SELECT r, r FROM d UNION SELECT e.v, m.root FROM m JOIN e ON e.u = m.r)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, k.c AS component_id, d.doc_id IS NOT DISTINCT FROM k.c AS kept
FROM d LEFT JOIN n USING (r) JOIN (SELECT root AS r, min(x.doc_id) AS c FROM m JOIN d x ON x.r = m.r GROUP BY root) k USING (r)"""
