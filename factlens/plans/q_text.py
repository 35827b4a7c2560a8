"""Registered queries: text cleaning, filters and per-row generators
(P1-P17, F1, F2, F10, U1, U6, U9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from factlens.functions import text as T
from factlens.operators import cleaning as CL
from factlens.operators import responses as RSP
from factlens.operators.sentences import sentence_array, split_sentences
from factlens.plans.catalog import register
from factlens.session import scratch_path
from factlens.sources.tables import Tables, spread

# What a post ends with, by its number: a topic handle, wiki links, a possessive (with and without a last newline), mentions.
ENDINGS = (" about {@Top news@} and @now", " see [[Main page|the page]] and [[Other]]", " at the end's", " at the end's\n", " thanks @user_1 and @josé\n\nbye", "")
_END_SQL = " ".join(f"WHEN {i} THEN '" + e.replace("'", "''") + "'" for i, e in enumerate(ENDINGS))
POSTS_SQL = f"""posts AS (SELECT d.doc_id, concat_ws(' ', p.url, d.text) || CASE d.doc_id % 6 {_END_SQL} END AS text
               FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id)"""


def posts(spark, sf_dir):
    """Documents as posts; the page with the same id lends its url, so the url rules see
    real links, and an ending by number lets every other rule see what it is for."""
    t = Tables(spark, sf_dir)
    p = t.pages.select(F.col("page_id").alias("doc_id"), "url")
    end = F.element_at(F.array(*map(F.lit, ENDINGS)), (F.col("doc_id") % 6 + 1).cast("int"))
    j = t.documents.join(p, "doc_id", "left").select("doc_id", F.concat(F.concat_ws(" ", "url", "text"), end).alias("text"))
    return spread(j)


def _digest(col):
    return [F.md5(col).alias("clean_md5"), F.char_length(col).cast("bigint").alias("clean_len")]


def _sql_digest(e):
    return f"md5({e}) AS clean_md5, CAST(length({e}) AS BIGINT) AS clean_len"


def _posts_query(name, fn, sql_fn):
    @register(name, sql=f"WITH {POSTS_SQL} SELECT doc_id, {_sql_digest(sql_fn('text'))} FROM posts")
    def q(spark, sf_dir):
        return posts(spark, sf_dir).select("doc_id", *_digest(fn("text")))

    q.__name__ = name
    return q


p1_mask_urls = _posts_query("p1_mask_urls", T.mask_urls, T.sql_mask_urls)
p2_drop_urls = _posts_query("p2_drop_urls", T.drop_urls, T.sql_drop_urls)
p3_mask_mentions = _posts_query("p3_mask_mentions", T.mask_mentions, T.sql_mask_mentions)
p4_collapse_newlines = _posts_query("p4_collapse_newlines", T.collapse_newlines, T.sql_collapse_newlines)
p6_standardize = _posts_query(
    "p6_standardize", T.standardize,
    lambda e: T.sql_mask_mentions(T.sql_mask_urls(T.sql_unmask_topic_handles(e))))
p8_strip_wiki_links = _posts_query("p8_strip_wiki_links", T.strip_wiki_links, T.sql_strip_wiki_links)
p10_normalize_entities = _posts_query("p10_normalize_entities", T.normalize_entities, T.sql_normalize_entities)
p12_collapse_ws = _posts_query("p12_collapse_ws", T.collapse_ws, T.sql_collapse_ws)
p_keyword_profile = _posts_query(
    "p5_keyword_clean", T.keyword_clean,
    lambda e: T.sql_strip_possessive(T.sql_collapse_newlines(T.sql_mask_mentions(T.sql_drop_urls(e)))))

_SENT = T.SENTENCE_BREAK_RE
_SQL_SENTS = f"""
sp AS (SELECT doc_id, unnest(regexp_split_to_array(text, '{_SENT}')) AS s,
              unnest(range(len(regexp_split_to_array(text, '{_SENT}')))) AS pos FROM documents),
sk AS (SELECT doc_id, pos, {T.sql_py_strip('s')} AS s FROM sp)"""


@register("u1_split_sentences", sql=f"""WITH {_SQL_SENTS}
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS sent_idx, s AS text
FROM sk WHERE length(s) >= 6""")
def u1_split_sentences(spark, sf_dir):
    d = Tables(spark, sf_dir).documents
    return split_sentences(d, "doc_id", "text").select("doc_id", F.col("sent_idx").cast("int"), "text")


@register("p5_strip_possessive", sql=f"""WITH {_SQL_SENTS}
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS sent_idx,
       {T.sql_strip_possessive('s')} AS text
FROM sk WHERE length(s) >= 6""")
def p5_strip_possessive(spark, sf_dir):
    s = split_sentences(Tables(spark, sf_dir).documents, "doc_id", "text")
    return s.select("doc_id", F.col("sent_idx").cast("int"), T.strip_possessive("text").alias("text"))


@register("p11_split_long", sql=f"""WITH {_SQL_SENTS},
j AS (SELECT doc_id, array_to_string(list(s ORDER BY pos) FILTER (WHERE s <> ''), ' ') AS joined FROM sk GROUP BY doc_id)
SELECT d.doc_id, md5(CASE WHEN len({T.sql_words('d.text')}) > 30 THEN coalesce(j.joined, '') ELSE {T.sql_collapse_ws('d.text')} END)
       AS clean_md5
FROM documents d LEFT JOIN j USING (doc_id)""")
def p11_split_long(spark, sf_dir):
    d = Tables(spark, sf_dir).documents
    return d.select("doc_id", F.md5(T.split_long("text")).alias("clean_md5"))


@register("p7_model_input", sql=f"""WITH
sp AS (SELECT item_id, unnest(regexp_split_to_array(text, '{_SENT}')) AS s,
              unnest(range(len(regexp_split_to_array(text, '{_SENT}')))) AS pos FROM benchmark),
sk AS (SELECT item_id, pos, {T.sql_py_strip('s')} AS s FROM sp),
ev AS (SELECT item_id, array_to_string(list(s ORDER BY pos), ' ') AS e FROM sk WHERE length(s) >= 6 GROUP BY item_id)
SELECT b.item_id, md5('[CLS] ' || b.text || ' [SEP]') AS text_input_md5,
       md5('[CLS] CLAIM: ' || b.text || ' [SEP] EVIDENCE: ' || coalesce(ev.e, '') || ' [SEP]') AS pair_input_md5
FROM benchmark b LEFT JOIN ev USING (item_id)""")
def p7_model_input(spark, sf_dir):
    b = Tables(spark, sf_dir).benchmark
    return b.select("item_id", F.md5(T.wrap_model_input("text")).alias("text_input_md5"),
                    F.md5(T.wrap_claim_evidence("text", sentence_array("text"))).alias("pair_input_md5"))


@register("p13_slug", sql="""SELECT item_id, left(regexp_replace(replace(lower('Stra' || chr(223) || 'e ' || text), chr(223), 'ss'), '[^a-z0-9]+', '', 'g'), 12) AS slug,
  left(regexp_replace(replace(lower(text), chr(223), 'ss'), '[^a-z0-9]+', '', 'g'), 12) AS plain_slug
FROM benchmark""")
def p13_slug(spark, sf_dir):
    return Tables(spark, sf_dir).benchmark.select("item_id", T.slug(F.concat(F.lit("Stra\u00dfe "), F.col("text"))).alias("slug"), T.slug("text").alias("plain_slug"))


_SEEN_SQL = """CASE WHEN value < 2 THEN NULL WHEN value < 5 THEN left(s, 7)
                    WHEN value < 8 THEN left(s, 6) || '00' || substr(s, 9) ELSE s END"""


@register("p14_parse_seen_date", sql=f"""WITH r AS (SELECT event_id, {_SEEN_SQL} AS seen
  FROM (SELECT event_id, value, strftime(ts, '%Y%m%d%H%M%S') AS s FROM events))
SELECT event_id, seen, CASE WHEN seen IS NULL OR length(seen) < 8 THEN ''
  ELSE coalesce(strftime(try_strptime(left(seen, 8), '%Y%m%d'), '%Y-%m-%d'), seen) END AS published_at FROM r""")
def p14_parse_seen_date(spark, sf_dir):
    """Seen-date strings derived from event times (null, short, impossible day and
    full forms by value band) parsed to ISO dates."""
    e = Tables(spark, sf_dir).events.select("event_id", "value",
                                            F.date_format("ts", "yyyyMMddHHmmss").alias("s"))
    seen = (F.when(F.col("value") < 2, F.lit(None).cast("string"))
            .when(F.col("value") < 5, F.left("s", F.lit(7)))
            .when(F.col("value") < 8, F.concat(F.left("s", F.lit(6)), F.lit("00"), F.substring("s", 9, 100)))
            .otherwise(F.col("s")))
    e = e.select("event_id", seen.alias("seen"))
    return e.select("event_id", "seen", T.parse_seen_date("seen").alias("published_at"))


@register("p15_url_parts", sql=r"""
SELECT page_id, url,
       regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS authority,
       regexp_extract(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^(?:[^@]*@)?([^:]*)', 1) AS host,
       regexp_extract(url, 'http[s?]://(.*?)/', 1) AS pattern_host,
       'https://en.wikipedia.org/wiki/' || replace(regexp_extract(html, '<title>(.*?)</title>', 1), ' ', '_') AS page_url
FROM pages""")
def p15_url_parts(spark, sf_dir):
    p = Tables(spark, sf_dir).pages
    title = F.regexp_extract("html", r"<title>(.*?)</title>", 1)
    return p.select("page_id", "url", T.url_authority("url").alias("authority"), T.url_host("url").alias("host"),
                    T.host_by_pattern("url").alias("pattern_host"), T.build_page_url(title).alias("page_url"))


@register("p16_map_label", sql="""
SELECT doc_id, 'LABEL_' || CAST(quality + 2 * toxic AS VARCHAR) AS raw_label,
       CASE 'LABEL_' || CAST(quality + 2 * toxic AS VARCHAR) WHEN 'LABEL_0' THEN 'SUPPORTS' WHEN 'LABEL_1' THEN 'REFUTES'
            WHEN 'LABEL_2' THEN 'NOT ENOUGH INFO' ELSE 'LABEL_' || CAST(quality + 2 * toxic AS VARCHAR) END AS label,
       CASE quality + 2 * toxic WHEN 0 THEN 'SUPPORTS' WHEN 1 THEN 'REFUTES' WHEN 2 THEN 'NOT ENOUGH INFO' ELSE 'ERROR - WHAT?!?' END AS label_by_digit,
       CAST(CASE WHEN quality + 2 * toxic < 3 THEN quality + 2 * toxic END AS INTEGER) AS label_id,
       CASE WHEN quality + 2 * toxic = 1 THEN 'Claim' ELSE 'Opinion' END AS claim_label
FROM labels""")
def p16_map_label(spark, sf_dir):
    lab = Tables(spark, sf_dir).labels
    raw = F.concat(F.lit("LABEL_"), (F.col("quality") + 2 * F.col("toxic")).cast("string"))
    return lab.select("doc_id", raw.alias("raw_label"), T.map_label(raw).alias("label"), T.map_label_by_digit(raw).alias("label_by_digit"),
                      T.label_id(T.map_label(raw)).alias("label_id"), T.claim_label(raw).alias("claim_label"))


@register("p17_stable_text_id", sql=f"""
SELECT doc_id, md5({T.sql_collapse_ws('text')}) AS text_id,
       source || '_chunk_' || lpad(CAST(doc_id AS VARCHAR), CAST(greatest(4, length(CAST(doc_id AS VARCHAR))) AS INTEGER), '0') AS page_chunk_id,
       source || '_chunk_' || CAST(doc_id + 10000 AS VARCHAR) AS long_chunk_id FROM documents""")
def p17_stable_text_id(spark, sf_dir):
    d = Tables(spark, sf_dir).documents
    return d.select("doc_id", F.md5(T.collapse_ws("text")).alias("text_id"),
                    T.page_chunk_id("source", "doc_id").alias("page_chunk_id"),
                    T.page_chunk_id("source", F.col("doc_id") + 10000).alias("long_chunk_id"))


@register("p18_reshape", sql="""
SELECT doc_id AS id, CASE WHEN quality = 1 THEN 'claim' ELSE 'other' END AS label, quality AS label_id,
       'labels' AS origin FROM labels""")
def p18_reshape(spark, sf_dir):
    lab = Tables(spark, sf_dir).labels
    return (lab.withColumnsRenamed({"doc_id": "id", "quality": "label_id"}).drop("toxic")
            .withColumn("label", F.when(F.col("label_id") == 1, "claim").otherwise("other"))
            .withColumn("origin", F.lit("labels")).select("id", "label", "label_id", "origin"))


@register("f1_min_length_gate", sql=f"""WITH {_SQL_SENTS},
n AS (SELECT doc_id, count(*) FILTER (WHERE length(s) >= 11) AS n_scorable FROM sk GROUP BY doc_id)
SELECT d.doc_id, length({T.sql_py_strip('d.text')}) < 5 AS insufficient, coalesce(n.n_scorable, 0) AS n_scorable
FROM documents d LEFT JOIN n USING (doc_id)""")
def f1_min_length_gate(spark, sf_dir):
    d = Tables(spark, sf_dir).documents
    return d.select("doc_id", (F.char_length(T.py_strip("text")) < 5).alias("insufficient"),
                    F.size(sentence_array("text", 11)).cast("bigint").alias("n_scorable"))


@register("f2_length_band", sql="SELECT doc_id, length(text) AS n FROM documents WHERE length(text) > 132 AND length(text) < 2067")
def f2_length_band(spark, sf_dir):
    d = Tables(spark, sf_dir).documents
    n = F.char_length("text").cast("bigint")
    return d.where((n > 132) & (n < 2067)).select("doc_id", n.alias("n"))


@register("f10_drop_duplicate_text", sql="""
SELECT doc_id, md5(text) AS text_md5 FROM (
  SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1""")
def f10_drop_duplicate_text(spark, sf_dir):
    from factlens.operators.filters import drop_duplicate_text

    d = drop_duplicate_text(Tables(spark, sf_dir).documents, "text", "doc_id")
    return d.select("doc_id", F.md5("text").alias("text_md5"))


@register("u6_explode_labels", sql="""
SELECT event_id, label FROM (
  SELECT event_id, unnest(list_distinct([event_type, 'k' || CAST(CAST(floor(CAST(json_extract(props, '$.k') AS DOUBLE) / 25) AS BIGINT) AS VARCHAR)])) AS label
  FROM events) WHERE label IS NOT NULL""")
def u6_explode_labels(spark, sf_dir):
    e = Tables(spark, sf_dir).events
    k = F.get_json_object("props", "$.k").cast("double")
    band = F.concat(F.lit("k"), F.floor(k / 25).cast("bigint").cast("string"))
    return (e.select("event_id", F.array_distinct(F.array("event_type", band)).alias("labels"))
            .select("event_id", F.explode("labels").alias("label")).where(F.col("label").isNotNull()))


def _answers(events):
    """5W1H answers about the events: whole, inside prose, cut off, or with other fields."""
    user, what = F.col("user_id").cast("string"), F.col("event_type")
    k = F.col("event_id") % 4
    text = (F.when(k == 0, F.concat(F.lit('{"who": "user '), user, F.lit('", "what": "'), what, F.lit('"}')))
            .when(k == 1, F.concat(F.lit('assistant\nHere: {"who":\n"user '), user, F.lit('"} done')))
            .when(k == 2, F.concat(F.lit('{"what": "'), what, F.lit('", "who": ')))
            .otherwise(F.concat(F.lit('{"why": null, "what": "'), what, F.lit('"}'))))
    return events.select(F.concat(F.lit("w"), F.col("event_id").cast("string")).alias("response_id"), text.alias("response"))


@register("u9_first_responses", sql=f"""
SELECT 'w' || CAST(event_id AS VARCHAR) AS response_id, CASE WHEN event_id % 4 IN (0, 1) THEN 'user ' || user_id END AS who,
       CASE WHEN event_id % 4 IN (0, 3) THEN event_type END AS what
FROM events WHERE event_id % 4 <> 2 ORDER BY response_id LIMIT 25""")
def u9_first_responses(spark, sf_dir):
    """The first 25 answers that parse (the stop after N successes is the feature)."""
    r = RSP.parse_responses(_answers(Tables(spark, sf_dir).events), "response", keep_first=25, order_col="response_id")
    return r.select("response_id", "who", "what")


@register("u9_parse_responses", sql=r"""
WITH r AS (SELECT 'e' || CAST(event_id AS VARCHAR) AS response_id, props AS response FROM events
           UNION ALL SELECT 'c' || CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR), text FROM conversations
           WHERE role = 'assistant'
           UNION ALL SELECT 'w' || CAST(event_id AS VARCHAR), CASE event_id % 4
             WHEN 0 THEN '{"who": "user ' || user_id || '", "what": "' || event_type || '"}'
             WHEN 1 THEN 'assistant' || chr(10) || 'Here: {"who":' || chr(10) || '"user ' || user_id || '"} done'
             WHEN 2 THEN '{"what": "' || event_type || '", "who": ' ELSE '{"why": null, "what": "' || event_type || '"}' END FROM events),
n AS (SELECT response_id, response, __STRIP__ AS t FROM r),
c AS (SELECT *, CASE WHEN json_valid(t) AND left(t, 1) = '{' THEN t
                     WHEN json_valid(regexp_extract(regexp_replace(t, '^assistant', ''), '(?s)\{.*\}'))
                          AND regexp_extract(regexp_replace(t, '^assistant', ''), '(?s)\{.*\}') <> ''
                     THEN regexp_extract(regexp_replace(t, '^assistant', ''), '(?s)\{.*\}') END AS js FROM n)
SELECT response_id, js IS NOT NULL AS parsed,
       json_extract_string(js, '$.who') AS who, json_extract_string(js, '$.what') AS what,
       CASE WHEN js IS NULL THEN response END AS raw
FROM c""".replace("__STRIP__", T.sql_py_strip("replace(response, chr(10), ' ')")))
def u9_parse_responses(spark, sf_dir):
    """Event property payloads (JSON) and assistant turns (prose) parsed as model
    responses: JSON object fields, else the raw text."""
    t = Tables(spark, sf_dir)
    r = (t.events.select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("response_id"),
                         F.col("props").alias("response"))
         .unionByName(t.conversations.where(F.col("role") == "assistant").select(
             F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string"))
             .alias("response_id"), F.col("text").alias("response")))
         .unionByName(_answers(t.events)))
    p = RSP.parse_responses(r, "response")
    return p.select("response_id", "parsed", "who", "what", "raw")


@register("p9_nfkd")
def p9_nfkd(spark, sf_dir):
    """Documents in NFKD form (accented letters decomposed)."""
    d = Tables(spark, sf_dir).documents
    n = T.nfkd("text")
    return d.select("doc_id", F.char_length(n).cast("bigint").alias("nfkd_len"), F.md5(n).alias("nfkd_md5"))


def _profile_sql(name: str) -> tuple[str, dict[str, str]]:
    """(cleaned text, matches per counter) of a profile over ``text`` in DuckDB."""
    spell = {"handles_masked": (T.TOPIC_HANDLE_RE, T.sql_unmask_topic_handles), "mentions_masked": (T.MENTION_RE, T.sql_mask_mentions),
             "lines_joined": ("\n+", T.sql_collapse_newlines), "possessives_cut": (T.POSSESSIVE_RE, T.sql_strip_possessive)}
    e, found = "text", {}
    for step in CL.PROFILES[name]:
        pattern, rule = spell.get(step.counter, (T.URL_RE, T.sql_drop_urls if step is CL.DROP_URLS else T.sql_mask_urls))
        found[step.counter] = f"len(regexp_extract_all({e}, '" + pattern.replace("'", "''") + "'))"
        e = rule(e)
    return e, found


def _clean_sql(name: str, columns: str) -> str:
    e, found = _profile_sql(name)
    counts = ", ".join(f"CAST({found.get(c, '0')} AS BIGINT) AS {c}" for c in CL.COUNTERS)
    return f"SELECT '{name}' AS profile, {columns} FROM (SELECT doc_id, text, {e} AS clean, {counts} FROM posts)"


@register("p_clean_posts", sql=f"WITH {POSTS_SQL} " + " UNION ALL ".join(
    _clean_sql(n, "doc_id, md5(clean) AS clean_md5, " + ", ".join(CL.COUNTERS)) for n in CL.PROFILES))
def p_clean_posts(spark, sf_dir):
    """Every post under every profile: digest of the cleaned text and the row's own counts."""
    out = None
    for name in CL.PROFILES:
        x = CL.clean_posts(posts(spark, sf_dir), name, counts=True)
        x = x.select(F.lit(name).alias("profile"), "doc_id", F.md5("clean_text").alias("clean_md5"), *CL.COUNTERS)
        out = x if out is None else out.unionByName(x)
    return out


@register("p_clean_posts_counters", sql=f"WITH {POSTS_SQL} " + " UNION ALL ".join(
    _clean_sql(n, "count(*) AS rows, count(*) FILTER (clean IS DISTINCT FROM text) AS rows_changed, "
               + ", ".join(f"sum({c})::BIGINT AS {c}" for c in CL.COUNTERS)) for n in CL.PROFILES))
def p_clean_posts_counters(spark, sf_dir):
    """The counters of the four cleaning jobs, observed while the cleaned posts are written."""
    return CL.clean_all(posts(spark, sf_dir), "doc_id", "text", scratch_path(spark, "clean-posts"))
