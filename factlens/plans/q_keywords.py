"""Registered queries: annotator, keywords, keyword search and back-off, pronoun
resolution (M1, M2, J7, J8, W6, W7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from factlens.operators import annotate as AN
from factlens.operators import coref as CR
from factlens.operators import inverted as INV
from factlens.operators import keywords as KW
from factlens.plans.catalog import register
from factlens.sources.tables import Tables


def _q(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def annot_sql(src: str, id_col: str, text_col: str, p: str = "a") -> str:
    """DuckDB spelling of the default annotator: {p}_tok and {p}_ent CTEs."""
    tre = AN.TOKEN_RE.replace("'", "''")
    pron = _q(AN.PRONOUN_CLASSES)
    stop = _q(AN.STOP_WORDS)
    return f"""
{p}_src AS (SELECT {id_col} AS doc_id, {text_col} AS text FROM {src}),
{p}_arr AS (SELECT doc_id, regexp_extract_all(text, '{tre}') AS toks, string_split_regex(text, '{tre}') AS gaps FROM {p}_src),
{p}_u AS (SELECT doc_id, unnest(toks) AS text, unnest(list_slice(gaps, 1, len(toks))) AS g,
                 unnest(range(len(toks))) AS tok_i FROM {p}_arr),
{p}_t0 AS (SELECT doc_id, CAST(tok_i AS INTEGER) AS tok_i, text,
                  CAST(sum(length(g) + length(text)) OVER (PARTITION BY doc_id ORDER BY tok_i ROWS UNBOUNDED PRECEDING)
                       - length(text) AS INTEGER) AS char_idx,
                  lower(text) AS low, lag(text) OVER (PARTITION BY doc_id ORDER BY tok_i) AS prev,
                  substr(text, 1, 1) = upper(substr(text, 1, 1)) AND substr(text, 1, 1) <> lower(substr(text, 1, 1)) AS is_title,
                  regexp_full_match(text, '\\p{{L}}+') AS is_alpha FROM {p}_u),
{p}_tok AS (SELECT doc_id, tok_i, char_idx, text, low AS lemma, list_contains({stop}, low) AS is_stop, is_alpha, is_title,
                   CASE WHEN list_contains({pron}, low) THEN 'PRON'
                        WHEN regexp_full_match(text, '[0-9]+') THEN 'NUM'
                        WHEN NOT regexp_matches(text, '[\\p{{L}}\\p{{N}}]') THEN 'PUNCT'
                        WHEN is_title AND NOT list_contains({stop}, low) AND prev IS NOT NULL
                             AND prev NOT IN ('.', '!', '?') THEN 'PROPN'
                        WHEN is_alpha AND len(list_filter({_q(AN.VERB_ENDINGS)}, lambda s: ends_with(low, s))) > 0 THEN 'VERB'
                        ELSE 'NOUN' END AS pos FROM {p}_t0),
{p}_c AS (SELECT doc_id, tok_i, text, is_title AND is_alpha AND NOT is_stop AS cap FROM {p}_tok),
{p}_r AS (SELECT *, tok_i - sum(CAST(cap AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY tok_i ROWS UNBOUNDED PRECEDING) AS run
          FROM {p}_c),
{p}_e0 AS (SELECT doc_id, run, min(tok_i) AS start_tok, max(tok_i) + 1 AS end_tok,
                  string_agg(text, ' ' ORDER BY tok_i) AS text FROM {p}_r WHERE cap GROUP BY doc_id, run),
{p}_ent AS (SELECT doc_id, CAST(start_tok AS INTEGER) AS start_tok, CAST(end_tok AS INTEGER) AS end_tok, text,
                   CASE WHEN list_contains({_q(AN.GPE_NAMES)}, lower(text)) THEN 'GPE'
                        WHEN list_contains({_q(AN.ORG_SUFFIXES)}, lower(string_split(text, ' ')[-1])) THEN 'ORG'
                        WHEN len(list_filter({_q(AN.NORP_ENDINGS)}, lambda s: ends_with(lower(text), s))) > 0
                             AND NOT contains(text, ' ') THEN 'NORP'
                        ELSE 'PERSON' END AS label FROM {p}_e0)"""


def m1_sql(p: str = "a") -> str:
    ex = _q(AN.default_exclusions())
    return f""",
{p}_ke AS (SELECT doc_id, trim(text) AS keyword, start_tok AS pos FROM {p}_ent
          WHERE label IN {tuple(KW.KEYWORD_ENTITY_LABELS)} AND length(trim(text)) > 1
            AND NOT list_contains({ex}, lower(trim(text)))),
{p}_kb0 AS (SELECT doc_id, lower(lemma) AS k, arg_min(lemma, tok_i) AS keyword, min(tok_i) AS pos FROM {p}_tok
           WHERE pos IN {tuple(KW.KEYWORD_POS)} AND length(text) > 3 AND NOT is_stop AND is_alpha
             AND NOT list_contains({ex}, lower(text)) GROUP BY doc_id, lower(lemma)),
{p}_kb AS (SELECT doc_id, keyword, pos FROM {p}_kb0 b
          WHERE NOT EXISTS (SELECT 1 FROM {p}_ke e WHERE e.doc_id = b.doc_id AND lower(e.keyword) = b.k)),
{p}_kw AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY o, pos) - 1 AS INTEGER) AS kw_idx,
                 keyword, kind FROM (SELECT doc_id, keyword, pos, 0 AS o, 'entity' AS kind FROM {p}_ke
                                     UNION ALL SELECT doc_id, keyword, pos, 1, 'word' FROM {p}_kb))"""


@register("m1_extract_keywords", sql="WITH " + annot_sql("benchmark", "item_id", "text") + m1_sql() + """
SELECT doc_id, kw_idx, keyword, kind FROM a_kw""")
def m1_extract_keywords(spark, sf_dir):
    """The tables of tokens and entities, as any annotator gives them."""
    return _claim_keywords(spark, sf_dir)


@register("m1_document_keywords", sql="WITH " + annot_sql("documents", "doc_id", "text") + m1_sql() + """
SELECT doc_id, count(*) AS n_keywords, count(*) FILTER (WHERE kind = 'entity') AS n_entities,
       md5(string_agg(keyword, '|' ORDER BY kw_idx)) AS keywords_md5 FROM a_kw GROUP BY doc_id""")
def m1_document_keywords(spark, sf_dir):
    """One scan of the documents, no shuffle."""
    kw = KW.document_keywords(AN.annotate_rows(Tables(spark, sf_dir).documents)).where(F.size("keywords") > 0)
    return kw.select("doc_id", F.size("keywords").cast("bigint").alias("n_keywords"),
                     F.size(F.filter("keywords", lambda k: k["kind"] == "entity")).cast("bigint").alias("n_entities"),
                     F.md5(F.array_join(F.transform("keywords", lambda k: k["keyword"]), "|")).alias("keywords_md5"))


@register("m2_search_queries", sql="WITH " + annot_sql("benchmark", "item_id", "text") + f""",
q AS (SELECT doc_id, text AS term, 0 AS o, start_tok AS pos FROM a_ent WHERE label IN {tuple(KW.QUERY_ENTITY_LABELS)}
      UNION ALL SELECT doc_id, lower(lemma), 1, tok_i FROM a_tok WHERE pos = 'VERB' AND length(text) > 3)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY o, pos) - 1 AS INTEGER) AS q_idx, term FROM q""")
def m2_search_queries(spark, sf_dir):
    b = Tables(spark, sf_dir).benchmark
    toks, ents = AN.annotate(b, "item_id", "text")
    return KW.search_queries(toks, ents)


def _claim_keywords(spark, sf_dir):
    b = Tables(spark, sf_dir).benchmark
    toks, ents = AN.annotate(b, "item_id", "text")
    return KW.extract_keywords(toks, ents)


SEARCH_SQL = """,
ct AS (SELECT DISTINCT claim_id, {levelsel} term FROM (
         SELECT k.doc_id AS claim_id, {levelsel2} unnest(string_split(lower(k.keyword), ' ')) AS term
         FROM a_kw k {levelsjoin})),
need AS (SELECT claim_id, {levelsel} count(*) AS n FROM ct GROUP BY ALL),
dt AS (SELECT doc, term, count(*) AS tf FROM (
         SELECT doc_id AS doc, unnest(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS term FROM documents)
       WHERE term <> '' AND term IN (SELECT term FROM ct) GROUP BY ALL),
hits AS (SELECT ct.claim_id, {levelsel3} dt.doc, count(*) AS m, sum(dt.tf) AS score FROM ct JOIN dt USING (term)
         GROUP BY ALL),
ok AS (SELECT h.* FROM hits h JOIN need n ON n.claim_id = h.claim_id {levelcond} WHERE h.m = n.n),
ranked AS (SELECT claim_id, {levelsel} doc, score,
                  row_number() OVER (PARTITION BY claim_id {levelpart} ORDER BY score DESC, doc) AS rank FROM ok)"""


def _search_sql(levels: bool) -> str:
    if not levels:
        return SEARCH_SQL.format(levelsel="", levelsel2="", levelsjoin="WHERE k.kw_idx < 3", levelsel3="",
                                 levelcond="", levelpart="")
    return SEARCH_SQL.format(levelsel="level,", levelsel2="lv.level AS level,",
                             levelsjoin="JOIN lv ON k.kw_idx < lv.n_words", levelsel3="ct.level,",
                             levelcond="AND n.level = h.level", levelpart=", level")


def document_index(spark, sf_dir):
    """The stored index of the documents (what an ingest job maintains), with their language as scope."""
    return INV.build(Tables(spark, sf_dir).documents, scope=("lang",))


def _first_terms(spark, sf_dir, n):
    kw = _claim_keywords(spark, sf_dir).where(F.col("kw_idx") < n)
    return kw.select(F.col("doc_id").alias("claim_id"), F.explode(F.split(F.lower("keyword"), " ")).alias("term"))


def _hits(r, *more):
    return r.select("claim_id", *more, "doc", F.col("score").cast("bigint"), F.col("rank").cast("int"))


@register("j7_keyword_search", sql="WITH " + annot_sql("benchmark", "item_id", "text") + m1_sql() + _search_sql(False) + """
SELECT claim_id, doc, CAST(score AS BIGINT) AS score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 5""")
def j7_keyword_search(spark, sf_dir):
    """AND of the words of each claim's first three keywords, over the stored index; top 5."""
    return _hits(INV.search(document_index(spark, sf_dir), _first_terms(spark, sf_dir, 3), ["claim_id"], 5))


@register("j7_keyword_search_scoped", sql="WITH " + annot_sql("benchmark", "item_id", "text") + m1_sql()
          + _search_sql(False).replace("FROM documents)", "FROM documents WHERE lang = 'en')") + """
SELECT claim_id, doc, CAST(score AS BIGINT) AS score, CAST(rank AS INTEGER) AS rank FROM ranked""")
def j7_keyword_search_scoped(spark, sf_dir):
    """The same within the English documents, every hit."""
    return _hits(INV.search(document_index(spark, sf_dir), _first_terms(spark, sf_dir, 3), ["claim_id"], scope=F.col("lang") == "en"))


def _levels_sql(levels):
    return "lv AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {n}, {lim})" for i, (n, lim) in enumerate(levels)) + ") t(level, n_words, lim))"


def _backoff_sql(levels):
    return "WITH " + annot_sql("benchmark", "item_id", "text") + m1_sql() + ",\n" + _levels_sql(levels) + _search_sql(True) + """,
lim AS (SELECT r.* FROM ranked r JOIN lv USING (level) WHERE r.rank <= lv.lim),
best AS (SELECT claim_id, min(level) AS level FROM lim GROUP BY claim_id)
SELECT claim_id, CAST(level AS INTEGER) AS level, doc, CAST(score AS BIGINT) AS score, CAST(rank AS INTEGER) AS rank
FROM lim JOIN best USING (claim_id, level)"""


def _backoff(spark, sf_dir, levels):
    r = KW.keyword_backoff(_claim_keywords(spark, sf_dir), document_index(spark, sf_dir), levels)
    return _hits(r, F.col("level").cast("int"))


@register("j8_keyword_backoff", sql=_backoff_sql(KW.NEWS_LEVELS))
def j8_keyword_backoff(spark, sf_dir):
    return _backoff(spark, sf_dir, KW.NEWS_LEVELS)


@register("j8_keyword_backoff_index", sql=_backoff_sql(KW.INDEX_LEVELS))
def j8_keyword_backoff_index(spark, sf_dir):
    return _backoff(spark, sf_dir, KW.INDEX_LEVELS)


@register("j8_keyword_backoff_wiki", sql=_backoff_sql(KW.WIKI_LEVELS))
def j8_keyword_backoff_wiki(spark, sf_dir):
    return _backoff(spark, sf_dir, KW.WIKI_LEVELS)


# every third conversation opens with entities of other kinds than names of persons, and pronouns for them
OPENING = "Maria Lopez left Acme Corp for Paris. It thanked her. Many Americans met Bob Stone; they saw him. "
CONV_SQL = f"(SELECT conv_id || ':' || turn AS doc_id, CASE WHEN conv_id % 3 = 0 THEN '{OPENING}' ELSE '' END || text AS text FROM conversations)"


def _turns(spark, sf_dir):
    opening = F.when(F.col("conv_id") % 3 == 0, OPENING).otherwise("")
    return Tables(spark, sf_dir).conversations.select(F.concat_ws(":", "conv_id", "turn").alias("doc_id"), F.concat(opening, "text").alias("text"))


_APOS_S = "''s"  # SQL literal body for 's


def coref_ctes(src: str, rule: str, p: str = "a") -> str:
    """DuckDB spelling of W6 / W7 over the SQL annotator: CTE {p}_resolved (doc_id, n, text) of ``src`` (doc_id, text)."""
    from factlens.functions.text import POSSESSIVE_RE

    labels = ("PERSON", "ORG", "GPE", "NORP")
    lasts = ",\n".join(
        f"last_value(CASE WHEN label = '{lab}' THEN etext END IGNORE NULLS) OVER w AS l_{lab.lower()}" for lab in labels)
    singular = sorted({c for c in AN.PRONOUN_CLASSES.values() if "NORP" not in c})
    nears = ",\n".join(
        "last_value(CASE WHEN label IN (" + ", ".join(f"'{x}'" for x in c) + f") THEN etext END IGNORE NULLS)"
        f" OVER w AS n_{i}" for i, c in enumerate(singular))
    cases = []
    for pron, classes in AN.PRONOUN_CLASSES.items():
        if rule == "priority" or "NORP" in classes:
            e = "coalesce(" + ", ".join(f"l_{c.lower()}" for c in classes) + ")"
        else:
            e = f"n_{singular.index(classes)}"
        cases.append(f"WHEN '{pron}' THEN {e}")
    poss = _q(AN.POSSESSIVE_PRONOUNS)
    poss_re = POSSESSIVE_RE.replace("'", "''")
    return annot_sql(src, "doc_id", "text", p) + f""",
{p}_tl AS (SELECT doc_id, tok_i AS p, 1 AS k, tok_i, char_idx, text, NULL::VARCHAR AS label, NULL::VARCHAR AS etext
       FROM {p}_tok WHERE pos = 'PRON' AND list_contains({_q(AN.PRONOUN_CLASSES)}, lower(text))
       UNION ALL SELECT doc_id, end_tok, 0, NULL, NULL, NULL, label, regexp_replace(text, '{poss_re}', '\\1') FROM {p}_ent),
{p}_lw AS (SELECT *, {lasts},
       {nears}
       FROM {p}_tl WINDOW w AS (PARTITION BY doc_id ORDER BY p, k, tok_i NULLS FIRST
                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
{p}_r0 AS (SELECT doc_id, tok_i, char_idx, text, CASE lower(text) {" ".join(cases)} END AS rep FROM {p}_lw WHERE k = 1),
{p}_r1 AS (SELECT *, CASE WHEN list_contains({poss}, lower(text)) AND NOT ends_with(rep, '{_APOS_S}')
                      THEN rep || '{_APOS_S}' ELSE rep END AS r
       FROM {p}_r0 WHERE rep IS NOT NULL),
{p}_r2 AS (SELECT doc_id, char_idx, length(text) AS len,
              CASE WHEN substr(text, 1, 1) = upper(substr(text, 1, 1)) AND substr(text, 1, 1) <> lower(substr(text, 1, 1))
                   THEN upper(substr(r, 1, 1)) || substr(r, 2) ELSE r END AS r FROM {p}_r1),
{p}_pc AS (SELECT *, coalesce(lag(char_idx + len) OVER (PARTITION BY doc_id ORDER BY char_idx), 0) AS prev_end FROM {p}_r2),
{p}_pieces AS (SELECT pc.doc_id, string_agg(substr(c.text, pc.prev_end + 1, pc.char_idx - pc.prev_end) || pc.r, ''
                                        ORDER BY pc.char_idx) AS body, max(pc.char_idx + pc.len) AS last_end,
                  count(*) AS n FROM {p}_pc pc JOIN {src} c USING (doc_id) GROUP BY pc.doc_id),
{p}_resolved AS (SELECT c.doc_id, CAST(coalesce(p.n, 0) AS INTEGER) AS n, CASE WHEN p.doc_id IS NULL THEN c.text ELSE p.body || substr(c.text, p.last_end + 1) END AS text
       FROM {src} c LEFT JOIN {p}_pieces p USING (doc_id))"""


def coref_sql(rule: str) -> str:
    return "WITH " + coref_ctes(CONV_SQL, rule) + " SELECT doc_id, n AS n_replaced, md5(text) AS resolved_md5 FROM a_resolved"


@register("w6_resolve_pronouns", sql=coref_sql("priority"))
def w6_resolve_pronouns(spark, sf_dir):
    """Conversation turns with the default annotator; priority rule."""
    c = _turns(spark, sf_dir)
    toks, ents = AN.annotate(c)
    r = CR.resolve_pronouns(c, toks, ents)
    return r.select("doc_id", F.col("n_replaced").cast("int"), F.md5("resolved_text").alias("resolved_md5"))


@register("w7_resolve_pronouns_nearest", sql=coref_sql("nearest"))
def w7_resolve_pronouns_nearest(spark, sf_dir):
    c = _turns(spark, sf_dir)
    toks, ents = AN.annotate(c)
    r = CR.resolve_pronouns(c, toks, ents, rule="nearest")
    return r.select("doc_id", F.col("n_replaced").cast("int"), F.md5("resolved_text").alias("resolved_md5"))
