"""Keywords and keyword search: M1 extract_keywords, M2 search_queries,
J7 keyword_search, J8 keyword_backoff.

Over a stored corpus, searches run on an inverted index (``operators/inverted.py``). Over a
table that is searched once, keyword search is the same AND query written as joins:
claim keywords (few per claim) are semi-joined against the document term table so
only terms some claim asks for are kept; candidates come from each claim's rarest
keyword's posting list and are verified against the other keywords by an equi-join
on (doc, term). Intermediate size is bounded by (#keywords x candidates), never by
claims x documents, and hot terms are never the driving posting list unless every
keyword of a claim is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factlens.functions.text import py_strip
from factlens.operators import inverted as INV
from factlens.operators.annotate import default_exclusions
from factlens.operators.filters import date_window, domain_filter
from factlens.session import ensure_checkpoint_dir

# Entity labels and parts of speech that yield keywords.
KEYWORD_ENTITY_LABELS = ("PERSON", "ORG", "GPE", "EVENT", "PRODUCT", "NORP")
KEYWORD_POS = ("NOUN", "ADJ", "VERB")
QUERY_ENTITY_LABELS = ("PERSON", "ORG", "GPE", "EVENT")
# Back-off levels (words, result limit) per source.
NEWS_LEVELS = ((7, 5), (5, 3), (2, 3))
INDEX_LEVELS = ((5, 3), (3, 5))
WIKI_LEVELS = ((5, 1), (3, 1))


def _exclusion_df(spark, exclude):
    if exclude is None:
        exclude = default_exclusions()
    if isinstance(exclude, DataFrame):
        return exclude.select(F.lower(F.col(exclude.columns[0])).alias("_x")).distinct()
    return spark.createDataFrame([(w.lower(),) for w in exclude], "_x string").distinct()


def extract_keywords(tokens: DataFrame, entities: DataFrame, exclude=None) -> DataFrame:
    """M1: ``doc_id, kw_idx, keyword, kind``. Entities of the keyword labels (text
    stripped, longer than 1, not excluded) in order; then NOUN/ADJ/VERB lemmas of
    alphabetic non-stop tokens longer than 3 and not excluded, distinct
    case-insensitively (first occurrence), minus those equal to an entity."""
    spark = tokens.sparkSession
    ex = _exclusion_df(spark, exclude)
    ents = (entities.where(F.col("label").isin(*KEYWORD_ENTITY_LABELS))
            .select("doc_id", py_strip("text").alias("keyword"), F.col("start_tok").alias("_pos"))
            .where(F.char_length("keyword") > 1))
    ents = ents.join(ex, F.lower("keyword") == F.col("_x"), "left_anti")
    back = (tokens.where(F.col("pos").isin(*KEYWORD_POS) & (F.char_length("text") > 3) & ~F.col("is_stop")
                         & F.col("is_alpha"))
            .join(ex, F.lower("text") == F.col("_x"), "left_anti"))
    back = back.groupBy("doc_id", F.lower("lemma").alias("_k")).agg(
        F.min_by("lemma", "tok_i").alias("keyword"), F.min("tok_i").alias("_pos"))
    ent_keys = ents.select("doc_id", F.lower("keyword").alias("_k")).distinct()
    back = back.join(ent_keys, ["doc_id", "_k"], "left_anti").drop("_k")
    allk = (ents.withColumn("kind", F.lit("entity")).withColumn("_o", F.lit(0))
            .unionByName(back.withColumn("kind", F.lit("word")).withColumn("_o", F.lit(1))))
    w = Window.partitionBy("doc_id").orderBy("_o", "_pos")
    return allk.select("doc_id", (F.row_number().over(w) - 1).cast("int").alias("kw_idx"), "keyword", "kind")


def document_keywords(rows: DataFrame, exclude=None) -> DataFrame:
    """M1 over ``annotate_rows``: ``doc_id, keywords`` (keyword, kind in order), made document by document without a shuffle; the
    same as ``extract_keywords`` where lemmas are lower-case, as the default annotator's are. ``exclude`` is a list of words (a table of
    them goes through ``extract_keywords``)."""
    out = F.array(*(F.lit(w.lower()) for w in (default_exclusions() if exclude is None else exclude))).cast("array<string>")
    kept = lambda c: ~F.array_contains(out, F.lower(c))
    named = F.filter("ents", lambda e: e["label"].isin(*KEYWORD_ENTITY_LABELS))
    named = F.filter(F.transform(named, lambda e: py_strip(e["text"])), lambda t: (F.char_length(t) > 1) & kept(t))
    words = F.filter("toks", lambda t: t["pos"].isin(*KEYWORD_POS) & (F.char_length(t["text"]) > 3) & ~t["is_stop"] & t["is_alpha"] & kept(t["text"]))
    x = rows.select("doc_id", named.alias("named"), F.transform(words, lambda t: t["lemma"]).alias("lemmas"))
    words = F.array_except(F.transform("lemmas", F.lower), F.transform("named", F.lower))  # distinct, in first-seen order
    both = F.concat(F.transform("named", lambda t: F.struct(t.alias("keyword"), F.lit("entity").alias("kind"))),
                    F.transform(words, lambda t: F.struct(t.alias("keyword"), F.lit("word").alias("kind"))))
    return x.select("doc_id", both.alias("keywords"))


def search_queries(tokens: DataFrame, entities: DataFrame) -> DataFrame:
    """M2 (older form): PERSON/ORG/GPE/EVENT entity texts, then VERB lemmas (lower)
    of tokens longer than 3, no de-duplication."""
    e = entities.where(F.col("label").isin(*QUERY_ENTITY_LABELS)).select(
        "doc_id", F.col("text").alias("term"), F.lit(0).alias("_o"), F.col("start_tok").alias("_pos"))
    v = tokens.where((F.col("pos") == "VERB") & (F.char_length("text") > 3)).select(
        "doc_id", F.lower("lemma").alias("term"), F.lit(1).alias("_o"), F.col("tok_i").alias("_pos"))
    w = Window.partitionBy("doc_id").orderBy("_o", "_pos")
    return e.unionByName(v).select("doc_id", (F.row_number().over(w) - 1).cast("int").alias("q_idx"), "term")


def doc_terms(docs: DataFrame, id_col: str, text_col: str, vocab: DataFrame | None = None) -> DataFrame:
    """(doc, term, tf) with lower-cased letter/digit terms; with ``vocab`` (a ``term``
    column) only those terms are kept, before the aggregation."""
    toks = F.array_remove(F.split(F.lower(F.col(text_col)), r"[^\p{L}\p{N}]+", -1), "")
    t = (docs.select(F.col(id_col).alias("doc"), F.explode_outer(toks).alias("term"))
         .where(F.col("term").isNotNull()))
    if vocab is not None:
        t = t.join(vocab, "term", "left_semi")
    return (t.groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf")))


def keyword_search(claim_terms: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   limit: int | None = None, level_col: str | None = None, *, include=None, exclude=None, lang=None,
                   as_of=None, days_back: int = 30, url_col: str = "url", lang_col: str = "language",
                   ts_col: str = "published_at") -> DataFrame:
    """Documents containing ALL of a claim's terms (``claim_id, term`` rows,
    lower-case, optional level column for J8). Relevance = total term frequency;
    ``rank`` by relevance desc then doc; ``limit`` keeps the page size. The scope of the
    search is cut before any term is read: ``include`` / ``exclude`` domains and ``lang``
    (F8), and the ``days_back`` days up to ``as_of`` (F9).

    Output: claim_id, [level], doc, score, rank."""
    keys = ["claim_id"] + ([level_col] if level_col else [])
    docs = domain_filter(docs, url_col, include, exclude, lang, lang_col)
    docs = date_window(docs, ts_col, as_of, days_back) if as_of is not None else docs
    ensure_checkpoint_dir(docs.sparkSession)
    # claim terms and the (filtered) term table each feed several joins below; both
    # are small after the vocabulary filter, so they are materialised once.
    ct = claim_terms.select(*keys, F.lower("term").alias("term")).distinct().checkpoint(eager=True)
    need = ct.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    vocab = ct.select("term").distinct()
    dt = doc_terms(docs, id_col, text_col, vocab).checkpoint(eager=True)  # only asked-for terms
    df_ = dt.groupBy("term").agg(F.count(F.lit(1)).alias("_df"))
    rare = (ct.join(df_, "term")
            .withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("_df", "term")))
            .where("_r = 1").select(*keys, "term"))
    cand = rare.join(dt.select("term", "doc"), "term").select(*keys, "doc")
    hits = (cand.join(ct, keys).join(dt, ["doc", "term"])
            .groupBy(*keys, "doc").agg(F.count(F.lit(1)).alias("_m"), F.sum("tf").alias("score")))
    hits = hits.join(need, keys).where(F.col("_m") == F.col("_n")).drop("_m", "_n")
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "doc")
    out = hits.withColumn("rank", F.row_number().over(w))
    return out.where(F.col("rank") <= limit) if limit else out


def claim_level_terms(keywords: DataFrame, levels) -> DataFrame:
    """Leading keywords per back-off level: level L uses the words of the first n_L
    keywords. Output claim_id, level, term, lim."""
    lv = F.array(*[F.struct(F.lit(i).alias("level"), F.lit(n).alias("n_words"), F.lit(lim).alias("lim"))
                   for i, (n, lim) in enumerate(levels)])
    kw = keywords.select(F.col("doc_id").alias("claim_id"), "kw_idx",
                         F.explode(F.split(F.lower("keyword"), " ")).alias("term"))
    # each keyword word is repeated once per level it belongs to (a handful of levels)
    x = kw.select("claim_id", "kw_idx", "term", F.explode(lv).alias("l")).where(F.col("kw_idx") < F.col("l.n_words"))
    return x.select("claim_id", F.col("l.level").alias("level"), "term", F.col("l.lim").alias("lim"))


def keyword_backoff(keywords: DataFrame, docs: DataFrame | INV.InvertedIndex, levels=NEWS_LEVELS, id_col: str = "doc_id",
                    text_col: str = "text", scope=None) -> DataFrame:
    """All levels searched in one pass; per claim the first level with at least
    one hit wins, limited to that level's result count. ``docs`` is a table or a stored index (then ``scope`` may cut it)."""
    lt = claim_level_terms(keywords, levels).select("claim_id", "level", "term")
    # the largest page size bounds every level's ranking (partial top-k per task)
    most = max(lim for _, lim in levels)
    if isinstance(docs, INV.InvertedIndex):
        hits = INV.search(docs, lt, ["claim_id", "level"], most, scope)
    else:
        hits = keyword_search(lt, docs, id_col, text_col, limit=most, level_col="level")
    lim = F.element_at(F.array(*[F.lit(m) for _, m in levels]), F.col("level") + 1)
    hits = hits.where(F.col("rank") <= lim)
    best = hits.groupBy("claim_id").agg(F.min("level").alias("level"))
    return hits.join(best, ["claim_id", "level"])
