"""Evidence-set build: U4 explode_evidence_refs, U5 extract_titles, J1 resolve_evidence,
J2 merge_on_id, A17 distinct_pages.

Reference strings look like ``<page title>_sentence_<n>``; titles may themselves
contain ``_``, so they are matched from the right. Other evidence kinds (cells,
captions) are skipped. Resolution is one equi-join of the references with the
sentences of the page store on (page, sentence), so no row carries a page and a hot
page is spread over its sentences; a missing page or sentence drops that reference
and is counted, it does not fail the job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factlens.functions.text import py_strip, strip_wiki_links, title_to_page

SENTENCE_REF_RE = r"^(.*)_sentence_([0-9]+)$"
# Typed suffixes of evidence references.
TYPED_REF_RE = r"^(.*)_(?:sentence|cell|header_cell|table_caption|item)_[0-9_]+$"

EVIDENCE_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("claim", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("challenge", T.StringType()),
    T.StructField("evidence", T.ArrayType(T.StructType([
        T.StructField("content", T.ArrayType(T.StringType())),
        T.StructField("context", T.StringType()),
    ]))),
])


def explode_evidence_refs(raw: DataFrame) -> DataFrame:
    """U4: ``id, ev_idx, c_idx, page, sentence_key`` for every sentence reference."""
    e = raw.select("id", F.posexplode_outer("evidence").alias("ev_idx", "ev")).where(F.col("ev").isNotNull())
    c = e.select("id", "ev_idx", F.posexplode_outer("ev.content").alias("c_idx", "ref")).where(F.col("ref").isNotNull())
    m = c.where(F.col("ref").rlike(SENTENCE_REF_RE))
    return m.select("id", "ev_idx", "c_idx", F.regexp_extract("ref", SENTENCE_REF_RE, 1).alias("page"),
                    F.concat(F.lit("sentence_"), F.regexp_extract("ref", SENTENCE_REF_RE, 2)).alias("sentence_key"))


def extract_titles(raw: DataFrame) -> DataFrame:
    """Per claim the titles of the first reference of each evidence entry (text
    before the typed suffix, stripped), distinct in first-seen order, and the
    matching page names (spaces -> underscores)."""
    firsts = F.transform(F.filter("evidence", lambda ev: F.size(ev["content"]) > 0),
                         lambda ev: py_strip(F.regexp_extract(ev["content"][0], TYPED_REF_RE, 1)))
    titles = F.array_distinct(F.filter(firsts, lambda t: t != ""))
    out = raw.select("id", titles.alias("titles"))
    return out.select("id", "titles", F.transform("titles", lambda t: title_to_page(t)).alias("pages"))


def resolve_evidence(raw: DataFrame, wiki: DataFrame) -> DataFrame:
    """``id, claim, label, challenge, evidence`` with evidence = resolved sentence
    texts (wiki links stripped) in reference order; claims left without any
    resolved sentence are dropped (F5). ``wiki``: id (page), sentences MAP."""
    sents = wiki.select(F.col("id").alias("page"), F.explode_outer("sentences").alias("sentence_key", "s"))
    j = explode_evidence_refs(raw).join(sents.where(F.col("s").isNotNull()), ["page", "sentence_key"])
    ev = j.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("ev_idx", "c_idx", strip_wiki_links("s").alias("s"))))
                             .alias("_e"))
    ev = ev.select("id", F.col("_e")["s"].alias("evidence"))
    return raw.drop("evidence").join(ev, "id").where(F.size("evidence") > 0)


def unresolved_count(raw: DataFrame, wiki: DataFrame) -> DataFrame:
    """References whose page or sentence is missing (reported instead of failing)."""
    refs = explode_evidence_refs(raw)
    j = refs.join(wiki.select(F.col("id").alias("page"), "sentences"), "page", "left")
    miss = F.col("sentences").isNull() | F.element_at("sentences", F.col("sentence_key")).isNull()
    return j.agg(F.count_if(F.col("sentences").isNull()).alias("missing_pages"),
                 F.count_if(miss).alias("missing_refs"))


def merge_on_id(left: DataFrame, right: DataFrame, require_nonempty: list[str] | None = None) -> DataFrame:
    """Inner join on ``id``; rows with an empty required array are dropped."""
    j = left.join(right, "id", "inner")
    for c in require_nonempty or []:
        j = j.where(F.size(c) > 0)
    return j


def distinct_pages(df: DataFrame, pages_col: str = "pages") -> DataFrame:
    """Every page referenced by the set, once."""
    return df.select(F.explode_outer(pages_col).alias("page")).where(F.col("page").isNotNull()).distinct()
