"""Registered queries: chunking and chunk-store operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from factlens.functions.text import chunk_id, sql_words
from factlens.operators import chunks as C
from factlens.plans.catalog import register
from factlens.plans.sqlparts import doc_chunks_cte, n_chunks_sql
from factlens.session import scratch_path
from factlens.sources.tables import Tables, spread


def doc_chunks(spark, sf_dir, size=C.LIVE_SIZE, overlap=C.LIVE_OVERLAP):
    """documents -> chunks with the store's own md5 ids and a document locator as url."""
    docs = Tables(spark, sf_dir).documents.select("doc_id", "text")
    ch = C.chunk_words(docs, ["doc_id"], "text", size, overlap)
    return ch.select("doc_id", F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("url"),
                     chunk_id(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")), "chunk_index").alias("chunk_id"),
                     "chunk_index", "content", "word_count", "total_chunks")


def articles(spark, sf_dir):
    """Documents as articles: url from the page with the same id (NULL when none)."""
    t = Tables(spark, sf_dir)
    p = t.pages.select(F.col("page_id").alias("doc_id"), "url")
    j = t.documents.join(p, "doc_id", "left").select(
        "doc_id", "url", F.col("source"), F.col("lang"), F.col("text").alias("full_content"))
    return spread(j)


ARTICLES_SQL = """articles AS (SELECT d.doc_id, p.url, d.source, d.lang, d.text AS full_content
                  FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id)"""


def _article_chunks_sql(src="articles", name="ac"):
    return f"""
{name}_w AS (SELECT url, source, {sql_words('full_content')} AS w FROM {src}
            WHERE url IS NOT NULL AND url <> '' AND full_content IS NOT NULL AND full_content <> ''),
{name}_n AS (SELECT url, source, w, {n_chunks_sql('len(w)', 64, 8)} AS total_chunks FROM {name}_w),
{name}_e AS (SELECT url, source, w, total_chunks, unnest(range(total_chunks)) AS i FROM {name}_n),
{name} AS (SELECT md5(url || '_' || CAST(i AS VARCHAR)) AS chunk_id, url, CAST(i AS INTEGER) AS chunk_index,
                CAST(total_chunks AS INTEGER) AS total_chunks, source,
                array_to_string(list_slice(w, i * 56 + 1, i * 56 + 64), ' ') AS content,
                CAST(len(list_slice(w, i * 56 + 1, i * 56 + 64)) AS INTEGER) AS word_count FROM {name}_e)"""


@register("u2_chunk_words", sql="WITH " + doc_chunks_cte(64, 8) + """
SELECT doc_id, chunk_index, content, word_count, total_chunks FROM chunks""")
def u2_chunk_words(spark, sf_dir):
    return doc_chunks(spark, sf_dir).select("doc_id", "chunk_index", "content", "word_count", "total_chunks")


@register("u2_chunk_words_256", sql="WITH " + doc_chunks_cte(256, 16) + """
SELECT doc_id, chunk_index, word_count, total_chunks, md5(content) AS content_md5 FROM chunks""")
def u2_chunk_words_256(spark, sf_dir):
    return doc_chunks(spark, sf_dir, C.DEFAULT_SIZE, C.DEFAULT_OVERLAP).select(
        "doc_id", "chunk_index", "word_count", "total_chunks", F.md5("content").alias("content_md5"))


def _article_chunks(spark, sf_dir):
    return C.chunk_articles(articles(spark, sf_dir))


@register("u3_chunk_articles", sql="WITH " + ARTICLES_SQL + "," + _article_chunks_sql() + """
SELECT chunk_id, url, chunk_index, total_chunks, source, word_count, md5(content) AS content_md5 FROM ac""")
def u3_chunk_articles(spark, sf_dir):
    return _article_chunks(spark, sf_dir).select(
        "chunk_id", "url", "chunk_index", "total_chunks", "source", "word_count",
        F.md5("content").alias("content_md5"))


@register("j3_new_urls_only", sql="WITH " + ARTICLES_SQL + "," + _article_chunks_sql("(SELECT * FROM articles WHERE lang = 'en')", "st") + """
SELECT a.doc_id, a.url FROM articles a
WHERE a.url IS NOT NULL AND NOT EXISTS (SELECT 1 FROM st WHERE st.url = a.url)""")
def j3_new_urls_only(spark, sf_dir):
    a = articles(spark, sf_dir)
    store = C.chunk_articles(a.where(F.col("lang") == "en"))
    return C.new_urls_only(a.where(F.col("url").isNotNull()), store).select("doc_id", "url")


@register("k3_append_chunks", sql="WITH " + ARTICLES_SQL + "," + _article_chunks_sql() + """
SELECT chunk_id, url, chunk_index, word_count, md5(content) AS content_md5 FROM ac""")
def k3_append_chunks(spark, sf_dir):
    """Store seeded with the English articles, then the whole batch (every article
    twice, so each url repeats inside the batch) appended twice: the store must end
    with each article's chunks exactly once."""
    a = articles(spark, sf_dir)
    path = scratch_path(spark, "chunk-store")
    C.append_chunks(spark, path, C.chunk_articles(a.where(F.col("lang") == "en")))
    batch = C.dedupe_articles(a.unionByName(a), ["doc_id"])
    for _ in range(2):
        C.append_chunks(spark, path, C.chunk_articles(batch))
    return spark.read.parquet(path).select("chunk_id", "url", "chunk_index", "word_count",
                                           F.md5("content").alias("content_md5"))


@register("a13_store_stats", sql="WITH " + ARTICLES_SQL + "," + _article_chunks_sql() + """
SELECT count(*) AS total_chunks, count(DISTINCT url) AS unique_articles,
       CASE WHEN count(DISTINCT url) > 0 THEN round(count(*) / count(DISTINCT url), 6) ELSE 0.0 END
       AS avg_chunks_per_article FROM ac""")
def a13_store_stats(spark, sf_dir):
    return C.store_stats(_article_chunks(spark, sf_dir))


@register("l2_ordered_chunks", sql="WITH " + ARTICLES_SQL + "," + _article_chunks_sql() + """,
top AS (SELECT url FROM ac ORDER BY total_chunks DESC, url LIMIT 1)
SELECT ac.url, chunk_index, word_count, content FROM ac JOIN top USING (url)""")
def l2_ordered_chunks(spark, sf_dir):
    """The chunks of the article with the most of them (ties: smallest url), read from a written store."""
    path = scratch_path(spark, "ordered-store")
    _article_chunks(spark, sf_dir).write.parquet(path)  # chunked once
    ch = spark.read.parquet(path)
    top = ch.agg(F.min_by("url", F.struct(-F.col("total_chunks"), F.col("url"))).alias("url")).first()["url"]  # one value
    return C.ordered_chunks(ch, top).select("url", "chunk_index", "word_count", "content")


@register("u7_extract_article_text")
def u7_extract_article_text(spark, sf_dir):
    """Article text of every page (first article, else main, else body)."""
    from factlens.operators.html import extract_article_text

    r = extract_article_text(Tables(spark, sf_dir).pages)
    return r.select("page_id", "word_count", "success", F.md5("content").alias("content_md5"))


@register("u8_extract_wiki_text")
def u8_extract_wiki_text(spark, sf_dir):
    from factlens.operators.html import extract_wiki_text

    r = extract_wiki_text(Tables(spark, sf_dir).pages)
    return r.select("page_id", F.char_length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


@register("u3_chunk_pages")
def u3_chunk_pages(spark, sf_dir):
    """Pages -> article text -> 64/8 chunks with url-derived ids (the store's input)."""
    from factlens.operators.html import extract_article_text

    txt = extract_article_text(Tables(spark, sf_dir).pages, keep=["url"]).where("success")
    ch = C.chunk_articles(txt.select("url", F.col("content").alias("full_content")))
    return ch.select("chunk_id", "url", "chunk_index", "total_chunks", "word_count")


@register("l3_peek", sql="WITH " + ARTICLES_SQL + "," + _article_chunks_sql() + """
SELECT chunk_id, url, chunk_index, word_count FROM ac ORDER BY chunk_id LIMIT 5""")
def l3_peek(spark, sf_dir):
    """The first five chunks of the store in id order (the limit is the feature)."""
    return C.peek(_article_chunks(spark, sf_dir), 5, "chunk_id").select("chunk_id", "url", "chunk_index",
                                                                        "word_count")
