"""Word-window chunking, chunk store maintenance and adjacent-chunk merging.

U2 chunk_words, U3 chunk_articles, K3 append_chunks / append_version, J3 new_urls_only,
W1/W2 merge_adjacent, A13 store_stats, L2 ordered_chunks.

All of it is per-row array work or key-partitioned windows: a document's chunks are
produced by one generator call (bounded by the document's length), merges group by
(query, url, island) whose size is bounded by the chunk count of one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factlens.functions import text as T

# Chunk size / overlap of the store class and of the live service.
DEFAULT_SIZE, DEFAULT_OVERLAP = 256, 16
LIVE_SIZE, LIVE_OVERLAP = 64, 8


def n_chunks(n_words: Column, size: int, overlap: int) -> Column:
    """Number of windows the step rule produces: 0 for no words, 1 up to ``size``
    words, else ceil((n - size) / step) + 1."""
    step = size - overlap
    return (F.when(n_words == 0, F.lit(0))
            .when(n_words <= size, F.lit(1))
            .otherwise(F.floor((n_words - size + step - 1) / step).cast("int") + 1))


def chunk_words(df: DataFrame, keys: list[str], text_col: str = "text",
                size: int = DEFAULT_SIZE, overlap: int = DEFAULT_OVERLAP) -> DataFrame:
    """U2. One row per window: ``keys..., chunk_index, content, word_count, total_chunks``.

    Windows start every ``size - overlap`` words and stop once a window reaches the
    last word; blank text gives no rows."""
    if not (0 <= overlap < size):
        raise ValueError(f"need 0 <= overlap < size, got size={size} overlap={overlap}")
    step = size - overlap
    w = df.select(*keys, T.words(text_col).alias("_w"))
    w = w.select(*keys, "_w", n_chunks(F.size("_w"), size, overlap).alias("total_chunks"))
    # Chunk strings are built inside the generator's input array, so exploded rows
    # carry one chunk each rather than a copy of the whole word array. The outer
    # generator plus a filter after it keeps Catalyst from inferring a non-empty
    # filter below the projection (which would re-evaluate the word split per chunk).
    pieces = F.when(F.col("total_chunks") > 0, F.transform(
        F.sequence(F.lit(0), F.col("total_chunks") - 1), lambda i: F.slice(F.col("_w"), i * step + 1, F.lit(size))))
    w = w.select(*keys, "total_chunks", pieces.alias("_p"))
    out = (w.select(*keys, "total_chunks", F.posexplode_outer("_p").alias("chunk_index", "_piece"))
           .where(F.col("_piece").isNotNull()))
    return out.select(
        *keys,
        F.col("chunk_index").cast("int").alias("chunk_index"),
        F.array_join("_piece", " ").alias("content"),
        F.size("_piece").alias("word_count"),
        F.col("total_chunks").cast("int").alias("total_chunks"),
    )


# Chunk table schema: union of both metadata shapes the reference writes.
CHUNK_COLUMNS = ("chunk_id", "url", "page", "chunk_index", "total_chunks", "title", "source",
                 "author", "published_at", "content", "word_count")


def chunk_articles(articles: DataFrame, size: int = LIVE_SIZE, overlap: int = LIVE_OVERLAP) -> DataFrame:
    """U3. Articles (url, title, source, author, published_at, full_content|content) to
    chunk rows with ids ``md5(url_index)``. Rows without url or text are dropped."""
    cols = set(articles.columns)

    def opt(c, typ="string"):
        return F.col(c) if c in cols else F.lit(None).cast(typ)

    body = F.coalesce(F.nullif(opt("full_content"), F.lit("")), F.nullif(opt("content"), F.lit("")))
    a = articles.select(
        F.col("url"), opt("title").alias("title"), opt("source").alias("source"),
        opt("author").alias("author"), opt("published_at").alias("published_at"),
        opt("page").alias("page"), body.alias("_body"),
    ).where(F.col("url").isNotNull() & (F.col("url") != "") & F.col("_body").isNotNull())
    ch = chunk_words(a, ["url", "title", "source", "author", "published_at", "page"], "_body", size, overlap)
    return ch.select(
        T.chunk_id("url", "chunk_index").alias("chunk_id"), "url", "page", "chunk_index",
        "total_chunks", "title", "source", "author", "published_at", "content", "word_count",
    )


def new_urls_only(incoming: DataFrame, store: DataFrame, url_col: str = "url") -> DataFrame:
    """J3. Rows whose url is not in the store (NOT EXISTS). The store is first reduced to
    the incoming urls (the small side, so nothing of the store need be shuffled), then
    the short list of known urls is taken off."""
    asked = incoming.select(F.col(url_col).alias("_a")).distinct()
    known = store.select(F.col(url_col).alias("_u")).join(asked, F.col("_u") == F.col("_a"), "left_semi").distinct()
    return incoming.join(known, F.col(url_col) == F.col("_u"), "left_anti")


def dedupe_articles(articles: DataFrame, order_cols: list[str], url_col: str = "url") -> DataFrame:
    """In-batch duplicates: keep the first article per url by ``order_cols``. A
    ``min_by`` aggregate (combined map-side), so a url repeated millions of times
    does not pile up in one task the way a window per url would."""
    cols = articles.columns
    best = articles.groupBy(url_col).agg(
        F.min_by(F.struct(*cols), F.struct(*order_cols, *[c for c in cols if c not in order_cols])).alias("_r"))
    return best.select("_r.*")


def path_exists(spark, path: str) -> bool:
    """Whether a (possibly remote) path exists, through the Hadoop file system."""
    jp = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jp.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jp)


STORE_BUCKETS = 64


def url_bucket(url: Column) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(STORE_BUCKETS)).cast("int")


def append_chunks(spark, store_path: str, new_chunks: DataFrame) -> DataFrame:
    """K3. Idempotent append: chunks of urls that the store holds completely are skipped,
    and so is every chunk it holds of the others, so a re-run (or a retried micro-batch)
    appends nothing twice and completes what a failed one left. The store is kept in folders by the
    hash of the url (``bucket``); only the folders of the batch's urls are read and added to. Returns the store."""
    new_chunks = new_chunks.withColumn("bucket", url_bucket(F.col("url")))
    fresh = new_chunks
    if path_exists(spark, store_path):
        asked = new_chunks.select(F.col("url").alias("_a"), "bucket").distinct()
        touched = [r.bucket for r in asked.select("bucket").distinct().collect()]  # at most STORE_BUCKETS numbers
        known = (spark.read.parquet(store_path).where(F.col("bucket").isin(touched))
                 .select(F.col("url").alias("_u"), F.col("chunk_id").alias("_id"), "total_chunks")
                 .join(asked, F.col("_u") == F.col("_a"), "left_semi"))
        complete = known.groupBy("_u").agg(F.count_distinct("_id").alias("_n"), F.max("total_chunks").alias("_t")).where("_n >= _t").select("_u")
        fresh = (new_chunks.join(complete, F.col("url") == F.col("_u"), "left_anti")
                 .join(known.select("_id").distinct(), F.col("chunk_id") == F.col("_id"), "left_anti"))
    fresh.write.mode("append").partitionBy("bucket").parquet(store_path)
    return spark.read.parquet(store_path)


def append_version(spark, store_path: str, new_chunks: DataFrame, version: int) -> DataFrame:
    """K3 with a store version per batch: the chunks of urls that no earlier version holds become version ``version``
    (a folder of its own, overwritten, so a repeated batch replaces its rows). Returns the store as of that version."""
    fresh = new_chunks
    if path_exists(spark, store_path):
        earlier = spark.read.parquet(store_path).where(F.col("version") < version)
        fresh = new_urls_only(new_chunks, earlier)
    fresh.drop("version").write.mode("overwrite").parquet(f"{store_path.rstrip('/')}/version={version}")
    return store_as_of(spark, store_path, version)


def store_as_of(spark, store_path: str, version: int) -> DataFrame:
    """The chunks of versions up to ``version``; folders of later ones are not read."""
    return spark.read.option("basePath", store_path).parquet(store_path).where(F.col("version") <= version)


def store_stats(chunks: DataFrame) -> DataFrame:
    """A13. total chunks, distinct articles, average chunks per article (0 when empty)."""
    return chunks.agg(
        F.count(F.lit(1)).alias("total_chunks"),
        F.countDistinct("url").alias("unique_articles"),
    ).select(
        "total_chunks", "unique_articles",
        F.when(F.col("unique_articles") > 0,
               F.round(F.col("total_chunks") / F.col("unique_articles"), 6)).otherwise(F.lit(0.0))
        .alias("avg_chunks_per_article"),
    )


def ordered_chunks(chunks: DataFrame, url: str) -> DataFrame:
    """L2. One article's chunks by index (pushed down as an equality filter on url)."""
    return chunks.where(F.col("url") == F.lit(url)).orderBy("chunk_index")


def merge_adjacent(retrieval: DataFrame, group_cols: list[str], overlap: int = LIVE_OVERLAP,
                   rank_col: str = "rank", score_col: str = "score") -> DataFrame:
    """W1/W2 long form. Input: one retrieved chunk per row with ``group_cols``, url,
    chunk_index, content, ``rank_col`` (retrieval order) and ``score_col``.

    Consecutive chunk indexes of one url form a block; a following chunk adds its
    words after the first ``overlap`` (nothing when it has no more than ``overlap``).
    Output per block: group_cols, block_no (blocks ordered by the url's first
    appearance, then start index), url, start_index, end_index, n_chunks, max_score,
    first_rank, text."""
    r = retrieval.where(F.col("url").isNotNull())
    g = [*group_cols, "url"]
    w_idx = Window.partitionBy(*g).orderBy("chunk_index", rank_col)
    r = r.withColumn("_island", F.col("chunk_index") - F.row_number().over(w_idx))
    w_isl = Window.partitionBy(*g, "_island").orderBy("chunk_index", rank_col)
    wds = T.words("content")
    piece = (F.when(F.row_number().over(w_isl) == 1, F.col("content"))
             .when(F.size(wds) > overlap, F.array_join(F.slice(wds, overlap + 1, 1 << 30), " ")))
    r = r.withColumn("_piece", piece).withColumn("_url_first", F.min(rank_col).over(Window.partitionBy(*g)))
    first_meta = ([F.min_by("chunk_id", F.struct("chunk_index", rank_col)).alias("first_chunk_id")]
                  if "chunk_id" in r.columns else [])
    blocks = r.groupBy(*g, "_island").agg(
        *first_meta,
        F.min("chunk_index").alias("start_index"),
        F.max("chunk_index").alias("end_index"),
        F.count(F.lit(1)).alias("n_chunks"),
        F.max(score_col).alias("max_score"),
        F.min(rank_col).alias("first_rank"),
        F.first("_url_first").alias("_url_first"),
        F.array_sort(F.collect_list(F.struct("chunk_index", F.col(rank_col).alias("_rk"), "_piece")))
        .alias("_parts"),
    )
    text = F.array_join(F.transform("_parts", lambda s: s["_piece"]), " ")
    wb = Window.partitionBy(*group_cols).orderBy("_url_first", "start_index")
    return blocks.select(
        *group_cols, F.row_number().over(wb).alias("block_no"), "url", "start_index", "end_index",
        "n_chunks", "max_score", "first_rank", *(["first_chunk_id"] if first_meta else []), text.alias("text"),
    )


def merged_evidence(blocks: DataFrame, group_cols: list[str]) -> DataFrame:
    """W1 array form: one row per group with the block texts in block order."""
    return blocks.groupBy(*group_cols).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("block_no", "text"))), lambda s: s["text"])
        .alias("evidence"))


def merge_adjacent_scored(blocks: DataFrame, group_cols: list[str]) -> DataFrame:
    """Blocks with ``chunk_range`` 'a-b', sorted by best score within the group;
    the first chunk's id (for its metadata) is kept when the input had chunk ids."""
    w = Window.partitionBy(*group_cols).orderBy(F.col("max_score").desc(), "block_no")
    meta = ["first_chunk_id"] if "first_chunk_id" in blocks.columns else []
    return blocks.select(
        *group_cols, F.row_number().over(w).alias("score_rank"), "url", *meta,
        F.concat_ws("-", F.col("start_index").cast("string"), F.col("end_index").cast("string"))
        .alias("chunk_range"), "n_chunks", "max_score", "text")


def peek(chunks: DataFrame, n: int, order_col: str = "chunk_id") -> DataFrame:
    """L3: the first ``n`` rows in ``order_col`` order (a top-n: each partition keeps
    n, one final merge of n x partitions rows)."""
    return chunks.orderBy(order_col).limit(n)
