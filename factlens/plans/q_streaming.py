"""Registered queries: trending windows (batch, SQL-checked) and the streaming jobs
X1-X3 driven over the driver's files with an available-now trigger."""

from __future__ import annotations

from pyspark.sql import functions as F

from factlens.operators import chunks as C
from factlens.plans.catalog import register
from factlens.plans.q_verify import RESPONSES_SQL, _claims_sql
from factlens.session import scratch_path
from factlens.sources.readers import _list_files
from factlens.sources.tables import Tables
from factlens.streaming import ingest as IN
from factlens.streaming import trending as TR


def _fmt(df):
    return df.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                     F.date_format("window_end", "yyyy-MM-dd HH:mm:ss").alias("window_end"),
                     "topic", "n", F.col("rank").cast("int").alias("rank"))


@register("x3_trending", sql="""
WITH w AS (SELECT event_type AS topic, date_trunc('hour', ts) - INTERVAL 1 HOUR * i AS ws FROM events, range(6) t(i)),
c AS (SELECT ws, topic, count(*) AS n FROM w GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY ws ORDER BY n DESC, topic) AS rank FROM c)
SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(ws + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end,
       topic, n, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3""")
def x3_trending(spark, sf_dir):
    """Top 3 event types of every 6-hour window sliding by 1 hour."""
    return _fmt(TR.trending(Tables(spark, sf_dir).events, "event_type", "ts", "6 hours", "1 hour", 3))


@register("x3_trending_tumbling", sql="""
WITH c AS (SELECT date_trunc('day', ts) AS ws, event_type AS topic, count(*) AS n FROM events GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY ws ORDER BY n DESC, topic) AS rank FROM c)
SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(ws + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS window_end,
       topic, n, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 2""")
def x3_trending_tumbling(spark, sf_dir):
    return _fmt(TR.trending(Tables(spark, sf_dir).events, "event_type", "ts", "1 day", None, 2))


BATCHES, FILE_BYTES = 4, 64 << 20  # micro-batches; about the bytes of the input table behind one file of the feed


def _bytes(spark, path):
    """Bytes of a file or folder (metadata, through the Hadoop FS)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def _feed(table, part, path, files):
    """Write the ranges 0, 1, ... of ``part`` one after the other, each as exactly ``files`` files; False where a range gave fewer."""
    spark = table.sparkSession
    for i in range(BATCHES):
        rows = table.where(F.coalesce(part, F.lit(0)) == i)
        rows = rows.coalesce(1) if files == 1 else rows.repartition(files)
        rows.write.mode("append").parquet(path)
        if files > 1 and len(_list_files(spark, path, "part-")) != files * (i + 1):
            return False
    return True


def _stream(spark, sf_dir, name, by):
    """A file stream over one table: files by ranges of ``by``, written one range after the other as a feed would, read one range a
    micro-batch. A range is dealt out over as many files as its share of the table's bytes asks for, so no task writes or reads a whole range."""
    source = f"{sf_dir.rstrip('/')}/{name}.parquet"
    table = spark.read.parquet(source)
    order = F.unix_micros(F.col(by).cast("timestamp")) if by == "ts" else F.col(by)
    edges = table.agg(F.percentile_approx(order, [i / BATCHES for i in range(1, BATCHES)]).alias("e")).first()["e"] or []
    part = F.lit(0)
    for e in edges:
        part = part + F.when(order > F.lit(e), 1).otherwise(0)
    files = -(-_bytes(spark, source) // (BATCHES * FILE_BYTES)) or 1
    path = scratch_path(spark, f"stream-{name}")
    while not _feed(table, part, path, files):  # a range of few rows: fewer files for all
        files, path = files // 2, scratch_path(spark, f"stream-{name}")
    s = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files).parquet(path)
    # event-time operators need TIMESTAMP (not TIMESTAMP_NTZ); session zone is UTC
    for c, t in s.dtypes:
        if t == "timestamp_ntz":
            s = s.withColumn(c, F.col(c).cast("timestamp"))
    return s


@register("x3_trending_stream", sql="""
WITH w AS (SELECT event_type AS topic, date_trunc('hour', ts) - INTERVAL 1 HOUR * i AS ws FROM events, range(6) t(i)),
c AS (SELECT ws, topic, count(*) AS n FROM w GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY ws ORDER BY n DESC, topic) AS rank FROM c)
SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(ws + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end,
       topic, n, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3 AND ws + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def x3_trending_stream(spark, sf_dir):
    """The same sliding top-3 as a stream: all counts of a window leave the state in the micro-batch in which the watermark
    (1 hour) passes its end, and are ranked there; windows that are still open at the end stay in state."""
    out, ck = scratch_path(spark, "trending-out"), scratch_path(spark, "trending-ck")
    q = TR.trending_stream(spark, _stream(spark, sf_dir, "events", "ts"), "event_type", "ts", out, ck)
    q.awaitTermination()
    if C.path_exists(spark, out):
        return _fmt(spark.read.parquet(out))
    return spark.createDataFrame([], "window_start string, window_end string, topic string, n long, rank int")


@register("x1_stream_ingest_articles")
def x1_stream_ingest_articles(spark, sf_dir):
    """Pages streamed in several micro-batches (event time derived from the page id), the first page of every url kept by its state, article text extracted and chunked into a folder a batch."""
    out, ck = scratch_path(spark, "store"), scratch_path(spark, "ingest-ck")
    s = _stream(spark, sf_dir, "pages", "page_id").withColumn("ts", F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") * 60))
    q = IN.stream_ingest_articles(spark, s, out, ck, html=True)
    q.awaitTermination()
    return spark.read.parquet(out).select("chunk_id", "url", "chunk_index", "word_count")


@register("x2_stream_verify_posts", sql=_claims_sql() + RESPONSES_SQL)
def x2_stream_verify_posts(spark, sf_dir):
    """Benchmark claims streamed as posts and verified against the static store."""
    from factlens.plans.q_retrieval import vector_store
    from factlens.plans.q_verify import claim_classifier, evidence_labels, topic_classifier

    out, ck = scratch_path(spark, "verify-out"), scratch_path(spark, "verify-ck")
    posts = _stream(spark, sf_dir, "benchmark", "item_id").select(F.col("item_id").alias("post_id"), "text")
    # the store with its vectors is materialised once and reused by every micro-batch
    store = vector_store(spark, sf_dir)
    q = IN.stream_verify_posts(spark, posts, out, ck, chunks=store, evidence_labels=evidence_labels(spark, sf_dir, store),
                               topic=topic_classifier(spark, sf_dir), claim=claim_classifier(spark, sf_dir))
    q.awaitTermination()
    return spark.read.parquet(out).select("post_id", "is_political", "success", "message",
                                          F.size("fact_check_results").alias("n_results"))
