"""X1 stream_ingest_articles and X2 stream_verify_posts.

X1: article rows arrive as a stream (url, content or html, event time). One value state a url says
that it has been seen (``SeenUrls``, ``transformWithState``): the first row of a url passes, all later ones
do not, whether in the same micro-batch or after a restart. State can start from the urls of an existing store, and
a timer forgets a url ``retention`` after its event time where one is given. So nothing is looked up in the store: the chunks of a
micro-batch are written to a folder of its own, overwritten, and a replayed batch replaces its rows. Rows
later than the watermark are dropped by the stateful operator and reported in the
query progress (``numRowsDroppedByWatermark``).

X2: a post stream joined with the static chunk store inside ``foreachBatch`` (the
k-NN top-k is not a streaming operator); each batch is reduced to one row a post and written to its own folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from factlens.operators import chunks as C

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SeenUrls(StatefulProcessor):
    """Passes the first row of every url (in event time order within a micro-batch) and remembers the url."""

    def __init__(self, ts_col: str, retention_ms: int | None = None):
        self.ts_col, self.retention_ms = ts_col, retention_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "at timestamp")

    def handleInputRows(self, key, rows, timerValues):
        if self.seen.exists():
            for _ in rows:  # the rows have to be taken
                pass
            return
        first = min((pdf.sort_values(self.ts_col, kind="stable").iloc[[0]] for pdf in rows), key=lambda pdf: pdf[self.ts_col].iloc[0])
        at = first[self.ts_col].iloc[0]
        self._remember(at.to_pydatetime(), int(at.timestamp() * 1000))
        yield first

    def handleInitialState(self, key, initialState, timerValues) -> None:
        at = initialState["at"].iloc[0]
        self._remember(at.to_pydatetime(), int(at.timestamp() * 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.seen.clear()
        return iter(())

    def _remember(self, at, ms: int) -> None:
        self.seen.update((at,))
        if self.retention_ms is not None:
            self.handle.registerTimer(ms + self.retention_ms)

    def close(self) -> None:
        pass


def first_of_urls(stream: DataFrame, ts_col: str, delay: str, retention_ms: int | None = None, known: DataFrame | None = None) -> DataFrame:
    """The first row of every url that ``known`` (url, at: when it was stored) does not hold. Needs the RocksDB state store."""
    spark = stream.sparkSession
    if not spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").endswith("RocksDBStateStoreProvider"):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    start = known.select("url", "at").groupBy("url") if known is not None else None
    return (stream.withWatermark(ts_col, delay).groupBy("url")
            .transformWithStateInPandas(SeenUrls(ts_col, retention_ms), stream.schema, "Append", "EventTime", start))


def ingest_batch(store_path: str, size: int = C.LIVE_SIZE, overlap: int = C.LIVE_OVERLAP, html: bool = False):
    """The ``foreachBatch`` function: the chunks of a batch's (new) articles, in the batch's own folder."""

    def run(batch: DataFrame, batch_id: int) -> None:
        arts = batch
        if html:
            from factlens.operators.html import extract_article_text

            arts = extract_article_text(arts, "url", "html", keep=[c for c in arts.columns if c not in ("url", "html")]).where("success")
            arts = arts.withColumnRenamed("content", "full_content")
        C.chunk_articles(arts, size, overlap).write.mode("overwrite").parquet(f"{store_path.rstrip('/')}/batch_id={batch_id}")

    return run


def stream_ingest_articles(spark: SparkSession, stream: DataFrame, store_path: str, checkpoint: str,
                           ts_col: str = "ts", delay: str = "1 hour", html: bool = False, available_now: bool = True,
                           retention_ms: int | None = None, known: DataFrame | None = None):
    """Starts the ingest query and returns the ``StreamingQuery``."""
    d = first_of_urls(stream, ts_col, delay, retention_ms, known)
    w = d.writeStream.outputMode("append").foreachBatch(ingest_batch(store_path, html=html)).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


class LateRows(StreamingQueryListener):
    """Counts the rows that watermarks drop over the whole life of the queries:
    ``spark.streams.addListener(late := LateRows())``, then ``late.total``."""

    def __init__(self) -> None:
        self.total = 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.total += sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)

    def onQueryTerminated(self, event) -> None:
        pass


def rows_dropped_late(query) -> int:
    """Rows the watermark dropped as too late in the progress reports that Spark still
    keeps of a query (its last 100); ``LateRows`` counts them all."""
    total = 0
    for p in query.recentProgress:
        for op in p.get("stateOperators", []) if isinstance(p, dict) else p.stateOperators:
            total += (op.get("numRowsDroppedByWatermark", 0) if isinstance(op, dict)
                      else op.numRowsDroppedByWatermark)
    return total


def stream_verify_posts(spark: SparkSession, posts_stream: DataFrame, out_path: str, checkpoint: str, *,
                        chunks: DataFrame, evidence_labels: DataFrame, topic, claim, available_now: bool = True):
    """Every micro-batch of posts is reduced to one row a post, verified against the static store, and its
    responses replace what an earlier try of the same batch has written."""
    from factlens.plans.verify import verify_posts

    def run(batch: DataFrame, batch_id: int) -> None:
        posts = batch.groupBy("post_id").agg(F.min("text").alias("text"))
        res = verify_posts(posts, chunks, evidence_labels, topic=topic, claim=claim)
        res.write.mode("overwrite").parquet(f"{out_path.rstrip('/')}/batch_id={batch_id}")

    w = posts_stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
