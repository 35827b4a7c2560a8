"""X3 trending: top topics per time window (tumbling or sliding), batch or stream.

Counts per (window, topic) are an ordinary partial/final aggregation; ranking the
topics of a window needs the finished window, so the streaming form runs the
windowed count in append mode behind a watermark (a window is emitted once the
watermark passes its end) and ranks each micro-batch of finished windows in
``foreachBatch``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def window_counts(events: DataFrame, topic_col: str, ts_col: str, size: str, slide: str | None = None) -> DataFrame:
    win = F.window(ts_col, size, slide) if slide else F.window(ts_col, size)
    return events.groupBy(win.alias("w"), F.col(topic_col).alias("topic")).agg(F.count(F.lit(1)).alias("n"))


def top_k(counts: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("w").orderBy(F.col("n").desc(), "topic")
    r = counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return r.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "topic", "n", "rank")


def trending(events: DataFrame, topic_col: str, ts_col: str, size: str = "6 hours", slide: str | None = "1 hour",
             k: int = 3) -> DataFrame:
    """Batch form: ``window_start, window_end, topic, n, rank``."""
    return top_k(window_counts(events, topic_col, ts_col, size, slide), k)


def trending_stream(spark, stream: DataFrame, topic_col: str, ts_col: str, out_path: str, checkpoint: str,
                    size: str = "6 hours", slide: str | None = "1 hour", delay: str = "1 hour", k: int = 3,
                    available_now: bool = True):
    counts = window_counts(stream.withWatermark(ts_col, delay), topic_col, ts_col, size, slide)

    def run(batch: DataFrame, batch_id: int) -> None:
        # one folder per micro-batch, overwritten: a replayed batch replaces its rows
        top_k(batch, k).write.mode("overwrite").parquet(f"{out_path.rstrip('/')}/batch_id={batch_id}")

    w = counts.writeStream.outputMode("append").foreachBatch(run).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
