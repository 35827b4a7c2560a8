"""Target-distribution importance resampling (operator 12).

Which documents look most like a target collection? Features are the runs of 1 to ``max_n`` consecutive words
(lower-cased alphanumeric words, joined by one space, repeats counted), hashed into ``buckets`` by the crc32 of their
UTF-8 bytes. A bucket's gain is the log ratio of its smoothed shares in the target and in the corpus, in thousandths; a
document's weight is the floored mean of the gains of its features, its score the weight plus a seeded Gumbel draw. The
highest scores make a sample without replacement in proportion to exp(weight / 1000). The steps:

1. One pass cuts every whole text once and writes, per document, the buckets of its features. Bucket counts of all
   documents are a keyed sum over that table, combined before the shuffle.
2. The gains (an array of ``buckets`` numbers, whatever the corpus) travel with the tasks and score the written buckets.
3. The sample size is a share of the documents of at least ``min_words`` words. The lowest score drawn is found by
   bisection: every round counts, in one job over the written scores, the rows at or above ``PROBES`` thresholds, until
   the integer threshold is exact; ties at it are settled by the same search over their ids.
4. Only the drawn rows are range-partitioned by (score, id) and numbered: a row's rank is its place in its partition plus
   the sizes of the partitions before it.

Cases: a null or empty text, or one without words, has no features, weight 0, and is never drawn unless ``min_words``
is 0; a null id draws as an empty id and loses ties; rows repeating an id and text score alike, so which of
them gets the last rank is not visible; ids that are not integers settle ties by their 64-bit hash; an empty corpus gives an empty result, an empty target gains
from the smoothing only; other columns are ignored. Texts of any length are cut whole, in one task each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factlens.llm import words as W
from factlens.llm.tables import arrow_map, stored

BUCKETS, MAX_N, MIN_WORDS, PERCENT, SEED = 10000, 1, 20, 10, 2024
PROBES = 15  # thresholds counted by one job of the bisection


def _features(max_n: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, w in W.blocks(batch, "text", W.ALNUM):
                h = w.hashes()
                rows, found = [], []
                for n in range(1, max_n + 1):
                    at = w.window_starts(n)
                    if not len(at):
                        continue
                    _, first, inverse = np.unique(h if n == 1 else W.rolling(h)(at, at + n), return_index=True, return_inverse=True)
                    crc = np.array([zlib.crc32(w.text(i, i + n).lower()) % buckets for i in at[first].tolist()], dtype=np.int32)
                    found.append(crc[inverse])
                    rows.append(np.searchsorted(w.first, at, side="right") - 1)
                row = np.concatenate(rows) if rows else np.zeros(0, np.int64)
                value = np.concatenate(found) if found else np.zeros(0, np.int32)
                if max_n > 1:
                    order = np.argsort(row, kind="stable")
                    row, value = row[order], value[order]
                ends = np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(w.counts.astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(value))],
                    names=["id", "n_words", "features"])

    return run


def features(docs: DataFrame, id_col: str, text_col: str, max_n: int = MAX_N, buckets: int = BUCKETS) -> DataFrame:
    """(id, n_words, features): the bucket of every feature of every document."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("n_words", T.LongType()), T.StructField("features", T.ArrayType(T.IntegerType()))])
    return arrow_map(rows, _features(max_n, buckets), schema)


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """The gain of every bucket, from two tables of ``features``; ``buckets`` numbers come to the driver."""

    def counts(x: DataFrame, name: str) -> DataFrame:
        return x.select(F.explode("features").alias("bucket")).groupBy("bucket").agg(F.count("*").alias(name))

    both = (corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
            .join(counts(corpus, "s"), "bucket", "left").join(counts(target, "t"), "bucket", "left").select("bucket", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in "st")))
    rows = {r.bucket: (r.s, r.t) for r in both.collect()}
    every = [sum(v[i] for v in rows.values()) for i in range(2)]
    table = corpus.sparkSession.createDataFrame([(b, float(s), float(t)) for b, (s, t) in rows.items()], "bucket int, s double, t double")
    share = ((F.col("t") + 1) * F.lit(float(every[0] + buckets))) / ((F.col("s") + 1) * F.lit(float(every[1] + buckets)))
    gain = {r.bucket: r.gain for r in table.select("bucket", F.floor(F.lit(1000.0) * F.log(share)).alias("gain")).collect()}
    return [gain[b] for b in range(buckets)]


def _weights(gain: list[int]):
    table = np.array(gain, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("features"))
            ends = lists.offsets.to_numpy()
            n = np.diff(ends).astype(np.int64)
            total = np.concatenate([[0], np.cumsum(table[lists.values.to_numpy(zero_copy_only=False)[: ends[-1]]])])
            weight = np.where(n > 0, (total[ends[1:]] - total[ends[:-1]]) // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(weight)], names=["id", "n_words", "n_features", "weight"])

    return run


def scores(corpus: DataFrame, gain: list[int], seed: object = SEED) -> DataFrame:
    """(id, n_words, n_features, weight, score) from a table of ``features``."""
    schema = T.StructType([corpus.schema["id"], *(T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight"))])
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    draw = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return arrow_map(corpus, _weights(gain), schema).withColumn("score", F.col("weight") + draw)


def _lowest(rows: DataFrame, column: str, need: int) -> int:
    """The largest v with at least ``need`` rows of ``column`` >= v; only counts leave the executors."""
    lo, hi = rows.agg(F.min(column), F.max(column)).first()
    while lo < hi:
        step = max(1, -(-(hi - lo) // (PROBES + 1)))
        probes = list(range(lo + step, hi + 1, step)) or [hi]
        have = rows.agg(*(F.count(F.when(F.col(column) >= F.lit(p), 1)) for p in probes)).first()
        enough = [p for p, n in zip(probes, have) if n >= need]
        short = [p for p, n in zip(probes, have) if n < need]
        lo, hi = max(enough, default=lo), min(short, default=hi + 1) - 1
    return lo


def importance_resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, max_n: int = MAX_N,
                        buckets: int = BUCKETS, min_words: int = MIN_WORDS, seed: object = SEED) -> DataFrame:
    """One row per document: id, n_features, weight, score and rank (1, 2, ... in the drawn order; null where not drawn)."""
    corpus = stored(features(docs, id_col, text_col, max_n, buckets))
    wanted = features(target.select(F.lit(0).alias("id"), F.col(f"`{text_col}`").alias("text")), "id", "text", max_n, buckets)
    x = scores(corpus, gains(corpus, wanted, buckets), seed)
    integral = isinstance(corpus.schema["id"].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    tie = F.col("id").cast("long") if integral else F.when(F.col("id").isNotNull(), F.xxhash64("id"))
    x = stored(x.select("id", "n_features", "weight", "score", (F.col("n_words") >= min_words).alias("eligible"), tie.alias("tie")))
    able = x.where("eligible")
    need = able.count() * percent // 100
    drawn = F.lit(False)
    if need:
        last = _lowest(able, "score", need)
        tied = able.where(F.col("score") == last).withColumn("rank_key", F.bitwise_not("tie"))  # smaller ids first
        left = need - able.where(F.col("score") > last).count()
        by_id = F.lit(True)
        if tied.where("tie is not null").count() > left:
            by_id = F.coalesce(F.bitwise_not("tie") >= F.lit(_lowest(tied.where("tie is not null"), "rank_key", left)), F.lit(False))
        drawn = F.col("eligible") & ((F.col("score") > last) | ((F.col("score") == last) & by_id))
    order = [F.col("score").desc(), F.col("tie").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    placed = stored(x.where(drawn).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()))
    part, inside = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted((r.part, r.n) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # one number per partition
    before = [(p, sum(n for _, n in sizes[:i])) for i, (p, _) in enumerate(sizes)]
    offsets = F.broadcast(docs.sparkSession.createDataFrame(before, "part long, before long"))
    rank = F.col("before") + inside + 1
    ranked = placed.withColumn("part", part).join(offsets, "part").withColumn("rank", F.when(rank <= need, rank))  # ties of equal rows may exceed the draw
    rest = x.where(~drawn).withColumn("rank", F.lit(None).cast("long"))
    out = ["id", "n_features", "weight", "score", "rank"]
    return ranked.select(*out).unionByName(rest.select(*out)).withColumnRenamed("id", id_col)
