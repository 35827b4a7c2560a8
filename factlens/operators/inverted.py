"""A stored inverted index for the AND searches J7 and J8.

``build`` reads the documents once. Each task cuts what it reads into segments of about ``SEGMENT_TOKENS`` tokens and turns a
segment into posting blocks, one a term: the places of its documents in the segment, their term frequencies, and the
largest of these. Blocks are written sorted by (term, segment), range by range, so the files and row groups of other terms are
skipped by their statistics and a term of the whole corpus is spread; the documents' ids and scope columns stand by segment.

``search`` never reads a document. For (claim, term) rows:

1. The segments that hold a claim's rarest term are its candidates; those that lack another of its terms go. Only block
   headers (term, segment, size, maximum) are read.
2. The sum of a segment's block maxima bounds its scores. The ``FIRST`` segments with the highest bounds are evaluated
   first; their ``limit``-th score rules out every other segment whose bound is below it.
3. A segment is evaluated by one task: its asked blocks once, its claims in parts of ``CLAIMS``; posting lists are
   intersected from the shortest on and only the best ``limit`` documents leave the task.

A scope (domains, language, dates) is one more posting list that every claim has to meet and that adds no score. Values of scope columns
are terms too (``value_term``), so claims that each search a scope of their own can be searched together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factlens.operators.retrieve import bounded_batches
from factlens.session import ensure_checkpoint_dir, scratch_path

SEGMENT_TOKENS, SEGMENT_DOCS = 1 << 20, 1 << 16
FIRST, CLAIMS = 8, 4096
IN_LIST = 1000  # up to so many asked terms go to the scan as a list, which skips files and row groups
SCOPE = ""  # the scope's own term; words are never empty


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), "")


def value_term(column: str, value: str | Column) -> Column:
    """The term of the documents with a value in a scope column; adds no score."""
    return F.concat(F.lit(f"{column}="), value.cast("string") if isinstance(value, Column) else F.lit(value))


def _segments(tokens: int, docs: int, doc_type: pa.DataType):
    """(doc row, terms) to posting blocks; a row without a term lists the segment's documents."""
    schema = pa.schema([("seg", pa.int64()), ("term", pa.string()), ("n", pa.int32()), ("top", pa.int32()), ("places", pa.list_(pa.int32())),
                        ("tfs", pa.list_(pa.int32())), ("docs", pa.list_(doc_type))])

    def blocks(held: list[tuple], seg: int) -> Iterator[pa.RecordBatch]:
        rows = pa.concat_arrays([h[0] for h in held])
        counts = np.concatenate([h[1] for h in held])
        order = pc.sort_indices(rows.field("doc")).to_numpy()  # places follow the ids: ties go to the smaller one
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        coded = pa.concat_arrays([h[2] for h in held]).dictionary_encode()
        words = coded.dictionary
        by_word = pc.sort_indices(words).to_numpy()
        rank = np.empty(len(words), dtype=np.int64)
        rank[by_word] = np.arange(len(words))
        key = rank[coded.indices.to_numpy()] * len(counts) + np.repeat(place, counts)
        pairs, tf = np.unique(key, return_counts=True)
        word, at = pairs // len(counts), (pairs % len(counts)).astype(np.int32)
        ends = np.searchsorted(word, np.arange(len(words) + 1)).astype(np.int32)
        tf = tf.astype(np.int32)
        n = np.diff(ends)
        none = lambda f, k: pa.nulls(k, schema.field(f).type)
        yield pa.RecordBatch.from_arrays([pa.array([seg], pa.int64()), *(none(f, 1) for f in ("term", "n", "top", "places", "tfs")),
                                          pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), rows.take(pa.array(order)))], schema=schema)
        for lo in range(0, len(words), 1 << 16):
            hi = min(len(words), lo + (1 << 16))
            off, a, b = pa.array(ends[lo:hi + 1] - ends[lo]), ends[lo], ends[hi]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(hi - lo, seg)), words.take(pa.array(by_word[lo:hi])), pa.array(n[lo:hi].astype(np.int32)), pa.array(np.maximum.reduceat(tf[:b], ends[lo:hi])),
                pa.ListArray.from_arrays(off, pa.array(at[a:b])), pa.ListArray.from_arrays(off, pa.array(tf[a:b])), none("docs", hi - lo)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seg, held, size, rows = TaskContext.get().partitionId() << 24, [], 0, 0
        for batch in batches:
            lists = batch.column(1)
            lists = lists if lists.null_count == 0 else pc.fill_null(lists, pa.scalar([], lists.type))
            ends = lists.offsets.to_numpy()
            lo = 0
            while lo < len(ends) - 1:
                room = min(docs - rows, len(ends) - 1 - lo)
                hi = min(lo + room, max(lo + 1, int(np.searchsorted(ends, ends[lo] + tokens - size, side="right")) - 1))
                held.append((batch.column(0).slice(lo, hi - lo), np.diff(ends[lo:hi + 1]).astype(np.int64), lists.values.slice(int(ends[lo]), int(ends[hi] - ends[lo]))))
                size, rows, lo = size + int(ends[hi] - ends[lo]), rows + hi - lo, hi
                if size >= tokens or rows >= docs:
                    yield from blocks(held, seg)
                    seg, held, size, rows = seg + 1, [], 0, 0
        if held:
            yield from blocks(held, seg)

    return run


@dataclass
class InvertedIndex:
    """``postings``: term, seg, n, top, places, tfs. ``docs``: seg, place, doc and the scope columns."""

    postings: DataFrame
    docs: DataFrame
    path: str
    segments: int


def build(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", scope: tuple[str, ...] = (),
          segment_tokens: int = SEGMENT_TOKENS, segment_docs: int = SEGMENT_DOCS) -> InvertedIndex:
    """Write the index of ``docs`` under ``path`` (default: a fresh folder beside the checkpoints). Every row with an id is a document of its own."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    path = path or scratch_path(spark, "inverted")
    row = F.struct(F.col(id_col).alias("doc"), *scope)
    given = docs.where(F.col(id_col).isNotNull()).select(
        row.alias("row"), F.concat(F.coalesce(terms(F.col(text_col)), F.array().cast("array<string>")),
                                   F.array_compact(F.array(*(value_term(c, F.col(c)) for c in scope)).cast("array<string>"))).alias("terms"))
    kind = given.schema["row"].dataType
    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType([T.StructField("seg", T.LongType()), T.StructField("term", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("top", T.IntegerType()),
                           T.StructField("places", ints), T.StructField("tfs", ints), T.StructField("docs", T.ArrayType(kind))])
    bounded_batches(spark)
    raw = f"{path}/segments"
    given.mapInArrow(_segments(segment_tokens, segment_docs, to_arrow_type(kind)), schema).write.parquet(raw)
    segments = spark.read.schema(schema).parquet(raw)
    blocks = segments.where("term is not null").drop("docs")
    blocks.repartitionByRange("term", "seg").sortWithinPartitions("term", "seg").write.parquet(f"{path}/postings")
    (segments.where("term is null").select("seg", F.posexplode("docs").alias("place", "d")).select("seg", "place", "d.*").write.parquet(f"{path}/docs"))
    return load(spark, path)


def load(spark: SparkSession, path: str) -> InvertedIndex:
    block = "term string, seg long, n int, top int, places array<int>, tfs array<int>"
    docs = spark.read.parquet(f"{path}/docs")
    return InvertedIndex(spark.read.schema(block).parquet(f"{path}/postings"), docs, path, docs.where("place = 0").count())


def _evaluate(pairs: DataFrame, postings: DataFrame, limit: int | None) -> DataFrame:
    """(claim, seg, place, score) of the documents that hold all of a claim's terms; ``pairs``: claim, seg, terms."""
    load = pairs.groupBy("seg").agg(F.ceil(F.count(F.lit(1)) / CLAIMS).cast("int").alias("parts"))
    asked = pairs.join(load, "seg").withColumn("part", F.pmod(F.xxhash64("claim"), F.col("parts")).cast("int")).select("seg", "part", "claim", "terms")
    wanted = pairs.select("seg", F.explode("terms").alias("term")).distinct()
    given = postings.join(wanted, ["term", "seg"]).join(load, "seg").select("seg", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "term", "places", "tfs")
    schema = T.StructType([pairs.schema["claim"], T.StructField("seg", T.LongType()), T.StructField("place", T.IntegerType()), T.StructField("score", T.LongType())])
    names = [f.name for f in schema]

    def meet(key, claims: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        at = {t: (np.asarray(p), np.asarray(f)) for t, p, f in zip(blocks["term"], blocks["places"], blocks["tfs"])}
        found: list[list] = [[], [], [], []]
        for claim, words in zip(claims["claim"], claims["terms"]):
            lists = sorted(((at[w][0], at[w][1] * ("=" not in w)) for w in words), key=lambda x: len(x[0]))  # value terms add no score
            places, score = lists[0][0], lists[0][1].astype(np.int64)
            for p, f in lists[1:]:
                i = np.minimum(np.searchsorted(p, places), len(p) - 1)
                both = p[i] == places
                places, score = places[both], score[both] + f[i[both]]
            keep = np.lexsort((places, -score))[:limit]
            for to, x in zip(found, ([claim] * len(keep), [key[0]] * len(keep), places[keep].tolist(), score[keep].tolist())):
                to.extend(x)
        return pd.DataFrame({n: pd.Series(c, dtype=object) for n, c in zip(names, found)})

    return asked.groupBy("seg", "part").cogroup(given.groupBy("seg", "part")).applyInPandas(meet, schema)


def search(index: InvertedIndex, claim_terms: DataFrame, keys: list[str], limit: int | None = None, scope: Column | None = None) -> DataFrame:
    """``keys..., doc, score, rank``: the documents that hold all terms (``keys..., term``) of a claim, by total term frequency, then id;
    ``scope`` is a condition on the index's scope columns."""
    ensure_checkpoint_dir(claim_terms.sparkSession)
    asked = claim_terms.select(F.struct(*keys).alias("key"), F.when(F.contains("term", F.lit("=")), F.col("term")).otherwise(F.lower("term")).alias("term")).where("term <> ''").distinct()
    ids = asked.select("key").distinct().withColumn("claim", F.monotonically_increasing_id()).checkpoint(eager=True)
    asked = asked.join(ids, "key").select("claim", "term")
    postings = index.postings
    if scope is not None:
        inside = index.docs.where(scope).groupBy("seg").agg(F.array_sort(F.collect_list("place")).alias("places"))
        inside = inside.select(F.lit(SCOPE).alias("term"), "seg", F.size("places").alias("n"), F.lit(0).alias("top"), "places",
                               F.array_repeat(F.lit(0), F.size("places")).alias("tfs"))
        postings = postings.unionByName(inside)
        asked = asked.union(ids.select("claim", F.lit(SCOPE)))
    asked = asked.checkpoint(eager=True)
    vocabulary = asked.select("term").distinct()
    some = vocabulary.limit(IN_LIST + 1).collect()
    if len(some) <= IN_LIST:
        postings = postings.where(F.col("term").isin([r.term for r in some]))
    heads = postings.select("term", "seg", "n", "top").join(vocabulary, "term", "left_semi").checkpoint(eager=True)
    spread = heads.groupBy("term").agg(F.count(F.lit(1)).alias("segs"))
    need = asked.groupBy("claim").agg(F.count(F.lit(1)).alias("need"), F.collect_list("term").alias("terms"))
    rarest = asked.join(spread, "term").groupBy("claim").agg(F.min_by("term", F.struct("segs", "term")).alias("term"))
    cand = rarest.join(heads.select("term", "seg"), "term").select("claim", "seg")
    pairs = (cand.join(asked.select("claim", "term"), "claim").join(heads.select("term", "seg", "top"), ["term", "seg"])
             .groupBy("claim", "seg").agg(F.count(F.lit(1)).alias("m"), F.sum("top").alias("bound")).join(need, "claim").where("m = need"))
    pairs = pairs.select("claim", "seg", "bound", "terms")
    if limit is None or index.segments <= FIRST:  # nothing that could be ruled out
        hits = _evaluate(pairs, postings, limit)
    else:
        best = Window.partitionBy("claim").orderBy(F.col("bound").desc(), "seg")
        pairs = pairs.withColumn("turn", F.row_number().over(best)).checkpoint(eager=True)
        first = _evaluate(pairs.where(F.col("turn") <= FIRST), postings, limit).checkpoint(eager=True)
        kth = Window.partitionBy("claim").orderBy(F.col("score").desc())
        known = first.select("claim", "score", F.row_number().over(kth).alias("r")).where(F.col("r") == limit).select("claim", F.col("score").alias("least"))
        rest = pairs.where(F.col("turn") > FIRST).join(known, "claim", "left").where("least is null or bound >= least")
        hits = first.unionByName(_evaluate(rest.select("claim", "seg", "terms"), postings, limit))
    named = hits.join(index.docs.select("seg", "place", "doc"), ["seg", "place"]).join(ids, "claim")
    out = named.select("key.*", "doc", "score", F.row_number().over(Window.partitionBy("claim").orderBy(F.col("score").desc(), "doc")).alias("rank"))
    return out.where(F.col("rank") <= limit) if limit else out
