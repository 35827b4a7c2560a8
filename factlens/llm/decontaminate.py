"""Benchmark decontamination by winnowing (operator 3).

Words are lower-cased (A-Z) alphanumeric runs. A *window* is ``span`` consecutive words
of a benchmark item; an item of fewer words (but not none) is one window. A document word
inside any occurrence of a window is *hit*.

Of every ``span - gram + 1`` consecutive k-grams the one with the smallest hash is kept,
so two texts that share ``span`` words keep a common k-gram (Schleimer et al., 2003). The
kept fingerprints of documents and items are joined, and each hit is extended word by
word, at most ``span - gram`` to either side: a shared window always has a kept k-gram
inside, so these short extensions find all of every shared span and nothing else. Items
shorter than ``span`` cannot be promised a kept k-gram; for their lengths (at most
``span - 1`` different ones) documents contribute all n-grams.

Benchmark fingerprints are counted first. Up to ``max_known`` of them (8 bytes each) go
to the executors as a sorted array, so that only matching document fingerprints enter
the join; above that bound the join itself, dealt by fingerprint, does all the work. The
rows after the join are the same either way.

Cases: null texts have no words; a null doc_id is kept as its own row; rows that repeat an
id are documents of their own, one row each. Null item ids hit words
but are not counted as items. Other columns are ignored. Empty tables give zero hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factlens.llm import words as W
from factlens.llm.tables import arrow_map

SPAN, GRAM = 10, 5
MAX_KNOWN = 1 << 20

_MARK = pa.struct([("kind", pa.int32()), ("print", pa.int64()), ("at", pa.int32()), ("around", pa.string()), ("lead", pa.int32())])
_MARK_DDL = "array<struct<kind:int,print:bigint,at:int,around:string,lead:int>>"


def _kept(grams: np.ndarray, starts: np.ndarray, row: np.ndarray, width: int) -> np.ndarray:
    """Indices into ``starts`` (k-gram starts, row by row) that winnowing keeps."""
    h = grams[starts]
    n = len(h)
    if n < width:
        return np.zeros(0, dtype=np.int64)
    view = np.lib.stride_tricks.sliding_window_view(h, width)
    inside = row[: n - width + 1] == row[width - 1:]
    return np.unique((np.arange(n - width + 1) + np.argmin(view, axis=1))[inside])


def _fingerprints(span: int, gram: int, lengths: tuple[int, ...], known, items: bool):
    """Rows (id, row, n_words, marks); kind 0 is a winnowed k-gram, kind n a whole n-gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = None if known is None else known.value
        for batch in batches:
            for lo, hi, w in W.blocks(batch, "text", W.ALNUM):
                h = w.hashes()
                roll = W.rolling(h, 0)
                n = w.counts
                found = []  # (kind, prints, word index, row)
                starts = w.window_starts(gram)
                if len(starts):
                    prints = np.zeros(len(h), dtype=np.uint64)
                    prints[starts] = roll(starts, starts + gram)
                    row = np.searchsorted(w.first, starts, side="right") - 1
                    k = _kept(prints, starts, row, span - gram + 1)
                    found.append((0, gram, prints[starts[k]], starts[k], row[k]))
                for size in lengths:
                    at = w.window_starts(size)
                    row = np.searchsorted(w.first, at, side="right") - 1
                    if items:  # a short item is one window: only items of that very length
                        at, row = at[n[row] == size], row[n[row] == size]
                    found.append((size, size, roll(at, at + size), at, row))
                marks: list[list] = [[] for _ in range(hi - lo)]
                lower = w._as_byte
                for kind, size, prints, at, row in found:
                    prints = prints.view(np.int64)
                    if keep is not None:
                        i = np.minimum(np.searchsorted(keep, prints), max(len(keep) - 1, 0))
                        ok = keep[i] == prints if len(keep) else np.zeros(len(prints), dtype=bool)
                        prints, at, row = prints[ok], at[ok], row[ok]
                    reach = span - size if kind == 0 else 0
                    a = np.maximum(at - reach, w.first[row])
                    b = np.minimum(at + size + reach, w.first[row + 1])
                    for p, x, r, i, j in zip(prints.tolist(), at.tolist(), row.tolist(), a.tolist(), b.tolist()):
                        around = b" ".join(lower[w.data[s:e]].tobytes() for s, e in zip(w.starts[i:j], w.ends[i:j])).decode()
                        marks[r].append({"kind": kind, "print": p, "at": x - int(w.first[r]), "around": around, "lead": x - i})
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(n.astype(np.int64)), pa.array(marks, pa.list_(_MARK))],
                    names=["id", "row", "n_words", "marks"])

    return run


def _extend(span: int, gram: int):
    """(from, to) words of the document that stand inside a shared window at a joined hit, else null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            spans = []
            memo: dict[tuple, tuple | None] = {}
            for kind, at, around, lead, i_around, i_lead in zip(*(x[c].to_pylist() for c in ("kind", "at", "around", "lead", "i_around", "i_lead"))):
                if i_around is None:
                    spans.append(None)
                    continue
                key = (kind, around, lead, i_around, i_lead)
                if key not in memo:
                    d, e = around.split(" "), i_around.split(" ")
                    size = kind or gram
                    left = right = 0
                    if d[lead:lead + size] == e[i_lead:i_lead + size]:
                        while left < lead and left < i_lead and d[lead - left - 1] == e[i_lead - left - 1]:
                            left += 1
                        p, q = lead + size, i_lead + size
                        while p + right < len(d) and q + right < len(e) and d[p + right] == e[q + right]:
                            right += 1
                        memo[key] = (left, size + right) if left + size + right >= (span if kind == 0 else size) else None
                    else:
                        memo[key] = None
                m = memo[key]
                spans.append(m and {"a": at - m[0], "b": at + m[1]})
            yield pa.RecordBatch.from_arrays(
                [x["id"], x["row"], x["n_words"], _where(x["item"], spans), pa.array(spans, pa.struct([("a", pa.int32()), ("b", pa.int32())]))],
                names=["id", "row", "n_words", "item", "span"])

    return run


def _where(items: pa.Array, spans: list) -> pa.Array:
    return pc.if_else(pa.array([s is not None for s in spans], pa.bool_()), items, pa.scalar(None, items.type))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", span: int = SPAN, gram: int = GRAM, max_known: int = MAX_KNOWN) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated, items, spans
    (``items``: the item ids as sorted strings; ``spans``: [from, to) word ranges)."""
    spark = docs.sparkSession
    number = F.monotonically_increasing_id().alias("row")  # one pass reads the documents, so a row keeps its number
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), number)
    items = benchmark.select(F.col(item_col).alias("id"), F.col(item_text_col).alias("text"), number)
    row = lambda df: T.StructType([T.StructField("id", df.schema["id"].dataType), T.StructField("row", T.LongType()), T.StructField("n_words", T.LongType()),
                                   T.StructField("marks", T._parse_datatype_string(_MARK_DDL))])
    marked = arrow_map(items, _fingerprints(span, gram, tuple(range(1, span)), None, True), row(items))
    prints = marked.select(F.col("id").alias("item"), F.explode("marks").alias("m")).select("item", "m.*")
    known = prints.select("print").distinct()
    shared = None
    if known.limit(max_known + 1).count() <= max_known:
        shared = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in known.collect()], dtype=np.int64)))
    lengths = tuple(sorted(r[0] for r in prints.filter("kind > 0").select("kind").distinct().collect()))

    cands = arrow_map(docs, _fingerprints(span, gram, lengths, shared, False), row(docs)).select("id", "row", "n_words", F.explode_outer("marks").alias("m")).select("id", "row", "n_words", "m.*")
    theirs = prints.select(F.col("kind").alias("i_kind"), F.col("print").alias("i_print"), "item", F.col("around").alias("i_around"), F.col("lead").alias("i_lead"))
    # documents without a candidate have nothing to join: their null key would be one hot key
    cands = cands.withColumn("print", F.coalesce("print", F.xxhash64("row"))).withColumn("kind", F.coalesce("kind", F.lit(-1)))
    joined = cands.join(theirs, (F.col("print") == F.col("i_print")) & (F.col("kind") == F.col("i_kind")), "left")
    hits = arrow_map(joined.select("id", "row", "n_words", "kind", "at", "around", "lead", "item", "i_around", "i_lead"), _extend(span, gram), T.StructType([
        *row(docs).fields[:3], T.StructField("item", items.schema["id"].dataType), T.StructField("span", T._parse_datatype_string("struct<a:int,b:int>"))]))
    per_doc = hits.groupBy("id", "row").agg(F.max("n_words").alias("n_words"), F.array_sort(F.collect_set("span")).alias("spans"),
                                            F.array_sort(F.transform(F.collect_set("item"), lambda i: i.cast("string"))).alias("items"))
    n_hit = F.expr("aggregate(spans, named_struct('n', 0L, 'upto', 0), (s, x) -> named_struct('n', s.n + greatest(0, x.b - greatest(x.a, s.upto)), 'upto', greatest(s.upto, x.b)), s -> s.n)")
    return per_doc.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                          F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), "items", "spans")
