"""Exact substring dedup by repeated-phrase automata (operator 1).

A window is ``length`` consecutive words of one document. Every word covered by a
window whose word sequence also starts earlier (smaller id, or same document and
earlier start) is removed; windows are judged on the input. The steps:

1. *Anchors.* Every window is represented by the smallest hash among its k-grams
   (winnowing). Equal windows have equal anchors. Consecutive windows with one
   anchor form a run, about ``length/3`` rows fewer than windows.
2. *Confirm.* Anchors seen once cannot repeat and go. Runs whose whole word sequence
   (anchor hash and content hash, 128 bits) stands earlier are covered as a whole.
   What is left are the first copies of runs whose anchor also stands in another run.
3. *Automata.* Those runs are dealt by anchor hash to shards. A shard keeps the windows
   that stand in several runs, compiles them (a word is one letter) into an Aho-Corasick
   automaton and streams its runs through it, which locates every occurrence. Shards
   work in batches of ``PIECES`` runs, cut between anchors, so memory is bounded; an
   anchor with more runs than that is resolved by an aggregation over window texts,
   which combines map-side and needs no group in one task.
4. Covered words are cut per document.

Cases: a null text has no words; a null id sorts before every other id; rows that share
an id are told apart by 96 bits of two hashes of their text (exactly repeated rows are one place, so
neither is removed for the other); texts shorter than a window are kept; columns other
than id and text are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factlens.llm import words as W
from factlens.llm.tables import arrow_map, stored

LENGTH, GRAM = 20, 8
PIECES = 8192


def _tags(batch: pa.RecordBatch) -> np.ndarray:
    """32-bit checksum of each row's text: with the 64 bits of column ``tag`` it tells rows apart that share an id."""
    return np.array([zlib.crc32((t.as_py() or "").encode()) for t in batch.column(1)], dtype=np.int64)


def _anchors(length: int, gram: int, count_only: bool = False):
    """The runs of every text; with ``count_only`` just how often a block holds each anchor."""
    width = length - gram + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tags = None if count_only else _tags(batch)
            for lo, _, w in W.blocks(batch, "text", W.SPACE):
                at = w.window_starts(length)
                if not len(at):
                    continue
                h = w.hashes()
                short = W.rolling(h, 0)
                grams = short(i := np.arange(len(h) - gram + 1), i + gram)
                view = np.lib.stride_tricks.sliding_window_view(grams, width)
                anchor = at + np.argmin(view[at], axis=1) if len(at) < len(view) else at + np.argmin(view, axis=1)
                row = np.searchsorted(w.first, at, side="right") - 1
                new = np.ones(len(at), dtype=bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
                b = np.flatnonzero(new)
                if count_only:
                    seen, times = np.unique(grams[anchor[b]], return_counts=True)
                    yield pa.RecordBatch.from_arrays([W.signed(seen), pa.array(times)], names=["anchor", "c"])
                    continue
                n = np.diff(np.append(b, len(at)))
                start, row = at[b], row[b]
                whole = W.rolling(h, 1)
                place = (tags[lo + row] << 32) | (start - w.first[row])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(lo + row)), batch.column(2).take(pa.array(lo + row)), W.signed(grams[anchor[b]]),
                     W.signed(whole(start, start + n + length - 1)), pa.array(place), pa.array(n.astype(np.int8))],
                    names=["id", "tag", "anchor", "content", "place", "n"])

    return run


def _pieces(length: int):
    """Texts of the runs that an automaton has to look at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column(batch.schema.get_field_index("runs"))
            for lo, hi, w in W.blocks(batch, "text", W.SPACE):
                rows, out = [], ([], [], [], [])
                for r in range(lo, hi):
                    for x in runs[r].as_py():
                        if x["anchor"] is not None:
                            a = int(w.first[r - lo]) + (x["place"] & 0xFFFFFFFF)
                            rows.append(r)
                            for to, v in zip(out, (x["anchor"], x["place"], x["hot"], w.text(a, a + x["n"] + length - 1))):
                                to.append(v)
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(rows)), batch.column(2).take(pa.array(rows)), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()),
                         pa.array(out[2], pa.bool_()), pa.array(out[3], pa.binary())],
                        names=["id", "tag", "anchor", "place", "hot", "words"])

    return run


def locate(pieces: list[tuple], length: int) -> Iterator[tuple]:
    """(id, tag, place) of the windows in ``pieces`` (id, tag, place, words) that stand earlier too."""
    letters: dict[bytes, str] = {}

    def letter(word: bytes) -> str:
        c = letters.get(word)
        if c is None:
            n = len(letters) + 1
            c = letters[word] = chr(n if n < 0xD800 else n + 0x800)
        return c

    texts = ["".join(map(letter, p[3].split(b" "))) for p in pieces]
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    confirmed = [x for x, n in seen.items() if n > 1]
    if not confirmed:
        return
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for n, x in enumerate(confirmed):
        automaton.add_word(x, n)
    automaton.make_automaton()
    first: list = [None] * len(confirmed)
    hits = []
    for (key, tag, place, _), t in zip(pieces, texts):
        for end, n in automaton.iter(t):
            at = (key is not None, 0 if key is None else key, tag, place + end - length + 1)
            hits.append((n, at, key))
            if first[n] is None or at < first[n]:
                first[n] = at
    for n, at, key in hits:
        if at != first[n]:
            yield key, *at[2:]


def _shards(length: int, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[tuple] = []
        last = None

        def flush():
            found = list(locate(pending, length))
            if found:
                cols = zip(zip(*found), (id_type, pa.int64(), pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in cols], names=["id", "tag", "place"])

        for batch in batches:
            for key, tag, anchor, place, text in zip(*(batch.column(c).to_pylist() for c in range(5))):
                if len(pending) >= PIECES and anchor != last:
                    yield from flush()
                    pending = []
                pending.append((key, tag, place, text))
                last = anchor
        yield from flush()

    return run


def _windows(length: int):
    """Every window of the runs of a crowded anchor, as its own row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, places, texts = [], [], []
            for r, (place, text) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                ws = text.split(b" ")
                for i in range(len(ws) - length + 1):
                    rows.append(r)
                    places.append(place + i)
                    texts.append(b" ".join(ws[i:i + length]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), batch.column(1).take(pa.array(rows, pa.int64())), pa.array(places, pa.int64()),
                                               pa.array(texts, pa.binary())], names=["id", "tag", "place", "words"])

    return run


def _cut(length: int, with_text: bool):
    """Drop covered words: ``runs`` are covered as a whole unless an anchor is given, ``more`` are single windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, runs, more = (batch.column(c).to_pylist() for c in (3, 4, 5))
            n_words, n_removed, sha, kept_texts = [], [], [], []
            for text, rs, ms in zip(texts, runs, more):
                ws = (text or "").encode().split()
                edge = np.zeros(len(ws) + 1, dtype=np.int64)
                for x in rs or ():
                    if x["anchor"] is None:
                        a = x["place"] & 0xFFFFFFFF
                        edge[a] += 1
                        edge[a + x["n"] + length - 1] -= 1
                for place in ms or ():
                    a = place & 0xFFFFFFFF
                    edge[a] += 1
                    edge[a + length] -= 1
                gone = np.cumsum(edge)[:-1] > 0
                kept = b" ".join(x for x, g in zip(ws, gone) if not g) if gone.any() else b" ".join(ws)
                n_words.append(len(ws))
                n_removed.append(int(gone.sum()))
                sha.append(hashlib.sha256(kept).hexdigest())
                kept_texts.append(kept.decode())
            out = [*(batch.column(c) for c in range(3)), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(out + [pa.array(kept_texts, pa.string())] * with_text, names=["id", "tag", "crc", "n_words", "n_removed", "kept_sha256"] + ["kept"] * with_text)

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                    gram: int = GRAM, with_text: bool = True, hot_pieces: int = PIECES) -> DataFrame:
    """One row per document: id, n_words, n_removed, kept_sha256 (and ``kept``, the words left)."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("tag", F.xxhash64(text))
    key = docs.schema["id"].dataType
    tag, place = T.StructField("tag", T.LongType()), T.StructField("place", T.LongType())
    who = [T.StructField("id", key), tag]
    anchors = arrow_map(docs, _anchors(length, gram), T.StructType([
        *who, T.StructField("anchor", T.LongType()), T.StructField("content", T.LongType()), place, T.StructField("n", T.ByteType())]))
    counts = arrow_map(docs, _anchors(length, gram, True), "anchor long, c long")
    again = counts.groupBy("anchor").agg(F.sum("c").alias("c")).filter("c > 1").select("anchor")
    hits = stored(anchors.join(again, "anchor", "left_semi"))

    at = F.struct("id", "tag", "place")
    firsts = stored(hits.groupBy("anchor", "content").agg(F.min(at).alias("first")))
    crowd = firsts.groupBy("anchor").agg(F.count("*").alias("kinds"))
    known = firsts.join(crowd, "anchor")
    marked = hits.join(known, ["anchor", "content"]).withColumn("is_first", at.eqNullSafe(F.col("first")))
    crc_of = F.shiftright("place", 32).alias("crc")
    todo = marked.filter("not is_first or kinds > 1").select(
        "id", "tag", crc_of, F.struct("place", "n", F.expr("if(is_first, anchor, null)").alias("anchor"), (F.col("kinds") > hot_pieces).alias("hot")).alias("run"))
    runs = todo.groupBy("id", "tag", "crc").agg(F.collect_list("run").alias("runs"))
    same = lambda a, b: (F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & (F.col(f"{a}.tag") == F.col(f"{b}.tag"))
                         & (F.col(f"{a}.crc") == F.col(f"{b}.crc")))
    d = docs.withColumn("crc", F.shiftright(F.shiftleft(F.crc32(text), 32), 32)).alias("d")
    touched = stored(d.join(runs.alias("r"), same("d", "r")).select("d.id", "d.text", "d.tag", "d.crc", "r.runs"))

    pieces = stored(arrow_map(touched, _pieces(length), T.StructType([
        *who, T.StructField("anchor", T.LongType()), place, T.StructField("hot", T.BooleanType()), T.StructField("words", T.BinaryType())])))
    from pyspark.sql.pandas.types import to_arrow_type

    found = T.StructType([*who, place])
    by_shard = arrow_map(pieces.filter("not hot").select("id", "tag", "anchor", "place", "words").repartition("anchor").sortWithinPartitions("anchor"),
                         _shards(length, to_arrow_type(key)), found)
    windows = arrow_map(pieces.filter("hot").select("id", "tag", "place", "words"), _windows(length), T.StructType([*found.fields, T.StructField("words", T.BinaryType())]))
    earliest = windows.groupBy("words").agg(F.min(at).alias("first"))
    by_count = windows.join(earliest, "words").filter(~at.eqNullSafe(F.col("first"))).select("id", "tag", "place")
    more = by_shard.unionByName(by_count).groupBy("id", "tag", crc_of).agg(F.collect_list("place").alias("more")).alias("m")

    result = T.StructType([*who, T.StructField("crc", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
                           T.StructField("kept_sha256", T.StringType())] + [T.StructField("kept", T.StringType())] * with_text)
    t = touched.alias("t")
    changed = arrow_map(t.join(more, same("t", "m"), "left").select("t.id", "t.tag", "t.crc", "t.text", "t.runs", "m.more"), _cut(length, with_text), result)
    # all other documents keep their words: a narrow pass, only small rows meet the list of changed ones
    nothing = [F.lit(None).cast(runs.schema["runs"].dataType).alias("runs"), F.lit(None).cast("array<bigint>").alias("more")]
    whole = arrow_map(d.select("id", "tag", "crc", "text", *nothing), _cut(length, with_text), result).alias("w")
    keys = touched.select("id", "tag", "crc").distinct().alias("k")
    plain = whole.join(keys, same("w", "k"), "left_anti")
    return changed.unionByName(plain).drop("tag", "crc").withColumnRenamed("id", id_col)
