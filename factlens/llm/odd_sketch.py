"""MinHash near-duplicates by odd sketches (operator 13).

A document is the set of its 5-word shingles (words between white space, A-Z lower-cased; a text of one to four words is one
shingle). Two documents are linked when inter / union >= ``threshold`` hundredths; a component is what links connect. The steps
(odd sketches: Mitzenmacher, Pagh, Pham, 2014):

1. One pass makes, per document, its set size, a 128-bit hash of the set, ``BANDS`` x ``ROWS`` minhashes, their band keys, and
   the odd sketch: every (place, minhash) flips one of ``BITS`` bits. Samples that two documents share cancel in the XOR of their
   sketches, so its population count x tells the similarity, 1 + bits / (4 samples) * ln(1 - 2 x / bits), most sharply where it is high.
   Documents of equal sets become one class with the smallest id.
2. Classes that share a band key meet in a bucket. Around pivots, in the order of a bucket, whatever the sketches call near (``TIE``) is tied, spanning
   only, and members that are nearly the pivot's equals (``CORE``) need not become pivots: what is linked to them is tied to the pivot
   by the triangle inequality. Each member proposes one link, to the first pivot that is near enough (``LIKELY``). So a
   bucket gives edges linear in its size. Buckets of more than ``CROWD`` classes are cut by a salt; the pivots of
   the parts meet in block pairs.
3. Proposed links are confirmed on the full sets; a class with many of them is salted. ``components`` joins what is confirmed, so a large family of
   near copies is done in linear work.
4. Ties between different components are what is open. Their components meet in blocks: all sets of the smaller ones with
   each other and with the largest, which does not meet itself. Every pair of sets that the sketches do not rule out (``GATE``) is
   counted on the full sets, and what links them ends the search.

Pairs are never emitted: tasks give spanning ties, one proposal a member, or forests of confirmed links. A link is missed
when no band agrees (similarity 0.85: 4 in 100 000 for one pair) or the sketch is off by more than four standard errors, and does not matter when its
ends are connected in another way.

Cases: null texts and texts without words are alone, with 0 shingles; equal texts are linked; a null id comes after every id: its row's component is the smallest id
it reaches, or null; rows repeating an id are rows of their own, so one id can stand in two components; an
empty table gives an empty result; other columns are ignored. Very long texts are cut whole, in one task each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factlens.llm import words as W
from factlens.llm.components import components, forest
from factlens.llm.jaccard_join import _lists, _sets, _shared
from factlens.llm.tables import arrow_map, stored

SHINGLE, THRESHOLD = 5, 85
BANDS, ROWS, BITS = 20, 6, 512
SAMPLES = BANDS * ROWS
TIE, CORE, LIKELY, GATE, MEET = 0.55, 0.93, 0.80, 0.70, 0.50  # similarities by sketch: ties, pivots' equals, proposals, pairs to count, pivots of cut buckets
CROWD, BLOCK, STAR = 4096, 1024, 4096


def apart(similarity: float) -> int:
    """The largest population count of an XOR of sketches that still speaks for ``similarity``."""
    return math.floor(BITS / 2 * (1 - math.exp(-4 * SAMPLES * (1 - similarity) / BITS)))


def estimate(x: np.ndarray) -> np.ndarray:
    """Similarity by the population count of the XOR of two sketches."""
    return 1 + BITS / (4 * SAMPLES) * np.log(np.maximum(1 - 2 * x / BITS, 1e-9))


def _sketches(minhash: np.ndarray) -> np.ndarray:
    """Odd sketches (rows x words of 64 bits) of minhashes (rows x samples)."""
    n = len(minhash)
    bits = np.zeros((n, BITS), dtype=np.uint8)
    at = W.mix(minhash + np.arange(1, SAMPLES + 1, dtype=np.uint64)[None, :] * np.uint64(W.BASES[0])) % np.uint64(BITS)
    for j in range(SAMPLES):
        bits[np.arange(n), at[:, j].astype(np.int64)] ^= 1
    return np.packbits(bits, axis=1).view(np.uint64)


def _signatures(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor = W.seeded(np.arange(SAMPLES, dtype=np.uint64), 7) | np.uint64(1)
        shift = W.seeded(np.arange(SAMPLES, dtype=np.uint64), 8)
        for batch in batches:
            for lo, hi, w in W.blocks(batch, "text", W.SPACE_LOWER):
                n = hi - lo
                rows, tokens = _sets(w, k)
                size = np.bincount(rows, minlength=n)
                full = np.flatnonzero(size)
                sums = np.zeros((2, n), dtype=np.uint64)
                sketch = np.zeros((n, BITS // 64), dtype=np.uint64)
                bands = np.zeros((n, BANDS), dtype=np.uint64)
                if len(full):
                    at = np.searchsorted(rows, full)
                    for j in range(2):
                        sums[j, full] = np.add.reduceat(W.seeded(tokens, 1 + j), at)
                    minhash = np.empty((len(full), SAMPLES), dtype=np.uint64)
                    for j in range(SAMPLES):  # tokens are mixed hashes already: one multiplication reorders them
                        minhash[:, j] = np.minimum.reduceat((tokens ^ shift[j]) * factor[j], at)
                    sketch[full] = _sketches(minhash)
                    seeds = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * np.uint64(W.BASES[1])
                    band = seeds
                    for r in range(ROWS):
                        band = W.mix(band ^ minhash[:, r::ROWS])
                    bands[full] = band
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, n), batch.column(1).slice(lo, n), pa.array(size.astype(np.int64)), W.signed(sums[0]), W.signed(sums[1]),
                     pa.array([s.tobytes() for s in sketch], pa.binary()), _lists(np.repeat(np.arange(n), np.where(size > 0, BANDS, 0)), W.signed(bands[full].ravel()), n)],
                    names=["id", "digest", "size", "h1", "h2", "sketch", "bands"])

    return run


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Population counts of the XOR of every sketch of a with every one of b."""
    out = np.zeros((len(a), len(b)), dtype=np.int32)
    for word in range(a.shape[1]):
        out += np.bitwise_count(a[:, word, None] ^ b[None, :, word])
    return out


def _stack(sketches: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), dtype=np.uint64).reshape(len(sketches), BITS // 64)


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) of a sorted partition, by the first ``keys`` columns; the key columns bound a group's size."""
    last, held = None, []
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
            if row[:keys] != last:
                if held:
                    yield last, held
                last, held = row[:keys], []
            held.append(row[keys:])
    if held:
        yield last, held


_EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("near", pa.bool_()), ("bucket", pa.int64()), ("sketch", pa.binary())])


def _edge_batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= 20000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _EDGES)], schema=_EDGES)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _EDGES)], schema=_EDGES)


def _bucket_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, salt, node, sketch) sorted: ties and proposals of every part, and the pivots of cut buckets."""
    tie, core, gate = apart(TIE), apart(CORE), apart(LIKELY)

    def edges():
        for (bucket, salt), rows in _groups(batches, 2):
            ids, sk = np.array([r[0] for r in rows]), _stack([r[1] for r in rows])
            n = len(ids)
            left, label, proposed = np.ones(n, dtype=bool), np.arange(n), np.zeros(n, dtype=bool)
            for p in range(n):
                if not left[p]:
                    continue
                x = np.bitwise_count(sk ^ sk[p]).sum(axis=1)
                for i in np.flatnonzero((x <= gate) & ~proposed).tolist():
                    if i != p:
                        proposed[i] = True
                        yield int(ids[p]), int(ids[i]), True, None, None
                for other in np.unique(label[(x <= tie) & (label != label[p])]).tolist():
                    yield int(ids[p]), int(ids[other]), False, None, None
                    label[label == other] = label[p]
                if salt >= 0:
                    yield int(ids[p]), int(ids[p]), False, bucket, rows[p][1]
                left &= x > core
                left[p] = False
                if salt < 0 and proposed.sum() >= n - 1 and not (label != label[0]).any():
                    break

    return _edge_batches(edges())


def _pivot_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, p, q, block, node, sketch) sorted: spanning ties and one proposal a member between the pivots of a block pair."""
    meet, gate = apart(MEET), apart(LIKELY)

    def edges():
        for (_, p, q), rows in _groups(batches, 3):
            a = [r for r in rows if r[0] == p]
            b = a if p == q else [r for r in rows if r[0] == q]
            if not a or not b:
                continue
            x = _distances(_stack([r[2] for r in a]), _stack([r[2] for r in b]))
            ia, ib = (np.array([r[1] for r in s]) for s in (a, b))
            x[ia[:, None] == ib[None, :]] = BITS
            i, j = np.nonzero(x <= meet)
            nodes = ia if p == q else np.concatenate([ia, ib])
            label = forest(len(nodes), i, j if p == q else j + len(a))
            for m in np.flatnonzero(label != np.arange(len(label))).tolist():
                yield int(nodes[label[m]]), int(nodes[m]), False, None, None
            for m, best in enumerate(x.argmin(axis=1).tolist()):
                if x[m, best] <= gate:
                    yield int(ib[best]), int(ia[m]), True, None, None

    return _edge_batches(edges())


def _token_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, w in W.blocks(batch, "text", W.SPACE_LOWER):
                rows, tokens = _sets(w, k)
                rest = [batch.column(i).slice(lo, hi - lo) for i in range(1, batch.num_columns)]
                yield pa.RecordBatch.from_arrays([_lists(rows, W.signed(tokens), hi - lo), *rest], names=["tokens", *batch.schema.names[1:]])

    return run


def _token_rows(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple]:
    """Rows with the list column ``at`` as numpy arrays."""
    for batch in batches:
        lists = batch.column(at)
        flat, ends = lists.values.to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy()
        rest = zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns) if i != at))
        for r, row in enumerate(rest):
            yield (*row, flat[ends[r]:ends[r + 1]])


def _linked(both, a, b, threshold: int):
    return (100 + threshold) * both >= threshold * (a + b)  # 100 * inter >= threshold * union, in integers


def _confirm(threshold: int):
    """(u, salt, v or null, tokens) sorted, the row of u itself first: the links of u that hold on the full sets."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at = None, None
        out: list[tuple] = []
        for u, salt, v, tokens in _token_rows(batches, 3):
            if v is None:
                own, at = tokens.copy(), (u, salt)
                continue
            assert at == (u, salt)
            found = np.minimum(np.searchsorted(own, tokens), len(own) - 1)
            if _linked(int((own[found] == tokens).sum()), len(own), len(tokens), threshold):
                out.append((u, v))
            if len(out) >= 20000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)

    return run


def _search(threshold: int):
    """(root, p, q, block, label, sketch, tokens) sorted: a forest of the labels that any pair of sets of the block pair links."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    gate = apart(GATE)

    def joined(p, q, rows):
        a = [r for r in rows if r[0] == p]
        b = a if p == q else [r for r in rows if r[0] == q]
        if not a or not b:
            return
        la, lb = (np.array([r[1] for r in s]) for s in (a, b))
        near = (_distances(_stack([r[2] for r in a]), _stack([r[2] for r in b])) <= gate) & (la[:, None] != lb[None, :])
        ka, kb = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
        if not len(ka):
            return
        ta, tb = [a[i][3] for i in ka], [b[i][3] for i in kb]
        sa, sb = (np.array([len(t) for t in s], dtype=np.int64) for s in (ta, tb))
        both = _shared(ta, tb).astype(np.int64)
        i, j = np.nonzero(_linked(both, sa[:, None], sb[None, :], threshold) & near[np.ix_(ka, kb)])
        labels, place = np.unique(np.concatenate([la[ka][i], lb[kb][j]]), return_inverse=True)
        root = forest(len(labels), place[: len(i)], place[len(i):])
        yield from ((int(labels[r]), int(labels[m])) for m, r in enumerate(root.tolist()) if m != r)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []

        def batch_of(found):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], schema=schema)

        for root, p, q, *row in _token_rows(batches, 6):
            if (root, p, q) != last:
                if held and (found := list(joined(last[1], last[2], held))):
                    yield batch_of(found)
                last, held = (root, p, q), []
            held.append((*row[:3], row[3].copy()))
        if held and (found := list(joined(last[1], last[2], held))):
            yield batch_of(found)

    return run


def _blocks(count: Column, size: int) -> Column:
    return F.ceil(count / F.lit(size)).cast("int")


def _candidates(classes: DataFrame, crowd: int, block: int) -> DataFrame:
    """(u, v, near): spanning ties of the buckets, ``near`` where the link is to be confirmed."""
    keys = classes.select("node", F.posexplode("bands").alias("band", "value")).select("node", F.xxhash64("band", "value").alias("bucket"))
    counted = keys.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    salt = F.when(F.col("n") > crowd, F.pmod(F.xxhash64("node"), _blocks(F.col("n"), crowd))).otherwise(F.lit(-1)).cast("int")
    members = keys.join(counted, "bucket").select("bucket", salt.alias("salt"), "node").join(classes.select("node", "sketch"), "node")
    members = members.select("bucket", "salt", "node", "sketch")
    schema = "u long, v long, near boolean, bucket long, sketch binary"
    parts = stored(arrow_map(members.repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", "node"), _bucket_edges, schema))
    pivots = parts.where("bucket is not null").select("bucket", F.col("u").alias("node"), "sketch")
    sizes = pivots.groupBy("bucket").agg(_blocks(F.count("*"), block).alias("blocks"))
    dealt = pivots.join(sizes, "bucket").withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int"))
    pairs = F.expr("transform(sequence(0, blocks - 1), x -> struct(least(x, block) as p, greatest(x, block) as q))")
    dealt = dealt.select("bucket", F.explode(pairs).alias("pq"), "block", "node", "sketch").select("bucket", "pq.p", "pq.q", "block", "node", "sketch")
    met = arrow_map(dealt.repartition("bucket", "p", "q").sortWithinPartitions("bucket", "p", "q"), _pivot_edges, schema)
    edges = parts.where("bucket is null").unionByName(met).where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "near")
    return stored(edges.groupBy("u", "v").agg(F.max("near").alias("near")))


def _confirmed(edges: DataFrame, sets: DataFrame, threshold: int, star: int) -> DataFrame:
    """The proposed links that hold on the full sets; the links of a class with many are dealt to several tasks."""
    near = edges.where("near").select("u", "v")
    salts = near.groupBy("u").agg(_blocks(F.count("*"), star).alias("salts"))
    hubs = salts.join(sets, salts["u"] == sets["node"]).select("u", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("v"), "tokens")
    spokes = near.join(salts, "u").select("u", F.pmod(F.xxhash64("v"), F.col("salts")).cast("int").alias("salt"), "v")
    spokes = spokes.join(sets, spokes["v"] == sets["node"]).select("u", "salt", "v", "tokens")
    met = hubs.unionByName(spokes).repartition("u", "salt").sortWithinPartitions("u", "salt", F.col("v").asc_nulls_first())
    return stored(arrow_map(met, _confirm(threshold), "u long, v long"))


def _opened(edges: DataFrame, label: DataFrame, classes: DataFrame, sets: DataFrame, threshold: int, block: int) -> DataFrame:
    """(u, v): links between components that ties leave open, found on the full sets."""
    root = lambda side: label.select(F.col("node").alias(side), F.col("root").alias(f"{side}r"))
    x = edges.join(root("u"), "u", "left").join(root("v"), "v", "left").select(F.coalesce("ur", "u").alias("u"), F.coalesce("vr", "v").alias("v")).where("u != v")
    x = stored(x.distinct())
    if not x.take(1):
        return x
    group = components(x).select(F.col("node").alias("label"), F.col("root").alias("open"))
    own = classes.select("node", "sketch").join(label, "node", "left").select("node", "sketch", F.coalesce("root", "node").alias("label")).join(group, "label")
    own = stored(own.select("open", "label", "node", "sketch"))
    size = own.groupBy("open", "label").agg(F.count("*").alias("n"))
    largest = size.groupBy("open").agg(F.max(F.struct("n", "label")).alias("m"), F.sum("n").alias("all")).select(
        "open", F.col("m.label").alias("main"), _blocks(F.col("all") - F.col("m.n"), block).alias("rest"), _blocks(F.col("m.n"), block).alias("mains"))
    spread = lambda n: F.pmod(F.xxhash64("node", F.lit(2)), F.col(n)).cast("int")
    dealt = own.join(largest, "open").withColumn("block", F.when(F.col("label") == F.col("main"), F.col("rest") + spread("mains")).otherwise(spread("rest")))
    pairs = F.expr("""if(block >= rest, transform(sequence(0, rest - 1), x -> struct(x as p, block as q)),
                      transform(sequence(0, rest + mains - 1), x -> struct(least(x, block) as p, greatest(x, block) as q)))""")
    dealt = dealt.select("open", "block", "label", "node", "sketch", F.explode(pairs).alias("pq")).join(sets, "node")
    dealt = dealt.select("open", "pq.p", "pq.q", "block", "label", "sketch", "tokens").repartition("open", "p", "q").sortWithinPartitions("open", "p", "q")
    return stored(arrow_map(dealt, _search(threshold), "u long, v long"))


def odd_sketch_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: int = THRESHOLD,
                          crowd: int = CROWD, block: int = BLOCK, star: int = STAR) -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable), kept. ``threshold`` in hundredths."""
    docs = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = docs.schema["id"].dataType
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    schema = T.StructType([T.StructField("id", kind), T.StructField("digest", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("size", "h1", "h2")),
                           T.StructField("sketch", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])
    sig = stored(arrow_map(docs.select("id", digest.alias("digest"), "text"), _signatures(shingle), schema))
    same = ["size", "h1", "h2"]
    classes = sig.where("size > 0").groupBy(*same).agg(F.min("id").alias("least"), F.min(F.struct("digest", "id")).alias("one"), F.min("sketch").alias("sketch"),
                                                       F.min("bands").alias("bands"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()))
    edges = _candidates(classes, crowd, block)

    # the texts of one document of every class that is tied to another
    tied = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    ones = classes.join(tied, "node").select(F.col("one.digest").alias("digest"), F.col("one.id").alias("one"), "node")
    texts = docs.withColumn("digest", digest)
    texts = texts.join(ones, (texts["digest"] == ones["digest"]) & texts["id"].eqNullSafe(ones["one"])).select("text", "node")
    sets = stored(arrow_map(texts, _token_sets(shingle), "tokens array<long>, node long").dropDuplicates(["node"]))

    label = components(_confirmed(edges, sets, threshold, star))
    more = components(_opened(edges, label, classes, sets, threshold, block)).select(F.col("node").alias("root"), F.col("root").alias("top"))
    found = classes.select("node", "least", *same).join(label, "node", "left").withColumn("root", F.coalesce("root", "node"))
    found = stored(found.join(more, "root", "left").select("least", *same, F.coalesce("top", "root").alias("root")))
    least = found.groupBy("root").agg(F.min("least").alias("component"))
    per_set = found.join(least, "root").select(*same, "component")
    out = sig.select("id", *same).join(per_set, same, "left")
    component = F.when(F.col("size") > 0, F.col("component")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
