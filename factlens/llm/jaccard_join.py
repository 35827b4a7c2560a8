"""N-gram Jaccard join by chosen paths (operator 6).

A document is the set of its 5-word shingles (lower-cased alphanumeric words; a text of
one to four words has one shingle). Two documents are linked when the Jaccard similarity of their sets
is ``threshold`` or more. The steps follow the chosen-path similarity join (Christiani, Pagh, Sivertsen, 2018):

1. One pass makes, per document, its set size, a 128-bit hash of the set, a sketch of
   ``SKETCH`` one-byte minhashes and, for every run and level, the tokens the set
   *chooses*: token x is chosen when its seeded hash is under 1 / (threshold * |set|).
   Equal sets become one representative with a weight.
2. In each run sets that choose a common token share a bucket. Buckets of more than
   ``SMALL`` sets are split again by the tokens chosen on the next level, ``LEVELS`` levels deep. ``runs_for`` gives
   the number of independent runs for a target recall.
3. Small buckets (and the few that no level splits) are compared by sketch. Around each pivot everything that may be
   near is tied to it, with slack for the sketch error and the triangle inequality, so
   no link between members is lost while edges stay linear in the bucket. A bucket of
   more than ``CROWD`` sets is first cut by a salt, and the pivots of its parts meet in pairs of blocks.
4. Ties make candidate components (``components``); each component's sets meet once, in blocks of ``BLOCK``, and every pair of
   sets of a component is verified exactly. So a link that no run has seen is found
   too when its documents are connected. Verified links give the
   number of links (weights counted) and the classes: connected documents, named by their smallest id.

Pairs are never emitted: a block returns counts and a spanning forest.

Cases: documents without words (null, empty, punctuation) are alone with 0 links; equal texts link to each other; ids may be of any type that
has an order; every row is a document of its own, also where rows repeat an id; a null id comes after all others and is no name: the
class of such rows is the smallest id in it, or null; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factlens.llm import words as W
from factlens.llm.components import components, forest
from factlens.llm.tables import arrow_map, stored

SHINGLE, THRESHOLD, RECALL = 5, 0.8, 0.999
LEVELS, SKETCH = 3, 64
SMALL, CROWD, BLOCK = 256, 4096, 1024
TIE, CORE = 0.5, 0.9  # sketch similarities, see step 3
CROWD_TIE, CROWD_CORE, MEET = 0.4, 0.75, 0.2  # the same in crowded buckets, and between their pivots


def runs_for(recall: float = RECALL, threshold: float = THRESHOLD, levels: int = LEVELS) -> int:
    """Runs until a pair at the threshold is missed with probability at most 1 - recall.

    A pair shares on average common / (threshold * larger size) chosen tokens a level: 2/(1+threshold) for
    equal sizes, and least, 1, for a set inside a larger one. The chance that a common path survives is that
    of a branching process."""
    mean, alive = 1.0, 1.0
    for _ in range(levels):
        alive = 1 - math.exp(-mean * alive)
    return math.ceil(math.log(1 - recall) / math.log(1 - alive))


def _sets(w: W.Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle hash) of the distinct shingles of a block, sorted by row and hash."""
    h = w.hashes()
    roll = W.rolling(h, 0)
    at = w.window_starts(k)
    row = np.searchsorted(w.first, at, side="right") - 1
    short = np.flatnonzero((w.counts > 0) & (w.counts < k))
    tokens = np.concatenate([roll(at, at + k), roll(w.first[short], w.first[short + 1])])
    rows = np.concatenate([row, short])
    o = np.lexsort((tokens, rows))
    rows, tokens = rows[o], tokens[o]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]) | (tokens[1:] != tokens[:-1])
    return rows[new], tokens[new]


def _lists(rows: np.ndarray, values: pa.Array, n: int) -> pa.Array:
    """List array with one list per row 0..n-1 from values sorted by row."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)), values)


def _sketches(k: int, threshold: float, runs: int, levels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, w in W.blocks(batch, "text", W.ALNUM):
                n = hi - lo
                rows, tokens = _sets(w, k)
                size = np.bincount(rows, minlength=n)
                full = np.flatnonzero(size)
                at = np.searchsorted(rows, full)
                sums = np.zeros((2, n), dtype=np.uint64)
                sketch = np.zeros((n, SKETCH), dtype=np.uint8)
                chosen_rows, chosen_slots, chosen_tokens = [], [], []
                if len(full):
                    for j in range(2):
                        sums[j, full] = np.add.reduceat(W.seeded(tokens, 1 + j), at)
                    for j in range(SKETCH):
                        sketch[full, j] = (W.mix(np.minimum.reduceat(W.seeded(tokens, 100 + j), at)) & np.uint64(255)).astype(np.uint8)
                    limit = np.minimum(float(2**64) / (threshold * size[full]), float(2**64 - 2048)).astype(np.uint64)
                    limits = np.repeat(limit, size[full])
                    for slot in range(runs * levels):
                        c = np.flatnonzero(W.seeded(tokens, 1000 + slot) < limits)
                        chosen_rows.append(rows[c])
                        chosen_slots.append(np.full(len(c), slot, dtype=np.int32))
                        chosen_tokens.append(tokens[c])
                r = np.concatenate(chosen_rows) if chosen_rows else np.zeros(0, np.int64)
                o = np.argsort(r, kind="stable")
                slots = np.concatenate(chosen_slots)[o] if chosen_slots else np.zeros(0, np.int32)
                picked = np.concatenate(chosen_tokens)[o] if chosen_tokens else np.zeros(0, np.uint64)
                pairs = pa.StructArray.from_arrays([pa.array(slots), W.signed(picked)], names=["slot", "token"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, n), batch.column(1).slice(lo, n), pa.array(size.astype(np.int32)), W.signed(sums[0]), W.signed(sums[1]),
                     pa.array([s.tobytes() for s in sketch], pa.binary()), _lists(r[o], pairs, n)],
                    names=["id", "digest", "size", "h1", "h2", "sketch", "chosen"])

    return run


def _ties(sk: np.ndarray, tie: float, core: float, all_pivots: bool) -> tuple[np.ndarray, list[int]]:
    """(component label of every member, pivots) of one bucket, see step 3. Only what is
    connected matters: without ``all_pivots`` the search ends when everything is."""
    n = len(sk)
    left, label, pivots = np.ones(n, dtype=bool), np.arange(n), []
    for p in range(n):
        if not left[p]:
            continue
        alike = (sk == sk[p]).mean(axis=1)
        joined = np.zeros(n, dtype=bool)
        joined[label[alike >= tie]] = True
        joined[label[p]] = True
        label = np.where(joined[label], np.flatnonzero(joined)[0], label)
        pivots.append(p)
        left &= alike < core
        left[p] = False
        if not all_pivots and not label.any():
            break
    return label, pivots


def _buckets(meet: bool):
    """Spanning ties within each bucket of a partition sorted by bucket; crowded parts give their pivots too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last = None

        def ties():
            crowded = last[1] >= 0
            sk = np.frombuffer(b"".join(h[1] for h in held), dtype=np.uint8).reshape(len(held), SKETCH)
            tie, core = (MEET, 2.0) if meet else (CROWD_TIE, CROWD_CORE) if crowded else (TIE, CORE)
            label, pivots = _ties(sk, tie, core, crowded and not meet)
            for i in np.flatnonzero(label != np.arange(len(label))).tolist():
                yield held[int(label[i])][0], held[i][0], None, None
            if crowded and not meet:
                for p in pivots:
                    yield held[p][0], held[p][0], last[0], held[p][1]

        def batch_of(rows):
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["u", "v", "bucket", "sketch"])

        out: list[tuple] = []
        for batch in batches:
            for bucket, salt, key, sketch in zip(*(batch.column(c).to_pylist() for c in range(4))):
                if last is not None and (bucket, salt) != last:
                    out += ties()
                    held = []
                    if len(out) > 20000:
                        yield batch_of(out)
                        out = []
                last = (bucket, salt)
                held.append((key, sketch))
        if held:
            out += ties()
        if out:
            yield batch_of(out)

    return run


def _token_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, w in W.blocks(batch, "text", W.ALNUM):
                rows, tokens = _sets(w, k)
                rest = [batch.column(i).slice(lo, hi - lo) for i in range(1, batch.num_columns)]
                yield pa.RecordBatch.from_arrays([_lists(rows, W.signed(tokens), hi - lo), *rest], names=["tokens", *batch.schema.names[1:]])

    return run


def _shared(sets_a: list, sets_b: list, columns: int = 8192) -> np.ndarray:
    """Matrix of intersection sizes; tokens that stand in one set only are left out."""
    rows = np.concatenate([np.repeat(np.arange(len(s)), [len(x) for x in s]) + off for s, off in ((sets_a, 0), (sets_b, len(sets_a)))])
    tokens = np.concatenate([*sets_a, *sets_b])
    _, inverse, count = np.unique(tokens, return_inverse=True, return_counts=True)
    keep = count[inverse] > 1
    rows, inverse = rows[keep], inverse[keep]
    _, inverse = np.unique(inverse, return_inverse=True)
    order = np.argsort(inverse, kind="stable")
    rows, inverse = rows[order], inverse[order]
    out = np.zeros((len(sets_a), len(sets_b)), dtype=np.float32)
    total = len(sets_a) + len(sets_b)
    for c in range(0, int(inverse[-1]) + 1 if len(inverse) else 0, columns):
        i, j = np.searchsorted(inverse, (c, c + columns))
        m = np.zeros((total, min(columns, int(inverse[j - 1]) - c + 1)), dtype=np.float32)
        m[rows[i:j], inverse[i:j] - c] = 1
        out += m[: len(sets_a)] @ m[len(sets_a):].T
    return out


def _verify(threshold: float):
    """Counts of verified links and a spanning forest per (component, block, block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last = None

        def judged():
            p, q = last[1], last[2]
            a = [h for h in held if h[0] == p]
            b = a if p == q else [h for h in held if h[0] == q]
            if not a or not b:
                return
            both = _shared([h[3] for h in a], [h[3] for h in b])
            sa, sb = (np.array([len(h[3]) for h in s], dtype=np.float64) for s in (a, b))
            ia, ib = (np.array([h[1] for h in s]) for s in (a, b))
            wa, wb = (np.array([h[2] for h in s], dtype=np.float64) for s in (a, b))
            # |x & y| / |x | y| >= t, rounded the same way for every pair
            linked = (both >= np.ceil(threshold * (sa[:, None] + sb[None, :]) / (1 + threshold) - 1e-9)) & (ia[:, None] != ib[None, :])
            i, j = np.nonzero(linked)
            n = len(a) + (0 if p == q else len(b))
            label = forest(n, i, j if p == q else j + len(a))
            nodes = ia if p == q else np.concatenate([ia, ib])
            links = linked @ wb if p == q else np.concatenate([linked @ wb, wa @ linked])
            yield from zip(nodes.tolist(), nodes[label].tolist(), links.astype(np.int64).tolist())

        out: list[tuple] = []

        def batch_of():
            cols = list(zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["u", "v", "links"])

        for batch in batches:
            tokens = batch.column(3)
            flat, off = tokens.values.to_numpy(zero_copy_only=False), tokens.offsets.to_numpy()
            for r, (comp, p, q, key, weight, block) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 4, 5, 6)))):
                if last is not None and (comp, p, q) != last:
                    out.extend(judged())
                    held = []
                    if len(out) > 20000:
                        yield batch_of()
                        out = []
                last = (comp, p, q)
                held.append((block, key, weight, flat[off[r]:off[r + 1]].copy()))
        if held:
            out.extend(judged())
        if out:
            yield batch_of()

    return run


SAME = ["size", "h1", "h2"]


def class_texts(docs: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(text, node): the text of one document of every class (node, one: digest and id of a row) that ``nodes`` names; repeated rows come more than once."""
    ones = classes.join(nodes.select("node").distinct(), "node").select(F.col("one.digest").alias("d"), F.col("one.id").alias("i"), "node")
    return docs.join(ones, (F.col("digest") == F.col("d")) & F.col("id").eqNullSafe(F.col("i"))).select("text", "node")


def digested(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, digest, text): the digest names the text of a row where ids repeat."""
    text = F.col(f"`{text_col}`")
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.md5(F.coalesce(text, F.lit("")).cast("binary")).alias("digest"), text.alias("text"))


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD,
                    recall: float = RECALL, small: int = SMALL, crowd: int = CROWD, block: int = BLOCK) -> DataFrame:
    """One row per document: id, class id (the smallest id of its class) and number of links."""
    runs = runs_for(recall, threshold)
    docs = digested(docs, id_col, text_col)
    schema = T.StructType([docs.schema["id"], docs.schema["digest"], T.StructField("size", T.IntegerType()), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()),
                           T.StructField("sketch", T.BinaryType()), T.StructField("chosen", T._parse_datatype_string("array<struct<slot:int,token:bigint>>"))])
    sk = stored(arrow_map(docs, _sketches(shingle, threshold, runs, LEVELS), schema))
    classes = sk.where("size > 0").groupBy(*SAME).agg(F.min("id").alias("least"), F.count("*").alias("weight"), F.min(F.struct("digest", "id")).alias("one"),
                                                      F.min("sketch").alias("sketch"), F.min("chosen").alias("chosen"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()))

    level = classes.select("node", F.explode("chosen").alias("c")).select("node", (F.col("c.slot") / LEVELS).cast("int").alias("run"), (F.col("c.slot") % LEVELS).alias("level"), "c.token")
    paths = level.where("level = 0").select("node", "run", F.xxhash64("run", "token").alias("bucket"))
    leaves = None
    for depth in range(1, LEVELS + 1):
        counted = paths.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
        paths = stored(paths.join(counted, "bucket"))
        done = paths if depth == LEVELS else paths.where(F.col("n") <= small)
        leaves = done if leaves is None else leaves.unionByName(done)
        if depth < LEVELS:
            deeper = level.where(F.col("level") == depth).select("node", "run", "token")
            longer = paths.where(F.col("n") > small).select("node", "run", "bucket").join(deeper, ["node", "run"])
            paths = stored(longer.select("node", "run", F.xxhash64("bucket", "token").alias("bucket")))  # counted and kept: made once
    salt = F.when(F.col("n") > crowd, F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / crowd))).otherwise(F.lit(-1)).cast("int")
    members = leaves.select("node", "bucket", salt.alias("salt")).join(classes.select("node", "sketch"), "node").select("bucket", "salt", F.col("node").alias("id"), "sketch")
    ties = stored(arrow_map(members.repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", "id"),
                            _buckets(False), "u long, v long, bucket long, sketch binary"))
    # the pivots of a cut bucket meet in pairs of blocks, so however many there are no task holds them all
    pivots = ties.where("bucket is not null").select("bucket", F.col("u").alias("id"), "sketch")
    sizes = pivots.groupBy("bucket").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    paired = F.expr("transform(sequence(0, blocks - 1), x -> least(x, block) * blocks + greatest(x, block))")
    pivots = pivots.join(sizes, "bucket").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).select("bucket", F.explode(paired).alias("salt"), "id", "sketch")
    met = arrow_map(pivots.repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", "id"), _buckets(True), "u long, v long, bucket long, sketch binary")
    comp = stored(components(ties.where("bucket is null").select("u", "v").union(met.select("u", "v"))))

    crowded = comp.groupBy("root").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    member = comp.join(crowded, "root").select("node", "root", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    member = member.join(classes.select("node", "weight"), "node")
    tokens = arrow_map(class_texts(docs, classes, comp), _token_sets(shingle), "tokens array<long>, node long").dropDuplicates(["node"]).join(member, "node")
    pairs = F.expr("transform(sequence(0, blocks - 1), x -> struct(least(x, block) as p, greatest(x, block) as q))")
    dealt = (tokens.select("root", F.explode(pairs).alias("pq"), "tokens", "node", "weight", "block")
             .select("root", "pq.p", "pq.q", "tokens", F.col("node").alias("id"), "weight", "block").repartition("root", "p", "q").sortWithinPartitions("root", "p", "q"))
    verified = stored(arrow_map(dealt, _verify(threshold), "u long, v long, links long"))
    links = verified.groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    found = classes.select("node", "least", "weight", *SAME).join(links, "node", "left").join(components(verified.select("u", "v")), "node", "left")
    found = found.select("least", *SAME, F.coalesce("root", "node").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"))
    found = stored(found)
    per_set = found.join(found.groupBy("root").agg(F.min("least").alias("class")), "root").select(*SAME, "class", "links")
    out = sk.select("id", *SAME).join(per_set, SAME, "left")
    return out.select(F.col("id").alias(id_col), F.when(F.col("size") > 0, F.col("class")).otherwise(F.col("id")).alias("class_id"),
                      F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))
