"""Exact k-NN by pivots (J5): an index of cells and a join that visits only the cells that can hold a neighbour.

Index. A bounded number of items serve as pivots; every item belongs to the cell of its nearest pivot and keeps its
distance to it. Cells are packed into blocks of at most ``i_block`` items; a larger cell (many equal vectors, say) is
cut into parts by the hash of the ids. Pivots, cell sizes, radii and the ``NEAR`` smallest distances of each cell are the only things that
reach the driver: ``MAX_PIVOTS`` rows whatever the number of items.

Search. With d the Euclidean distance, p the pivot of a cell with distances between lo and hi, and o the pivot nearest to the
query q, every item x of the cell has d(q, x) >= d(q, p) - hi, >= lo - d(q, p) and >= (d(q, p)^2 - d(q, o)^2) / (2 d(p, o)).

1. A cell whose k-th smallest distance to its pivot is r holds k items within d(q, p) + r: the least such sum is the query's bound,
   known without any item.
2. The query visits the blocks with a cell that the bounds do not rule out. Within a block its nearest cells are scored first, which tightens
   the bound, then the cells that are still open; where most of a block is open (vectors without structure) it is scored as a whole.

Items are grouped by block and never copied, unless so many queries ask for one block that they are cut into parts of ``q_block``;
a query travels once to every block it has to visit.

Where the queries would visit more than ``VISITS`` blocks each on average (vectors without structure), they stay where they are and all items
pass by (``passing``): packs of items are written once, every task holds a pack of queries with their k best so far and reads one pack of items after the
other. Nothing is copied, so what is written grows with the queries and the items, not with their product. A product of
4-byte floats rules items out with a margin for its rounding; what is left is scored exactly.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from factlens.session import ensure_checkpoint_dir

MAX_PIVOTS, NEAR = 1024, 64
DENSE = 0.25  # share of a block's (query, item) pairs from which on it is scored as a whole
SLACK = 1e-9  # relative; bounds never rule out a tie by rounding
ROWS = 512  # rows whose distances to all pivots a task holds at once (4 MB an array)
ROUTED = 8192  # routed rows handed on at once
VISITS = 2  # mean number of blocks a query may be sent to
PACK_BYTES = 1 << 23  # vectors of a pack of items (16384 of 64 dimensions)
HEAD, WIDE = 1024, 4096  # items in the first and in the other products; the first one gives bounds
FEW = 8  # a row's candidates, in multiples of k, from which on a product is used for its bounds, or candidates are merged
PAIRS = 8192  # pairs scored exactly at once


@dataclass
class PivotIndex:
    """``items``: item_id, v, cell, block. The arrays have one entry a cell."""

    items: DataFrame
    pivots: np.ndarray
    count: np.ndarray
    low: np.ndarray
    high: np.ndarray
    near: np.ndarray
    first_block: np.ndarray
    parts: np.ndarray
    i_block: int

    @property
    def n_blocks(self) -> int:
        return int((self.first_block + self.parts).max()) if len(self.parts) else 0

    def geometry(self) -> "Geometry":
        return Geometry(self.pivots, self.low, self.high, self.near, self.count, self.first_block, self.parts)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a and b."""
    return np.maximum(np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None, :] - 2.0 * (a @ b.T), 0.0)


class Geometry:
    """What a task needs to know of the cells."""

    def __init__(self, pivots, low, high, near, count, first_block, parts):
        self.pivots, self.low, self.high, self.near, self.count, self.first_block, self.parts = pivots, low, high, near, count, first_block, parts
        self.between = np.sqrt(_squared(pivots, pivots))

    def distances(self, q: np.ndarray) -> np.ndarray:
        return np.sqrt(_squared(q, self.pivots))

    def lower(self, d: np.ndarray) -> np.ndarray:
        """Lower bounds of the distance of every query to the items of every cell."""
        near = d.argmin(axis=1)
        nearest = d[np.arange(len(d)), near]
        gap = self.between[near]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = np.where(gap > 0, (d * d - (nearest * nearest)[:, None]) / (2 * gap), 0.0)
        bound = np.maximum(np.maximum(d - self.high[None, :], self.low[None, :] - d), np.maximum(plane, 0.0))
        return np.where(self.count[None, :] > 0, np.maximum(bound - 1e-7, 0.0), np.inf)  # distances by products are good to about 1e-8

    def open_cells(self, d: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Cells that may hold an item at squared distance ``bound`` or less."""
        return self.lower(d) ** 2 <= (bound + SLACK * (1 + np.abs(bound)))[:, None]

    def bound(self, d: np.ndarray, k: int) -> np.ndarray:
        """Squared distance within which every query has at least k items."""
        reach = np.where(self.count >= k, self.near[:, k - 1] if k <= NEAR else self.high, np.inf)
        return (np.min(d + reach[None, :], axis=1) + 1e-7) ** 2

    def home_cells(self, d: np.ndarray, k: int) -> np.ndarray:
        """The nearest cells that together hold k items."""
        order = np.argsort(np.where(self.count[None, :] > 0, d, np.inf), axis=1, kind="stable")
        per_part = np.ceil(self.count / np.maximum(self.parts, 1))[order]
        before = np.cumsum(per_part, axis=1) - per_part
        out = np.zeros(d.shape, dtype=bool)
        np.put_along_axis(out, order, (before < k) & (per_part > 0), axis=1)
        return out

    def blocks(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, block) of the blocks that hold the marked cells, each once."""
        row, cell = [], []
        for n in range(len(cells)):
            c = np.flatnonzero(cells[n])
            k = self.parts[c]
            b = np.unique(np.repeat(self.first_block[c] - (np.cumsum(k) - k), k) + np.arange(k.sum()))
            row.append(np.full(len(b), n))
            cell.append(b)
        return (np.concatenate(row), np.concatenate(cell)) if row else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))


    def visits(self, cells: np.ndarray) -> int:
        """Number of (row, block) pairs of ``blocks``, without making them."""
        order = np.argsort(self.first_block, kind="stable")
        first = self.first_block[order]
        start = np.flatnonzero(np.r_[True, first[1:] != first[:-1]])
        return int((np.logical_or.reduceat(cells[:, order], start, axis=1) * np.maximum.reduceat(self.parts[order], start)).sum())


def _matrix(v: pd.Series) -> np.ndarray:
    return np.stack(v.to_numpy()).astype(np.float64, copy=False)


def pivot_index(items: DataFrame, i_block: int, n_pivots: int | None = None) -> PivotIndex:
    """Index over a stored table (item_id, v), v not null."""
    spark = items.sparkSession
    n = items.count()
    wanted = n_pivots or max(1, min(MAX_PIVOTS, math.isqrt(n)))
    h = F.xxhash64("item_id")  # only about as many rows as are wanted are sorted, or tasks would all send that many
    some = items.where(h <= min(2 ** 63 - 1, math.ceil(6 * wanted / n * 2 ** 64) - 2 ** 63)) if n else items
    sample = some.orderBy(h, "item_id").limit(4 * wanted).select("v").collect() or items.select("v").limit(1).collect()  # bounded by MAX_PIVOTS
    distinct = np.unique(np.array([r.v for r in sample], dtype=np.float64), axis=0) if sample else np.zeros((0, 1))
    order = np.random.default_rng(0).permutation(len(distinct))[:wanted]
    pivots = distinct[np.sort(order)]

    def assign(batches):
        for pdf in batches:
            for at in range(0, len(pdf), ROWS):
                some = pdf.iloc[at:at + ROWS]
                d = _squared(_matrix(some["v"]), pivots)
                cell = d.argmin(axis=1)
                yield some.assign(cell=cell.astype(np.int32), r=np.sqrt(d[np.arange(len(d)), cell]))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in items.schema)
    placed = items.mapInPandas(assign, f"{kinds}, cell int, r double").checkpoint(eager=True) if n else items.selectExpr("*", "cast(0 as int) as cell", "cast(0 as double) as r")
    count, low, high = (np.zeros(len(pivots)) for _ in range(3))
    near = np.full((len(pivots), NEAR), np.inf)
    for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("lo"), F.max("r").alias("hi")).collect():
        count[r.cell], low[r.cell], high[r.cell] = r.n, r.lo, r.hi
    closest = placed.select("cell", "r").mapInPandas(_closest, "cell int, r double")
    ranked = closest.withColumn("i", F.row_number().over(Window.partitionBy("cell").orderBy("r"))).where(F.col("i") <= NEAR)
    for r in ranked.collect():  # at most NEAR numbers a cell
        near[r.cell, r.i - 1] = r.r
    parts, first, block, room = np.ones(len(pivots), dtype=np.int64), np.zeros(len(pivots), dtype=np.int64), -1, 0
    near_first = np.argsort(_squared(pivots[:1], pivots)[0], kind="stable") if len(pivots) else []
    for c in near_first:  # cells of one region share blocks
        size = int(count[c])
        if size > i_block:
            parts[c], first[c] = math.ceil(size / i_block), block + 1
            block, room = block + int(parts[c]), 0
        else:
            if size > room or block < 0:
                block, room = block + 1, i_block
            first[c], room = block, room - size
    if n:
        where = F.element_at(F.lit([int(x) for x in first]), F.col("cell") + 1)
        part = F.pmod(F.xxhash64("item_id"), F.element_at(F.lit([int(x) for x in parts]), F.col("cell") + 1).cast("long"))
        placed = placed.withColumn("block", (where + part).cast("int"))
    return PivotIndex(placed, pivots, count, low, high, near, first, parts, i_block)


def _closest(batches):
    """The ``NEAR`` smallest distances of every cell in what a task reads."""
    held = None
    for pdf in batches:
        held = pdf if held is None else pd.concat([held, pdf])
        held = held.sort_values("r", kind="stable").groupby("cell").head(NEAR)
    if held is not None:
        yield held


def empty_hits() -> pd.DataFrame:
    """No rows; object columns, as ids may be of any type."""
    return pd.DataFrame({"qid": pd.Series([], dtype=object), "item_id": pd.Series([], dtype=object), "score": pd.Series([], dtype="float64")})


def search(index: PivotIndex, queries: DataFrame, k: int, exclude_self: bool, topk, q_block: int) -> DataFrame:
    """(qid, item_id, score): a superset of the k nearest items of every query of the stored table ``queries`` (qid, v)."""
    geometry = index.geometry()
    qid = queries.schema["qid"].dataType.simpleString()
    item_id = index.items.schema["item_id"].dataType.simpleString()
    need = k + 1 if exclude_self else k

    def route(batches):
        for pdf in batches:
            for at in range(0, len(pdf), ROWS):
                some = pdf.iloc[at:at + ROWS]
                d = geometry.distances(_matrix(some["v"]))
                bound = geometry.bound(d, need)
                row, block = geometry.blocks(geometry.open_cells(d, bound))
                for lo in range(0, len(row), ROUTED):  # a row may go to every block
                    part = row[lo:lo + ROUTED]
                    yield some.iloc[part].assign(bound=bound[part], block=block[lo:lo + ROUTED].astype(np.int32))

    def visits(batches):
        for pdf in batches:
            for at in range(0, len(pdf), ROWS):
                d = geometry.distances(_matrix(pdf["v"].iloc[at:at + ROWS]))
                yield pd.DataFrame({"rows": [len(d)], "visits": [geometry.visits(geometry.open_cells(d, geometry.bound(d, need)))]})

    def near(Q, codes, bound, X, i_at, here, own, of) -> list[tuple]:
        """Hits of some queries in a block with the cells ``here``."""
        d = geometry.distances(Q)
        asked = geometry.open_cells(d, bound)[:, here]
        if (asked * own[None, :]).sum() > DENSE * len(Q) * len(X):
            return [topk(codes, Q, i_at, X, k, "l2sq", exclude_self)]
        first = geometry.home_cells(d, need)[:, here] & asked
        found = []
        for cells in (first, None):
            if cells is None:
                if found:
                    bound = np.minimum(bound, 1.0 - _kth(codes, *(np.concatenate(x) for x in zip(*found)), k))
                cells = geometry.open_cells(d, bound)[:, here] & ~first
            for n, at in enumerate(of):
                ask = np.flatnonzero(cells[:, n])
                if len(ask):
                    found.append(topk(codes[ask], Q[ask], i_at[at], X[at], k, "l2sq", exclude_self))
        return found

    def score(qpdf: pd.DataFrame, ipdf: pd.DataFrame) -> pd.DataFrame:
        if len(qpdf) == 0 or len(ipdf) == 0:
            return empty_hits()
        Q, X = _matrix(qpdf["v"]), _matrix(ipdf["v"])
        q_keys, q_at = np.unique(qpdf["qid"].to_numpy(), return_inverse=True)
        i_keys, i_at = np.unique(ipdf["item_id"].to_numpy(), return_inverse=True)  # ties go to the smaller id: its rank
        place = {x: n for n, x in enumerate(i_keys.tolist())} if exclude_self else {}
        codes = np.array([place.get(x, -1 - n) for n, x in enumerate(q_keys.tolist())], dtype=np.int64)[q_at]
        back = dict(zip(codes.tolist(), qpdf["qid"].tolist()))
        cell = ipdf["cell"].to_numpy()
        bounds = qpdf["bound"].to_numpy(np.float64)
        here, own = np.unique(cell, return_counts=True)
        of = np.split(np.argsort(cell, kind="stable"), np.cumsum(own)[:-1])  # places of every cell's items
        found = []
        for at in range(0, len(Q), ROWS):
            hits = near(Q[at:at + ROWS], codes[at:at + ROWS], bounds[at:at + ROWS], X, i_at, here, own, of)
            if hits:
                hits = tuple(np.concatenate(x) for x in zip(*hits))
                keep = _best(*hits, k)
                found.append(tuple(x[keep] for x in hits))
        q, i, s = (np.concatenate(x) for x in zip(*found)) if found else ([], [], [])
        if not len(q):
            return empty_hits()
        keep = _best(q, i, s, k)
        return pd.DataFrame({"qid": [back[x] for x in q[keep].tolist()], "item_id": i_keys[i[keep]], "score": s[keep]})

    if not len(index.pivots):
        return queries.selectExpr("qid", f"cast(null as {item_id}) as item_id", "cast(null as double) as score").where("false")
    if index.n_blocks > VISITS:
        seen = queries.select("v").mapInPandas(visits, "rows long, visits long").agg(F.sum("rows").alias("rows"), F.sum("visits").alias("visits")).first()
        if seen.rows and seen.visits > VISITS * seen.rows:
            return passing(index, queries, k, exclude_self, q_block)
    asked = queries.select("qid", "v").mapInPandas(route, f"qid {qid}, v array<double>, bound double, block int").checkpoint(eager=True)
    load = {r.block: math.ceil(r.n / q_block) for r in asked.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a block
    copies = F.lit([int(load.get(b, 0)) for b in range(max(index.n_blocks, 1))])
    turn: Column = F.element_at(copies, F.col("block") + 1)
    asked = asked.withColumn("part", F.pmod(F.xxhash64("qid"), turn.cast("long")).cast("int"))
    items = index.items.where(turn > 0).select("item_id", "v", "cell", "block", F.explode(F.sequence(F.lit(0), turn - 1)).alias("part"))
    return (asked.groupBy("block", "part").cogroup(items.groupBy("block", "part"))
            .applyInPandas(score, f"qid {qid}, item_id {item_id}, score double"))


def exact_scores(X: np.ndarray, q: np.ndarray) -> np.ndarray:
    """1 - squared distance, summed left to right over the dimensions so equal vectors give bit-equal
    scores (SIMD reductions depend on memory alignment and would break ties)."""
    d = X - q
    acc = np.zeros(d.shape[:-1])
    for j in range(d.shape[-1]):
        acc += d[..., j] * d[..., j]
    return 1.0 - acc


def _to_bytes(ids: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.record_batch([ids], names=["id"])
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _from_bytes(data: bytes) -> pa.Array:
    return pa.ipc.open_stream(data).read_next_batch().column(0)


def _ranks(ids: pa.Array) -> np.ndarray:
    """Equal ids have equal numbers, smaller ids smaller ones; null comes first, as in Spark."""
    return pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)


def _nearer(ids: pa.Array, m: np.ndarray, keep: int) -> np.ndarray:
    """Places of the rows that can be among the best of a query: of equal vectors those with the ``keep`` smallest ids."""
    _, same = np.unique(np.ascontiguousarray(m).view(np.dtype((np.void, m.shape[1] * 8))).ravel(), return_inverse=True)
    rank = _ranks(ids)
    order = np.lexsort((rank, same))
    group, rank = same[order], rank[order]
    new = np.r_[True, group[1:] != group[:-1]]
    step = np.cumsum(np.r_[True, (rank[1:] != rank[:-1]) | new[1:]])
    return np.sort(order[step - np.maximum.accumulate(np.where(new, step, 0)) < keep])


def _packs(rows: int, keep: int | None = None):
    """mapInArrow: (id, v) rows to packs of at most ``rows`` and ``PACK_BYTES``: ids (an Arrow stream) and vectors (float64). ``keep``: see ``_nearer``."""

    def pack(ids: list, ms: list, no: int) -> pa.RecordBatch:
        i, m = pa.concat_arrays(ids), np.concatenate(ms)
        sound = np.isfinite(m).all(axis=1)  # others have no distances
        if not sound.all():
            i, m = i.filter(pa.array(sound)), m[sound]
        if keep is not None and m.shape[1]:
            some = _nearer(i, m, keep)
            i, m = i.take(pa.array(some)), m[some]
        return pa.record_batch([pa.array([no], pa.int32()), pa.array([len(m)], pa.int32()), pa.array([_to_bytes(i)], pa.binary()), pa.array([m.tobytes()], pa.binary())], names=["no", "n", "ids", "v"])

    def run(batches):
        ids, ms, held, no = [], [], 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            m = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(np.float64, copy=False)
            most, at = max(1, min(rows, PACK_BYTES // max(8 * m.shape[1], 1))), 0
            while at < len(m):
                n = min(len(m) - at, most - held)
                ids.append(b.column(0).slice(at, n))
                ms.append(m[at:at + n].copy())
                at, held = at + n, held + n
                if held == most:
                    yield pack(ids, ms, no)
                    ids, ms, held, no = [], [], 0, no + 1
        if held:
            yield pack(ids, ms, no)

    return run


class _Pack:
    def __init__(self, row):
        self.ids = _from_bytes(bytes(row.ids))
        self.m = np.frombuffer(row.v, dtype=np.float64).reshape(row.n, -1)

    def lengths(self, center: np.ndarray) -> np.ndarray:
        """Squared distances to ``center``."""
        return np.concatenate([np.einsum("ij,ij->i", x, x) for x in (self.m[at:at + WIDE] - center for at in range(0, len(self.m), WIDE))])

    def small(self, center: np.ndarray, scale: float, last) -> np.ndarray:
        """The vectors in 4-byte floats, with ``last`` as one more dimension."""
        out = np.empty((len(self.m), self.m.shape[1] + 1), dtype=np.float32)
        for at in range(0, len(out), WIDE):
            out[at:at + WIDE, :-1] = (self.m[at:at + WIDE] - center) / math.sqrt(scale)
        out[:, -1] = last
        return out


class _Asked(_Pack):
    """A pack of queries with the k best items of each so far."""

    def __init__(self, row, k: int, exclude_self: bool):
        super().__init__(row)
        self.k, self.exclude_self = k, exclude_self
        self.score = np.full((len(self.m), k), -np.inf)
        self.item = np.zeros((len(self.m), k), dtype=np.int64)  # places in ``known``
        self.known = None

    def meet(self, items: _Pack) -> None:
        """Takes what is better in a pack of items."""
        if not len(items.m) or not len(self.m):
            return
        # moved and scaled, so that rounding is measured against the spread of the vectors
        center = items.m.mean(axis=0)
        x2, q2 = items.lengths(center), self.lengths(center)
        scale = max(float(x2.max()), float(q2.max())) or 1.0
        x2, q2 = x2 / scale, q2 / scale
        Xf, Qf = items.small(center, scale, -0.5 * x2), self.small(center, scale, 1.0)
        d, widest = self.m.shape[1], max(float(np.abs(items.m).max()), float(np.abs(self.m).max()))
        err = (d + 8) * 2.0 ** -23 * 1.5 + 4 * math.sqrt(d) * 2.0 ** -52 * widest / math.sqrt(scale)  # of a product q.x - x.x / 2 of lengths 1 at most
        own_q, own_x = self._own(items)
        base = 0 if self.known is None else len(self.known)
        self.known = items.ids if self.known is None else pa.concat_arrays([self.known, items.ids])
        for lo in range(0, len(self.m), ROWS):
            hi = min(lo + ROWS, len(self.m))
            of = slice(*np.searchsorted(own_q, [lo, hi]))
            held, n_held, least = [], 0, self._least(lo, hi, q2, scale, err)
            for a in [0, *range(HEAD, len(Xf), WIDE)]:
                b = min(a + (WIDE if a else HEAD), len(Xf))
                g = Qf[lo:hi] @ Xf[a:b].T
                here = (own_x[of] >= a) & (own_x[of] < b)
                g[own_q[of][here] - lo, own_x[of][here] - a] = -np.inf
                found = np.flatnonzero(g >= least[:, None])
                if len(found) > FEW * self.k * len(g) and b - a > self.k:
                    kth = np.partition(g, b - a - self.k, axis=1)[:, b - a - self.k].astype(np.float64)
                    found = np.flatnonzero(g >= np.maximum(least, (kth - 2 * err).astype(np.float32))[:, None])
                if not len(found):
                    continue
                r, c = np.divmod(found, b - a)
                for at in range(0, len(r), PAIRS):
                    q, x = lo + r[at:at + PAIRS], a + c[at:at + PAIRS]
                    held.append((q, base + x, exact_scores(items.m[x], self.m[q])))
                    n_held += len(q)
                    if n_held > FEW * self.k * (hi - lo):
                        self._merge(held)
                        held, n_held = [], 0
                if not a and held:  # bounds for what follows
                    self._merge(held)
                    held, n_held = [], 0
                if not held:
                    least = self._least(lo, hi, q2, scale, err)
            if held:
                self._merge(held)
        self._forget()

    def _own(self, items: _Pack) -> tuple[np.ndarray, np.ndarray]:
        """(query, item) places of equal ids, by query, where they are left out."""
        a, b = self.ids.type, items.ids.type
        if not self.exclude_self or a != b and not (pa.types.is_integer(a) and pa.types.is_integer(b)):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        coded = items.ids.dictionary_encode()
        code = pc.index_in(self.ids.cast(items.ids.type), value_set=coded.dictionary, skip_nulls=True)
        at = np.flatnonzero(code.is_valid().to_numpy(zero_copy_only=False))
        code, place = code.drop_null().to_numpy(), coded.indices.to_numpy()
        order = np.argsort(place, kind="stable")
        first, last = (np.searchsorted(place[order], code, side=x) for x in ("left", "right"))
        n = last - first
        return np.repeat(at, n), order[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())]

    def _least(self, lo: int, hi: int, q2: np.ndarray, scale: float, err: float) -> np.ndarray:
        """The least product with which an item may be among the k best of these queries."""
        far = 1.0 - self.score[lo:hi, -1]
        far += (self.m.shape[1] + 8) * 2.0 ** -52 * (1 + np.abs(far))  # rounding of the exact scores
        return np.maximum((q2[lo:hi] - far / scale) / 2 - 2 * err, -1e30).astype(np.float32)

    def _merge(self, held: list) -> None:
        q, x, s = (np.concatenate(v) for v in zip(*held))
        rows = np.unique(q)
        old = np.isfinite(self.score[rows])
        q = np.concatenate([np.repeat(rows, old.sum(axis=1)), q])
        x = np.concatenate([self.item[rows][old], x])
        s = np.concatenate([self.score[rows][old], s])
        best = _best(q, _ranks(self.known.take(pa.array(x))), s, self.k)
        q, x, s = q[best], x[best], s[best]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        self.score[rows], self.item[rows] = -np.inf, 0
        self.score[q, place], self.item[q, place] = s, x

    def _forget(self) -> None:
        """Keeps the ids of the best items only."""
        some, at = np.unique(self.item, return_inverse=True)
        self.known, self.item = self.known.take(pa.array(some)), at.reshape(self.item.shape)

    def hits(self) -> pa.RecordBatch | None:
        if self.known is None:
            return None
        full = np.isfinite(self.score)
        return pa.record_batch([self.ids.take(pa.array(np.repeat(np.arange(len(full)), full.sum(axis=1)))), self.known.take(pa.array(self.item[full])),
                                pa.array(self.score[full])], names=["qid", "item_id", "score"])


def passing(index: PivotIndex, queries: DataFrame, k: int, exclude_self: bool, q_block: int) -> DataFrame:
    """(qid, item_id, score): the k nearest items of every query, by letting all items pass by every pack of queries."""
    spark = queries.sparkSession
    qid, item_id = queries.schema["qid"].dataType.simpleString(), index.items.schema["item_id"].dataType.simpleString()
    q, items = queries.select("qid", "v"), index.items.select("item_id", "v")
    if exclude_self:  # null is not known to be another id
        q, items = q.where("qid is not null"), items.where("item_id is not null")
    least = 4 * spark.sparkContext.defaultParallelism
    if q.rdd.getNumPartitions() < least:
        q = q.repartition(least)
    kind = "no int, n int, ids binary, v binary"
    ensure_checkpoint_dir(spark)
    rows = max(1, min(index.i_block, PACK_BYTES // (8 * max(index.pivots.shape[1], 1))))
    items = items.coalesce(max(1, math.ceil(index.count.sum() / rows)))
    packs = items.mapInArrow(_packs(rows, k + 1 if exclude_self else k), kind).rdd.map(lambda r: Row(no=r.no, n=r.n, ids=bytes(r.ids), v=bytes(r.v)))
    packs.checkpoint()
    packs.count()
    # one partition, that is read pack by pack and anew for every pack of queries: neither side is copied or gathered
    pairs = q.mapInArrow(_packs(q_block), kind).rdd.cartesian(packs.coalesce(1))

    def score(pairs):
        asked: dict[int, _Asked] = {}
        for x, y in pairs:
            if x.no not in asked:
                asked[x.no] = _Asked(x, k, exclude_self)
            asked[x.no].meet(_Pack(y))
        for a in asked.values():
            hits = a.hits()
            if hits is not None:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, hits.schema) as out:
                    out.write_batch(hits)
                yield (sink.getvalue().to_pybytes(),)

    def unpack(batches):
        for b in batches:
            for data in b.column(0):
                yield from pa.ipc.open_stream(data.as_py())

    found = spark.createDataFrame(pairs.mapPartitions(score), "hits binary", verifySchema=False)
    return found.mapInArrow(unpack, f"qid {qid}, item_id {item_id}, score double")


def _best(q, i, s, k: int) -> np.ndarray:
    """Places of the k best rows of every query."""
    order = np.lexsort((i, -s, q))
    new = np.ones(len(order), dtype=bool)
    new[1:] = q[order][1:] != q[order][:-1]
    start = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return order[np.arange(len(order)) - start < k]


def _kth(codes, q, i, s, k: int) -> np.ndarray:
    """The k-th best score found for every query, -inf where fewer are."""
    order = np.lexsort((-s, q))
    keys, start, count = np.unique(q[order], return_index=True, return_counts=True)
    full = {key: s[order][a + k - 1] for key, a, n in zip(keys.tolist(), start.tolist(), count.tolist()) if n >= k}
    return np.array([full.get(c, -np.inf) for c in codes.tolist()])


def nearest(index: PivotIndex, queries: DataFrame, k: int, exclude_self: bool, topk, q_block: int) -> DataFrame:
    """``qid, item_id, score, rank``; ties by the smaller item id."""
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), "item_id")
    hits = search(index, queries, k, exclude_self, topk, q_block)
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
