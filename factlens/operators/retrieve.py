"""Vector retrieval: M7 embed_text, J5 knn_join, J6 multi_query_retrieve, W3 top_k,
L1 select_evidence.

k-NN (exact) runs over a pivot index (``operators/pivots.py``): cells around pivots, bounds by the
triangle inequality, and only the cells that can hold a neighbour are visited; a block of
them is scored with numpy matrix products. Similarities that are no distances (cosine, inner product) are
scanned by a grid of blocks: queries in QB, items in IB blocks, each side copied across the other's blocks, so a task holds
one tile of ``<= q_block`` queries x ``<= i_block`` items and gives its local top-k.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factlens.operators import pivots as P
from factlens.session import ensure_checkpoint_dir

TOKEN_SPLIT_RE = r"[^\p{L}\p{N}]+"


# M7 ----------------------------------------------------------------------------

def token_bucket(tok: Column, dim: int) -> Column:
    """Feature index of a token: first 8 hex digits of md5 as an integer, mod dim
    (JVM form of the rule ``_embed_batch`` applies)."""
    return F.pmod(F.conv(F.substring(F.md5(tok), 1, 8), 16, 10).cast("bigint"), F.lit(dim)).cast("int")


SLICE_CHARS = 1 << 19  # characters whose tokens a Python worker holds at once (or one longer text)
BATCH_ROWS = 1000      # whole texts in an Arrow batch


def bounded_batches(spark) -> None:
    """From now on Arrow batches of the session hold at most ``BATCH_ROWS`` rows: for steps that send whole texts to Python."""
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def text_slices(texts: pd.Series, chars: int = SLICE_CHARS):
    """``texts`` in runs of at most ``chars`` characters (a longer text is a run of its own); one empty run for no texts."""
    if not len(texts):
        yield texts
    ends = np.cumsum([len(t) if isinstance(t, str) else 0 for t in texts])
    lo = 0
    while lo < len(texts):
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + chars, side="right")))
        yield texts.iloc[lo:hi]
        lo = hi


def _embed_batch(texts: pd.Series, dim: int) -> pd.Series:
    """The vectors of one Arrow batch, slice by slice."""
    return pd.concat([_embed_slice(t, dim) for t in text_slices(texts)], ignore_index=True)


def _embed_slice(texts: pd.Series, dim: int) -> pd.Series:
    """Hashed bag of words for some texts: lower-case, split on non letters /
    digits, bucket = int(md5(token)[:8], 16) % dim, counts L2-normalised. Only the
    slice's distinct tokens are hashed; counting is one ``bincount`` for the slice."""
    import hashlib

    import regex

    split = regex.compile(TOKEN_SPLIT_RE).split
    toks = [[x for x in split(t.lower()) if x] if isinstance(t, str) else [] for t in texts]
    lens = np.fromiter((len(t) for t in toks), dtype=np.int64, count=len(toks))
    n = len(toks)
    if lens.sum() == 0:
        return pd.Series([None] * n, dtype="object")
    codes, uniq = pd.factorize(pd.Series([x for t in toks for x in t], dtype="object"))
    ub = np.fromiter((int(hashlib.md5(u.encode("utf-8")).hexdigest()[:8], 16) % dim for u in uniq),
                     dtype=np.int64, count=len(uniq))
    rows = np.repeat(np.arange(n, dtype=np.int64), lens)
    counts = np.bincount(rows * dim + ub[codes], minlength=n * dim).reshape(n, dim).astype(np.float64)
    norms = np.sqrt(np.einsum("ij,ij->i", counts, counts))
    return pd.Series([counts[i] / norms[i] if lens[i] else None for i in range(n)], dtype="object")


def embed_text(df: DataFrame, id_col: str, text_col: str, dim: int = 64, out_col: str = "embedding",
               keep_text: bool = False) -> DataFrame:
    """M7: hashed bag-of-words vector, L2-normalised; NULL for a text without any
    token. A narrow per-row step (no shuffle), vectorised per Arrow batch.

    No filter is applied here on purpose: a filter on the UDF result would be pushed
    below earlier exchanges and evaluate the UDF a second time. Consumers drop NULL
    vectors after materialising them (``knn_join`` does)."""
    bounded_batches(df.sparkSession)
    emb = F.pandas_udf(lambda s: _embed_batch(s, dim), "array<double>")
    keep = [c for c in df.columns if keep_text or c != text_col]
    return df.select(*keep, emb(F.col(text_col)).alias(out_col))


# J5 ----------------------------------------------------------------------------

def _exact_scores(Xc, q, metric, approx):
    """Exact scores of candidate rows ``Xc`` (..., d) against ``q`` (..., d)."""
    if metric != "l2sq":
        return approx
    return P.exact_scores(Xc, q)


TILE_SCORE_BUDGET = 1 << 21   # doubles in one sub-block score matrix (16 MB)
I_BLOCK = 32768               # items of a task (16 MB of 64 dimensions)


def _tile_topk(q_ids, Q, i_ids, X, k, metric, exclude_self, sub=None, margin=8):
    """Top-k items per query for one tile; returns (qid, item_id, score) arrays.

    Per sub-block of queries: approximate scores by one matrix product, the
    ``k + margin`` best candidates per row by ``argpartition``, exact re-scores of
    those, order by (score desc, item id). A row whose near-tie band (within 1e-9 of
    its k-th score) does not fit in the candidates is redone over all items."""
    none = np.zeros(0, dtype=np.int64)
    out_q, out_i, out_s = [none], [none], [np.zeros(0)]
    n = len(i_ids)
    if n == 0 or len(q_ids) == 0:
        return out_q[0], out_i[0], out_s[0]
    x2 = np.einsum("ij,ij->i", X, X)
    kk = min(k, n)
    c = min(n, kk + margin)
    sub = sub or max(16, min(1024, TILE_SCORE_BUDGET // n))
    for s0 in range(0, len(q_ids), sub):
        qb = Q[s0:s0 + sub]
        ids = q_ids[s0:s0 + sub]
        far = qb @ X.T  # becomes minus the score; the one array of this size, worked on in place
        if metric == "l2sq":
            far *= -2.0
            far += x2[None, :]
            far += np.einsum("ij,ij->i", qb, qb)[:, None]
            far -= 1.0
        elif metric == "cosine":
            qn = np.sqrt(np.einsum("ij,ij->i", qb, qb))
            far /= -(qn[:, None] * np.sqrt(x2)[None, :])
        else:  # inner product
            np.negative(far, out=far)
        if exclude_self:
            far[ids[:, None] == i_ids[None, :]] = np.inf
        rows = np.arange(len(ids))[:, None]
        if c < n:
            cand = np.argpartition(far, c - 1, axis=1)[:, :c].copy()  # not a view of all places
            cs = -far[rows, cand]
            srt = -np.sort(-cs, axis=1)
            safe = srt[:, c - 1] < srt[:, kk - 1] - 1e-9      # band fits in the candidates
        else:
            cand = np.broadcast_to(np.arange(n), (len(ids), n))
            cs = -far
            safe = np.ones(len(ids), dtype=bool)
        sc = _exact_scores(X[cand], qb[:, None, :], metric, cs)
        sc = np.where(np.isfinite(cs), sc, -np.inf)
        cid = i_ids[cand]
        order = np.lexsort((cid, -sc), axis=1)[:, :kk]
        top_s = np.take_along_axis(sc, order, axis=1)
        top_i = np.take_along_axis(cid, order, axis=1)
        keep = np.isfinite(top_s) & safe[:, None]
        out_q.append(np.repeat(ids, keep.sum(axis=1)))
        out_i.append(top_i[keep])
        out_s.append(top_s[keep])
        for r in np.flatnonzero(~safe).tolist():              # rare: many near-ties
            row = -far[r]
            kth = np.partition(row, n - kk)[n - kk]
            cc = np.nonzero((row >= kth - 1e-9) & np.isfinite(row))[0]
            scr = _exact_scores(X[cc], qb[r], metric, row[cc])
            o = np.lexsort((i_ids[cc], -scr))[:kk]
            out_q.append(np.repeat(ids[r], len(o)))
            out_i.append(i_ids[cc][o])
            out_s.append(scr[o])
    return np.concatenate(out_q), np.concatenate(out_i), np.concatenate(out_s)


def knn_join(queries: DataFrame, items: DataFrame, k: int = 10, metric: str = "l2sq",
             q_id: str = "qid", q_vec: str = "embedding", i_id: str = "item_id", i_vec: str = "embedding",
             exclude_self: bool = False, q_block: int = 8192, i_block: int = I_BLOCK,
             items_materialized: bool = False, index: P.PivotIndex | None = None, queries_materialized: bool = False) -> DataFrame:
    """Exact top-k items per query: ``qid, item_id, score, rank`` (rank 1 = best;
    ties by smaller item_id). ``score`` is ``1 - squared L2`` for ``l2sq``.
    ``items_materialized``: the item side is already a stored table (the vector
    store), so it is not checkpointed again; its count is a scan of that table. ``queries_materialized``: so is the query side.
    ``index``: a pivot index of the items, where one is at hand."""
    if metric not in ("l2sq", "cosine", "ip"):
        raise ValueError(metric)
    spark = queries.sparkSession
    q = queries.select(F.col(q_id).alias("qid"), F.col(q_vec).cast("array<double>").alias("v"))
    it = items.select(F.col(i_id).alias("item_id"), F.col(i_vec).cast("array<double>").alias("v"))
    # Both sides are checkpointed to the shared checkpoint folder: the block sizes
    # need row counts, and the tiles must not recompute the (embedding) lineage.
    ensure_checkpoint_dir(spark)
    if not queries_materialized:
        q = q.checkpoint(eager=True)
    if not items_materialized:
        it = it.checkpoint(eager=True)
    q, it = q.where(F.col("v").isNotNull()), it.where(F.col("v").isNotNull())  # rows without a vector
    par = spark.sparkContext.defaultParallelism
    if metric == "l2sq":
        index = index or P.pivot_index(it, min(i_block, max(2048, math.ceil(it.count() / par))))
        return P.nearest(index, q, k, exclude_self, _tile_topk, q_block)
    nq, ni = q.count(), it.count()
    # Tile grid: tiles hold at most q_block x i_block pairs; when that gives fewer
    # tiles than the cluster has cores, split further (items first, then queries),
    # never below 256 rows per block.
    IB = max(1, math.ceil(ni / i_block), min(par, ni // 2048))
    QB = max(1, math.ceil(nq / q_block), min(math.ceil(par / IB), nq // 256))
    qx = q.select("qid", "v", F.pmod(F.xxhash64("qid"), F.lit(QB)).alias("qb"),
                  F.explode(F.sequence(F.lit(0), F.lit(IB - 1))).alias("ib"))
    ix = it.select("item_id", "v", F.pmod(F.xxhash64("item_id"), F.lit(IB)).alias("ib"),
                   F.explode(F.sequence(F.lit(0), F.lit(QB - 1))).alias("qb"))

    def tile(qpdf: pd.DataFrame, ipdf: pd.DataFrame) -> pd.DataFrame:
        if len(qpdf) == 0 or len(ipdf) == 0:
            return P.empty_hits()
        Q = np.stack(qpdf["v"].to_numpy()).astype(np.float64)
        X = np.stack(ipdf["v"].to_numpy()).astype(np.float64)
        # ids of any type count as their rank in the tile (ties go to the smaller id)
        q_keys, q_at = np.unique(qpdf["qid"].to_numpy(), return_inverse=True)
        i_keys, i_at = np.unique(ipdf["item_id"].to_numpy(), return_inverse=True)
        place = {x: n for n, x in enumerate(i_keys.tolist())} if exclude_self else {}
        codes = [place.get(x, -1 - n) for n, x in enumerate(q_keys.tolist())]
        back = dict(zip(codes, q_keys.tolist()))
        a, b, c = _tile_topk(np.array(codes)[q_at], Q, i_at, X, k, metric, exclude_self)
        if not len(a):
            return P.empty_hits()
        return pd.DataFrame({"qid": [back[x] for x in a.tolist()], "item_id": i_keys[b], "score": c})

    cand = (qx.groupBy("qb", "ib").cogroup(ix.groupBy("qb", "ib"))
            .applyInPandas(tile, f"qid {q.schema['qid'].dataType.simpleString()}, item_id {it.schema['item_id'].dataType.simpleString()}, score double"))
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), "item_id")
    return cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# W3 ----------------------------------------------------------------------------

def top_k_per_group(df: DataFrame, group_cols: list[str], score_col: str, tie_col: str, k: int) -> DataFrame:
    w = Window.partitionBy(*group_cols).orderBy(F.col(score_col).desc(), F.col(tie_col))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# J6 ----------------------------------------------------------------------------

def multi_query_retrieve(queries: DataFrame, chunks: DataFrame, k: int = 10, **knn_kw) -> DataFrame:
    """Per claim, run every query (``claim_id, query_idx, query_type, embedding``;
    query_idx 0 = the claim itself) for its top-k chunks, keep each chunk's best score
    (equal scores: the earlier query wins) and order the claim's list by score.

    Output: claim_id, chunk_id, score, query_idx, query_type, rank."""
    qkey = queries.select(
        F.concat_ws(":", "claim_id", "query_idx").alias("qid"),
        "claim_id", "query_idx", "query_type", "embedding")
    hits = knn_join(qkey, chunks, k=k, q_id="qid", i_id="chunk_id", **knn_kw)
    hits = hits.join(qkey.select("qid", "claim_id", "query_idx", "query_type"), "qid")
    best = Window.partitionBy("claim_id", "item_id").orderBy(F.col("score").desc(), "query_idx")
    hits = hits.withColumn("_b", F.row_number().over(best)).where("_b = 1")
    order = Window.partitionBy("claim_id").orderBy(F.col("score").desc(), "item_id")
    return hits.select("claim_id", F.col("item_id").alias("chunk_id"), "score", "query_idx", "query_type",
                       F.row_number().over(order).alias("rank"))


# L1 ----------------------------------------------------------------------------

def select_evidence(retrieval: DataFrame, labels: DataFrame, k: int = 5, min_score: float = 0.0) -> DataFrame:
    """SUPPORTS/REFUTES: best k with score > min_score; NOT ENOUGH INFO: the k lowest
    (kept in descending order; all when fewer); any other label: best k.

    ``retrieval``: claim_id, rank (1 = best), score, ...; ``labels``: claim_id, label."""
    r = retrieval.join(labels.select("claim_id", "label"), "claim_id")
    n = F.count(F.lit(1)).over(Window.partitionBy("claim_id"))
    pos = Window.partitionBy("claim_id", (F.col("score") > min_score).alias("_p")).orderBy("rank")
    r = r.withColumn("_n", n).withColumn("_pos_rank", F.row_number().over(pos))
    keep = (F.when(F.col("label").isin("SUPPORTS", "REFUTES"), (F.col("score") > min_score) & (F.col("_pos_rank") <= k))
            .when(F.col("label") == "NOT ENOUGH INFO", F.col("rank") > F.col("_n") - k)
            .otherwise(F.col("rank") <= k))
    return r.where(keep).drop("_n", "_pos_rank")
