"""Seeded, engine-independent sampling: W4, W5, L4-L12, J4.

Everything is built on ``seeded_rank``: the order of rows inside a label is the
order of ``md5(id || ':' || seed)``, which any engine reproduces. A plain
``row_number() over (partition by label order by key)`` would put a whole label in
one task (and there are only two or three labels), so the rank is computed in two
levels:

1. bucket = first ``bucket_hex`` hex digits of the key; counts per (label, bucket)
   form a table of at most ``labels x 16^bucket_hex`` rows (partial aggregation,
   no skew);
2. a running sum over that small table gives each bucket's offset; it is joined
   back (AQE broadcasts it after measuring it) and the rank is
   ``offset + row_number() within (label, bucket)``.

The result equals the single-window rank exactly, while the largest window
partition is one bucket (1/65536 of a label with the default 4 digits).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_SEED = 42
BUCKET_HEX = 4


def seed_key(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(f":{seed}")))


def hash_int(key: Column) -> Column:
    """First 15 hex digits (60 bits) of a hex digest as a non-negative integer."""
    return F.conv(F.substring(key, 1, 15), 16, 10).cast("bigint")


def seeded_rank(df: DataFrame, label_cols: list[str], id_col: str, seed: int = DEFAULT_SEED,
                rank_col: str = "rank", max_rank: Column | int | None = None,
                bucket_hex: int = BUCKET_HEX) -> DataFrame:
    """Adds ``rank_col`` (1-based) = position of the row inside its label in
    ``md5(id:seed)`` order (ties by id). ``max_rank`` (a number or a column of the
    label's quota) prunes whole buckets that start beyond it before ranking."""
    k = df.withColumn("_key", seed_key(id_col, seed)).withColumn("_bkt", F.substring("_key", 1, bucket_hex))
    counts = k.groupBy(*label_cols, "_bkt").agg(F.count(F.lit(1)).alias("_cnt"))
    wo = Window.partitionBy(*label_cols).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_cnt").over(wo), F.lit(0))).drop("_cnt")
    # The offsets table has at most labels x 16^bucket_hex rows (a few MB for a few
    # labels). No hint: AQE measures it after its stage runs and broadcasts it when
    # it is under the broadcast threshold, else keeps a shuffle join.
    # Labels are compared null-safe, so rows without a label are ranked among themselves.
    named = offsets.select(*(F.col(c).alias(f"_l{i}") for i, c in enumerate(label_cols)), F.col("_bkt").alias("_ob"), "_off")
    same = F.col("_bkt") == F.col("_ob")
    for i, c in enumerate(label_cols):
        same = same & F.col(c).eqNullSafe(F.col(f"_l{i}"))
    j = k.join(named, same).drop("_ob", *(f"_l{i}" for i in range(len(label_cols))))
    if max_rank is not None:
        mr = F.lit(max_rank) if isinstance(max_rank, int) else max_rank
        j = j.where(F.col("_off") < mr)
    w = Window.partitionBy(*label_cols, "_bkt").orderBy("_key", id_col)
    return j.withColumn(rank_col, F.col("_off") + F.row_number().over(w)).drop("_key", "_bkt", "_off")


# W4 / L12 ---------------------------------------------------------------------------

def stratified_exact_sample(df: DataFrame, label_col: str, id_col: str, n: int,
                            seed: int = DEFAULT_SEED) -> DataFrame:
    """Exactly ``n`` rows per label (all rows of a smaller label), no replacement."""
    r = seeded_rank(df, [label_col], id_col, seed, max_rank=n + 1)
    return r.where(F.col("rank") <= n)


mini_set = stratified_exact_sample  # L12: fixed n per class for smoke runs


def label_counts(df: DataFrame, label_col: str) -> dict:
    """Per-label row counts (one row per label reaches the driver)."""
    return {r[0]: r[1] for r in df.groupBy(label_col).count().collect()}


# L4 --------------------------------------------------------------------------------

def balance_down(df: DataFrame, label_col: str, id_col: str, seed: int = DEFAULT_SEED) -> DataFrame:
    """Every label sampled down to the smallest label's size."""
    counts = label_counts(df, label_col)
    n_min = min(counts.values()) if counts else 0
    r = seeded_rank(df, [label_col], id_col, seed, max_rank=n_min + 1)
    return r.where(F.col("rank") <= n_min)


# L5 --------------------------------------------------------------------------------

def balance_over_under(df: DataFrame, label_col: str, id_col: str, minority, majority,
                       extra: float = 0.2, seed: int = DEFAULT_SEED) -> DataFrame:
    """Minority kept whole plus ``round(extra * n)`` of its rows again (half-even, as
    pandas ``frac``); the majority sampled to that total."""
    mino = df.where(F.col(label_col) == F.lit(minority))
    n_min = mino.count()
    n_extra = round(extra * n_min)
    again = seeded_rank(mino, [label_col], id_col, seed, max_rank=n_extra + 1).where(F.col("rank") <= n_extra)
    maj = stratified_exact_sample(df.where(F.col(label_col) == F.lit(majority)), label_col, id_col,
                                  n_min + n_extra, seed)
    return (mino.withColumn("copy", F.lit(0)).unionByName(again.drop("rank").withColumn("copy", F.lit(1)))
            .unionByName(maj.drop("rank").withColumn("copy", F.lit(0))))


# L6 / J4 ---------------------------------------------------------------------------

def unused_rows(df: DataFrame, used: DataFrame, id_col: str) -> DataFrame:
    """Rows whose id is not in ``used`` (anti-join)."""
    return df.join(used.select(id_col), id_col, "left_anti")


def balance_with_relabel(df: DataFrame, label_col: str, id_col: str, n: int, short_label,
                         donors: tuple, seed: int = DEFAULT_SEED) -> DataFrame:
    """``n`` rows of each donor label; all rows of ``short_label``, and when it has
    fewer than ``n`` the shortfall is taken from unused donor rows (half from the
    first donor, half plus the odd one from the second) and relabelled."""
    a, b = donors
    src = df.where(F.col(label_col).isin(a, b, short_label))
    picked = stratified_exact_sample(src.where(F.col(label_col).isin(a, b)), label_col, id_col, n, seed)
    short = src.where(F.col(label_col) == F.lit(short_label)).withColumn("relabelled", F.lit(False))
    need = n - short.count()
    out = picked.drop("rank").withColumn("relabelled", F.lit(False)).unionByName(short)
    if need > 0:
        half, rem = divmod(need, 2)
        # rows ranked n+1.. of a donor are exactly its unused rows, in seeded order
        spare = seeded_rank(src.where(F.col(label_col).isin(a, b)), [label_col], id_col, seed,
                            max_rank=n + half + rem + 1)
        quota = F.when(F.col(label_col) == F.lit(a), F.lit(half)).otherwise(F.lit(half + rem))
        extra = spare.where((F.col("rank") > n) & (F.col("rank") <= n + quota)).drop("rank")
        out = out.unionByName(extra.withColumn(label_col, F.lit(short_label)).withColumn("relabelled", F.lit(True)))
    return out


# L7 / K4 ---------------------------------------------------------------------------

def balanced_folds(df: DataFrame, label_col: str, id_col: str, k: int, n_per_label: int,
                   seed: int = DEFAULT_SEED) -> DataFrame:
    """``fold`` = (rank - 1) // n_per_label within each label; rows beyond k folds are
    dropped, so every fold holds n_per_label rows of each label."""
    r = seeded_rank(df, [label_col], id_col, seed, max_rank=k * n_per_label + 1)
    return (r.where(F.col("rank") <= k * n_per_label)
            .withColumn("fold", F.floor((F.col("rank") - 1) / n_per_label).cast("int")).drop("rank"))


# L8 --------------------------------------------------------------------------------

def _largest_remainder(counts: dict, total: int) -> dict:
    """Split ``total`` over labels proportionally to ``counts``: floors first, then one
    more to the largest remainders (ties by label order)."""
    n = sum(counts.values())
    if n == 0:
        return {k: 0 for k in counts}
    base = {k: (c * total) // n for k, c in counts.items()}
    left = total - sum(base.values())
    order = sorted(counts, key=lambda k: (-((counts[k] * total) % n), str(k)))
    for k in order[:left]:
        base[k] += 1
    return base


def split_quotas(counts: dict, frac: float = 0.1) -> tuple[dict, dict]:
    n = sum(counts.values())
    size = int(n * frac)
    test = _largest_remainder(counts, size)
    rest = {k: counts[k] - test[k] for k in counts}
    val = _largest_remainder(rest, size)
    return test, val


def stratified_split(df: DataFrame, label_col: str, id_col: str, frac: float = 0.1,
                     seed: int = DEFAULT_SEED) -> DataFrame:
    """``split`` = test / val / train: test and val each hold int(frac * N) rows,
    allocated to labels by largest remainder; rows inside a label go in seeded order.
    Only the per-label counts (a handful of numbers) reach the driver."""
    counts = label_counts(df, label_col)
    test, val = split_quotas(counts, frac)
    spark = df.sparkSession
    q = spark.createDataFrame([(k, test[k], val[k]) for k in counts], f"{label_col} string, _t long, _v long") \
        if counts else None
    r = seeded_rank(df, [label_col], id_col, seed)
    if q is None:
        r = r.withColumn("_t", F.lit(0)).withColumn("_v", F.lit(0))
    else:  # one row per label, counted on the driver: broadcast only under the bound
        r = r.join(q.withColumnRenamed(label_col, "_label"), F.col(label_col).eqNullSafe(F.col("_label"))).drop("_label")
    split = (F.when(F.col("rank") <= F.col("_t"), "test")
             .when(F.col("rank") <= F.col("_t") + F.col("_v"), "val").otherwise("train"))
    return r.withColumn("split", split).drop("_t", "_v", "rank")


# L10 -------------------------------------------------------------------------------

def sample_with_replacement(df: DataFrame, label_col: str, id_col: str, seed: int = DEFAULT_SEED) -> DataFrame:
    """n = 2 x the smallest label count per label. Labels with at least n rows are
    sampled without replacement; smaller (rare) labels are drawn n times with
    replacement: draw j picks rank 1 + hash(j:seed:label) mod count."""
    counts = label_counts(df, label_col)
    n = 2 * min(counts.values()) if counts else 0
    cn = df.sparkSession.createDataFrame([(k, c, n) for k, c in counts.items()],
                                         f"{label_col} string, _c long, _n long")
    r = seeded_rank(df, [label_col], id_col, seed)
    r = r.join(cn.withColumnRenamed(label_col, "_label"), F.col(label_col).eqNullSafe(F.col("_label"))).drop("_label")
    plain = r.where((F.col("_c") >= F.col("_n")) & (F.col("rank") <= F.col("_n"))) \
        .withColumn("draw", F.col("rank")).drop("_c", "_n", "rank")
    # all draws are one distributed range: draw d of the i-th rare label has number i * n + d - 1
    spark = df.sparkSession
    rare_labels = [(i, k, c) for i, (k, c) in enumerate((k, c) for k, c in counts.items() if c < n)]
    labels = spark.createDataFrame(rare_labels, f"_i long, {label_col} string, _c long")  # a row a label
    numbers = spark.range(n * len(rare_labels)).select((F.col("id") / F.lit(max(n, 1))).cast("long").alias("_i"), (F.col("id") % F.lit(max(n, 1)) + 1).alias("draw"))
    draws = numbers.join(labels, "_i").select(label_col, "_c", "draw")
    key = F.md5(F.concat(F.col("draw").cast("string"), F.lit(f":{seed}:"), F.coalesce(F.col(label_col).cast("string"), F.lit("null"))))
    draws = draws.withColumn("rank", F.pmod(hash_int(key), F.col("_c")) + 1).drop("_c")
    rare = r.where(F.col("_c") < F.col("_n")).drop("_c", "_n").join(draws.withColumnRenamed(label_col, "_label").withColumnRenamed("rank", "_rank"), F.col(label_col).eqNullSafe(F.col("_label")) & (F.col("rank") == F.col("_rank"))).drop("rank", "_label", "_rank")
    return plain.unionByName(rare.select(*plain.columns))


# L11 -------------------------------------------------------------------------------

def shuffle_order(df: DataFrame, id_col: str, seed: int = DEFAULT_SEED) -> DataFrame:
    """Seeded random order as an explicit ``position`` column (global two-level
    rank), for when a physical order matters downstream."""
    r = seeded_rank(df.withColumn("_all", F.lit(0)), ["_all"], id_col, seed, rank_col="position")
    return r.drop("_all")


# W5 --------------------------------------------------------------------------------

def quantile_edges(df: DataFrame, value_col: str, q: int = 9) -> DataFrame:
    """One row: exact linear-interpolation quantile edges at 0, 1/q, ..., 1, rounded to
    9 decimals, duplicates dropped."""
    ps = [i / q for i in range(q + 1)]
    return df.agg(F.array_distinct(F.transform(
        F.percentile(F.col(value_col).cast("double"), F.array(*[F.lit(p) for p in ps])),
        lambda e: F.round(e, 9))).alias("edges"))


def quantile_bins(df: DataFrame, value_col: str, q: int = 9, bin_col: str = "bin") -> DataFrame:
    """pandas ``qcut(q, labels=False, duplicates='drop')``: right-closed bins, lowest
    value included; bin = (#edges below x) - 1, at least 0. The edges (at most q+1
    numbers from one exact-percentile aggregate) come back as a literal array."""
    edges = quantile_edges(df, value_col, q).first()["edges"] or []
    x = F.col(value_col).cast("double")
    arr = F.array(*[F.lit(float(v)) for v in edges]) if edges else F.array().cast("array<double>")
    b = F.greatest(F.size(F.filter(arr, lambda t: t < x)) - 1, F.lit(0))
    return df.withColumn(bin_col, b.cast("int"))


# L9 --------------------------------------------------------------------------------

# Bin pairs of the length-stratified sample and the boost factors.
QUOTA_GROUPS = ((0, 1), (2, 3), (4, 5), (6, 7), (8,))
QUOTA_BOOSTS = (1.25, 1.15, 1.05)


def quota_sizes(count: int, last_group_rows: int) -> list[int]:
    size = count // 5
    for boost in QUOTA_BOOSTS:
        if int(size * boost) < last_group_rows:
            last = int(size * boost)
            return [count - (last + size * 3), size, size, size, last]
    return [size, size, size, size, count - size * 4]


def quota_sample(df: DataFrame, bin_col: str, id_col: str, count: int, seed: int = DEFAULT_SEED) -> DataFrame:
    """``count // 5`` rows from each pair of length bins, the longest group boosted by
    1.25/1.15/1.05 when it has the rows, the first group taking the remainder. A group
    with fewer rows than its quota gives all it has."""
    grp = F.lit(None).cast("int")
    for gi, bins in reversed(list(enumerate(QUOTA_GROUPS))):
        grp = F.when(F.col(bin_col).isin(*bins), F.lit(gi)).otherwise(grp)
    g = df.withColumn("quota_group", grp).where(F.col("quota_group").isNotNull())
    last_rows = g.where(F.col("quota_group") == len(QUOTA_GROUPS) - 1).count()
    sizes = quota_sizes(count, last_rows)
    quota = F.element_at(F.array(*[F.lit(s) for s in sizes]), F.col("quota_group") + 1)
    r = seeded_rank(g, ["quota_group"], id_col, seed, max_rank=max(sizes) + 1)
    return r.where(F.col("rank") <= quota).drop("rank")

