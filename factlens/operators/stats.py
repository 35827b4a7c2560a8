"""Profiles and model metrics: A1-A11, A14, A18.

Aggregates are single-pass ``groupBy``/``agg`` (partial + final hash aggregation).
Exact percentiles of lengths use Spark's ``percentile``, whose buffer is a map value -> count,
so memory follows the number of distinct values, not rows; quantiles of any column are found by rank
selection (``quantiles``).
Running sums over sorted values (ECDF, AUC) never use an unpartitioned window over
rows: values are first collapsed to distinct values with counts, then summed in two
levels (equi-depth buckets from approximate quantiles, exact sums inside), see
``running_totals``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Reporting limits and percentiles.
TRUNCATION_LIMITS = (256, 512, 768, 1024, 2048)
HIST_BINS = 50
POLITICAL_TERMS = ("politics", "election", "vote", "trump", "biden", "congress", "government")


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """A1."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def _r(c: Column, d: int) -> Column:
    return F.round(c, d)


def length_stats(df: DataFrame, value_col: str, by: list[str] | None = None, digits: int = 2) -> DataFrame:
    """A2/A3: n, mean, median, mode (smallest on ties), sample std, p25/p75/p90/p95,
    min, max of a length column; rounded like the reference (2 digits)."""
    x = F.col(value_col).cast("double")
    p = F.percentile(x, F.array(*[F.lit(v) for v in (0.5, 0.25, 0.75, 0.9, 0.95)]))
    g = df.groupBy(*(by or []))
    out = g.agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("_mean"), p.alias("_p"),
                F.mode(F.col(value_col), True).alias("mode"), F.stddev_samp(x).alias("_std"),
                F.min(value_col).alias("min"), F.max(value_col).alias("max"))
    return out.select(*(by or []), "n", _r(F.col("_mean"), digits).alias("mean"),
                      _r(F.col("_p")[0], digits).alias("median"), "mode", _r(F.col("_std"), digits).alias("std"),
                      _r(F.col("_p")[1], digits).alias("p25"), _r(F.col("_p")[2], digits).alias("p75"),
                      _r(F.col("_p")[3], digits).alias("p90"), _r(F.col("_p")[4], digits).alias("p95"),
                      "min", "max")


def token_profile(df: DataFrame, n_col: str, limits=TRUNCATION_LIMITS, digits: int = 6) -> DataFrame:
    """A4: count, mean, median, population std, min, max, p25..p99, percent of rows
    over each limit, and the recommended max length rule."""
    x = F.col(n_col).cast("double")
    ps = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
    out = df.agg(F.count(F.lit(1)).alias("count"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"),
                 F.min(n_col).alias("min"), F.max(n_col).alias("max"),
                 F.percentile(x, F.array(*[F.lit(v) for v in ps])).alias("_p"),
                 *[F.avg((F.col(n_col) > m).cast("double")).alias(f"_over_{m}") for m in limits])
    p95, p90 = F.col("_p")[4], F.col("_p")[3]
    rec = (F.when(p95 <= 256, F.lit(256)).when(p95 <= 512, F.lit(512)).when(p90 <= 512, F.lit(512))
           .when(p95 <= 1024, F.lit(1024)).otherwise(p95.cast("int")))
    cols = ["count", _r(F.col("mean"), digits).alias("mean"), _r(F.col("_p")[1], digits).alias("median"),
            _r(F.col("std"), digits).alias("std"), "min", "max"]
    cols += [_r(F.col("_p")[i], digits).alias(f"p{int(v * 100)}") for i, v in enumerate(ps)]
    cols += [_r(F.col(f"_over_{m}") * 100, digits).alias(f"pct_over_{m}") for m in limits]
    return out.select(*cols, rec.alias("recommended_max_length"))


def histogram(df: DataFrame, value_col: str, bins: int = HIST_BINS) -> DataFrame:
    """A5: equal-width bins between min and max (the last bin holds the max); integer
    arithmetic, so bin edges are exact. Min and max come from a one-row aggregate."""
    mm = df.agg(F.min(value_col).alias("lo"), F.max(value_col).alias("hi")).first()
    lo, hi = mm["lo"], mm["hi"]
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, n long")
    span = max(hi - lo, 1)
    b = F.least(F.floor((F.col(value_col) - F.lit(lo)) * bins / F.lit(span)).cast("int"), F.lit(bins - 1))
    return df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def running_totals(counts: DataFrame, value_col: str, sum_cols: list[str], n_buckets: int = 64) -> DataFrame:
    """For each distinct value, adds ``<c>_below`` = sum of ``c`` over strictly smaller
    values. Two levels: equi-depth buckets from approximate quantiles (any boundaries
    give the exact answer), bucket totals (small) -> offsets, window inside buckets."""
    qs = [i / n_buckets for i in range(1, n_buckets)]
    bounds = counts.agg(F.percentile_approx(value_col, qs, 1000).alias("b")).first()["b"] or []
    bounds = sorted(set(bounds))
    arr = F.array(*[F.lit(v) for v in bounds]) if bounds else F.array().cast(f"array<{dict(counts.dtypes)[value_col]}>")
    c = counts.withColumn("_bk", F.size(F.filter(arr, lambda t: t < F.col(value_col))))
    tot = c.groupBy("_bk").agg(*[F.sum(s).alias(f"_t_{s}") for s in sum_cols])
    wo = Window.orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)  # <= n_buckets rows
    off = tot.select("_bk", *[F.coalesce(F.sum(f"_t_{s}").over(wo), F.lit(0)).alias(f"_o_{s}") for s in sum_cols])
    c = c.join(F.broadcast(off), "_bk")
    wi = Window.partitionBy("_bk").orderBy(value_col).rowsBetween(Window.unboundedPreceding, -1)
    for s in sum_cols:
        c = c.withColumn(f"{s}_below", F.col(f"_o_{s}") + F.coalesce(F.sum(s).over(wi), F.lit(0)))
    return c.drop("_bk", *[f"_o_{s}" for s in sum_cols])


def ecdf(df: DataFrame, value_col: str) -> DataFrame:
    """A5: empirical CDF at each distinct value: P(X <= v)."""
    counts = df.groupBy(value_col).agg(F.count(F.lit(1)).alias("n"))
    n_all = counts.agg(F.sum("n")).first()[0] or 0
    rt = running_totals(counts, value_col, ["n"])
    return rt.select(value_col, "n", ((F.col("n_below") + F.col("n")) / F.lit(max(n_all, 1))).alias("cdf"))


def boxplot(df: DataFrame, value_col: str, by: list[str] | None = None, digits: int = 6) -> DataFrame:
    """A5: quartiles, IQR, whiskers (furthest values within 1.5 IQR) and outliers."""
    x = F.col(value_col).cast("double")
    by = by or []
    q = df.groupBy(*by).agg(F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"))
    q = q.select(*by, F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q3"))
    if by:  # one row per group: AQE broadcasts it at run time when it is small
        j = df.join(q, by)
    else:
        r = q.first()
        j = df.select("*", *[F.lit(r[c]).alias(c) for c in ("q1", "median", "q3")])
    iqr = F.col("q3") - F.col("q1")
    inside = (x >= F.col("q1") - 1.5 * iqr) & (x <= F.col("q3") + 1.5 * iqr)
    out = j.groupBy(*by, "q1", "median", "q3").agg(
        F.min(F.when(inside, x)).alias("whisker_low"), F.max(F.when(inside, x)).alias("whisker_high"),
        F.count(F.when(~inside, 1)).alias("outliers"))
    return out.select(*by, *[_r(F.col(c), digits).alias(c) for c in ("q1", "median", "q3")],
                      _r(F.col("q3") - F.col("q1"), digits).alias("iqr"), "whisker_low", "whisker_high", "outliers")


def null_profile(df: DataFrame) -> DataFrame:
    """Nulls per column, long form (column, nulls)."""
    agg = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    pairs = ", ".join(f"'{c}', `{c}`" for c in df.columns)
    return agg.selectExpr(f"stack({len(df.columns)}, {pairs}) AS (`column`, nulls)")


QUANTILE_BINS = 512


def quantiles(df: DataFrame, cols: list[str], qs: tuple[float, ...], bins: int = QUANTILE_BINS) -> dict[str, list[float | None]]:
    """Exact quantiles (linear between neighbours) by rank selection: every round counts, in one job for all columns and
    ranks, the values of each range that still holds a wanted rank in ``bins`` equal bins with their least and
    largest value, and narrows the range to the bin of the rank, until that holds one value. A task keeps ranges x bins
    counters whatever the number of distinct values. Nulls and NaN are left out."""
    x = df.select(*(F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c) for c in cols))
    seen = x.agg(*(f(c).alias(f"{c}|{n}") for c in cols for n, f in (("n", F.count), ("lo", F.min), ("hi", F.max)))).first()
    wanted = {}  # (column, rank) -> [lowest, highest, rows below the range]
    for c in cols:
        for q in qs if seen[f"{c}|n"] else ():
            at = q * (seen[f"{c}|n"] - 1)
            for rank in {math.floor(at), math.ceil(at)}:
                wanted[c, rank] = [seen[f"{c}|lo"], seen[f"{c}|hi"], 0]
    while any(lo < hi for lo, hi, _ in wanted.values()):
        ranges = sorted({(c, lo, hi) for (c, _), (lo, hi, _) in wanted.items() if lo < hi})
        entries = []
        for i, (c, lo, hi) in enumerate(ranges):
            half = 0.5 if math.isinf(hi - lo) else 1.0  # the width of a range may exceed the largest double
            part = (F.col(c) * half - F.lit(lo * half)) / F.lit(hi * half - lo * half)
            here = F.struct(F.lit(i).alias("range"), F.least(F.floor(part * bins), F.lit(bins - 1)).alias("bin"), F.col(c).alias("x"))
            entries.append(F.when(F.col(c).between(lo, hi), here))
        hit = x.select(F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull())).alias("e")).select("e.*")
        found = hit.groupBy("range", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
        counted = {r: sorted((f.bin, f.n, f.lo, f.hi) for f in found if f.range == i) for i, r in enumerate(ranges)}
        for (c, rank), state in wanted.items():
            for _, n, lo, hi in counted.get((c, state[0], state[1]), ()):
                if rank < state[2] + n:
                    state[0], state[1] = lo, hi
                    break
                state[2] += n
    out: dict[str, list[float | None]] = {}
    for c in cols:
        n, out[c] = seen[f"{c}|n"], []
        for q in qs:
            at = q * (n - 1)
            a, b = ((wanted[c, f(at)][0] for f in (math.floor, math.ceil)) if n else (None, None))
            out[c].append(a + (b - a) * (at - math.floor(at)) if n else None)
    return out


def describe(df: DataFrame, cols: list[str], digits: int = 6) -> DataFrame:
    """Count, mean, sample std, min, quartiles (exact, by rank selection), max per numeric column,
    long form (column, stat, value)."""
    found = quantiles(df, cols, (0.25, 0.5, 0.75))
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.count(x).cast("double").alias(f"{c}|count"), F.avg(x).alias(f"{c}|mean"),
                 F.stddev_samp(x).alias(f"{c}|std"), F.min(x).alias(f"{c}|min"), F.max(x).alias(f"{c}|max")]
    a = df.agg(*aggs)
    rows = []
    for c in cols:
        q = [F.lit(v).cast("double") for v in found[c]]
        for stat, e in (("count", F.col(f"`{c}|count`")), ("mean", F.col(f"`{c}|mean`")),
                        ("std", F.col(f"`{c}|std`")), ("min", F.col(f"`{c}|min`")), ("25%", q[0]),
                        ("50%", q[1]), ("75%", q[2]), ("max", F.col(f"`{c}|max`"))):
            rows.append(F.struct(F.lit(c).alias("column"), F.lit(stat).alias("stat"), _r(e, digits).alias("value")))
    return a.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def keyword_presence(df: DataFrame, text_col: str, class_col: str, terms=POLITICAL_TERMS) -> DataFrame:
    """Per class, number of rows whose text contains each term (case-insensitive),
    long form (class, term, rows)."""
    low = F.lower(F.col(text_col))
    agg = df.groupBy(class_col).agg(*[F.count_if(F.contains(low, F.lit(t))).alias(t) for t in terms])
    pairs = ", ".join(f"'{t}', `{t}`" for t in terms)
    return agg.selectExpr(class_col, f"stack({len(terms)}, {pairs}) AS (term, `rows`)")


def confusion_matrix(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """A9 long form: actual, predicted, n."""
    return df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n"))


def per_class(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Per class: support, npred, tp and p, r, f1 (zero division -> 0), from the confusion matrix (a table of classes^2 rows)."""
    cm = confusion_matrix(df, actual, predicted)
    # one pass over the (classes^2-row) matrix: each cell counts towards the support
    # of its actual class, the predictions of its predicted class, and tp when equal
    cells = F.explode(F.array(
        F.struct(F.col("actual").alias("cls"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("npred"),
                 F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("tp")),
        F.struct(F.col("predicted").alias("cls"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("npred"),
                 F.lit(0).cast("bigint").alias("tp"))))
    per = cm.select(cells.alias("c")).select("c.*").groupBy("cls").agg(
        F.sum("support").alias("support"), F.sum("npred").alias("npred"), F.sum("tp").alias("tp"))
    prec = F.when(F.col("npred") > 0, F.col("tp") / F.col("npred")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    return per.withColumn("p", prec).withColumn("r", rec).withColumn(
        "f1", F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0))


def classification_report(df: DataFrame, actual: str, predicted: str, digits: int = 6) -> DataFrame:
    """A10 report: a row per class (precision, recall, f1, support), then ``accuracy`` (as f1), ``macro avg`` and ``weighted avg``."""
    per = per_class(df, actual, predicted)
    rows = per.select(F.col("cls").cast("string").alias("class"), F.col("p").alias("precision"), F.col("r").alias("recall"), "f1", "support")
    n = F.sum("support")
    mean = lambda c: F.sum(F.col(c) * F.col("support")) / n
    lines = [F.struct(F.lit("accuracy").alias("class"), F.lit(None).cast("double").alias("precision"), F.lit(None).cast("double").alias("recall"),
                      (F.sum("tp") / n).alias("f1"), n.alias("support")),
             F.struct(F.lit("macro avg").alias("class"), F.avg("p").alias("precision"), F.avg("r").alias("recall"), F.avg("f1").alias("f1"), n.alias("support")),
             F.struct(F.lit("weighted avg").alias("class"), mean("p").alias("precision"), mean("r").alias("recall"), mean("f1").alias("f1"), n.alias("support"))]
    whole = per.agg(F.array(*lines).alias("l")).select(F.explode("l").alias("l")).select("l.*")
    return rows.unionByName(whole).select("class", *(_r(F.col(c), digits).alias(c) for c in ("precision", "recall", "f1")), "support")


def classification_metrics(df: DataFrame, actual: str, predicted: str, digits: int = 6) -> DataFrame:
    """A10: accuracy and support-weighted precision / recall / F1."""
    per = per_class(df, actual, predicted)
    tot = F.sum("support")
    out = per.agg((F.sum("tp") / tot).alias("accuracy"), (F.sum(F.col("p") * F.col("support")) / tot).alias("precision"),
                  (F.sum(F.col("r") * F.col("support")) / tot).alias("recall"),
                  (F.sum(F.col("f1") * F.col("support")) / tot).alias("f1"), tot.alias("n"))
    return out.select(*[_r(F.col(c), digits).alias(c) for c in ("accuracy", "precision", "recall", "f1")], "n")


def binary_metrics(df: DataFrame, actual: str, predicted: str, score: str, positive=1, digits: int = 6) -> DataFrame:
    """A10 binary extras: TP/FP/TN/FN, MCC and ROC-AUC (rank-sum with average ranks
    for tied scores, via distinct-score counts and two-level running sums)."""
    pos_a = F.col(actual) == F.lit(positive)
    pos_p = F.col(predicted) == F.lit(positive)
    c = df.agg(F.count_if(pos_a & pos_p).alias("tp"), F.count_if(~pos_a & pos_p).alias("fp"),
               F.count_if(~pos_a & ~pos_p).alias("tn"), F.count_if(pos_a & ~pos_p).alias("fn"))
    per = df.groupBy(F.col(score).cast("double").alias("s")).agg(
        F.count_if(pos_a).alias("pos"), F.count_if(~pos_a).alias("neg"))
    rt = running_totals(per, "s", ["neg"])
    wide = lambda c: F.col(c).cast("decimal(18,0)")  # noqa: E731  products of counts pass the range of a long
    a = rt.agg(F.sum((2 * wide("neg_below") + wide("neg")) * wide("pos")).alias("num"),
               F.sum("pos").alias("npos"), F.sum("neg").alias("nneg")).first()
    j = c.select("*", (F.lit(a["num"]).cast("double") / 2).alias("num"), F.lit(a["npos"]).alias("npos"),
                 F.lit(a["nneg"]).alias("nneg"))
    den = F.sqrt((F.col("tp") + F.col("fp")).cast("double") * (F.col("tp") + F.col("fn")) *
                 (F.col("tn") + F.col("fp")) * (F.col("tn") + F.col("fn")))
    mcc = F.when(den > 0, (wide("tp") * wide("tn") - wide("fp") * wide("fn")).cast("double") / den).otherwise(0.0)
    auc = F.when((F.col("npos") > 0) & (F.col("nneg") > 0), F.col("num") / (F.col("npos").cast("double") * F.col("nneg")))
    return j.select("tp", "fp", "tn", "fn", _r(mcc, digits).alias("mcc"), _r(auc, digits).alias("roc_auc"))


def class_weights(df: DataFrame, label_col: str, digits: int = 6) -> DataFrame:
    """N / (k * count_c)."""
    c = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("count"))
    tot = c.agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("k")).first()
    return c.select(label_col, "count", _r(F.lit(tot["n"]) / (F.lit(tot["k"]) * F.col("count")), digits).alias("weight"))
