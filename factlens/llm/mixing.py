"""Mixing sources to target weights by iterative proportional fitting (operator 10).

Documents fall into cells (source, language, topic) with a number of tokens each. Cell
weights start at their tokens and are scaled to one marginal after the other until all
marginals agree with their targets within ``tolerance`` (raking). A cell's ratio, raked
weight over tokens, scaled to the token budget, is the expected number of copies of each
of its documents: the whole part is certain, the rest a seeded draw by the document's id,
so the sample is reproducible and each marginal is met in expectation.

Cells are a table (at most sources x languages x topics rows) and stay distributed; every round is one job of
keyed sums, written to the shared folder.

Sums of weights are decimals, so they do not depend on the order of the tasks and a second run draws the same sample.
Targets that contradict each other (no weights meet them all) end when three rounds in a row bring nothing: ``rake`` then warns, and
its column ``residual`` says by what share a cell's marginals still miss their targets.

A target is a mapping of values to shares (shares of values that have no tokens go to the
others; values without a share divide what ``REST`` names, and without ``REST`` they keep their
observed share while the named ones divide what is left; ``REST`` of 0 leaves them out) or a number: the power to
which the observed token shares are raised (1 keeps them, 0 makes them equal).

Cases: null source, language or topic is a value of its own; documents without tokens get no weight and are never drawn;
null ids draw by the digest of their text; rows repeating an id and text are drawn alike; an empty table gives an empty result; columns of the input that are named like
the operator's own are replaced.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlens.llm.quality_rules import GAP
from factlens.llm.tables import stored

REST = "*"
ROUNDS, TOLERANCE = 50, 1e-4
Targets = Mapping[str, Mapping[str, float] | float]


def total(column: str) -> Column:
    """A sum of doubles that does not depend on their order (18 places)."""
    return F.sum(F.col(column).cast("decimal(38,18)")).cast("double")


def tokens(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")).cast("long")


def topic(text: Column) -> Column:
    """A coarse topic by surface form; pass an own topic column where one is at hand."""
    return (F.when(text.rlike("(?i:licen[sc]e)"), "legal").when(text.rlike("@|\\+[0-9]|=\\s*\""), "records").when(text.contains(" | "), "tables")
            .when(F.length(text) >= 4000, "long prose").otherwise("prose"))


def _shares(cells: DataFrame, dim: str, target) -> DataFrame:
    """(value, share) of one marginal; shares sum to 1 over the values that have tokens."""
    have = cells.groupBy(F.col(dim).alias("value")).agg(F.sum("mass").alias("mass")).where("mass > 0")
    if isinstance(target, Mapping):
        named = F.lit(None).cast("double")
        for value, share in target.items():
            if value != REST:
                named = F.when(F.col("value") == value, F.lit(float(share))).otherwise(named)
        have = have.select("value", "mass", named.alias("named"))
        rest = have.agg(F.sum(F.when(F.col("named").isNull(), F.col("mass"))).alias("rest"), F.sum("mass").alias("all"), total("named").alias("shares"))
        if REST in target:
            share, scale = F.lit(float(target[REST])) * F.col("mass") / F.col("rest"), F.lit(1.0)
        else:  # what no share is named for is not dropped
            share, scale = F.col("mass") / F.col("all"), F.when(F.col("shares") > 0, (1 - F.coalesce("rest", F.lit(0)) / F.col("all")) / F.col("shares")).otherwise(0.0)
        raw = have.join(F.broadcast(rest)).select("value", F.coalesce(F.col("named") * scale, share).alias("raw"))
    else:
        raw = have.select("value", F.pow("mass", F.lit(float(target))).alias("raw"))
    whole = raw.agg(total("raw").alias("whole"))  # one row
    return raw.join(F.broadcast(whole)).select("value", (F.col("raw") / F.col("whole")).alias("share"))


def rake(cells: DataFrame, targets: Targets, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """``cells`` (the dimensions and ``mass``) with ``weight``: shares that meet every target marginal, and ``residual``."""
    wanted = {d: stored(_shares(cells, d, t)) for d, t in targets.items()}
    state = stored(cells.withColumn("weight", F.col("mass").cast("double")).withColumn("residual", F.lit(0.0)))
    best, stalled, worst = None, 0, 0.0
    for _ in range(rounds):
        x, errors = state.drop("residual"), []
        for dim, want in wanted.items():
            sums = x.groupBy(F.col(dim).alias("value")).agg(total("weight").alias("sum"))
            scale = sums.join(want, sums["value"].eqNullSafe(want["value"])).select(
                sums["value"].alias("__v"), F.when(F.col("sum") > 0, F.col("share") / F.col("sum")).otherwise(F.lit(0.0)).alias("__by"))
            errors.append(f"__by_{len(errors)}")
            x = x.join(scale, F.col(dim).eqNullSafe(F.col("__v"))).withColumn("weight", F.col("weight") * F.col("__by")).withColumnRenamed("__by", errors[-1]).drop("__v")
        off = F.greatest(F.lit(0.0), *(F.abs(F.col(e) - 1) for e in errors))
        state = stored(x.withColumn("residual", off).drop(*errors))
        worst = state.where("weight > 0").agg(F.max("residual")).first()[0] or 0.0
        stalled = stalled + 1 if best is not None and worst > 0.999 * best else 0
        best = worst if best is None else min(best, worst)
        if worst <= tolerance or stalled == 3:
            break
    if worst > tolerance:
        warnings.warn(f"the targets are missed by up to {worst:.3g} of their shares: they contradict each other or need more rounds", stacklevel=2)
    return state


def mixture(docs: DataFrame, targets: Targets, budget: float = 0.5, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text",
            topic_col: Column | None = None) -> DataFrame:
    """Every document with n_tokens, topic, expected copies and drawn copies.

    ``targets`` name the dimensions (columns of ``docs``, or ``topic``); ``budget`` is the expected share of the input's tokens."""
    dims = list(targets)
    # written once: cells and draws both need the counts, and cutting words costs far more than the copy
    docs = docs.drop("mix_topic", "mix_tokens", "mix_expected", "mix_copies")
    x = stored(docs.withColumns({"__n": tokens(F.col(text_col)), "__topic": topic_col if topic_col is not None else topic(F.col(text_col))}))
    col = lambda d: F.col("__topic") if d == "topic" else F.col(f"`{d}`")
    cells = x.groupBy(*(col(d).alias(d) for d in dims)).agg(F.sum("__n").alias("mass")).where("mass > 0")
    cells = stored(cells)
    raked = rake(cells, targets)
    whole = F.broadcast(raked.agg(F.sum("mass").alias("__mass"), total("weight").alias("__weight")))  # one row
    ratio = raked.join(whole).select(*(F.col(d).alias(f"__c_{d}") for d in dims), (F.col("weight") / F.col("__weight") * F.col("__mass") * budget / F.col("mass")).alias("__ratio"))
    on = [col(d).eqNullSafe(F.col(f"__c_{d}")) for d in dims]
    met = x.join(stored(ratio), on, "left")
    who = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), who).cast("binary")), 1, 12), 16, 10).cast("double") / float(16**12)
    expected = F.when(F.col("__n") > 0, F.coalesce("__ratio", F.lit(0.0))).otherwise(F.lit(0.0))
    copies = (F.floor(expected) + F.when(u < expected - F.floor(expected), 1).otherwise(0)).cast("long")
    return met.select(*(F.col(f"`{c}`") for c in docs.columns), F.col("__topic").alias("mix_topic"), F.col("__n").alias("mix_tokens"), expected.alias("mix_expected"), copies.alias("mix_copies"))


def sample(docs: DataFrame, targets: Targets, **options) -> DataFrame:
    """The drawn documents only."""
    return mixture(docs, targets, **options).where("mix_copies > 0")
