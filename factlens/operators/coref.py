"""Pronoun resolution: W6 (priority rule) and W7 (nearest compatible entity).

One timeline per document: entity rows placed at their end token, pronoun rows at
their token; an entity ending at or before the pronoun precedes it (entities sort
first at equal positions). ``last(..., ignorenulls)`` per label over the running
frame gives the latest preceding entity of each label in one window pass, so there
is no pronoun x entity join. The text is rebuilt from the original characters and
the replacements (sorted by offset) without shifting indexes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factlens.functions.text import POSSESSIVE_RE
from factlens.operators.annotate import POSSESSIVE_PRONOUNS, PRONOUN_CLASSES

LABELS = ("PERSON", "ORG", "GPE", "NORP")


def _clean(c):
    return F.regexp_replace(c, POSSESSIVE_RE, "$1")


def referents(tokens: DataFrame, entities: DataFrame, rule: str = "priority") -> DataFrame:
    """doc_id, tok_i, char_idx, text (pronoun), replacement."""
    pron = tokens.where((F.col("pos") == "PRON") & F.lower("text").isin(*PRONOUN_CLASSES)).select(
        "doc_id", F.col("tok_i").alias("_p"), F.lit(1).alias("_k"), "tok_i", "char_idx", "text",
        F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("etext"))
    ent = entities.select("doc_id", F.col("end_tok").alias("_p"), F.lit(0).alias("_k"),
                          F.lit(None).cast("int").alias("tok_i"), F.lit(None).cast("int").alias("char_idx"),
                          F.lit(None).cast("string").alias("text"), "label", _clean(F.col("text")).alias("etext"))
    tl = ent.unionByName(pron)
    w = Window.partitionBy("doc_id").orderBy("_p", "_k", "tok_i").rowsBetween(Window.unboundedPreceding, 0)
    for lab in LABELS:
        tl = tl.withColumn(f"_last_{lab}", F.last(F.when(F.col("label") == lab, F.col("etext")), True).over(w))
    low = F.lower("text")
    if rule == "priority":
        rep = F.lit(None).cast("string")
        for p, classes in PRONOUN_CLASSES.items():
            rep = F.when(low == p, F.coalesce(*[F.col(f"_last_{c}") for c in classes])).otherwise(rep)
    else:
        # Plural pronouns keep the priority list; singular ones take the nearest
        # preceding entity of any compatible label.
        singular = sorted({c for c in PRONOUN_CLASSES.values() if "NORP" not in c})
        for i, classes in enumerate(singular):
            tl = tl.withColumn(f"_near_{i}", F.last(F.when(F.col("label").isin(*classes), F.col("etext")),
                                                    True).over(w))
        rep = F.lit(None).cast("string")
        for p, classes in PRONOUN_CLASSES.items():
            if "NORP" in classes:
                choice = F.coalesce(*[F.col(f"_last_{c}") for c in classes])
            else:
                choice = F.col(f"_near_{singular.index(classes)}")
            rep = F.when(low == p, choice).otherwise(rep)
    out = tl.where(F.col("_k") == 1).select("doc_id", "tok_i", "char_idx", "text", rep.alias("replacement"))
    out = out.where(F.col("replacement").isNotNull())
    poss = F.lower("text").isin(*POSSESSIVE_PRONOUNS) & ~F.col("replacement").endswith("'s")
    r = F.when(poss, F.concat("replacement", F.lit("'s"))).otherwise(F.col("replacement"))
    first = F.substring("text", 1, 1)
    cap = (first == F.upper(first)) & (first != F.lower(first))
    out = out.withColumn("_r0", r)
    out = out.withColumn("replacement", F.when(cap, F.concat(F.upper(F.substring("_r0", 1, 1)),
                                                            F.substring("_r0", 2, 1 << 30))).otherwise(F.col("_r0")))
    return out.drop("_r0")


def resolve_pronouns(docs: DataFrame, tokens: DataFrame, entities: DataFrame, id_col: str = "doc_id",
                     text_col: str = "text", rule: str = "priority") -> DataFrame:
    """``id_col, text, resolved_text, n_replaced``."""
    reps = referents(tokens, entities, rule)
    per = reps.groupBy("doc_id").agg(F.array_sort(F.collect_list(
        F.struct("char_idx", F.char_length("text").alias("len"), F.col("replacement").alias("rep")))).alias("reps"))
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(per, "doc_id", "left")
    init = F.struct(F.lit(0).alias("pos"), F.lit("").alias("acc"))
    folded = F.aggregate(
        F.coalesce("reps", F.array().cast("array<struct<char_idx:int,len:int,rep:string>>")), init,
        lambda s, r: F.struct((r["char_idx"] + r["len"]).alias("pos"),
                              F.concat(s["acc"], F.substring(F.col("text"), s["pos"] + 1, r["char_idx"] - s["pos"]),
                                       r["rep"]).alias("acc")))
    d = d.withColumn("_f", folded)
    return d.select(F.col("doc_id").alias(id_col), "text",
                    F.concat(F.col("_f.acc"), F.expr("substring(text, _f.pos + 1)")).alias("resolved_text"),
                    F.coalesce(F.size("reps"), F.lit(0)).alias("n_replaced"))
