"""Sentence splitting and topic / claim gates: U1, F1, F6, F7, A12.

Splitting is a per-row projection (split, strip, filter, posexplode): the sentence
index is the position in the filtered array, so re-indexing needs no window and no
shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlens.functions import text as T

# Gate thresholds and labels.
TOPIC_PROMOTE_BELOW = 0.75
CLAIM_PROMOTE_BELOW = 0.80
MIN_SENTENCE_CHARS = 6      # sentence kept iff len(strip) > 5
MIN_CLAIM_CHARS = 11        # sentence scored iff len(strip) > 10
MIN_POST_CHARS = 5          # len(strip) < 5 -> insufficient_content
POLITICAL, NON_POLITICAL = "POLITICAL", "NON_POLITICAL"


def sentence_array(text_col: str, min_chars: int = MIN_SENTENCE_CHARS):
    parts = F.transform(F.split(F.col(text_col), T.SENTENCE_BREAK_JAVA, -1), lambda s: T.py_strip(s))
    return F.filter(parts, lambda s: F.char_length(s) >= min_chars)


def split_sentences(df: DataFrame, id_col: str, text_col: str = "text",
                    min_chars: int = MIN_SENTENCE_CHARS) -> DataFrame:
    """U1. ``id_col, sent_idx, text`` for every stripped piece of at least
    ``min_chars`` code points, in order, re-indexed from 0."""
    # outer generator + filter after it: no inferred pre-filter re-evaluating the split
    return (df.select(id_col, F.posexplode_outer(sentence_array(text_col, min_chars)).alias("sent_idx", "text"))
            .where(F.col("text").isNotNull()))


def min_length_status(text_col: str):
    """F1 on a post: 'insufficient_content' when the stripped text is shorter than 5."""
    return F.when(F.char_length(T.py_strip(F.col(text_col))) < MIN_POST_CHARS,
                  F.lit("insufficient_content"))


def topic_gate(scored: DataFrame, label_col: str = "label", conf_col: str = "confidence",
               promote_below: float = TOPIC_PROMOTE_BELOW, status_col: str | None = "status") -> DataFrame:
    """F6. ``is_political`` is the raw model decision; ``classification`` is POLITICAL
    when political, or when not political with confidence below ``promote_below``.
    Rows with an ``insufficient_content`` status are never promoted."""
    raw = F.col(label_col) == F.lit(POLITICAL)
    insufficient = (F.col(status_col) == "insufficient_content") if status_col and status_col in scored.columns \
        else F.lit(False)
    promoted = ~raw & (F.col(conf_col) < promote_below) & ~F.coalesce(insufficient, F.lit(False))
    return scored.withColumn("is_political", raw).withColumn(
        "classification", F.when(raw | promoted, F.lit(POLITICAL)).otherwise(F.lit(NON_POLITICAL)))


def claim_gate(scored: DataFrame, text_col: str = "text", label_col: str = "label", conf_col: str = "confidence",
               promote_below: float = CLAIM_PROMOTE_BELOW, min_chars: int = MIN_CLAIM_CHARS,
               claim_label: str = "claim") -> DataFrame:
    """F7. Keep sentences of at least ``min_chars`` that the model calls a claim, or
    that it calls something else with confidence below ``promote_below``; the latter
    are promoted: they become claims too."""
    is_claim = (F.col(label_col) == claim_label) | (F.col(conf_col) < promote_below)
    return (scored.where(F.char_length(T.py_strip(F.col(text_col))) >= min_chars)
            .where(is_claim)
            .withColumn(label_col, F.lit(claim_label)).withColumn("is_factual_claim", F.lit(True)))


def post_rollup(sent_scores: DataFrame, posts: DataFrame, post_col: str = "post_id",
                label_col: str = "label", conf_col: str = "confidence") -> DataFrame:
    """A12. Sentence decisions to a post decision: political iff more than half of the
    sentences are, or any sentence is political with confidence > 0.8. Posts without
    a usable sentence keep their whole-post result (``label_col``/``conf_col`` on
    ``posts``)."""
    pol = (F.col(label_col) == POLITICAL)
    agg = sent_scores.groupBy(post_col).agg(
        F.avg(pol.cast("double")).alias("political_ratio"),
        F.avg(conf_col).alias("mean_confidence"),
        F.bool_or(pol & (F.col(conf_col) > 0.8)).alias("_strong"),
        F.count(F.lit(1)).alias("n_sentences"))
    agg = agg.withColumn("is_political", (F.col("political_ratio") > 0.5) | F.col("_strong")).drop("_strong")
    whole = posts.select(post_col, (F.col(label_col) == POLITICAL).alias("_p"), F.col(conf_col).alias("_c"))
    j = whole.join(agg, post_col, "left")
    return j.select(
        post_col,
        F.coalesce("is_political", "_p").alias("is_political"),
        F.coalesce("mean_confidence", "_c").alias("confidence"),
        "political_ratio",
        F.coalesce("n_sentences", F.lit(0).cast("bigint")).alias("n_sentences"))

