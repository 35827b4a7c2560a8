"""The cleaning job ``clean_posts``: one named profile over a table of posts, with counters.

A profile is a list of steps in order (P1 to P6). The counters are ``Observation`` metrics: they are gathered by the very pass
that cleans, from the text as each step finds it, so counting costs no second read and no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from factlens.functions import text as T


@dataclass(frozen=True)
class Step:
    """A cleaning step and the pattern whose matches it counts."""

    counter: str
    pattern: str
    apply: object


HANDLES = Step("handles_masked", T.TOPIC_HANDLE_RE, T.unmask_topic_handles)
MASK_URLS = Step("urls_masked", T.URL_RE, T.mask_urls)
DROP_URLS = Step("urls_masked", T.URL_RE, T.drop_urls)
MENTIONS = Step("mentions_masked", T.MENTION_RE, T.mask_mentions)
LINES = Step("lines_joined", r"\n+", T.collapse_newlines)
POSSESSIVE = Step("possessives_cut", T.POSSESSIVE_RE, T.strip_possessive)

# what each consumer of the text is given
PROFILES: dict[str, tuple[Step, ...]] = {
    "topic": (MASK_URLS, MENTIONS),
    "claim": (MASK_URLS, MENTIONS, LINES),
    "keyword": (DROP_URLS, MENTIONS, LINES, POSSESSIVE),
    "social": (HANDLES, MASK_URLS, MENTIONS),
}
COUNTERS = ("handles_masked", "urls_masked", "mentions_masked", "lines_joined", "possessives_cut")


def _counts(column: Column, steps: tuple[Step, ...]) -> tuple[Column, dict[str, Column]]:
    """The cleaned text and, per step, the matches in the text that the step was given."""
    found: dict[str, Column] = {}
    for s in steps:
        n = F.regexp_count(column, F.lit(s.pattern))
        found[s.counter] = found[s.counter] + n if s.counter in found else n
        column = s.apply(column)
    return column, found


def clean_posts(df: DataFrame, profile: str, text_col: str = "text", out_col: str = "clean_text",
                observation: Observation | None = None, counts: bool = False) -> DataFrame:
    """``df`` with ``out_col``. With an ``observation`` its counters (``rows``, ``rows_changed`` and COUNTERS) can be read once an
    action has run over the result; with ``counts`` every row keeps its own counts as columns, too. Null texts stay null and change nothing."""
    steps = PROFILES[profile]
    cleaned, found = _counts(F.col(text_col), steps)
    per_row = {c: F.coalesce(found[c], F.lit(0)).cast("long") if c in found else F.lit(0).cast("long") for c in COUNTERS}
    out = df.withColumns({out_col: cleaned, **{f"__{c}": v for c, v in per_row.items()}})
    if observation is not None:
        changed = F.count_if(~F.col(out_col).eqNullSafe(F.col(text_col)))
        out = out.observe(observation, F.count(F.lit(1)).alias("rows"), changed.alias("rows_changed"),
                          *(F.coalesce(F.sum(f"__{c}"), F.lit(0)).alias(c) for c in COUNTERS))
    return out.withColumnsRenamed({f"__{c}": c for c in COUNTERS}) if counts else out.drop(*(f"__{c}" for c in COUNTERS))


def clean_all(df: DataFrame, id_col: str, text_col: str, path: str) -> DataFrame:
    """Every profile written under ``path`` (profile, id, clean_text), one pass each; returns the counters, one row a profile."""
    spark, rows = df.sparkSession, []
    for name in PROFILES:
        seen = Observation(f"clean_{name}")
        clean_posts(df.select(id_col, text_col), name, text_col, observation=seen).select(id_col, "clean_text").write.parquet(f"{path}/profile={name}")
        got = seen.get
        rows.append((name, *(int(got[c]) for c in ("rows", "rows_changed", *COUNTERS))))
    return spark.createDataFrame(rows, "profile string, " + ", ".join(f"{c} long" for c in ("rows", "rows_changed", *COUNTERS)))
