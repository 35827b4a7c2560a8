"""Parse model responses that should carry a JSON object.

Rule: newlines become spaces and the text is stripped; when that parses as a JSON
object it is used, otherwise a leading ``assistant`` is dropped and the outermost
``{...}`` span is tried; failing both, the raw text is kept. All column expressions
(``try_parse_json`` / ``get_json_object``), no Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlens.functions.text import py_strip

# The fields of a 5W1H response.
FIELDS = ("who", "what", "where", "when", "why", "how")
JSON_OBJECT_RE = r"(?s)\{.*\}"


def response_json(col) -> "F.Column":
    c = F.col(col) if isinstance(col, str) else col
    t = py_strip(F.replace(c, F.lit("\n"), F.lit(" ")))
    direct = F.when(t.startswith("{") & F.try_parse_json(t).isNotNull(), t)
    body = F.regexp_extract(F.regexp_replace(t, "^assistant", ""), JSON_OBJECT_RE, 0)
    fallback = F.when((body != "") & F.try_parse_json(body).isNotNull(), body)
    return F.coalesce(direct, fallback)


def parse_responses(df: DataFrame, col: str = "response", keep_first: int | None = None,
                    order_col: str | None = None) -> DataFrame:
    """Adds ``parsed``, the six fields and ``raw`` (the input when nothing parsed).
    ``keep_first`` keeps the first N parsed rows in ``order_col`` order (the
    reference's stop-after-N-successes)."""
    js = response_json(col)
    out = df.withColumn("_js", js)
    out = out.select(*df.columns, F.col("_js").isNotNull().alias("parsed"),
                     *[F.get_json_object("_js", f"$.{f}").alias(f) for f in FIELDS],
                     F.when(F.col("_js").isNull(), F.col(col)).alias("raw"))
    if keep_first is not None:
        # a top-N (each partition keeps N, one merge), not a window over all rows
        out = out.where(F.col("parsed")).orderBy(order_col).limit(keep_first)
    return out
