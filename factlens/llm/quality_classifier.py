"""Quality classifier by compression (operator 8).

Two zstandard dictionaries are built, one from good and one from bad labelled text. A
text is cut into pieces of ``PIECE`` bytes (all of it, so that the dictionary speaks for
every part) and compressed with either dictionary; the difference of the two sizes over
their larger one is the feature, and a logistic curve fitted on labelled rows that did
not make the dictionaries turns it into a probability.

Fitting takes a bounded sample: at most ``FIT_ROWS`` labelled rows per class (the first by
a hash of the id) of at most ``FIT_BYTES`` bytes each, half for the dictionaries, half for the curve.
Rows whose crc32(id as text) mod 3 is 1 are held out and never seen. Every row of the table is scored in one
narrow pass. Labels, language, source and id are no input of a score.

Cases: a null or empty text has difference 0; null or contradictory labels are not used; a null id is
never held out nor fitted; repeated rows score alike; without labels of both classes every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factlens.llm.tables import arrow_map

FIT_ROWS, FIT_BYTES = 600, 1 << 15
DICT_BYTES, PIECE, LEVEL = 1 << 16, 1024, 1


class Model:
    def __init__(self, good: bytes, bad: bytes) -> None:
        self.good, self.bad, self.slope, self.shift = good, bad, 0.0, 0.0

    def open(self) -> Model:
        packs = [zstd.ZstdCompressionDict(d, dict_type=zstd.DICT_TYPE_AUTO) for d in (self.good, self.bad)]
        for p in packs:
            p.precompute_compress(level=LEVEL)
        self.packers = [zstd.ZstdCompressor(dict_data=p, write_checksum=False, write_content_size=False, write_dict_id=False) for p in packs]
        return self

    def difference(self, text: bytes) -> float:
        """(good - bad) / larger compressed size: negative where the good dictionary fits better."""
        sizes = [0, 0]
        for i in range(0, len(text), PIECE):
            piece = text[i:i + PIECE]
            for k, p in enumerate(self.packers):
                sizes[k] += len(p.compress(piece))
        return (sizes[0] - sizes[1]) / max(sizes) if max(sizes) else 0.0

    def score(self, difference):
        return 1 / (1 + np.exp(-np.clip(self.slope * np.asarray(difference) + self.shift, -30, 30)))


def _dictionary(texts: list[bytes]) -> bytes:
    pieces = [t[i:i + PIECE] for t in texts for i in range(0, len(t), PIECE)]
    return zstd.train_dictionary(DICT_BYTES, pieces).as_bytes()


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and intercept by Newton's method, classes weighted alike."""
    scale = float(np.abs(x).max()) or 1.0
    a = np.stack([x / scale, np.ones_like(x)], axis=1)
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        w = weight * p * (1 - p)
        step = np.linalg.solve((a * w[:, None]).T @ a + ridge * np.eye(2) * [1, 0] + 1e-9 * np.eye(2), a.T @ (weight * (y - p)) - ridge * b * [1, 0])
        b += step
        if np.abs(step).max() < 1e-9:
            break
    return float(b[0] / scale), float(b[1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model | None:
    known = (labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where("id is not null and y in (0, 1)")
             .where(F.crc32(F.col("id").cast("string").cast("binary")) % 3 != 1)
             .groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z"))
    order = [F.xxhash64("id"), F.col("id")]
    sample = known.where("y = 1").orderBy(*order).limit(FIT_ROWS).unionByName(known.where("y = 0").orderBy(*order).limit(FIT_ROWS))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.octet_length("text").between(1, FIT_BYTES))
    # at most 2 * FIT_ROWS keys are broadcast and as many texts of at most FIT_BYTES come back
    rows = sorted(((r.id, r.y, r.text.encode()) for r in texts.join(F.broadcast(sample.select("id", "y")), "id").groupBy("id", "y").agg(F.min("text").alias("text")).collect()), key=lambda r: str(r[0]))
    sides = [[t for _, y, t in rows if y == k] for k in (0, 1)]
    if min(map(len, sides)) < 8:
        return None
    model = Model(_dictionary(sides[1][::2]), _dictionary(sides[0][::2])).open()
    rest = [(t, k) for k in (0, 1) for t in sides[k][1::2]]
    x = np.array([model.difference(t) for t, _ in rest])
    model.slope, model.shift = _logistic(x, np.array([k for _, k in rest], dtype=float))
    del model.packers
    return model


def _scores(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model and model.open()
        for batch in batches:
            diffs = [m.difference(t.as_py().encode()) if m and t.is_valid else 0.0 for t in batch.column(1)]
            score = m.score(diffs) if m else np.full(len(diffs), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(diffs, pa.float64()), pa.array(score, pa.float64())], names=["id", "difference", "score"])

    return run


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per document: id, held_out, difference, score, predicted."""
    model = fit(docs, labels, id_col, text_col, label_col)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = T.StructType([T.StructField("id", docs.schema["id"].dataType), T.StructField("difference", T.DoubleType()), T.StructField("score", T.DoubleType())])
    held = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return arrow_map(docs, _scores(model), out).select(
        F.col("id").alias(id_col), held.alias("held_out"), "difference", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
