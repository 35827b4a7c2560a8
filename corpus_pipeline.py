"""Corpus pipeline over ``documents``: quality rules, near duplicates, benchmark
decontamination, PII surrogates, mixing. Each stage takes what its predecessor kept and
returns the columns of documents; the last adds the columns of the mixture. ``run`` writes
each stage to the shared folder and reads it back. Ids may be null or repeat: the stages that drop
documents decide on a key that each row has to itself.

The similarity join and the raking are not expressible in SQL, so there is no ORACLE_SQL;
tests/llm checks the whole against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlens.llm.decontaminate import decontaminate
from factlens.llm.jaccard_join import jaccard_classes
from factlens.llm.mixing import sample
from factlens.llm.pii import pseudonymize
from factlens.llm.quality_rules import apply_policy
from factlens.llm.queries import TARGETS, surrogate_key
from factlens.llm.tables import read, stored


ROW = "__row"


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a key of its own for every row, written once so that the keys stay."""
    return stored(docs.withColumn(ROW, F.monotonically_increasing_id()))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy rejects go."""
    return apply_policy(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: the one with the smallest id (those without an id come last)."""
    keyed = _keyed(docs)
    rank = keyed.select(ROW, F.struct(F.col("doc_id").isNull(), "doc_id", F.md5(F.to_json(F.struct(*docs.columns)).cast("binary")), ROW).alias("rank"))
    first = jaccard_classes(keyed, id_col=ROW).join(rank, ROW).groupBy("class_id").agg(F.min("rank").alias("rank"))
    return keyed.join(first.select(f"rank.{ROW}"), ROW, "left_semi").select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    keyed = _keyed(docs)
    hit = decontaminate(keyed, read(spark, sf_dir, "benchmark"), id_col=ROW).where("contaminated")
    return keyed.join(hit.select(ROW), ROW, "left_anti").select(*docs.columns)


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities are replaced; n_chars follows the new text."""
    out = pseudonymize(docs, surrogate_key(spark))
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn for the target mixture, with their number of copies."""
    return sample(docs, TARGETS)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard", ngram_jaccard),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii_surrogates", pii_surrogates),
    ("mixing", mixing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
