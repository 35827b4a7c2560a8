"""Readers for the driver's parquet tables (and any table laid out the same way)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


# Tables whose rows carry long texts, so per-row work on them is heavy.
TEXT_TABLES = ("documents", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy parquet scan; column pruning and filter pushdown happen in Catalyst."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


def spread(df: DataFrame) -> DataFrame:
    """Round-robin repartition to the default parallelism, only where the session asks for
    it (``spark.factlens.spread``; local sessions do, as their test tables are single
    files of one row group). On a cluster it is off: scans are split by Spark.

    A join right above a spread scan may replace its exchange with the join's own shuffle,
    so callers that join before heavy per-row work spread the join's output."""
    if df.sparkSession.conf.get("spark.factlens.spread", "false") != "true":
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The scan without spreading."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


class Tables:
    """Attribute access to the tables of one scale-factor folder: ``t.documents``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return table(self.spark, self.sf_dir, name)
