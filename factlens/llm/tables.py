"""Tables of the llm operators: inputs, and intermediates in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


BATCH_ROWS = 1000  # whole texts per Arrow batch: bounds what a Python worker holds at once


def arrow_map(df: DataFrame, fn, schema) -> DataFrame:
    """``mapInArrow`` with batches of at most ``BATCH_ROWS`` rows."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) <= BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(fn, schema)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder named by spark.checkpoint.dir
    and read it back: cuts the lineage and survives lost executors. Only where that
    setting is unset (local tests) a fresh local folder is used."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        base = tempfile.mkdtemp(prefix="factlens-llm-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
