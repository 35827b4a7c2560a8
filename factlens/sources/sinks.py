"""Sinks: K1 write_shards, K2 export, K4 write_partitioned_by_fold (K3, the
idempotent chunk append, lives with the chunk operators)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame


def write_shards(df: DataFrame, path: str, rows_per_file: int = 1000, mode: str = "overwrite") -> None:
    """K1: parquet files of at most ``rows_per_file`` rows each, disjoint."""
    df.write.mode(mode).option("maxRecordsPerFile", rows_per_file).parquet(path)


def export(df: DataFrame, directory: str, name: str, fmt: str = "csv", partition_by: list[str] | None = None,
           stamp: _dt.datetime | None = None) -> str:
    """K2: CSV (with header) or JSON lines under ``<dir>/<name>_<YYYYmmddHHMMSS>``."""
    stamp = stamp or _dt.datetime.now(_dt.timezone.utc)
    path = f"{directory.rstrip('/')}/{name}_{stamp.strftime('%Y%m%d%H%M%S')}"
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        raise ValueError(fmt)
    return path


def write_partitioned_by_fold(df: DataFrame, path: str, fold_col: str = "fold") -> None:
    """K4: one folder per fold (``fold=<k>``)."""
    df.write.mode("overwrite").partitionBy(fold_col).parquet(path)
