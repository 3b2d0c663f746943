"""Table sources and sinks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def read_tables(spark: SparkSession, folder: str, names: Iterable[str]) -> dict[str, DataFrame]:
    """Lazily load parquet tables by name; columns and filters are pruned at the scan."""
    return {name: spark.read.parquet(f"{folder}/{name}.parquet") for name in names}


def write_table(df: DataFrame, path: str, partition_by: Iterable[str] = ()) -> None:
    """Replace a derived table.

    Rows of one folder are brought together before writing; adaptive execution
    splits folders that are large and merges small ones, so that file sizes stay
    even when one folder holds most rows.
    """
    folders = list(partition_by)
    if folders:
        df = df.hint("rebalance", *folders)
    df.write.mode("overwrite").partitionBy(*folders).parquet(path)
