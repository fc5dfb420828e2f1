"""Access to the driver's parquet tables.

Readers return the scan only; callers select the columns they need right
away so that Catalyst prunes the parquet ``ReadSchema`` and pushes filters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, min_parts: int | None = None) -> DataFrame:
    """Spread rows over at least ``min_parts`` (default: the cluster's
    parallelism) partitions before CPU-heavy per-row work.

    A scan has one task per file split; an input of few unsplittable pieces
    (one row group, gzip text) would run tokenisation or regex work on a few
    cores. Only then is a round-robin repartition added - on a large input
    with enough splits this is a no-op and adds no shuffle. Apply it to a
    scan (plus projections): the partition count of a scan is known without
    running anything, whereas asking an adaptive plan with shuffles for its
    partitions would execute its stages."""
    n = min_parts or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df
