"""Ranking, top-k, dedupe and scalar-attach operators.

All of them keep the data partitioned: per-group windows are partitioned by
their group key, and the one global numbering (``dense_index``) is done with
range partitioning plus per-partition offsets, never by a window without a
partition key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_base


def with_scalars(df: DataFrame, scalars: DataFrame) -> DataFrame:
    """Attach the columns of a global aggregate (exactly one row by
    construction: ``agg`` without ``groupBy``) to every row of ``df``.

    Each column becomes a scalar subquery (``DataFrame.scalar()``): Spark
    runs the aggregate once - subqueries over the same aggregate are merged
    into one - and uses the values as constants. There is no join, ``df`` is
    neither shuffled nor multiplied.
    """
    return df.select("*", *[scalars.select(c).scalar().alias(c) for c in scalars.columns])


def dense_index(df: DataFrame, value_col: str, index_col: str = "k") -> DataFrame:
    """0-based dense rank of the distinct values of ``value_col``.

    Distinct values are range-partitioned and sorted inside each partition;
    a row's index is its position in the partition plus the number of values
    in all earlier partitions (a table with one row per partition). No step
    moves all values into one task.
    """
    d = (df.select(value_col).where(F.col(value_col).isNotNull()).distinct()
         .repartitionByRange(value_col).sortWithinPartitions(value_col)
         .withColumn("_p", F.spark_partition_id())
         .withColumn("_m", F.monotonically_increasing_id()))
    # one written copy feeds both branches, so the row ids and the
    # per-partition counts come from the same partitioning
    checkpoint_base(df.sparkSession)  # the shared folder, read from the session
    d = d.checkpoint()
    per_part = d.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_m0"))
    # one row per partition: the cumulative count is a tiny single-task window
    offsets = per_part.select(
        "_p", "_m0",
        (F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)))
        .alias("_off"))
    return (d.join(F.broadcast(offsets), "_p")
            .select(value_col,
                    (F.coalesce(F.col("_off"), F.lit(0)) + F.col("_m") - F.col("_m0"))
                    .cast("long").alias(index_col)))


def rank_within(df: DataFrame, group_cols: list[str], order_cols: list[Column],
                rank_col: str = "rk") -> DataFrame:
    """1-based ``row_number`` within each group."""
    w = Window.partitionBy(*group_cols).orderBy(*order_cols)
    return df.withColumn(rank_col, F.row_number().over(w))


def top_n(df: DataFrame, group_cols: list[str], order_cols: list[Column], n: int,
          rank_col: str = "rk") -> DataFrame:
    """First ``n`` rows of each group.

    ``row_number() <= n`` lets Catalyst insert a partial WindowGroupLimit
    before the shuffle, so even a group holding a third of the table sends
    at most ``n`` rows per map task to its reducer.
    """
    return rank_within(df, group_cols, order_cols, rank_col).where(F.col(rank_col) <= n)


def dedupe_last(df: DataFrame, key_cols: list[str], value_cols: list[str], order_col: str) -> DataFrame:
    """Repeated key: the row with the greatest ``order_col`` wins (W9,
    dict assignment in file order). ``max_by`` is a partial aggregate, so
    the dedupe combines map-side."""
    return df.groupBy(*key_cols).agg(
        *[F.max_by(F.col(c), F.col(order_col)).alias(c) for c in value_cols])


def dedupe_sum(df: DataFrame, key_cols: list[str], value_col: str) -> DataFrame:
    """Repeated key: values are added (the ``defaultdict`` += variant)."""
    return df.groupBy(*key_cols).agg(F.sum(value_col).alias(value_col))


def rank_within_spread(df: DataFrame, group_cols: list[str], order_cols: list[Column],
                       rank_col: str = "rk") -> DataFrame:
    """``row_number()`` within each group without putting a group into one
    task: for unbounded ranked lists whose largest group may hold a big
    share of the table.

    Rows are range-partitioned on (group, order) - a hot group spans several
    partitions - and sorted inside each partition. A row's rank is its
    position among its group's rows in its partition plus the number of the
    group's rows in earlier partitions; the per (partition, group) counts
    are a table of at most partitions x groups-per-partition rows.
    The order must be total (ties broken by the last order column) for the
    ranks to be repeatable.
    """
    keys = [F.col(c) for c in group_cols]
    d = (df.repartitionByRange(*keys, *order_cols).sortWithinPartitions(*keys, *order_cols)
         .withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()))
    checkpoint_base(df.sparkSession)  # the shared folder, read from the session
    d = d.checkpoint()  # both branches below read the same partitioned copy
    per = d.groupBy("_p", *group_cols).agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_m0"))
    w = Window.partitionBy(*group_cols).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    off = per.select("_p", *group_cols, "_m0", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    return (d.join(off, ["_p", *group_cols])
            .withColumn(rank_col, (F.col("_off") + F.col("_m") - F.col("_m0") + 1).cast("int"))
            .drop("_p", "_m", "_m0", "_off"))
