"""Sharding by a two-pass external shuffle, with DataFrame operations only.

Pass one scatters the records uniformly into buckets that fit in memory, by a
seeded hash of the record. Pass two permutes each bucket with Spark's
``shuffle`` (a Fisher-Yates shuffle) and lays the buckets end to end; the
stream is cut into shards whose row counts differ by at most one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import settle

SHARDS = 40
SEED = 20_240_601
#: Bytes of a bucket on average: what one task permutes in memory.
BUCKET_BYTES = 16 << 20
#: Fixed cost of a record besides its text.
RECORD_BYTES = 16
#: Buckets whose offsets one task adds up; whole runs of them are added up first.
RUN = 1024


def scatter(records: DataFrame, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, int]:
    """Pass one: ``records(..., size)`` with the ``bucket`` of each, and the number of buckets.

    The hash covers all columns, so equal texts, ids or sources do not meet in a bucket.
    """
    total = records.agg(F.sum("size")).first()[0] or 0
    buckets = max(1, -(-int(total) // bucket_bytes))
    key = F.xxhash64(F.lit(seed), *[F.col(c) for c in records.columns])
    return records.withColumn("bucket", F.pmod(key, F.lit(buckets)).cast("int")), buckets


def bucket_offsets(scattered: DataFrame) -> DataFrame:
    """``bucket, n, start``: the rows that lie before each bucket; windows over at most ``RUN`` buckets."""
    counts = scattered.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("run", F.expr(f"bucket div {RUN}"))
    counts = settle(counts, "bucket_counts")
    runs = counts.groupBy("run").agg(F.sum("n").alias("n"), F.expr(f"run div {RUN}").alias("part"))
    parts = runs.groupBy("part").agg(F.sum("n").alias("n"))

    def start(df: DataFrame, key: str, within: list[str], name: str) -> DataFrame:
        w = Window.partitionBy(*within).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(name, F.coalesce(F.sum("n").over(w), F.lit(0)))

    top = start(parts.withColumn("all", F.lit(0)), "part", ["all"], "part_start").select("part", "part_start")
    mid = start(runs, "run", ["part"], "run_start").join(top, "part").select("run", (F.col("run_start") + F.col("part_start")).alias("run_start"))
    low = start(counts, "bucket", ["run"], "bucket_start")
    return low.join(mid, "run").select("bucket", "n", (F.col("bucket_start") + F.col("run_start")).alias("start"))


def shuffle_buckets(scattered: DataFrame, buckets: int, seed: int = SEED) -> DataFrame:
    """Pass two: each bucket's records in a random order, with their place in the bucket.

    A bucket is sorted before it is permuted and is a partition of its own, which
    fixes the generator's seed; the order is the same in every run.
    """
    cols = [c for c in scattered.columns if c != "bucket"]
    rows = scattered.repartitionById(buckets, F.col("bucket")).groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias("rows"))
    return rows.select("bucket", F.posexplode(F.shuffle("rows", seed)).alias("place", "row")).select("bucket", "place", "row.*")


def shard(records: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``records`` (with a ``size`` column) in ``shard, slot``: row counts at most one apart, slots gapless from 0."""
    scattered, buckets = scatter(records, seed, bucket_bytes)
    starts = settle(bucket_offsets(scattered), "bucket_starts")
    total = starts.agg(F.sum("n")).first()[0] or 0
    placed = shuffle_buckets(scattered, buckets, seed).join(starts.drop("n"), "bucket")
    at = F.col("start") + F.col("place")
    # the first (total mod shards) shards take one row more
    small, large = total // shards, total % shards
    cut = large * (small + 1)
    number = F.when(at < cut, F.expr(f"(start + place) div {small + 1}")).otherwise(F.expr(f"{large} + (start + place - {cut}) div {max(1, small)}"))
    slot = F.when(at < cut, F.pmod(at, F.lit(small + 1))).otherwise(F.pmod(at - cut, F.lit(max(1, small))))
    return placed.withColumns({"shard": number.cast("int"), "slot": slot.cast("long")}).drop("bucket", "place", "start")


def sized(docs: DataFrame) -> DataFrame:
    """``docs`` with ``size``: the text's UTF-8 bytes plus a fixed part; a null text has none."""
    return docs.withColumn("size", (F.coalesce(F.octet_length("text"), F.lit(0)) + RECORD_BYTES).cast("long"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Put every row of ``docs(doc_id, text)`` into a shard.

    Returns ``doc_id, text, size, shard, slot``. Null ids and texts and
    repeated rows are placed like any other; other columns are ignored. An empty table
    gives an empty result; a single longer text makes its bucket larger.
    """
    return shard(sized(docs.select("doc_id", "text")), shards, seed, bucket_bytes)


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write the shards as folders ``shard=N`` in slot order, one task a shard.

    Nulls, empty texts, repeated rows and further columns are written as they
    are; an empty table gives an empty folder.
    """
    n = 1 + (sharded.agg(F.max("shard")).first()[0] or 0)
    sharded.repartitionById(n, F.col("shard").cast("int")).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
