"""Session construction and the shared scratch folder.

On a cluster the scratch folder is the one named by ``spark.checkpoint.dir``
(a shared file system); it is only invented here when the session has none,
which is the case in local tests.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # runtime (measured) broadcast: AQE turns a shuffle join into a broadcast
    # only when the materialised side is below this many bytes
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app: str = "eventfit", driver_memory: str = "16g") -> SparkSession:
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", driver_memory))
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_base(spark)
    return spark


def checkpoint_base(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written intermediate tables.

    Read from the session (``spark.checkpoint.dir`` or the context's
    checkpoint directory); only when neither is set (tests, a laptop) is a
    fresh local folder created and registered.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None)
    if not base:
        try:
            base = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset key
            base = None
    if not base:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isDefined():
            base = os.path.dirname(current.get())
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        base = tempfile.mkdtemp(prefix="eventfit-ckpt-")
        spark.conf.set("spark.checkpoint.dir", base)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(base)
    return base


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique folder below the shared checkpoint folder."""
    return f"{checkpoint_base(spark).rstrip('/')}/eventfit-scratch/{name}-{uuid.uuid4().hex}"


_WRITTEN: dict[str, list[tuple[DataFrame, str]]] = {}


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back.

    AQE splits a skewed join only if both sides come straight from a shuffle;
    an aggregate, a ``distinct`` or another join on the same key does not.
    Written first, such a side is a plain scan. A plan already written in this
    session under this name is read again instead of computed again.
    """
    spark = df.sparkSession
    known = _WRITTEN.setdefault(f"{spark.sparkContext.applicationId}/{name}", [])
    for plan, path in known:
        if plan.sameSemantics(df):
            break
    else:
        path = scratch_path(spark, f"written/{name}")
        df.write.parquet(path)
        known.append((df, path))
    return spark.read.schema(df.schema).parquet(path)
