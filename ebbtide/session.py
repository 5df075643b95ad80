"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOOKUP_ROWS = 50_000


def build(app: str = "ebbtide", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator assumes (UTC, AQE, skew handling)."""
    b = (SparkSession.builder.appName(app)
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true"))
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the settings results depend on. Timestamps are zone-less, so the zone is UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_folder(spark: SparkSession) -> None:
    """Make sure that checkpoints have a folder: the session's, or a local one where it is local."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="ebbtide-ckpt-")
    sc.setCheckpointDir(folder)


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, visible to every executor."""
    checkpoint_folder(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and continue from the written copy.

    Used where the rows must not move between two passes (a range partitioning that is read
    twice) or where an iteration would otherwise grow its plan. Reliable on purpose: a lost
    executor re-reads the files and nothing is recomputed.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write `df` as compressed columns beside the checkpoints, in folders `by` columns, and read it back.

    For tables that many passes read, each a few columns of it; `cut` keeps whole rows as they are.
    """
    path = work_folder(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def spread(df: DataFrame, split: int = 1 << 20) -> DataFrame:
    """Give a compute-heavy projection tasks that follow its input: all cores at least, and one per
    `split` bytes by the planner's own estimate.

    A file with one row group is one task however many cores wait, and large files are read in far
    larger pieces than rows that grow afterwards can bear.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(max(cores, -(-size // split)))


def lookup(df: DataFrame, limit: int = LOOKUP_ROWS) -> DataFrame:
    """Broadcast a small aggregate, but only after counting it; a larger one stays a shuffle join.

    At most `limit` + 1 rows ever reach the driver.
    """
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))
