"""Session helpers: build a session for tests/bench, find shared scratch space."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "canonry") -> SparkSession:
    """Session for tests and the benchmark. On a cluster, use the cluster's session."""
    return (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Read from the session. Only when it is unset and Spark runs in local
    mode (tests, the benchmark) do we create our own folder. On a cluster an
    unset value is an error: a machine-local folder would not survive the loss
    of an executor.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc._conf.get("spark.checkpoint.dir", None)
    if not root:
        current = sc.getCheckpointDir()
        if current:
            return current
        if not _is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS, S3, ...)")
        root = tempfile.mkdtemp(prefix="canonry-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for derived tables."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/canonry-scratch/{name}-{uuid.uuid4().hex}"


def cut_lineage(df, spark: SparkSession | None = None, name: str = "table", **options):
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    Cuts the lineage (a lost executor replays nothing before this point; never
    ``localCheckpoint``), and the planner then sees real file sizes and can prune
    columns of the written table. ``options`` are those of the writer.
    """
    spark = spark or df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").options(**options).parquet(path)
    return spark.read.parquet(path)


@contextmanager
def arrow_batches(spark: SparkSession, megabytes: int):
    """Arrow batches of jobs started inside hold at most about ``megabytes``: chained Python steps each hold a few of them."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(megabytes << 20))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def env_path(name: str, default: str) -> str:
    return os.environ.get(name, default)


def cut_lineage_bucketed(df, cols, n_buckets: int | None = None, spark: SparkSession | None = None,
                         name: str = "table", **options):
    """Like ``cut_lineage``, written as a table bucketed by ``cols``.

    Reading it back keeps the hash partitioning, so every later aggregation or
    window keyed by (a superset of) ``cols`` runs without an exchange: a table read
    once per iteration of an algorithm is shuffled once, when written. The table is
    external (files under the shared checkpoint folder), registered under a unique
    name in the session catalog.
    """
    spark = spark or df.sparkSession
    cols = [cols] if isinstance(cols, str) else list(cols)
    n = n_buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, name)
    table = f"canonry_{name.replace('-', '_')}_{uuid.uuid4().hex}"
    df.write.mode("overwrite").bucketBy(n, *cols).options(**options).option("path", path).saveAsTable(table)
    return spark.table(table)
