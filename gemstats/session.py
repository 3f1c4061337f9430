"""Session construction and the shared folder for written intermediates."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "gemstats", extra: dict | None = None) -> SparkSession:
    """A session for tests and the benchmark. Library code never calls this:
    it works with whatever session it is given."""
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    builder = (SparkSession.builder
               .master(master or f"local[{cpus}]")
               .appName(app)
               .config("spark.ui.enabled", "false")
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.driver.memory", os.environ.get("GEMSTATS_DRIVER_MEMORY", "8g")))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for lineage cuts: ``spark.checkpoint.dir``.

    Read from the session. Only a local-mode session without the setting
    (tests) gets a fresh temporary folder; on a cluster a machine-local
    folder would be wrong, so the setting is then required.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="gemstats-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def shared_root(spark: SparkSession) -> str:
    """The folder that sessions share: ``spark.checkpoint.dir`` itself, without
    the subfolder that Spark makes for each session. A session that has only a
    folder of its own uses that."""
    return spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or shared_dir(spark)
