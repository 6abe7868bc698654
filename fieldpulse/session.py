"""Session helpers: a tuned local session for tests/bench, and the shared
checkpoint folder (read from the cluster's ``spark.checkpoint.dir``)."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "fieldpulse") -> SparkSession:
    """Session for local runs.  On a cluster, use the cluster's session and only
    make sure AQE is on (it is by default in Spark 4)."""
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    spark = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# Settings for a large cluster (100 TB of answers, ~1000 executors).  Pass them
# to the cluster's SparkConf / spark-submit; ``build_session`` (local runs) keeps
# Spark's defaults where these only pay off at scale.
CLUSTER_SETTINGS = {
    # runtime re-planning: coalesce small shuffle partitions, split skewed ones,
    # switch to broadcast only on measured shuffle sizes
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    # initial shuffle width; AQE coalesces it down per stage
    "spark.sql.shuffle.partitions": "8000",
    "spark.sql.files.maxPartitionBytes": "256m",
    # bad numbers fail the query unless a query asks for on_bad="null"
    "spark.sql.ansi.enabled": "true",
    # streaming state (T4 keeps one row per submission) in RocksDB, off the JVM
    # heap, checkpointed as changelogs instead of full snapshots
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # survive lost executors without recomputing whole stages from the source
    "spark.decommission.enabled": "true",
    "spark.storage.decommission.shuffleBlocks.enabled": "true",
}


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written intermediate tables.

    Uses ``spark.checkpoint.dir`` when the cluster sets it.  When it is unset on
    a local master (tests) a scratch folder is created and registered with the
    SparkContext (the setting itself cannot be changed on a running session).
    On any other master an unset folder is an error: each executor would write
    to its own disk and later reads would miss rows."""
    sc = spark.sparkContext
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(conf_dir)
        return conf_dir.rstrip("/")
    current = sc.getCheckpointDir()
    if not current:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError(f"set spark.checkpoint.dir to a shared folder (master {sc.master})")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="fieldpulse-ckpt-"))
        current = sc.getCheckpointDir()
    return current.rstrip("/")
