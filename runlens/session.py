"""Session construction and cluster-safe scratch locations.

Everything in the library is a lazy ``DataFrame -> DataFrame`` function; the
only place that touches cluster configuration is this module.
"""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession

# Settings every runlens job relies on.  AQE re-plans joins and coalesces
# partitions at runtime and splits skewed join partitions (one repo / one run
# may own a third of all rows); the session time zone is pinned so that
# timestamps render the same on every executor.
DEFAULT_CONF: dict[str, str] = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # streaming state (one row per instance id for the latest-progress
    # stream) lives off-heap in RocksDB instead of the JVM heap
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(
    master: str | None = None,
    app_name: str = "runlens",
    shuffle_partitions: int | None = None,
    extra_conf: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or reuse) a session with the runlens defaults.

    On a cluster ``master`` is left to spark-submit; tests pass ``local[N]``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder of the cluster.

    The cluster names it in ``spark.checkpoint.dir``.  Only a ``local`` master
    may go without: it gets a private scratch folder.  On any other master the
    driver and the executors share no local folder, so an unset folder raises.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        master = spark.conf.get("spark.master", "")
        if not re.match(r"local($|\[)", master):
            raise ValueError(f"spark.checkpoint.dir must name a shared folder on master {master!r}")
        current = tempfile.mkdtemp(prefix="runlens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    try:  # RDD checkpoint folder for DataFrame.checkpoint (absent under Spark Connect)
        spark.sparkContext.setCheckpointDir(current)
    except Exception:  # noqa: BLE001
        pass
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A folder for an intermediate table, below one folder per application in
    the shared checkpoint folder.  Results are lazy and may still read these
    tables, so they are removed with the application's folder when it is over."""
    return f"{checkpoint_dir(spark).rstrip('/')}/runlens-{spark.sparkContext.applicationId}/{name}"
