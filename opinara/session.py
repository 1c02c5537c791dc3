"""Session helpers: the few settings the engine relies on, and its shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime settings that results or plans depend on.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Rank bounds (budgets, top-k) up to this size are applied per partition before the shuffle.
    "spark.sql.optimizer.windowGroupLimitThreshold": "100000",
    # Batches for Python workers by size, so that long texts do not add up in one.
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
}


_local_dirs: dict[str, str] = {}


def ship_functions() -> None:
    """Let Python workers run this package's functions without having it installed.

    Functions and classes of the package travel by value inside the plan, which also reaches
    the helper process of stateful streams.
    """
    import opinara
    from pyspark import cloudpickle

    if "opinara" not in cloudpickle.list_registry_pickle_by_value():
        cloudpickle.register_pickle_by_value(opinara)


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else built."""
    for key, value in SESSION_CONF.items():
        spark.conf.set(key, value)
    ship_functions()
    return spark


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = (SparkSession.builder.master(f"local[{cpus}]").appName("opinara")
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.driver.memory", "12g")
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions)))
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = configure(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: ``spark.checkpoint.dir`` of the session.

    Where nothing is configured, a local master gets a folder of its own; a cluster has to name one.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if context.applicationId not in _local_dirs:
        _local_dirs[context.applicationId] = tempfile.mkdtemp(prefix="opinara-")
    return _local_dirs[context.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one run's intermediate table, below the shared folder."""
    return f"{shared_dir(spark)}/opinara/{name}-{uuid.uuid4().hex}"
