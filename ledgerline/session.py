"""Session construction and shared settings.

Everything in the library takes a ``SparkSession`` from the caller; this module
only builds one for tests, the bench and the driver entry point, and answers
where lineage-cutting checkpoints go.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every session needs for the results to be right, not just fast.
REQUIRED_CONF = {
    # Timestamps in the fixtures are zone-less; pin the zone so casts to
    # TIMESTAMP (needed for watermarks) are deterministic.
    "spark.sql.session.timeZone": "UTC",
    # Runtime re-planning: coalesces small shuffle partitions, switches joins
    # to broadcast when a side turns out small, splits skewed join partitions.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Decimal overflow and integer division by zero raise instead of nulling.
    "spark.sql.ansi.enabled": "true",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "ledgerline", extra: dict | None = None) -> SparkSession:
    """Local session for tests and the bench (the cluster brings its own)."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    )
    for k, v in {**REQUIRED_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_required_conf(spark)
    ship_package(spark)
    for k, v in (extra or {}).items():
        if k.startswith("spark.sql."):  # runtime-settable; others were applied at startup
            spark.conf.set(k, v)
    ensure_checkpoint_dir(spark)
    return spark


def apply_required_conf(spark: SparkSession) -> None:
    for k, v in REQUIRED_CONF.items():
        spark.conf.set(k, v)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the deployment (a shared file system path) and
    is used as is. Only when it is unset, as in local tests, is a scratch
    folder created and registered. Works without a SparkContext (Spark
    Connect), where only the setting is read or set.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: no driver-side context
        sc = None
    if current:
        if sc is not None and sc.getCheckpointDir() is None:
            sc.setCheckpointDir(current)
        return current
    existing = sc.getCheckpointDir() if sc is not None else None
    if existing:
        return existing
    master = sc.master if sc is not None else spark.conf.get("spark.master", "")
    if not master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="ledgerline-ckpt-", dir=os.environ.get("LEDGERLINE_SCRATCH", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", path)
    if sc is not None:
        sc.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for written intermediates."""
    base = ensure_checkpoint_dir(spark)
    if base.startswith("file:"):
        base = base[len("file:"):]
    return os.path.join(base, name)


def recommended_conf(input_bytes: int, total_cores: int, target_partition_bytes: int = 256 << 20,
                     shuffle_fraction: float = 0.3) -> dict[str, str]:
    """Shuffle and scan sizing for a cluster run over ``input_bytes`` of parquet.

    The largest shuffle moves the pruned trade columns, about
    ``shuffle_fraction`` of the input. Partitions are sized so that an average
    one holds ``target_partition_bytes``, with at least two waves of tasks;
    AQE then coalesces small partitions and splits skewed join partitions at
    run time.
    """
    parts = max(2 * total_cores, int(input_bytes * shuffle_fraction) // target_partition_bytes + 1)
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.files.maxPartitionBytes": str(512 << 20),
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }


_SHIPPED_ZIP: str | None = None


def ship_package(spark: SparkSession) -> None:
    """Make ``ledgerline`` importable in the executors' Python workers.

    Functions run by ``mapInPandas`` / ``applyInPandasWithState`` are pickled
    by reference to their module, so workers must import the package. The
    package is zipped once per driver process and added to the session as a
    Python file (``--py-files`` equivalent); Spark copies it to every
    executor. Idempotent per session.
    """
    global _SHIPPED_ZIP
    if spark.conf.get("spark.ledgerline.shipped", "false") == "true":
        return
    if _SHIPPED_ZIP is None:
        import shutil
        pkg_dir = os.path.dirname(os.path.abspath(__file__))
        out = tempfile.mkdtemp(prefix="ledgerline-pkg-")
        _SHIPPED_ZIP = shutil.make_archive(os.path.join(out, "ledgerline"), "zip",
                                           root_dir=os.path.dirname(pkg_dir), base_dir="ledgerline")
    try:
        spark.sparkContext.addPyFile(_SHIPPED_ZIP)
    except Exception:  # Spark Connect: no SparkContext
        spark.addArtifacts(_SHIPPED_ZIP, pyfile=True)
    spark.conf.set("spark.ledgerline.shipped", "true")
