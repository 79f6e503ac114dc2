"""Session helpers.

Library code never creates a session; it takes the caller's.  ``local_session``
is for tests and the bench only.  ``checkpoint_dir`` reads the cluster's
``spark.checkpoint.dir`` and only falls back to a fresh scratch folder when the
setting is absent (local runs).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "riskloom") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.files.maxPartitionBytes", str(128 * 1024 * 1024))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder, creating a scratch one only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if not current:
        current = spark.conf.get("spark.checkpoint.dir", None)
        if current:
            sc.setCheckpointDir(current)
    if not current and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not current:
        current = tempfile.mkdtemp(prefix="riskloom-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        sc.setCheckpointDir(current)
        spark.conf.set("spark.checkpoint.dir", current)
    return current


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably in the shared checkpoint folder.

    Reliable checkpoints survive executor loss (unlike local checkpoints) and
    cut long lineages in iterative work such as model training.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def sizing_conf(input_bytes: int, cores: int, target_partition_mb: int = 256) -> dict[str, str]:
    """Shuffle/scan sizing for a cluster run: about ``target_partition_mb`` per
    task, at least two waves of tasks, AQE free to coalesce small partitions.
    Apply with ``apply_if_unset`` so a cluster's own settings win."""
    target = target_partition_mb * 1024 * 1024
    shuffle = max(2 * cores, -(-input_bytes // target))
    return {
        "spark.sql.shuffle.partitions": str(shuffle),
        "spark.sql.files.maxPartitionBytes": str(min(target, 512 * 1024 * 1024)),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    }


def apply_if_unset(spark: SparkSession, conf: dict[str, str]) -> None:
    defaults = {"spark.sql.shuffle.partitions": "200"}
    for k, v in conf.items():
        cur = spark.conf.get(k, None)
        if cur is None or cur == defaults.get(k):
            spark.conf.set(k, v)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``riskloom`` importable in executor Python workers (pandas UDFs,
    grouped-map and stateful functions refer to it): zip the package once per
    application and add it like ``--py-files``.  Idempotent."""
    import zipfile

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    import riskloom

    pkg = os.path.dirname(os.path.abspath(riskloom.__file__))
    fd, path = tempfile.mkstemp(prefix="riskloom-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)
