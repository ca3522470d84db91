"""Session helpers: a local session for tests/bench and the shared checkpoint folder."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", app: str = "tagwarden", checkpoint_dir: str | None = None,
                  extra: dict | None = None) -> SparkSession:
    """A local[N] session for tests and the bench (never used by the operators themselves)."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(cpus if cpus != "*" else 8))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if not any(k == "spark.driver.memory" for k in (extra or {})):
        builder = builder.config("spark.driver.memory", "8g")
    if checkpoint_dir:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    Library code never invents a machine-local folder: if the session has no
    checkpoint folder configured this raises, and the caller (a test, the bench)
    must set one.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        raise RuntimeError("spark.checkpoint.dir is not set; configure a shared folder for lineage cuts")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def ensure_test_checkpoint_dir(spark: SparkSession) -> str:
    """For tests and the bench only: set a scratch checkpoint folder where none is configured."""
    try:
        return checkpoint_dir(spark)
    except RuntimeError:
        import tempfile

        path = tempfile.mkdtemp(prefix="tw-ckpt-", dir=os.environ.get("TW_SCRATCH", "/tmp"))
        spark.sparkContext.setCheckpointDir(path)
        return path
