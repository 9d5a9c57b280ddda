"""Session, checkpoint and broadcast helpers shared by every operator."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Conf applied when this package builds the session itself (tests, bench,
# local runs). On a cluster the session comes from the caller and is used as is.
DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Whole documents travel through Arrow batches: keep batches small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.files.maxPartitionBytes": str(64 * 1024 * 1024),
}


def get_spark(
    master: str | None = None,
    app: str = "textmill",
    shuffle_partitions: int | None = None,
    extra: dict | None = None,
) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and materialised stages.

    Taken from ``spark.checkpoint.dir`` as the cluster names it. Only in a local
    session (tests), where driver and executors are one process, a fresh
    scratch folder stands in for it and is recorded in the session; elsewhere a
    missing setting is an error, since executors would write to their own disks.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="textmill-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    try:
        spark.sparkContext.setCheckpointDir(root)
    except Exception:  # no SparkContext in this client; written stages still use root
        pass
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the checkpoint root for a written stage."""
    root = checkpoint_root(spark)
    path = os.path.join(root, f"{name}-{os.urandom(6).hex()}")
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the checkpoint root and read it back: what follows starts
    from files that outlive any executor."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_broadcast(df: DataFrame, max_rows: int = 1_000_000, max_bytes: int = 64 << 20) -> DataFrame:
    """Broadcast ``df`` only when it is proven to hold at most ``max_rows`` rows and
    ``max_bytes`` bytes of values.

    The probe reads at most ``max_rows + 1`` rows. Beyond either bound the frame
    is returned unchanged and the join falls back to a shuffle join (which AQE
    may still turn into a broadcast at run time from real sizes).
    """
    size = F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))
    n, used = df.limit(max_rows + 1).agg(F.count("*"), size).first()
    return F.broadcast(df) if n <= max_rows and (used or 0) <= max_bytes else df
