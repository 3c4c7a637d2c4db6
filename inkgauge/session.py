"""Session helpers.

Library code never creates a session on its own; callers pass one in.  These
helpers exist for tests, ``bench.py`` and the command line.  Cluster settings
(``spark.checkpoint.dir``, memory, executor counts) always win over the
defaults below: we only fill in what is unset.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession

# Defaults tuned for the scoring workload: text rows are wide (kilobytes per
# row) and the Python metric stage is CPU-bound, so partitions are kept small
# enough that one Arrow batch per task stays well inside executor memory.
DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.files.maxPartitionBytes": str(32 * 1024 * 1024),
    # Text scoring is CPU-bound per byte: keep post-shuffle partitions small
    # so every core has work (AQE still merges tiny ones).
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(16 * 1024 * 1024),
}


#: Checkpoints of single-machine sessions without ``spark.checkpoint.dir``.
LOCAL_CHECKPOINTS = "/tmp/inkgauge-checkpoints"


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "inkgauge", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
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
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting one only when unset.

    On a cluster ``spark.checkpoint.dir`` names shared storage and is used as
    is; without the setting this raises.  A single-machine session
    (``local[...]``: tests, bench) gets a folder of its own.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
        configured = os.path.join(LOCAL_CHECKPOINTS, sc.applicationId)
    sc.setCheckpointDir(configured)
    return configured


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the checkpoint folder for written intermediate
    tables (shared storage on a cluster, never a machine-local temp dir)."""
    return f"{_tables(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def _tables(spark: SparkSession) -> str:
    """The folder of this application's written tables."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{spark.sparkContext.applicationId}"


def drop_written(spark: SparkSession) -> None:
    """Delete all tables that this application has written so far.

    Frames that have not been computed yet may still read them: call this when
    the results are written.  Other applications' tables are not touched."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_tables(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df, name: str):
    """Write ``df`` into the checkpoint folder and read it back: one
    execution, the same rows for every reader."""
    path = scratch_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``inkgauge`` importable by every Python worker (Arrow UDFs,
    ``mapInPandas``) by shipping it as a zip with ``addPyFile`` once per
    application - the usual way to distribute job code to a cluster.  The
    zip is written through the Hadoop FileSystem API into the shared
    checkpoint folder, never into a machine-local temporary folder."""
    import io
    import zipfile

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, files in os.walk(root):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.join("inkgauge", os.path.relpath(full, root)))
    target = f"{ensure_checkpoint_dir(spark).rstrip('/')}/code/{uuid.uuid4().hex[:12]}/inkgauge.zip"
    jvm = sc._jvm
    path = jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    out = fs.create(path, True)
    try:
        out.write(bytearray(buf.getvalue()))
    finally:
        out.close()
    sc.addPyFile(str(fs.makeQualified(path).toString()))
    _SHIPPED.add(app)


def materialize(df):
    """Compute ``df`` once and cut its lineage with a reliable checkpoint in
    ``spark.checkpoint.dir`` (shared storage): every later consumer reads the
    files, and a lost executor costs a re-read, not a recomputation of the
    upstream text work."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
