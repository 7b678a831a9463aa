"""Session helpers.

Cluster settings (memory, executors, the shared checkpoint folder) come from
the cluster's own configuration; this module only fills in what is unset, so a
laptop test and a 1000-executor job build the same plans.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings for a session this module creates; an already running session (a
# cluster job, the round driver) is used as it is. The checkpoint folder is never
# set here unless the session has none (see ensure_checkpoint_dir).
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # remove reliable-checkpoint files once their DataFrame is unreachable
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "curio") -> SparkSession:
    """Return the active session, creating a local one when none exists."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in _DEFAULTS.items():
        builder = builder.config(key, value)
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the cluster (a shared file system path); an
    unset folder there is an error, since a folder of the driver's machine
    cannot be read by the executors. Only a local session (tests, a laptop),
    where driver and executors are one process, gets a scratch folder.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="curio-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the shared checkpoint folder for a written
    table. Spark's writer makes the folder, on whatever store the path names."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df, name: str):
    """Cut lineage by writing ``df`` as Parquet under the shared checkpoint
    folder and reading it back. Unlike an RDD checkpoint the result is
    columnar: later passes that need a few columns (sort keys, ids) read only
    those, and filters push down to the files. ``discard`` removes the files."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df) -> None:
    """Delete the files of a table that ``materialize`` wrote, once nothing
    reads it any more. Paths outside the checkpoint folder are left alone."""
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/").split(":", 1)[-1].lstrip("/")
    jvm = spark._jvm
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        if base and f"/{base}/" in folder.replace("///", "/"):
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
