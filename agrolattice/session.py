"""SparkSession construction and lineage helpers.

Everything here is plain Spark configuration: AQE on (runtime broadcast conversion,
partition coalescing and skew-join splitting), UTC session time, no UI.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(master: str | None = None, app: str = "agrolattice",
                  shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # a partition is "skewed" when 5x the median and above 64 MB: split it
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64MB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128MB",
        "spark.sql.files.maxPartitionBytes": "128MB",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    On a cluster this is configured and simply read back.  Only when it is unset
    (unit tests, a laptop: a ``local`` master) a scratch folder is created and registered;
    on a cluster each executor would write to its own disk, so there it is an error.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="agrolattice-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


#: Spark deletes the shuffle files of a query when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str | None = None) -> DataFrame:
    """Cut lineage by writing ``df`` as parquet under the shared checkpoint folder.

    A lost executor then only re-reads files instead of recomputing the whole plan.  The shuffle
    files of the write go as soon as the table stands, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark)
    path = os.path.join(base, "tables", f"{name or 'stage'}-{uuid.uuid4().hex[:12]}")
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    table = spark.read.parquet(path)
    table.__dict__["_table"] = path  # for discard
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote (other frames stay as they are); no plan that is still
    to run may read them."""
    for df in tables:
        path = df.__dict__.get("_table")
        if path:
            jpath = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


def small_side(df: DataFrame, name: str, max_rows: int = 200_000) -> DataFrame:
    """A join side whose size is measured: ``df`` is written to shared storage once and read
    back, with a broadcast hint if it has at most ``max_rows`` rows.  Above that it carries no
    hint and the planner joins by a (skew-split) shuffle."""
    stored = materialize(df, name)
    return F.broadcast(stored) if stored.count() <= max_rows else stored


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt evenly over all cores, for rows that are few bytes and much work: a table of
    millions of such rows may be one file split, hence one task."""
    return df.repartition(3 * df.sparkSession.sparkContext.defaultParallelism)


def source_stamp(spark: SparkSession, path: str) -> str:
    """What tells two states of the files at ``path`` apart: name, size and modification time of
    its entries (any Hadoop file system)."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(jpath):
        return "absent"
    return ";".join(sorted(f"{x.getPath().getName()}:{x.getLen()}:{x.getModificationTime()}" for x in fs.listStatus(jpath)))
