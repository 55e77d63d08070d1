"""Session construction and lineage cutting.

Iterative trainers cut their lineage by writing parquet tables into the
shared folder named by ``spark.checkpoint.dir``. That setting is read
from the session; a folder of our own is only set when none is configured
(local runs and tests).
"""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "factorlab",
                  shuffle_partitions: int | None = None) -> SparkSession:
    """Session with AQE on, UI off, UTC session time zone."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("FACTORLAB_DRIVER_MEM", "16g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set = set()

# Bytes of an Arrow batch sent to a Python worker. The library's default bounds rows first (10,000
# texts of 20 kB would be 200 MB in the JVM and again in the worker).
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
_BATCH_DEFAULT = 64 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches in bytes, unless the session has a setting of its own."""
    now = spark.conf.get(_BATCH_SETTING, None)
    if now is None or now.rstrip("bB") == str(_BATCH_DEFAULT):
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def ship_package(spark: SparkSession) -> None:
    """Make ``factorlab`` importable in the Python workers (the pandas/Arrow
    functions are pickled by reference to its modules): zip the package once
    per SparkContext and add it with ``addPyFile``, as --py-files would. Also bounds the batches they receive."""
    bound_batches(spark)
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    out = os.path.join(tempfile.mkdtemp(prefix="factorlab-pyfiles-"), "factorlab.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(key)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder, setting one only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        # Local runs and tests only: a cluster must configure a shared folder.
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="factorlab-ckpt-"))
    else:
        raise RuntimeError("spark.checkpoint.dir is not set; iterative jobs need a shared folder")
    return sc.getCheckpointDir()


def _table_root(spark: SparkSession) -> str:
    return ensure_checkpoint_dir(spark).rstrip("/") + "/factorlab-tables"


def new_table_path(spark: SparkSession) -> str:
    """A folder of its own for one written table."""
    return f"{_table_root(spark)}/{uuid.uuid4().hex}"


def _read_back(spark: SparkSession, path: str, df: DataFrame) -> DataFrame:
    """The written table under the written schema (an empty or partitioned table has no
    footer to infer it from); remembers its folder for :func:`table_path`."""
    out = spark.read.schema(df.schema).parquet(path).select(*[f"`{c}`" for c in df.columns])
    out._factorlab_table = path
    return out


def cut_lineage(df: DataFrame, partition_by: list | None = None) -> DataFrame:
    """Materialise ``df`` as a parquet table in the shared checkpoint folder
    and return a DataFrame reading it back.

    One job computes and writes the data (a reliable ``checkpoint()`` would
    compute it twice unless cached); the result has a one-node lineage and
    survives the loss of any executor. ``partition_by``: low-cardinality
    columns to write as directories, so later filters on them prune files.
    """
    spark = df.sparkSession
    path = new_table_path(spark)
    w = df.write.mode("error")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return _read_back(spark, path, df)


def cut_lineage_observed(df: DataFrame, metrics: list) -> tuple[DataFrame, dict]:
    """:func:`cut_lineage` that also returns global aggregates of the written
    rows, computed by ``DataFrame.observe`` during the same write job."""
    from pyspark.sql import Observation
    obs = Observation(f"factorlab_{uuid.uuid4().hex[:12]}")
    spark = df.sparkSession
    path = new_table_path(spark)
    df.observe(obs, *metrics).write.mode("error").parquet(path)
    return _read_back(spark, path, df), obs.get


def table_path(df: DataFrame) -> str | None:
    """The folder that a DataFrame returned by :func:`cut_lineage` reads from
    (known from the write: no file listing); None for any other DataFrame."""
    return getattr(df, "_factorlab_table", None)


def drop_table(spark: SparkSession, path: str | None) -> None:
    """Delete a superseded table written by :func:`cut_lineage`."""
    if not path or "/factorlab-tables/" not in path:
        return
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(jpath, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished jobs now: it acts when the
    driver collects garbage, which a driver with little to do seldom does."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
