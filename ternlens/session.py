"""SparkSession construction and lineage-cut helpers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on: UTC event time, AQE for runtime re-planning
# (partition coalescing and skew-join splitting), Arrow for the pandas stages.
_DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Python (Arrow) stages are CPU-bound per byte: do not let AQE fold a small but
    # expensive shuffle into one task. Large inputs are unaffected (they split anyway).
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    # Broadcast only what is provably small; everything else shuffles.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.ui.enabled": "false",
}


def get_spark(app_name: str = "ternlens", master: str | None = None,
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Return (or create) a session with the settings this library expects.

    On a cluster ``master`` is left to spark-submit; tests pass ``local[*]``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(_DEFAULT_CONF)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if extra:
        conf.update(extra)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    # A session that already existed keeps its static settings; runtime ones are applied here.
    for k, v in conf.items():
        if k.startswith("spark.sql.") and k != "spark.sql.warehouse.dir":
            try:
                spark.conf.set(k, v)
            except Exception:  # static conf on a shared session
                pass
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per Spark application.

    Arrow stages import it in the Python workers, which need not run where the driver
    does nor see its folders.  An installed package (site-packages) is taken to be on
    every node.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # a Connect session: the server's environment has the package
        return
    home = os.path.dirname(os.path.abspath(__file__))
    if getattr(sc, "_ternlens_shipped", False) or "site-packages" in home:
        return
    folder = tempfile.mkdtemp(prefix="ternlens-package-")  # read by the driver's own file server only
    sc.addPyFile(shutil.make_archive(os.path.join(folder, "ternlens"), "zip",
                                     os.path.dirname(home), os.path.basename(home)))
    sc._ternlens_shipped = True


@contextmanager
def adaptive(spark: SparkSession) -> Iterator[None]:
    """Adaptive execution for the queries inside.  A stream with state has it switched off in its session, in which
    ``foreachBatch`` works, too: there, writes would not be dealt by size and no shuffle be put together."""
    key = "spark.sql.adaptive.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    Only a session with a local master may go without: it gets a folder of its own, which
    is removed when the process ends.  On a cluster a missing setting is an error, since
    a folder of the driver's machine isn't seen by the executors.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # a Connect session: the server owns the checkpoint folder
        sc = None
    if configured:
        if sc is not None and sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    current = sc.getCheckpointDir() if sc is not None else None
    if current:
        return current
    master = sc.master if sc is not None else spark.conf.get("spark.master", "")
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="ternlens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    atexit.register(shutil.rmtree, local, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", local)
    if sc is not None:
        sc.setCheckpointDir(local)
    return local


#: Folders of this driver's staged tables.
_STAGED: dict[str, SparkSession] = {}


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared checkpoint folder and read back: computed once, survives lost executors, and
    a reader of a few columns reads only these.  Removed when the driver's Python ends, or by ``unstage``."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _STAGED:
        atexit.register(unstage)
    _STAGED[path] = spark
    return spark.read.schema(df.schema).parquet(path)


def unstage(*tables: DataFrame) -> None:
    """Removes the folders that the given staged tables read (all of this driver's, if none is given)."""
    files = [f for t in tables for f in t.inputFiles()]
    for path in [x for x in _STAGED if not tables or any(x.rsplit("/", 1)[1] in f for f in files)]:
        remove_folder(_STAGED.pop(path), path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder on whatever file system it is (at the interpreter's end the JVM may be gone)."""
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001
        if spark.sparkContext._jsc is not None:
            raise


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
