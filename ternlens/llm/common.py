"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import functools
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ternlens.session import checkpoint_dir


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches, a few rows at a time: a whole batch never becomes Python objects."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


#: Functions whose results a Python worker keeps from task to task.
_KEPT: list[Callable] = []


def kept(maxsize: int):
    """``lru_cache`` for a worker's large tables, which ``let_go`` drops."""
    def wrap(f):
        f = functools.lru_cache(maxsize=maxsize)(f)
        _KEPT.append(f)
        return f
    return wrap


def let_go() -> None:
    """Drops the tables that this worker keeps for other operators: a reused worker holds them while it works on something else."""
    for f in _KEPT:
        f.cache_clear()


def staged(df: DataFrame, name: str, slim: bool = False) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back.

    Cuts the lineage: a lost executor costs only the reading tasks, not the stages
    before.  The folder is removed when the driver's Python ends.  ``slim``: rows of a few
    numbers, written by one task for each core, not one for each shuffle partition.
    """
    spark = df.sparkSession
    if slim:
        df = df.coalesce(max(1, spark.sparkContext.defaultParallelism))
    path = f"{checkpoint_dir(spark).rstrip('/')}/staged-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _FOLDERS:
        atexit.register(_remove_all)
    _FOLDERS[path] = spark
    return spark.read.schema(df.schema).parquet(path)


#: Folders of this driver's staged tables, in the order they were written.
_FOLDERS: dict[str, SparkSession] = {}


def collect_shuffles(spark: SparkSession) -> None:
    """Lets the driver's collector find the shuffles of finished steps, whose files Spark's cleaner then removes."""
    jvm = getattr(spark.sparkContext, "_jvm", None)
    if jvm is not None:
        jvm.java.lang.System.gc()


def releasing(operator):
    """The operator's result (a DataFrame) keeps the staged tables that it reads; the others written meanwhile are removed."""
    @functools.wraps(operator)
    def run(*args, **kwargs):
        before = set(_FOLDERS)
        out = operator(*args, **kwargs)
        release(set(_FOLDERS) - before, out)
        collect_shuffles(out.sparkSession)
        return out
    return run


def release(paths: set[str], result: DataFrame | None = None) -> None:
    """Removes the staged folders ``paths`` but for those that ``result`` reads."""
    used = result.inputFiles() if result is not None else []
    read = {p for p in paths if any(p.rsplit("/", 1)[1] in f for f in used)}
    for path in paths - read:
        _remove(_FOLDERS.pop(path), path)


def discard(*tables: DataFrame) -> None:
    """Removes the folders of staged tables that nothing reads any more, and the shuffles that made them."""
    for t in tables:
        release({p for p in list(_FOLDERS) if any(p.rsplit("/", 1)[1] in f for f in t.inputFiles())})
    if tables:
        collect_shuffles(tables[0].sparkSession)


def _remove_all() -> None:
    for path, spark in _FOLDERS.items():
        _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    jvm = getattr(spark.sparkContext, "_jvm", None)
    if jvm is None or spark.sparkContext._jsc is None:
        return
    try:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may be gone at interpreter exit
        pass


def crc_mod(id_col: str, m: int) -> Column:
    """crc32 of the id as text, modulo ``m`` (the fold of the labelled operators)."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(m)


def own(df: DataFrame, *cols: str) -> DataFrame:
    """Only the named columns: extra columns of the input, whatever their names, take no part."""
    return df.select(*[df[c].alias(c) for c in cols])


def text_hash(text: Column) -> Column:
    """SHA-256 (binary) of a text; empty for null."""
    return F.coalesce(F.unhex(F.sha2(text, 256)), F.lit(b""))


def row_keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, sha, row: a number for each different (identifier, text), ascending by identifier (null last) and hash."""
    each = docs.select(docs[id_col].alias("id"), text_hash(docs[text_col]).alias("sha")).distinct()
    return staged(each.orderBy(F.col("id").asc_nulls_last(), "sha").withColumn("row", F.monotonically_increasing_id()), "rows")


def with_row(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row, text of every row of ``docs``."""
    texts = docs.select(docs[id_col].alias("i"), text_hash(docs[text_col]).alias("h"), docs[text_col].alias("text"))
    return texts.join(keys, F.col("i").eqNullSafe(F.col("id")) & (F.col("h") == F.col("sha"))).select("row", "text")


def rows_among(docs: DataFrame, kept: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of ``docs`` whose (identifier, text) is among ``kept`` (id, sha); null identifiers are equal."""
    kept = kept.select(F.col("id").alias("__id"), F.col("sha").alias("__sha"))
    return docs.join(kept, docs[id_col].eqNullSafe(kept["__id"]) & (text_hash(docs[text_col]) == kept["__sha"]), "left_semi")


def one_each(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of each (identifier, text)."""
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    keyed = docs.select(docs[id_col].alias("id"), text_hash(docs[text_col]).alias("sha"), row)
    return keyed.groupBy("id", "sha").agg(F.first("row").alias("row")).select("row.*")
