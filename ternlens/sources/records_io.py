"""Record and alert storage: append, idempotent upsert, JSON-text codec, CSV export.

The record table is Parquet partitioned by ``app_name, event_date``. Upserts
rewrite only the partitions that the incoming rows touch (dynamic partition
overwrite), never the whole table.  Beside the table lies an index, an append-only log of where each
id was put (id → partition, by a hash of the id); it tells an upsert which partitions hold earlier
versions of the incoming ids, so an id that moves to another app or date leaves its old place.

Writers deal rows by size (``rebalance``): small partitions get one file, a hot one as many tasks
and files as its rows make.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ternlens import constants as K
from ternlens.functions.text import iso_utc
from ternlens.schemas import ALERT_SCHEMA, RECORD_SCHEMA
from ternlens.session import remove_folder, stage, unstage

_ARRAY_COLUMNS = {"tags": "array<string>", "flagged_claims": "array<string>", "embedding_vector": "array<double>"}


def with_partition_columns(records: DataFrame) -> DataFrame:
    return records.withColumn("event_date", F.to_date("timestamp"))


RECORD_PARTITIONS = ("app_name", "event_date")


def _stored(records: DataFrame, parts: tuple[str, ...] = RECORD_PARTITIONS) -> DataFrame:
    """With the partition columns and ``created_at`` (the time of storing, if not given)."""
    if "created_at" not in records.columns:
        records = records.withColumn("created_at", F.current_timestamp())
    return with_partition_columns(records)


def _dealt(rows: DataFrame, parts: tuple[str, ...]) -> DataFrame:
    """Dealt by partition and size: AQE splits hot partitions and puts small ones together."""
    return rows.hint("rebalance", *[F.col(c) for c in parts])


# ------------------------------------------------------------------ id index
def index_path(path: str) -> str:
    return path.rstrip("/") + "-index"


def _append_index(rows: DataFrame, path: str, key: str, parts: tuple[str, ...]) -> None:
    """Logs where the ids of ``rows`` are now."""
    place = F.struct(*parts).alias("place")
    (rows.select(F.xxhash64(key).alias("h"), F.col(key).alias("key"), place, F.lit(time.time_ns()).alias("written"))
     .write.mode("append").parquet(index_path(path)))


def locations(spark: SparkSession, path: str, ids: DataFrame, key: str = "id",
              parts: tuple[str, ...] = RECORD_PARTITIONS) -> DataFrame:
    """(key, partition columns): where the table holds the given ids, by the index's latest entry for each.

    A table without an index (written by other means) gets one from its own ids first.
    """
    if not _exists(spark, index_path(path)):
        _append_index(spark.read.parquet(path), path, key, parts)
    log = spark.read.parquet(index_path(path))
    wanted = ids.select(F.xxhash64(key).alias("h"), F.col(key).alias("key"))
    last = log.join(wanted, ["h", "key"], "left_semi").groupBy("key").agg(F.max_by("place", "written").alias("place"))
    return last.select(F.col("key").alias(key), "place.*")


def compact_index(spark: SparkSession, path: str) -> None:
    """Rewrites the index with one entry per id (the log grows by every delivery)."""
    log = spark.read.parquet(index_path(path))
    last = stage(log.groupBy("h", "key").agg(F.max_by("place", "written").alias("place"), F.max("written").alias("written")), "index")
    last.write.mode("overwrite").parquet(index_path(path))
    unstage(last)


def save_records(records: DataFrame, path: str, mode: str = "append") -> None:
    """Append scored records (an empty frame writes nothing) and log their places in the index."""
    rows = _stored(records)
    _dealt(rows, RECORD_PARTITIONS).write.mode(mode).partitionBy(*RECORD_PARTITIONS).parquet(path)
    if mode == "overwrite":
        remove_folder(records.sparkSession, index_path(path))
    _append_index(rows, path, "id", RECORD_PARTITIONS)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Read the record table; ``event_date`` / ``app_name`` filters prune partitions."""
    return spark.read.parquet(path)


def latest_version(df: DataFrame, key: str = "id", order: str = "created_at") -> DataFrame:
    """S6 core: one row per key, of the latest delivery (``_seq``), whatever ``created_at`` says;
    within one delivery the newest ``created_at``, nulls last.

    A ``max_by`` over the key: combined before the shuffle.
    """
    cols = [c for c in df.columns if c != "_seq"]
    best = F.max_by(F.struct(*cols), F.struct("_seq", F.col(order).isNotNull(), order))
    return df.groupBy(F.col(key).alias("_key")).agg(best.alias("_row")).select("_row.*")


def upsert_frames(existing: DataFrame, incoming: DataFrame, key: str = "id", order: str = "created_at") -> DataFrame:
    """The incoming rows, of which each key has one, and the latest stored row of every other key (a null key is one, too).

    Of the incoming rows only the keys are joined; the stored ones move once.
    """
    new = incoming.select(F.col(key).alias("_new"))
    stay = existing.join(new, existing[key].eqNullSafe(new["_new"]), "left_anti").withColumn("_seq", F.lit(0))
    return latest_version(stay, key, order).unionByName(incoming.select(*existing.columns))


def _once(rows: DataFrame, key: str, put) -> DataFrame:
    """``latest_version`` of one delivery: a row whose key comes once stays where it is, so only hashes of keys are
    shuffled, and the rows of keys that come more often.  ``put`` stages a table."""
    held = put(rows)
    h = F.xxhash64(F.col(key))
    several = put(held.select(h.alias("_h")).groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_h"))
    if several.isEmpty():
        return held
    alone = held.join(several, h == several["_h"], "left_anti")
    latest = latest_version(held.join(several, h == several["_h"], "left_semi").withColumn("_seq", F.lit(1)), key)
    return put(alone.select(*held.columns).unionByName(latest.select(*held.columns)))


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _partition_folder(spark: SparkSession, path: str, place: dict) -> str:
    escape = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
    return "/".join([path.rstrip("/"), *(escape(c, None if v is None else str(v)) for c, v in place.items())])


def upsert_records(spark: SparkSession, incoming: DataFrame, path: str, key: str = "id",
                   parts: tuple[str, ...] = RECORD_PARTITIONS) -> None:
    """S6 on disk: one row per id, the latest delivery's, rewriting only the partitions that the delivery touches.

    These are the partitions of the incoming rows and those in which the index has earlier versions of
    their ids.  The incoming rows are computed once and the touched partitions merged into a staging folder of the
    shared checkpoint folder, then overwritten dynamically (a writer option, so other jobs of the session are not
    affected); partitions that have lost all their rows are deleted, and the new places logged last.  A
    delivery that is stopped anywhere and given again leaves the same table.
    """
    staged = []

    def put(df: DataFrame) -> DataFrame:
        staged.append(stage(df, "upsert"))
        return staged[-1]
    try:
        fresh = _once(_stored(incoming, parts), key, put)
        if _exists(spark, path) and fresh.isEmpty():  # a delivery without rows touches nothing
            return
        new_places = fresh.select(*parts)
        if _exists(spark, path):
            places = put(new_places.union(locations(spark, path, fresh, key, parts).select(*parts)).distinct())
            # the span of every partition column, so that the scan is pruned to it; the semi-join is exact
            span = places.agg(*[f(c).alias(f"{n}_{c}") for c in parts for n, f in (("lo", F.min), ("hi", F.max))]).first()
            old = spark.read.parquet(path)
            if not all(isinstance(span[f"lo_{c}"], type(None)) for c in parts):
                for c in parts:
                    old = old.where(F.col(c).between(span[f"lo_{c}"], span[f"hi_{c}"]) | F.col(c).isNull())
            same = [old[c].eqNullSafe(places[c]) for c in parts]
            old = old.join(places, same, "left_semi")
            for f in fresh.schema.fields:
                if f.name not in old.columns:  # a column that is new in this delivery
                    old = old.withColumn(f.name, F.lit(None).cast(f.dataType))
            merged = put(upsert_frames(old.select(*fresh.columns), fresh, key))
            kept = merged.select(*parts).distinct()
            emptied = places.join(kept, [places[c].eqNullSafe(kept[c]) for c in parts], "left_anti")
        else:
            merged, emptied = fresh, None
        (_dealt(merged, parts).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(*parts).parquet(path))
        for row in emptied.toLocalIterator() if emptied is not None else ():  # folders, a few for each delivery
            remove_folder(spark, _partition_folder(spark, path, row.asDict()))
        _append_index(fresh, path, key, parts)
    finally:
        for t in staged:
            unstage(t)


# ------------------------------------------------------------------ S7 JSON-text codec
def encode_for_text_store(records: DataFrame) -> DataFrame:
    """S7 encode: arrays → JSON text, booleans → 0/1, timestamps → ISO text."""
    out = records
    for c in _ARRAY_COLUMNS:
        if c in out.columns:
            out = out.withColumn(c, F.to_json(F.col(c)))
    if "is_denial" in out.columns:
        out = out.withColumn("is_denial", F.col("is_denial").cast("int"))
    for c in ("timestamp", "created_at"):
        if c in out.columns:
            out = out.withColumn(c, iso_utc(F.col(c)))
    return out


def decode_from_text_store(rows: DataFrame, now: Column | None = None) -> DataFrame:
    """S7 decode: JSON text → arrays (null → []), 0/1 → boolean, bad timestamps → now."""
    now = now if now is not None else F.current_timestamp()
    out = rows
    for c, t in _ARRAY_COLUMNS.items():
        if c in out.columns:
            out = out.withColumn(c, F.coalesce(F.from_json(F.col(c), t), F.array().cast(t)))
    if "is_denial" in out.columns:
        out = out.withColumn("is_denial", F.col("is_denial").cast("int") != 0)
    for c in ("timestamp", "created_at"):
        if c in out.columns:
            out = out.withColumn(c, F.coalesce(F.try_to_timestamp(F.col(c)), now))
    return out


# ------------------------------------------------------------------ S8 alerts
def save_alerts(alerts: DataFrame, path: str) -> None:
    """Alerts are upserted by id like records; ids are deterministic, so a retry changes nothing."""
    rows = (alerts.select(*[f.name for f in ALERT_SCHEMA.fields])
            .withColumn("created_at", F.col("timestamp")))
    upsert_records(alerts.sparkSession, rows, path, parts=("event_date",))


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*[f.name for f in ALERT_SCHEMA.fields])


# ------------------------------------------------------------------ S9 CSV export
_CSV_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def export_projection(records: DataFrame, n: int = K.CSV_EXPORT_ROWS) -> DataFrame:
    """The latest n records with the 19 export columns (no arrays, no context)."""
    latest = records.orderBy(F.col("timestamp").desc(), F.col("id").desc()).limit(n)
    return latest.select(*K.CSV_EXPORT_COLUMNS)


def export_csv(records: DataFrame, path: str, n: int = K.CSV_EXPORT_ROWS) -> None:
    """The export as one CSV file with a header; quotes are doubled, so that texts with line ends and quotes read back."""
    (export_projection(records, n).coalesce(1).write.mode("overwrite")
     .option("header", True).option("escape", '"').option("emptyValue", '""')
     .option("timestampFormat", _CSV_TIME).csv(path))


def read_csv_export(spark: SparkSession, path: str) -> DataFrame:
    """The rows that ``export_csv`` wrote, with the record types."""
    kinds = {f.name: f for f in RECORD_SCHEMA.fields}
    return (spark.read.schema(T.StructType([kinds[c] for c in K.CSV_EXPORT_COLUMNS])).option("header", True)
            .option("escape", '"').option("multiLine", True)
            .option("nullValue", "\u0001")  # what the reader makes of an unquoted empty field; a quoted one is an empty text
            .option("emptyValue", "").option("timestampFormat", _CSV_TIME).csv(path))
