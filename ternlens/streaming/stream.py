"""Structured Streaming forms of the pipeline (ST1–ST6).

* ST1, ST2 are in ``streaming.chain``: whole micro-batches with a ledger.
* ST3 ``stateful_cooldown``: ``transformWithState`` keyed by (app, metric), with a list of pending
  breaches, the last fired time, and event-time timers: a breach is decided when the watermark has passed it, so
  the order of delivery inside the watermark doesn't matter. The breaches go to the keys, and wait there, in packs.
* ST4 ``upsert_sink``: ``foreachBatch`` that merges each micro-batch into the record table, touching only the
  partitions it needs; a batch id entered in the ledger is skipped when it is delivered again.
* ST5 ``drain``: ``trigger(availableNow=True)`` then ``awaitTermination(timeout)``.
* ST6 ``windowed_time_series``: watermark + tumbling ``window`` per app; late rows beyond
  the watermark are dropped (the batch form G1 has no lateness rule).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ternlens import constants as K
from ternlens.session import adaptive, remove_folder


def event_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """S1 (streaming): files under ``path`` with a fixed schema, oldest first; a trigger takes all
    new files, or so many of them."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def create_source(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """An empty folder of files, which a stream can be started on."""
    spark.createDataFrame([], schema).write.mode("append").parquet(path)


# ------------------------------------------------------------------ ST3
#: Pending breaches of a key that are packed together, and unpacked at a time.
HELD_ROWS = 1000
#: Breaches of a task that are put in order of their keys before they are packed.
DEALT_ROWS = 32_768
#: Packs that the state store hands to Python at a time.
HELD_PACKS = 32
#: Breaches of one key: their instants, eight bytes each, and the rows as a compressed Arrow batch.
_PACK = T.StructType([T.StructField("instants", T.BinaryType()), T.StructField("rows", T.BinaryType())])


class _Packing:
    """Rows of a schema to packs and back; ``_ts`` is a row's instant."""

    def __init__(self, schema: T.StructType):
        self.names, self.arrow = schema.fieldNames(), to_arrow_schema(schema)

    def pack(self, rows: pa.RecordBatch) -> tuple[bytes, bytes]:
        at = rows.column("_ts")
        if at.null_count:
            raise ValueError("a breach has no timestamp")
        whole = rows.serialize()
        return (at.to_numpy(zero_copy_only=False).astype("<i8").tobytes(),
                len(whole).to_bytes(8, "little") + pa.compress(whole, codec="zstd", asbytes=True))

    def unpack(self, rows: bytes) -> pa.RecordBatch:
        whole = pa.decompress(memoryview(rows)[8:], decompressed_size=int.from_bytes(rows[:8], "little"), codec="zstd")
        return pa.ipc.read_record_batch(whole, self.arrow)

    def of_rows(self, rows: Iterator[tuple]) -> Iterator[tuple[bytes, bytes]]:
        for some in iter(lambda: list(islice(rows, HELD_ROWS)), []):
            yield self.pack(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), self.arrow)], schema=self.arrow))


def _packed(schema: T.StructType, keys: list[str]):
    """Rows to packs of one key each, with the key columns and the latest instant: (keys, instants, rows, _event)."""
    packing = _Packing(schema)

    def packs(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).select(packing.names).cast(packing.arrow).combine_chunks()
        code = np.zeros(len(rows), dtype=np.int64)
        for k in keys:
            of = rows[k].combine_chunks().dictionary_encode(null_encoding="encode")
            code = np.unique(code * len(of.dictionary) + of.indices.to_numpy(), return_inverse=True)[1]
        order = np.argsort(code, kind="stable")
        code, rows = code[order], rows.take(pa.array(order)).combine_chunks()
        edge = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        starts = np.concatenate([np.arange(s, e, HELD_ROWS) for s, e in zip(edge, np.append(edge[1:], len(rows)))])
        batch = rows.to_batches()[0]
        out = [packing.pack(batch.slice(s, e - s)) for s, e in zip(starts, np.append(starts[1:], len(rows)))]
        latest = np.maximum.reduceat(rows["_ts"].to_numpy(), starts)
        return pa.RecordBatch.from_arrays(
            [batch.column(k).take(pa.array(starts)) for k in keys]
            + [pa.array([p[0] for p in out], pa.binary()), pa.array([p[1] for p in out], pa.binary()), pa.array(latest).cast(pa.timestamp("us", "UTC"))],
            names=[*keys, *_PACK.fieldNames(), "_event"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= DEALT_ROWS:
                yield packs(held)
                held = []
        if any(b.num_rows for b in held):
            yield packs(held)

    return pack


class _Packs:
    """A list of packs, each under a key of its own in the state store: a list state is one value there, which each append reads."""

    def __init__(self, handle: StatefulProcessorHandle, name: str):
        self.packs = handle.getMapState(name, "n long", _PACK)
        self.count = handle.getValueState(f"{name}_count", "n long")

    def get(self) -> Iterator[tuple]:
        return self.packs.values()

    def appendList(self, packs: list[tuple[bytes, bytes]]) -> None:
        n = self.count.get()[0] if self.count.exists() else 0
        for k, pack in enumerate(packs, n):
            self.packs.updateValue((k,), pack)
        self.count.update((n + len(packs),))

    def clear(self) -> None:
        self.packs.clear()
        self.count.clear()


class _Cooldown(StatefulProcessor):
    """One key's breaches that the watermark hasn't passed, and its last fire; a timer stands at the earliest pending breach.

    The pending breaches are kept in packs of up to ``HELD_ROWS``, read and written one after the other: of the passed ones a task
    holds the instants, eight bytes each, and the rows that fire; only packs in which some fire are unpacked, and those of which some stay.
    The packs that stay are written to the other one of two lists.
    """

    def __init__(self, cooldown_us: int, schema: T.StructType):
        self.cooldown, self.schema = cooldown_us, schema
        self.at, self.record = schema.fieldNames().index("_ts"), schema.fieldNames().index("record_id")
        self.packing = _Packing(schema)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lists = [self._list(name) for name in ("pending", "pending_other")]
        self.turn = handle.getValueState("turn", "i int")
        self.last = handle.getValueState("last_fired", "t long")

    def _list(self, name: str):
        return self.handle.getListState(name, _PACK)

    def _turn(self) -> int:
        return self.turn.get()[0] if self.turn.exists() else 0

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        self._add(self.lists[self._turn()], self.packing.of_rows(tuple(r) for r in rows))
        return iter(())

    def _add(self, pending, packs: Iterator[tuple[bytes, bytes]], watermark: int = -1) -> None:
        """Appends the packs and sets a timer at the earliest breach; timers up to the watermark are spent."""
        earliest = None
        for pack in packs:
            pending.appendList([pack])
            first = int(self._instants(pack).min())
            earliest = first if earliest is None else min(earliest, first)
        if earliest is not None:
            self._wake(earliest, watermark)

    def _wake(self, ts_us: int, watermark: int) -> None:
        """A timer for the millisecond after ``ts_us``, unless one stands earlier."""
        at = ts_us // 1000 + 1
        standing = [t for t in self.handle.listTimers() if t > watermark]
        if not standing or min(standing) > at:
            for t in standing:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(at)

    def _instants(self, pack: tuple[bytes, bytes]) -> np.ndarray:
        return np.frombuffer(pack[0], dtype="<i8")

    def _order(self, row: tuple) -> tuple:
        """Of breaches at one instant the one of the smallest record id (null: first) fires."""
        return row[self.record] is not None, row[self.record] or ""

    def _fires(self, instants: np.ndarray, last: int | None) -> list[int]:
        """The instants, of the ascending ones, at which a breach fires."""
        out, j = [], 0 if last is None else int(np.searchsorted(instants, last + self.cooldown, side="left"))
        while j < len(instants):
            out.append(int(instants[j]))
            j = int(np.searchsorted(instants, max(out[-1] + self.cooldown, out[-1] + 1), side="left"))
        return out

    def _decided(self, pending, fires: list[int], passed: int, fired: dict[int, list[tuple]]) -> Iterator[tuple[bytes, bytes]]:
        """Puts the rows that fire into ``fired`` and gives the packs of the rows that stay."""
        for pack in pending.get():
            instants = self._instants(pack)
            stays, hits = instants >= passed, np.isin(instants, fires)
            rows = self.packing.unpack(pack[1]) if hits.any() or (stays.any() and not stays.all()) else None
            if hits.any():
                columns = rows.filter(pa.array(hits)).columns
                for r in zip(*(c.to_pylist(maps_as_pydicts="strict") for c in columns)):
                    if self.cooldown <= 0:             # every breach fires
                        fired.setdefault(r[self.at], []).append(r)
                    elif r[self.at] not in fired or self._order(r) < self._order(fired[r[self.at]][0]):
                        fired[r[self.at]] = [r]
            if stays.all():
                yield tuple(pack)
            elif stays.any():
                yield self.packing.pack(rows.filter(pa.array(stays)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        turn = self._turn()
        pending, other = self.lists[turn], self.lists[1 - turn]
        instants = [np.unique(t[t < passed]) for t in map(self._instants, pending.get())]
        fires = self._fires(np.unique(np.concatenate([np.empty(0, np.int64), *instants])), self.last.get()[0] if self.last.exists() else None)
        fired: dict[int, list[tuple]] = {}
        self._add(other, self._decided(pending, fires, passed, fired), passed // 1000)
        pending.clear()
        self.turn.update((1 - turn,))
        if fires:
            self.last.update((fires[-1],))
        names = self.schema.fieldNames()
        return (Row(**dict(zip(names, r))) for t in fires for r in sorted(fired[t], key=self._order))

    def close(self) -> None:
        pass


class _PackedCooldown(_Cooldown):
    """The cooldown of breaches that come in packs, any number for a key."""

    def _list(self, name: str) -> _Packs:
        return _Packs(self.handle, name)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        self._add(self.lists[self._turn()], ((bytes(r["instants"]), bytes(r["rows"])) for r in rows))
        return iter(())


def stateful_cooldown(alerts: DataFrame, cooldown_seconds: int = K.DEFAULT_COOLDOWN_SECONDS,
                      scope: str = "app_metric", watermark: str = "1 hour") -> DataFrame:
    """ST3: alerts that fire under the cooldown, with per-key state across batches.

    An alert is given out when the watermark has passed it; until then later deliveries may bring earlier breaches.
    So any order within the watermark gives the rows of W3; rows behind the watermark are dropped by Spark (counted as
    ``numRowsDroppedByWatermark`` in the query's progress).  A breach delivered again within the watermark is one.
    Behind the dropping of repeated breaches, these go in packs: a few thousand rows of a task are packed by key, and Python handles packs.
    The state store is RocksDB, which such states and timers need; it is set for the session's streams. It doesn't count its rows
    (``numRowsTotal``), which would take a look-up of every repeated-breach key that it writes.
    """
    conf = alerts.sparkSession.conf
    conf.set("spark.sql.streaming.stateStore.providerClass",
             "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    conf.set("spark.sql.execution.arrow.transformWithStateInPySpark.maxStateRecordsPerBatch", str(HELD_PACKS))
    conf.set("spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows", "false")
    keys = ["metric"] if scope == "metric" else ["app_name", "metric"]
    src = (alerts.withWatermark("timestamp", watermark)
           .dropDuplicatesWithinWatermark(["record_id", "metric", "timestamp"])
           .withColumn("_ts", F.unix_micros("timestamp")))
    # the state holds plain numbers in place of timestamps
    stamps = [f.name for f in src.schema.fields if isinstance(f.dataType, T.TimestampType)]
    plain = src.select(*[F.unix_micros(c).alias(f"{c}_us") if c in stamps else F.col(c) for c in src.columns])
    state = plain.schema
    # a pack's latest instant carries the watermark on
    event = T.StructField("_event", T.TimestampType(), True, src.schema["timestamp"].metadata)
    packs = plain.mapInArrow(_packed(state, keys), T.StructType([*(state[k] for k in keys), *_PACK.fields, event]))
    fired = packs.groupBy(*keys).transformWithState(
        _PackedCooldown(int(cooldown_seconds) * 1_000_000, state), state, "append", "eventTime")
    return fired.select(*[F.timestamp_micros(f"{c}_us").alias(c) if c in stamps else F.col(c) for c in alerts.columns])


# ------------------------------------------------------------------ ST4 / ST5 / ST6
def upsert_sink(path: str):
    """ST4: ``foreachBatch`` function merging each micro-batch (events or scored records) into the record table.

    The newest row of an id inside the batch counts.  The batch id is entered in a ledger beside the table, and a batch
    entered there is skipped; one that was stopped before is merged again to the same rows.
    """
    from ternlens.sources.records_io import upsert_records
    from ternlens.streaming.ledger import Ledger

    def sink(batch: DataFrame, batch_id: int) -> None:
        ledger = Ledger(batch.sparkSession, f"{path.rstrip('/')}-batches")
        if not ledger.done(batch_id):
            with adaptive(batch.sparkSession):
                upsert_records(batch.sparkSession, batch, path)
            ledger.commit(batch_id)

    return sink


def drain(writer, timeout: float | None = None):
    """ST5: process everything available, then stop."""
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination(timeout)
    return q


def windowed_time_series(records: DataFrame, metric: str = "health_score", window: str = "1 hour",
                         watermark: str = "10 minutes", by: tuple[str, ...] = ("app_name",)) -> DataFrame:
    """ST6: G1 on a stream — tumbling event-time windows per key with a watermark, for append mode: a
    window is written once, when the watermark has passed it, and its state is dropped.  Rows without
    the metric only advance the watermark."""
    v = F.col(metric).cast("double")
    agg = (records.withWatermark("timestamp", watermark).where(F.col(metric).isNotNull())
           .groupBy(F.window("timestamp", window), *by)
           .agg(F.avg(v).alias("avg_value"), F.min(v).alias("min_value"), F.max(v).alias("max_value"),
                F.count(F.lit(1)).alias("count")))
    return agg.select(*by, F.date_format(F.col("window.start"), "yyyy-MM-dd HH:00").alias("time_bucket"),
                      "avg_value", "min_value", "max_value", "count")


def replay(df: DataFrame, path: str, writer, chunks: int = 4, ts: str = "timestamp") -> None:
    """Deliver ``df`` to a running table of files in ``chunks`` time ranges and drain the stream after each,
    so each micro-batch is one time range of as many files as its rows make. Replays and tests only.

    The rows are computed once, partitioned by time range; the stream restarts from its checkpoint each time.
    """
    spark = df.sparkSession
    bounds = df.agg(F.min(F.unix_micros(ts)).alias("lo"), F.max(F.unix_micros(ts)).alias("hi")).first()
    if bounds["lo"] is None:                 # nothing to replay: still create the folder
        df.write.mode("append").parquet(path)
        drain(writer)
        return
    lo, hi = int(bounds["lo"]), int(bounds["hi"])
    width = max(1, (hi - lo) // chunks + 1)
    chunk = F.floor((F.unix_micros(ts) - F.lit(lo)) / F.lit(width)).cast("int")
    held = f"{path.rstrip('/')}-held"
    (df.withColumn("_chunk", chunk).repartitionByRange("_chunk", ts).write.partitionBy("_chunk").parquet(held))
    for i in range(chunks):  # a handful of sequential deliveries, one per time range
        spark.read.parquet(held).where(F.col("_chunk") == i).drop("_chunk").write.mode("append").parquet(path)
        drain(writer)
    remove_folder(spark, held)
