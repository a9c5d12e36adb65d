"""ST1, ST2: whole micro-batches — score, store, alert, cool down, notify — effectively once.

``ScoredBatches`` is a ``foreachBatch`` function: a batch's events are scored by the batch chain (P5), with the drift of each
app going on from the stored (app, count, sum).  Inside the batch the running centroids come from the block plan of W1: sums by
(app, block), a prefix over the blocks and the stored total, so an app with any share of the rows is in no single task.

``MonitoredBatches`` adds the rest: records are upserted, threshold breaches pass the cooldown (whose last fires are stored, too),
the alerts that fire are upserted and their notification payloads put into the outbox.

All of it hangs on the ledger: the batch id is entered last.  A batch that was stopped between two tables is done again from the
same states and writes the same rows (records and alerts by id, scores and outbox into the batch's own folder), and a
batch that is delivered again after its commit is skipped.

Events take part in the order of their batches, by (timestamp, id) inside a batch: a stream delivered in time order equals the batch
chain.  ``MonitoredBatches`` does not enter a batch without rows, once there are tables.  ``deduplicated`` drops events delivered again within the watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ternlens import constants as K
from ternlens.operators import alerts as AL
from ternlens.operators import drift as D
from ternlens.operators import scoring as SC
from ternlens.session import adaptive, stage, unstage
from ternlens.sources import records_io as IO
from ternlens.streaming.ledger import Ledger


def deduplicated(events: DataFrame, watermark: str = "1 hour", key: str = "id") -> DataFrame:
    """ST4: normalised events, each id once within the watermark, whichever batch brings it again."""
    return SC.normalize_events(events).withWatermark("timestamp", watermark).dropDuplicatesWithinWatermark([key])


class ScoredBatches:
    """Scores of each batch under ``root``/scores/batch=<id>.  ``after(step, batch id)`` is called after each write;
    ``prepare`` adds columns to a batch's events (learned toxicity and language, say) that ``options`` of ``evaluate`` name."""

    states: tuple[str, ...] = ("drift",)

    def __init__(self, root: str, after: Callable[[str, int], None] | None = None,
                 prepare: Callable[[DataFrame], DataFrame] | None = None, **options):
        self.prepare = prepare or (lambda events: events)
        self.root, self.options = root.rstrip("/"), options
        self.after = after or (lambda step, batch: None)

    def __call__(self, events: DataFrame, batch: int) -> None:
        ledger = Ledger(events.sparkSession, self.root)
        if ledger.done(batch):
            return
        self.take(ledger, events, batch)

    def take(self, ledger: Ledger, events: DataFrame, batch: int) -> None:
        start = ledger.state("drift", batch)
        records = stage(SC.evaluate(self.prepare(events), drift_start=start, **self.options), "scored")
        try:
            ledger.put_state("drift", batch, D.drift_state(records, start, vector="embedding_vector"))
            self.after("drift", batch)
            self.write(ledger, records, batch)
            ledger.commit(batch, self.states)
            self.after("commit", batch)
        finally:
            unstage(records)

    def write(self, ledger: Ledger, records: DataFrame, batch: int) -> None:
        records.write.mode("overwrite").parquet(f"{self.root}/scores/batch={batch}")
        self.after("scores", batch)

    def scores(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.root}/scores").drop("batch")


class MonitoredBatches(ScoredBatches):
    """The whole chain, into the tables records, alerts and outbox under ``root``."""

    states = ("drift", "cooldown")

    def __init__(self, root: str, channels: list[tuple[str, str]], thresholds: K.Thresholds = K.Thresholds(),
                 cooldown_seconds: int = K.DEFAULT_COOLDOWN_SECONDS, scope: str = "app_metric",
                 after: Callable[[str, int], None] | None = None, **options):
        super().__init__(root, after=after, **options)
        self.channels, self.thresholds, self.cooldown, self.scope = channels, thresholds, cooldown_seconds, scope

    def take(self, ledger: Ledger, events: DataFrame, batch: int) -> None:
        events = stage(events, "batch")  # a stream with state is read once
        try:
            # a batch without rows, by which the engine moves a watermark, changes no table
            if not (ledger.committed() and events.isEmpty()):
                with adaptive(events.sparkSession):
                    super().take(ledger, events, batch)
        finally:
            unstage(events)

    def write(self, ledger: Ledger, records: DataFrame, batch: int) -> None:
        spark = records.sparkSession
        IO.upsert_records(spark, records, f"{self.root}/records")
        self.after("records", batch)
        last = ledger.state("cooldown", batch)
        breaches = AL.threshold_breaches(records, self.thresholds)
        fired = stage(AL.apply_cooldown(breaches, self.cooldown, self.scope, start=last), "fired")
        try:
            IO.save_alerts(fired, f"{self.root}/alerts")
            self.after("alerts", batch)
            outbox = AL.notification_outbox(fired, self.channels)
            outbox.write.mode("overwrite").parquet(f"{self.root}/outbox/batch={batch}")
            self.after("outbox", batch)
            ledger.put_state("cooldown", batch, AL.cooldown_state(fired, last, self.scope))
            self.after("cooldown", batch)
        finally:
            unstage(fired)

    def records(self, spark: SparkSession) -> DataFrame:
        return IO.read_records(spark, f"{self.root}/records")

    def alerts(self, spark: SparkSession) -> DataFrame:
        return IO.read_alerts(spark, f"{self.root}/alerts")

    def outbox(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.root}/outbox").drop("batch")


__all__ = ["Ledger", "ScoredBatches", "MonitoredBatches", "deduplicated"]
