"""Streaming chain equals the batch chain; stopped and repeated micro-batches; event-time cooldown under disorder."""

import datetime as dt
import random
import uuid

import pytest
from pyspark.sql import functions as F

from ternlens.operators import alerts as AL
from ternlens.operators import scoring as SC
from ternlens.session import checkpoint_dir
from ternlens.sources import bridge
from ternlens.sources import records_io as IO
from ternlens.streaming import stream as ST
from ternlens.streaming.chain import Ledger, MonitoredBatches, ScoredBatches, deduplicated

COLS = ["id", "hallucination_score", "drift_score", "groundedness_score", "health_score"]
CHANNELS = [("email", "a@example.org"), ("slack", "https://hooks.slack.com/x")]


def _base(spark, tag):
    return f"{checkpoint_dir(spark)}/t-{tag}-{uuid.uuid4().hex}"


def _rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_stream_equals_batch(spark, sf):
    ev = bridge.chat_events(spark, sf)
    base = _base(spark, "stream")
    ST.create_source(spark, f"{base}/src", ev.schema)
    batches = ScoredBatches(f"{base}/scored")
    ST.replay(ev, f"{base}/src", ST.event_stream(spark, f"{base}/src", ev.schema).writeStream
              .option("checkpointLocation", f"{base}/chk").foreachBatch(batches), chunks=3)
    assert _rows(batches.scores(spark), *COLS) == _rows(SC.evaluate(ev), *COLS)


def _one_app(spark, n=90):
    """Calls of one app in three batches, by time."""
    t0 = dt.datetime(2024, 1, 1)
    words = ["rates", "loans", "cards", "limits", "fees", "deposits", "weather"]
    rows = [(f"c{k:03d}", "app", t0 + dt.timedelta(minutes=20 * k), f"question about {words[k % 7]}", "the fees and rates of cards",
             f"answer {words[k % 5]} and {words[(k * k) % 7]} for {words[k % 3]}") for k in range(n)]
    schema = "id string, app_name string, timestamp timestamp, query string, context string, response string"
    return [spark.createDataFrame(rows[k:k + n // 3], schema) for k in range(0, n, n // 3)]


def _tables(spark, chain):
    return (_rows(chain.records(spark), *COLS), _rows(chain.alerts(spark), "id", "record_id", "metric", "value", "timestamp"),
            _rows(chain.outbox(spark), "alert_id", "channel", "payload"))


@pytest.fixture(scope="module")
def undisturbed(spark):
    chain = MonitoredBatches(_base(spark, "chain"), CHANNELS, cooldown_seconds=3600)
    for k, batch in enumerate(_one_app(spark)):
        chain(batch, k)
    return _tables(spark, chain)


def test_chain_of_batches_equals_batch(spark, undisturbed):
    a, b, c = _one_app(spark)
    whole = SC.evaluate(a.union(b).union(c))
    fired = AL.apply_cooldown(AL.threshold_breaches(whole), 3600)
    assert undisturbed[0] == _rows(whole, *COLS)
    assert undisturbed[1] == _rows(fired, "id", "record_id", "metric", "value", "timestamp") and len(undisturbed[1]) > 3
    assert undisturbed[2] == _rows(AL.notification_outbox(fired, CHANNELS), "alert_id", "channel", "payload")


@pytest.mark.parametrize("step", ["drift", "alerts", "cooldown"])
def test_stopped_batch_is_made_whole_by_its_next_delivery(spark, undisturbed, step):
    stopped = []

    def stop(done, batch):
        if done == step and batch == 1 and not stopped:
            stopped.append(step)
            raise RuntimeError("executor lost")
    chain = MonitoredBatches(_base(spark, "chain"), CHANNELS, cooldown_seconds=3600, after=stop)
    for k, batch in enumerate(_one_app(spark)):
        try:
            chain(batch, k)
        except RuntimeError:
            chain(batch, k)  # the engine gives the batch again
        chain(batch, k)  # and once more after its commit: skipped
    assert stopped and _tables(spark, chain) == undisturbed
    assert Ledger(spark, chain.root).committed() == [1, 2]


def test_events_delivered_again_are_dropped(spark):
    batches = _one_app(spark, 30)
    base = _base(spark, "dedup")
    ST.create_source(spark, f"{base}/src", batches[0].schema)
    scored = ScoredBatches(f"{base}/scored")
    w = (deduplicated(ST.event_stream(spark, f"{base}/src", batches[0].schema), "10 days").writeStream
         .option("checkpointLocation", f"{base}/chk").foreachBatch(scored))
    for delivery in (batches[0].union(batches[0]), batches[1].union(batches[0]), batches[2], batches[1]):
        delivery.write.mode("append").parquet(f"{base}/src")
        ST.drain(w)
    whole = SC.evaluate(batches[0].union(batches[1]).union(batches[2]))
    assert _rows(scored.scores(spark), *COLS) == _rows(whole, *COLS)


def test_upsert_sink_skips_committed_batches_and_takes_scored_records(spark):
    path = _base(spark, "sink")
    rec = SC.evaluate(_one_app(spark, 30)[0])
    sink = ST.upsert_sink(path)
    sink(rec, 0)
    sink(rec.withColumn("health_score", F.lit(-1)), 0)  # batch 0 again: skipped
    assert _rows(IO.read_records(spark, path), *COLS) == _rows(rec, *COLS)
    sink(rec.withColumn("health_score", F.lit(7)), 1)
    assert {r.health_score for r in IO.read_records(spark, path).collect()} == {7}


def test_cooldown_of_shuffled_and_repeated_deliveries(spark):
    t0, rng = dt.datetime(2024, 1, 1), random.Random(3)
    schema = "id string, record_id string, app_name string, metric string, value double, timestamp timestamp"
    rows = [(f"a{k}", f"r{k:03d}", "x" if k % 3 else "y", "m", 0.5, t0 + dt.timedelta(seconds=(k // 2) * 61)) for k in range(160)]
    want = _rows(AL.apply_cooldown(spark.createDataFrame(rows, schema), 300), "record_id", "metric", "timestamp")
    rng.shuffle(rows)
    base = _base(spark, "cool")
    ST.create_source(spark, f"{base}/src", spark.createDataFrame([], schema).schema)
    fired = ST.stateful_cooldown(ST.event_stream(spark, f"{base}/src", spark.createDataFrame([], schema).schema), 300, watermark="3 hours")
    w = (fired.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/chk").outputMode("append"))
    end = [("e", "e", "z", "m", 0.5, t0 + dt.timedelta(days=2))]
    for delivery in (rows[:70], rows[50:120], rows[120:] + rows[:10], end, end):
        spark.createDataFrame(delivery, schema).coalesce(1).write.mode("append").parquet(f"{base}/src")
        ST.drain(w)
    assert _rows(spark.read.parquet(f"{base}/out"), "record_id", "metric", "timestamp") == want


def test_windowed_series_drops_rows_behind_watermark(spark):
    base = f"{checkpoint_dir(spark)}/t-wm-{uuid.uuid4().hex}"
    t0 = dt.datetime(2024, 1, 1, 0, 0)
    schema = "id string, app_name string, timestamp timestamp, health_score int"
    first = spark.createDataFrame([("a", "x", t0, 80), ("b", "x", t0 + dt.timedelta(hours=3), 60)], schema)
    late = spark.createDataFrame([("c", "x", t0 + dt.timedelta(minutes=5), 10)], schema)   # 3 h behind
    first.coalesce(1).write.parquet(f"{base}/src")
    stream = ST.event_stream(spark, f"{base}/src", first.schema)
    agg = ST.windowed_time_series(stream, window="1 hour", watermark="10 minutes")
    q = (agg.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out")
         .option("checkpointLocation", f"{base}/chk").trigger(availableNow=True).start())
    q.awaitTermination()
    late.coalesce(1).write.mode("append").parquet(f"{base}/src")
    q = (agg.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out")
         .option("checkpointLocation", f"{base}/chk").trigger(availableNow=True).start())
    q.awaitTermination()
    out = spark.read.parquet(f"{base}/out").where(F.col("time_bucket") == "2024-01-01 00:00").collect()
    # the 00:00 window closed with the first batch (watermark 02:50); the late row is dropped
    assert len(out) == 1 and out[0]["count"] == 1 and out[0]["avg_value"] == 80.0


def test_batches_of_a_stream_with_state_write_few_files_and_none_without_rows(spark):
    """In the session of such a stream, writes were not dealt by size; a batch that only moves the watermark went through the chain."""
    batches, base = _one_app(spark, 60), _base(spark, "files")
    ST.create_source(spark, f"{base}/src", batches[0].schema)
    steps = []
    chain = MonitoredBatches(f"{base}/tables", CHANNELS, cooldown_seconds=3600, after=lambda step, batch: steps.append((step, batch)))
    w = (deduplicated(ST.event_stream(spark, f"{base}/src", batches[0].schema), "10 days").writeStream
         .option("checkpointLocation", f"{base}/chk").foreachBatch(chain))
    for delivery in (batches[0].union(batches[1]).union(batches[2]), batches[1]):
        delivery.write.mode("append").parquet(f"{base}/src")
        ST.drain(w)
    rec = chain.records(spark)
    assert rec.count() == 60 and len(rec.inputFiles()) == rec.select("app_name", "event_date").distinct().count()
    assert len({batch for _, batch in steps}) == 1
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_cooldown_hands_packs_of_breaches_to_its_keys(spark):
    """Every breach was one row of state, of one list a key, which each further row read again."""
    t0, n = dt.datetime(2024, 1, 1), 6000
    schema = ("id string, record_id string, app_name string, metric string, value double, tags array<string>, props map<string,int>, "
              "seen timestamp, timestamp timestamp")
    rows = [(f"a{k}", f"r{k:05d}", [None, "x", "y"][k % 3], "m", 0.5, ["t", None], {"k": k}, t0 if k % 2 else None,
             t0 + dt.timedelta(seconds=(k * 7919) % n, microseconds=k % 5)) for k in range(n)]
    df = spark.createDataFrame(rows, schema)
    base = _base(spark, "packs")
    ST.create_source(spark, f"{base}/src", df.schema)
    fired = ST.stateful_cooldown(ST.event_stream(spark, f"{base}/src", df.schema), 300, "metric", watermark="3 hours")
    w = (fired.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/chk").outputMode("append"))
    late = [("e", "e", "z", "m", 0.5, None, None, None, t0 + dt.timedelta(days=2))]
    early = [("b", "b", "x", "m", 0.5, None, None, None, t0 - dt.timedelta(hours=1))]  # behind the watermark
    updated, dropped = 0, 0
    for delivery in (df.union(df.where("id > 'a3'")), spark.createDataFrame(late, schema), spark.createDataFrame(early + late, schema)):
        delivery.coalesce(1).write.mode("append").parquet(f"{base}/src")
        for p in ST.drain(w).recentProgress:
            cooldown, repeats = p["stateOperators"]
            updated += cooldown["numRowsUpdated"]
            dropped += repeats["numRowsDroppedByWatermark"]
    cols = ["id", "record_id", "app_name", "metric", "tags", "props", "seen", "timestamp"]
    assert _rows(spark.read.parquet(f"{base}/out"), *cols) == _rows(AL.apply_cooldown(df, 300, "metric"), *cols)
    assert updated < n / 10 and dropped == 1
