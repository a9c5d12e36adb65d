"""What a task's Python holds doesn't grow with its batch, partition, key or delivery."""

import datetime as dt

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ternlens.functions import vectors as V
from ternlens.operators import alerts as AL
from ternlens.operators import drift as D
from ternlens.operators import models as M
from ternlens.operators import scoring as SC
from ternlens.sources import records_io as IO
from ternlens.streaming import stream as ST

T0 = dt.datetime(2024, 1, 1)


def test_embedding_stage_hands_on_few_rows_at_a_time():
    n, sentences = 3000, 20
    text = pa.array(["one two three"] * n)
    batch = (text, text, text, pa.array([True] * n), pa.array([["a sentence of words"] * sentences] * n))
    sizes = [len(x) for x in SC._embed_struct(8).func(iter([batch]))]
    assert sum(sizes) == n and max(sizes) * (6 + sentences) < SC.HELD_VECTORS + 6 + sentences


@pytest.mark.parametrize("column, batch", [(V.embed, pa.array(["a b", None] * 1000)), (V.embed_many, pa.array([["a b"], None] * 1000))])
def test_embeddings_hand_on_few_rows_at_a_time(spark, monkeypatch, column, batch):
    made = []
    monkeypatch.setattr(V.F, "arrow_udf", lambda kind: lambda f: made.append(f) or (lambda c: c))
    column(F.lit("x"))
    sizes = [len(x) for x in made[0](iter([batch]))]
    assert sum(sizes) == 2000 and max(sizes) <= V.SLICE_ROWS


def test_embedding_columns_are_those_of_the_texts(spark):
    df = spark.createDataFrame([("a b", ["a", "b c"]), (None, None), ("", [])], "t string, s array<string>").coalesce(1)
    got = df.select(V.embed("t", 4).alias("v"), V.embed_many("s", 4).alias("m")).collect()
    assert got[0].v == pytest.approx(V.embed_text("a b", 4, {}).tolist()) and [len(x) for x in got[0].m] == [4, 4]
    assert (got[1].v, got[1].m, got[2].v, got[2].m) == (None, None, [0.0] * 4, [])


def test_model_scores_hand_on_few_rows_at_a_time(spark, monkeypatch):
    made = []
    monkeypatch.setattr(M.F, "arrow_udf", lambda kind: lambda f: made.append(f) or (lambda c: F.lit(0.0)))
    M.with_toxicity(spark.createDataFrame([("x",)], "text string"), spark.createDataFrame([(1, 0.5)], "bucket long, weight double"))
    profile = pa.table({"lang": ["en"], "gram": ["abc"], "log_count": [1.0], "unseen": [-2.0], "log_prior": [0.0]})
    M._language_udf(profile)
    for f in made:
        sizes = [len(x) for x in f(iter([pa.array(["abc", None] * 1000)]))]
        assert sum(sizes) == 2000 and max(sizes) <= V.SLICE_ROWS


def test_blocks_of_drift_are_bounded_and_change_nothing(spark, monkeypatch):
    rows = [(f"a{i % 2}", T0 + dt.timedelta(seconds=i), f"{i:03}", [float(i % 7), 1.0, float(i % 3)]) for i in range(100)]
    df = spark.createDataFrame(rows, "app_name string, timestamp timestamp, id string, vector array<double>")
    for cap in (None, 25):
        want = {r.id: r.drift_score for r in D.online_drift(df, cap=cap).collect()}
        sizes, stage = [], D.stage

        def recorded(t, name):
            t = stage(t, name)
            if name == "drift-rows":
                sizes.extend(r["count"] for r in t.groupBy("_key", "_block").count().collect())
            return t
        with monkeypatch.context() as m:
            m.setattr(D, "stage", recorded)
            m.setattr(D, "BLOCK_BITS", 3, raising=False)
            got = {r.id: r.drift_score for r in D.online_drift(df, cap=cap).collect()}
        assert max(sizes) <= 8 and got == want


def test_parts_of_the_cooldown_are_bounded_and_change_nothing(spark, monkeypatch):
    rows = [(f"r{i:03}", f"a{i % 2}", T0 + dt.timedelta(seconds=(i // 3) * 37)) for i in range(150)]
    alerts = spark.createDataFrame(rows, "record_id string, app_name string, timestamp timestamp").withColumn("metric", F.lit("m"))
    last, want = {}, set()
    for rid, app, ts in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        if app not in last or (ts - last[app]).total_seconds() >= 300:
            last[app] = ts
            want.add(rid)
    sizes, stage = [], AL.stage

    def recorded(t, name):
        t = stage(t, name)
        sizes.extend(r["count"] for r in t.groupBy("_part").count().collect())
        return t
    monkeypatch.setattr(AL, "stage", recorded)
    monkeypatch.setattr(AL, "PART_BITS", 2, raising=False)
    for parts in (1, 3):
        assert {r.record_id for r in AL.apply_cooldown(alerts, 300, parts=parts).collect()} == want
    assert max(sizes) <= 4


class _List:
    """A list state that gives one row after the other, and counts the rows given to it at once."""

    def __init__(self):
        self.rows, self.most = [], 0

    def get(self):
        return iter(list(self.rows))

    def appendList(self, rows):
        self.most = max(self.most, len(rows))
        self.rows += rows

    put = clear = None


class _Value:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


class _Handle:
    def __init__(self):
        self.lists, self.values, self.timers = {}, {}, set()

    def getListState(self, name, schema):
        x = self.lists[name] = _List()
        x.clear = x.rows.clear
        return x

    def getValueState(self, name, schema):
        return self.values.setdefault(name, _Value())

    def listTimers(self):
        return iter(self.timers)

    def deleteTimer(self, t):
        self.timers.discard(t)

    def registerTimer(self, t):
        self.timers.add(t)


class _Clock:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = lambda: ms


def test_pending_breaches_are_written_few_at_a_time_and_fire_as_in_sequence():
    n = 5 * 1000 + 7
    rows = [((i * 7919) % n * 1_000_000, f"r{i:05}") for i in range(n)]
    rows += [(ts, rid + "x") for ts, rid in rows[:50]]
    schema = T.StructType([T.StructField("_ts", T.LongType()), T.StructField("record_id", T.StringType())])
    step, handle = ST._Cooldown(300_000_000, schema), _Handle()
    step.init(handle)
    list(step.handleInputRows(("a",), iter(rows), None))
    fired = []
    for ms in (2_000_000, 2_500_000, 10_000_000):           # the rest stays, and has a timer
        assert any(t > ms or ms == 10_000_000 for t in handle.timers) or min(handle.timers) <= ms
        fired += [(r["_ts"], r["record_id"]) for r in step.handleExpiredTimer(("a",), _Clock(ms), None)]
        assert ms == 10_000_000 or any(t > ms for t in handle.timers)
    want, last = [], None
    for ts, rid in sorted(rows):
        if last is None or ts - last >= 300_000_000:
            want.append((ts, rid))
            last = ts
    assert fired == want
    assert max(x.most for x in handle.lists.values()) <= 1000


def test_a_delivery_of_different_ids_is_staged_once_and_not_dealt(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "id string, created_at int")
    staged = []

    def put(df):
        staged.append(df)
        return df
    assert IO._once(rows, "id", put) is rows and "created_at" not in staged[-1].columns
    twice = rows.union(spark.createDataFrame([("a", 5), (None, 2)], "id string, created_at int"))
    assert sorted((r.id or "", r.created_at) for r in IO._once(twice, "id", put).collect()) == [("", 3), ("a", 5), ("b", 2)]


def test_upsert_moves_only_the_keys_of_incoming_rows(spark):
    old = spark.createDataFrame([("a", 1, "old"), ("b", 1, "old"), ("b", 2, "new"), (None, 1, "old")], "id string, created_at int, v string")
    new = spark.createDataFrame([("a", 0, "in"), (None, 0, "in")], "id string, created_at int, v string")
    got = sorted((r.id or "", r.v) for r in IO.upsert_frames(old, new).collect())
    assert got == [("", "in"), ("a", "in"), ("b", "new")]
    plan = IO.upsert_frames(old, new)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan


class _Map:
    """A map state that counts what is read of it."""

    def __init__(self):
        self.rows, self.read = {}, 0

    def values(self):
        for v in list(self.rows.values()):
            self.read += 1
            yield v

    def updateValue(self, key, value):
        self.rows[key] = value

    def clear(self):
        self.rows.clear()


class _MapHandle(_Handle):
    def __init__(self):
        super().__init__()
        self.maps = {}

    def getMapState(self, name, key, value):
        return self.maps.setdefault(name, _Map())

    def getValueState(self, name, schema):
        x = super().getValueState(name, schema)
        x.clear = lambda: setattr(x, "value", None)
        return x


def test_packs_are_appended_unread_and_fire_as_in_sequence(monkeypatch):
    monkeypatch.setattr(ST, "HELD_ROWS", 7)
    monkeypatch.setattr(ST, "DEALT_ROWS", 100)
    n = 500
    rows = [{"app_name": [None, "a", ""][i % 3], "_ts": (i * 79) % n * 1_000_000, "record_id": f"r{i:03}"} for i in range(n)]
    schema = T.StructType([T.StructField("record_id", T.StringType()), T.StructField("_ts", T.LongType()), T.StructField("app_name", T.StringType())])
    batches = [pa.RecordBatch.from_pylist(rows[k:k + 30]) for k in range(0, n, 30)]
    packs = [r for b in ST._packed(schema, ["app_name"])(iter(batches)) for r in b.to_pylist()]
    held = ST._Packing(schema)
    for r in packs:
        got = held.unpack(r["rows"]).to_pylist()
        assert len(got) <= 7 and {x["app_name"] for x in got} == {r["app_name"]} and len(r["instants"]) == 8 * len(got)
        assert r["_event"].timestamp() == max(x["_ts"] for x in got) / 1e6
    assert len(packs) < 120 and sum(len(r["instants"]) for r in packs) == 8 * n
    for app in (None, "a", ""):
        step, handle = ST._PackedCooldown(30_000_000, schema), _MapHandle()
        step.init(handle)
        for r in packs:
            if r["app_name"] == app:
                list(step.handleInputRows((app,), iter([r]), None))
        assert not any(m.read for m in handle.maps.values())
        fired = []
        for ms in (200_000, 250_500, 10_000_000):
            fired += [(r["_ts"], r["record_id"], r["app_name"]) for r in step.handleExpiredTimer((app,), _Clock(ms), None)]
        want = []
        for r in sorted((r for r in rows if r["app_name"] == app), key=lambda r: r["_ts"]):
            if not want or r["_ts"] - want[-1][0] >= 30_000_000:
                want.append((r["_ts"], r["record_id"], app))
        assert fired == want and not any(m.rows for m in handle.maps.values())


def test_a_breach_without_a_timestamp_is_an_error():
    schema = T.StructType([T.StructField("record_id", T.StringType()), T.StructField("_ts", T.LongType())])
    with pytest.raises(ValueError, match="timestamp"):
        list(ST._packed(schema, [])(iter([pa.RecordBatch.from_pylist([{"record_id": "a", "_ts": None}], schema=ST._Packing(schema).arrow)])))
