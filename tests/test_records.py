"""Record store: upsert, paging, time filters, JSON codec round trip."""

import datetime as dt
import uuid

from pyspark.sql import functions as F

from ternlens.operators import records as R
from ternlens.session import checkpoint_dir
from ternlens.sources import bridge
from ternlens.sources import records_io as IO


def test_upsert_replaces_whole_row(spark):
    t = dt.datetime(2024, 3, 1, 10, 0)
    first = spark.createDataFrame([("x", "app", t, 50, t), ("y", "app", t, 70, t)],
                                  "id string, app_name string, timestamp timestamp, health_score int, created_at timestamp")
    second = spark.createDataFrame([("x", "app", t, 90, t + dt.timedelta(minutes=1))], first.schema)
    path = f"{checkpoint_dir(spark)}/t-upsert-{uuid.uuid4().hex}"
    IO.save_records(first, path)
    IO.upsert_records(spark, second, path)
    got = {r.id: r.health_score for r in IO.read_records(spark, path).collect()}
    assert got == {"x": 90, "y": 70}


def test_pages_differ_and_counts(spark, sf):
    rec = bridge.records(spark, sf)
    p1 = [r.id for r in R.query_records(rec, {"app_name": "app_1"}, limit=10, offset=0).collect()]
    p2 = [r.id for r in R.query_records(rec, {"app_name": "app_1"}, limit=10, offset=10).collect()]
    assert len(p1) == 10 and len(p2) == 10 and not set(p1) & set(p2)
    n_app = R.count_records(rec, {"app_name": "app_1"}).first()[0]
    assert n_app == rec.where(F.col("app_name") == "app_1").count()


def test_time_range_filter(spark):
    now = dt.datetime(2024, 5, 10, 12, 0)
    df = spark.createDataFrame([("old", now - dt.timedelta(days=7)), ("new", now)], "id string, timestamp timestamp")
    got = [r.id for r in R.apply_filters(df, {"start_time": "2024-05-09 12:00:00"}).collect()]
    assert got == ["new"]


def test_json_codec_round_trip(spark):
    t = dt.datetime(2024, 1, 2, 3, 4, 5)
    df = spark.createDataFrame([("a", ["x", "y"], ["c1"], [0.5, 0.25], True, t)],
                               "id string, tags array<string>, flagged_claims array<string>, "
                               "embedding_vector array<double>, is_denial boolean, timestamp timestamp")
    enc = IO.encode_for_text_store(df)
    row = enc.first()
    assert row.tags == '["x","y"]' and row.is_denial == 1 and row.timestamp == "2024-01-02T03:04:05+00:00"
    back = IO.decode_from_text_store(enc).first()
    assert back.tags == ["x", "y"] and back.embedding_vector == [0.5, 0.25] and back.is_denial is True
    assert back.timestamp == t
    nulls = spark.createDataFrame([(None, "not a time")], "tags string, timestamp string")
    dec = IO.decode_from_text_store(nulls, now=F.lit(t)).first()
    assert dec.tags == [] and dec.timestamp == t


def test_next_in_order_matches_lead_across_blocks(spark):
    from pyspark.sql import Window
    from ternlens.operators.sequence import next_in_order
    rows = [(k, t, f"v{k}-{t}") for k in range(3) for t in range(0, 60, 1 + k)]
    df = spark.createDataFrame(rows, "k long, t long, v string")
    got = {(r.k, r.t): r.next_v for r in next_in_order(df, "k", "t", ["v"], block=7).collect()}
    w = Window.partitionBy("k").orderBy("t")
    want = {(r.k, r.t): r.nv for r in df.withColumn("nv", F.lead("v").over(w)).collect()}
    assert got == want


import pytest  # noqa: E402


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_upsert_partition_invariant_and_idempotent(spark, sf, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        rec = bridge.records(spark, sf).select("id", "app_name", "timestamp", "health_score", "created_at")
        again = (rec.where(F.col("id").cast("long") % 3 == 0)
                 .withColumn("health_score", F.col("health_score") + 1)
                 .withColumn("created_at", F.col("created_at") + F.expr("INTERVAL 1 HOUR")))
        path = f"{checkpoint_dir(spark)}/t-upsert-inv-{uuid.uuid4().hex}"
        IO.save_records(rec, path)
        IO.upsert_records(spark, again, path)
        first = sorted((r.id, r.health_score) for r in IO.read_records(spark, path).collect())
        IO.upsert_records(spark, again, path)          # the same delivery again changes nothing
        second = sorted((r.id, r.health_score) for r in IO.read_records(spark, path).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    base = {r.id: r.health_score for r in rec.collect()}
    want = sorted((i, h + 1 if int(i) % 3 == 0 else h) for i, h in base.items())
    assert first == want and second == want


def test_normalize_truncates_text_and_tags(spark):
    from ternlens.operators import scoring as SC
    df = spark.createDataFrame([("x" * 50, ["abcdef", "gh", "ijk"])], "response string, tags array<string>")
    out = SC.normalize_events(df, max_chars=10, max_tags=2, max_tag_chars=3).first()
    assert out.response == "x" * 10 and out.tags == ["abc", "gh"]
    assert out.app_name == "default" and out.model_name == "unknown" and out.query == "" and out.latency_ms == 0


def test_later_delivery_wins_and_first_write_is_deduplicated(spark):
    import datetime as dt
    import uuid
    from ternlens.session import checkpoint_dir

    path = f"{checkpoint_dir(spark)}/t-upsert-{uuid.uuid4().hex}"
    t = dt.datetime(2024, 1, 1)
    schema = "id string, app_name string, timestamp timestamp, health_score int, created_at timestamp"
    def rows(*parts):
        return spark.createDataFrame([(i, "x", t, h, c) for i, h, c in parts], schema)
    IO.upsert_records(spark, rows(("a", 50, t), ("a", 60, t + dt.timedelta(days=1)), ("b", 1, None)), path)
    assert {r.id: r.health_score for r in IO.read_records(spark, path).collect()} == {"a": 60, "b": 1}
    IO.upsert_records(spark, rows(("a", 90, None), ("b", 2, t - dt.timedelta(days=9))), path)
    IO.upsert_records(spark, rows(("c", 5, t)).drop("created_at"), path)
    got = {r.id: r.health_score for r in IO.read_records(spark, path).collect()}
    assert got == {"a": 90, "b": 2, "c": 5}


def test_timeline_is_ascending(spark, sf):
    from ternlens.operators import analytics as A
    from ternlens.sources import bridge

    rows = A.timeline(bridge.records(spark, sf), ["health_score"], window=50).collect()
    assert [(r.timestamp, r.id) for r in rows] == sorted((r.timestamp, r.id) for r in rows) and len(rows) == 50


def test_preview_rounds_as_python_does(spark, sf):
    from pyspark.sql import functions as F
    from ternlens.operators import records as R
    from ternlens.sources import bridge

    one = bridge.records(spark, sf).limit(1)
    for value in (0.0625, 0.1875, 0.0005, 0.12345):
        got = R.preview(one.withColumn("hallucination_score", F.lit(value))).first()
        assert got.score_text == f"{value:.3f}"


def test_malformed_webhook_is_invalid(spark):
    from pyspark.sql import functions as F
    from ternlens.operators import alerts as AL

    urls = [("https://hooks.slack.com/x", True), ("https://exa mple.com/%%", False), ("http://hooks.slack.com/x", False), (None, False)]
    df = spark.createDataFrame(urls, "u string, ok boolean")
    assert all(r.got == r.ok for r in df.withColumn("got", AL.valid_webhook(F.col("u"))).collect())


def test_events_are_whole_but_for_parity(spark):
    from ternlens import constants as K
    from ternlens.operators import scoring as SC
    long = "word " * 40_001 + "end"  # over 200 000 characters
    df = spark.createDataFrame([("a", long, long, long, ["t" * 120] * 60)],
                               "id string, query string, context string, response string, tags array<string>")
    off = K.ModuleFlags(drift=False, rag=False, hallucination=False)
    whole = SC.evaluate(df, off).first()
    assert whole.query == whole.context == whole.response == long and whole.tags == ["t" * 120] * 60
    assert whole.response_length == 40_002
    cut = SC.evaluate(df, off, limits=K.PARITY_LIMITS).first()
    assert cut.query == cut.context == cut.response == long[:200_000] and cut.tags == ["t" * 100] * 50


def test_moved_ids_leave_their_old_partitions(spark):
    t = dt.datetime(2024, 3, 1, 10, 0)
    schema = "id string, app_name string, timestamp timestamp, health_score int"
    path = f"{checkpoint_dir(spark)}/t-moved-{uuid.uuid4().hex}"
    IO.save_records(spark.createDataFrame([(f"i{k}", f"app {k % 2}/x", t + dt.timedelta(days=k % 3), k) for k in range(12)], schema), path)
    # all of one partition and a few of others move to another app and date
    gone = [r.id for r in IO.read_records(spark, path).where("app_name = 'app 0/x' AND event_date = '2024-03-01'").collect()]
    assert len(gone) == 2
    move = spark.createDataFrame([(i, "elsewhere", t + dt.timedelta(days=9), 100) for i in [*gone, "i1", "i5"]], schema)
    for _ in range(2):  # the same delivery again changes nothing
        IO.upsert_records(spark, move, path)
        got = {r.id: (r.app_name, r.health_score) for r in IO.read_records(spark, path).collect()}
        assert IO.read_records(spark, path).count() == len(got) == 12
        assert all(got[i] == ("elsewhere", 100) for i in [*gone, "i1", "i5"])
    dates = {(r.app_name, str(r.event_date)) for r in IO.read_records(spark, path).select("app_name", "event_date").distinct().collect()}
    assert ("app 0/x", "2024-03-01") not in dates and ("elsewhere", "2024-03-10") in dates
    IO.upsert_records(spark, spark.createDataFrame([("i1", "app 1/x", t, 5)], schema), path)  # and back
    assert IO.read_records(spark, path).count() == 12
    before = sorted(map(tuple, IO.locations(spark, path, IO.read_records(spark, path)).collect()))
    IO.compact_index(spark, path)
    assert sorted(map(tuple, IO.locations(spark, path, IO.read_records(spark, path)).collect())) == before
    assert spark.read.parquet(IO.index_path(path)).count() == 12


def test_table_without_an_index_gets_one(spark):
    t = dt.datetime(2024, 3, 1, 10, 0)
    schema = "id string, app_name string, timestamp timestamp, health_score int, created_at timestamp, event_date date"
    path = f"{checkpoint_dir(spark)}/t-noindex-{uuid.uuid4().hex}"
    spark.createDataFrame([("a", "x", t, 1, t, t.date()), ("b", "x", t, 2, t, t.date())], schema).write.partitionBy("app_name", "event_date").parquet(path)
    IO.upsert_records(spark, spark.createDataFrame([("a", "y", t, 9)], "id string, app_name string, timestamp timestamp, health_score int"), path)
    assert sorted((r.id, r.app_name, r.health_score) for r in IO.read_records(spark, path).collect()) == [("a", "y", 9), ("b", "x", 2)]


def test_hot_partition_is_written_by_its_size(spark):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        rows = spark.range(0, 40_000, 1, 16).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 20 == 0, "cold").otherwise("hot").alias("app_name"),
                                          F.lit("2024-01-01").cast("timestamp").alias("timestamp"), F.sha2(F.col("id").cast("string"), 256).alias("response"))
        path = f"{checkpoint_dir(spark)}/t-hot-{uuid.uuid4().hex}"
        IO.save_records(rows, path)
        files = [f for f in IO.read_records(spark, path).inputFiles()]
        assert sum("hot" in f for f in files) > 8 and sum("cold" in f for f in files) <= 4
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_csv_export_reads_back_quotes_line_ends_and_blanks(spark, tmp_path):
    from ternlens import constants as K
    from ternlens.schemas import RECORD_SCHEMA
    from ternlens.sources import bridge
    from ternlens.sources.records_io import export_csv, read_csv_export
    rec = bridge.records(spark, "/root/testdata/sf0.001").limit(4).withColumn(
        "response", F.expr("element_at(array('a \"quoted\", text', 'two\\nlines', '', cast(null as string)), cast(row_number() over (order by id) as int))"))
    rec = rec.withColumn("query", F.lit('\\ back"slash\\')).select(*[f.name for f in RECORD_SCHEMA.fields if f.name in rec.columns])
    rows = rec.select(*K.CSV_EXPORT_COLUMNS).collect()
    export_csv(spark.createDataFrame(rows, rec.select(*K.CSV_EXPORT_COLUMNS).schema), str(tmp_path / "csv"))
    assert sorted(read_csv_export(spark, str(tmp_path / "csv")).collect(), key=lambda r: r.id) == sorted(rows, key=lambda r: r.id)
