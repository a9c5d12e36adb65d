"""Queries for sources/sinks, streaming and plug-ins: S5–S8, ST1–ST6, J3, U1, U2, U4."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ternlens import constants as K
from ternlens.operators import alerts as AL
from ternlens.operators import plugins as PL
from ternlens.operators import regression as RG
from ternlens.operators import scoring as SC
from ternlens.plans.catalog import r9, register
from ternlens.plans.q_alerts import _ALERT_COLS, _BREACHES, _CHANNELS, _cooldown_sql
from ternlens.plans.q_models import text_model_columns, text_models
from ternlens.plans.q_records import _ts_sql
from ternlens.plans.q_scoring import _SCORED_COLS, scored_sql
from ternlens.plans.sqlviews import V_EVT, V_GOLD, V_REC, with_views
from ternlens.session import checkpoint_dir, stage, unstage
from ternlens.sources import bridge
from ternlens.sources import records_io as IO
from ternlens.sources.tables import table
from ternlens.streaming import stream as ST
from ternlens.streaming.chain import MonitoredBatches, ScoredBatches, deduplicated


def _scratch(spark, tag: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- S5 / S6 / S7 / S8
@register("record_table_partition_read", ops="S5 (append, partitioned by app/date; pruned read)",
          sql=with_views(V_REC) + """
SELECT id, app_name, health_score, CAST("timestamp" AS DATE) AS event_date FROM v_rec
WHERE app_name = 'app_1' AND CAST("timestamp" AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-12'""")
def record_table_partition_read(spark, sf):
    path = _scratch(spark, "records")
    IO.save_records(bridge.records(spark, sf), path)
    rec = IO.read_records(spark, path)
    return (rec.where((F.col("app_name") == "app_1") & F.col("event_date").between("2024-01-05", "2024-01-12"))
            .select("id", "app_name", "health_score", "event_date"))


_REDELIVER = "(CAST(id AS BIGINT) % 3 = 0)"


@register("record_upsert", ops="S6 (second delivery of a third of the ids replaces them)", sql=with_views(V_REC) + f"""
SELECT id, app_name, CASE WHEN {_REDELIVER} THEN least(health_score + 7, 100) ELSE health_score END AS health_score
FROM v_rec""")
def record_upsert(spark, sf):
    rec = bridge.records(spark, sf).select("id", "app_name", "timestamp", "health_score", "created_at")
    again = (rec.where(F.col("id").cast("long") % 3 == 0)
             .withColumn("health_score", F.least(F.col("health_score") + 7, F.lit(100)))
             .withColumn("created_at", F.col("created_at") + F.expr("INTERVAL 1 DAY")))
    path = _scratch(spark, "upsert")
    IO.save_records(rec, path)
    IO.upsert_records(spark, again, path)
    return IO.read_records(spark, path).select("id", "app_name", "health_score")


@register("record_upsert_moved_ids", ops="S6 (second delivery moves a third of the ids to another date and app: one row per id)",
          sql=with_views(V_REC) + f"""
SELECT id, CASE WHEN {_REDELIVER} THEN 'app_moved' ELSE app_name END AS app_name,
       CASE WHEN {_REDELIVER} THEN "timestamp" + INTERVAL 400 DAY ELSE "timestamp" END AS "timestamp", health_score
FROM v_rec""")
def record_upsert_moved_ids(spark, sf):
    rec = bridge.records(spark, sf).select("id", "app_name", "timestamp", "health_score", "created_at")
    moved = (rec.where(F.col("id").cast("long") % 3 == 0)
             .withColumns({"app_name": F.lit("app_moved"), "timestamp": F.col("timestamp") + F.expr("INTERVAL 400 DAYS")}))
    path = _scratch(spark, "upsert")
    IO.save_records(rec, path)
    IO.upsert_records(spark, moved, path)
    return IO.read_records(spark, path).select("id", "app_name", "timestamp", "health_score")


@register("json_text_codec", ops="S7 (arrays/booleans/timestamps through JSON text and back)",
          sql=with_views(V_REC) + """
SELECT r.id, [e.event_type, 'u' || CAST(e.user_id AS VARCHAR)] AS tags, r.is_denial, r."timestamp",
       CAST(json_extract(e.props, '$.k') AS INTEGER) AS k
FROM v_rec r JOIN events e ON r.id = CAST(e.event_id AS VARCHAR)""")
def json_text_codec(spark, sf):
    ev = table(spark, sf, "events")
    rec = bridge.records(spark, sf).join(
        ev.select(F.col("event_id").cast("string").alias("id"), "event_type", "user_id", "props"), "id")
    rec = rec.withColumn("tags", F.array(F.col("event_type"), F.concat(F.lit("u"), F.col("user_id").cast("string"))))
    text_rows = IO.encode_for_text_store(rec.select("id", "tags", "is_denial", "timestamp", "props"))
    back = IO.decode_from_text_store(text_rows)
    return back.select("id", "tags", "is_denial", "timestamp",
                       F.get_json_object("props", "$.k").cast("int").alias("k"))


@register("csv_export_file", ops="S9 (the CSV file, read back)", sql=with_views(V_REC) + f"""
SELECT {", ".join('"timestamp"' if c == "timestamp" else c for c in K.CSV_EXPORT_COLUMNS)}
FROM v_rec ORDER BY "timestamp" DESC, id DESC LIMIT {K.CSV_EXPORT_ROWS}""")
def csv_export_file(spark, sf):
    path = _scratch(spark, "csv")
    IO.export_csv(bridge.records(spark, sf), path)
    return IO.read_csv_export(spark, path)


@register("alert_store_dedup", ops="S8 (alerts written twice, read once per id)",
          sql=with_views(V_REC, _BREACHES) + "SELECT id, metric, record_id, severity FROM v_alert")
def alert_store_dedup(spark, sf):
    a = AL.threshold_breaches(bridge.records(spark, sf))
    path = _scratch(spark, "alerts")
    IO.save_alerts(a, path)
    IO.save_alerts(a, path)
    return IO.read_alerts(spark, path).select("id", "metric", "record_id", "severity")


# ---------------------------------------------------------------- streaming
@register("stream_scored_chat_records", ops="ST1 ST2 ST5 (stream in time order = batch evaluate)",
          sql=with_views(V_EVT, scored_sql(models=True)) + f"SELECT {', '.join(_SCORED_COLS)} FROM scored")
def stream_scored_chat_records(spark, sf):
    ev = bridge.chat_events(spark, sf)
    src, chk = _scratch(spark, "st-src"), _scratch(spark, "st-chk")
    batches = ScoredBatches(_scratch(spark, "st-scored"), prepare=text_models(spark, sf), **text_model_columns())
    ST.create_source(spark, src, ev.schema)
    w = ST.event_stream(spark, src, ev.schema).writeStream.option("checkpointLocation", chk).foreachBatch(batches)
    ST.replay(ev, src, w, chunks=4)
    return batches.scores(spark).select(*_SCORED_COLS)


def _monitored(spark, sf):
    """The whole chain on the chat events, the first half delivered twice in one file and the second half twice in two."""
    ev = bridge.chat_events(spark, sf)
    src, chk = _scratch(spark, "st-src"), _scratch(spark, "st-chk")
    batches = MonitoredBatches(_scratch(spark, "st-monitor"), _CHANNELS, cooldown_seconds=10800,
                               prepare=text_models(spark, sf), **text_model_columns())
    ST.create_source(spark, src, ev.schema)
    stream = deduplicated(ST.event_stream(spark, src, ev.schema), "20 days")
    w = stream.writeStream.option("checkpointLocation", chk).foreachBatch(batches)
    ev = stage(ev, "events")
    half = ev.agg(F.percentile_approx(F.unix_micros("timestamp"), 0.5).alias("t"))  # one row
    first = ev.join(F.broadcast(half), F.unix_micros("timestamp") <= F.col("t")).drop("t")
    second = ev.join(F.broadcast(half), F.unix_micros("timestamp") > F.col("t")).drop("t")
    for delivery in (first.union(first), second, second):
        delivery.select(*ev.columns).write.mode("append").parquet(src)
        ST.drain(w)
    unstage(ev)
    return batches


_SCORED_REC = "v_rec AS (SELECT * FROM scored)"


@register("stream_monitored_alerts", ops="ST1 ST2 ST4 (micro-batches: evaluate, upsert, alert, cooldown; repeated deliveries = batch)",
          sql=with_views(V_EVT, scored_sql(models=True), _SCORED_REC, _BREACHES, _cooldown_sql(10800, "app_name || '|' || metric"))
          + """
SELECT a.id, a.record_id, a.metric, a.severity, a.value, a.threshold, a.message, a."timestamp",
       r.app_name, r.health_score FROM v_fired a JOIN v_rec r ON r.id = a.record_id""")
def stream_monitored_alerts(spark, sf):
    batches = _monitored(spark, sf)
    rec = batches.records(spark).select(F.col("id").alias("record_id"), "app_name", "health_score")
    return batches.alerts(spark).join(rec, "record_id").select(
        "id", "record_id", "metric", "severity", "value", "threshold", "message", "timestamp", "app_name", "health_score")


@register("stream_monitored_outbox", ops="ST1 A5 (outbox of the micro-batches = batch outbox)",
          sql=with_views(V_EVT, scored_sql(models=True), _SCORED_REC, _BREACHES, _cooldown_sql(10800, "app_name || '|' || metric")) + """
SELECT a.id AS alert_id, ch.channel, ch.target, coalesce(ch.channel = 'email' OR ch.target LIKE 'https:%', false) AS valid
FROM v_fired a, (VALUES ('email', 'oncall@example.org'), ('slack', 'https://hooks.slack.com/services/T000/B000/XXXX'),
                        ('slack', 'http://hooks.slack.com/services/T000/B000/YYYY')) ch(channel, target)""")
def stream_monitored_outbox(spark, sf):
    return _monitored(spark, sf).outbox(spark).select("alert_id", "channel", "target", "valid")


@register("stream_alert_cooldown", ops="ST3 (event-time cooldown; deliveries out of order and repeated = batch W3)",
          sql=with_views(V_REC, _BREACHES, _cooldown_sql(10800, "app_name || '|' || metric"))
          + f'SELECT {_ALERT_COLS}, "timestamp" FROM v_fired')
def stream_alert_cooldown(spark, sf):
    a = stage(AL.threshold_breaches(bridge.records(spark, sf)).select(*_ALERT_COLS.split(", "), "timestamp"), "breaches")
    src, out, chk = _scratch(spark, "st-src"), _scratch(spark, "st-out"), _scratch(spark, "st-chk")
    ST.create_source(spark, src, a.schema)
    fired = ST.stateful_cooldown(ST.event_stream(spark, src, a.schema), 10800, watermark="10000 days")
    w = (fired.writeStream.format("parquet").option("path", out).option("checkpointLocation", chk)
         .outputMode("append"))
    # by a hash of the id, so that every delivery spans the whole time; the second brings the first one's rows again
    part = F.pmod(F.xxhash64("id"), F.lit(3))
    for delivery in (a.where(part == 2), a.where(part >= 1), a.where(part == 0)):
        delivery.write.mode("append").parquet(src)
        ST.drain(w)
    # two rows far later: the first moves the watermark past all breaches, the second's batch gives them out
    end = (a.groupBy().agg(F.max("timestamp").alias("t"))
           .select(*[(F.col("t") + F.expr("INTERVAL 20000 DAYS")).alias(c) if c == "timestamp" else F.lit("end").alias(c)
                     if a.schema[c].dataType == T.StringType() else F.lit(None).cast(a.schema[c].dataType).alias(c) for c in a.columns]))
    for _ in range(2):
        end.write.mode("append").parquet(src)
        ST.drain(w)
    unstage(a)
    return spark.read.parquet(out).select(*_ALERT_COLS.split(", "), "timestamp")


@register("stream_time_series", ops="ST6 (windowed health per app = batch G1)",
          sql=_ts_sql("health_score", "hour", by="app_name"))
def stream_time_series(spark, sf):
    rec = bridge.records(spark, sf).select("id", "app_name", "timestamp", "health_score")
    src, out, chk = _scratch(spark, "st-src"), _scratch(spark, "st-out"), _scratch(spark, "st-chk")
    ST.create_source(spark, src, rec.schema)
    agg = ST.windowed_time_series(ST.event_stream(spark, src, rec.schema))
    w = (agg.writeStream.format("parquet").option("path", out).option("checkpointLocation", chk).outputMode("append"))
    ST.replay(rec, src, w, chunks=4)
    # rows of a day later: the first moves the watermark past the last windows, the second is the
    # batch that writes them; their own window stays open, so it is never written
    end = (rec.groupBy().agg(F.max("timestamp").alias("t"))
           .select(F.lit("end").alias("id"), F.lit(None).cast("string").alias("app_name"),
                   (F.col("t") + F.expr("INTERVAL 1 DAY")).alias("timestamp"),
                   F.lit(0).cast(rec.schema["health_score"].dataType).alias("health_score")))
    for _ in range(2):
        end.write.mode("append").parquet(src)
        ST.drain(w)
    return spark.read.parquet(out).withColumn("avg_value", r9("avg_value"))


@register("stream_upsert_records", ops="ST4 (re-delivered ids replace earlier rows)", sql=with_views(V_REC) + f"""
SELECT id, app_name, CASE WHEN {_REDELIVER} THEN least(health_score + 7, 100) ELSE health_score END AS health_score
FROM v_rec""")
def stream_upsert_records(spark, sf):
    rec = bridge.records(spark, sf).select("id", "app_name", "timestamp", "health_score", "created_at")
    again = (rec.where(F.col("id").cast("long") % 3 == 0)
             .withColumn("health_score", F.least(F.col("health_score") + 7, F.lit(100)))
             .withColumn("created_at", F.col("created_at") + F.expr("INTERVAL 1 DAY")))
    src, path, chk = _scratch(spark, "st-src"), _scratch(spark, "st-table"), _scratch(spark, "st-chk")
    ST.create_source(spark, src, rec.schema)
    stream = ST.event_stream(spark, src, rec.schema)
    w = stream.writeStream.option("checkpointLocation", chk).foreachBatch(ST.upsert_sink(path))
    for delivery in (rec, again):
        delivery.write.mode("append").parquet(src)
        ST.drain(w)
    return IO.read_records(spark, path).select("id", "app_name", "health_score")


@register("stream_upsert_scored_records", ops="ST4 (scored records, ids repeated within and across batches)",
          sql=with_views(V_EVT, scored_sql()) + "SELECT id, app_name, hallucination_score, groundedness_score, health_score FROM scored")
def stream_upsert_scored_records(spark, sf):
    rec = stage(SC.evaluate(bridge.chat_events(spark, sf)).drop("score_errors"), "scored")
    src, path, chk = _scratch(spark, "st-src"), _scratch(spark, "st-table"), _scratch(spark, "st-chk")
    ST.create_source(spark, src, rec.schema)
    stream = (ST.event_stream(spark, src, rec.schema).withWatermark("timestamp", "10000 days")
              .dropDuplicatesWithinWatermark(["id", "health_score"]))
    w = stream.writeStream.option("checkpointLocation", chk).foreachBatch(ST.upsert_sink(path))
    wrong = rec.withColumn("health_score", F.lit(-1))  # replaced by the next delivery
    for delivery in (wrong.union(wrong), rec.union(rec), rec):
        delivery.write.mode("append").parquet(src)
        ST.drain(w)
    unstage(rec)
    return IO.read_records(spark, path).select("id", "app_name", "hallucination_score", "groundedness_score", "health_score")


# ---------------------------------------------------------------- J3 judge join, U1, U2, U4
def _judge_table(spark, sf):
    """Offline judge answers for chat events: a score for two of three calls, none for the rest."""
    conv = table(spark, sf, "conversations").select("conv_id", "turn")
    return (conv.where((F.col("conv_id") + F.col("turn")) % 3 != 0)
            .select(F.concat_ws("-", "conv_id", "turn").alias("id"),
                    F.concat(F.lit(" 0."), ((F.col("conv_id") * 7 + F.col("turn")) % 10).cast("string"))
                    .alias("answer")))


@register("judge_combined_hallucination", ops="J2 J3 M2 (external judge table merged by id; 0.6 emb + 0.4 judge)", sql=with_views(V_EVT, scored_sql()) + """,
jt AS (SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS id,
              greatest(0.0, least(1.0, TRY_CAST(trim(' 0.' || CAST((conv_id * 7 + turn) % 10 AS VARCHAR)) AS DOUBLE))) AS j
       FROM conversations WHERE (conv_id + turn) % 3 <> 0)
SELECT e4.id,
       CASE WHEN regexp_replace(e4.response, '\\s+', '', 'g') = '' THEN 0.0
            WHEN e4.emb IS NOT NULL AND jt.j IS NOT NULL THEN round_even(0.6 * e4.emb + 0.4 * jt.j, 4)
            WHEN jt.j IS NOT NULL THEN round_even(jt.j, 4)
            WHEN e4.emb IS NOT NULL THEN round_even(e4.emb, 4) ELSE 0.0 END AS hallucination_score,
       CASE WHEN regexp_replace(e4.response, '\\s+', '', 'g') = '' THEN 'none'
            WHEN e4.emb IS NOT NULL AND jt.j IS NOT NULL THEN 'both' WHEN jt.j IS NOT NULL THEN 'llm_judge'
            WHEN e4.emb IS NOT NULL THEN 'embedding' ELSE 'none' END AS hallucination_method
FROM e4 LEFT JOIN jt ON jt.id = e4.id""")
def judge_combined_hallucination(spark, sf):
    ev = bridge.chat_events(spark, sf)
    judged = ev.join(_judge_table(spark, sf), "id", "left")
    judged = judged.withColumn("judge_score", PL.TX.parse_judge_answer("answer"))
    rec = SC.evaluate(judged.drop("answer"), judge=F.col("judge_score"), flags=K.ModuleFlags(drift=False, rag=False))
    return rec.select("id", "hallucination_score", "hallucination_method")


def _chars(pdf):
    import pandas as pd
    return pd.DataFrame({"response_chars": pdf["response"].fillna("").str.len().astype("int64")})


@register("plugin_scorer_column", ops="U1 (pandas scorer plug-in appends a column)", sql=with_views(V_EVT) + """
SELECT id, CAST(length(response) AS BIGINT) AS response_chars FROM v_evt""")
def plugin_scorer_column(spark, sf):
    plug = PL.PandasScorer("response_chars", _chars, ["response"],
                           T.StructType([T.StructField("response_chars", T.LongType())]))
    rec = SC.evaluate(bridge.chat_events(spark, sf), flags=K.ModuleFlags(drift=False), plugins=(plug,))
    return rec.select("id", "response_chars")


def _fragile_chars(pdf):
    """A scorer that fails on a whole batch if one response in it has the word."""
    if pdf["response"].fillna("").str.contains("Guido").any():
        raise RuntimeError("scorer failed")
    return _chars(pdf)


@register("plugin_failure_isolated", ops="P6 U1 (a plug-in that fails on some rows leaves its defaults there, counted in score_errors)",
          sql=with_views(V_EVT) + """
SELECT id, CASE WHEN contains(response, 'Guido') THEN CAST(-1 AS BIGINT) ELSE CAST(length(response) AS BIGINT) END AS response_chars,
       CASE WHEN contains(response, 'Guido') THEN 1 ELSE 0 END AS score_errors FROM v_evt""")
def plugin_failure_isolated(spark, sf):
    plug = PL.PandasScorer("response_chars", _fragile_chars, ["response"],
                           T.StructType([T.StructField("response_chars", T.LongType())]), {"response_chars": -1})
    rec = SC.evaluate(bridge.chat_events(spark, sf), flags=K.ModuleFlags(drift=False), plugins=(plug,))
    return rec.select("id", "response_chars", "score_errors")


def _echo(query: str) -> str:
    return f"Response to: {query}"


@register("regression_cli_echo", ops="U2 R1 R3 R5 (echo system under test, no scoring modules)",
          sql=with_views(V_GOLD) + f"""
SELECT 'benchmark-golden' AS dataset_name, count(*) AS total, count(*) AS passed, CAST(0 AS BIGINT) AS failed,
       CAST(CASE WHEN count(*) > 0 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS pass_rate,
       CASE WHEN count(*) > 0 THEN 1.0 ELSE 0.0 END >= {K.REGRESSION_GATE} AS gate_passed FROM v_gold""")
def regression_cli_echo(spark, sf):
    g = bridge.golden(spark, sf).drop("response", "call_failed")
    answered = RG.call_system(g, _echo)
    res = RG.run_suite(answered, flags=None)
    return RG.suite_summary(res, dataset_name="benchmark-golden")


def _length_judge(query, context, response):
    return f" {(len(query or '') + len(response or '')) % 11 / 10} "


@register("judge_plugin_scores", ops="U4 T10 T11 (judge callable in executors)", sql=with_views(V_EVT) + """
SELECT id, greatest(0.0, least(1.0, ((length(query) + length(response)) % 11) / 10.0)) AS judge_score FROM v_evt""")
def judge_plugin_scores(spark, sf):
    out = PL.judge_scores(bridge.chat_events(spark, sf), _length_judge)
    return out.select("id", "judge_score")


# ---------------------------------------------------------------- S1 / S10 / U3 / P6
@register("event_file_source", ops="S1 (events as JSON files read back with the fixed schema)",
          sql=with_views(V_EVT) + 'SELECT id, app_name, "timestamp", query, context, response, model_name, latency_ms FROM v_evt')
def event_file_source(spark, sf):
    from ternlens.sources.tables import read_events
    path = _scratch(spark, "events-json")
    bridge.chat_events(spark, sf).write.mode("overwrite").json(path)
    ev = read_events(spark, path, fmt="json")
    return ev.select("id", "app_name", "timestamp", "query", "context", "response", "model_name", "latency_ms")


@register("regression_report_files", ops="S10 (suite summary and failures written as JSON, read back)",
          sql=with_views(V_GOLD) + """
SELECT 'benchmark-golden' AS dataset_name, count(*) AS total,
       CAST(count_if(NOT call_failed AND regexp_replace(coalesce(response, ''), '\\s+', '', 'g') <> '') AS BIGINT) AS passed
FROM v_gold""")
def regression_report_files(spark, sf):
    from ternlens.sources.golden import save_regression_report
    g = bridge.golden(spark, sf).withColumn("error", F.when(F.col("call_failed"), F.lit("no response")))
    res = RG.run_suite(g, flags=None)
    path = _scratch(spark, "report")
    save_regression_report(RG.suite_summary(res, dataset_name="benchmark-golden"), RG.suite_failures(res), path)
    back = spark.read.json(f"{path}/summary")
    return back.select("dataset_name", back["total"].cast("long").alias("total"),
                       back["passed"].cast("long").alias("passed"))


def _hashed_embedder_32():
    """U3 plug-in: a factory run once per task, returning text → vector (32 buckets)."""
    from ternlens.functions.vectors import embed_text
    cache = {}

    def fn(text):
        return embed_text(text, 32, cache)
    return fn


@register("plugin_embedder_vectors", ops="U3 V1 (embedder plug-in inside the shared Arrow stage)", sql=with_views(V_EVT) + f""",
cnt AS (SELECT id AS eid, ('0x' || substr(md5(tok), 1, 8))::BIGINT % 32 AS bucket, count(*) AS c
        FROM (SELECT id, unnest(regexp_split_to_array(lower(response), '[^a-z0-9]+')) AS tok FROM v_evt)
        WHERE tok <> '' GROUP BY 1, 2),
dense AS (SELECT eid, list_transform(range(0, 32), lambda i: coalesce(list_sum(list_transform(
            list_filter(p, lambda q: q.bucket = i), lambda q: q.c)), 0) / nrm) AS vec
          FROM (SELECT eid, list(struct_pack(bucket := bucket, c := c)) AS p, sqrt(sum(c * c)) AS nrm FROM cnt GROUP BY eid))
SELECT e.id, list_transform(coalesce(d.vec, list_transform(range(0, 32), lambda i: 0.0::DOUBLE)),
                            lambda x: round(x, 9)) AS response_vector
FROM v_evt e LEFT JOIN dense d ON d.eid = e.id""")
def plugin_embedder_vectors(spark, sf):
    from ternlens.functions.vectors import round_elements
    ev = SC.event_to_record(SC.normalize_events(bridge.chat_events(spark, sf)))
    emb = SC.with_embeddings(ev, dim=32, embedder=_hashed_embedder_32)
    return emb.select("id", round_elements(F.col("_emb")["v_r"]).alias("response_vector"))


def _fragile_embedder():
    """An embedder that fails on one kind of text (to show P6 defaults)."""
    from ternlens.functions.vectors import DEFAULT_DIM, embed_text
    cache = {}

    def fn(text):
        if "Guido" in text:
            raise RuntimeError("embedder failed")
        return embed_text(text, DEFAULT_DIM, cache)
    return fn


@register("score_failure_defaults", ops="P6 (failed embedding → module defaults, counted in score_errors)",
          sql=with_views(V_EVT, scored_sql()) + """
SELECT s.id,
       CASE WHEN contains(e.query, 'Guido') OR contains(coalesce(e.context, ''), 'Guido') OR contains(e.response, 'Guido')
            THEN 1 ELSE 0 END AS score_errors,
       CASE WHEN contains(e.query, 'Guido') OR contains(coalesce(e.context, ''), 'Guido') OR contains(e.response, 'Guido')
            THEN 'none' ELSE s.hallucination_method END AS hallucination_method,
       CASE WHEN contains(e.query, 'Guido') OR contains(coalesce(e.context, ''), 'Guido') OR contains(e.response, 'Guido')
            THEN NULL ELSE s.groundedness_score END AS groundedness_score
FROM scored s JOIN v_evt e ON e.id = s.id""")
def score_failure_defaults(spark, sf):
    rec = SC.evaluate(bridge.chat_events(spark, sf), embedder=_fragile_embedder, flags=K.ModuleFlags(drift=False))
    return rec.select("id", "score_errors", "hallucination_method", "groundedness_score")
