"""Queries for alerts: threshold checks, cooldown, feeds, outbox, record links."""

from __future__ import annotations

from pyspark.sql import functions as F

from ternlens.operators import alerts as AL
from ternlens.plans.catalog import register
from ternlens.plans.sqlviews import V_REC, with_views
from ternlens.sources import bridge
from ternlens.sources.tables import table

_BREACHES = """v_alert AS (
  SELECT md5(r.id || ':' || c.metric) AS id, r."timestamp", r.app_name, r.id AS record_id, c.metric, c.check_pos,
         c.value, c.threshold, c.below,
         CASE WHEN (CASE WHEN c.below THEN c.threshold - c.value ELSE c.value - c.threshold END) > 0.2
              THEN 'critical' ELSE 'warning' END AS severity,
         c.metric || ' is ' || CASE WHEN c.below THEN 'below' ELSE 'above' END || ' threshold: '
           || printf('%.3f', c.value) || ' ' || CASE WHEN c.below THEN '<' ELSE '>' END || ' '
           || printf('%.3f', c.threshold) AS message
  FROM v_rec r,
       (SELECT * FROM (VALUES (0, 'hallucination_score', 0.3::DOUBLE, false), (1, 'drift_score', 0.15::DOUBLE, false),
                              (2, 'groundedness_score', 0.65::DOUBLE, true), (3, 'toxicity_score', 0.05::DOUBLE, false))
               t(check_pos, metric, threshold, below)) c0,
       LATERAL (SELECT c0.check_pos, c0.metric, c0.threshold, c0.below,
                       CASE c0.metric WHEN 'hallucination_score' THEN r.hallucination_score
                                      WHEN 'drift_score' THEN r.drift_score
                                      WHEN 'groundedness_score' THEN r.groundedness_score
                                      ELSE r.toxicity_score END AS value) c
  WHERE c.value IS NOT NULL AND ((c.below AND c.value < c.threshold) OR (NOT c.below AND c.value > c.threshold)))"""


def _cooldown_sql(seconds: int, key: str) -> str:
    """Oracle: sequential greedy firing by recursion (one step per fire)."""
    return f"""b AS (
  SELECT *, {key} AS k, epoch_us("timestamp") AS t,
         row_number() OVER (PARTITION BY {key} ORDER BY "timestamp", record_id) AS rn FROM v_alert),
fires(k, rn, t) AS (
  SELECT k, rn, t FROM b WHERE rn = 1
  UNION ALL
  SELECT b.k, min(b.rn), arg_min(b.t, b.rn) FROM fires f JOIN b ON b.k = f.k AND b.t >= f.t + {seconds * 1_000_000}
  GROUP BY b.k),
v_fired AS (SELECT b.* FROM b JOIN fires USING (k, rn))"""


_ALERT_COLS = "id, record_id, app_name, metric, severity, value, threshold, message"


@register("threshold_alerts", ops="A1 A2 A4 T12", sql=with_views(V_REC, _BREACHES) + f"""
SELECT {_ALERT_COLS}, check_pos FROM v_alert""")
def threshold_alerts(spark, sf):
    a = AL.threshold_breaches(bridge.records(spark, sf))
    return a.select(*_ALERT_COLS.split(", "), "check_pos")


@register("alert_cooldown_app_metric", ops="W3 A3 (key app+metric, 10800 s)",
          sql=with_views(V_REC, _BREACHES, _cooldown_sql(10800, "app_name || '|' || metric")) + f"""
SELECT {_ALERT_COLS}, "timestamp" FROM v_fired""")
def alert_cooldown_app_metric(spark, sf):
    a = AL.threshold_breaches(bridge.records(spark, sf))
    return AL.apply_cooldown(a, 10800).select(*_ALERT_COLS.split(", "), "timestamp")


@register("alert_cooldown_metric_scope", ops="W3 A3 (parity: key metric only, 300 s)",
          sql=with_views(V_REC, _BREACHES, _cooldown_sql(300, "metric")) + f"""
SELECT {_ALERT_COLS}, "timestamp" FROM v_fired""")
def alert_cooldown_metric_scope(spark, sf):
    a = AL.threshold_breaches(bridge.records(spark, sf))
    return AL.apply_cooldown(a, 300, scope="metric").select(*_ALERT_COLS.split(", "), "timestamp")


@register("alert_feed", ops="A6 F6", sql=with_views(V_REC, _BREACHES, _cooldown_sql(300, "app_name || '|' || metric")) + """
SELECT strftime("timestamp", '%Y-%m-%d %H:%M') AS time, upper(severity) AS severity, metric,
       printf('%.4f', value) AS value, printf('%.4f', threshold) AS threshold, message, id
FROM v_fired ORDER BY "timestamp" DESC, id DESC LIMIT 20""")
def alert_feed(spark, sf):
    fired = AL.apply_cooldown(AL.threshold_breaches(bridge.records(spark, sf)), 300)
    return AL.alert_feed(fired)


_CHANNELS = [("email", "oncall@example.org"), ("slack", "https://hooks.slack.com/services/T000/B000/XXXX"),
             ("slack", "http://hooks.slack.com/services/T000/B000/YYYY")]


@register("notification_outbox", ops="A5", sql=with_views(V_REC, _BREACHES, _cooldown_sql(10800, "app_name || '|' || metric")) + """
SELECT a.id AS alert_id, ch.channel, ch.target,
       CASE WHEN ch.channel = 'email' THEN '[ternlens ' || upper(a.severity) || '] ' || a.metric || ': ' || a.message END AS subject,
       CASE WHEN ch.channel = 'email' THEN 'ternlens alert' || chr(10) || repeat('=', 40) || chr(10) || chr(10)
              || 'Severity: ' || a.severity || chr(10) || 'Metric: ' || a.metric || chr(10)
              || 'Value: ' || printf('%.4f', a.value) || chr(10) || 'Threshold: ' || printf('%.4f', a.threshold) || chr(10)
              || 'Message: ' || a.message || chr(10) || 'Time: ' || strftime(a."timestamp", '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(a."timestamp") % 1000000 <> 0 THEN strftime(a."timestamp", '.%f') ELSE '' END || '+00:00'
              || chr(10) || 'Record ID: ' || a.record_id || chr(10)
            WHEN ch.channel = 'slack' THEN CASE WHEN a.severity = 'critical' THEN ':red_circle:' ELSE ':warning:' END
              || ' *ternlens alert*' || chr(10) || '*' || a.metric || '*: ' || a.message || chr(10)
              || 'Value: `' || printf('%.4f', a.value) || '` | Threshold: `' || printf('%.4f', a.threshold) || '`'
              || chr(10) || 'Severity: ' || a.severity || ' | Time: '
              || strftime(a."timestamp", '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(a."timestamp") % 1000000 <> 0 THEN strftime(a."timestamp", '.%f') ELSE '' END || '+00:00' END AS payload,
       CASE WHEN ch.channel = 'slack' THEN
              lower(regexp_extract(ch.target, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) = 'https'
              AND lower(regexp_extract(ch.target, '^[A-Za-z][A-Za-z0-9+.-]*://([^:/?#@]*)', 1)) LIKE '%hooks.slack.com'
            ELSE true END AS valid
FROM v_fired a,
     (VALUES ('email', 'oncall@example.org'), ('slack', 'https://hooks.slack.com/services/T000/B000/XXXX'),
             ('slack', 'http://hooks.slack.com/services/T000/B000/YYYY')) ch(channel, target)""")
def notification_outbox(spark, sf):
    fired = AL.apply_cooldown(AL.threshold_breaches(bridge.records(spark, sf)), 10800)
    return AL.notification_outbox(fired, _CHANNELS)


@register("webhook_url_check", ops="A5 (URL validation over pages.url)", sql="""
SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme,
       lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^:/?#@]*)', 1)) AS host,
       (lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) = 'https'
        AND lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^:/?#@]*)', 1)) LIKE '%hooks.slack.com') AS slack_valid,
       (lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) = 'https'
        AND lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^:/?#@]*)', 1)) LIKE '%example.com') AS https_example_com
FROM pages""")
def webhook_url_check(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url")
    return p.select("page_id", "url", F.lower(F.parse_url("url", F.lit("PROTOCOL"))).alias("scheme"),
                    F.lower(F.parse_url("url", F.lit("HOST"))).alias("host"),
                    AL.valid_webhook(F.col("url")).alias("slack_valid"),
                    AL.valid_webhook(F.col("url"), "example.com").alias("https_example_com"))


@register("alerts_with_records", ops="J6 (alert ⋈ record)", sql=with_views(V_REC, _BREACHES) + """
SELECT a.id, a.metric, r.id AS record_id, r.app_name, r.health_score
FROM v_alert a JOIN v_rec r ON a.record_id = r.id WHERE a.severity = 'critical'""")
def alerts_with_records(spark, sf):
    rec = bridge.records(spark, sf)
    a = AL.threshold_breaches(rec).where(F.col("severity") == "critical").select("id", "metric", "record_id")
    r = rec.select(F.col("id").alias("rid"), "app_name", "health_score")
    return a.join(r, a.record_id == r.rid).select("id", "metric", "record_id", "app_name", "health_score")


@register("records_without_alerts", ops="J6 (anti join)", sql=with_views(V_REC, _BREACHES) + """
SELECT id, app_name, health_score FROM v_rec r
WHERE NOT EXISTS (SELECT 1 FROM v_alert a WHERE a.record_id = r.id)""")
def records_without_alerts(spark, sf):
    rec = bridge.records(spark, sf)
    a = AL.threshold_breaches(rec).select(F.col("record_id").alias("id"))
    return rec.join(a, "id", "left_anti").select("id", "app_name", "health_score")


@register("records_with_alerts", ops="J6 (semi join)", sql=with_views(V_REC, _BREACHES) + """
SELECT id, app_name, health_score FROM v_rec r
WHERE EXISTS (SELECT 1 FROM v_alert a WHERE a.record_id = r.id AND a.metric = 'toxicity_score')""")
def records_with_alerts(spark, sf):
    rec = bridge.records(spark, sf)
    a = (AL.threshold_breaches(rec).where(F.col("metric") == "toxicity_score")
         .select(F.col("record_id").alias("id")))
    return rec.join(a, "id", "left_semi").select("id", "app_name", "health_score")


@register("alert_cooldown_parallel_runs", ops="W3 (breaches dealt over 64 parts)",
          sql=with_views(V_REC, _BREACHES, _cooldown_sql(10800, "app_name || '|' || metric")) + f"""
SELECT {_ALERT_COLS}, "timestamp" FROM v_fired""")
def alert_cooldown_parallel_runs(spark, sf):
    a = AL.threshold_breaches(bridge.records(spark, sf))
    return AL.apply_cooldown(a, 10800, parts=64).select(*_ALERT_COLS.split(", "), "timestamp")
