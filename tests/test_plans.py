"""Physical-plan properties the design relies on (checked on the executed plans)."""

from pyspark.sql import functions as F

import __spark_entry__ as E
import re

from ternlens.operators import drift as D
from ternlens.operators import records as R
from ternlens.operators import scoring as SC
from ternlens.sources import bridge

Q = E.queries()


def _plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def _initial(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


def test_scan_reads_only_needed_columns(spark, sf):
    plan = _initial(Q["health_time_series_by_app"](spark, sf))
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string>" in plan


def test_filters_reach_the_scan(spark, sf):
    df = spark.read.parquet(f"{sf}/events.parquet").where(F.col("event_type") == "error").select("event_id")
    plan = _initial(df)
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,error)]" in plan


def test_single_arrow_stage_for_all_embeddings(spark, sf):
    ev = SC.event_to_record(SC.normalize_events(bridge.chat_events(spark, sf)))
    scored = SC.rag_scores(SC.hallucination_scores(SC.quality_scores(SC.with_embeddings(ev))))
    assert _plan(scored).count("ArrowEvalPython") == 1


def test_latest_per_app_limits_before_the_shuffle(spark, sf):
    plan = _initial(R.latest_n_per_app(bridge.records(spark, sf), 10))
    assert plan.count("WindowGroupLimit") >= 2   # partial (map side) and final


def test_online_drift_groups_by_block_and_ranks_no_app(spark, sf):
    plan = _initial(D.online_drift(bridge.vectors(spark, sf), order=("id",)))
    assert "row_number" not in plan and "RowNumber" not in plan
    assert "FlatMapGroupsInPandas [_key" in plan and "_block" in plan


def test_keyword_retrieval_is_an_equi_join(spark, sf):
    plan = _plan(Q["keyword_retrieval"](spark, sf))
    assert re.search(r"(HashJoin|SortMergeJoin) \[_width#\d+, _head#\d+\], \[_width#\d+, _head#\d+\]", plan)
    assert "Cartesian" not in plan


def test_top_k_is_take_ordered(spark, sf):
    plan = _initial(R.latest_n(bridge.records(spark, sf), 10))
    assert "TakeOrderedAndProject" in plan


def test_aggregates_are_partial_then_final(spark, sf):
    plan = _initial(Q["multi_metric_time_series_daily"](spark, sf))
    assert plan.count("HashAggregate") >= 2          # partial before the exchange, final after
