"""What the physical plans must and must not contain."""

import re

import pytest

from plans import hot_spots

from tideloom.plans import ORACLES, QUERIES
from tideloom.plans.base import hourly_sparse, ticks
from tideloom.operators.filters import date_slice

SF = "/root/testdata/sf0.001"
# Whole-table windows over tables that hold one row per slice, or the k rows of a top-k report.
SMALL_WINDOWS = {
    "gaussian_nll_topk",
    "minibatch_assign",
    "series_covariates",
    "weighted_resample",
}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join_and_no_single_task_window(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name not in SMALL_WINDOWS:
        # A window over the whole table sorts below an exchange to a single partition.
        lines = plan.splitlines()
        for at, line in enumerate(lines):
            if re.search(r"\bWindow\b", line):
                below = " ".join(lines[at + 1 : at + 4])
                assert "Exchange SinglePartition" not in below, plan


def test_date_slice_is_pushed_down(spark):
    rows = date_slice(ticks(spark, SF), "2024-01-05 00:00:00", "2024-01-06 00:00:00").select("ts", "value")
    plan = plan_of(rows)
    assert "GreaterThanOrEqual(ts,2024-01-05T00:00)" in plan
    assert "ReadSchema: struct<ts:timestamp_ntz,value:double>" in plan


def test_series_base_reads_three_columns_once(spark):
    plan = plan_of(hourly_sparse(spark, SF))
    assert re.findall(r"ReadSchema: (\S+)", plan) == ["struct<ts:timestamp_ntz,event_type:string,value:double>"]
    assert "partial_sum" in plan
    # Later steps read the written hourly sums, not the events.
    assert "events.parquet" not in plan_of(QUERIES["resample_sum"](spark, SF))


def test_tail_is_limited_before_the_shuffle(spark):
    plan = plan_of(QUERIES["tail_n"](spark, SF))
    assert plan.count("WindowGroupLimit") == 2


def test_topk_does_not_sort_everything(spark):
    assert "TakeOrderedAndProject" in plan_of(QUERIES["topk_window_mse"](spark, SF))


def test_names():
    assert set(ORACLES) <= set(QUERIES)
    assert not any(re.match(r"op\d", n) or "pipeline" in n for n in QUERIES)


def test_chunks_are_shuffled_after_a_keyed_join(spark):
    from tideloom.models.diagnostics import level_and_change

    rows = spark.range(100).selectExpr("id % 2 AS series_id", "id DIV 2 AS pos", "id * 1.0D AS value")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = level_and_change(rows, ["series_id"], "value", "pos", 16)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "SortMergeJoin" in plan
    assert "_chunk" in next(line for line in plan.splitlines() if "Exchange hashpartitioning" in line)


# ``tools/plans.py`` searches all queries; these had an aggregate or a window on a join by series.
JOINED = [
    "ffill", "bfill", "scale_minmax", "scale_standard", "unscale_standard", "best_by_aic", "model_select", "model_select_rolling",
    "mse_aligned", "mse_positional", "sarimax_forecast", "arima_fit", "strided_window_cells", "forecast_requests_routed",
]


@pytest.mark.parametrize("name", JOINED)
def test_no_series_meets_one_task_behind_a_join(spark, name):
    assert hot_spots(spark, lambda: QUERIES[name](spark, SF)) == []


def test_the_search_finds_what_it_looks_for(spark):
    rows = spark.range(100).selectExpr("id % 2 AS series_id", "id AS value")
    ends = rows.groupBy("series_id").max("value")
    assert hot_spots(spark, lambda: rows.join(ends, "series_id").groupBy("series_id").count())
