"""What the plans must and must not contain, at a size where nothing is broadcast."""

from __future__ import annotations

import importlib
import re

import pytest

from cohortlens.catalog import QUERIES, Study

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plan_of(spark):
    """Physical plan text with size-based broadcasts switched off, as at full scale."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    study = Study(spark, FOLDER)
    yield lambda name: QUERIES[name](study)._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_python_no_local_rows_and_no_pairs(plan_of, name):
    plan = plan_of(name)
    for node in ("Python", "Arrow", "ExistingRDD", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in plan, node


def test_only_bounded_frames_are_broadcast(plan_of):
    # the one hint: per-slot totals
    assert plan_of("freq_admission").count("BroadcastExchange") == 1
    for name in ("cohort", "exposures", "top_exposures", "demographics_cases"):
        assert "BroadcastExchange" not in plan_of(name), name


def test_scans_read_only_used_columns(plan_of):
    columns = set(re.findall(r"ReadSchema: (struct<.*?>)", plan_of("mortality")))
    assert columns == {
        "struct<o_orderkey:bigint,o_custkey:bigint,o_orderstatus:string>",
        "struct<c_custkey:bigint>",
        "struct<l_orderkey:bigint,l_partkey:bigint,l_linenumber:int>",
    }


def test_flags_come_from_one_scan(plan_of):
    assert plan_of("code_flags").count("FileScan") == 1
    assert plan_of("code_flags").count("Exchange") == 1


def test_prefix_filters_reach_the_scan(spark, tmp_path):
    from cohortlens.config import DEFAULT
    from cohortlens.operators import flag_by_codes
    from edge import edge_tables

    edge_tables(spark).diagnoses_icd.write.parquet(f"{tmp_path}/dx")
    flags = flag_by_codes(spark.read.parquet(f"{tmp_path}/dx"), "hadm_id", DEFAULT.rules)
    plan = flags._jdf.queryExecution().executedPlan().toString()
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", plan).group(1)
    for prefix in ("428", "249", "250"):
        assert f"StringStartsWith(icd9_code,{prefix})" in pushed


def test_stay_totals_vanish_where_unused(plan_of):
    # the left join to unique stay totals is dropped when no column of it is read
    assert "l_returnflag" not in plan_of("mortality")
    assert "l_returnflag" in plan_of("icu_checks")


def test_interval_flag_compares_no_pairs(spark, plan_of):
    plan = plan_of("exposures")
    assert "ExistenceJoin" not in plan and "collect_list" not in plan
    # events, starts and carried maxima meet by key and hour
    assert re.search(r"SortMergeJoin \[hadm_id#\d+L, _day#\d+, _hour#\d+\], .*LeftOuter", plan)


def test_interval_flag_evaluates_its_sources_once(spark):
    """Both levels of the scan share one evaluation of events and starts."""
    plan = final_plan(spark, "exposures")
    assert "ReusedExchange" in plan
    scans = re.findall(r"FileScan parquet \[(.*?)\]", plan)
    assert sum("l_quantity" in scan for scan in scans) == 1  # prescriptions
    assert sum("l_returnflag" in scan for scan in scans) == 1  # stays


@pytest.fixture
def written_plans(spark, monkeypatch):
    """Final plans of what operators write while they run, in order."""
    seen = []
    modules = [importlib.import_module(f"cohortlens.operators.{m}") for m in ("quantiles", "profile", "strata", "exposures")]
    real = modules[0].scratch

    def watched(df, label="scratch"):
        df.collect()
        seen.append((label, df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]))
        return real(df, label)

    for module in modules:
        monkeypatch.setattr(module, "scratch", watched)
    return seen


def test_outcomes_roll_up_counts_in_one_expand(spark, written_plans):
    QUERIES["outcomes_stratified"](Study(spark, FOLDER)).collect()
    plan = written_plans[0][1]
    assert written_plans[0][0] == "counts" and "percentile" not in plan
    # one Expand turns measures long, one rolls up the counts
    assert plan.count("Expand [[") == 2


@pytest.mark.parametrize(("name", "column"), [("outcomes_stratified", "o_orderstatus"), ("los_profile", "c_custkey"), ("dose_by_unit", "l_quantity")])
def test_counts_read_the_rows_once(spark, written_plans, name, column):
    """Rows are scanned once for the counts; all rounds and results read the counts."""
    QUERIES[name](Study(spark, FOLDER)).collect()
    scanned = [sum(column in scan for scan in re.findall(r"FileScan parquet \[(.*?)\]", plan)) for _, plan in written_plans]
    assert scanned[0] == 1 and sum(scanned[1:]) == 0


def test_refinement_spreads_a_hot_group(spark, written_plans):
    """Values meet their bracket by group and slot, so one group is many keys."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        QUERIES["los_profile"](Study(spark, FOLDER)).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    rounds = [plan for label, plan in written_plans if label == "ranks"][1:]
    assert rounds and all(re.search(r"Join \[.*_slot#\d+", plan) for plan in rounds)


def test_top_k_is_not_a_full_sort(plan_of):
    for name in ("top_exposures", "setting_split", "top_exposures_report"):
        assert "TakeOrderedAndProject" in plan_of(name), name


def test_first_per_key_limits_before_the_shuffle(plan_of):
    plan = plan_of("dominant_unit")
    assert re.search(r"WindowGroupLimit .* Partial", plan)


def final_plan(spark, name):
    frame = QUERIES[name](Study(spark, FOLDER))
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


@pytest.mark.parametrize(
    ("name", "column"),
    [
        ("top_exposures", "l_quantity"),
        ("top_exposures_report", "l_quantity"),
        ("dose_units_used", "l_quantity"),
        ("exposure_overview", "l_suppkey"),
        ("freq_ethnicity", "l_linenumber"),
    ],
)
def test_rows_are_read_once(spark, name, column):
    """Branches of a query share one evaluation of the rows: the column is scanned once."""
    scans = re.findall(r"FileScan parquet \[(.*?)\]", final_plan(spark, name))
    assert sum(column in scan for scan in scans) == 1
