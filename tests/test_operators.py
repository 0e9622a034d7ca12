"""Operators against brute force on small random data, hot keys included."""

from __future__ import annotations

import bisect
import importlib
import math
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens import operators as op
from cohortlens.config import CodeRule

# the package offers the function under the module's name
quantile_module = importlib.import_module("cohortlens.operators.quantiles")
ORIGIN = datetime(2020, 3, 7)


def random_intervals(rng, hot_share=0.35):
    """Intervals and events of 40 keys; one key holds over a third of both."""
    key = lambda: 0 if rng.random() < hot_share else rng.randrange(1, 40)
    moment = lambda: ORIGIN + timedelta(hours=rng.randrange(24 * 20), minutes=rng.choice([0, 30]))
    lengths = [-5, 0, 0.5, 3, 20, 30, 24 * 6]
    intervals = []
    for _ in range(300):
        begin = moment()
        end = None if rng.random() < 0.1 else begin + timedelta(hours=rng.choice(lengths))
        intervals.append((key(), None if rng.random() < 0.05 else begin, end))
    events = [(i, key(), None if rng.random() < 0.1 else moment()) for i in range(2000)]
    # exact bounds, and bounds at midnight
    for k, begin, end in intervals[:60]:
        for edge in (begin, end):
            if edge:
                events.append((len(events), k, edge))
    return intervals, events


def test_flag_in_interval_matches_brute_force(spark):
    intervals, events = random_intervals(random.Random(3))
    stays = spark.createDataFrame(intervals, "k int, a timestamp_ntz, b timestamp_ntz")
    facts = spark.createDataFrame(events, "i int, k int, t timestamp_ntz")
    got = op.flag_in_interval(facts, stays, "k", "t", "a", "b")
    assert got.columns == ["i", "k", "t", "in_interval"]
    found = {r["i"]: r["in_interval"] for r in got.collect()}
    assert len(found) == len(events)
    for i, k, t in events:
        inside = t is not None and any(
            kk == k and a is not None and b is not None and a <= t <= b for kk, a, b in intervals
        )
        assert found[i] == int(inside), (i, k, t)


def test_flag_in_interval_for_some_keys(spark):
    far = datetime(2150, 1, 1)
    stays = spark.createDataFrame([(1, ORIGIN, far), (2, ORIGIN, far)], "k int, a timestamp_ntz, b timestamp_ntz")
    facts = [(1, datetime(2100, 5, 5)), (1, datetime(2150, 1, 2)), (1, None), (2, ORIGIN), (3, ORIGIN), (4, None)]
    facts += [(None, ORIGIN)]
    frame = spark.createDataFrame(facts * 2, "k int, t timestamp_ntz")
    keys = spark.createDataFrame([(1,), (3,), (9,)], "k int")
    got = op.flag_in_interval(frame, stays, "k", "t", "a", "b", only=keys)
    want = [(1, facts[0][1], 1), (1, facts[1][1], 0), (1, None, 0), (3, ORIGIN, 0)] * 2
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_one_key_with_a_third_of_everything(spark):
    """Hundreds of millions of pairs within one key, were they compared pair by pair."""
    first = F.lit(ORIGIN).cast("timestamp_ntz")
    moment = lambda n, step: first + F.make_dt_interval(mins=(n * step % 500_000).cast("int"))
    key = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 1000).alias("k")
    facts = spark.range(150_000).select("id", key, moment(F.col("id"), 7).alias("t"))
    stays = spark.range(15_000).select(key, moment(F.col("id"), 11).alias("a"))
    stays = stays.withColumn("b", F.col("a") + F.expr("interval 3 minutes"))
    got = op.flag_in_interval(facts, stays, "k", "t", "a", "b").toPandas()
    assert len(got) == 150_000
    places = defaultdict(list)
    for k, a, b in stays.collect():
        places[k].append((a, b))
    starts = {k: sorted(v) for k, v in places.items()}
    for k, t, flag in got.sample(3000, random_state=1)[["k", "t", "in_interval"]].itertuples(index=False):
        i = bisect.bisect_right(starts.get(k, []), (t.to_pydatetime(), datetime.max))
        near = starts.get(k, [])[max(0, i - 8) : i]
        assert flag == int(any(a <= t <= b for a, b in near)), (k, t, near)


@pytest.mark.parametrize("step", ["microseconds", "seconds", "none"])
def test_one_key_with_everything_in_one_hour(spark, step):
    """A thousand million pairs share key and hour; starts may also all be the same."""
    n = 32_000
    micros = {"microseconds": 1, "seconds": 1_000_000 // 10, "none": 0}[step]
    place = lambda factor: (F.col("id") * factor % n) * micros
    later = lambda c: (F.lit(ORIGIN).cast("timestamp_ntz") + F.make_dt_interval(secs=(c / 1_000_000).cast("decimal(18,6)")))
    facts = spark.range(n).select("id", F.lit(1).alias("k"), place(7919).alias("p")).withColumn("t", later(F.col("p")))
    stays = spark.range(n).where("id % 5 < 2").select(F.lit(1).alias("k"), place(7717).alias("p"))
    stays = stays.withColumns({"a": later(F.col("p")), "b": later(F.col("p") + micros * (F.col("p") % 2))})
    got = op.flag_in_interval(facts, stays.select("k", "a", "b"), "k", "t", "a", "b").toPandas()
    assert len(got) == n
    covered = set()
    for r in stays.select("p").distinct().collect():
        covered.update((r["p"], r["p"] + micros * (r["p"] % 2)))
    assert (got["in_interval"] == got["p"].isin(covered).astype(int)).all()


def test_intervals_over_many_hours_are_carried_over(spark):
    """Ends far away, hours without a start, a long interval behind a short later one."""
    hours = lambda n: ORIGIN + timedelta(hours=n)
    stays = [(1, hours(0), hours(3000)), (1, hours(2), hours(3)), (2, hours(0.2), hours(0.9)), (2, hours(0.5), hours(0.6)), (2, hours(30), hours(30))]
    stays += [(3, hours(0), datetime(9999, 12, 31)), (None, hours(0), hours(9))]
    facts = [(1, hours(n), int(n <= 3000)) for n in (0, 2.5, 4, 700, 3000, 3000.001)] + [(1, hours(-1), 0)]
    facts += [(2, hours(n), f) for n, f in ((0.1, 0), (0.2, 1), (0.55, 1), (0.9, 1), (0.95, 0), (5, 0), (30, 1), (31, 0))]
    facts += [(3, datetime(9000, 1, 1), 1), (None, hours(1), 0), (3, None, 0)]
    frame = spark.createDataFrame(facts, "k int, t timestamp_ntz, want int")
    got = op.flag_in_interval(frame, spark.createDataFrame(stays, "k int, a timestamp_ntz, b timestamp_ntz"), "k", "t", "a", "b")
    assert [r for r in got.collect() if r["want"] != r["in_interval"]] == []
    assert got.count() == len(facts)


def test_total_interval_days(spark):
    hours = lambda n: ORIGIN + timedelta(hours=n)
    data = [
        (1, hours(0), hours(36)),
        (1, hours(40), hours(34)),
        (2, hours(0), None),
        (3, hours(5), hours(5)),
        (4, hours(5), hours(4)),
        (5, hours(0), hours(24)),
        (5, hours(0), None),
    ]
    frame = spark.createDataFrame(data, "k int, a timestamp_ntz, b timestamp_ntz")
    got = {r[0]: r[1] for r in op.total_interval_days(frame, "k", "a", "b").collect()}
    assert got == {1: 1.25, 2: None, 3: 0.0, 4: None, 5: 1.0}


def test_flag_by_codes(spark):
    data = [(1, 1, "4280"), (1, 1, "25000"), (2, 2, "25000"), (3, 1, "14280"), (4, None, "2509"), (5, 9, None)]
    frame = spark.createDataFrame(data, "k int, n int, c string")
    rules = {"x": (CodeRule("428"),), "y": (CodeRule("249"), CodeRule("250", after=1))}
    got = op.flag_by_codes(frame, "k", rules, "c", "n")
    assert sorted(tuple(r) for r in got.collect()) == [(1, 1, 0), (2, 0, 1)]
    all_keys = op.left_flags(frame.select("k").distinct(), got, "k")
    assert sorted(tuple(r) for r in all_keys.collect())[2] == (3, 0, 0)


@pytest.mark.parametrize("slices", [64, 1024])
def test_quantiles_match_linear_interpolation(spark, monkeypatch, slices):
    monkeypatch.setattr(quantile_module, "SLICES", slices)
    rng = random.Random(11)
    data = [("hot", rng.choice([0.0, 1.5, rng.gauss(10, 4), rng.expovariate(0.01)])) for _ in range(1500)]
    data += [(rng.choice("abcde"), round(rng.uniform(-3, 3), 1)) for _ in range(300)]
    data += [("single", 7.25), (None, 4.0), (None, 5.0), ("none", None), ("odd", float("nan")), ("odd", 2.0)]
    frame = spark.createDataFrame(data, "g string, x double")
    probabilities = {"p0": 0.0, "q25": 0.25, "median": 0.5, "q75": 0.75, "p90": 0.9, "p100": 1.0}
    counts = op.value_counts(frame, ["g"], ["x"])
    got = {r["g"]: r for r in op.quantiles(counts, ["g"], probabilities).collect()}
    values = defaultdict(list)
    for g, x in data:
        if x is not None and not math.isnan(x):
            values[g].append(x)
    assert set(got) == set(values)
    for g, xs in values.items():
        for name, p in probabilities.items():
            assert got[g][name] == pytest.approx(np.quantile(xs, p), abs=1e-9), (g, name)


def test_quantiles_of_the_whole_frame(spark):
    frame = spark.range(101).select(F.col("id").cast("double").alias("x"))
    got = op.quantiles(op.value_counts(frame, [], ["x"]), [])
    assert [tuple(r) for r in got.collect()] == [(25.0, 50.0, 75.0)]


@pytest.mark.parametrize("kind", ["narrow", "integers", "outlier", "wide"])
def test_quantiles_of_many_values_in_small_windows(spark, monkeypatch, kind):
    """No window sees more rows than there are slices, wherever the values lie."""
    n = 300_000
    spread = F.pmod(F.xxhash64("id"), F.lit(n)).cast("double")
    value = {
        "narrow": spread * (0.3 / n),
        "integers": spread,
        "outlier": F.when(F.col("id") == 5, 1e300).otherwise(spread / n),
        "wide": F.pow(F.lit(10.0), spread / n * 40 - 20) * F.when(F.col("id") % 2 == 0, -1).otherwise(1),
    }[kind]
    frame = spark.range(n).select(F.lit("g").alias("g"), value.alias("x"))
    histograms = []
    narrowed = quantile_module._narrowed

    def watched(*args):
        found = narrowed(*args)
        # the rows that the window sees are the rows of the histogram below the join
        histograms.append(found)
        return found

    monkeypatch.setattr(quantile_module, "_narrowed", watched)
    probabilities = {"p0": 0.0, "q1": 0.01, "q25": 0.25, "median": 0.5, "q75": 0.75, "p100": 1.0}
    got = op.quantiles(op.value_counts(frame, ["g"], ["x"]), ["g"], probabilities).collect()
    values = np.array([r[0] for r in frame.select("x").collect()])
    want = np.quantile(values, list(probabilities.values()))
    assert len(got) == 1
    assert list(got[0])[1:] == pytest.approx(want, rel=1e-12)
    assert 1 <= len(histograms) <= (20 if kind == "wide" else 4)


def test_slices_are_few_and_grow_with_the_value(spark):
    edges = [-math.inf, -1.7e308, -5.0, -5e-324, 0.0, 5e-324, 1e-300, 1.0, 1.0000000000000002, 1e308, 1.7e308, math.inf]
    for low in edges:
        for high in edges:
            if low < high:
                inside = [v for v in edges if low <= v <= high]
                frame = spark.createDataFrame([(v, low, high) for v in inside], "v double, l double, h double").coalesce(1)
                got = [r[0] for r in frame.select(quantile_module._slice(F.col("v"), F.col("l"), F.col("h"))).collect()]
                assert got == sorted(got) and got[0] < got[-1] and -1 <= got[0] and got[-1] <= quantile_module.SLICES + 2


def test_infinite_values_are_values(spark):
    inf = math.inf
    data = [("a", x) for x in (-inf, -inf, 1.0, 2.0, 3.0, inf, inf)] + [("b", inf), ("c", -inf), ("c", inf), ("c", 0.0)]
    frame = spark.createDataFrame(data, "g string, x double")
    got = {r["g"]: tuple(r)[1:] for r in op.quantiles(op.value_counts(frame, ["g"], ["x"]), ["g"]).collect()}
    assert got["a"][1] == 2.0 and got["b"] == (inf, inf, inf) and got["c"][1] == 0.0


def test_numeric_profile(spark):
    xs = [float(x) for x in range(1, 102)] + [None, None]
    frame = spark.createDataFrame([(x,) for x in xs], "x double")
    row = op.numeric_profile(frame, "x").first().asDict()
    assert row == {
        "min": 1.0, "q25": 26.0, "median": 51.0, "q75": 76.0, "max": 101.0, "mean": 51.0,
        "sd": round(float(np.std([x for x in xs if x], ddof=1)), 2), "n": 101, "n_missing": 2,
    }


def test_profile_of_nothing(spark, rows):
    empty = spark.createDataFrame([], "x double, f int")
    assert op.numeric_profile(empty, "x").first().asDict()["median"] is None
    assert rows(op.missing_profile(empty)) == []
    assert rows(op.event_rate(empty, "f")) == [(None, 0, None)]
    assert rows(op.frequency(empty, "x")) == []


def test_frequency(spark, rows):
    rng = random.Random(5)
    values = ["hot"] * 500 + [f"v{rng.randrange(300)}" for _ in range(400)] + [None] * 100
    frame = spark.createDataFrame([(v,) for v in values], "v string")
    got = rows(op.frequency(frame, "v", by_count=True))
    count = Counter(values)
    order = sorted(count, key=lambda v: (-count[v], v is None, v or ""))
    assert got == [(v, count[v], pytest.approx(100 * count[v] / 1000)) for v in order]
    named = rows(op.frequency(frame.where("v = 'hot' or v is null or v = 'v7'"), "v", levels=["v7", "hot"]))
    assert [r[0] for r in named] == ["v7", "hot", None]


def test_dominant_value(spark):
    data = [("a", "x"), ("a", "y"), ("a", "y"), ("b", None), ("b", "z"), ("c", None), (None, "q")]
    frame = spark.createDataFrame(data, "k string, v string")
    got = {r["k"]: (r["v"], r["n"]) for r in op.dominant_value(frame, "k", "v").collect()}
    assert got == {"a": ("y", 2), "b": ("z", 1), "c": (None, 1), None: ("q", 1)}


def test_ties_at_the_cut_go_by_name(spark, rows):
    data = [(1, name, "1", "mg", 1) for name in ("d", "c", "b", "a", "a")]
    frame = spark.createDataFrame(
        data, "hadm_id int, drug string, dose_val_rx string, dose_unit_rx string, in_icu int"
    )
    assert [r[0] for r in rows(op.top_exposures(frame, 3).orderBy("drug"))] == ["a", "b", "c"]
    assert [r[0] for r in rows(op.setting_split(frame, 2))] == ["a", "b"]
    assert [r[0] for r in rows(op.dose_by_unit(frame, 2))] == ["a", "b"]


def test_crosstab_keeps_undeclared_levels_and_drops_missing_groups(spark):
    data = [("x", "p", "no"), ("x", None, "no"), ("y", "p", "yes"), ("z", "q", None)]
    frame = spark.createDataFrame(data, "a string, b string, g string")
    table = op.crosstab(frame, ["a", "b"], "g", {"no": "n", "yes": "y"}, {"a": ("w", "x")})
    got = {(r["variable"], r["level"]): tuple(r)[2:] for r in table.collect()}
    assert got == {
        ("a", "w"): (1, 0, 0.0, 2, 0, 0.0, 1),
        ("a", "x"): (2, 2, 100.0, 2, 0, 0.0, 1),
        ("a", "y"): (None, 0, 0.0, 2, 1, 100.0, 1),
        ("b", "p"): (None, 1, 100.0, 2, 1, 100.0, 1),
    }


def test_crosstab_by_a_number(spark):
    """The column variable keeps its type, and declared levels need no local rows."""
    frame = spark.createDataFrame([("x", 0), ("x", 1), ("y", 1), ("z", 7)], "a string, g int")
    table = op.crosstab(frame, ["a"], "g", {0: "zero", 1: "one"}, {"a": ("x", "w")})
    got = {r["level"]: (r["position"], r["n_zero"], r["n_one"]) for r in table.collect()}
    assert got == {"x": (1, 1, 1), "w": (2, 0, 0), "y": (None, 0, 1)}
    bare = op.crosstab(frame, ["a"], "g", {0: "zero", 1: "one"}, {"a": ()})
    assert {r["level"] for r in bare.collect()} == {"x", "y"}


def test_exposure_columns_are_arguments(spark):
    """The same rows under other names give the same figures under those names."""
    rows = [(1, "d", "5", "mg", 1), (1, "d", "7", "mg", 0), (2, "e", "x", None, 1), (2, "d", "9", "ml", 0), (3, "e", "2", "mg", 0)]
    given = spark.createDataFrame(rows, "hadm_id int, drug string, dose_val_rx string, dose_unit_rx string, in_icu int")
    renamed = spark.createDataFrame(rows, "visit int, agent string, amount string, measure string, within int")
    cols = op.ExposureColumns("agent", "visit", "amount", "measure", "within")
    names = {"drug": "agent", "dose_unit_rx": "measure"}
    for function in (op.top_exposures, op.exposure_detail, op.exposures_with_units, op.dose_by_unit, op.dose_units_used):
        want, got = function(given, 2), function(renamed, 2, cols)
        assert got.columns == [names.get(c, c) for c in want.columns]
        assert got.collect() == want.collect()
    assert op.setting_split(renamed, 2, cols).collect() == op.setting_split(given, 2).collect()
    assert op.exposure_overview(renamed, cols=cols).collect() == op.exposure_overview(given).collect()


def test_unit_totals(spark):
    data = [(1, "d", "5", "mg", 1), (1, "d", "7", "mg", 0), (2, "d", "x", None, 1), (2, "d", "9", "ml", None), (None, "d", "1", "mg", 1), (3, None, "2", "mg", 0)]
    frame = spark.createDataFrame(data, "hadm_id int, drug string, dose_val_rx string, dose_unit_rx string, in_icu int")
    got = {tuple(r)[:3]: tuple(r)[3:] for r in op.unit_totals(frame).collect()}
    assert got == {
        ("d", None, 0): (5, 2, 5.5, 0.75),
        ("d", "mg", 1): (3, 1, 13 / 3, 2 / 3),
        ("d", None, 1): (1, 1, None, 1.0),
        ("d", "ml", 1): (1, 1, 9.0, None),
        (None, None, 0): (1, 1, 2.0, 0.0),
        (None, "mg", 1): (1, 1, 2.0, 0.0),
    }


def test_range_checks(spark):
    frame = spark.createDataFrame([(-1.0, 89), (0.0, 5), (2.0, None), (None, 89)], "d double, age int")
    row = op.range_checks(frame, ["d"], "age", 89).first().asDict()
    assert row == {
        "min_d": -1.0, "max_d": 2.0, "mean_d": 0.3, "negative_d": 1, "with_d": 1, "without_d": 2,
        "min_age": 5, "max_age": 89, "at_cap_age": 2,
    }


def test_nan_is_missing(spark):
    """NaN counts as missing in profiles, as NULL does."""
    df = spark.createDataFrame([(1.0,), (3.0,), (float("nan"),), (None,)], "x double")
    row = op.numeric_profile(df, "x").first()
    assert (row["min"], row["median"], row["max"], row["mean"], row["n"], row["n_missing"]) == (1.0, 2.0, 3.0, 2.0, 2, 2)
    assert op.missing_profile(df).first()["n_missing"] == 2


def test_every_status_label_gets_its_columns():
    from types import SimpleNamespace

    from cohortlens.plans.report import status_suffixes

    config = SimpleNamespace(status_labels={0: "none", 1: "some", 2: "unknown"})
    assert status_suffixes(config) == {"none": "without", "some": "with", "unknown": "s2"}
