"""Column expressions against plain Python."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from cohortlens import functions as fn


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(name) for name, c in columns.items()]).first()


def ntz(text):
    return F.lit(text).cast("timestamp_ntz")


def years_between(born: datetime, then: datetime) -> int:
    def forward(a, b):
        early = (b.month, b.day, b.time()) < (a.month, a.day, a.time())
        return b.year - a.year - early

    return forward(born, then) if then >= born else -forward(then, born)


def test_full_years_matches_the_calendar(spark):
    rng = random.Random(7)
    start = datetime(1890, 1, 1)
    moment = lambda: start + timedelta(days=rng.randrange(60000), seconds=rng.choice([0, 0, rng.randrange(86400)]))
    pairs = [(moment(), moment()) for _ in range(3000)]
    for born, then in list(pairs[:1000]):
        try:
            pairs.append((born, born.replace(year=born.year + 30)))
            pairs.append((born, born.replace(year=born.year + 30) - timedelta(microseconds=1)))
        except ValueError:
            pairs.append((born, datetime(born.year + 30, 2, 28)))
    frame = spark.createDataFrame(pairs, "born timestamp_ntz, then timestamp_ntz")
    for born, then, years in frame.select("born", "then", fn.full_years("born", "then")).collect():
        assert years == years_between(born, then), (born, then)


def test_full_years_cap_keeps_missing(spark):
    got = one(
        spark,
        old=fn.full_years(ntz("1850-01-01"), ntz("2020-01-01"), 89),
        at_cap=fn.full_years(ntz("1930-01-02"), ntz("2020-01-01"), 89),
        missing=fn.full_years(F.lit(None).cast("timestamp_ntz"), ntz("2020-01-01"), 89),
    )
    assert tuple(got) == (89, 89, None)


def test_elapsed_time_ignores_the_session_zone(spark):
    # clocks in the session zone skip 02:00-03:00 on this day
    got = one(
        spark,
        gap=fn.elapsed_seconds(ntz("2020-03-08 01:30:00"), ntz("2020-03-08 02:30:00")),
        day=fn.elapsed_days(ntz("2020-03-07 12:00:00"), ntz("2020-03-08 12:00:00")),
        part=fn.elapsed_seconds(ntz("2020-03-08 01:30:00"), ntz("2020-03-08 01:30:00.25")),
        zero=fn.elapsed_days(ntz("2020-01-01"), ntz("2020-01-01")),
        reversed=fn.elapsed_days(ntz("2020-01-02"), ntz("2020-01-01")),
        open=fn.elapsed_days(ntz("2020-01-02"), F.lit(None).cast("timestamp_ntz")),
    )
    assert (float(got.gap), got.day, float(got.part)) == (3600.0, 1.0, 0.25)
    assert (got.zero, got.reversed, got.open) == (0.0, None, None)


def test_fixed_point_rounds_like_printf(spark):
    numbers = [m / 20 for m in range(-200, 2000)] + [i / 3 for i in range(100)] + [n / 96 for n in range(500)]
    rng = random.Random(1)
    numbers += [rng.uniform(-50, 5000) for _ in range(500)]
    frame = spark.createDataFrame([(float(x),) for x in numbers], "x double")
    for x, text in frame.select("x", fn.fixed_point("x")).collect():
        assert text == "%.1f" % x or (x <= 0 and float(text) == 0 == float("%.1f" % x)), x


def test_presentation_text(spark):
    nothing = F.lit(None).cast("double")
    got = one(
        spark,
        spread=fn.median_iqr_text(F.lit(1.5), F.lit(3.0), F.lit(4.25)),
        empty=fn.median_iqr_text(nothing, nothing, nothing),
        cell=fn.count_percent(F.lit(3), F.lit(12.5)),
    )
    assert tuple(got) == ("3.0 (1.5–4.2)", None, "3 (12.5%)")


def test_title_case(spark):
    words = {
        "acetaminophen-codeine D5W": "Acetaminophen-Codeine D5w",
        "0.9% SODIUM chloride": "0.9% Sodium Chloride",
        "st. john's WORT": "St. John's Wort",
        "NS (iso)": "Ns (Iso)",
        "a  b": "A  B",
        "émile": "Émile",
        "two\nlines": "Two\nLines",
        "": "",
    }
    frame = spark.createDataFrame([(w,) for w in words], "w string")
    assert dict(tuple(r) for r in frame.select("w", fn.title_case("w")).collect()) == words
    assert one(spark, none=fn.title_case(F.lit(None).cast("string"))).none is None


def test_recoding(spark):
    patterns = (("%WHITE%", "White"), ("%HISPANIC%", "Hispanic"))
    nothing = F.lit(None).cast("string")
    got = one(
        spark,
        first=fn.bucket_text(F.lit("hispanic/white"), patterns, "Other"),
        default=fn.bucket_text(nothing, patterns, "Other"),
        no_pattern=fn.bucket_text(F.lit("x"), (), "Other"),
        low=fn.bin_numeric(F.lit(17), (18, 60), ("a", "b", "c")),
        edge=fn.bin_numeric(F.lit(18), (18, 60), ("a", "b", "c")),
        last=fn.bin_numeric(F.lit(None).cast("int"), (18, 60), ("a", "b", "c")),
        null=fn.bin_numeric(F.lit(None).cast("int"), (18, 60), ("a", "b", "c"), "null"),
        known=fn.code_labels(F.lit(1), {0: "no", 1: "yes"}),
        unknown=fn.code_labels(F.lit(2), {0: "no", 1: "yes"}),
        level=fn.keep_levels(F.lit("M"), ("F", "M")),
        off_level=fn.keep_levels(F.lit("U"), ("F", "M")),
        rank=fn.level_rank(F.lit("M"), ("F", "M")),
        no_rank=fn.level_rank(F.lit("U"), ("F", "M")),
    )
    assert tuple(got) == (
        "White", "Other", "Other", "a", "b", "c", None, "yes", None, "M", None, 2, None,
    )


def test_numbers_from_text(spark):
    texts = [("20", 20.0), (" 1.5 ", 1.5), ("1-2", None), ("NaN", None), ("", None), (None, None)]
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "i int, t string")
    got = [r[1] for r in frame.select("i", fn.number_from_text("t")).orderBy("i").collect()]
    assert got == [number for _, number in texts]
