import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import collections as coll
from tallyframe.functions import dates, numbers, text


def one(spark, column, value, kind):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("r")).first()["r"]


def test_sunday_week_matches_strftime(spark):
    days = [dt.date(1999, 1, 1) + dt.timedelta(days=i) for i in range(0, 12000, 3)]
    df = spark.createDataFrame([(d,) for d in days], "d date").select("d", dates.sunday_week(F.col("d")).alias("w"))
    assert all(r["w"] == int(r["d"].strftime("%U")) for r in df.collect())


@pytest.mark.parametrize(
    "day,expected",
    [("2020-12-31", 202052), ("2021-01-01", 202052), ("2021-01-02", 202052), ("2021-01-03", 202101), ("2023-01-01", 202301)],
)
def test_sunday_year_week(spark, day, expected):
    assert one(spark, dates.sunday_year_week, dt.date.fromisoformat(day), "date") == expected


def test_age_and_days_left(spark):
    born = dt.date(2002, 12, 28)
    age = lambda c: dates.age_text(c, F.lit("2026-12-01").cast("date"))
    assert one(spark, age, born, "date") == "23 years, 11 months, 3 days"
    assert one(spark, dates.days_left_in_year, dt.date(2024, 12, 1), "date") == 30


@pytest.mark.parametrize(
    "written,expected",
    [("03/04/2024", dt.date(2024, 4, 3)), ("3-4-2024", dt.date(2024, 4, 3)), ("31/02/2024", None), ("soon", None), (None, None)],
)
def test_parse_day_first(spark, written, expected):
    parsed = one(spark, dates.parse_day_first, written, "string")
    assert (parsed.date() if parsed else None) == expected


def test_text_functions(spark):
    assert one(spark, text.letter_group, "mia", "string") == "Group A-M"
    assert one(spark, text.letter_group, "9x", "string") == "other"
    assert one(spark, text.domain_of, "ann@mail.example.org", "string") == "mail.example.org"
    assert one(spark, text.top_level_domain, "ann@mail.example.org", "string") == "org"
    assert one(spark, lambda c: text.char_occurrences(c, "A"), "Banana", "string") == 3
    assert one(spark, lambda c: text.substring_occurrences(c, "a.b"), "a.b axb a.b", "string") == 2
    assert one(spark, lambda c: text.find_first(c, "z"), "abc", "string") == -1
    assert one(spark, lambda c: text.split_labels(c), "A, B", "string") == ["A", "B"]
    assert one(spark, text.is_title, "Hello World", "string") is True
    for value in ("Ab-cd", "Ab-Cd", "O'Neil", "ABc", "a", "1A", "A1b", ""):
        assert one(spark, text.is_title, value, "string") is value.istitle()
    assert one(spark, text.is_palindrome, "Level", "string") is False
    assert one(spark, text.is_present, "  ", "string") is False
    assert one(spark, lambda c: text.matches_like(c, "J%"), "jo", "string") is False
    assert one(spark, lambda c: text.matches_like(c, "J%", ci=True), "jo", "string") is True


def test_number_functions(spark):
    clip = lambda c: numbers.clip(c, F.lit(0.0), F.lit(1.0))
    assert one(spark, clip, None, "double") is None and one(spark, clip, 7.0, "double") == 1.0
    assert one(spark, lambda c: numbers.xor_int(c, 3), 4.6, "double") == 6
    cut = lambda c: numbers.bin_right_closed(c, [0, 1.5, 2.5], ["low", "high"])
    assert [one(spark, cut, v, "double") for v in (0.0, 1.5, 1.6, 3.0)] == [None, "low", "high", None]
    assert one(spark, numbers.leap_label, 1900, "int") == "Not a Leap Year"
    assert one(spark, lambda c: numbers.ratio(c, F.lit(0)), 1, "int") is None


def test_collection_functions(spark):
    df = spark.createDataFrame([({"a": 1}, [0, 1, 0, 3], [[1, 2], [3]])], "m map<string,int>, x array<int>, n array<array<int>>")
    got = df.select(
        coll.map_put(F.col("m"), F.lit("a"), F.lit(5)).alias("put"),
        coll.map_remove(F.col("m"), F.lit("a")).alias("removed"),
        coll.zeros_last(F.col("x")).alias("z"),
        coll.nested_at(F.col("n"), 1, 2).alias("found"),
        coll.nested_at(F.col("n"), 9, 2).alias("lost"),
        coll.squares(F.lit(0)).alias("none"),
    ).first()
    assert got.asDict() == {"put": {"a": 5}, "removed": {}, "z": [1, 3, 0, 0], "found": 2, "lost": None, "none": []}
