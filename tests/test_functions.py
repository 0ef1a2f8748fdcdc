from datetime import datetime

import pytest
from pyspark.sql import functions as F

from stormlake.functions.names import name_matches, normal_name
from stormlake.functions.text import clean_sections, link_filename, stable_bucket, tokens
from stormlake.functions.times import (
    lenient_time,
    observation_date,
    observation_time,
    tokyo_time,
)


def evaluate(spark, expression, value):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "link, expected",
    [("http://x/a/b.xml", "b.xml"), ("/v/b.xml", "b.xml"), ("b.xml", "b.xml"), ("http://x/a/", "a"), ("", "")],
)
def test_link_filename(spark, link, expected):
    assert evaluate(spark, link_filename, link) == expected


def test_clean_sections(spark):
    text = "A b .\nc.\n\n d  .e\nf \n \n\ng"
    assert evaluate(spark, clean_sections, text) == "A b.c.\nd .ef \ng"


def test_stable_bucket(spark):
    for text in ("", "abc", "台風 10", "Customer#000000001"):
        assert evaluate(spark, stable_bucket, text) == sum(map(ord, text)) % 9 + 1


def test_tokens(spark):
    assert evaluate(spark, tokens, " Été-2024, 台風! ") == ["été", "2024", "台風"]
    assert evaluate(spark, tokens, "--") == []


@pytest.mark.parametrize(
    "text, date, time",
    [
        ("2024-08-28T13:00:00+09:00", "2024-08-28", "13:00:00"),
        ("2024-08-28T13:00:00Z", "2024-08-28", "13:00:00"),
        ("2024-08-28T13:00", "2024-08-28", "13:00:00"),
        ("2024-08-28", "2024-08-28", "00:00:00"),
        ("2024-08-28T13:00:00.500000", "2024-08-28", "13:00:00.500000"),
        ("2024-02-30T13:00:00+09:00", "Unknown", "Unknown"),
        ("2024", "Unknown", "Unknown"),
        ("", "Unknown", "Unknown"),
        (None, "Unknown", "Unknown"),
    ],
)
def test_date_and_time_of_observation(spark, text, date, time):
    assert evaluate(spark, observation_date, text) == date
    assert evaluate(spark, observation_time, text) == time


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Tokyo"])
@pytest.mark.parametrize(
    "text, expected",
    [
        ("2024-03-10T02:30:00+09:00", datetime(2024, 3, 10, 2, 30)),
        ("2024-03-10T02:30:00Z", datetime(2024, 3, 10, 11, 30)),
        ("2024-11-03T01:30:00-05:00", datetime(2024, 11, 3, 15, 30)),
        ("2024-03-10T02:30:00", None),
        ("2024-03-10 02:30:00+09:00", None),
        ("2024-03-10T02:30:00+19:00", None),
        ("noon", None),
        (None, None),
    ],
)
def test_tokyo_time_in_any_session_zone(spark, zone, text, expected):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert evaluate(spark, tokyo_time, text) == expected
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2024-08-28", datetime(2024, 8, 28)),
        ("2024-08-28T13:05:06", datetime(2024, 8, 28, 13, 5, 6)),
        ("None", None), ("''", None), ("", None), ("2024-02-30", None),
        ("2024-08-28T24:00:00", None), ("2024-08-28 13:00:00", None), ("0000-01-01", None), (None, None),
    ],
)
def test_lenient_time(spark, text, expected):
    assert evaluate(spark, lenient_time, text) == expected


def test_normal_name(spark):
    assert evaluate(spark, normal_name, " typhoon Kong rey\t") == "KONG REY"


@pytest.mark.parametrize(
    "storm, wanted, expected",
    [
        ("KONG-REY", "KONG-REY", True), ("KONG-REY", "KONGREY", True), ("KONG-REY", "KONG REY", True),
        ("KONG-REY", "KONG", True), ("KONG-REY", "REY", True), ("KONG-REY", "GREY", True),
        ("KONG-REY", "", True), ("KONG-REY", "KONG_REY", False), ("KONG-REY", "REYES", False),
        (None, "", None),
    ],
)
def test_name_matches(spark, storm, wanted, expected):
    frame = spark.createDataFrame([(storm, wanted)], "s string, w string")
    assert frame.select(name_matches(F.col("s"), F.col("w")).alias("y")).first().y == expected
