import datetime as dt
import hashlib
import sys

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from gritsieve.functions import cells


def one(spark, fn, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").coalesce(1)
    return [r["x"] for r in df.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


def test_blanks_are_what_python_strips():
    blank = {chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace()}
    assert set(cells.BLANKS) == blank


def test_norm(spark):
    assert one(spark, cells.norm, " Lagos ", "\tYES ", None) == ["lagos", "yes", None]


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet=st.sampled_from("aB \t 　x-"), max_size=6), min_size=30, max_size=60))
def test_norm_is_pythons(spark, texts):
    assert one(spark, cells.norm, *texts) == [t.strip().lower() for t in texts]


def test_number(spark):
    got = one(spark, cells.number, " 12 ", "12d", "1_000", "1,314", "0x1A", "-.5", "1e3", "NaN", "", "inf", " 5", None)
    assert got == [12.0, None, None, None, None, -0.5, 1000.0, None, None, float("inf"), None, None]


def test_name_tokens(spark):
    got = one(spark, cells.name_tokens, "respondentName", "e_mail-x", "Q7/part.one")
    assert got == ["respondent name", "e mail x", "q7 part one"]


@pytest.mark.parametrize("value", ["1999-12-31", "7.5.2014", "Feb 9", "30/6/08", "2031 Sep 4th"])
def test_dates_look_like_dates(spark, value):
    assert one(spark, cells.looks_like_date, value) == [True]


@pytest.mark.parametrize("value", ["8", "2.75", "6.02e23", "5/8", "1,000.50", "v1.4", "+44", "January"])
def test_numbers_do_not_look_like_dates(spark, value):
    assert one(spark, cells.looks_like_date, value) == [False]


def test_parsed_date(spark):
    texts = [
        "2026-03-01", "01/03/2026", "13/04/2026", "15-03-2026", "2026/03/20", "15-Mar-2026", "3 January 2026",
        "March 3, 2026", "2026-03-01T10:11:12Z", "1/2/26", "20260301", "2026", "1/2/2026 3:04 PM", "1/2/2026 12:04 am",
        "49", "75.1", "110/79", "2026-02-30", "nonsense", "",
    ]
    month_first = [
        dt.datetime(2026, 3, 1), dt.datetime(2026, 1, 3), dt.datetime(2026, 4, 13), dt.datetime(2026, 3, 15),
        dt.datetime(2026, 3, 20), dt.datetime(2026, 3, 15), dt.datetime(2026, 1, 3), dt.datetime(2026, 3, 3),
        dt.datetime(2026, 3, 1, 10, 11, 12), dt.datetime(2026, 1, 2), dt.datetime(2026, 3, 1), dt.datetime(2026, 1, 1),
        dt.datetime(2026, 1, 2, 15, 4), dt.datetime(2026, 1, 2, 0, 4), None, None, None, None, None, None,
    ]
    assert one(spark, cells.parsed_date, *texts) == month_first
    day_first = one(spark, lambda c: cells.parsed_date(c, dayfirst=True), *texts)
    assert day_first[:3] == [dt.datetime(2026, 3, 1), dt.datetime(2026, 3, 1), dt.datetime(2026, 4, 13)]


def test_hash_prefix(spark):
    assert one(spark, cells.hash_prefix, "Ann O'Hara", None) == [hashlib.sha256(b"Ann O'Hara").hexdigest()[:12], None]
