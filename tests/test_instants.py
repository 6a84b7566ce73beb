"""Every format of the cascade, the local-time policies and the values that are no time."""

import datetime as dt
from zoneinfo import ZoneInfo

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from apothecary.functions.instants import parse_instant

NY = "America/New_York"


def us(*args):
    return int(dt.datetime(*args, tzinfo=dt.timezone.utc).timestamp()) * 1_000_000


def parse(spark, texts, **policy):
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "i int, v string, instant string")
    out = parse_instant(rows, "v", NY, **policy).orderBy("i").collect()
    assert [r["instant"] for r in out] == ["x"] * len(texts)
    return out


def test_formats(spark):
    cases = {
        "20240318": us(2024, 3, 18, 4), "08/17/2021": us(2021, 8, 17, 4), "4/8/2026": us(2026, 4, 8, 4), "07-14-2025": us(2025, 7, 14, 4), "05/27/24": us(2024, 5, 27, 4),
        "13.04.2026": us(2026, 4, 13, 4), "2017-08-19": us(2017, 8, 19, 4), "2025-10-05T17:04:38Z": us(2025, 10, 5, 17, 4, 38), "2020-03-10 12:07": us(2020, 3, 10, 16, 7),
        "2015-09-26T13:51:42.947906563+0530": us(2015, 9, 26, 8, 21, 42) + 947906, "2022-06-09T15:18:28.931-04:00": us(2022, 6, 9, 19, 18, 28) + 931000,
        "20260205T151204Z": us(2026, 2, 5, 15, 12, 4), "1770886480": 1770886480000000, "1619136999167": 1619136999167000, "01/14/2026 05:35 AM": us(2026, 1, 14, 10, 35),
        "12/12/2020 12:00 AM CDT": us(2020, 12, 12, 5), "12/12/2020 12:30 PM EST": us(2020, 12, 12, 17, 30), "22.06.2023 21:12 CEST": us(2023, 6, 22, 19, 12), "2019-01-26 22:00:58 Asia/Tokyo": us(2019, 1, 26, 13, 0, 58),
        "2019-01-26 22:00:58 America/New_York": us(2019, 1, 27, 3, 0, 58), "2017-07-02 12:23:30 America/Los_Angeles": us(2017, 7, 2, 19, 23, 30), "01/02/2020 03:04PM America/Chicago": us(2020, 1, 2, 21, 4), "13-Apr-2026": us(2026, 4, 13, 4), "April 6, 2018": us(2018, 4, 6, 4), "Thu, 23 Apr 2026 00:27:25 GMT": us(2026, 4, 23, 0, 27, 25), "\t03/18/2026  ": us(2026, 3, 18, 4),
    }
    for row, (text, want) in zip(parse(spark, cases), cases.items()):
        assert row["instant_us"] == want, text


def test_no_instants(spark):
    bad = [None, "", "  ", "TBD", "20231301", "02/30/2020", "12/25/2025 24:55", "12/25/2025 13:00 PM", "2019-01-26 22:00:58 Foo/Bar", "2020-01-01T00:00:00+99:00", "2020-01-01 x", "123456789", "1" * 100_000]
    assert {r["instant_us"] for r in parse(spark, bad)} == {None}


def test_policies(spark):
    twice, never = "2021-11-07 01:30:00", "2021-03-14 02:30:00"
    a, b = parse(spark, [twice, never])
    assert (a["instant_us"], a["instant_case"], b["instant_us"], b["instant_case"]) == (us(2021, 11, 7, 5, 30), "ambiguous", us(2021, 3, 14, 7, 30), "nonexistent")
    a, b = parse(spark, [twice, never], ambiguous="later", nonexistent="reject")
    assert (a["instant_us"], b["instant_us"]) == (us(2021, 11, 7, 6, 30), None)
    (a,) = parse(spark, [twice], ambiguous="reject")
    assert a["instant_us"] is None


def test_session_zone_plays_no_role(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    try:
        assert parse(spark, ["08/17/2021"])[0]["instant_us"] == us(2021, 8, 17, 4)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.datetimes(dt.datetime(1990, 1, 1), dt.datetime(2037, 1, 1)), min_size=1, max_size=60))
def test_against_zoneinfo(spark, times):
    times = [t.replace(microsecond=0) for t in times]
    rows = spark.createDataFrame([(i, t.strftime("%m/%d/%Y %I:%M %p")) for i, t in enumerate(times)], "i int, v string")
    got = [r["instant_us"] for r in parse_instant(rows, "v", NY).orderBy("i").select("instant_us").collect()]
    want = []
    for t in times:
        t = t.replace(second=0, tzinfo=ZoneInfo(NY), fold=0)
        want.append(int((t.replace(tzinfo=None) - t.utcoffset() - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000)
    assert got == want


def test_empty(spark):
    assert parse_instant(spark.createDataFrame([], "v string"), "v", F.lit(NY)).count() == 0
