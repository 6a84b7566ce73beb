"""Queries over the events stream in their batch form, with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from apothecary.sources.tables import table
from apothecary.streaming import arrivals


def _micros(c: str):
    """Microseconds of a wall-clock time that means UTC, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {c})")


def event_windows(spark, d):
    return arrivals.event_windows(table(spark, d, "events")).withColumn("window_start", _micros("window_start"))


def event_sessions(spark, d):
    out = arrivals.sessions(table(spark, d, "events"))
    return out.select("user_id", _micros("session_start").alias("session_start"), _micros("session_end").alias("session_end"), "n")


QUERIES = {"event_windows": event_windows, "event_sessions": event_sessions}
SQL = {
    "event_windows": """select epoch_us(time_bucket(interval 1 hour, ts)) as window_start, event_type, count(*) as n, round(sum(value), 6) as total
from (select distinct on (event_id) * from events where ts is not null and event_id is not null) group by 1, 2""",
    "event_sessions": """with o as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) <= interval 30 minutes then 0 else 1 end as s from events where ts is not null and user_id is not null),
g as (select user_id, ts, sum(s) over (partition by user_id order by ts rows unbounded preceding) as k from o)
select user_id, epoch_us(min(ts)) as session_start, epoch_us(max(ts) + interval 30 minutes) as session_end, count(*) as n from g group by user_id, k""",
}
