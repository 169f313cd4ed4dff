"""Queries that run as streams to the end of their input, with the SQL of the batch that must equal them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import windows as streams
from .registry import query

_EVENTS = "{sf}/events.parquet"


def _hours(df):
    return df.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def st_tumble(spark, sf):
    """Counts per hour and type."""
    return _hours(streams.run(spark, _EVENTS.format(sf=sf), streams.tumbling, "complete"))


@query("WITH o AS (SELECT value, date_trunc('hour', ts) - to_hours(j) AS h FROM events, range(0, 4) t(j)) SELECT strftime(h, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, round(sum(value), 4) AS total FROM o GROUP BY 1")
def st_slide(spark, sf):
    """Four hours every hour."""
    return _hours(streams.run(spark, _EVENTS.format(sf=sf), streams.sliding, "complete"))


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g) SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, user_id, count(*) AS n FROM s GROUP BY user_id, s")
def st_session(spark, sf):
    """Sessions of users with a gap of half an hour."""
    return _hours(streams.run(spark, _EVENTS.format(sf=sf), streams.sessions, "complete"))


@query("SELECT event_id, event_type FROM events")
def st_dedup(spark, sf):
    """Each event once."""
    return streams.run(spark, _EVENTS.format(sf=sf), streams.once, "append", watermark=None)


@query("WITH r AS (SELECT user_id, event_id, sum(value) OVER w AS t, count(*) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) SELECT user_id, event_id, round(t, 4) AS total FROM r WHERE c = 4")
def st_ring(spark, sf):
    """Sums over the last four events of each user, from a ring buffer."""
    return streams.run(spark, _EVENTS.format(sf=sf), streams.rings, "append", watermark=None)
