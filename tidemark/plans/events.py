"""Event-time windows on batch tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import windows
from .registry import query


@query("""SELECT event_type, strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H:%M') AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def tumbling_windows(t):
    w = windows.tumbling(t.events, "ts", "6 hours", ["event_type"], "value")
    return w.select("event_type", F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n", F.round("total", 4).alias("total"))


@query("""WITH w AS (SELECT event_type, value, unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS s FROM events) SELECT event_type, strftime(s, '%Y-%m-%d %H:%M') AS start, count(*) AS n, round(avg(value), 6) AS mean FROM w GROUP BY 1, 2""")
def sliding_windows(t):
    w = windows.sliding(t.events, "ts", "12 hours", "6 hours", ["event_type"], "value")
    return w.select("event_type", F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n", F.round("mean", 6).alias("mean"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(t):
    return windows.sessions(t.events, "ts", "2 hours", ["user_id"]).select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")
