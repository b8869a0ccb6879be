"""Queries through Structured Streaming."""

from __future__ import annotations

from ..functions.paths import work_path
from ..streaming import flows as S


def stream_class_windows(spark, sf):
    """Daily counts and sums of every class, read as a stream: days that the watermark has passed."""
    return S.run_once(S.class_windows(S.read_events(spark, sf)), work_path(spark, "stream"))


def stream_sessions(spark, sf):
    """Sessions of every user with pauses of half a day at most, read as a stream: those that the watermark has passed."""
    return S.run_once(S.flow_sessions(S.read_events(spark, sf)), work_path(spark, "stream"))


SQL = {
    "stream_class_windows": "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type AS class, count(*) AS packets, round(sum(value), 4) AS total FROM events GROUP BY 1, 2 HAVING any_value(date_trunc('day', ts)) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR",
    "stream_sessions": """SELECT user_id, min(ts) AS start, count(*) AS packets FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s HAVING max(ts) + INTERVAL 12 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR""",
}
QUERIES = {f.__name__: f for f in (stream_class_windows, stream_sessions)}
