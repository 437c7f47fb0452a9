"""Event windows as batch queries; ``streaming.scores`` runs the same plans on streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import scores
from .registry import query, table


@query("ext_windowed_rates", "SELECT epoch(date_trunc('hour', ts))::BIGINT AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS highest FROM events GROUP BY ALL")
def windowed_rates(spark, sf_dir):
    w = scores.windowed_rates(table(spark, sf_dir, "events"))
    return w.select(F.unix_timestamp("start").alias("start"), "event_type", "n", F.round("mean", 6).alias("mean"), "highest")


@query("ext_sessions", "WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS first FROM events), g AS (SELECT user_id, ts, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM o) SELECT user_id, count(*) AS n FROM g GROUP BY user_id, s")
def sessions(spark, sf_dir):
    return scores.sessions(table(spark, sf_dir, "events"), "user_id").select("user_id", "n")
