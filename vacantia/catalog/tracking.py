"""Tracking: W17-W19, S24, X7's batch rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from vacantia.catalog import tables as D
from vacantia.catalog.registry import query
from vacantia.operators import tracking as K


def _apps(spark, d):
    return K.application_state(D.app_events(spark, d))


_NOW = "TIMESTAMP '2024-01-31'"
_DAYS = "floor(date_diff('millisecond', {c}, " + _NOW + ") / 86400000)::BIGINT"


@query("follow_ups", D.with_ctes(D.APPS) + f"""SELECT candidate_id, posting_id, {_DAYS.format(c='sent_at')} AS days_quiet FROM apps
  WHERE status = 'APPLIED' AND sent_at < {_NOW} - INTERVAL 14 DAY""")
def follow_ups(spark, d):
    return K.follow_ups(_apps(spark, d), D.ts(D.EVENTS_NOW)).select("candidate_id", "posting_id", "days_quiet")


@query("follow_up_due", D.with_ctes(D.APPS) + f"""SELECT candidate_id, posting_id, {_DAYS.format(c='updated_at')} AS days FROM apps
  WHERE status = 'APPLIED' AND {_DAYS.format(c='updated_at')} >= 7""")
def follow_up_due(spark, d):
    return K.follow_up_due(_apps(spark, d), D.ts(D.EVENTS_NOW)).select("candidate_id", "posting_id", "days")


@query("quiet_flag", D.with_ctes(D.APPS) + f"""SELECT candidate_id, posting_id, status = 'APPLIED' AND coalesce(sent_at < {_NOW} - INTERVAL 14 DAY, false) AS quiet FROM apps""")
def quiet_flag(spark, d):
    return _apps(spark, d).select("candidate_id", "posting_id", K.quiet_flag(D.ts(D.EVENTS_NOW)).alias("quiet"))


@query("retention_sweep", """SELECT o_orderkey, o_orderdate + INTERVAL 24 MONTH AS expires_at, o_orderdate + INTERVAL 24 MONTH <= TIMESTAMP '2001-08-02' AS expired
  FROM orders WHERE o_orderstatus = 'F'""")
def retention_sweep(spark, d):
    sent = D.read(spark, d, "orders").where(F.col("o_orderstatus") == "F").select("o_orderkey", F.col("o_orderdate").alias("sent_at"))
    return K.retention_sweep(sent, D.now()).select("o_orderkey", "expires_at", "expired")


@query("requests_over_limit", """SELECT date_trunc('minute', ts) AS minute, user_id, count(*) AS n FROM (SELECT ts, user_id FROM events
  UNION ALL SELECT ts, user_id FROM events WHERE event_type IN ('click', 'error')) GROUP BY 1, 2 HAVING count(*) > 1""")
def requests_over_limit(spark, d):
    e = D.read(spark, d, "events")
    both = e.select("ts", "user_id").unionByName(e.where(F.col("event_type").isin("click", "error")).select("ts", "user_id"))
    return K.requests_over_limit(both, 1)
