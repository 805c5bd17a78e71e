"""Queries: event windows (an extension), here over the batch table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.plans import kit as K
from lexloom.streaming import live


def _events(spark: SparkSession, d: str) -> DataFrame:
    return K.table(spark, d, "events").select("ts", "user_id", "event_type", "value")


def event_days(spark: SparkSession, d: str) -> DataFrame:
    return live.tumbling(_events(spark, d)).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("mean", 9).alias("mean"))


def event_slides(spark: SparkSession, d: str) -> DataFrame:
    return live.sliding(_events(spark, d)).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "n", F.round("mean", 9).alias("mean"))


def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    return live.sessions(_events(spark, d)).groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.max("n").alias("longest"))


QUERIES = {"event_days": event_days, "event_slides": event_slides, "event_sessions": event_sessions}
SQL = {
    "event_days": "select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, event_type, count(*) as n, round(avg(value), 9) as mean from events group by all",
    # a two-day window starts on each day and holds it and the next; windows are aligned to the epoch
    "event_slides": "with e as (select date_trunc('day', ts) as day, value from events), w as (select day, value from e union all select day - interval 1 day, value from e) select strftime(day, '%Y-%m-%d') as day, count(*) as n, round(avg(value), 9) as mean from w group by 1",
    "event_sessions": "with o as (select user_id, ts, case when ts - lag(ts) over w < interval 6 hour then 0 else 1 end as new from events window w as (partition by user_id order by ts)), s as (select user_id, sum(new) over (partition by user_id order by ts rows unbounded preceding) as s from o), c as (select user_id, s, count(*) as n from s group by all) select user_id, count(*) as n_sessions, max(n) as longest from c group by user_id",
}
