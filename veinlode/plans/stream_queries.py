"""Queries of the streaming operators, each run to its end over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import table
from ..streaming import streams as st
from .registry import query


def events(spark: SparkSession, d: str) -> DataFrame:
    path = f"{d}/events.parquet"
    return st.read(spark, path, spark.read.parquet(path)).withColumn("ts", F.col("ts").cast("timestamp"))


def naive(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


CLOSED = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


@query(f"""SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2
HAVING time_bucket(INTERVAL 6 HOUR, any_value(ts), TIMESTAMP '1970-01-01') + INTERVAL 6 HOUR <= {CLOSED}""")
def st_tumbling_window(spark: SparkSession, d: str) -> DataFrame:
    out = st.drain(st.tumbling(events(spark, d), "ts", "1 hour", "6 hours", "event_type"))
    return naive(out, "start").withColumn("total", F.round("total", 4))


@query(f"""WITH w AS (SELECT unnest([time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 6 HOUR, ts - INTERVAL 6 HOUR, TIMESTAMP '1970-01-01')]) AS start, event_type, value FROM events)
SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY 1, 2 HAVING start + INTERVAL 12 HOUR <= {CLOSED}""")
def st_sliding_window(spark: SparkSession, d: str) -> DataFrame:
    out = st.drain(st.tumbling(events(spark, d), "ts", "1 hour", "12 hours", "event_type", "6 hours"))
    return naive(out, "start").withColumn("total", F.round("total", 4))


@query(f"""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS end_ts, user_id, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 2 HOUR <= {CLOSED}""")
def st_session_window(spark: SparkSession, d: str) -> DataFrame:
    out = st.drain(st.sessions(events(spark, d), "ts", "1 hour", "2 hours", "user_id"))
    return naive(out.withColumnRenamed("end", "end_ts"), "start", "end_ts")


@query("SELECT event_type, count(*) AS n FROM events WHERE value > 50 GROUP BY 1")
def st01_filtered_counts(spark: SparkSession, d: str) -> DataFrame:
    return st.drain(events(spark, d).where("value > 50").groupBy("event_type").agg(F.count("*").alias("n")), "complete")


@query("SELECT event_id, event_type FROM events")
def st02_deduplicated(spark: SparkSession, d: str) -> DataFrame:
    twice = events(spark, d).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return st.drain(st.once(twice, "event_id", "ts", "1 hour")).select("event_id", "event_type")


@query(f"""SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS n FROM events GROUP BY 1 HAVING time_bucket(INTERVAL 1 DAY, any_value(ts)) + INTERVAL 1 DAY <= {CLOSED}""")
def st03_complete_windows(spark: SparkSession, d: str) -> DataFrame:
    return naive(st.drain(st.complete_until(events(spark, d), "ts", "1 hour", "1 day")), "start")


@query("""WITH s AS (SELECT event_id AS sample_id, user_id, ts FROM events WHERE event_type = 'purchase'), e AS (SELECT user_id, ts AS event_at FROM events WHERE event_type = 'signup'),
j AS (SELECT sample_id, s.ts, event_at FROM s LEFT JOIN e ON e.user_id = s.user_id AND event_at > s.ts AND event_at <= s.ts + INTERVAL 12 HOUR)
SELECT sample_id, event_at FROM j WHERE event_at IS NOT NULL""")
def st06_observed_outcomes(spark: SparkSession, d: str) -> DataFrame:
    samples = events(spark, d).where("event_type = 'purchase'").select(F.col("event_id").alias("sample_id"), "user_id", F.col("ts").alias("at"))
    found = events(spark, d).where("event_type = 'signup'").select("user_id", F.col("ts").alias("event_at"))
    out = st.drain(st.censored(samples, found, "user_id", "12 HOURS", "1 hour"))
    return naive(out.where("event_at IS NOT NULL").select("sample_id", "event_at"), "event_at")


@query("""WITH x AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN text END AS v FROM conversations)
SELECT conv_id, turn, last_value(nullif(v, '') IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS context FROM x""")
def st08_whole_context(spark: SparkSession, d: str) -> DataFrame:
    path = f"{d}/conversations.parquet"
    stream = st.read(spark, path, table(spark, d, "conversations"))
    rows = stream.select("conv_id", "turn", F.when(F.col("role") == "user", F.col("text")).alias("v"))
    return st.drain(st.carried_context(rows, "conv_id", "turn", "v"))
