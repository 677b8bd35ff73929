"""Streams over the event tables, run over what is there now, with the SQL of the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import streams


def _events(spark: SparkSession, sf_dir: str, name: str, time: str) -> DataFrame:
    return streams.read_stream(spark, f"{sf_dir}/{name}.parquet", time)


def stream_daily_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = streams.daily_sums(_events(spark, sf_dir, "events", "ts"), "ts", "value")
    return streams.updated(sums, "day", ["n"])


def stream_last_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = streams.last_states(_events(spark, sf_dir, "events", "ts"), "user_id", "ts", "event_type")
    return streams.updated(states, "user_id", ["ts", "event_type"]).select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_type")


def stream_unique_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage events once each, however late their copies are in what is there now."""
    late = streams.lateness(spark.read.parquet(f"{sf_dir}/llm_usage_events.parquet").select("id", "created_at"), "id", "created_at")
    u = _events(spark, sf_dir, "llm_usage_events", "created_at").where("created_at is not null")
    return streams.drained(streams.unique_events(u, "id", "created_at", late).select("id", "model"))


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users that end with a pause of a day, those that later events may still reach left out."""
    found = streams.sessions(_events(spark, sf_dir, "events", "ts").select("user_id", "ts"), "user_id", "ts", "1 day", "0 seconds")
    return streams.drained(found).select("user_id", F.col("start").cast("timestamp_ntz").alias("started"), "n")


def stream_job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' jobs as events come in: an error fails a job, anything else is a success and clears the error."""
    e = _events(spark, sf_dir, "events", "ts")
    runs = e.select("user_id", F.unix_micros("ts").alias("at"), F.when(F.col("event_type") == "error", "failed").otherwise("done").alias("state"), F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("error"))
    return streams.kept(runs, lambda old, new: streams.status_of(old, new, "user_id", "at", "state")).select("user_id", "state", "error")


def stream_merged_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of posts as they come in, late or again: of each post the earliest document."""
    docs = _events(spark, sf_dir, "documents", "fetched_at").where("post_id is not null and fetched_at is not null").select("post_id", "doc_id", (-F.unix_micros("fetched_at")).alias("age"), (-F.col("doc_id")).alias("no"))
    return streams.updated(docs, "post_id", ["age", "no"]).select("post_id", "doc_id")


QUERIES = {f.__name__: f for f in (stream_daily_sums, stream_last_states, stream_unique_usage, stream_sessions, stream_job_states, stream_merged_signals)}
ORACLE = {
    "stream_daily_sums": "SELECT CAST(ts AS DATE) AS day, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total FROM events GROUP BY 1",
    "stream_last_states": "SELECT user_id, (max((ts, event_type)))[1] AS ts, (max((ts, event_type)))[2] AS event_type FROM events GROUP BY 1",
    "stream_sessions": """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 1 DAY THEN 0 ELSE 1 END AS new FROM events),
        s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM e)
        SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, no HAVING max(ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events)""",
    "stream_job_states": """WITH e AS (SELECT *, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'done' END AS state FROM events), l AS (SELECT user_id, max((epoch_us(ts), state)) AS m FROM e GROUP BY 1)
        SELECT l.user_id, (m)[2] AS state, CASE WHEN (m)[2] = 'failed' THEN concat('event ', max(event_id)) END AS error FROM l JOIN e ON e.user_id = l.user_id AND epoch_us(e.ts) = (m)[1] AND e.state = (m)[2] GROUP BY l.user_id, m""",
    "stream_merged_signals": "SELECT post_id, arg_min(doc_id, (fetched_at, doc_id)) AS doc_id FROM documents WHERE post_id IS NOT NULL AND fetched_at IS NOT NULL GROUP BY 1",
    "stream_unique_usage": "SELECT DISTINCT id, model FROM llm_usage_events WHERE created_at IS NOT NULL",
}
