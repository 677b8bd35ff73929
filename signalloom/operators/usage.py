"""Ledgers of events: one row each however often delivered, sums by day, running sums and states."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicons as L
from ..sources.tables import beside
from .views import once


def delivered_once(df: DataFrame) -> DataFrame:
    """Events with an id, each once; of several deliveries the earliest."""
    return once(df, "id", [F.col("created_at").asc_nulls_last()])


def daily_spend(usage: DataFrame) -> DataFrame:
    """(day, calls, spend) by UTC day; decimal sums are the same in any order."""
    rows = delivered_once(usage.select("id", "cost_usd", "created_at")).where("created_at is not null")
    return rows.groupBy(F.col("created_at").cast("date").alias("day")).agg(F.count("*").alias("calls"), F.coalesce(F.sum(F.col("cost_usd").cast("decimal(18,8)")), F.lit(0)).cast("decimal(18,8)").cast("double").alias("spend"))


def crossings(usage: DataFrame, cap: float) -> DataFrame:
    """(day, id, spent): the event with which a day's running sum reaches a limit.

    A day is cut into hours first, so that running sums are taken within hours and no task holds a whole day."""
    rows = delivered_once(usage.select("id", "cost_usd", "created_at")).where("created_at is not null and cost_usd is not null")
    rows = rows.select("id", "created_at", F.col("created_at").cast("date").alias("day"), F.hour("created_at").alias("hour"), F.col("cost_usd").cast("decimal(18,8)").alias("c"))
    hours = rows.groupBy("day", "hour").agg(F.sum("c").alias("h"))
    w = Window.partitionBy("day").orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)
    limit = F.lit(cap).cast("decimal(18,8)")
    first = hours.withColumn("to", F.sum("h").over(w)).withColumn("before", F.col("to") - F.col("h")).where((F.col("to") >= limit) & (F.col("before") < limit)).select("day", "hour", F.col("before").cast("decimal(27,8)").alias("before"))
    inside = rows.join(first, ["day", "hour"])
    run = Window.partitionBy("day", "hour").orderBy("created_at", "id").rowsBetween(Window.unboundedPreceding, 0)
    spent = inside.withColumn("spent", F.col("before") + F.sum("c").over(run)).where((F.col("spent") >= limit) & (F.col("spent") - F.col("c") < limit))
    return spent.select("day", "id", F.col("spent").cast("decimal(18,8)").cast("double").alias("spent"))


def feedback_counts(feedback: DataFrame) -> DataFrame:
    """(value, n) of every known feedback value, 0 where there is none; case and blanks don't matter."""
    spark = feedback.sparkSession
    rows = delivered_once(feedback.select("id", "feedback_value", "created_at"))
    counts = rows.groupBy(F.lower(F.trim("feedback_value")).alias("value")).agg(F.count("*").alias("n"))
    known = spark.createDataFrame([(v,) for v in L.FEEDBACK], "value string")
    return known.join(counts, "value", "left").select("value", F.coalesce("n", F.lit(0)).alias("n"))


def usage_by_stage(usage: DataFrame) -> DataFrame:
    rows = delivered_once(usage.select("id", "candidate_stage", "operation", "prompt_tokens", "completion_tokens", "created_at"))
    return rows.groupBy(F.coalesce("candidate_stage", F.lit("none")).alias("stage"), "operation").agg(F.count("*").alias("calls"), F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"), F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("completion_tokens"))


def monitoring_summary(feeds: DataFrame, signals: DataFrame, feedback: DataFrame) -> DataFrame:
    """One row: feeds that are watched, favourites, and known feedback, each event once."""
    watched = feeds.agg(F.count_if(F.col("active") == 1).alias("monitored"))
    liked = signals.agg(F.count_if(F.col("triage_status") == "favorite").alias("favorites"))
    said = feedback_counts(feedback).agg(F.sum("n").alias("feedback_total"))
    return beside(watched, liked, said)
