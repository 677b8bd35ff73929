"""What a group of signals has in common: its statistics, tools, key words, failures, quotes and buyers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicons as L
from ..functions.columns import contains_any, exact_quotes, text


def group_stats(df: DataFrame, group: str) -> DataFrame:
    """Size, willingness to pay, fresh and lasting posts, median authority, mean score, latest time and the
    monetisation signal of each group."""
    n, wtp = F.count("*"), F.coalesce(F.sum("willingness_to_pay"), F.lit(0))
    bucket = F.col("opportunity_bucket")
    return df.groupBy(group).agg(
        n.alias("item_count"), wtp.alias("aggregate_wtp"),
        F.count_if(bucket == "current_opportunity").alias("fresh_count"), F.count_if(bucket == "evergreen_pain").alias("evergreen_count"),
        F.round(F.median("buyer_authority_score"), 3).alias("median_authority"),
        (F.sum(F.col("opportunity_score").cast("decimal(18,4)")).cast("double") / F.nullif(F.count("opportunity_score"), F.lit(0))).alias("avg_score"),
        F.coalesce(F.max(F.when(F.col("source_created_ts") > 0, F.col("source_created_ts"))), F.lit(0)).alias("latest_ts"),
        F.when(wtp >= 7 * n, "high").when(wtp >= 4 * n, "medium").otherwise("low").alias("monetization"),
    )


def top_of_group(df: DataFrame, group: str, value: str, k: int, name: str) -> DataFrame:
    """The k most frequent values of each group as a list, ties by value; pre-counted before ranking."""
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(group).orderBy(F.col("n").desc(), value)
    ranked = counts.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    return ranked.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("r", value))).alias("_l")).select(group, F.transform("_l", lambda x: x[value]).alias(name))


def canonical_keys(df: DataFrame, group: str, words: int = 4, longest: int = 96) -> DataFrame:
    """(group, canonical_key): the most frequent words of titles and summaries that have four letters or more and
    aren't stop words, joined; ties by word.  A group without any is left out."""
    whole = F.lower(F.concat_ws(" ", text("title"), text("summary"), text("deep_dive_summary")))
    tokens = df.select(group, F.explode(F.regexp_extract_all(whole, F.lit(r"([a-z0-9_]{2,})"), F.lit(1))).alias("token"))
    tokens = tokens.where((F.length("token") >= 4) & ~F.col("token").isin(*L.STOPWORDS))
    top = top_of_group(tokens, group, "token", words, "tokens")
    return top.select(group, F.regexp_replace(F.substring(F.array_join("tokens", "-"), 1, longest), "^-+|-+$", "").alias("canonical_key"))


def display_name(key: Column, words: int = 6) -> Column:
    """A canonical key as a title."""
    parts = F.slice(F.filter(F.split(F.replace(key, F.lit("_"), F.lit("-")), "-"), lambda x: x != ""), 1, words)
    return F.when(key.startswith("cluster-") | (F.size(parts) == 0), F.lit("Recurring pain cluster")).otherwise(F.initcap(F.array_join(parts, " ")))


def failure_signals(haystack: Column, alternatives: Column) -> Column:
    """The failure signals that a text shows, in fixed order."""
    found = [F.when(contains_any(haystack, terms), F.lit(name)) for name, terms in L.FAILURES]
    return F.filter(F.array(*found, F.when(alternatives, F.lit("alternative_tool_mentions"))), lambda x: x.isNotNull())


def competitor_radar(signals: DataFrame, tags: DataFrame) -> DataFrame:
    """For each tool: signals that name it, how often each failure occurs in them, and their mean positive score.

    Tags delivered twice count once; signals are joined by post_id, and counts are combined before the shuffle."""
    pairs = tags.select("post_id", F.lower(F.trim("competitor_tag")).alias("tool")).where("post_id is not null and tool <> ''").distinct()
    several = pairs.groupBy("post_id").agg((F.count("*") > 1).alias("several"))
    low = F.lower(F.concat_ws(" ", text("title"), text("summary")))
    rows = signals.where("post_id is not null").select("post_id", "opportunity_score", low.alias("t")).join(several, "post_id")
    rows = rows.select("post_id", "opportunity_score", failure_signals(F.col("t"), F.col("several")).alias("found"))
    names = [name for name, _ in L.FAILURES] + ["alternative_tool_mentions"]
    joined = pairs.join(rows, "post_id")
    score = F.when(F.col("opportunity_score") > 0, F.col("opportunity_score").cast("decimal(18,4)"))
    return joined.groupBy("tool").agg(F.count("*").alias("mentions"), *(F.count_if(F.array_contains("found", n)).alias(n) for n in names), (F.sum(score).cast("double") / F.nullif(F.count(score), F.lit(0))).alias("avg_score"))


def buyer_summary(df: DataFrame, group: str) -> DataFrame:
    """Of each group: known buyers, mean authority and mean willingness to pay (0 to 10, zeros ignored)."""
    role = F.lower(F.trim(text("buyer_authority")))
    wtp = F.col("willingness_to_pay")
    scaled = F.when(wtp > 0, F.least(F.lit(10), F.when(wtp <= 1, wtp * 10).otherwise(wtp)))
    auth = F.when(F.col("buyer_authority_score") != 0, F.col("buyer_authority_score").cast("decimal(18,6)"))
    return df.groupBy(group).agg(
        F.count_if(~role.isin("", "unknown", "none", "n/a")).alias("known_buyers"), F.countDistinct(F.when(~role.isin("", "unknown", "none", "n/a"), role)).alias("buyer_roles"),
        F.coalesce(F.sum(auth).cast("double") / F.nullif(F.count(auth), F.lit(0)), F.lit(0.0)).alias("avg_authority"), F.coalesce(F.avg(scaled), F.lit(0.0)).alias("avg_wtp"),
        F.count_if(text("body").rlike("(?i)" + L.WTP_PATTERN)).alias("wtp_texts"),
    )


def first_distinct(rows: DataFrame, group: str, value: str, order: str, k: int, name: str) -> DataFrame:
    """(group, name): the first k different values of each group, in the order in which they are first seen; values that
    differ in case only are one, blank ones don't count.  Repeats are combined before the shuffle."""
    seen = rows.where(F.trim(text(value)) != "").groupBy(group, F.lower(value).alias("low")).agg(F.min(F.struct(order, value)).alias("first"))
    w = Window.partitionBy(group).orderBy(f"first.{order}", f"first.{value}")
    best = seen.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    return best.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("r", F.col(f"first.{value}").alias("v")))).alias("l")).select(group, F.transform("l", lambda x: x["v"]).alias(name))


def tool_quotes(signals: DataFrame, tags: DataFrame, evidence: Column, k: int = 5) -> DataFrame:
    """(tool, quotes): the first k different exact quotes of the signals that name a tool, by their ids."""
    pairs = tags.select("post_id", F.lower(F.trim("competitor_tag")).alias("tool")).where("post_id is not null and tool <> ''").distinct()
    quotes = signals.select("post_id", "id", F.posexplode(exact_quotes(evidence)).alias("at", "quote")).select("post_id", F.struct("id", "at").alias("seen"), "quote")
    return first_distinct(pairs.join(quotes, "post_id"), "tool", "quote", "seen", k, "quotes")


def radar_order() -> list[Column]:
    """Tools by mentions, mean score and name."""
    return [F.col("mentions").desc(), F.coalesce("avg_score", F.lit(0.0)).desc(), F.col("tool").asc()]


def buyer_roles(df: DataFrame, group: str, order: str = "id") -> DataFrame:
    """(group, role, n, place): known roles of buyers and how many have each, in the order in which they are first seen."""
    role = F.lower(F.trim(text("buyer_authority")))
    counts = df.select(group, F.col(order).alias("o"), role.alias("role")).where(~F.col("role").isin("", "unknown", "none", "n/a")).groupBy(group, "role").agg(F.count("*").alias("n"), F.min("o").alias("first"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy("first", "role"))).drop("first")


def buyer_words(df: DataFrame, group: str, evidence: Column, reason: Column, order: str = "id", k: int = 3) -> DataFrame:
    """(group, wtp_quotes, uncertainties): the first k different exact quotes that speak of paying, and the first k reasons
    of doubt; empty lists for none."""
    spoken = df.select(group, F.col(order).alias("o"), F.posexplode(exact_quotes(evidence)).alias("at", "quote")).where(F.col("quote").rlike("(?i)" + L.WTP_PATTERN))
    quotes = first_distinct(spoken.select(group, F.struct("o", "at").alias("seen"), "quote"), group, "quote", "seen", k, "wtp_quotes")
    doubts = first_distinct(df.select(group, F.col(order).alias("seen"), F.trim(reason).alias("doubt")), group, "doubt", "seen", k, "uncertainties")
    none = F.array().cast("array<string>")
    joined = df.select(group).distinct().join(quotes, group, "left").join(doubts, group, "left")
    return joined.select(group, F.coalesce("wtp_quotes", none).alias("wtp_quotes"), F.coalesce("uncertainties", none).alias("uncertainties"))
