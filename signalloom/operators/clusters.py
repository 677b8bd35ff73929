"""Recurring problems: groups of alike signals, their headers and members, and the latest of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicons as L
from ..functions.columns import json_list, tags, text, trimmed, unit
from ..functions.udfs import bag_vector_udf
from ..sources.tables import beside
from . import graph, similarity, trends, views


def candidates(signals: DataFrame, as_of: str, days: int, min_wtp: int) -> DataFrame:
    """Active signals of the last days that pay enough or are favourites, with their place in the order of score,
    willingness to pay, pain and time; ties by id.

    Places are counted within ranges of the score by a range-partitioned sort, so no task ranks all rows."""
    rows = views.since(views.active(signals), as_of, days)
    rows = rows.where((F.col("triage_status") == "favorite") | (F.col("willingness_to_pay") >= min_wtp))
    order = [F.col(c).desc_nulls_last() for c in ("opportunity_score", "willingness_to_pay", "pain_level", "created_at")] + [F.col("id").asc()]
    return views.with_place(rows, order, "ordinal")


def candidate_text() -> Column:
    """What a signal is compared by: title, summary, deep dive and up to eight tools."""
    return trimmed(F.concat_ws(" | ", text("title"), text("summary"), text("deep_dive_summary"), F.array_join(F.slice(json_list("competitor_tags"), 1, 8), ", ")))


def candidate_line() -> Column:
    """The line that stands for a signal in the text that a group is named by."""
    return F.concat(F.lit("- post="), text("post_id"), F.lit(" wtp="), F.coalesce(F.col("willingness_to_pay"), F.lit(0)).cast("string"), F.lit(" summary="), F.substring(text("summary"), 1, 180))


def vectors(rows: DataFrame, given: str | None = None) -> Column:
    """A unit vector of each row: the given one where it can be used, else hashed words; never null."""
    words = bag_vector_udf(candidate_text())
    return F.coalesce(unit(F.col(given)), words) if given else words


def groups(rows: DataFrame, threshold: float, *, given: str | None = None) -> DataFrame:
    """(ordinal, cluster): single linkage of rows whose vectors' product reaches the threshold; a row without a partner
    is a group of its own, named like every group by its first ordinal."""
    v = rows.select("ordinal", vectors(rows, given).alias("v"))
    found = graph.components(similarity.similar_pairs(v, "ordinal", "v", threshold))
    return rows.select("ordinal").join(found.select(F.col("node").alias("ordinal"), F.col("component").alias("cluster")), "ordinal", "left").select("ordinal", F.coalesce("cluster", "ordinal").alias("cluster"))


def member_similarity(rows: DataFrame, cluster: str, id_col: str, vector: str) -> DataFrame:
    """(cluster, id, similarity): the mean product of a member's vector with those of all members, itself included.

    It is the product with the members' mean vector, so no pairs are formed; sums are combined before the shuffle."""
    flat = rows.where(F.col(vector).isNotNull() & F.col(cluster).isNotNull()).select(cluster, id_col, F.posexplode(F.col(vector).cast("array<double>")).alias("at", "x"))
    means = flat.groupBy(cluster, "at").agg(F.avg("x").alias("m")).groupBy(cluster).agg(F.array_sort(F.collect_list(F.struct("at", "m"))).alias("ms"))
    joined = rows.select(cluster, id_col, vector).join(means, cluster)
    product = F.aggregate(F.zip_with(F.col(vector).cast("array<double>"), F.transform("ms", lambda x: x["m"]), lambda x, y: x * y), F.lit(0.0).cast("double"), lambda s, x: s + x)
    return joined.select(cluster, id_col, product.alias("similarity"))


def keys_of(rows: DataFrame, cluster: str, labels: DataFrame | None = None, words: int = 4, longest: int = 96) -> DataFrame:
    """(cluster, canonical_key) of every cluster: its most frequent words of four letters or more that aren't stop words,
    joined; ties by word.  Words of a given label (cluster, label, key_complaints) count three times each.  A cluster
    without such words is named by a hash of its members' texts."""
    whole = F.concat_ws(" ", text("title"), text("summary"), text("deep_dive_summary"))
    low = F.lower(whole)
    tokens = rows.select(cluster, F.explode(F.regexp_extract_all(low, F.lit(r"([a-z0-9_]{2,})"), F.lit(1))).alias("token"), F.lit(1).alias("weight"))
    if labels is not None:
        named = labels.where(F.lower(F.trim("label")) != "trend detected")
        phrases = F.lower(F.array_join(F.concat(F.array("label"), F.coalesce("key_complaints", F.array().cast("array<string>"))), " "))
        tokens = tokens.unionAll(named.select(cluster, F.explode(F.regexp_extract_all(phrases, F.lit(r"([a-z0-9_]{2,})"), F.lit(1))), F.lit(3)))
    counts = tokens.where((F.length("token") >= 4) & ~F.col("token").isin(*L.STOPWORDS)).groupBy(cluster, "token").agg(F.sum("weight").alias("n"))
    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy(cluster).orderBy(F.col("n").desc(), "token"))).where(F.col("r") <= words)
    keys = ranked.groupBy(cluster).agg(F.array_sort(F.collect_list(F.struct("r", "token"))).alias("l"))
    keys = keys.select(cluster, F.regexp_replace(F.substring(F.array_join(F.transform("l", lambda x: x["token"]), "-"), 1, longest), "^-+|-+$", "").alias("own"))
    # only clusters without words need their texts together, which are short then
    rest = rows.select(cluster, trimmed(low).alias("t")).join(keys, cluster, "left_anti")
    hashed = rest.groupBy(cluster).agg(F.array_sort(F.collect_list(F.nullif("t", F.lit("")))).alias("ts")).select(cluster, F.concat(F.lit("cluster-"), F.substring(F.sha1(F.array_join("ts", "|")), 1, 10)).alias("own"))
    return keys.unionAll(hashed).withColumnRenamed("own", "canonical_key")


def headers(rows: DataFrame, cluster: str, labels: DataFrame | None = None, *, min_size: int = 1) -> DataFrame:
    """One row for each cluster of at least so many members: size, willingness to pay, fresh and lasting posts, median
    authority, mean score, latest time, incumbents, key, label, summary and monetisation signal.

    labels (cluster, label, summary, signal, key_complaints) are those that a model gave; a cluster without one is
    named after its key, summed up by its counts, and its signal follows from willingness to pay."""
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c).otherwise(F.lit(0.0))
    n = F.count("*")
    bucket = F.lower(F.trim(text("opportunity_bucket")))
    stats = rows.where(F.col(cluster).isNotNull()).groupBy(cluster).agg(
        n.alias("item_count"), F.sum(F.coalesce(F.col("willingness_to_pay"), F.lit(0))).cast("double").alias("aggregate_wtp"),
        F.count_if(bucket == "current_opportunity").alias("fresh_post_count"), F.count_if(bucket == "evergreen_pain").alias("evergreen_post_count"),
        F.round(F.median(finite(F.coalesce(F.col("buyer_authority_score"), F.lit(0.0)))), 3).alias("median_buyer_authority"),
        F.round(F.sum(finite(F.coalesce(F.col("opportunity_score"), F.lit(0.0))).cast("decimal(18,4)")).cast("double") / n, 2).alias("avg_opportunity_score"),
        F.max(F.when(F.col("source_created_ts") > 0, F.col("source_created_ts"))).alias("latest_source_created_ts"),
    ).where(F.col("item_count") >= min_size)
    named = rows.select(cluster, F.explode(F.filter(F.transform(json_list("competitor_tags"), lambda x: F.lower(trimmed(x))), lambda x: x != "")).alias("tool"))
    tools = trends.top_of_group(named, cluster, "tool", 5, "incumbents")
    out = stats.join(tools, cluster, "left").join(keys_of(rows, cluster, labels), cluster)
    out = out.withColumn("incumbents", F.coalesce("incumbents", F.array().cast("array<string>")))
    own = fallback_summary(F.col("item_count"), F.col("fresh_post_count"), F.col("evergreen_post_count"), F.col("incumbents"))
    signal = F.when(F.col("aggregate_wtp") >= 7 * F.col("item_count"), "high").when(F.col("aggregate_wtp") >= 4 * F.col("item_count"), "medium").otherwise("low")
    if labels is None:
        return out.withColumns({"label": trends.display_name(F.col("canonical_key")), "summary": own, "signal": signal})
    given = labels.where(F.lower(F.trim("label")) != "trend detected").select(cluster, F.col("label").alias("l_"), F.col("summary").alias("s_"), F.col("signal").alias("g_"))
    out = out.join(given, cluster, "left").withColumns({"label": F.coalesce("l_", trends.display_name(F.col("canonical_key"))), "summary": F.coalesce("s_", own), "signal": F.coalesce("g_", signal)})
    return out.drop("l_", "s_", "g_")


def fallback_summary(n: Column, fresh: Column, evergreen: Column, incumbents: Column) -> Column:
    """The fixed sentence about a cluster that no model summed up."""
    first = F.array_join(F.slice(incumbents, 1, 3), ", ")
    return F.format_string("%d related pain posts grouped into one recurring problem. Fresh=%d, evergreen=%d, incumbents=%s.", n, fresh, evergreen, F.when(first == "", "none").otherwise(first))


def order() -> list[Column]:
    """Clusters by mean score, latest time, size and willingness to pay, all descending; ties by key."""
    return [F.col("avg_opportunity_score").desc_nulls_last(), F.coalesce("latest_source_created_ts", F.lit(0)).desc(), F.col("item_count").desc(), F.col("aggregate_wtp").desc(), F.col("canonical_key").asc()]


def run(signals: DataFrame, as_of: str, days: int, *, min_wtp: int = 8, threshold: float = 0.72, min_size: int = 3, given: str | None = None, labels: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(run, headers, members) of a cluster run: candidates, vectors, single linkage, sizes, headers and how near each
    member is to the others.  Without candidates the run's row has counts of 0 and the rest is empty."""
    rows = candidates(signals, as_of, max(1, days), min_wtp)
    rows = graph.checkpointed(rows)
    joined = rows.join(groups(rows, threshold, given=given), "ordinal")
    sizes = joined.groupBy("cluster").agg(F.count("*").alias("n")).where(F.col("n") >= max(2, min_size))
    joined = joined.join(sizes.select("cluster"), "cluster", "left_semi")
    joined = graph.checkpointed(joined.withColumn("v_", vectors(joined, given)))
    header = headers(joined, "cluster", labels)
    near = member_similarity(joined, "cluster", "post_id", "v_").select("cluster", "post_id", F.round("similarity", 4).alias("similarity"))
    counts = rows.agg(F.lit(max(1, days)).alias("window_days"), F.count("*").alias("candidate_count"))
    counts = beside(counts, sizes.agg(F.count("*").alias("cluster_count")))
    return counts, header, near


def save(folder: str, run_id: int, created_at: str, run_row: DataFrame, header: DataFrame, members: DataFrame) -> None:
    """Append a run: members first, then headers, then the run's row, which commits them; readers take only clusters of
    committed runs, and a run repeated after a failure replaces what it left."""
    stamp = {"run_id": F.lit(run_id).cast("long"), "run_created_at": F.to_timestamp_ntz(F.lit(created_at))}
    for name, df in (("members", members), ("headers", header), ("runs", run_row)):
        df.withColumns(stamp).write.mode("overwrite").parquet(f"{folder}/{name}/run={run_id}")


def with_members(clusters: DataFrame, members: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Clusters with the sorted ids of their members as `post_ids`, empty for none."""
    ids = members.where(F.col(cluster).isNotNull()).groupBy(cluster).agg(F.array_sort(F.collect_set("post_id")).alias("post_ids"))
    return clusters.join(ids, cluster, "left").withColumn("post_ids", F.coalesce("post_ids", F.array().cast("array<string>")))


def of_posts(members: DataFrame, clusters: DataFrame, runs: DataFrame) -> DataFrame:
    """(post_id, cluster) of the latest run that has the post: members (post_id, cluster), clusters (cluster, run_id),
    runs (run_id, run_created_at)."""
    joined = members.select("post_id", "cluster").join(clusters.select("cluster", "run_id"), "cluster").join(runs.select("run_id", "run_created_at"), "run_id")
    return views.latest_per_key(joined, "post_id", [F.col("run_created_at").desc_nulls_last(), F.col("run_id").desc(), F.col("cluster")]).select("post_id", "cluster")


def latest(clusters: DataFrame, limit: int, *, members: DataFrame | None = None, posts: DataFrame | None = None) -> DataFrame:
    """The first `limit` clusters of different keys, by run time, run, mean score, latest time, size and willingness to
    pay, all descending; blank keys are left out.

    With members and posts (post_id) only clusters that have one of the posts.  Ties go by cluster."""
    rows = clusters.where(F.trim(text("canonical_key")) != "")
    if posts is not None:
        wanted = members.join(posts.select("post_id"), "post_id", "left_semi").select("cluster").distinct()
        rows = rows.join(wanted, "cluster", "left_semi")
    order = [F.col(c).desc_nulls_last() for c in ("run_created_at", "run_id", "avg_opportunity_score", "latest_source_created_ts", "item_count", "aggregate_wtp")] + [F.col("cluster").asc()]
    first = views.latest_per_key(rows.withColumn("k_", trimmed(F.col("canonical_key"))), "k_", order).drop("k_")
    return first.orderBy(*order).limit(limit)
