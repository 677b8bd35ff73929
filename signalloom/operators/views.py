"""Relational views: windows of rows, latest per key, ranked lists, groups and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import escaped_cell, json_list, text, trimmed
from ..sources.tables import checkpointed

INACTIVE = ("discarded", "merged")


def active(df: DataFrame) -> DataFrame:
    """Rows that are neither discarded nor merged; a null status isn't active."""
    return df.where(~F.col("triage_status").isin(*INACTIVE))


def since(df: DataFrame, as_of: str, days: int, column: str = "created_at") -> DataFrame:
    """Rows stored within so many days before a time."""
    return df.where(F.col(column) >= F.to_timestamp_ntz(F.lit(as_of)) - F.make_dt_interval(days=F.lit(days)))


def row_score(df_score: Column, wtp: Column) -> Column:
    """The score, or the willingness to pay where there is no finite one."""
    good = df_score.isNotNull() & ~F.isnan(df_score) & (F.abs(df_score) < F.lit(float("inf")))
    return F.when(good, df_score).otherwise(F.coalesce(wtp, F.lit(0)).cast("double"))


def named(c: str, default: str) -> Column:
    """A trimmed text, or a default for null and blank."""
    value = F.trim(text(c))
    return F.when(value == "", F.lit(default)).otherwise(value)


def latest_per_key(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key in an order; null keys are left out.  Give an order that leaves no ties."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.where(F.col(key).isNotNull()).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def once(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Rows delivered more than once, each key kept once."""
    return latest_per_key(df, key, order)


def top_counts(df: DataFrame, column: str, k: int, count_name: str = "n") -> DataFrame:
    """The k most frequent values and their counts; ties by value."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias(count_name))
    return counts.orderBy(F.col(count_name).desc(), column).limit(k)


def with_place(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """With each row's place, from 0, in an order that leaves no ties.

    Rows are range-partitioned and sorted within partitions; only the partitions' sizes are added up in one task."""
    index = F.monotonically_increasing_id()  # the partition in its high, the row in its low 33 bits
    rows = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_i", index))
    part = F.shiftright("_i", 33)
    sizes = rows.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    return rows.withColumn("_p", part).join(F.broadcast(before), "_p").withColumn(name, F.col("_before") + F.col("_i").bitwiseAND((1 << 33) - 1)).drop("_p", "_i", "_before")


def page(df: DataFrame, order: list[Column], number: int, size: int = 5) -> DataFrame:
    """One page, from 0, of the rows in an order that leaves no ties."""
    return df.orderBy(*order).offset(number * size).limit(size)


def exported(df: DataFrame, as_of: int, *, min_wtp: int = 8, favourites: bool = True, subreddit: str | None = None, bucket: str | None = None, max_age_days: int | None = None) -> DataFrame:
    """Active rows that an export takes: those that pay enough, or favourites; by choice only of one subreddit or bucket,
    and only posted within some days before `as_of` (epoch seconds; rows without a time are left out then)."""
    rows = active(df)
    pays = F.col("willingness_to_pay") >= min_wtp
    rows = rows.where(pays | (F.col("triage_status") == "favorite") if favourites else pays)
    if subreddit:
        rows = rows.where(F.col("subreddit") == subreddit)
    if bucket:
        rows = rows.where(F.col("opportunity_bucket") == bucket)
    if max_age_days is not None:
        rows = rows.where(F.col("source_created_ts") >= as_of - max(0, max_age_days) * 86_400)
    return rows


def export_order() -> list[Column]:
    """Favourites first, then score, willingness to pay, pain and time; the id settles ties."""
    favourite = F.when(F.col("triage_status") == "favorite", 0).otherwise(1)
    return [favourite.asc(), *(F.col(c).desc_nulls_last() for c in ("opportunity_score", "willingness_to_pay", "pain_level", "created_at")), F.col("id").asc()]


#: Fixed value: the columns of an export, in order.
EXPORT_COLUMNS = ("created_at", "subreddit", "source", "post_id", "title", "summary", "pain_level", "willingness_to_pay", "niche_category", "competitor_tags", "category", "severity", "opportunity_score", "promotion_eligible", "evidence_rejection_reason", "hard_negative_type", "verified_evidence_count", "triage_status", "deep_dive_status", "deep_dive_summary", "url")


def export_rows(df: DataFrame) -> DataFrame:
    """Rows as cells of an export, in its order of rows and columns: promotion_eligible, evidence_rejection_reason,
    hard_negative_type and the number of verified quotes come from the row's payload, empty where it has none, and
    texts that a spreadsheet would take for formulas are escaped."""
    payload = lambda name: F.coalesce(F.get_json_object("analysis_payload_json", f"$.{name}"), F.lit(""))
    quotes = F.coalesce(F.from_json(F.get_json_object("analysis_payload_json", "$.verified_evidence"), "array<struct<match_type: string>>"), F.array().cast("array<struct<match_type: string>>"))
    found = F.size(F.filter(quotes, lambda x: F.coalesce(x["match_type"], F.lit("none")) != "none"))
    made = {c: payload(c) for c in ("promotion_eligible", "evidence_rejection_reason", "hard_negative_type")} | {"verified_evidence_count": found}
    texts = {"subreddit", "source", "post_id", "title", "summary", "niche_category", "competitor_tags", "category", "severity", "promotion_eligible", "evidence_rejection_reason", "hard_negative_type", "triage_status", "deep_dive_status", "deep_dive_summary", "url"}
    ordered = df.orderBy(*export_order())
    return ordered.select(*((escaped_cell(c) if name in texts else c).alias(name) for name in EXPORT_COLUMNS for c in [made.get(name, F.col(name))]))


def artifact_stem(c: Column, default: str = "scope") -> Column:
    """A name that a file may have: other characters become underscores, none and no dots or dashes at the ends."""
    stem = F.regexp_replace(F.regexp_replace(trimmed(text(c)), r"[^A-Za-z0-9_.-]+", "_"), r"^[._-]+|[._-]+$", "")
    return F.when(stem == "", F.lit(default)).otherwise(stem)


def worksheet_name(prefix: Column, scope: Column, longest: int = 100) -> Column:
    name = F.concat(artifact_stem(prefix, "pain_finder"), F.lit("_"), artifact_stem(scope, "all"))
    return F.regexp_replace(F.substring(name, 1, longest), r"[._-]+$", "")


def shown_bucket(c: Column) -> Column:
    """The bucket as a digest shows it: unknown ones are of unknown age."""
    value = F.lower(F.trim(text(c)))
    return F.when(value.isin("current_opportunity", "evergreen_pain", "unknown_age"), value).otherwise("unknown_age")


def mean_score(score: Column, pain: Column, wtp: Column) -> Column:
    """The score, or the mean of pain and willingness to pay where there is no finite one."""
    good = score.isNotNull() & ~F.isnan(score) & (F.abs(score) < F.lit(float("inf")))
    return F.round(F.when(good, score).otherwise((F.coalesce(pain, F.lit(0)) + F.coalesce(wtp, F.lit(0))) / F.lit(2.0)), 2)


def digest_order(score: str = "score") -> list[Column]:
    """Best first: score, number of evidence spans, time, willingness to pay, pain; ties by id."""
    return [F.col(score).desc(), F.size(json_list("evidence_spans_json")).desc(), *(F.coalesce(F.col(c), F.lit(0)).desc() for c in ("source_created_ts", "willingness_to_pay", "pain_level")), F.col("id").asc()]


def digest(rows: DataFrame, clusters: DataFrame | None = None, best: int = 5) -> DataFrame:
    """(section, place, name, n, score) of what a digest tells of its rows: their total, counts of niches and sources,
    the best items, the most frequent blockers and, where given, clusters (canonical_key, item_count,
    avg_opportunity_score, in their order) as sections of one table.  Counts are combined before any shuffle."""
    parts = "section string, place int, name string, n long, score double"
    count = lambda section, name: rows.groupBy(name.alias("name")).agg(F.count("*").alias("n")).select(F.lit(section).alias("section"), F.lit(None).cast("int").alias("place"), "name", "n", F.lit(None).cast("double").alias("score"))
    out = rows.agg(F.count("*").alias("n")).select(F.lit("total").alias("section"), F.lit(None).cast("int").alias("place"), F.lit("").alias("name"), "n", F.lit(None).cast("double").alias("score"))
    out = out.unionAll(count("niche", named("niche_category", "Uncategorized"))).unionAll(count("source", named("source", "unknown")))
    scored = rows.withColumn("score", mean_score(F.col("opportunity_score"), F.col("pain_level"), F.col("willingness_to_pay")))
    few = lambda df, order: df.orderBy(*order).limit(best).withColumn("place", F.row_number().over(Window.orderBy(*order)))  # noqa: E731  of at most `best` rows
    items = few(scored, digest_order()).select(F.lit("item").alias("section"), "place", F.col("post_id").alias("name"), F.lit(None).cast("long").alias("n"), "score")
    told = top_counts(rows.select(F.trim(text("deep_dive_summary")).alias("name")).where("name <> ''"), "name", best)
    blockers = few(told, [F.col("n").desc(), F.col("name").asc()]).select(F.lit("blocker").alias("section"), "place", "name", "n", F.lit(None).cast("double").alias("score"))
    out = out.unionAll(items).unionAll(blockers)
    if clusters is not None:
        order = [F.col("avg_opportunity_score").desc_nulls_last(), F.col("canonical_key").asc()]
        out = out.unionAll(few(clusters, order).select(F.lit("cluster").alias("section"), "place", F.col("canonical_key").alias("name"), F.col("item_count").cast("long").alias("n"), F.col("avg_opportunity_score").alias("score")))
    return out.to(T.StructType.fromDDL(parts))


def grouped_rows(df: DataFrame, group: str, best: int, order: list[Column], score: str, within: str | None = None) -> DataFrame:
    """The best rows of each group with row_no, best_score, group_size and group_rank: groups rank by best score, size and
    name, in each value of `within` apart where given."""
    keys = [within, group] if within else [group]
    stats = df.groupBy(*keys).agg(F.max(score).alias("best_score"), F.count("*").alias("group_size"))
    place = Window.partitionBy(*([within] if within else [])).orderBy(F.col("best_score").desc(), F.col("group_size").desc(), F.lower(group), group)
    stats = stats.withColumn("group_rank", F.row_number().over(place))  # one row for each group
    top = df.withColumn("row_no", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("row_no") <= best)
    return top.join(stats, keys)


def merged_posts(df: DataFrame, key: str) -> DataFrame:
    """One row for each post seen in several feeds: how many, the longest text and the earliest time."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count("*").alias("seen"), F.max(F.length(text("text"))).cast("long").alias("longest"), F.min("fetched_at").alias("first_fetched"),
        F.min_by("source", F.struct(F.col("fetched_at").isNull(), "fetched_at", "doc_id")).alias("first_source"),
    )
