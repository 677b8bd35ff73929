"""Queries on stored tables, with the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import lexicons as L
from ..functions import columns as C
from ..operators import evaluation, features, graph, scoring, similarity, store, trends, usage, views
from ..sources.tables import table

#: The time that windows are reckoned back from.
AS_OF = "2026-04-21 00:00:00"
SECONDS = 1_776_729_600
#: A daily limit that the test data reach on some days.
CAP = 0.002
#: Thresholds at which the test vectors have pairs and components, none of them near it.
PAIRS, COMPONENTS = 0.35, 0.40


def _signals(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "pain_points", *columns)


def rank_signal_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best active signals: by score, willingness to pay, pain, times posted and stored."""
    rows = views.active(_signals(spark, sf_dir, "id", "post_id", "triage_status", "opportunity_score", "willingness_to_pay", "pain_level", "source_created_ts", "created_at"))
    order = [F.col(c).desc_nulls_last() for c in ("opportunity_score", "willingness_to_pay", "pain_level", "source_created_ts", "created_at")]
    return rows.orderBy(*order, "id").limit(50).select("id", "post_id", "opportunity_score")


def recent_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.since(views.active(_signals(spark, sf_dir, "id", "subreddit", "triage_status", "created_at")), AS_OF, 90)
    return rows.select("id", "subreddit")


def top_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 tools most named by active signals of the last year."""
    tags = table(spark, sf_dir, "pain_point_competitors", "post_id", "competitor_tag").distinct()
    rows = views.since(views.active(_signals(spark, sf_dir, "post_id", "triage_status", "created_at")), AS_OF, 365)
    return views.top_counts(tags.join(rows.select("post_id"), "post_id"), "competitor_tag", 20, "mentions")


def tag_pain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 most painful signals that name one tool."""
    tags = table(spark, sf_dir, "pain_point_competitors", "post_id", "competitor_tag").where("competitor_tag = 'kanbrero'").select("post_id").distinct()
    rows = views.active(_signals(spark, sf_dir, "id", "post_id", "triage_status", "willingness_to_pay", "pain_level")).join(tags, "post_id", "left_semi")
    return rows.orderBy(F.col("willingness_to_pay").desc_nulls_last(), F.col("pain_level").desc_nulls_last(), "id").limit(10).select("id", "willingness_to_pay", "pain_level")


def unseen_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of posts that weren't stored at the beginning of the year."""
    docs = table(spark, sf_dir, "documents", "doc_id", "post_id").where("post_id is not null")
    stored = _signals(spark, sf_dir, "post_id", "created_at").where("created_at < '2026-01-01'")
    return docs.join(stored, "post_id", "left_anti").select("doc_id", "post_id")


def latest_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last feedback on each post."""
    rows = usage.delivered_once(table(spark, sf_dir, "feedback_events", "id", "post_id", "feedback_value", "created_at"))
    last = views.latest_per_key(rows, "post_id", [F.col("created_at").desc_nulls_last(), F.col("id").desc()])
    return last.select("post_id", "id", F.lower(F.trim("feedback_value")).alias("value"))


def feedback_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.feedback_counts(table(spark, sf_dir, "feedback_events", "id", "feedback_value", "created_at"))


def daily_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.daily_spend(table(spark, sf_dir, "llm_usage_events", "id", "cost_usd", "created_at"))


def spend_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.crossings(table(spark, sf_dir, "llm_usage_events", "id", "cost_usd", "created_at"), CAP)


def usage_by_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.usage_by_stage(table(spark, sf_dir, "llm_usage_events", "id", "candidate_stage", "operation", "prompt_tokens", "completion_tokens", "created_at"))


def prompt_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each prompt, its calls and the first of them, which a cache would have kept."""
    rows = usage.delivered_once(table(spark, sf_dir, "llm_usage_events", "id", "prompt_hash", "created_at")).where("prompt_hash is not null")
    return rows.groupBy("prompt_hash").agg(F.count("*").alias("calls"), F.min_by("id", F.struct("created_at", "id")).alias("first_id"))


def ledger_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of counts of what shouldn't be in the usage ledger."""
    u = table(spark, sf_dir, "llm_usage_events", "id", "model", "operation", "cost_usd", "prompt_tokens", "created_at")
    blank = lambda c: C.trimmed(C.text(c)) == ""
    u = u.unionAll(u.where("id <= 6").withColumn("model", F.element_at(F.array(*map(F.lit, ("\t", " \n ", "\u00a0", "\r\n", "", "m"))), F.col("id").cast("int"))))  # rows as they shouldn't be
    return u.agg(F.count("*").alias("n"), F.count_if(blank("model")).alias("no_model"), F.count_if(blank("operation")).alias("no_operation"), F.count_if(F.col("cost_usd").isNull()).alias("no_cost"), F.count_if(F.col("prompt_tokens") < 0).alias("negative"), F.countDistinct("id").alias("events"))


def monitor_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds that are due at the time: active, and never checked or checked longer ago than their interval."""
    rows = table(spark, sf_dir, "monitored_subreddits", "name", "interval_hours", "last_checked", "last_error", "active")
    hours = (F.unix_seconds(F.to_timestamp(F.lit(AS_OF))) - F.unix_seconds(F.col("last_checked").cast("timestamp"))) / 3600
    due = (F.col("active") == 1) & (F.col("last_checked").isNull() | (hours >= F.col("interval_hours")))
    return rows.select("name", due.alias("due"), F.substring(C.text("last_error"), 1, 1000).alias("error"))


def job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last state of each user: the latest event wins, ties by id."""
    e = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type")
    return e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.count_if(F.col("event_type") == "error").alias("errors"))


def digest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active signals by source and niche."""
    rows = views.active(_signals(spark, sf_dir, "source", "niche_category", "triage_status"))
    return rows.groupBy(views.named("source", "unknown").alias("source"), views.named("niche_category", "Uncategorized").alias("niche")).agg(F.count("*").alias("n"))


def digest_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active signals by source and bucket: the groups' rank by best score, size and name, and the five best rows of each."""
    rows = views.active(_signals(spark, sf_dir, "id", "source", "opportunity_bucket", "triage_status", "opportunity_score", "willingness_to_pay", "source_created_ts", "pain_level"))
    rows = rows.withColumns({"label": F.concat_ws("/", views.named("source", "unknown"), views.named("opportunity_bucket", "unknown_age")), "score": views.row_score(F.col("opportunity_score"), F.col("willingness_to_pay"))})
    order = [F.col("score").desc(), *(F.coalesce(F.col(c), F.lit(0)).desc() for c in ("source_created_ts", "willingness_to_pay", "pain_level")), F.col("id")]
    return views.grouped_rows(rows, "label", 5, order, "score").select("label", "id", F.col("row_no").cast("long").alias("row_no"), "best_score", "group_size", F.col("group_rank").cast("long").alias("group_rank"))


def recurring_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _signals(spark, sf_dir, "deep_dive_summary").select(F.trim(C.text("deep_dive_summary")).alias("blocker")).where("blocker <> ''")
    return views.top_counts(rows, "blocker", 5)


def category_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _signals(spark, sf_dir, "subreddit", "category", "is_monetizable", "pain_level")
    return rows.groupBy("subreddit", views.named("category", "none").alias("category")).agg(F.count("*").alias("n"), F.count_if(F.col("is_monetizable") == 1).alias("monetizable"), F.avg("pain_level").alias("avg_pain"))


def cluster_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of each niche as a cluster of three signals or more."""
    rows = _signals(spark, sf_dir, "niche_category", "willingness_to_pay", "opportunity_bucket", "buyer_authority_score", "opportunity_score", "source_created_ts").where("niche_category is not null")
    return trends.group_stats(rows, "niche_category").where("item_count >= 3")


def cluster_incumbents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five tools most named in each niche."""
    tags = _signals(spark, sf_dir, "niche_category", "competitor_tags").where("niche_category is not null").select("niche_category", F.explode(C.tags(C.json_list("competitor_tags"))).alias("tool"))
    return trends.top_of_group(tags, "niche_category", "tool", 5, "tools").select("niche_category", F.array_join("tools", ",").alias("tools"))


def canonical_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _signals(spark, sf_dir, "subreddit", "title", "summary", "deep_dive_summary")
    keys = trends.canonical_keys(rows, "subreddit")
    return keys.select("subreddit", "canonical_key", trends.display_name(F.col("canonical_key")).alias("name"))


def latest_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest signal of each niche that isn't blank."""
    rows = _signals(spark, sf_dir, "id", "niche_category", "created_at").where("trim(coalesce(niche_category, '')) <> ''")
    last = views.latest_per_key(rows, "niche_category", [F.col("created_at").desc_nulls_last(), F.col("id").desc()])
    return last.select("niche_category", "id")


def competitor_radar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.competitor_radar(_signals(spark, sf_dir, "post_id", "title", "summary", "opportunity_score"), table(spark, sf_dir, "pain_point_competitors", "post_id", "competitor_tag"))


def buyer_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.buyer_summary(_signals(spark, sf_dir, "subreddit", "body", "buyer_authority", "buyer_authority_score", "willingness_to_pay"), "subreddit")


def merged_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.merged_posts(table(spark, sf_dir, "documents", "doc_id", "post_id", "text", "source", "fetched_at"), "post_id")


def similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return similarity.similar_pairs(rows, "vec_id", "embedding", PAIRS).select("a", "b", F.round("similarity", 3).alias("similarity"))


def cross_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    return similarity.similar_pairs(rows, "vec_id", "embedding", PAIRS, group_col="label").select("a", "b")


def vector_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The product of each vector with the next one, and with one of another length, which is 0."""
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    both = rows.join(after, "vec_id")
    return both.select("vec_id", F.round(C.dot(F.col("embedding"), F.col("other")), 4).alias("product"), C.dot(F.col("embedding"), F.slice("other", 1, 3)).alias("odd"))


def best_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each vector whose id is divisible by 100, the best of another label."""
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    found = similarity.best_matches(rows.where("vec_id % 100 = 0"), rows, "vec_id", "embedding", 0.2, group_col="label")
    return found.select("id", "match_id", F.round("similarity", 3).alias("similarity"))


def trend_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of clusters of three vectors or more by single linkage; a cluster is named by its smallest member."""
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    found = graph.components(similarity.similar_pairs(rows, "vec_id", "embedding", COMPONENTS))
    sizes = found.groupBy("component").agg(F.count("*").alias("size")).where("size >= 3")
    return found.join(sizes, "component").select(F.col("node").alias("vec_id"), "component", "size")


def dedup_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of different labels merged greedily in the order of their ids."""
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    return graph.greedy_merge(similarity.similar_pairs(rows, "vec_id", "embedding", PAIRS, group_col="label"))


def signal_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored signals of even ids, updated by all signals with other severities.

    The split is the feature: the tables hold one state of each signal, so rows that are updated and rows that are new
    are both made from it.  All signals come in, and none is dropped; a stored row without an update is tested on its own."""
    rows = _signals(spark, sf_dir, "id", "post_id", "severity", "author_name", "triage_status", "deep_dive_status", "cross_source_count")
    new = rows.withColumns({"severity": F.lit("high"), "author_name": F.lit(None).cast("string"), "triage_status": F.lit("new"), "deep_dive_status": F.lit("running")})
    return store.upsert(rows.where("id % 2 = 0"), new)


def tag_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of posts, those of Reddit posts replaced by one."""
    old = table(spark, sf_dir, "pain_point_competitors", "post_id", "competitor_tag").distinct()
    new = old.where("post_id like 'reddit:%'").withColumn("competitor_tag", F.lit("replaced"))
    return store.replace_children(old, new, "post_id")


def duplicate_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals after those of the same title and source have been merged into the one of the smallest id, twice: the
    second time changes nothing."""
    rows = _signals(spark, sf_dir, "id", "post_id", "title", "source", "triage_status", "cross_source_count", "cross_source_ids", "deep_dive_status", "deep_dive_summary")
    first = rows.where("title is not null").groupBy("title", "source").agg(F.min_by("post_id", "id").alias("canonical_id"), F.count("*").alias("n")).where("n > 1")
    pairs = rows.join(first, ["title", "source"]).select("canonical_id", F.col("post_id").alias("duplicate_id")).where("canonical_id <> duplicate_id")
    merged = store.merge_duplicates(store.merge_duplicates(rows, pairs), pairs)
    return merged.select("id", "triage_status", F.col("cross_source_count").cast("long").alias("cross_source_count"), F.size(C.json_list("cross_source_ids")).cast("long").alias("brought"), "deep_dive_status", F.md5(C.text("deep_dive_summary")).alias("summary_hash"))


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of the keyword classifier for the held-out posts, joined with their labels."""
    posts = table(spark, sf_dir, "eval_posts", "post_id", "title", "body", "top_comments", "source_created_ts")
    t = features.post_text()
    rows = posts.withColumn("t", t).withColumn("category", features.keyword_category(F.col("t"))).withColumn("kind", features.post_type(F.col("t"), F.col("category")))
    rows = rows.withColumn("handness", features.first_handness(F.col("t"), F.col("kind")))
    rows = rows.withColumn("score", features.prescreen_score(F.col("t"), C.filled(F.col("top_comments")), F.col("handness")))
    strength = F.greatest(features.keyword_score(F.col("t")), F.least(F.lit(3), F.col("score")))
    quotes = features.evidence_spans(C.text("title"), C.text("body"))
    exact = F.size(F.filter(quotes, lambda x: F.contains(F.concat_ws("\n", "title", "body"), x) & (x != "")))
    rows = evaluation.statuses(rows.withColumn("prescreen_score", F.col("score")), rows.where("size(top_comments) > 0"))
    rows = rows.select(
        "post_id", "score", "prediction_status", F.col("kind").alias("predicted_type"), F.col("handness").alias("predicted_handness"), features.buyer_authority(F.col("t")).alias("predicted_authority"), (F.col("score") >= 2).alias("predicted_pain"),
        ((strength >= 2) & ~features.consumer_noise(F.col("t"))).alias("predicted_monetizable"), scoring.opportunity_bucket(F.col("source_created_ts"), SECONDS).alias("predicted_bucket"),
        F.when(F.col("kind") == "founder_pitch", "founder_pitch").when(features.consumer_noise(F.col("t")), "consumer_rant").otherwise("").alias("predicted_negative"), exact.alias("predicted_exact"), F.col("t").alias("t"),
    )
    return evaluation.checked(table(spark, sf_dir, "eval_labels"), posts, rows)


def eval_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.binary_metrics(_predictions(spark, sf_dir), "predicted_pain", "is_pain")


def eval_monetizable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.binary_metrics(_predictions(spark, sf_dir), "predicted_monetizable", "is_monetizable")


def eval_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.confusion(_predictions(spark, sf_dir), "predicted_type", "post_type")


def eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.report(_predictions(spark, sf_dir))


def eval_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.status_counts(_predictions(spark, sf_dir))


def eval_missed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.screened_out_pain(_predictions(spark, sf_dir))


def cluster_usefulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.cluster_usefulness(table(spark, sf_dir, "eval_labels", "cluster_useful"))


def _calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions with the calibration score of factors that the keyword classifier gives."""
    rows = _predictions(spark, sf_dir).where("prediction_status is not null")
    t = F.col("t")
    factors = F.create_map(
        F.lit("intensity"), features.keyword_score(t) / 3.0, F.lit("frequency"), features.workflow_frequency(t, F.col("predicted_type")), F.lit("wtp"), F.col("predicted_monetizable").cast("int") * 0.8, F.lit("buyer_authority"), C.lookup(F.col("predicted_authority"), L.AUTHORITY_SCORES, "unknown"),
        F.lit("evidence_quality"), F.col("predicted_exact") / 3.0, F.lit("odd"), F.lit(5.0),
    )
    penalties = F.create_map(F.lit("stale"), F.when(F.col("predicted_bucket") == "current_opportunity", 0.0).otherwise(0.1), F.lit("negative"), F.when(F.col("predicted_negative") != "", 2.0).otherwise(0.0))
    return rows.select("*", evaluation.calibration_score(factors, penalties).alias("calibrated"), F.col("predicted_exact").alias("exact_evidence_count"))


def calibration_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calibrated(spark, sf_dir).select("post_id", "calibrated")


def calibration_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the 25 best predictions by the calibration score are worth."""
    return evaluation.calibration(_calibrated(spark, sf_dir), "calibrated", 25).withColumn("top_ranked_post_ids", F.array_join("top_ranked_post_ids", ","))


def calibration_of_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of no predictions: shares of nothing are null."""
    return evaluation.calibration(_calibrated(spark, sf_dir).where("calibrated < 0"), "calibrated", 25).drop("top_ranked_post_ids")


def spend_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each region and priority: the small tables are sent to the large one where their size allows."""
    r, n, c, o = (table(spark, sf_dir, x) for x in ("region", "nation", "customer", "orders"))
    rows = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return rows.groupBy("r_name", "o_orderpriority").agg(F.count("*").alias("orders"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))


def part_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best brands by quantity, with their lines."""
    li, p = table(spark, sf_dir, "lineitem", "l_partkey", "l_quantity"), table(spark, sf_dir, "part", "p_partkey", "p_brand")
    parts = li.groupBy("l_partkey").agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("q"), F.count("*").alias("n"))
    brands = parts.join(p, parts.l_partkey == p.p_partkey).groupBy("p_brand").agg(F.sum("q").cast("double").alias("quantity"), F.sum("n").alias("lines"))
    return brands.orderBy(F.col("quantity").desc(), "p_brand").limit(10)


_FUNCTIONS = (
    rank_signal_feed, recent_active, top_tags, tag_pain, unseen_documents, latest_feedback, feedback_summary, daily_spend, spend_crossings, usage_by_stage, prompt_cache, ledger_health, monitor_state, job_status,
    digest_counts, digest_groups, recurring_blockers, category_report, cluster_stats, cluster_incumbents, canonical_keys, latest_signals, competitor_radar, buyer_summary, merged_posts, similar_pairs, cross_pairs, vector_products, best_matches,
    trend_clusters, dedup_merge, signal_upsert, tag_replace, duplicate_merge, eval_binary, eval_monetizable, eval_confusion, eval_report, eval_statuses, eval_missed, cluster_usefulness, calibration_scores, calibration_top, calibration_of_none, spend_by_region, part_revenue,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_ACTIVE = "triage_status NOT IN ('discarded', 'merged')"
_ONCE = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at NULLS LAST) AS rn_ FROM {0} WHERE id IS NOT NULL) WHERE rn_ = 1"
_NAMED = "CASE WHEN trim(coalesce({0}, '')) = '' THEN '{1}' ELSE trim({0}) END"
_DOT = "list_dot_product(list_transform(x.embedding, lambda v: CAST(v AS DOUBLE)), list_transform(y.embedding, lambda v: CAST(v AS DOUBLE)))"
_PAIRS = f"SELECT x.vec_id AS a, y.vec_id AS b, x.label AS la, y.label AS lb, {_DOT} AS s FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id"
_BLANK = r"regexp_full_match(coalesce({0}, ''), '[\s\p{{Z}}\x{{85}}]*')"
_AUTH = "lower(trim(coalesce(buyer_authority, '')))"


def _any(t: str, terms) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(t, x.replace("'", "''")) for x in terms) + ")"


ORACLE = {
    "rank_signal_feed": f"SELECT id, post_id, opportunity_score FROM pain_points WHERE {_ACTIVE} ORDER BY opportunity_score DESC NULLS LAST, willingness_to_pay DESC NULLS LAST, pain_level DESC NULLS LAST, source_created_ts DESC NULLS LAST, created_at DESC NULLS LAST, id LIMIT 50",
    "recent_active": f"SELECT id, subreddit FROM pain_points WHERE {_ACTIVE} AND created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY",
    "top_tags": f"""SELECT competitor_tag, count(*) AS mentions FROM (SELECT DISTINCT post_id, competitor_tag FROM pain_point_competitors) JOIN (SELECT post_id FROM pain_points WHERE {_ACTIVE} AND created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 365 DAY) USING (post_id)
        WHERE competitor_tag IS NOT NULL GROUP BY competitor_tag ORDER BY mentions DESC, competitor_tag LIMIT 20""",
    "tag_pain": f"""SELECT id, willingness_to_pay, pain_level FROM pain_points WHERE {_ACTIVE} AND post_id IN (SELECT post_id FROM pain_point_competitors WHERE competitor_tag = 'kanbrero')
        ORDER BY willingness_to_pay DESC NULLS LAST, pain_level DESC NULLS LAST, id LIMIT 10""",
    "unseen_documents": "SELECT doc_id, post_id FROM documents d WHERE post_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM pain_points p WHERE p.post_id = d.post_id AND p.created_at < TIMESTAMP '2026-01-01')",
    "latest_feedback": f"""SELECT post_id, id, lower(trim(feedback_value)) AS value FROM (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY created_at DESC NULLS LAST, id DESC) AS r FROM ({_ONCE.format('feedback_events')}) WHERE post_id IS NOT NULL) WHERE r = 1""",
    "feedback_summary": f"""SELECT value, coalesce(n, 0) AS n FROM (SELECT unnest([{', '.join(repr(v) for v in L.FEEDBACK)}]) AS value) LEFT JOIN (SELECT lower(trim(feedback_value)) AS value, count(*) AS n FROM ({_ONCE.format('feedback_events')}) GROUP BY 1) USING (value)""",
    "daily_spend": f"SELECT CAST(created_at AS DATE) AS day, count(*) AS calls, CAST(coalesce(sum(CAST(cost_usd AS DECIMAL(18,8))), 0) AS DOUBLE) AS spend FROM ({_ONCE.format('llm_usage_events')}) WHERE created_at IS NOT NULL GROUP BY 1",
    "spend_crossings": f"""WITH e AS (SELECT id, created_at, CAST(created_at AS DATE) AS day, CAST(cost_usd AS DECIMAL(18,8)) AS c FROM ({_ONCE.format('llm_usage_events')}) WHERE created_at IS NOT NULL AND cost_usd IS NOT NULL),
        r AS (SELECT *, sum(c) OVER (PARTITION BY day ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) AS s FROM e)
        SELECT day, id, CAST(s AS DOUBLE) AS spent FROM r WHERE s >= {CAP} AND s - c < {CAP}""",
    "usage_by_stage": f"""SELECT coalesce(candidate_stage, 'none') AS stage, operation, count(*) AS calls, CAST(coalesce(sum(prompt_tokens), 0) AS BIGINT) AS prompt_tokens, CAST(coalesce(sum(completion_tokens), 0) AS BIGINT) AS completion_tokens
        FROM ({_ONCE.format('llm_usage_events')}) GROUP BY 1, 2""",
    "prompt_cache": f"SELECT prompt_hash, count(*) AS calls, arg_min(id, (created_at, id)) AS first_id FROM ({_ONCE.format('llm_usage_events')}) WHERE prompt_hash IS NOT NULL GROUP BY 1",
    "ledger_health": f"""WITH u AS (SELECT id, model, operation, cost_usd, prompt_tokens FROM llm_usage_events UNION ALL SELECT id, [chr(9), concat(' ', chr(10), ' '), chr(160), concat(chr(13), chr(10)), '', 'm'][id], operation, cost_usd, prompt_tokens FROM llm_usage_events WHERE id <= 6)
        SELECT count(*) AS n, count(*) FILTER ({_BLANK.format('model')}) AS no_model, count(*) FILTER ({_BLANK.format('operation')}) AS no_operation, count(*) FILTER (cost_usd IS NULL) AS no_cost, count(*) FILTER (prompt_tokens < 0) AS negative, count(DISTINCT id) AS events FROM u""",
    "monitor_state": f"""SELECT name, active = 1 AND (last_checked IS NULL OR (epoch(TIMESTAMP '{AS_OF}') - floor(epoch(last_checked))) / 3600 >= interval_hours) AS due, substring(coalesce(last_error, ''), 1, 1000) AS error FROM monitored_subreddits""",
    "job_status": "SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY user_id",
    "digest_counts": f"SELECT {_NAMED.format('source', 'unknown')} AS source, {_NAMED.format('niche_category', 'Uncategorized')} AS niche, count(*) AS n FROM pain_points WHERE {_ACTIVE} GROUP BY 1, 2",
    "digest_groups": f"""WITH a AS (SELECT *, concat({_NAMED.format('source', 'unknown')}, '/', {_NAMED.format('opportunity_bucket', 'unknown_age')}) AS label, CASE WHEN isfinite(opportunity_score) THEN opportunity_score ELSE CAST(coalesce(willingness_to_pay, 0) AS DOUBLE) END AS score FROM pain_points WHERE {_ACTIVE}),
        r AS (SELECT label, id, row_number() OVER (PARTITION BY label ORDER BY score DESC, coalesce(source_created_ts, 0) DESC, coalesce(willingness_to_pay, 0) DESC, coalesce(pain_level, 0) DESC, id) AS row_no, max(score) OVER (PARTITION BY label) AS best_score, count(*) OVER (PARTITION BY label) AS group_size FROM a),
        g AS (SELECT label, row_number() OVER (ORDER BY best_score DESC, group_size DESC, lower(label), label) AS group_rank FROM (SELECT DISTINCT label, best_score, group_size FROM r))
        SELECT r.*, group_rank FROM r JOIN g USING (label) WHERE row_no <= 5""",
    "recurring_blockers": "SELECT trim(deep_dive_summary) AS blocker, count(*) AS n FROM pain_points WHERE trim(coalesce(deep_dive_summary, '')) <> '' GROUP BY 1 ORDER BY n DESC, blocker LIMIT 5",
    "category_report": f"SELECT subreddit, {_NAMED.format('category', 'none')} AS category, count(*) AS n, count(*) FILTER (is_monetizable = 1) AS monetizable, avg(pain_level) AS avg_pain FROM pain_points GROUP BY 1, 2",
    "cluster_stats": """SELECT * FROM (SELECT niche_category, count(*) AS item_count, CAST(coalesce(sum(willingness_to_pay), 0) AS BIGINT) AS aggregate_wtp, count(*) FILTER (opportunity_bucket = 'current_opportunity') AS fresh_count, count(*) FILTER (opportunity_bucket = 'evergreen_pain') AS evergreen_count,
        round(median(buyer_authority_score), 3) AS median_authority, CAST(sum(CAST(opportunity_score AS DECIMAL(18,4))) AS DOUBLE) / nullif(count(opportunity_score), 0) AS avg_score, coalesce(max(source_created_ts) FILTER (source_created_ts > 0), 0) AS latest_ts,
        CASE WHEN coalesce(sum(willingness_to_pay), 0) >= 7 * count(*) THEN 'high' WHEN coalesce(sum(willingness_to_pay), 0) >= 4 * count(*) THEN 'medium' ELSE 'low' END AS monetization FROM pain_points WHERE niche_category IS NOT NULL GROUP BY 1) WHERE item_count >= 3""",
    "cluster_incumbents": """WITH t AS (SELECT niche_category, id, list_distinct(list_filter(list_transform(CASE WHEN json_valid(competitor_tags) AND json_type(competitor_tags) = 'ARRAY' THEN from_json(competitor_tags, '["VARCHAR"]') ELSE [] END, lambda x: substring(lower(trim(x)), 1, 64)), lambda x: x <> '')) AS l FROM pain_points WHERE niche_category IS NOT NULL),
        c AS (SELECT niche_category, tool, count(*) AS n FROM (SELECT niche_category, unnest(l) AS tool FROM t) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY niche_category ORDER BY n DESC, tool) AS r FROM c)
        SELECT niche_category, string_agg(tool, ',' ORDER BY r) AS tools FROM r WHERE r <= 5 GROUP BY 1""",
    "canonical_keys": f"""WITH t AS (SELECT subreddit, unnest(regexp_extract_all(lower(concat_ws(' ', coalesce(title, ''), coalesce(summary, ''), coalesce(deep_dive_summary, ''))), '[a-z0-9_]{{2,}}')) AS token FROM pain_points),
        c AS (SELECT subreddit, token, count(*) AS n FROM t WHERE length(token) >= 4 AND token NOT IN ({', '.join(repr(x) for x in L.STOPWORDS)}) AND subreddit IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY subreddit ORDER BY n DESC, token) AS r FROM c),
        k AS (SELECT subreddit, trim(substring(string_agg(token, '-' ORDER BY r), 1, 96), '-') AS canonical_key FROM r WHERE r <= 4 GROUP BY 1)
        SELECT subreddit, canonical_key, array_to_string(list_transform(list_filter(string_split(replace(canonical_key, '_', '-'), '-'), lambda x: x <> '')[1:6], lambda x: concat(upper(x[1]), x[2:])), ' ') AS name FROM k""",
    "latest_signals": "SELECT niche_category, id FROM (SELECT niche_category, id, row_number() OVER (PARTITION BY niche_category ORDER BY created_at DESC NULLS LAST, id DESC) AS r FROM pain_points WHERE trim(coalesce(niche_category, '')) <> '') WHERE r = 1",
    "competitor_radar": f"""WITH p AS (SELECT DISTINCT post_id, lower(trim(competitor_tag)) AS tool FROM pain_point_competitors WHERE post_id IS NOT NULL AND lower(trim(competitor_tag)) <> ''), m AS (SELECT post_id, count(*) > 1 AS several FROM p GROUP BY 1),
        s AS (SELECT post_id, opportunity_score, several, lower(concat_ws(' ', coalesce(title, ''), coalesce(summary, ''))) AS t FROM pain_points JOIN m USING (post_id))
        SELECT tool, count(*) AS mentions, {', '.join(f"count(*) FILTER ({_any('t', terms)}) AS {name}" for name, terms in L.FAILURES)}, count(*) FILTER (several) AS alternative_tool_mentions,
        CAST(sum(CAST(opportunity_score AS DECIMAL(18,4))) FILTER (opportunity_score > 0) AS DOUBLE) / nullif(count(*) FILTER (opportunity_score > 0), 0) AS avg_score FROM p JOIN s USING (post_id) GROUP BY 1""",
    "buyer_summary": f"""WITH w AS (SELECT *, CASE WHEN willingness_to_pay > 0 THEN least(10, CASE WHEN willingness_to_pay <= 1 THEN willingness_to_pay * 10 ELSE willingness_to_pay END) END AS w FROM pain_points)
        SELECT subreddit, count(*) FILTER ({_AUTH} NOT IN ('', 'unknown', 'none', 'n/a')) AS known_buyers, count(DISTINCT {_AUTH}) FILTER ({_AUTH} NOT IN ('', 'unknown', 'none', 'n/a')) AS buyer_roles,
        coalesce(CAST(sum(CAST(buyer_authority_score AS DECIMAL(18,6))) FILTER (buyer_authority_score <> 0) AS DOUBLE) / nullif(count(*) FILTER (buyer_authority_score <> 0), 0), 0) AS avg_authority, coalesce(avg(w), 0) AS avg_wtp,
        count(*) FILTER (regexp_matches(coalesce(body, ''), '(?i){L.WTP_PATTERN}')) AS wtp_texts FROM w GROUP BY 1""",
    "merged_posts": "SELECT post_id, count(*) AS seen, max(length(coalesce(text, ''))) AS longest, min(fetched_at) AS first_fetched, arg_min(source, (fetched_at IS NULL, coalesce(fetched_at, TIMESTAMP '2000-01-01'), doc_id)) AS first_source FROM documents WHERE post_id IS NOT NULL GROUP BY 1",
    "similar_pairs": f"SELECT a, b, round(s, 3) AS similarity FROM ({_PAIRS}) WHERE s >= {PAIRS}",
    "cross_pairs": f"SELECT a, b FROM ({_PAIRS}) WHERE s >= {PAIRS} AND la <> lb",
    "vector_products": f"SELECT x.vec_id, round({_DOT}, 4) AS product, CAST(0 AS DOUBLE) AS odd FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1",
    "best_matches": f"""WITH p AS (SELECT x.vec_id AS id, y.vec_id AS match_id, {_DOT} AS s FROM embeddings x JOIN embeddings y ON x.label <> y.label AND x.vec_id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, match_id) AS r FROM p WHERE s >= 0.2)
        SELECT id, match_id, round(s, 3) AS similarity FROM r WHERE r = 1""",
    "trend_clusters": f"""WITH RECURSIVE p AS MATERIALIZED (SELECT a, b FROM ({_PAIRS}) WHERE s >= {COMPONENTS}), e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), c(node, root) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.node),
        m AS (SELECT node, min(root) AS component FROM c GROUP BY 1), z AS (SELECT component, count(*) AS size FROM m GROUP BY 1 HAVING count(*) >= 3)
        SELECT node AS vec_id, component, size FROM m JOIN z USING (component)""",
    "signal_upsert": """SELECT p.id, p.post_id, 'high' AS severity, CASE WHEN p.id % 2 = 0 THEN p.author_name END AS author_name, CASE WHEN p.id % 2 = 0 THEN p.triage_status ELSE 'new' END AS triage_status,
        CASE WHEN p.id % 2 = 0 AND p.deep_dive_status = 'completed' THEN 'completed' ELSE 'running' END AS deep_dive_status, p.cross_source_count FROM pain_points p""",
    "tag_replace": """SELECT DISTINCT post_id, CASE WHEN post_id LIKE 'reddit:%' THEN 'replaced' ELSE competitor_tag END AS competitor_tag FROM pain_point_competitors""",
    "duplicate_merge": """WITH f AS (SELECT title, source, min(id) AS first, count(*) AS n FROM pain_points WHERE title IS NOT NULL AND source IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1),
        d AS (SELECT p.*, f.first FROM pain_points p JOIN f ON p.title = f.title AND p.source = f.source AND p.id <> f.first),
        g AS (SELECT first, count(*) AS gained, bool_or(triage_status = 'favorite') AS fav, bool_or(deep_dive_status = 'completed') AS done, arg_min(deep_dive_summary, post_id) FILTER (deep_dive_status = 'completed' AND deep_dive_summary IS NOT NULL) AS told FROM d GROUP BY 1)
        SELECT p.id, CASE WHEN d.id IS NOT NULL THEN 'merged' WHEN g.fav THEN 'favorite' ELSE p.triage_status END AS triage_status, CAST(coalesce(p.cross_source_count, 1) + coalesce(g.gained, 0) AS BIGINT) AS cross_source_count, coalesce(g.gained, 0) AS brought,
        CASE WHEN g.done THEN 'completed' ELSE p.deep_dive_status END AS deep_dive_status, md5(coalesce(CASE WHEN g.done AND (coalesce(p.deep_dive_status, '') <> 'completed' OR p.deep_dive_summary IS NULL) THEN coalesce(g.told, p.deep_dive_summary) ELSE p.deep_dive_summary END, '')) AS summary_hash
        FROM pain_points p LEFT JOIN g ON g.first = p.id LEFT JOIN d ON d.id = p.id""",
    "spend_by_region": """SELECT r_name, o_orderpriority, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""",
    "part_revenue": """SELECT p_brand, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity, count(*) AS lines FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 ORDER BY quantity DESC, p_brand LIMIT 10""",
}


def _with_predictions() -> None:
    """The SQL of the evaluation queries, built on that of the text features."""
    from . import text_queries as T

    comments = "list_filter(list_transform(coalesce(top_comments, []), lambda x: " + T._TRIM.format("x") + "), lambda x: x <> '')"
    base = T._BASE.replace(f"SELECT id, post_id, {T._POST} AS t, {T._COMMENTS} AS comments FROM pain_points", f"SELECT post_id, {T._POST} AS t, {comments} AS comments FROM eval_posts")
    spans = f"list_filter(list_filter(list_transform(regexp_split_to_array(w, '[\\n.!?]+'), lambda x: {T._TRIM.format('x')}), lambda x: x <> ''), lambda x: {_any('lower(x)', T._ALL_TERMS)})[1:3]"
    noise = f"{_any('t', L.CONSUMER)} AND NOT {_any('t', L.BUSINESS)}"
    whole = "array_to_string(list_filter([coalesce(title, ''), coalesce(body, '')], lambda x: x <> ''), chr(10))"
    pred = f"""WITH {base}, w AS (SELECT post_id, coalesce(title, '') AS ti, len(top_comments) > 0 AS has_, {whole} AS w, concat_ws(chr(10), title, body) AS src, CASE WHEN source_created_ts > 0 THEN greatest(CAST(0 AS DOUBLE), ({SECONDS} - source_created_ts) / CAST(86400 AS DOUBLE)) END AS age FROM eval_posts),
        sp AS (SELECT *, {spans} AS found FROM w), ex AS (SELECT post_id, has_, age, len(list_filter(CASE WHEN trim(w) = '' THEN [] WHEN len(found) > 0 THEN list_transform(found, lambda x: substring(x, 1, 160)) ELSE [substring(ti, 1, 160)] END, lambda x: x <> '' AND contains(src, x))) AS predicted_exact FROM sp),
        q AS (SELECT post_id, t, kind AS predicted_type, handness AS predicted_handness, {T._AUTHORITY} AS predicted_authority, {T._PRESCREEN} AS score, {T._KEYWORD} AS kw, {noise} AS noise FROM base),
        p AS (SELECT *, score >= 2 AS predicted_pain, greatest(kw, least(3, score)) >= 2 AND NOT noise AS predicted_monetizable, CASE WHEN predicted_type = 'founder_pitch' THEN 'founder_pitch' WHEN noise THEN 'consumer_rant' ELSE '' END AS predicted_negative,
        CASE WHEN age IS NULL THEN 'unknown_age' WHEN age <= 180 THEN 'current_opportunity' ELSE 'evergreen_pain' END AS predicted_bucket, CASE WHEN score < 2 THEN 'screened_out' WHEN has_ THEN 'classified' ELSE 'no_signal' END AS prediction_status FROM q JOIN ex USING (post_id)),
        j AS (SELECT * FROM eval_labels LEFT JOIN p USING (post_id))"""
    share = lambda a, b: f"CASE WHEN {b} = 0 THEN CAST(0 AS DOUBLE) ELSE round({a} / CAST({b} AS DOUBLE), 3) END"
    null_share = lambda a, b: f"CASE WHEN {b} > 0 THEN round({a} / CAST({b} AS DOUBLE), 4) END"
    n = lambda c: f"count(*) FILTER ({c})"
    for name, hit, real in (("eval_binary", "predicted_pain", "is_pain"), ("eval_monetizable", "predicted_monetizable", "is_monetizable")):
        hit = f"coalesce({hit}, false)"
        ORACLE[name] = f"""{pred}, c AS (SELECT {n(f'{hit} AND {real}')} AS tp, {n(f'{hit} AND NOT {real}')} AS fp, {n(f'NOT {hit} AND {real}')} AS fn FROM j)
            SELECT tp, fp, fn, {share('tp', '(tp + fp)')} AS precision, {share('tp', '(tp + fn)')} AS recall, {share('2 * tp', '(2 * tp + fp + fn)')} AS f1 FROM c"""
    ORACLE["eval_confusion"] = f"{pred} SELECT post_type AS actual, predicted_type AS predicted, count(*) AS n FROM j GROUP BY 1, 2"
    ORACLE["eval_statuses"] = f"{pred} SELECT coalesce(prediction_status, 'missing') AS prediction_status, count(*) AS n FROM j GROUP BY 1"
    ORACLE["eval_missed"] = f"{pred} SELECT post_id FROM j WHERE is_pain AND prediction_status = 'screened_out'"
    stale, exact = "NOT is_current_opportunity", "evidence_quality IN ('exact_quote', 'multi_quote')"
    leaked, matched = f"{stale} AND predicted_bucket = 'current_opportunity'", f"{exact} AND predicted_exact > 0"
    negative = "coalesce(hard_negative_type, '') <> ''"
    wrong = f"{negative} AND (predicted_monetizable OR (predicted_pain AND predicted_negative = '') OR (predicted_negative <> '' AND predicted_negative <> hard_negative_type))"
    missed = n("is_pain AND prediction_status = 'screened_out'")
    ORACLE["eval_report"] = f"""{pred} SELECT count(*) AS dataset_size, {n(leaked)} AS stale_leakage_count, {n(stale)} AS stale_candidate_count, {share(n(leaked), n(stale))} AS stale_leakage_rate, {missed} AS screening_false_negative_count,
        {n(wrong)} AS hard_negative_count, {n(negative)} AS hard_negative_candidates, {share(n(wrong), n(negative))} AS hard_negative_rate, {n(matched)} AS exact_match_count, {n(exact)} AS exact_expected_count, {share(n(matched), n(exact))} AS exact_match_rate,
        {share(n('predicted_handness = first_handness'), 'count(*)')} AS first_handness_accuracy, {share(n('predicted_authority = buyer_authority'), 'count(*)')} AS buyer_authority_accuracy FROM j"""
    useful = n("cluster_useful")
    ORACLE["cluster_usefulness"] = f"SELECT count(cluster_useful) AS labeled_count, {useful} AS useful_count, count(cluster_useful) - {useful} AS not_useful_count, {share(useful, 'count(cluster_useful)')} AS useful_rate FROM eval_labels"
    d = T._D
    frequency = f"least({d(1)}, {d(0.32)} + CASE WHEN {_any('t', L.HIGH_FREQUENCY)} THEN {d(0.33)} ELSE {d(0)} END + CASE WHEN {_any('t', (*L.WORKAROUND, *L.FREQUENCY_CONTEXT))} THEN {d(0.2)} ELSE {d(0)} END + CASE WHEN predicted_type IN ('first_person_pain', 'solution_request', 'vendor_rant') THEN {d(0.1)} ELSE {d(0)} END)"
    factors = f"({d(0)} + kw / {d(3)} * {d(0.18)} + {frequency} * {d(0.14)} + CAST(predicted_monetizable AS INTEGER) * {d(0.8)} * {d(0.14)} + {T._scores('predicted_authority', L.AUTHORITY_SCORES)} * {d(0.12)} + least({d(1)}, predicted_exact / {d(3)}) * {d(0.08)})"
    lost = f"(CASE WHEN predicted_bucket = 'current_opportunity' THEN {d(0)} ELSE {d(0.1)} END + CASE WHEN predicted_negative <> '' THEN {d(1)} ELSE {d(0)} END)"
    scored = f"{pred}, k AS (SELECT *, round(greatest({d(0)}, least({d(100)}, ({factors} - {lost}) * 100)), 4) AS calibrated FROM j WHERE prediction_status IS NOT NULL)"
    ORACLE["calibration_scores"] = f"{scored} SELECT post_id, calibrated FROM k"
    asked = "lower(trim(coalesce(evidence_quality, ''))) IN ('exact_quote', 'multi_quote', 'linked_multi_source')"
    rates = f"count(*) AS n, {null_share(n('feedback_useful'), 'count(*)')} AS top_n_useful_rate, {null_share(n('is_monetizable'), 'count(*)')} AS monetizable_precision, {null_share(n(f'{asked} AND predicted_exact > 0'), n(asked))} AS evidence_exact_match_rate"
    ORACLE["calibration_top"] = f"{scored} SELECT {rates}, string_agg(post_id, ',' ORDER BY calibrated DESC, post_id) AS top_ranked_post_ids FROM (SELECT * FROM k ORDER BY calibrated DESC, post_id LIMIT 25)"
    ORACLE["calibration_of_none"] = f"{scored} SELECT {rates} FROM k WHERE calibrated < 0"


_with_predictions()
