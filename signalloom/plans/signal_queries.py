"""Queries on clusters, exports, digests, stores and answers, with the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import lexicons as L
from ..functions import columns as C
from ..operators import answers, clusters, enrich, features, graph, similarity, store, trends, usage, views
from ..sources.tables import spread, table
from . import analysis
from .text_queries import _LIST, _TRIM, AS_OF

#: The time that windows are reckoned back from, and thresholds at which the test data give rows.
AS_OF_TEXT, COMPONENTS = "2026-04-21 00:00:00", 0.40


def _signals(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "pain_points", *columns)


def export_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of the export with its place: favourites, then by score, willingness to pay, pain and time."""
    rows = views.exported(_signals(spark, sf_dir, "id", "triage_status", "opportunity_score", "willingness_to_pay", "pain_level", "created_at"), AS_OF)
    return views.with_place(rows, views.export_order(), "place").select("id", "place")


def export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _signals(spark, sf_dir, *dict.fromkeys([c for c in views.EXPORT_COLUMNS if c not in ("promotion_eligible", "evidence_rejection_reason", "hard_negative_type", "verified_evidence_count")] + ["id", "analysis_payload_json"]))
    return views.export_rows(views.exported(rows, AS_OF)).drop("created_at")


def export_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an export of one bucket, of the last 120 days and without favourites takes."""
    rows = _signals(spark, sf_dir, "id", "subreddit", "opportunity_bucket", "triage_status", "willingness_to_pay", "source_created_ts")
    return views.exported(rows, AS_OF, min_wtp=5, favourites=False, bucket="current_opportunity", max_age_days=120).select("id", "subreddit")


def artifact_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File and worksheet names for each niche."""
    rows = _signals(spark, sf_dir, "niche_category").distinct()
    return rows.select("niche_category", views.artifact_stem(F.col("niche_category")).alias("stem"), views.worksheet_name(F.lit("pain finder"), F.col("niche_category")).alias("sheet"))


def macro_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _signals(spark, sf_dir, "id", "triage_status", "created_at", "opportunity_score", "willingness_to_pay", "pain_level")
    return clusters.candidates(rows, AS_OF_TEXT, 60, 8).select("id", "ordinal")


def candidate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _signals(spark, sf_dir, "id", "post_id", "title", "summary", "deep_dive_summary", "competitor_tags", "willingness_to_pay")
    return rows.select("id", F.md5(clusters.candidate_text()).alias("text_hash"), F.md5(clusters.candidate_line()).alias("line_hash"))


def cluster_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of niches as clusters of three signals or more."""
    c = ("niche_category", "title", "summary", "deep_dive_summary", "willingness_to_pay", "opportunity_bucket", "buyer_authority_score", "opportunity_score", "source_created_ts", "competitor_tags")
    out = clusters.headers(_signals(spark, sf_dir, *c), "niche_category", min_size=3)
    return views.with_place(out.withColumn("incumbents", F.array_join("incumbents", ",")), clusters.order(), "place")


def cluster_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of severities as clusters, with a given label, and of texts without words, which are named by their hash."""
    rows = _signals(spark, sf_dir, "severity", "title", "summary", "deep_dive_summary").select(C.text("severity").alias("c"), "title", "summary", "deep_dive_summary")
    bare = _signals(spark, sf_dir, "severity").select(F.concat(F.lit("bare-"), C.text("severity")).alias("c")).distinct().select("c", F.lit("a b").alias("title"), F.lit(None).cast("string").alias("summary"), F.lit("!").alias("deep_dive_summary"))
    labels = rows.select("c").distinct().select("c", F.lit("Zebra Exports").alias("label"), F.array(F.lit("zebra quagga"), F.lit("the zoo")).alias("key_complaints"))
    return clusters.keys_of(rows.unionByName(bare), "c", labels, words=200_000, longest=5_000_000).select(F.col("c").alias("cluster"), F.when(F.col("canonical_key").startswith("cluster-"), F.col("canonical_key")).otherwise(F.md5("canonical_key")).alias("key"))


def member_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How near each vector is to all of its label."""
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    return clusters.member_similarity(rows, "label", "vec_id", "embedding").select("label", "vec_id", F.round("similarity", 4).alias("similarity"))


def cluster_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of vectors by single linkage with the sorted ids of their members."""
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    found = graph.components(similarity.similar_pairs(rows, "vec_id", "embedding", COMPONENTS)).select(F.col("component").alias("cluster"), F.lpad(F.col("node").cast("string"), 9, "0").alias("post_id"))
    heads = found.groupBy("cluster").agg(F.count("*").alias("n"))
    return clusters.with_members(heads, found).select("cluster", "n", F.array_join("post_ids", ",").alias("post_ids"))


def _runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Clusters of monthly runs, a niche each, and their members."""
    rows = _signals(spark, sf_dir, "post_id", "niche_category", "created_at", "opportunity_score", "source_created_ts", "willingness_to_pay", "triage_status").where("niche_category is not null and created_at is not null")
    rows = rows.withColumns({"run_id": (F.year("created_at") * 12 + F.month("created_at")).cast("long"), "run_created_at": F.date_trunc("month", "created_at")}).withColumn("cluster", F.concat_ws("/", "run_id", "niche_category"))
    heads = rows.groupBy("cluster", "run_id", "run_created_at", F.col("niche_category").alias("canonical_key")).agg(F.max("opportunity_score").alias("avg_opportunity_score"), F.max("source_created_ts").alias("latest_source_created_ts"), F.count("*").alias("item_count"), F.sum("willingness_to_pay").alias("aggregate_wtp"))
    return heads, rows.select("cluster", "post_id", "triage_status", "run_id", "run_created_at")


def clusters_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 40 clusters of different niches, the latest run first."""
    return clusters.latest(_runs(spark, sf_dir)[0], 40).select("cluster", "run_id", "item_count")


def clusters_with_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of clusters that have a favourite."""
    heads, members = _runs(spark, sf_dir)
    return clusters.latest(heads, 40, members=members, posts=members.where("triage_status = 'favorite'")).select("cluster", "run_id", "item_count")


def clusters_of_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest cluster of each post, of a first run by subreddit and a second by niche, which lacks some."""
    rows = _signals(spark, sf_dir, "post_id", "subreddit", "niche_category")
    one, two = rows.select("post_id", F.concat(F.lit("a:"), "subreddit").alias("cluster")), rows.where("niche_category is not null").select("post_id", F.concat(F.lit("b:"), "niche_category").alias("cluster"))
    members = one.unionAll(two).where("cluster is not null")
    heads = one.select("cluster", F.lit(1).alias("run_id")).unionAll(two.select("cluster", F.lit(2))).where("cluster is not null").distinct()
    runs = spark.sql("select * from values (1, timestamp_ntz'2026-01-01 00:00:00'), (2, timestamp_ntz'2026-02-01 00:00:00') as t(run_id, run_created_at)")
    return clusters.of_posts(members, heads, runs)


def cluster_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole run over candidates of the last year: candidates, word vectors, single linkage and headers."""
    c = ("id", "post_id", "title", "summary", "deep_dive_summary", "competitor_tags", "triage_status", "created_at", "opportunity_score", "willingness_to_pay", "pain_level", "opportunity_bucket", "buyer_authority_score", "source_created_ts")
    _, heads, _ = clusters.run(_signals(spark, sf_dir, *c), AS_OF_TEXT, 365, min_size=2)
    return heads.withColumn("incumbents", F.array_join("incumbents", ","))


def digest_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a digest tells of the last 30 days, clusters included."""
    c = ("id", "post_id", "niche_category", "source", "opportunity_score", "pain_level", "willingness_to_pay", "source_created_ts", "evidence_spans_json", "deep_dive_summary", "triage_status", "created_at")
    rows = views.since(views.active(_signals(spark, sf_dir, *c)), AS_OF_TEXT, 30)
    heads, members = _runs(spark, sf_dir)
    return views.digest(rows, clusters.latest(heads, 5, members=members, posts=rows))


def digest_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active signals as sections by bucket and groups by niche: the groups' rank, and the three best rows of each."""
    rows = views.active(_signals(spark, sf_dir, "id", "niche_category", "opportunity_bucket", "triage_status", "opportunity_score", "willingness_to_pay", "source_created_ts", "pain_level"))
    rows = rows.withColumns({"bucket": views.shown_bucket(F.col("opportunity_bucket")), "label": views.named("niche_category", "Uncategorized"), "score": views.row_score(F.col("opportunity_score"), F.col("willingness_to_pay"))})
    order = [F.col("score").desc(), *(F.coalesce(F.col(c), F.lit(0)).desc() for c in ("source_created_ts", "willingness_to_pay", "pain_level")), F.col("id")]
    out = views.grouped_rows(rows, "label", 3, order, "score", within="bucket")
    return out.select("bucket", "label", F.col("group_rank").cast("long").alias("group_rank"), "group_size", F.col("row_no").cast("long").alias("row_no"), "id")


def signal_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of five signals by willingness to pay and pain."""
    rows = _signals(spark, sf_dir, "id", "willingness_to_pay", "pain_level")
    return views.page(rows, [F.col("willingness_to_pay").desc_nulls_last(), F.col("pain_level").desc_nulls_last(), F.col("id").asc()], 2).select("id")


def triage_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals after the last feedback on them: useful ones become favourites, those that are no pain are discarded."""
    said = usage.delivered_once(table(spark, sf_dir, "feedback_events", "id", "post_id", "feedback_value", "created_at"))
    last = views.latest_per_key(store.checked_feedback(said, ("useful", "not_a_pain"), strict=False), "post_id", [F.col("created_at").desc_nulls_last(), F.col("id").desc()])
    changes = last.select("post_id", F.when(F.col("feedback_value") == "useful", "favorite").otherwise("discarded").alias("triage_status"))
    return store.set_triage(_signals(spark, sf_dir, "id", "post_id", "triage_status"), changes).select("id", "triage_status")


def deep_dive_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals after queued deep dives failed with an error and running ones were completed with a summary."""
    rows = _signals(spark, sf_dir, "id", "post_id", "title", "deep_dive_status", "deep_dive_summary")
    none = F.lit(None).cast("string")
    failed = rows.where("deep_dive_status = 'queued'").select("post_id", F.lit("failed").alias("deep_dive_status"), none.alias("summary"), F.lit("timeout").alias("error"))
    done = rows.where("deep_dive_status = 'running'").select("post_id", F.lit("completed"), "title", none)
    return store.set_deep_dive(rows, failed.unionAll(done)).select("id", "deep_dive_status", F.md5(C.text("deep_dive_summary")).alias("summary_hash"))


def vector_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals after word vectors were stored for those that had none and aren't merged."""
    rows = spread(_signals(spark, sf_dir, "id", "post_id", "title", "summary", "deep_dive_summary", "competitor_tags", "triage_status", "emb_vector"))
    made = store.without_vector(rows).select("post_id", clusters.vectors(rows).alias("vector"))
    return store.set_vectors(rows, made).select("id", F.size(F.from_json("emb_vector", "array<double>")).alias("size"), (F.col("triage_status") != "merged").alias("searched"))


def answer_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache of the calls before February, after the later ones were put into it: the last of each prompt."""
    u = usage.delivered_once(table(spark, sf_dir, "llm_usage_events", "id", "prompt_hash", "model", "created_at")).where("prompt_hash is not null and created_at is not null")
    old = views.latest_per_key(u.where("created_at < '2025-02-01'"), "prompt_hash", [F.col("created_at").desc(), F.col("id").desc()])
    return store.put_keyed(old, u.where("created_at >= '2025-02-01'"), "prompt_hash", ["created_at", "id"]).select("prompt_hash", "id", "model")


def payload_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many stored payloads are JSON objects, and how many are to be dropped."""
    good, bad = store.readable_answers(_signals(spark, sf_dir, "evidence_spans_json", "score_components_json").select(F.explode(F.array("evidence_spans_json", "score_components_json")).alias("response_json")))
    return good.agg(F.count("*").alias("n")).select(F.lit("kept").alias("what"), "n").unionAll(bad.agg(F.count("*").alias("n")).select(F.lit("dropped"), "n"))


def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of users' jobs after their events: clicks and views succeed, errors fail with a long message."""
    e = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type")
    runs = e.select(F.col("user_id").alias("job_name"), F.col("ts").alias("at"), F.when(F.col("event_type") == "error", F.repeat(F.concat(F.lit("failed at "), F.col("event_id").cast("string"), F.lit(". ")), 100)).alias("error"))
    old = runs.limit(0).select("job_name", F.col("at").alias("last_run"), F.col("at").alias("last_success"), F.col("error").alias("last_error"))
    return store.status_after(old, runs).select(F.col("job_name").alias("user_id"), "last_run", "last_success", F.md5(C.text("last_error")).alias("error_hash"))


def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run counts, in one pass: stored, known before, dropped by the prescreen, kept, monetisable, and by mode."""
    rows = spread(_signals(spark, sf_dir, "title", "body", "comment_sample_json", "is_monetizable", "triage_status", "deep_dive_status", "analysis_mode"))
    rows = rows.withColumns({"t": features.post_text(), "comments": C.filled(C.json_list("comment_sample_json"))}).withColumn("category", features.keyword_category(F.col("t")))
    rows = rows.withColumn("handness", features.first_handness(F.col("t"), features.post_type(F.col("t"), F.col("category"))))
    rows = rows.withColumn("score", features.prescreen_score(F.col("t"), F.col("comments"), F.col("handness")))
    return rows.agg(
        F.count("*").alias("posts"), F.count_if(F.col("score") < 2).alias("dropped"), F.count_if(F.col("score") >= 2).alias("kept"), F.greatest(F.lit(0), F.count_if(F.col("score") >= 2) - 100).alias("capped"), F.count_if(F.col("is_monetizable") == 1).alias("monetizable"),
        F.count_if(F.col("deep_dive_status") == "completed").alias("deep_dives"), F.count_if(F.col("triage_status") == "merged").alias("merged"), F.count_if(F.col("analysis_mode").startswith("legacy")).alias("legacy"), F.count_if(F.col("analysis_mode").endswith("b2b")).alias("b2b"),
    )


def _evidence() -> Column:
    """Quotes that stand in the title or body count as exact."""
    return F.transform(C.json_list("evidence_spans_json"), lambda x: F.struct(x.alias("quote"), F.when(F.contains(F.concat_ws("\n", "title", "body"), x), "exact").otherwise("none").alias("match_type")))


def tool_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _signals(spark, sf_dir, "id", "post_id", "title", "body", "evidence_spans_json")
    return trends.tool_quotes(rows, table(spark, sf_dir, "pain_point_competitors", "post_id", "competitor_tag"), _evidence()).select("tool", F.array_join("quotes", "|").alias("quotes"))


def buyer_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trends.buyer_roles(_signals(spark, sf_dir, "id", "subreddit", "buyer_authority"), "subreddit").withColumn("place", F.col("place").cast("long"))


def buyer_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _signals(spark, sf_dir, "id", "subreddit", "title", "body", "evidence_spans_json", "deep_dive_summary")
    out = trends.buyer_words(rows, "subreddit", _evidence(), F.col("deep_dive_summary"))
    return out.select("subreddit", F.array_join("wtp_quotes", "|").alias("wtp_quotes"), F.array_join("uncertainties", "|").alias("uncertainties"))


def exact_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes of each signal that match exactly, and those that match at all."""
    rows = _signals(spark, sf_dir, "id", "title", "body", "evidence_spans_json")
    return rows.select("id", F.array_join(C.exact_quotes(_evidence()), "|").alias("exact"), F.size(C.grounded_quotes(_evidence())).alias("grounded"))


def thread_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies with comments, whole threads, valid names and keys of answers."""
    rows = spread(_signals(spark, sf_dir, "id", "post_id", "subreddit", "title", "body", "comment_sample_json")).withColumn("c", C.json_list("comment_sample_json"))
    return rows.select("id", F.md5(C.with_comments(F.col("body"), F.col("c"))).alias("body_hash"), F.md5(C.thread_prompt(F.col("title"), F.col("body"), F.col("c"))).alias("thread_hash"), C.valid_feed(F.col("subreddit")).alias("feed"), C.valid_post_id(F.col("post_id")).alias("named"), enrich.answer_key("classify", "m", C.text("title")).alias("answer_key"))


def tag_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of JSON lists and, for every other signal, of the same as a comma-separated text."""
    rows = _signals(spark, sf_dir, "id", "competitor_tags")
    mixed = F.when(F.col("id") % 2 == 1, F.col("competitor_tags")).otherwise(F.array_join(C.json_list("competitor_tags"), " , "))
    return rows.select("id", F.array_join(C.tag_list(mixed), ",").alias("tags"))


def signal_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a writer of texts about signals needs: title, summary, deep dive and trend as lines."""
    rows = _signals(spark, sf_dir, "id", "post_id", "title", "summary", "deep_dive_summary", "niche_category", "created_at")
    posts = rows.select("id", "post_id", "title", "summary")
    trend = rows.select("post_id", F.col("niche_category").alias("label"), "created_at").where("label is not null")
    out = enrich.with_context(posts, rows.select("post_id", "deep_dive_summary"), trend)
    return out.select("id", F.md5("context").alias("context_hash"))


def answer_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers made of signals, a part of them broken, held against the contract of classifications."""
    rows = _signals(spark, sf_dir, "id", "category", "severity", "summary", "is_monetizable", "pain_level", "willingness_to_pay", "niche_category", "competitor_tags", "post_type")
    payload = F.to_json(F.struct("category", "severity", "summary", (F.col("is_monetizable") == 1).alias("is_monetizable"), "pain_level", "willingness_to_pay", C.text("niche_category").alias("niche_category"), C.json_list("competitor_tags").alias("competitor_tags"), "post_type"), {"ignoreNullFields": "true"})
    made = rows.select("id", F.when(F.col("id") % 7 == 0, F.concat(F.lit("```json\n"), payload, F.lit("\n```"))).when(F.col("id") % 7 == 1, F.concat(payload, F.lit("}{"))).otherwise(payload).alias("payload"))
    out = made.withColumns({"one": answers.primary(F.col("payload")), "old": answers.legacy(F.col("payload"))})
    return out.select("id", F.col("one").isNotNull().alias("primary_valid"), F.col("old").isNotNull().alias("legacy_valid"), F.col("one.willingness_to_pay").alias("willingness_to_pay"), F.col("old.post_type").alias("post_type"))


def usage_of_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of responses, of which some report none or negative ones."""
    u = usage.delivered_once(table(spark, sf_dir, "llm_usage_events", "id", "prompt_tokens", "completion_tokens", "created_at"))
    body = F.when(F.col("id") % 5 == 0, F.lit('{"choices": []}')).when(F.col("id") % 5 == 1, F.to_json(F.struct(F.struct((-F.col("prompt_tokens")).alias("prompt_tokens"), F.lit("x").alias("completion_tokens")).alias("usage")))).otherwise(F.to_json(F.struct(F.struct("prompt_tokens", "completion_tokens").alias("usage"))))
    return answers.usage_events(u.select("id", body.alias("response_json")))


def monitored_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds in the order of their names."""
    rows = table(spark, sf_dir, "monitored_subreddits", "name", "active")
    return views.with_place(rows, [F.col("name").asc(), F.col("active").asc()], "place")


def radar_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tools in the order of a radar."""
    found = trends.competitor_radar(_signals(spark, sf_dir, "post_id", "title", "summary", "opportunity_score"), table(spark, sf_dir, "pain_point_competitors", "post_id", "competitor_tag"))
    rows = found.select("tool", "mentions", F.round("avg_score", 3).alias("avg_score"))
    return views.with_place(rows, trends.radar_order(), "place").select("tool", "place")


def stored_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals in the form in which they are stored, a part of them with odd statuses."""
    rows = _signals(spark, sf_dir, "id", "triage_status", "opportunity_bucket", "evidence_spans_json", "comment_sample_json", "competitor_tags", "opportunity_score")
    odd = rows.withColumns({"triage_status": F.when(F.col("id") % 3 == 0, "odd").otherwise(F.col("triage_status")), "opportunity_bucket": F.when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.col("opportunity_bucket"))})
    out = store.stored_form(odd)
    return out.select("id", "triage_status", "opportunity_bucket", F.md5(F.array_join(C.json_list("evidence_spans_json"), "|")).alias("quotes_hash"), F.md5(F.array_join(C.json_list("comment_sample_json"), "|")).alias("comments_hash"), F.array_join(C.json_list("competitor_tags"), ",").alias("tags"), "opportunity_score")


def monitoring_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.monitoring_summary(table(spark, sf_dir, "monitored_subreddits", "active"), _signals(spark, sf_dir, "triage_status"), table(spark, sf_dir, "feedback_events", "id", "feedback_value", "created_at"))


def online_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors after those of ids divisible by 100 came in and were merged into their best match of another label."""
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    found = similarity.best_matches(rows.where("vec_id % 100 = 0"), rows.where("vec_id % 100 <> 0"), "vec_id", "embedding", 0.2, group_col="label")
    pairs = found.select(F.col("match_id").cast("string").alias("canonical_id"), F.col("id").cast("string").alias("duplicate_id"))
    stored = rows.select(F.col("vec_id").cast("string").alias("post_id"), F.lit("new").alias("triage_status"), F.lit(1).cast("long").alias("cross_source_count"), F.lit("[]").alias("cross_source_ids"))
    return store.merge_duplicates(stored, pairs).select("post_id", "triage_status", "cross_source_count")


def analysis_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over the evaluation posts: what was kept of them, as signals."""
    posts = table(spark, sf_dir, "eval_posts", "post_id", "subreddit", "title", "body", "url", "source", "source_created_ts", "author_name", "top_comments")
    signals, _ = analysis.run(posts, _signals(spark, sf_dir, "post_id"), AS_OF)
    return signals


def analysis_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of a run that keeps 50 posts, of which those with odd scores are known."""
    posts = table(spark, sf_dir, "eval_posts", "post_id", "title", "body", "top_comments", "score", "source_created_ts")
    _, counts = analysis.run(posts.drop("score"), posts.where("score % 2 = 1"), AS_OF, most=50)
    return counts


_FUNCTIONS = (
    stored_signals, monitoring_summary, online_merge, analysis_run, analysis_counts, export_order, export_rows, export_filtered, artifact_names, macro_candidates, candidate_texts, cluster_headers, cluster_keys, member_similarity, cluster_members, clusters_latest, clusters_with_posts, clusters_of_posts, cluster_run,
    digest_payload, digest_sections, signal_page, triage_update, deep_dive_update, vector_backfill, answer_cache, payload_health, job_states, run_counters, tool_quotes, buyer_roles, buyer_words, exact_quotes, thread_texts, tag_texts,
    signal_context, answer_shapes, usage_of_responses, monitored_lists, radar_places,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_ACTIVE = "triage_status NOT IN ('discarded', 'merged')"
_ONCE = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at NULLS LAST) AS rn_ FROM {0} WHERE id IS NOT NULL) WHERE rn_ = 1"
_NAMED = "CASE WHEN trim(coalesce({0}, '')) = '' THEN '{1}' ELSE trim({0}) END"
_TAKEN = f"{_ACTIVE} AND (willingness_to_pay >= 8 OR triage_status = 'favorite')"
_CELL = "CASE WHEN regexp_matches(ltrim({0}, ' '), '^[=+\\-@]') THEN concat('''', {0}) ELSE {0} END AS {0}"
_STEM = "regexp_replace(regexp_replace(" + _TRIM.format("coalesce(niche_category, '')") + ", '[^A-Za-z0-9_.-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g')"
_SCORED = "CASE WHEN isfinite(opportunity_score) THEN opportunity_score ELSE {0} END"
_RUNS = """rows_ AS (SELECT *, year(created_at) * 12 + month(created_at) AS run_id, date_trunc('month', created_at) AS run_at, concat(CAST(year(created_at) * 12 + month(created_at) AS VARCHAR), '/', niche_category) AS cluster FROM pain_points WHERE niche_category IS NOT NULL AND created_at IS NOT NULL),
    heads AS (SELECT cluster, run_id, run_at, niche_category AS k, max(opportunity_score) AS s, max(source_created_ts) AS t, count(*) AS item_count, sum(willingness_to_pay) AS w FROM rows_ GROUP BY ALL)"""
_LATEST = """f AS (SELECT *, row_number() OVER (PARTITION BY trim(k) ORDER BY run_at DESC, run_id DESC, s DESC NULLS LAST, t DESC NULLS LAST, item_count DESC, w DESC NULLS LAST, cluster) AS r FROM heads WHERE trim(k) <> '' {0})"""
_FIRST = "ORDER BY run_at DESC, run_id DESC, s DESC NULLS LAST, t DESC NULLS LAST, item_count DESC, w DESC NULLS LAST, cluster LIMIT {0}"
_EVIDENCE = f"list_filter({_LIST.format('evidence_spans_json')}, lambda x: contains(concat_ws(chr(10), title, body), x))"
_EXACT = f"list_filter(list_transform({_EVIDENCE}, lambda x: {_TRIM.format('x')}), lambda x: x <> '')"
_DISTINCT = "list_filter(q, lambda x, i: list_position(list_transform(q, lambda y: lower(y)), lower(x)) = i)"
_LINES = "array_to_string(list_transform(c, lambda x: concat('- ', x)), chr(10))"
_LINE = "CASE WHEN trim(coalesce({1}, '')) <> '' THEN concat('{0}: ', trim({1})) END"
_TOOLS = f"list_filter(list_transform({_LIST.format('competitor_tags')}, lambda x: lower({_TRIM.format('x')})), lambda x: x <> '')"
_STOP = ", ".join(repr(x) for x in L.STOPWORDS)
_WORDS = "regexp_extract_all(lower(concat_ws(' ', coalesce(title, ''), coalesce(summary, ''), coalesce(deep_dive_summary, ''))), '[a-z0-9_]{2,}')"


def _first_distinct(source: str, group: str, value: str, seen: str, k: int) -> str:
    """Of rows of a subquery, the first k values of each group in the order of `seen`, differing in more than case."""
    return f"""(SELECT {group}, string_agg(v, '|' ORDER BY r) AS l FROM (SELECT {group}, v, row_number() OVER (PARTITION BY {group} ORDER BY o, v) AS r
        FROM (SELECT {group}, lower({value}) AS low, arg_min({value}, ({seen}, {value})) AS v, min({seen}) AS o FROM {source} WHERE trim({value}) <> '' GROUP BY 1, 2)) WHERE r <= {k} GROUP BY 1)"""


_CUT = "array_to_string(list_transform((list_filter(list_transform(" + _LIST + ", lambda x: " + _TRIM.format("x").replace("{", "{{").replace("}", "}}") + "), lambda x: x <> ''))[1:{1}], lambda x: substring(x, 1, {2})), '|')"
_DOT = "list_dot_product(list_transform(x.embedding, lambda v: CAST(v AS DOUBLE)), list_transform(y.embedding, lambda v: CAST(v AS DOUBLE)))"

ORACLE = {
    "stored_signals": f"""WITH t AS (SELECT *, list_filter(list_transform({_LIST.format('competitor_tags')}, lambda x: substring(lower({_TRIM.format('x')}), 1, 64)), lambda x: x <> '') AS a FROM pain_points)
        SELECT id, CASE WHEN id % 3 = 0 THEN 'new' ELSE triage_status END AS triage_status, CASE WHEN id % 3 = 1 THEN 'unknown_age' ELSE opportunity_bucket END AS opportunity_bucket, md5({_CUT.format('evidence_spans_json', 3, 160)}) AS quotes_hash, md5({_CUT.format('comment_sample_json', 5, 240)}) AS comments_hash,
        array_to_string(list_filter(a, lambda x, i: list_position(a, x) = i), ',') AS tags, opportunity_score FROM t""",
    "monitoring_summary": f"""SELECT (SELECT count(*) FROM monitored_subreddits WHERE active = 1) AS monitored, (SELECT count(*) FROM pain_points WHERE triage_status = 'favorite') AS favorites,
        (SELECT count(*) FROM ({_ONCE.format('feedback_events')}) WHERE lower(trim(feedback_value)) IN ({', '.join(repr(v) for v in L.FEEDBACK)})) AS feedback_total""",
    "online_merge": f"""WITH p AS (SELECT x.vec_id AS id, y.vec_id AS match_id, {_DOT} AS s FROM embeddings x JOIN embeddings y ON x.label <> y.label AND x.vec_id % 100 = 0 AND y.vec_id % 100 <> 0), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, match_id) AS r FROM p WHERE s >= 0.2),
        m AS (SELECT * FROM r WHERE r = 1) SELECT CAST(vec_id AS VARCHAR) AS post_id, CASE WHEN vec_id IN (SELECT id FROM m) THEN 'merged' ELSE 'new' END AS triage_status, 1 + (SELECT count(*) FROM m WHERE match_id = vec_id) AS cross_source_count FROM embeddings""",
    "export_order": f"SELECT id, row_number() OVER (ORDER BY CASE WHEN triage_status = 'favorite' THEN 0 ELSE 1 END, opportunity_score DESC NULLS LAST, willingness_to_pay DESC NULLS LAST, pain_level DESC NULLS LAST, created_at DESC NULLS LAST, id) - 1 AS place FROM pain_points WHERE {_TAKEN}",
    "export_rows": f"""WITH p AS (SELECT *, coalesce(analysis_payload_json ->> '$.promotion_eligible', '') AS promotion_eligible, coalesce(analysis_payload_json ->> '$.evidence_rejection_reason', '') AS evidence_rejection_reason, coalesce(analysis_payload_json ->> '$.hard_negative_type', '') AS hard_negative_type FROM pain_points WHERE {_TAKEN})
        SELECT {', '.join(_CELL.format(c) for c in ('subreddit', 'source', 'post_id', 'title', 'summary', 'niche_category', 'competitor_tags', 'category', 'severity', 'promotion_eligible', 'evidence_rejection_reason', 'hard_negative_type', 'triage_status', 'deep_dive_status', 'deep_dive_summary', 'url'))},
        pain_level, willingness_to_pay, opportunity_score, 0 AS verified_evidence_count FROM p""",
    "export_filtered": f"SELECT id, subreddit FROM pain_points WHERE {_ACTIVE} AND willingness_to_pay >= 5 AND opportunity_bucket = 'current_opportunity' AND source_created_ts >= {AS_OF} - 120 * 86400",
    "artifact_names": f"""WITH n AS (SELECT DISTINCT niche_category FROM pain_points), s AS (SELECT niche_category, {_STEM} AS s FROM n)
        SELECT niche_category, CASE WHEN s = '' THEN 'scope' ELSE s END AS stem, regexp_replace(substring(concat('pain_finder_', CASE WHEN s = '' THEN 'all' ELSE s END), 1, 100), '[._-]+$', '') AS sheet FROM s""",
    "macro_candidates": f"SELECT id, row_number() OVER (ORDER BY opportunity_score DESC NULLS LAST, willingness_to_pay DESC NULLS LAST, pain_level DESC NULLS LAST, created_at DESC NULLS LAST, id) - 1 AS ordinal FROM pain_points WHERE {_TAKEN} AND created_at >= TIMESTAMP '{AS_OF_TEXT}' - INTERVAL 60 DAY",
    "candidate_texts": f"""WITH p AS (SELECT *, concat_ws(' | ', coalesce(title, ''), coalesce(summary, ''), coalesce(deep_dive_summary, ''), array_to_string(({_LIST.format('competitor_tags')})[1:8], ', ')) AS t FROM pain_points)
        SELECT id, md5({_TRIM.format('t')}) AS text_hash, md5(concat('- post=', coalesce(post_id, ''), ' wtp=', coalesce(willingness_to_pay, 0), ' summary=', substring(coalesce(summary, ''), 1, 180))) AS line_hash FROM p""",
    "cluster_headers": f"""WITH g AS (SELECT niche_category, count(*) AS item_count, CAST(sum(coalesce(willingness_to_pay, 0)) AS DOUBLE) AS aggregate_wtp, count(*) FILTER (opportunity_bucket = 'current_opportunity') AS fresh_post_count, count(*) FILTER (opportunity_bucket = 'evergreen_pain') AS evergreen_post_count,
        CAST(round(CAST(median(coalesce(buyer_authority_score, 0)) AS DECIMAL(18,10)), 3) AS DOUBLE) AS median_buyer_authority, CAST(round(CAST(CAST(sum(CAST(coalesce(opportunity_score, 0) AS DECIMAL(18,4))) AS DOUBLE) / count(*) AS DECIMAL(18,10)), 2) AS DOUBLE) AS avg_opportunity_score, max(source_created_ts) FILTER (source_created_ts > 0) AS latest_source_created_ts
        FROM pain_points WHERE niche_category IS NOT NULL GROUP BY 1 HAVING count(*) >= 3),
        t AS (SELECT niche_category, tool, count(*) AS n FROM (SELECT niche_category, unnest({_TOOLS}) AS tool FROM pain_points) GROUP BY 1, 2), tr AS (SELECT *, row_number() OVER (PARTITION BY niche_category ORDER BY n DESC, tool) AS r FROM t),
        ti AS (SELECT niche_category, string_agg(tool, ',' ORDER BY r) AS incumbents, string_agg(tool, ', ' ORDER BY r) FILTER (r <= 3) AS named FROM tr WHERE r <= 5 GROUP BY 1),
        w AS (SELECT niche_category, token, count(*) AS n FROM (SELECT niche_category, unnest({_WORDS}) AS token FROM pain_points) WHERE length(token) >= 4 AND token NOT IN ({_STOP}) GROUP BY 1, 2), wr AS (SELECT *, row_number() OVER (PARTITION BY niche_category ORDER BY n DESC, token) AS r FROM w),
        k AS (SELECT niche_category, trim(substring(string_agg(token, '-' ORDER BY r), 1, 96), '-') AS canonical_key FROM wr WHERE r <= 4 GROUP BY 1)
        SELECT g.*, row_number() OVER (ORDER BY avg_opportunity_score DESC NULLS LAST, coalesce(latest_source_created_ts, 0) DESC, item_count DESC, aggregate_wtp DESC, canonical_key) - 1 AS place, coalesce(incumbents, '') AS incumbents, canonical_key, array_to_string(list_transform(list_filter(string_split(replace(canonical_key, '_', '-'), '-'), lambda x: x <> '')[1:6], lambda x: concat(upper(x[1]), x[2:])), ' ') AS label,
        concat(item_count, ' related pain posts grouped into one recurring problem. Fresh=', fresh_post_count, ', evergreen=', evergreen_post_count, ', incumbents=', coalesce(named, 'none'), '.') AS summary,
        CASE WHEN aggregate_wtp >= 7 * item_count THEN 'high' WHEN aggregate_wtp >= 4 * item_count THEN 'medium' ELSE 'low' END AS signal FROM g LEFT JOIN ti USING (niche_category) JOIN k USING (niche_category)""",
    "cluster_keys": f"""WITH p AS (SELECT coalesce(severity, '') AS c, title, summary, deep_dive_summary FROM pain_points), d AS (SELECT DISTINCT c FROM p),
        w AS (SELECT c, unnest({_WORDS}) AS token, 1 AS n FROM p UNION ALL SELECT c, unnest(['zebra', 'exports', 'zebra', 'quagga']), 3 FROM d), n AS (SELECT c, token, sum(n) AS n FROM w WHERE length(token) >= 4 AND token NOT IN ({_STOP}) GROUP BY 1, 2)
        SELECT c AS cluster, md5(trim(string_agg(token, '-' ORDER BY n DESC, token), '-')) AS key FROM n GROUP BY 1 UNION ALL SELECT concat('bare-', c), concat('cluster-', substring(sha1('a b  !'), 1, 10)) FROM d""",
    "member_similarity": "SELECT x.label, x.vec_id, round(avg(list_dot_product(list_transform(x.embedding, lambda v: CAST(v AS DOUBLE)), list_transform(y.embedding, lambda v: CAST(v AS DOUBLE)))), 4) AS similarity FROM embeddings x JOIN embeddings y ON x.label = y.label GROUP BY 1, 2",
    "cluster_members": f"""WITH RECURSIVE p AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id WHERE list_dot_product(list_transform(x.embedding, lambda v: CAST(v AS DOUBLE)), list_transform(y.embedding, lambda v: CAST(v AS DOUBLE))) >= {COMPONENTS}),
        e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), c(node, root) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.node), m AS (SELECT node, min(root) AS cluster FROM c GROUP BY 1)
        SELECT cluster, count(*) AS n, string_agg(lpad(CAST(node AS VARCHAR), 9, '0'), ',' ORDER BY node) AS post_ids FROM m GROUP BY 1""",
    "clusters_latest": f"WITH {_RUNS}, {_LATEST.format('')} SELECT cluster, run_id, item_count FROM f WHERE r = 1 {_FIRST.format(40)}",
    "clusters_with_posts": f"WITH {_RUNS}, {_LATEST.format("AND EXISTS (SELECT 1 FROM rows_ WHERE rows_.cluster = heads.cluster AND triage_status = 'favorite')")} SELECT cluster, run_id, item_count FROM f WHERE r = 1 {_FIRST.format(40)}",
    "clusters_of_posts": "SELECT post_id, CASE WHEN niche_category IS NOT NULL THEN concat('b:', niche_category) ELSE concat('a:', subreddit) END AS cluster FROM pain_points WHERE subreddit IS NOT NULL OR niche_category IS NOT NULL",
    "digest_payload": f"""WITH {_RUNS}, p AS (SELECT *, round({_SCORED.format('(coalesce(pain_level, 0) + coalesce(willingness_to_pay, 0)) / 2.0')}, 2) AS score FROM pain_points WHERE {_ACTIVE} AND created_at >= TIMESTAMP '{AS_OF_TEXT}' - INTERVAL 30 DAY), {_LATEST.format("AND EXISTS (SELECT 1 FROM rows_ SEMI JOIN p USING (post_id) WHERE rows_.cluster = heads.cluster)")},
        b AS (SELECT trim(deep_dive_summary) AS name, count(*) AS n FROM p WHERE trim(coalesce(deep_dive_summary, '')) <> '' GROUP BY 1 ORDER BY n DESC, name LIMIT 5), x AS (SELECT * FROM f WHERE r = 1 {_FIRST.format(5)})
        SELECT 'total' AS section, CAST(NULL AS INTEGER) AS place, '' AS name, count(*) AS n, CAST(NULL AS DOUBLE) AS score FROM p
        UNION ALL SELECT 'niche', NULL, {_NAMED.format('niche_category', 'Uncategorized')}, count(*), NULL FROM p GROUP BY 3 UNION ALL SELECT 'source', NULL, {_NAMED.format('source', 'unknown')}, count(*), NULL FROM p GROUP BY 3
        UNION ALL SELECT * FROM (SELECT 'item', CAST(row_number() OVER (ORDER BY score DESC, len({_LIST.format('evidence_spans_json')}) DESC, coalesce(source_created_ts, 0) DESC, coalesce(willingness_to_pay, 0) DESC, coalesce(pain_level, 0) DESC, id) AS INTEGER) AS place, post_id, NULL, score FROM p) WHERE place <= 5
        UNION ALL SELECT 'blocker', CAST(row_number() OVER (ORDER BY n DESC, name) AS INTEGER), name, n, NULL FROM b UNION ALL SELECT 'cluster', CAST(row_number() OVER (ORDER BY s DESC NULLS LAST, k) AS INTEGER), k, item_count, s FROM x""",
    "digest_sections": f"""WITH a AS (SELECT *, coalesce(opportunity_bucket, 'unknown_age') AS bucket, {_NAMED.format('niche_category', 'Uncategorized')} AS label, {_SCORED.format('CAST(coalesce(willingness_to_pay, 0) AS DOUBLE)')} AS score FROM pain_points WHERE {_ACTIVE}),
        r AS (SELECT *, row_number() OVER (PARTITION BY bucket, label ORDER BY score DESC, coalesce(source_created_ts, 0) DESC, coalesce(willingness_to_pay, 0) DESC, coalesce(pain_level, 0) DESC, id) AS row_no FROM a), g AS (SELECT bucket, label, max(score) AS best, count(*) AS group_size FROM a GROUP BY 1, 2),
        k AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY best DESC, group_size DESC, lower(label), label) AS group_rank FROM g)
        SELECT bucket, label, group_rank, group_size, row_no, id FROM r JOIN k USING (bucket, label) WHERE row_no <= 3""",
    "signal_page": "SELECT id FROM pain_points ORDER BY willingness_to_pay DESC NULLS LAST, pain_level DESC NULLS LAST, id LIMIT 5 OFFSET 10",
    "triage_update": f"""WITH f AS (SELECT post_id, lower({_TRIM.format('feedback_value')}) AS v, row_number() OVER (PARTITION BY post_id ORDER BY created_at DESC NULLS LAST, id DESC) AS r FROM ({_ONCE.format('feedback_events')}) WHERE lower({_TRIM.format('feedback_value')}) IN ('useful', 'not_a_pain'))
        SELECT p.id, CASE f.v WHEN 'useful' THEN 'favorite' WHEN 'not_a_pain' THEN 'discarded' ELSE triage_status END AS triage_status FROM pain_points p LEFT JOIN f ON f.post_id = p.post_id AND f.r = 1""",
    "deep_dive_update": """SELECT id, CASE deep_dive_status WHEN 'queued' THEN 'failed' WHEN 'running' THEN 'completed' ELSE deep_dive_status END AS deep_dive_status,
        md5(coalesce(CASE deep_dive_status WHEN 'queued' THEN 'Deep dive error: timeout' WHEN 'running' THEN coalesce(nullif(title, ''), deep_dive_summary) ELSE deep_dive_summary END, '')) AS summary_hash FROM pain_points""",
    "vector_backfill": "SELECT id, CASE WHEN emb_vector IS NOT NULL THEN CAST(json_array_length(emb_vector) AS INTEGER) WHEN triage_status <> 'merged' THEN 96 END AS size, triage_status <> 'merged' AS searched FROM pain_points",
    "answer_cache": f"SELECT prompt_hash, id, model FROM (SELECT *, row_number() OVER (PARTITION BY prompt_hash ORDER BY created_at >= TIMESTAMP '2025-02-01' DESC, created_at DESC, id DESC) AS r FROM ({_ONCE.format('llm_usage_events')}) WHERE prompt_hash IS NOT NULL AND created_at IS NOT NULL) WHERE r = 1",
    "payload_health": """WITH p AS (SELECT unnest([evidence_spans_json, score_components_json]) AS j FROM pain_points), g AS (SELECT coalesce(json_valid(j) AND json_type(CASE WHEN json_valid(j) THEN j END) = 'OBJECT', false) AS good FROM p)
        SELECT 'kept' AS what, count(*) FILTER (good) AS n FROM g UNION ALL SELECT 'dropped', count(*) FILTER (NOT good) FROM g""",
    "job_states": """WITH e AS (SELECT *, CASE WHEN event_type = 'error' THEN repeat(concat('failed at ', event_id, '. '), 100) END AS error FROM events)
        SELECT user_id, max(ts) AS last_run, max(ts) FILTER (event_type <> 'error') AS last_success, md5(coalesce(substring(CASE WHEN arg_max(event_type = 'error', (ts, coalesce(error, ''))) THEN arg_max(coalesce(error, ''), (ts, coalesce(error, ''))) END, 1, 1000), '')) AS error_hash FROM e GROUP BY 1""",
    "tool_quotes": f"""WITH t AS (SELECT DISTINCT post_id, lower(trim(competitor_tag)) AS tool FROM pain_point_competitors WHERE post_id IS NOT NULL AND lower(trim(competitor_tag)) <> ''), e AS (SELECT id, post_id, {_EXACT} AS q FROM pain_points), d AS (SELECT id, post_id, {_DISTINCT} AS q FROM e),
        u AS (SELECT id, post_id, unnest(q) AS quote, unnest(range(len(q))) AS pos FROM d), j AS (SELECT tool, quote, (id, pos) AS seen FROM u JOIN t USING (post_id)) SELECT tool, l AS quotes FROM {_first_distinct('j', 'tool', 'quote', 'seen', 5)}""",
    "buyer_roles": """WITH r AS (SELECT subreddit, lower(trim(coalesce(buyer_authority, ''))) AS role, count(*) AS n, min(id) AS first FROM pain_points GROUP BY 1, 2 HAVING lower(trim(coalesce(buyer_authority, ''))) NOT IN ('', 'unknown', 'none', 'n/a'))
        SELECT subreddit, role, n, row_number() OVER (PARTITION BY subreddit ORDER BY first, role) AS place FROM r""",
    "buyer_words": f"""WITH e AS (SELECT id, subreddit, {_EXACT} AS q FROM pain_points), d AS (SELECT id, subreddit, {_DISTINCT} AS q FROM e), u AS (SELECT id, subreddit, unnest(q) AS quote, unnest(range(len(q))) AS pos FROM d),
        s AS (SELECT subreddit, quote, (id, pos) AS seen FROM u WHERE regexp_matches(quote, '(?i){L.WTP_PATTERN}')), b AS (SELECT subreddit, id AS seen, trim(deep_dive_summary) AS doubt FROM pain_points WHERE deep_dive_summary IS NOT NULL)
        SELECT g.subreddit, coalesce(x.l, '') AS wtp_quotes, coalesce(y.l, '') AS uncertainties FROM (SELECT DISTINCT subreddit FROM pain_points WHERE subreddit IS NOT NULL) g LEFT JOIN {_first_distinct('s', 'subreddit', 'quote', 'seen', 3)} x USING (subreddit) LEFT JOIN {_first_distinct('b', 'subreddit', 'doubt', 'seen', 3)} y USING (subreddit)""",
    "exact_quotes": f"WITH e AS (SELECT id, {_EXACT} AS q, len({_EVIDENCE}) AS g FROM pain_points) SELECT id, array_to_string({_DISTINCT}, '|') AS exact, CAST(g AS INTEGER) AS grounded FROM e",
    "thread_texts": f"""WITH p AS (SELECT *, {_LIST.format('comment_sample_json')} AS c FROM pain_points)
        SELECT id, md5(CASE WHEN len(c) = 0 THEN coalesce(body, '') ELSE concat(CASE WHEN {_TRIM.format("coalesce(body, '')")} = '' THEN '' ELSE concat(body, chr(10), chr(10)) END, 'Top comments:', chr(10), {_LINES}) END) AS body_hash,
        md5({_TRIM.format(f"concat('Title: ', coalesce(title, ''), chr(10), chr(10), 'Body:', chr(10), coalesce(body, ''), chr(10), chr(10), 'Thread comments:', chr(10), {_LINES})")}) AS thread_hash,
        coalesce(regexp_full_match(subreddit, '[A-Za-z0-9_]{{2,21}}'), false) AS feed, coalesce(regexp_full_match(post_id, '[A-Za-z0-9_:-]+'), false) AS named, concat('classify:m:', substring(sha256('{{}}'), 1, 16), ':', sha256(coalesce(title, ''))) AS answer_key FROM p""",
    "tag_texts": f"""WITH t AS (SELECT id, list_filter(list_transform({_LIST.format('competitor_tags')}, lambda x: substring(lower({_TRIM.format('x')}), 1, 64)), lambda x: x <> '') AS a FROM pain_points) SELECT id, array_to_string(list_filter(a, lambda x, i: list_position(a, x) = i), ',') AS tags FROM t""",
    "signal_context": f"SELECT id, md5(concat_ws(chr(10), {_LINE.format('Title', 'title')}, {_LINE.format('Summary', 'summary')}, {_LINE.format('Deep dive', 'deep_dive_summary')}, {_LINE.format('Trend', 'niche_category')})) AS context_hash FROM pain_points",
    "answer_shapes": f"""WITH p AS (SELECT *, id % 7 <> 1 AND coalesce(category IN ('complaint', 'unsolved', 'wish') AND severity IN ('low', 'medium', 'high') AND {_TRIM.format('summary')} <> '' AND coalesce(post_type, 'advice_thread') IN ('first_person_pain', 'solution_request', 'founder_pitch', 'news_analysis', 'tool_comparison', 'advice_thread', 'vendor_rant'), false) AS good FROM pain_points),
        q AS (SELECT *, good AND coalesce(is_monetizable IS NOT NULL AND pain_level BETWEEN 0 AND 10 AND willingness_to_pay BETWEEN 0 AND 10, false) AS whole FROM p)
        SELECT id, whole AS primary_valid, good AS legacy_valid, CAST(CASE WHEN whole THEN CASE WHEN is_monetizable = 1 THEN willingness_to_pay ELSE least(3, willingness_to_pay) END END AS INTEGER) AS willingness_to_pay,
        CASE WHEN good THEN coalesce(post_type, CASE category WHEN 'complaint' THEN 'first_person_pain' WHEN 'unsolved' THEN 'solution_request' ELSE 'advice_thread' END) END AS post_type FROM q""",
    "usage_of_responses": f"SELECT id, CASE WHEN id % 5 = 1 THEN greatest(0, -coalesce(prompt_tokens, 0)) ELSE greatest(0, coalesce(prompt_tokens, 0)) END AS prompt_tokens, CASE WHEN id % 5 = 1 THEN 0 ELSE greatest(0, coalesce(completion_tokens, 0)) END AS completion_tokens FROM ({_ONCE.format('llm_usage_events')}) WHERE id % 5 <> 0",
    "monitored_lists": "SELECT name, active, row_number() OVER (ORDER BY name, active) - 1 AS place FROM monitored_subreddits",
    "radar_places": """WITH p AS (SELECT DISTINCT post_id, lower(trim(competitor_tag)) AS tool FROM pain_point_competitors WHERE post_id IS NOT NULL AND lower(trim(competitor_tag)) <> ''),
        s AS (SELECT tool, count(*) AS mentions, CAST(round(CAST(CAST(sum(CAST(opportunity_score AS DECIMAL(18,4))) FILTER (opportunity_score > 0) AS DOUBLE) / nullif(count(*) FILTER (opportunity_score > 0), 0) AS DECIMAL(18,10)), 3) AS DOUBLE) AS a FROM p JOIN pain_points USING (post_id) GROUP BY 1)
        SELECT tool, row_number() OVER (ORDER BY mentions DESC, coalesce(a, 0) DESC, tool) - 1 AS place FROM s""",
}


def _with_prescreen() -> None:
    from . import text_queries as T

    ORACLE["run_counters"] = f"""WITH {T._BASE}, s AS (SELECT id, {T._PRESCREEN} AS score FROM base)
        SELECT count(*) AS posts, count(*) FILTER (score < 2) AS dropped, count(*) FILTER (score >= 2) AS kept, greatest(0, count(*) FILTER (score >= 2) - 100) AS capped, count(*) FILTER (is_monetizable = 1) AS monetizable, count(*) FILTER (deep_dive_status = 'completed') AS deep_dives,
        count(*) FILTER (triage_status = 'merged') AS merged, count(*) FILTER (starts_with(analysis_mode, 'legacy')) AS legacy, count(*) FILTER (suffix(analysis_mode, 'b2b')) AS b2b FROM pain_points JOIN s USING (id)"""


    comments = "list_filter(list_transform(coalesce(top_comments, []), lambda x: " + T._TRIM.format("x") + "), lambda x: x <> '')"
    base = T._BASE.replace(f"SELECT id, post_id, {T._POST} AS t, {T._COMMENTS} AS comments FROM pain_points", f"SELECT post_id, {T._POST} AS t, {comments} AS comments FROM eval_posts WHERE score % 2 <> 1")
    ORACLE["analysis_counts"] = f"""WITH {base}, s AS (SELECT {T._PRESCREEN} AS score FROM base), c AS (SELECT count(*) FILTER (score < 2) AS dropped, count(*) FILTER (score >= 2) AS good FROM s)
        SELECT dropped, good - greatest(0, good - 50) AS kept, greatest(0, good - 50) AS capped, (SELECT count(*) FROM eval_posts WHERE score % 2 = 1) AS known FROM c"""


_with_prescreen()
