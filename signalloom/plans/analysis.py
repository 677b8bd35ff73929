"""A run over posts from end to end: known ones left out, prescreen, classification, evidence, scores and the next stored state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import lexicons as L
from ..functions import columns as C
from ..operators import enrich, evidence, features, scoring, store
from ..sources.tables import beside


def screened(posts: DataFrame, minimum: int = 2, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(posts with score that are enough, one row of counts: dropped, kept, capped).

    With `most` only the best so many stay, ties by post_id; that cap is the feature."""
    t = features.post_text()
    rows = posts.withColumn("t_", t).withColumn("k_", features.post_type(F.col("t_"), features.keyword_category(F.col("t_"))))
    rows = rows.withColumn("score", features.prescreen_score(F.col("t_"), C.filled(F.col("top_comments")), features.first_handness(F.col("t_"), F.col("k_")))).drop("t_", "k_")
    good = F.col("score") >= minimum
    over = F.greatest(F.lit(0), F.count_if(good) - F.lit(most)) if most is not None else F.lit(0)
    counts = rows.agg(F.count_if(~good).alias("dropped"), (F.count_if(good) - over).alias("kept"), over.alias("capped"))
    kept = rows.where(good)
    return (kept.orderBy(F.col("score").desc(), "post_id").limit(most) if most is not None else kept), counts


def analysed(posts: DataFrame, as_of: int, answers: DataFrame | None = None) -> DataFrame:
    """Posts (post_id, title, body, top_comments, source, subreddit, url, source_created_ts, author_name) as signals:
    classified, their quotes verified, scored, and in the form in which they are stored.  Null parts count as empty."""
    rows = enrich.classified(posts, answers)
    rows = features.comment_signals(rows, F.col("top_comments"), F.col("competitor_tags"))
    spans = features.evidence_spans(C.text("title"), C.text("body"))
    found = evidence.verify_quotes(rows.select("post_id", "title", "body", "top_comments", spans.alias("q")), "q", "top_comments")
    counted = found.groupBy("post_id").agg(F.count_if(F.col("match_type") != "none").alias("anchored"), F.count_if(F.col("match_type") == "exact").alias("exact"))
    rows = rows.join(counted, "post_id", "left").withColumn("t_", features.thread_text(C.filled(F.col("top_comments"))))
    ev = scoring.evidence_score(F.coalesce("anchored", F.lit(0)).cast("double"))
    fresh, stale = scoring.recency(F.col("source_created_ts"), as_of)
    number = lambda c: F.col(c).cast("double")
    parts = {
        "pain": number("pain_level") / 10, "wtp": number("willingness_to_pay") / 10, "authority": C.lookup(F.col("buyer_authority"), L.AUTHORITY_SCORES, "unknown"), "handness": C.lookup(F.col("first_handness"), L.HANDNESS_SCORES, "unknown"),
        "frequency": features.workflow_frequency(F.col("t_"), F.col("post_type")), "impact": features.impact(F.col("t_"), number("pain_level"), number("willingness_to_pay")), "consensus": scoring.consensus_score(number("consensus_n"), ev),
        "incumbent": scoring.incumbent_failure_score(F.size("competitor_tags"), F.size("tool_mentions"), number("workaround_n"), F.col("post_type")), "recency": fresh, "evidence": ev, "stale": stale, "solved": features.solved_penalty(F.col("t_"), number("workaround_n")),
        "shill": number("shill_risk"), "type": scoring.type_penalty(F.col("post_type"), F.col("first_handness")),
    }
    made = scoring.components(parts, verified=F.coalesce("anchored", F.lit(0)), exact=F.coalesce("exact", F.lit(0)), comments={"consensus_count": F.col("consensus_n"), "same_here_count": F.col("same_here_n"), "workaround_count": F.col("workaround_n"), "shill_risk": F.col("shill_risk")}, score=scoring.opportunity_score(parts))
    rows = rows.withColumns({"c_": made, "opportunity_bucket": scoring.opportunity_bucket(F.col("source_created_ts"), as_of), "q_": spans})
    out = rows.select(
        *(c for c in posts.columns if c != "top_comments"), "category", "severity", "summary", F.col("is_monetizable").cast("int").alias("is_monetizable"), F.col("pain_level").cast("long").alias("pain_level"), F.col("willingness_to_pay").cast("long").alias("willingness_to_pay"), "niche_category",
        F.to_json("competitor_tags").alias("competitor_tags"), "post_type", "first_handness", "buyer_authority", "analysis_mode", "opportunity_bucket", F.to_json("q_").alias("evidence_spans_json"), F.to_json("comment_sample").alias("comment_sample_json"), F.to_json("tool_mentions").alias("comment_tool_mentions_json"),
        F.col("c_.opportunity_score").alias("opportunity_score"), F.to_json("c_").alias("score_components_json"), F.lit("new").alias("triage_status"), F.lit("not_requested").alias("deep_dive_status"),
    )
    return store.stored_form(out)


def run(posts: DataFrame, stored: DataFrame, as_of: int, *, minimum: int = 2, most: int | None = None, answers: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(new signals, one row of counts) of posts that aren't stored yet."""
    fresh = posts.join(stored.select("post_id"), "post_id", "left_anti")
    kept, counts = screened(fresh, minimum, most)
    signals = analysed(kept.drop("score"), as_of, answers)
    known = posts.join(stored.select("post_id"), "post_id", "left_semi").agg(F.count("*").alias("known"))
    return signals, beside(counts, known)
