"""Classification of posts by pluggable enrichers: saved answers first, then the keyword classifier."""

from __future__ import annotations

import json
from functools import reduce
from hashlib import sha256
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import tags, text
from . import features
from .answers import SHAPES

def answer_key(operation: str, model: str, prompt: Column, settings: dict | None = None) -> Column:
    """The key under which an answer to a prompt is kept: operation, model, a hash of the settings and one of the prompt."""
    made = sha256(json.dumps(settings or {}, sort_keys=True).encode()).hexdigest()[:16]
    return F.concat_ws(":", F.lit(operation), F.lit(model), F.lit(made), F.sha2(prompt, 256))


def with_cached(rows: DataFrame, cache: DataFrame, key: Column, answer: str = "response_json") -> DataFrame:
    """Rows with what the cache (cache_key, response_json) has for their key, null for nothing; of several the largest.

    The cache is looked up by a join before anything costly is asked for."""
    one = cache.where("cache_key is not null").groupBy("cache_key").agg(F.max("response_json").alias(answer))
    return rows.withColumn("cache_key", key).join(one, "cache_key", "left")


def keyword_answer(t: Column, score: Column) -> Column:
    """What the keyword classifier makes of a post's text and prescreen score."""
    h = F.greatest(features.keyword_score(t), F.least(F.lit(3), score))
    noise = features.consumer_noise(t)
    level = lambda base: F.when(noise, 0).otherwise(F.least(F.lit(10), F.lit(base) + 2 * h)).cast("int")
    return F.struct(
        features.keyword_category(t).alias("category"), F.when(h >= 2, "medium").otherwise("low").alias("severity"), F.substring(t, 1, 160).alias("summary"), ((h >= 2) & ~noise).alias("is_monetizable"),
        level(4).alias("pain_level"), level(3).alias("willingness_to_pay"), F.when(noise, "consumer").otherwise("general").alias("niche_category"), features.competitor_hints(t).alias("competitor_tags"),
    )


def classified(posts: DataFrame, answers: DataFrame | None = None, *, mode: str = "dual") -> DataFrame:
    """Posts (post_id, title, body) with an answer's fields, `analysis_mode` and `fallback_reason`.

    answers (post_id, operation, payload) are saved answers of the operations structured, primary and legacy; without the
    column operation they are primary ones.  In mode dual the first valid answer in that order counts, in mode b2b only
    the first two, in mode legacy only the last; without one the keyword classifier answers.  A legacy answer takes what
    it doesn't say from the keyword classifier.  Of several answers of an operation the first valid one by its text
    counts.  Consumer noise is never monetisable, numbers lie within 0 and 10, willingness to pay is at most 3 where a
    post isn't monetisable, missing tools come from the text, and unknown kinds of post, hand and buyer are inferred.
    Posts without text get the keyword answer."""
    t = features.post_text()
    rows = posts.withColumn("t", t).withColumn("category_", features.keyword_category(F.col("t")))
    rows = rows.withColumn("kind_", features.post_type(F.col("t"), F.col("category_")))
    rows = rows.withColumn("handness_", features.first_handness(F.col("t"), F.col("kind_")))
    rows = rows.withColumn("score_", features.prescreen_score(F.col("t"), F.array().cast("array<string>"), F.col("handness_")))
    own = keyword_answer(F.col("t"), F.col("score_"))
    tiers = {"dual": ("structured", "primary", "legacy"), "b2b": ("structured", "primary"), "legacy": ("legacy",)}[mode]
    tiers = tiers if answers is not None else ()
    if answers is not None:
        kept = answers if "operation" in answers.columns else answers.withColumn("operation", F.lit("primary"))
        kept = kept.where("post_id is not null")
        for name in tiers:
            good = kept.where(F.col("operation") == name).select("post_id", "payload", SHAPES[name](F.col("payload")).alias("a")).where("a is not null")
            rows = rows.join(good.groupBy("post_id").agg(F.min_by("a", "payload").alias(f"a_{name}")), "post_id", "left")
    rows = rows.withColumn("k_", own)
    none = F.array().cast("array<string>")

    def field(name: str, tier: str) -> Column:
        a = F.col(f"a_{tier}")
        if tier == "legacy" and name in ("is_monetizable", "pain_level", "willingness_to_pay", "niche_category"):
            return F.col(f"k_.{name}")
        if tier == "structured" and name in ("post_type", "first_handness", "buyer_authority"):
            return F.lit("unknown")
        return a[name]

    def value(name: str, keyword: Column) -> Column:
        out = keyword
        for tier in reversed(tiers):
            out = F.when(F.col(f"a_{tier}").isNotNull(), field(name, tier)).otherwise(out)
        return out

    money = value("is_monetizable", F.col("k_.is_monetizable")) & ~features.consumer_noise(F.col("t"))
    wtp = F.greatest(F.lit(0), F.least(F.lit(10), value("willingness_to_pay", F.col("k_.willingness_to_pay"))))
    tools = tags(F.coalesce(value("competitor_tags", F.col("k_.competitor_tags")), none))
    known = lambda name, inferred: F.coalesce(F.nullif(value(name, F.lit("unknown")), F.lit("unknown")), inferred)
    said = F.coalesce(*(F.when(F.col(f"a_{tier}").isNotNull(), F.lit(tier)) for tier in tiers), F.lit("keyword"))
    # the tiers before the one that answered
    passed = F.concat_ws(",", *(F.when(~reduce(or_, (F.col(f"a_{x}").isNotNull() for x in tiers[: k + 1])), F.lit(f"{tier}_missing")) for k, tier in enumerate(tiers))) if tiers else F.lit("")
    return rows.select(
        *posts.columns, value("category", F.col("k_.category")).alias("category"), value("severity", F.col("k_.severity")).alias("severity"), value("summary", F.col("k_.summary")).alias("summary"), money.alias("is_monetizable"),
        F.greatest(F.lit(0), F.least(F.lit(10), value("pain_level", F.col("k_.pain_level")))).alias("pain_level"), F.when(money, wtp).otherwise(F.least(F.lit(3), wtp)).alias("willingness_to_pay"),
        text(value("niche_category", F.col("k_.niche_category"))).alias("niche_category"), F.when(F.size(tools) > 0, tools).otherwise(features.competitor_hints(F.col("t"))).alias("competitor_tags"),
        known("post_type", F.col("kind_")).alias("post_type"), known("first_handness", F.col("handness_")).alias("first_handness"), known("buyer_authority", features.buyer_authority(F.col("t"))).alias("buyer_authority"),
        said.alias("analysis_mode"), F.nullif(passed, F.lit("")).alias("fallback_reason"),
    )


def with_context(posts: DataFrame, deep_dives: DataFrame, clusters: DataFrame) -> DataFrame:
    """Posts with what a writer of texts about them needs: their deep dive and latest cluster as lines of a text.

    deep_dives (post_id, deep_dive_summary) and clusters (post_id, label, created_at); missing parts are left out."""
    last = clusters.where("post_id is not null").groupBy("post_id").agg(F.max_by("label", F.struct("created_at", "label")).alias("label"))
    one = deep_dives.where("post_id is not null").groupBy("post_id").agg(F.max("deep_dive_summary").alias("deep_dive_summary"))
    line = lambda name, c: F.when(F.trim(text(c)) != "", F.concat(F.lit(f"{name}: "), F.trim(text(c))))
    joined = posts.join(one, "post_id", "left").join(last, "post_id", "left")
    return joined.select(*posts.columns, F.concat_ws("\n", line("Title", "title"), line("Summary", "summary"), line("Deep dive", "deep_dive_summary"), line("Trend", "label")).alias("context"))
