"""Predictions held against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def binary_metrics(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    """tp, fp, fn, precision, recall and f1 of two boolean columns; 0 where undefined."""
    p, a = F.coalesce(F.col(predicted), F.lit(False)), F.coalesce(F.col(actual), F.lit(False))
    counts = df.agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"))
    tp = F.col("tp")
    share = lambda part, whole: F.when(whole == 0, F.lit(0.0)).otherwise(F.round(part / F.when(whole == 0, 1).otherwise(whole), 3))
    return counts.select("tp", "fp", "fn", share(tp, tp + F.col("fp")).alias("precision"), share(tp, tp + F.col("fn")).alias("recall"), share(2 * tp, 2 * tp + F.col("fp") + F.col("fn")).alias("f1"))


def confusion(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    return df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def rate(part: Column, whole: Column, places: int = 3) -> Column:
    """A share; 0 of nothing is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(part / F.when(whole == 0, 1).otherwise(whole), places))


def rate_or_null(part: Column, whole: Column, places: int = 4) -> Column:
    """A share; null of nothing."""
    return F.when(whole > 0, F.round(part / F.when(whole > 0, whole), places))


#: What each factor of the calibration score counts.
FACTORS = {"intensity": 0.18, "frequency": 0.14, "wtp": 0.14, "buyer_authority": 0.12, "current_workaround": 0.10, "incumbent_failure": 0.10, "urgency": 0.08, "evidence_quality": 0.08, "recency": 0.06}
#: Qualities of evidence that ask for an exact quote, in a report and in the calibration.
EXACT, CALIBRATED = ("exact_quote", "multi_quote"), ("exact_quote", "multi_quote", "linked_multi_source")


def unit_number(c: Column) -> Column:
    """A number within 0 and 1; 0 for null and what isn't finite."""
    good = c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return F.when(good, F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))).otherwise(F.lit(0.0))


def calibration_score(factors: Column, penalties: Column, weights: dict[str, float] = FACTORS) -> Column:
    """0 to 100: the weighted factors less all penalties, both maps of names to numbers; unknown factors don't count."""
    none = F.create_map().cast("map<string,double>")
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + unit_number(F.coalesce(factors, none)[name]) * F.lit(float(weight))
    lost = F.aggregate(F.map_values(F.coalesce(penalties, none)), F.lit(0.0), lambda s, x: s + unit_number(x))
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), (total - lost) * 100)), 4)


def calibration(joined: DataFrame, score: str, top: int = 10) -> DataFrame:
    """One row about the best `top` predictions by score, then post_id: how many, the shares that are useful and
    monetisable, and that of expected exact quotes which were found; a share of nothing is null."""
    best = joined.orderBy(F.col(score).desc_nulls_last(), "post_id").limit(top)
    expected = F.lower(F.trim(F.coalesce("evidence_quality", F.lit("")))).isin(*CALIBRATED)
    n = F.count("*")
    return best.agg(
        n.alias("n"), rate_or_null(F.count_if("feedback_useful"), n).alias("top_n_useful_rate"), rate_or_null(F.count_if("is_monetizable"), n).alias("monetizable_precision"),
        rate_or_null(F.count_if(expected & (F.coalesce("exact_evidence_count", F.lit(0)) > 0)), F.count_if(expected)).alias("evidence_exact_match_rate"),
        F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), "post_id"))).alias("_top"),
    ).withColumn("top_ranked_post_ids", F.transform("_top", lambda x: x["post_id"])).drop("_top")


def statuses(posts: DataFrame, signals: DataFrame, minimum: int = 2) -> DataFrame:
    """Posts (post_id, prescreen_score) with prediction_status: screened_out under the minimum, no_signal without a
    signal (post_id), else classified; signals of screened-out posts don't count."""
    has = signals.select("post_id").distinct().withColumn("has_", F.lit(True))
    status = F.when(F.coalesce("prescreen_score", F.lit(0)) < minimum, "screened_out").when(F.col("has_").isNull(), "no_signal").otherwise("classified")
    return posts.join(has, "post_id", "left").withColumn("prediction_status", status).drop("has_")


def checked(labels: DataFrame, posts: DataFrame, predictions: DataFrame) -> DataFrame:
    """Labels with their predictions, null for none; raises for repeated ids, and for labels without a post or of several
    reference times.  The checks are counts, combined before any shuffle."""
    named = [df.where("post_id is not null").select(F.lit(name).alias("what"), "post_id") for name, df in (("posts", posts), ("labels", labels), ("predictions", predictions))]
    if twice := named[0].unionAll(named[1]).unionAll(named[2]).groupBy("what", "post_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).collect():
        raise ValueError(f"duplicate post_id in {twice[0].what}: {twice[0].post_id}")
    seen = labels.join(posts.select("post_id", F.lit(True).alias("known_")), "post_id", "left")
    lost, times = seen.agg(F.min(F.when(F.col("known_").isNull(), F.col("post_id"))), F.countDistinct("reference_now_ts")).first()
    if lost is not None:
        raise ValueError(f"label references unknown post_id: {lost}")
    if times > 1:
        raise ValueError("labels have several reference times")
    return labels.join(predictions, "post_id", "left")


def report(joined: DataFrame) -> DataFrame:
    """One row of everything that is measured of labels joined with their predictions (columns predicted_pain,
    predicted_monetizable, predicted_type, predicted_handness, predicted_authority, predicted_bucket, predicted_negative,
    predicted_exact, prediction_status).  Missing predictions count as no pain; shares of nothing are 0."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    negative, said = F.coalesce("hard_negative_type", F.lit("")), F.coalesce("predicted_negative", F.lit(""))
    wrong = (negative != "") & (yes("predicted_monetizable") | (yes("predicted_pain") & (said == "")) | ((said != "") & (said != negative)))
    stale, expected = ~yes("is_current_opportunity"), F.col("evidence_quality").isin(*EXACT)
    leaked, matched = stale & (F.col("predicted_bucket") == "current_opportunity"), expected & (F.coalesce("predicted_exact", F.lit(0)) > 0)
    missed = yes("is_pain") & (F.col("prediction_status") == "screened_out")
    n = F.count("*")
    return joined.agg(
        n.alias("dataset_size"), F.count_if(leaked).alias("stale_leakage_count"), F.count_if(stale).alias("stale_candidate_count"), rate(F.count_if(leaked), F.count_if(stale)).alias("stale_leakage_rate"),
        F.count_if(missed).alias("screening_false_negative_count"),
        F.count_if(wrong).alias("hard_negative_count"), F.count_if(negative != "").alias("hard_negative_candidates"), rate(F.count_if(wrong), F.count_if(negative != "")).alias("hard_negative_rate"),
        F.count_if(matched).alias("exact_match_count"), F.count_if(expected).alias("exact_expected_count"), rate(F.count_if(matched), F.count_if(expected)).alias("exact_match_rate"),
        rate(F.count_if(F.col("predicted_handness") == F.col("first_handness")), n).alias("first_handness_accuracy"), rate(F.count_if(F.col("predicted_authority") == F.col("buyer_authority")), n).alias("buyer_authority_accuracy"),
    )


def screened_out_pain(joined: DataFrame) -> DataFrame:
    """(post_id) of labelled pain that the prescreen left out."""
    return joined.where(F.col("is_pain") & (F.col("prediction_status") == "screened_out")).select("post_id")


def status_counts(joined: DataFrame) -> DataFrame:
    return joined.groupBy(F.coalesce("prediction_status", F.lit("missing")).alias("prediction_status")).agg(F.count("*").alias("n"))


def cluster_usefulness(labels: DataFrame) -> DataFrame:
    """One row: labels that say whether a cluster was useful, how many of them do and don't, and the share."""
    labelled, useful = F.count("cluster_useful"), F.count_if("cluster_useful")
    return labels.agg(labelled.alias("labeled_count"), useful.alias("useful_count"), (labelled - useful).alias("not_useful_count"), rate(useful, labelled).alias("useful_rate"))


def contract(labels: DataFrame) -> dict:
    """What an evaluation covers, for its report: dimensions, label count, reference time and cluster usefulness."""
    n, at = labels.agg(F.count("*"), F.max("reference_now_ts")).first()
    return {
        "benchmark_type": "starter_product_level_opportunity_quality", "label_count": n, "reference_now_ts": at, "cluster_useful": cluster_usefulness(labels).first().asDict(),
        "dimensions": {"core": ["is_pain", "is_monetizable", "post_type", "first_handness", "buyer_authority"], "product_level": ["is_current_opportunity", "hard_negative_type", "evidence_quality", "feedback_useful", "cluster_useful"]},
    }
