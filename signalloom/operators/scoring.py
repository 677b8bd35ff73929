"""How much a signal is worth: age, recency, evidence and the weighted score, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400


def age_days(posted: Column, as_of: int) -> Column:
    """Days since a time in epoch seconds, 0 at least; null for no time."""
    return F.when(posted > 0, F.greatest(F.lit(0.0), (F.lit(as_of) - posted) / F.lit(float(DAY))))


def opportunity_bucket(posted: Column, as_of: int, current_days: int = 180) -> Column:
    age = age_days(posted, as_of)
    return F.when(age.isNull(), "unknown_age").when(age <= current_days, "current_opportunity").otherwise("evergreen_pain")


def recency(posted: Column, as_of: int, current_days: int = 180) -> tuple[Column, Column]:
    """(recency score, stale penalty)."""
    age = age_days(posted, as_of)
    over = F.least(F.lit(365.0), F.greatest(F.lit(0.0), age - current_days)) / 365
    fresh = F.least(F.lit(1.0), F.greatest(F.lit(0.45), 1 - age / current_days * F.lit(0.55)))
    score = F.when(age.isNull(), 0.35).when(age <= current_days, fresh).otherwise(F.greatest(F.lit(0.18), F.lit(0.45) - over * F.lit(0.22)))
    penalty = F.when(age.isNull(), 0.08).when(age <= current_days, 0.0).otherwise(F.least(F.lit(0.55), F.lit(0.1) + over * F.lit(0.25)))
    return score, penalty


def evidence_score(anchored: Column) -> Column:
    return F.least(F.lit(1.0), anchored / 3)


def consensus_score(consensus: Column, evidence: Column) -> Column:
    return F.least(F.lit(1.0), F.lit(0.18) + F.lit(0.22) * consensus + F.lit(0.18) * evidence)


def incumbent_failure_score(n_tags: Column, n_tools: Column, workarounds: Column, kind: Column) -> Column:
    rant = F.when(kind.isin("vendor_rant", "tool_comparison"), 0.14).otherwise(0.0)
    return F.least(F.lit(1.0), F.lit(0.18) + F.lit(0.16) * n_tags + F.lit(0.05) * n_tools + F.lit(0.11) * workarounds + rant)


def type_penalty(kind: Column, handness: Column) -> Column:
    return F.when(kind.isin("founder_pitch", "news_analysis") & (handness != "first_hand"), 0.22).when(kind == "advice_thread", 0.08).otherwise(0.0)


#: Points of each part of the score.
WEIGHTS = {"pain": 22, "wtp": 18, "authority": 14, "handness": 8, "frequency": 10, "impact": 12, "consensus": 10, "incumbent": 8, "recency": 10, "evidence": 6, "stale": -10, "solved": -12, "shill": -6, "type": -10}


def opportunity_score(parts: dict[str, Column]) -> Column:
    """The weighted sum of parts that each lie in 0..1, not under 0."""
    total = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        total = total + parts[name] * F.lit(float(weight))
    return F.greatest(F.lit(0.0), total)


def components(parts: dict[str, Column], *, verified: Column, exact: Column, comments: dict[str, Column], score: Column, reason: Column | None = None, cap: float = 35.0) -> Column:
    """What a score is made of, as one struct: each part to three places (the solved penalty with the type's, as it is
    stored), evidence and comment counts; with a reason of rejection (null for none) whether the signal may be promoted
    and, where not, the cap of its score."""
    r = lambda c: F.round(c.cast("double"), 3)
    fields = {
        "buyer_authority_score": r(parts["authority"]), "first_handness_score": r(parts["handness"]), "workflow_frequency_score": r(parts["frequency"]), "impact_score": r(parts["impact"]), "consensus_score": r(parts["consensus"]), "incumbent_failure_score": r(parts["incumbent"]),
        "recency_score": r(parts["recency"]), "stale_penalty": r(parts["stale"]), "solved_penalty": r(parts["solved"] + parts["type"]), "evidence_score": r(parts["evidence"]), "verified_evidence_count": verified, "exact_evidence_count": exact, "type_penalty": r(parts["type"]),
        **{f"comment_{k}": c for k, c in comments.items()}, "opportunity_score": F.round(score, 2),
    }
    if reason is not None:
        fields |= {"promotion_eligible": reason.isNull(), "evidence_rejection_reason": reason, "promotion_score_cap": F.when(reason.isNotNull(), F.lit(cap)), "opportunity_score": F.round(F.when(reason.isNotNull(), F.least(F.lit(cap), score)).otherwise(score), 2)}
    return F.struct(*(c.alias(k) for k, c in fields.items()))
