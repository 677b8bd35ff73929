"""What a post's text says: lexicon scores, kinds, spans and comment signals, as columns of the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicons as L
from ..functions.columns import contains_any, count_hits, filled, text


def post_text() -> Column:
    """Title, a space and body in lower case; null parts are empty."""
    return F.lower(F.concat(text("title"), F.lit(" "), text("body")))


def thread_text(comments: Column) -> Column:
    """Title, body and comments on lines of their own, in lower case; empty parts are left out."""
    parts = F.concat(F.array(text("title"), text("body")), comments)
    return F.lower(F.array_join(F.filter(parts, lambda x: x != ""), "\n"))


def keyword_score(t: Column) -> Column:
    """0 to 3: complaints count 2, unsolved questions and wishes 1 each."""
    return F.least(F.lit(3), 2 * contains_any(t, L.COMPLAINT).cast("int") + contains_any(t, L.UNSOLVED).cast("int") + contains_any(t, L.WISH).cast("int"))


def keyword_category(t: Column) -> Column:
    return F.when(contains_any(t, L.COMPLAINT), "complaint").when(contains_any(t, L.UNSOLVED), "unsolved").otherwise("wish")


def consumer_noise(t: Column) -> Column:
    """Consumer terms and no business term."""
    return contains_any(t, L.CONSUMER) & ~contains_any(t, L.BUSINESS)


def competitor_hints(t: Column) -> Column:
    """The known tools named in the text, in order."""
    return F.filter(F.array(*map(F.lit, sorted(L.COMPETITORS))), lambda x: F.contains(t, x))


def post_type(t: Column, category: Column) -> Column:
    return (
        F.when(contains_any(t, L.COMPARISON), "tool_comparison")
        .when(contains_any(t, L.PITCH), "founder_pitch")
        .when(contains_any(t, L.NEWS), "news_analysis")
        .when((category == "complaint") & contains_any(t, L.COMPETITORS), "vendor_rant")
        .when(category == "unsolved", "solution_request")
        .when(category == "complaint", "first_person_pain")
        .otherwise("advice_thread")
    )


def first_handness(t: Column, kind: Column) -> Column:
    padded = F.concat(F.lit(" "), t, F.lit(" "))
    return (
        F.when(kind == "news_analysis", "speculative")
        .when(contains_any(padded, L.AGGREGATED), "aggregated")
        .when(contains_any(padded, L.SECOND_HAND), "second_hand")
        .when(contains_any(padded, L.FIRST_HAND), "first_hand")
        .when(contains_any(padded, L.HEARSAY), "aggregated")
        .otherwise("unknown")
    )


def buyer_authority(t: Column) -> Column:
    found = reduce(lambda w, x: w.when(contains_any(t, x[1]), x[0]), L.AUTHORITY[1:], F.when(contains_any(t, L.AUTHORITY[0][1]), L.AUTHORITY[0][0]))
    return found.otherwise("unknown")


def evidence_spans(title: Column, body: Column, most: int = 3, longest: int = 160) -> Column:
    """The first sentences that hold a term of any list, cut; the title where none does."""
    whole = F.array_join(F.filter(F.array(title, body), lambda x: x != ""), "\n")
    terms = (*L.COMPLAINT, *L.UNSOLVED, *L.WISH, *L.EVIDENCE)
    # each sentence beside its lower case, which is then made once and not for every term
    parts = F.transform(filled(F.split(whole, r"[\n.!?]+")), lambda x: F.struct(x.alias("x"), F.lower(x).alias("low")))
    spans = F.transform(F.slice(F.filter(parts, lambda x: contains_any(x["low"], terms)), 1, most), lambda x: F.substring(x["x"], 1, longest))
    return F.when(F.trim(whole) == "", F.array().cast("array<string>")).when(F.size(spans) > 0, spans).otherwise(F.array(F.substring(title, 1, longest)))


def prescreen_score(t: Column, comments: Column, handness: Column) -> Column:
    """0 to 7: the keyword score, and 1 each for business, process and frequency terms, a known tool, a comment
    and a first-hand account; 1 less for consumer noise."""
    points = [contains_any(t, L.BUSINESS), contains_any(t, L.PROCESS), contains_any(t, L.HIGH_FREQUENCY), contains_any(t, L.COMPETITORS), F.size(comments) > 0, handness == "first_hand"]
    score = reduce(lambda a, b: a + b.cast("int"), points, keyword_score(t))
    return F.greatest(F.lit(0), F.least(F.lit(7), score - consumer_noise(t).cast("int")))


def comment_signals(df: DataFrame, comments: Column, known_tools: Column) -> DataFrame:
    """With counts of agreeing, workaround and promotional comments, tools named, and a sample of five.

    A blank comment isn't one; without comments counts and risk are 0."""
    c = filled(comments)
    low = F.transform(c, F.lower)
    tools = F.filter(F.array(*map(F.lit, sorted(L.COMPETITORS))), lambda x: F.exists(low, lambda y: F.contains(y, x)))
    count = lambda terms: F.size(F.filter(low, lambda x: contains_any(x, terms)))
    n = F.size(c)
    return df.withColumns({
        "consensus_n": count((*L.SAME_HERE, *L.CONSENSUS)),
        "same_here_n": count(L.SAME_HERE),
        "workaround_n": count(L.WORKAROUND),
        "tool_mentions": F.array_sort(F.array_union(tools, known_tools)),
        "shill_risk": F.when(n > 0, F.round(count((*L.SHILL, *L.LINKS)) / n, 3)).otherwise(F.lit(0.0)),
        "comment_sample": F.slice(c, 1, 5),
    })


def workflow_frequency(t: Column, kind: Column) -> Column:
    """0.32 to 0.95 by how often the work recurs."""
    score = F.lit(0.32) + F.when(contains_any(t, L.HIGH_FREQUENCY), 0.33).otherwise(0.0) + F.when(contains_any(t, (*L.WORKAROUND, *L.FREQUENCY_CONTEXT)), 0.2).otherwise(0.0)
    return F.least(F.lit(1.0), score + F.when(kind.isin("first_person_pain", "solution_request", "vendor_rant"), 0.1).otherwise(0.0))


def impact(t: Column, pain: Column, wtp: Column) -> Column:
    score = F.lit(0.2) + F.least(F.lit(0.45), F.greatest(pain, wtp) / 10 * F.lit(0.45))
    return F.least(F.lit(1.0), score + F.when(contains_any(t, L.HIGH_IMPACT), 0.25).otherwise(0.0) + F.when(contains_any(t, L.MEDIUM_IMPACT), 0.12).otherwise(0.0))


def solved_penalty(t: Column, workarounds: Column) -> Column:
    hits = count_hits(t, L.SOLVED)
    return F.when(hits == 0, F.lit(0.0)).otherwise(F.least(F.lit(0.65), F.lit(0.18) * hits + F.lit(0.04) * workarounds))
