"""Contracts of saved model answers: five shapes read from JSON, null where an answer breaks its contract, and usage events.

An answer is a JSON object, perhaps in a code fence.  Types are strict: a number isn't a text, a true isn't a number.
All checks are column expressions over a parsed variant, so nothing leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import trimmed

#: The kinds that an answer may name.
CATEGORIES, LEVELS = ("complaint", "unsolved", "wish"), ("low", "medium", "high")
POST_TYPES = ("first_person_pain", "solution_request", "founder_pitch", "news_analysis", "tool_comparison", "advice_thread", "vendor_rant")
HANDNESS = ("first_hand", "second_hand", "aggregated", "speculative", "unknown")
AUTHORITIES = ("intern", "ic", "engineer", "manager", "head_of_ops", "founder_owner", "agency_operator", "unknown")
#: Characters of a prompt's text that each operation takes.
PROMPT_CHARS = {"primary": 5000, "legacy": 4000, "deep_dive": 25_000, "cluster_label": 12_000, "gtm": 18_000}


def unfenced(c: Column) -> Column:
    """JSON without the code fence around it."""
    bare = trimmed(F.regexp_replace(trimmed(c), r"^`+|`+$", ""))
    return F.when(trimmed(c).startswith("```"), trimmed(F.regexp_replace(bare, r"^(?i)json", ""))).otherwise(trimmed(c))


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, (F.coalesce(c, F.lit(False)) for c in conditions))


class _Parsed:
    """Members of a payload with their JSON kind."""

    def __init__(self, v: Column):
        self.v = v
        self.is_object = F.schema_of_variant(v).startswith("OBJECT")

    def _kind(self, name: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(self.v, f"$.{name}", "variant"))

    def has(self, name: str) -> Column:
        return F.try_variant_get(self.v, f"$.{name}", "variant").isNotNull()

    def text(self, name: str) -> Column:
        """The value of a text, null for other kinds."""
        return F.when(self._kind(name) == "STRING", F.try_variant_get(self.v, f"$.{name}", "string"))

    def flag(self, name: str) -> Column:
        return F.when(self._kind(name) == "BOOLEAN", F.try_variant_get(self.v, f"$.{name}", "boolean"))

    def whole(self, name: str) -> Column:
        return F.when(self._kind(name) == "BIGINT", F.try_variant_get(self.v, f"$.{name}", "int"))

    def texts(self, name: str) -> Column:
        """The items of a list of texts, empty for an empty one, null for other kinds."""
        return F.when(self._kind(name).isin("ARRAY<STRING>", "ARRAY<VOID>"), F.try_variant_get(self.v, f"$.{name}", "array<string>"))


def _once(payload: Column, build: Callable[[_Parsed], Column]) -> Column:
    """What build() makes of a payload that is parsed once, however often its members are asked for."""
    # within brackets, as the parser passes over what follows a whole value; a second value is told by its place
    listed = F.try_parse_json(F.concat(F.lit("["), unfenced(payload), F.lit("]")))
    alone = lambda v: F.when(F.try_variant_get(v, "$[1]", "variant").isNull(), F.try_variant_get(v, "$[0]", "variant"))
    first = F.transform(F.array(listed), alone)
    return F.get(F.transform(first, lambda v: build(_Parsed(v))), F.lit(0))


def _filled(items: Column) -> Column:
    return F.filter(F.transform(items, trimmed), lambda x: x != "")


def _kept(items: Column) -> Column:
    return F.when(F.forall(items, lambda x: x.isNotNull()), items)


def _not_blank(c: Column) -> Column:
    return trimmed(c) != ""


def default_post_type(category: Column) -> Column:
    return F.when(category == "complaint", "first_person_pain").when(category == "unsolved", "solution_request").otherwise("advice_thread")


def _common(p: _Parsed) -> tuple[dict[str, Column], list[Column]]:
    category, summary = p.text("category"), p.text("summary")
    value = lambda name, default: F.when(p.has(name), p.text(name)).otherwise(default)
    kind, hand, who = value("post_type", default_post_type(category)), value("first_handness", F.lit("unknown")), value("buyer_authority", F.lit("unknown"))
    fields = {"category": category, "severity": p.text("severity"), "summary": trimmed(summary), "post_type": kind, "first_handness": hand, "buyer_authority": who}
    return fields, [p.is_object, category.isin(*CATEGORIES), p.text("severity").isin(*LEVELS), _not_blank(summary), kind.isin(*POST_TYPES), hand.isin(*HANDNESS), who.isin(*AUTHORITIES)]


def _spans(items: Column) -> Column:
    return F.slice(F.transform(_filled(items), lambda x: F.substring(x, 1, 160)), 1, 3)


def _shaped(fields: dict[str, Column], conditions: list[Column]) -> Column:
    return F.when(_all(conditions), F.struct(*(c.alias(name) for name, c in fields.items())))


def _primary(p: _Parsed) -> Column:
    """A classification of twelve fields; willingness to pay is at most 3 where the post isn't monetisable."""
    fields, good = _common(p)
    money, pain, wtp = p.flag("is_monetizable"), p.whole("pain_level"), p.whole("willingness_to_pay")
    items = lambda name: F.when(p.has(name), _kept(p.texts(name))).otherwise(F.array().cast("array<string>"))
    tools, spans, niche = items("competitor_tags"), items("evidence_spans"), p.text("niche_category")
    fields |= {
        "is_monetizable": money, "pain_level": pain, "willingness_to_pay": F.when(money, wtp).otherwise(F.least(F.lit(3), wtp)), "niche_category": trimmed(niche),
        "competitor_tags": F.transform(_filled(tools), F.lower), "evidence_spans": _spans(spans),
    }
    return _shaped(fields, [*good, money.isNotNull(), pain.between(0, 10), wtp.between(0, 10), niche.isNotNull(), tools.isNotNull(), spans.isNotNull()])


def _legacy(p: _Parsed) -> Column:
    """The older classification: lists that break the contract count as empty."""
    fields, good = _common(p)
    items = lambda name: F.coalesce(_kept(p.texts(name)), F.array().cast("array<string>"))
    return _shaped(fields | {"competitor_tags": F.transform(_filled(items("competitor_tags")), F.lower), "evidence_spans": _spans(items("evidence_spans"))}, good)


def _deep_dive(p: _Parsed) -> Column:
    """Four lists of texts, which may be empty, and two texts."""
    lists = {name: _kept(p.texts(name)) for name in ("workarounds", "competitors", "feature_wishlist", "buying_signals")}
    words = {name: p.text(name) for name in ("icp_hypothesis", "actionable_summary")}
    return _shaped({k: _filled(c) for k, c in lists.items()} | {k: trimmed(c) for k, c in words.items()}, [p.is_object, *(c.isNotNull() for c in lists.values()), *(_not_blank(c) for c in words.values())])


def _cluster_label(p: _Parsed) -> Column:
    """A cluster's label, summary, monetisation signal and key complaints."""
    label, summary, signal, told = p.text("label"), p.text("summary"), p.text("estimated_monetization_signal"), _kept(p.texts("key_complaints"))
    return _shaped({"label": trimmed(label), "summary": trimmed(summary), "signal": signal, "key_complaints": _filled(told)}, [p.is_object, _not_blank(label), _not_blank(summary), signal.isin(*LEVELS), told.isNotNull()])


def _gtm(p: _Parsed) -> Column:
    """Three names, two headings, three features, a price tier and a rationale, none blank."""
    three = lambda c: (F.size(c) == 3) & F.forall(c, lambda x: F.coalesce(_not_blank(x), F.lit(False)))
    names, features = p.texts("name_options"), p.texts("mvp_features")
    words = {name: p.text(name) for name in ("hero_h1", "hero_h2", "pricing_tier", "positioning_rationale")}
    return _shaped({"name_options": F.transform(names, trimmed), "mvp_features": F.transform(features, trimmed)} | {k: trimmed(c) for k, c in words.items()}, [p.is_object, three(names), three(features), *(_not_blank(c) for c in words.values())])


def _structured(p: _Parsed) -> Column:
    """The structured parser's classification: the primary one's bounds without the kinds of post, hand and buyer."""
    money, pain, wtp = p.flag("is_monetizable"), p.whole("pain_level"), p.whole("willingness_to_pay")
    category, severity, summary, niche = p.text("category"), p.text("severity"), p.text("summary"), p.text("niche_category")
    tools = F.when(p.has("competitor_tags"), _kept(p.texts("competitor_tags"))).otherwise(F.array().cast("array<string>"))
    fields = {"category": category, "severity": severity, "summary": trimmed(summary), "is_monetizable": money, "pain_level": pain, "willingness_to_pay": F.when(money, wtp).otherwise(F.least(F.lit(3), wtp)), "niche_category": trimmed(niche), "competitor_tags": F.transform(_filled(tools), F.lower)}
    return _shaped(fields, [p.is_object, category.isin(*CATEGORIES), severity.isin(*LEVELS), _not_blank(summary), money.isNotNull(), pain.between(0, 10), wtp.between(0, 10), niche.isNotNull(), tools.isNotNull()])


def _shape(build: Callable[[_Parsed], Column]) -> Callable[[Column], Column]:
    def shape(payload: Column) -> Column:
        return _once(payload, build)

    shape.__doc__ = build.__doc__
    return shape


primary, legacy, deep_dive, cluster_label, gtm, structured = map(_shape, (_primary, _legacy, _deep_dive, _cluster_label, _gtm, _structured))
#: Operation to the contract of its answer.
SHAPES = {"primary": primary, "legacy": legacy, "deep_dive": deep_dive, "cluster_label": cluster_label, "gtm": gtm, "structured": structured}


def prompt_text(operation: str, c: Column) -> Column:
    """The part of a text that an operation's prompt takes."""
    return F.substring(F.coalesce(c, F.lit("")), 1, PROMPT_CHARS[operation])


def first_valid(tiers: list[tuple[str, Column]]) -> tuple[Column, Column, Column]:
    """(answer, mode, fallback reason) of tiers (name, answer or null) of one type, best first: the first answer that isn't
    null, its tier's name, and what was passed over before it."""
    answer = F.coalesce(*(c for _, c in tiers))
    mode = F.coalesce(*(F.when(c.isNotNull(), F.lit(name)) for name, c in tiers))
    found, failed = F.lit(False), []
    for name, c in tiers:
        failed.append(F.when(~found & c.isNull(), F.lit(f"{name}_invalid")))
        found = found | c.isNotNull()
    return answer, mode, F.nullif(F.concat_ws(",", *failed), F.lit(""))


def usage_events(responses: DataFrame, response: str = "response_json") -> DataFrame:
    """The responses that report usage, with prompt_tokens and completion_tokens: whole numbers, 0 for others and for
    negative ones; a response without usage gives no row."""
    v = F.try_parse_json(response)
    usage = F.try_variant_get(v, "$.usage", "variant")
    count = lambda name: F.greatest(F.lit(0).cast("long"), F.coalesce(F.try_variant_get(usage, f"$.{name}", "long"), F.lit(0).cast("long")))
    rows = responses.withColumn("_good", F.coalesce(F.schema_of_variant(usage).startswith("OBJECT"), F.lit(False))).where("_good")
    return rows.withColumns({"prompt_tokens": count("prompt_tokens"), "completion_tokens": count("completion_tokens")}).drop("_good", response)
