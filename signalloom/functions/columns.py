"""Column expressions that operators are built of; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def text(c: str | Column) -> Column:
    """The value, or an empty text for null."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def contains_any(haystack: Column, terms: Iterable[str]) -> Column:
    """True where any of the terms occurs."""
    return reduce(lambda a, b: a | b, (F.contains(haystack, F.lit(t)) for t in terms), F.lit(False))


def count_hits(haystack: Column, terms: Iterable[str]) -> Column:
    """Number of different terms that occur."""
    return reduce(lambda a, b: a + b, (F.contains(haystack, F.lit(t)).cast("int") for t in terms), F.lit(0))


def trimmed(c: Column) -> Column:
    """Without white space of any script at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def json_list(c: str | Column) -> Column:
    """The texts of a JSON list; empty for null, malformed or other JSON."""
    return F.coalesce(F.from_json(c, "array<string>", {"mode": "PERMISSIVE", "allowSingleQuotes": "false"}), F.array().cast("array<string>"))


def filled(items: Column) -> Column:
    """The items that aren't blank, trimmed."""
    return F.filter(F.transform(items, trimmed), lambda x: x.isNotNull() & (x != ""))


def tags(items: Column, longest: int = 64) -> Column:
    """Tags trimmed, in lower case, cut to `longest` characters, without blanks; the first of equal ones stays."""
    return F.array_distinct(F.filter(F.transform(items, lambda x: F.substring(F.lower(trimmed(x)), 1, longest)), lambda x: x.isNotNull() & (x != "")))


def tag_list(c: str | Column) -> Column:
    """Tags of a JSON list or, where it isn't one, of a comma-separated text."""
    c = F.col(c) if isinstance(c, str) else c
    return tags(F.coalesce(F.from_json(c, "array<string>", {"allowSingleQuotes": "false"}), F.split(c, ","), F.array().cast("array<string>")))


def lookup(c: Column, values: dict[str, float], default: str) -> Column:
    """A fixed number for a name, trimmed and in lower case; the default's for an unknown or null one."""
    key, out = F.lower(F.trim(c)), F.lit(values[default]).cast("double")
    return reduce(lambda other, kv: F.when(key == kv[0], F.lit(kv[1]).cast("double")).otherwise(other), values.items(), out)


def dot(a: Column, b: Column) -> Column:
    """Inner product; 0 for vectors of different lengths."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0).cast("double"), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), product).otherwise(F.lit(0.0))


def unit(v: Column) -> Column:
    """The vector at length 1; null if it is null, empty, zero or has a number that isn't finite."""
    v = v.cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0).cast("double"), lambda s, x: s + x * x))
    good = (F.size(v) > 0) & (norm > 0) & (norm < F.lit(float("inf"))) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x))
    return F.when(good, F.transform(v, lambda x: x / norm))


def escaped_cell(c: Column) -> Column:
    """A text that a spreadsheet won't take for a formula."""
    return F.when(F.ltrim(c).rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def preview(c: Column, longest: int, suffix: str = "...") -> Column:
    """The text cut to `longest` characters, the suffix included."""
    return F.when(F.length(c) > longest, F.concat(F.rtrim(F.substring(c, 1, longest - len(suffix))), F.lit(suffix))).otherwise(c)


def without_markup(c: Column) -> Column:
    """Tags to spaces, common entities to characters, white space to single spaces."""
    out = F.regexp_replace(c, r"<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def public_url(c: Column) -> Column:
    """True for an http(s) address without credentials whose host is a name or a public number."""
    host = F.lower(F.regexp_extract(c, r"^(?i)https?://([^/?#:@]+)(?::\d+)?(?:[/?#]|$)", 1))
    number = host.rlike(r"^\d+(\.\d+){0,3}$|^0x")
    private = host.rlike(r"^(0|10|127|169\.254|192\.168|172\.(1[6-9]|2\d|3[01])|100\.(6[4-9]|[7-9]\d|1[01]\d|12[0-7])|22[4-9]|2[345]\d)\.") | ~host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    local = (host == "localhost") | host.rlike(r"\.(local|internal|localhost)$") | ~host.contains(".")
    return F.coalesce((host != "") & F.when(number, ~private).otherwise(~local), F.lit(False))


def with_comments(body: Column, comments: Column) -> Column:
    """A body with its comments as a list under it; the body alone without comments, the list alone under a blank one."""
    lines = F.concat(F.lit("Top comments:\n"), F.array_join(F.transform(comments, lambda x: F.concat(F.lit("- "), x)), "\n"))
    under = F.when(trimmed(text(body)) == "", lines).otherwise(F.concat(text(body), F.lit("\n\n"), lines))
    return F.when(F.size(comments) > 0, under).otherwise(text(body))


def thread_prompt(title: Column, body: Column, comments: Column) -> Column:
    """A whole thread as one text: title, body and comments under headings."""
    lines = F.array_join(F.transform(comments, lambda x: F.concat(F.lit("- "), x)), "\n")
    return trimmed(F.concat(F.lit("Title: "), text(title), F.lit("\n\nBody:\n"), text(body), F.lit("\n\nThread comments:\n"), lines))


def valid_feed(c: Column) -> Column:
    """True for a name that a subreddit may have."""
    return F.coalesce(c.rlike(r"^[A-Za-z0-9_]{2,21}$"), F.lit(False))


def valid_post_id(c: Column) -> Column:
    """True for an id that a post may have, with or without its source's prefix."""
    return F.coalesce(c.rlike(r"^[A-Za-z0-9_:-]+$"), F.lit(False))


def exact_quotes(evidence: Column) -> Column:
    """The quotes of verified evidence (array of quote, match_type) that match exactly, trimmed; the first of those that
    differ in case only stays."""
    quotes = F.filter(F.transform(F.filter(evidence, lambda x: x["match_type"] == "exact"), lambda x: trimmed(text(x["quote"]))), lambda x: x != "")
    low = F.transform(quotes, F.lower)
    return F.filter(quotes, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def grounded_quotes(evidence: Column) -> Column:
    """The quotes of verified evidence that match in any way."""
    return F.transform(F.filter(evidence, lambda x: x["match_type"] != "none"), lambda x: x["quote"])


def evidence_list(c: str | Column, path: str = "$.verified_evidence") -> Column:
    """Verified evidence of a JSON payload, empty where it has none."""
    kind = "array<struct<quote: string, match_type: string>>"
    return F.coalesce(F.from_json(F.get_json_object(c, path), kind), F.array().cast(kind))
