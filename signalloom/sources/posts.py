"""Landed payloads of the source families as posts of one schema.

Readers take text lines or rows that hold a payload, so that fetching stays outside; a payload that isn't well
formed gives no posts.  Posts: post_id, subreddit, title, body, url, score, permalink, source, source_created_ts,
source_created_at, author_name."""

from __future__ import annotations

import html
import json
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import filled, text, without_markup

POST = "post_id string, subreddit string, title string, body string, url string, score long, permalink string, top_comments array<string>, source string, discovery_query string, source_created_at string, source_created_ts long, author_name string"
LISTING = "data struct<children: array<struct<kind: string, data: struct<id: string, title: string, selftext: string, permalink: string, url: string, subreddit: string, score: string, created_utc: double, author: string>>>>"
HITS = "hits array<struct<objectID: string, title: string, story_title: string, story_text: string, comment_text: string, url: string, story_url: string, points: string, created_at_i: long, author: string>>"


def iso(ts: Column) -> Column:
    return F.date_format(F.timestamp_seconds(ts), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def safe_long(c: Column) -> Column:
    """A whole number, or 0 for what isn't one."""
    return F.coalesce(c.try_cast("long"), F.lit(0))


def listing_posts(payloads: DataFrame, column: str = "value", site: str = "https://www.reddit.com") -> DataFrame:
    """Posts of listing payloads; children without an id, or of other kinds than t3, are left out."""
    child = payloads.select(F.explode(F.from_json(column, LISTING)["data"]["children"]).alias("c")).where("c.data.id is not null and c.data.id <> '' and coalesce(c.kind, 't3') = 't3'").select("c.data.*")
    ts = F.when(F.col("created_utc") > 0, F.col("created_utc").cast("long"))
    link = F.when(F.col("permalink").startswith("/"), F.concat(F.lit(site), F.col("permalink"))).otherwise(text("permalink"))
    return child.select(F.concat(F.lit("reddit:"), "id").alias("post_id"), text("subreddit").alias("subreddit"), F.trim(text("title")).alias("title"), text("selftext").alias("body"), F.coalesce(F.nullif("url", F.lit("")), link).alias("url"), safe_long(F.col("score")).alias("score"), link.alias("permalink"), F.lit("reddit").alias("source"), ts.alias("source_created_ts"), iso(ts).alias("source_created_at"), F.nullif("author", F.lit("")).alias("author_name"))


def hit_posts(payloads: DataFrame, column: str = "value", *, since: int = 0, site: str = "https://news.ycombinator.com/item?id=") -> DataFrame:
    """Posts of search payloads that are newer than `since` and have an id and a title or text."""
    h = payloads.select(F.explode(F.from_json(column, HITS)["hits"]).alias("h")).select("h.*")
    title = without_markup(F.coalesce(F.nullif("title", F.lit("")), F.nullif("story_title", F.lit("")), F.lit("")))
    body = without_markup(F.coalesce(F.nullif("story_text", F.lit("")), F.nullif("comment_text", F.lit("")), F.lit("")))
    link = F.concat(F.lit(site), "objectID")
    rows = h.where("objectID is not null and objectID <> ''").select(F.concat(F.lit("hn:"), "objectID").alias("post_id"), F.lit("hackernews").alias("subreddit"), title.alias("title"), body.alias("body"), F.coalesce(F.nullif("url", F.lit("")), F.nullif("story_url", F.lit("")), link).alias("url"), safe_long(F.col("points")).alias("score"), link.alias("permalink"), F.lit("hn").alias("source"), F.col("created_at_i").alias("source_created_ts"), iso(F.col("created_at_i")).alias("source_created_at"), F.nullif("author", F.lit("")).alias("author_name"))
    return rows.where((F.col("title") != "") | (F.col("body") != "")).where(F.coalesce("source_created_ts", F.lit(since + 1)) > since)


def feed_posts(spark: SparkSession, path: str) -> DataFrame:
    """Posts of Atom files: one for each entry with an id."""
    entry = "id string, title string, content string, summary string, updated string, published string, author struct<name: string>, link struct<_href: string>"
    e = spark.read.format("xml").option("rowTag", "entry").option("mode", "PERMISSIVE").schema(entry).load(path)
    stamp = F.coalesce(F.try_to_timestamp("published"), F.try_to_timestamp("updated"))
    ts = F.unix_seconds(stamp)
    name = F.regexp_extract("id", r"([A-Za-z0-9_]+)/?$", 1)
    return e.where("id is not null and id <> ''").select(F.concat(F.lit("reddit:"), F.regexp_replace(name, "^t3_", "")).alias("post_id"), F.regexp_extract(text("link._href"), r"/r/([A-Za-z0-9_]+)/", 1).alias("subreddit"), without_markup(text("title")).alias("title"), without_markup(F.coalesce("content", "summary", F.lit(""))).alias("body"), text("link._href").alias("url"), F.lit(0).cast("long").alias("score"), text("link._href").alias("permalink"), F.lit("reddit").alias("source"), ts.alias("source_created_ts"), iso(ts).alias("source_created_at"), F.regexp_replace(text("author.name"), "^/?u/", "").alias("author_name"))


def flat_comments(payloads: DataFrame, column: str = "value", most: int = 250) -> DataFrame:
    """(position, comments) of thread payloads: the texts of nested replies, depth first, at most `most`."""

    def walk(batches):
        for pdf in batches:
            out = []
            for value in pdf["value"]:
                found: list[str] = []
                try:
                    stack = [c for c in reversed(json.loads(value)[1]["data"]["children"])]
                except (ValueError, TypeError, KeyError, IndexError):
                    stack = []
                while stack and len(found) < most:
                    node = stack.pop()
                    data = node.get("data") if isinstance(node, dict) and node.get("kind") == "t1" else None
                    if not isinstance(data, dict):
                        continue
                    if isinstance(body := data.get("body"), str) and body.strip():
                        found.append(body.strip())
                    replies = data.get("replies")
                    if isinstance(replies, dict) and isinstance(kids := (replies.get("data") or {}).get("children"), list):
                        stack += reversed(kids)
                out.append(found)
            yield pd.DataFrame({"thread_id": pdf["thread_id"], "comments": out})

    return payloads.select("thread_id", F.col(column).alias("value")).mapInPandas(walk, "thread_id string, comments array<string>")


class _Reviews(HTMLParser):
    """Review cards and JSON-LD reviews of one page."""

    def __init__(self):
        super().__init__()
        self.reviews: list[tuple[float, str]] = []
        self.script: list[str] | None = None
        self.card: list | None = None
        self.depth = 0

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "script" and (a.get("type") or "").lower() == "application/ld+json":
            self.script = []
        if self.card is None and ("review" in (a.get("class") or "").lower().split("-") or "review" in (a.get("class") or "").lower().split() or a.get("itemprop") == "review" or re.search(r"\breview-?(?:card|item|box)?\b", a.get("class") or "", re.I)):
            self.card, self.depth = [None, []], 0
        if self.card is not None:
            if tag not in ("br", "img", "hr", "input", "meta", "link"):
                self.depth += 1
            for key in ("data-rating", "aria-label", "content"):
                if self.card[0] is None and a.get(key) and (m := re.search(r"\d+(?:\.\d+)?", a[key])) and (key == "data-rating" or re.search(r"star|rat", a[key] + str(a.get("itemprop")), re.I)):
                    self.card[0] = float(m.group())

    def handle_endtag(self, tag):
        if tag == "script" and self.script is not None:
            self._linked("".join(self.script))
            self.script = None
        if self.card is not None and tag not in ("br", "img", "hr", "input", "meta", "link"):
            self.depth -= 1
            if self.depth <= 0:
                rating, words = self.card
                body = " ".join(" ".join(words).split())
                if rating is None and (m := re.search(r"(\d+(?:\.\d+)?)\s*(?:/\s*5|out of 5|stars?)", body, re.I)):
                    rating = float(m.group(1))
                if rating is not None and body:
                    self.reviews.append((rating, body))
                self.card = None

    def handle_data(self, data):
        if self.script is not None:
            self.script.append(data)
        elif self.card is not None:
            self.card[1].append(data)

    def _linked(self, source: str):
        try:
            nodes = [json.loads(source)]
        except ValueError:
            return
        while nodes:
            node = nodes.pop()
            if isinstance(node, list):
                nodes += node
            elif isinstance(node, dict):
                if node.get("@type") == "Review":
                    rating = node.get("reviewRating")
                    try:
                        value = float((rating or {}).get("ratingValue")) if isinstance(rating, dict) else float(rating)
                    except (TypeError, ValueError):
                        value = None
                    body = html.unescape(str(node.get("reviewBody") or "")).strip()
                    if value is not None and body:
                        self.reviews.append((value, body))
                nodes += [v for v in node.values() if isinstance(v, (list, dict))]


def page_reviews(pages: DataFrame, *, worst: float = 2.0, per_page: int = 30, max_bytes: int = 2_000_000) -> DataFrame:
    """(url, position, rating, body, score) of bad reviews on landed pages (url, html): 0 < rating <= `worst`.

    Pages over max_bytes are left out, as a bounded read would; malformed pages give what can be read of them."""

    def parse(batches):
        for pdf in batches:
            rows = []
            for url, page in zip(pdf["url"], pdf["html"]):
                reader = _Reviews()
                reader.feed(page or "")
                reader.close()
                bad = [(r, b) for r, b in reader.reviews if 0 < r <= worst][:per_page]
                rows += [(url, i, r, b, int((2.5 - r) * 10)) for i, (r, b) in enumerate(bad)]
            yield pd.DataFrame(rows, columns=["url", "position", "rating", "body", "score"])

    return pages.where(F.octet_length("html") <= max_bytes).select("url", "html").mapInPandas(parse, "url string, position int, rating double, body string, score int")


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    """Posts of a JSON-lines file, with defaults for what is missing; lines without an id are left out."""
    df = spark.read.schema(POST).json(path).where("post_id is not null")
    blanks = {c: F.coalesce(c, F.lit("")) for c in ("subreddit", "title", "body", "url", "permalink", "discovery_query")}
    return df.withColumns(blanks | {"score": F.coalesce("score", F.lit(0)), "source": F.coalesce("source", F.lit("reddit")), "top_comments": filled(F.coalesce("top_comments", F.array().cast("array<string>")))})


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels of a JSON-lines file; a missing required field, an unknown kind or a repeated id raises."""
    schema = "post_id string, is_pain boolean, is_monetizable boolean, post_type string, is_current_opportunity boolean, first_handness string, buyer_authority string, reference_now_ts long, hard_negative_type string, evidence_quality string, feedback_useful boolean, cluster_useful boolean, notes string"
    df = spark.read.schema(schema).json(path)
    required = ("post_id", "is_pain", "is_monetizable", "post_type", "is_current_opportunity", "first_handness", "buyer_authority")
    bad = [F.when(F.col(c).isNull(), F.lit(f"label without {c}")) for c in required]
    kinds = ("first_person_pain", "solution_request", "founder_pitch", "news_analysis", "tool_comparison", "advice_thread", "vendor_rant", "unclassified")
    bad.append(F.when(~F.col("post_type").isin(*kinds), F.concat(F.lit("unknown post_type "), "post_type")))
    df = df.withColumn("_bad", F.coalesce(*bad)).withColumn("post_id", F.when(F.col("_bad").isNotNull(), F.raise_error(F.col("_bad"))).otherwise(F.col("post_id"))).drop("_bad")
    twice = df.groupBy("post_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"label {twice[0].post_id} occurs more than once")
    return df.withColumns({"hard_negative_type": text("hard_negative_type"), "evidence_quality": F.coalesce("evidence_quality", F.lit("none")), "feedback_useful": F.coalesce("feedback_useful", F.lit(False))})


def with_top_comments(posts: DataFrame, comments: DataFrame, k: int = 5) -> DataFrame:
    """Posts with their k best comments (post_id, score, body) as a list, ties by text; none gives an empty list."""
    from pyspark.sql import Window

    w = Window.partitionBy("post_id").orderBy(F.col("score").desc_nulls_last(), "body")
    best = comments.where("body is not null").withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    lists = best.groupBy("post_id").agg(F.array_sort(F.collect_list(F.struct("r", "body"))).alias("_c"))
    joined = posts.drop("top_comments").join(lists, "post_id", "left")
    return joined.withColumn("top_comments", F.coalesce(F.transform("_c", lambda x: x["body"]), F.array().cast("array<string>"))).drop("_c")


def fetch_plan(feeds: list[str], queries: list[str], limit: int) -> list[tuple[str, str, int]]:
    """(kind, name, how many) of what to fetch: each feed and query once, sharing the limit, 1 to 100 each."""
    wanted = [("feed", x) for x in dict.fromkeys(f.strip() for f in feeds if f.strip())] + [("search", x) for x in dict.fromkeys(q.strip() for q in queries if q.strip())]
    each = max(1, min(100, -(-limit // max(1, len(wanted)))))
    return [(kind, name, each) for kind, name in wanted]
