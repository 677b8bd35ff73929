"""A batch data source of landed feed payloads with tiers to fall back on, and what a fetcher's plan and preview need.

Fetching stays outside: each tier is a folder of files, one for each feed, that a fetcher has landed."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions.udfs import review_id_udf
from .posts import POST

#: Tiers in the order in which they are tried, and how a file of each is read.
TIERS = ("rich", "oauth", "json", "lines")


class FeedPartition(InputPartition):
    """One feed or search, read by one task."""

    def __init__(self, feed: str):
        super().__init__(feed)


def _child(d: dict) -> tuple | None:
    if not isinstance(d, dict) or not d.get("id"):
        return None
    try:
        score = int(float(d.get("score") or 0))
        ts = int(float(d["created_utc"])) if d.get("created_utc") else None
    except (TypeError, ValueError):
        score, ts = 0, None
    words = lambda k: v if isinstance(v := d.get(k), str) else ""
    link = words("permalink")
    link = f"https://www.reddit.com{link}" if link.startswith("/") else link
    comments = [c for c in d.get("top_comments") or [] if isinstance(c, str) and c.strip()]
    return (f"reddit:{d['id']}", words("subreddit"), words("title").strip(), words("selftext"), words("url") or link, score, link, comments, "reddit", words("discovery_query"), None, ts, words("author") or None)


def read_payload(tier: str, content: str) -> list[tuple]:
    """Posts of a file of a tier; raises ValueError where it isn't one."""
    if tier == "lines":
        children = [json.loads(line) for line in content.splitlines() if line.strip()]
    else:
        body = json.loads(content)
        if tier == "rich":  # records with their comments, as a client library gives them
            children = body
        else:  # a listing, which oauth and public endpoints give alike
            children = [c.get("data") for c in (body.get("data") or {}).get("children") or [] if isinstance(c, dict) and c.get("kind", "t3") == "t3"] if isinstance(body, dict) else None
    if not isinstance(children, list):
        raise ValueError("not a list of posts")
    return [p for d in children if (p := _child(d)) is not None]


class FeedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.tiers = [t.strip() for t in options.get("tiers", ",".join(TIERS)).split(",")]
        self.most = int(options.get("maxbytes", 5_000_000))
        self.strict = options.get("failwhenempty", "true").lower() == "true"
        self.feeds = [f.strip() for f in options.get("feeds", "").split(",") if f.strip()]

    def partitions(self) -> list[FeedPartition]:
        names = self.feeds or sorted({f.rpartition(".")[0] for t in self.tiers if os.path.isdir(f"{self.path}/{t}") for f in os.listdir(f"{self.path}/{t}")})
        return [FeedPartition(f) for f in dict.fromkeys(names)]

    def read(self, partition: FeedPartition) -> Iterator[tuple]:
        """The posts of the first tier that has a readable file for the feed; larger files than maxBytes aren't read."""
        tried = []
        for tier in self.tiers:
            at = f"{self.path}/{tier}/{partition.value}.json"
            try:
                if os.path.getsize(at) > self.most:
                    raise ValueError("larger than maxBytes")
                with open(at, encoding="utf-8") as file:
                    found = read_payload(tier, file.read())
            except (OSError, ValueError, AttributeError) as e:
                tried.append(f"{tier}: {e}")
                continue
            yield from found
            return
        if self.strict:
            raise ValueError(f"no tier has feed {partition.value}: {'; '.join(tried)}")


class Feeds(DataSource):
    """spark.read.format("feeds").option("path", folder): posts of landed feeds.

    Options: path (a folder that all executors see), feeds (names, all by default), tiers (rich, oauth, json, lines in the
    order of trying), maxBytes, failWhenEmpty (a feed that no tier has raises, or gives no rows)."""

    @classmethod
    def name(cls) -> str:
        return "feeds"

    def schema(self) -> str:
        return POST

    def reader(self, schema: StructType) -> FeedReader:
        return FeedReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Feeds)


def capped_reviews(reviews: DataFrame, per_target: int, total: int | None = None) -> DataFrame:
    """The first `per_target` reviews of each target (columns target_no, target, position), and of those the first
    `total` in the order of targets.  The caps are the feature."""
    rows = reviews.withColumn("_r", F.row_number().over(Window.partitionBy("target").orderBy("position", "body"))).where(F.col("_r") <= per_target).drop("_r")
    return rows.orderBy("target_no", "target", "position", "body").limit(total) if total is not None else rows


def review_posts(reviews: DataFrame) -> DataFrame:
    """Reviews (site, slug, url, rating, body, score) as posts: a text of its own gives each its id."""
    ident = review_id_udf("site", "slug", "url", "rating", "body")
    return reviews.select(ident.alias("post_id"), F.col("site").alias("subreddit"), F.concat(F.col("slug"), F.lit(" review")).alias("title"), "body", "url", F.col("score").cast("long").alias("score"), F.concat(F.lit("review:"), F.col("site")).alias("source"))


def best_posts(posts: DataFrame, limit: int) -> DataFrame:
    """The posts of the highest score, ties by id."""
    return posts.orderBy(F.col("score").desc_nulls_last(), "post_id").limit(limit)


def merged_feeds(posts: DataFrame, ordinal: str = "ordinal", *, first_found: bool = False) -> DataFrame:
    """One row for each post_id seen in several feeds and searches, which `ordinal` puts in order.

    The highest score, the earliest time, and the first query, permalink, address and author that aren't empty; with
    first_found the first time, body and score that aren't null, empty or 0 instead."""
    filled = lambda c: F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) != "", F.col(c))
    first = lambda c: F.min_by(c, F.when(c.isNotNull(), F.col(ordinal)))
    fixed = [F.min_by(F.col(c), F.col(ordinal)).alias(c) for c in ("title", "subreddit", "source")]
    empty = [F.coalesce(first(filled(c)), F.lit("")).alias(c) for c in ("discovery_query", "permalink", "url")] + [first(filled("author_name")).alias("author_name")]
    if first_found:
        rest = [first(F.col("source_created_ts")).alias("source_created_ts"), F.coalesce(first(filled("body")), F.lit("")).alias("body"), F.coalesce(first(F.when(F.col("score") != 0, F.col("score"))), F.lit(0)).alias("score")]
    else:
        rest = [F.min("source_created_ts").alias("source_created_ts"), F.min_by(F.col("body"), F.col(ordinal)).alias("body"), F.max("score").alias("score")]
    return posts.where("post_id is not null").groupBy("post_id").agg(*fixed, *empty, *rest)


def preview(sources: dict[str, DataFrame], rows: int = 5) -> tuple[int, dict[str, dict]]:
    """(exit code, source to its count and first rows): 0 where every source gave posts, 1 where some did, 2 where none.

    A source that fails counts as empty and has its error; the few rows are the feature."""
    found: dict[str, dict] = {}
    for name, df in sources.items():
        try:
            first = [r.asDict() for r in df.orderBy("post_id").limit(rows).collect()]
            found[name] = {"count": df.count(), "first": first}
        except Exception as e:  # noqa: BLE001
            found[name] = {"count": 0, "first": [], "error": str(e).split("\n")[0][:200]}
    good = sum(x["count"] > 0 for x in found.values())
    return (0 if found and good == len(found) else 1 if good else 2), found


def health(spark: SparkSession, tables: dict[str, list[str]], counts: dict[str, Column], ledger: DataFrame) -> dict[str, bool]:
    """What a store must have: tables (folder to its columns) that can be read, and a ledger of which no row meets any of the
    conditions in counts."""
    out = {}
    for at, columns in tables.items():
        try:
            out[at] = set(columns) <= set(spark.read.parquet(at).columns)
        except Exception:  # noqa: BLE001
            out[at] = False
    row = ledger.agg(*(F.count_if(c).alias(name) for name, c in counts.items())).first()
    return out | {name: row[name] == 0 for name in counts}
