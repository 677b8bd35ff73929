"""Payloads made of the tables as feeds would land them, read back by the sources, with the SQL of what must come out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.udfs import review_id_udf
from ..sources import landed, posts, sinks
from ..sources.tables import scratch_dir, spread, table
from .text_queries import _LIST, _TRIM


def _signals(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pain_points", "id", *columns))


def _file(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def listing_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts of listings of one child each, a part of them broken or of another kind."""
    rows = _signals(spark, sf_dir, "title", "body", "subreddit", "source_created_ts", "author_name", "pain_level")
    data = F.struct(F.concat(F.lit("x"), "id").alias("id"), "title", F.col("body").alias("selftext"), F.concat(F.lit("/r/x/"), "id").alias("permalink"), "subreddit", F.col("pain_level").cast("string").alias("score"), F.col("source_created_ts").cast("double").alias("created_utc"), F.col("author_name").alias("author"))
    payload = F.to_json(F.struct(F.struct(F.array(F.struct(F.when(F.col("id") % 10 == 3, "t5").otherwise("t3").alias("kind"), data.alias("data"))).alias("children")).alias("data")))
    found = posts.listing_posts(rows.select(F.when(F.col("id") % 10 == 4, F.substring(payload, 1, 40)).otherwise(payload).alias("value")))
    return found.select("post_id", "subreddit", F.md5("title").alias("title_hash"), F.md5("body").alias("body_hash"), "url", "score", "source_created_ts", "source_created_at", "author_name")


def hit_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts of search hits that are newer than a time; those without title and text are left out."""
    rows = _signals(spark, sf_dir, "title", "summary", "source_created_ts", "pain_level")
    hit = F.struct(F.col("id").cast("string").alias("objectID"), F.when(F.col("id") % 2 == 0, F.col("title")).alias("title"), F.when(F.col("id") % 2 == 1, F.col("title")).alias("story_title"), F.col("summary").alias("comment_text"), F.col("pain_level").cast("string").alias("points"), F.col("source_created_ts").alias("created_at_i"))
    found = posts.hit_posts(rows.select(F.to_json(F.struct(F.array(hit).alias("hits"))).alias("value")), since=1_750_000_000)
    return found.select("post_id", F.length("title").alias("title_chars"), F.length("body").alias("body_chars"), "score", "source_created_ts")


def flat_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments of threads in which each but the first is a reply to the one before, depth first, at most three."""
    rows = _signals(spark, sf_dir, "comment_sample_json").withColumn("c", C.filled(C.json_list("comment_sample_json")))
    nested = F.aggregate(F.reverse("c"), F.lit('""'), lambda inner, x: F.concat(F.lit('{"data": {"children": [{"kind": "t1", "data": {"body": '), F.get(F.split(F.to_json(F.array(x)), r"^\[|\]$"), F.lit(1)), F.lit(', "replies": '), inner, F.lit("}}]}}")))
    payload = F.when(F.size("c") > 0, F.concat(F.lit("[{}, "), nested, F.lit("]"))).otherwise("[{}, {}]")
    found = posts.flat_comments(rows.select(F.col("id").cast("string").alias("thread_id"), payload.alias("value")), most=3)
    return found.select(F.col("thread_id").cast("long").alias("id"), F.md5(F.array_join("comments", "\n")).alias("comments_hash"), F.size("comments").alias("n"))


def page_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bad reviews of pages with a card each, at most two of each brand and 500 in all."""
    rows = spread(table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_size"))
    page = F.concat(F.lit('<article class="review-card"><span aria-label="'), (F.col("p_size") % 5 + 1).cast("string"), F.lit(' stars"></span><p>'), "p_name", F.lit(" <br> part</p></article>"))
    found = posts.page_reviews(rows.select(F.concat_ws("/", "p_brand", F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("url"), page.alias("html")))
    each = found.select(F.split_part("url", F.lit("/"), F.lit(1)).alias("target"), F.lit(0).alias("target_no"), F.split_part("url", F.lit("/"), F.lit(2)).cast("long").alias("position"), "rating", "body", "score")
    return landed.capped_reviews(each, 2, 500).select("target", F.col("position").alias("p_partkey"), "rating", "body", "score")


def review_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_size"))
    return rows.select("p_partkey", review_id_udf(F.lit("site"), F.lit("slug"), F.col("p_brand"), (F.col("p_size") / 4).cast("double"), F.col("p_name")).alias("post_id"))


def lines_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals written as JSON lines, numbers that aren't finite as null, and read back as posts."""
    rows = _signals(spark, sf_dir, "post_id", "title", "body", "subreddit", "url", "source_created_ts", "author_name", "comment_sample_json")
    at = _file(spark, "lines")
    sinks.write_json(rows.select(F.when(F.col("id") % 9 != 0, F.col("post_id")).alias("post_id"), "title", "body", "subreddit", "url", "source_created_ts", "author_name", C.json_list("comment_sample_json").alias("top_comments"), F.lit(float("nan")).alias("odd")), at)
    found = posts.read_posts(spark, at)
    return found.select("post_id", F.md5("title").alias("title_hash"), F.md5("body").alias("body_hash"), "subreddit", "score", "source", F.size("top_comments").alias("n_comments"), "source_created_ts", "author_name")


def labels_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels written as JSON lines and read back by the strict reader."""
    at = _file(spark, "labels")
    sinks.write_json(table(spark, sf_dir, "eval_labels"), at)
    return posts.read_labels(spark, at).select("post_id", "is_pain", "post_type", "hard_negative_type", "evidence_quality", "feedback_useful")


def feed_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts of Atom files that Spark wrote."""
    rows = _signals(spark, sf_dir, "source_created_ts", "author_name").where("source_created_ts is not null")
    at = _file(spark, "feed")
    entry = F.struct(F.concat(F.lit("t3_"), "id").alias("id"), F.concat(F.lit("Title "), "id").alias("title"), F.concat(F.lit("<p>Body&nbsp;"), "id", F.lit("</p>")).alias("content"), F.date_format(F.timestamp_seconds("source_created_ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published"), F.struct(F.concat(F.lit("/u/a"), "id").alias("name")).alias("author"), F.struct(F.concat(F.lit("https://reddit.example/r/feed"), F.col("id") % 5, F.lit("/comments/x/")).alias("_href")).alias("link"))
    rows.select(entry.alias("e")).select("e.*").write.format("xml").option("rootTag", "feed").option("rowTag", "entry").save(at)
    return posts.feed_posts(spark, at).select("post_id", "subreddit", "title", "body", "source_created_ts", "author_name")


def merged_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a post as the same post seen in several feeds: best score, earliest time, first filled fields."""
    rows = table(spark, sf_dir, "documents", "doc_id", "post_id", "text", "source", "n_chars", "fetched_at", "subreddit")
    seen = rows.select("post_id", F.col("doc_id").alias("ordinal"), F.col("source").alias("title"), "subreddit", "source", F.md5(C.text("text")).alias("body"), F.coalesce(F.col("n_chars"), F.lit(0)).alias("score"), F.unix_micros(F.col("fetched_at").cast("timestamp")).alias("source_created_ts"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise(" ").alias("discovery_query"), F.lit(None).cast("string").alias("permalink"), F.col("source").alias("url"), F.when(F.col("doc_id") % 3 == 0, F.col("source")).alias("author_name"))
    return landed.merged_feeds(seen).select("post_id", "score", "source_created_ts", "discovery_query", "permalink", "url", "author_name", "body")


def best_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landed.best_posts(table(spark, sf_dir, "eval_posts", "post_id", "score"), 50)


_FUNCTIONS = (listing_posts, hit_posts, flat_comments, page_reviews, review_ids, lines_again, labels_again, feed_again, merged_feeds, best_posts)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_ISO = "strftime(make_timestamp({0} * 1000000), '%Y-%m-%dT%H:%M:%S+00:00')"
_PLAIN = "trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace({0}, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ')"
_COMMENTS = f"list_filter(list_transform({_LIST.format('comment_sample_json')}, lambda x: {_TRIM.format('x')}), lambda x: x <> '')"

ORACLE = {
    "listing_posts": f"""SELECT concat('reddit:x', id) AS post_id, coalesce(subreddit, '') AS subreddit, md5(trim(coalesce(title, ''), ' ')) AS title_hash, md5(coalesce(body, '')) AS body_hash, concat('https://www.reddit.com/r/x/', id) AS url, coalesce(pain_level, 0) AS score,
        CASE WHEN source_created_ts > 0 THEN source_created_ts END AS source_created_ts, CASE WHEN source_created_ts > 0 THEN {_ISO.format('source_created_ts')} END AS source_created_at, nullif(author_name, '') AS author_name FROM pain_points WHERE id % 10 NOT IN (3, 4)""",
    "hit_posts": f"""WITH h AS (SELECT *, {_PLAIN.format("coalesce(title, '')")} AS t, {_PLAIN.format("coalesce(summary, '')")} AS b FROM pain_points)
        SELECT concat('hn:', id) AS post_id, CAST(length(t) AS INTEGER) AS title_chars, CAST(length(b) AS INTEGER) AS body_chars, coalesce(pain_level, 0) AS score, source_created_ts FROM h WHERE (t <> '' OR b <> '') AND coalesce(source_created_ts, 1750000001) > 1750000000""",
    "flat_comments": f"WITH c AS (SELECT id, ({_COMMENTS})[1:3] AS c FROM pain_points) SELECT id, md5(array_to_string(c, chr(10))) AS comments_hash, CAST(len(c) AS INTEGER) AS n FROM c",
    "page_reviews": """WITH r AS (SELECT p_brand AS target, p_partkey, CAST(p_size % 5 + 1 AS DOUBLE) AS rating, concat(p_name, ' part') AS body FROM part WHERE p_size % 5 + 1 <= 2), k AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY p_partkey) AS r FROM r)
        SELECT target, p_partkey, rating, body, CAST((2.5 - rating) * 10 AS INTEGER) AS score FROM k WHERE r <= 2 ORDER BY target, p_partkey LIMIT 500""",
    "review_ids": """WITH p AS (SELECT *, round(p_size / 4.0, 2) AS r FROM part), j AS (SELECT p_partkey, concat('{"rating": ', CAST(CAST(r AS DOUBLE) AS VARCHAR), ', "site": "site", "slug": "slug", "text": "', lower(p_name), '", "url": "', lower(p_brand), '"}') AS j FROM p)
        SELECT p_partkey, concat('review:site:slug:', substring(sha256(j), 1, 16)) AS post_id FROM j""",
    "lines_again": f"""SELECT post_id, md5(coalesce(title, '')) AS title_hash, md5(coalesce(body, '')) AS body_hash, coalesce(subreddit, '') AS subreddit, CAST(0 AS BIGINT) AS score, 'reddit' AS source, CAST(len({_COMMENTS}) AS INTEGER) AS n_comments, source_created_ts, author_name FROM pain_points WHERE id % 9 <> 0 AND post_id IS NOT NULL""",
    "labels_again": "SELECT post_id, is_pain, post_type, coalesce(hard_negative_type, '') AS hard_negative_type, coalesce(evidence_quality, 'none') AS evidence_quality, coalesce(feedback_useful, false) AS feedback_useful FROM eval_labels",
    "feed_again": "SELECT concat('reddit:', id) AS post_id, concat('feed', id % 5) AS subreddit, concat('Title ', id) AS title, concat('Body ', id) AS body, source_created_ts, concat('a', id) AS author_name FROM pain_points WHERE source_created_ts IS NOT NULL",
    "merged_feeds": """SELECT post_id, max(coalesce(n_chars, 0)) AS score, min(epoch_us(fetched_at)) AS source_created_ts, coalesce(arg_min(source, doc_id) FILTER (doc_id % 2 = 0 AND trim(coalesce(source, '')) <> ''), '') AS discovery_query, '' AS permalink, coalesce(arg_min(source, doc_id) FILTER (trim(coalesce(source, '')) <> ''), '') AS url,
        arg_min(source, doc_id) FILTER (doc_id % 3 = 0 AND trim(coalesce(source, '')) <> '') AS author_name, arg_min(md5(coalesce(text, '')), doc_id) AS body FROM documents WHERE post_id IS NOT NULL GROUP BY 1""",
    "best_posts": "SELECT post_id, score FROM eval_posts ORDER BY score DESC NULLS LAST, post_id LIMIT 50",
}
