import json
import os

import pytest
from pyspark.sql import functions as F

from signalloom.sources import landed, posts, sinks, tables
from signalloom.streaming import streams


def test_listing_and_hits(spark):
    child = lambda **d: {"kind": "t3", "data": d}
    payload = json.dumps({"data": {"children": [child(id="a1", title=" T ", selftext="b", permalink="/r/x/1", score="7", created_utc=1700000000.0, subreddit="x", author="me"), child(id=""), {"kind": "t5", "data": {"id": "z"}}]}})
    rows = posts.listing_posts(spark.createDataFrame([(payload,), ("{broken",), (None,)], "value string")).collect()
    assert len(rows) == 1 and rows[0].post_id == "reddit:a1" and rows[0].score == 7 and rows[0].url.endswith("/r/x/1") and rows[0].source_created_at == "2023-11-14T22:13:20+00:00"
    hits = json.dumps({"hits": [{"objectID": "9", "title": None, "story_title": "S", "comment_text": "<p>hi &amp; bye</p>", "points": "x", "created_at_i": 100}, {"objectID": "8", "title": "old", "created_at_i": 5}, {"objectID": "7", "created_at_i": 100}]})
    rows = posts.hit_posts(spark.createDataFrame([(hits,)], "value string"), since=50).collect()
    assert [(r.post_id, r.title, r.body, r.score) for r in rows] == [("hn:9", "S", "hi & bye", 0)]


def test_feed(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>t3_abc</id><title>T</title><content type="html">&lt;p&gt;Hello&lt;/p&gt;</content><updated>2024-01-02T03:04:05Z</updated><author><name>/u/kim</name></author><link href="https://www.reddit.com/r/ops/comments/abc/"/></entry></feed>')
    r = posts.feed_posts(spark, str(tmp_path)).collect()
    assert [(x.post_id, x.subreddit, x.body, x.author_name, x.source_created_ts) for x in r] == [("reddit:abc", "ops", "Hello", "kim", 1704164645)]


def test_threads(spark):
    node = lambda body, *kids: {"kind": "t1", "data": {"body": body, "replies": {"data": {"children": list(kids)}} if kids else ""}}
    thread = json.dumps([{}, {"data": {"children": [node("a", node("b", node("c"))), node(" "), node("d"), {"kind": "more"}]}}])
    got = {r.thread_id: r.comments for r in posts.flat_comments(spark.createDataFrame([("1", thread), ("2", "x"), ("3", None)], "thread_id string, value string"), most=3).collect()}
    assert got == {"1": ["a", "b", "c"], "2": [], "3": []}


def test_reviews(spark):
    page = """<script type="application/ld+json">{"@type":"Product","review":[{"@type":"Review","reviewRating":{"ratingValue":"1"},"reviewBody":"Bad &amp; slow"},{"@type":"Review","reviewRating":{"ratingValue":5},"reviewBody":"Good"}]}</script>
      <article class="review-card"><span aria-label="2 stars"></span><p>Crashes <br> often</p></article><article class="review-card"><p>No rating</p></article>"""
    rows = posts.page_reviews(spark.createDataFrame([("u", page), ("v", None), ("w", "<article class='review-card'")], "url string, html string")).collect()
    assert [(r.rating, r.body, r.score) for r in rows] == [(1.0, "Bad & slow", 15), (2.0, "Crashes often", 5)]


def test_files(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"post_id": "1", "title": "t", "top_comments": ["a", " "]}\n\n{"title": "no id"}\n')
    (p,) = posts.read_posts(spark, str(tmp_path / "p.jsonl")).collect()
    assert (p.source, p.body, p.top_comments) == ("reddit", "", ["a"])
    label = {"post_id": "1", "is_pain": True, "is_monetizable": False, "post_type": "advice_thread", "is_current_opportunity": True, "first_handness": "unknown", "buyer_authority": "ic", "reference_now_ts": 5}
    (tmp_path / "l.jsonl").write_text(json.dumps(label) + "\n")
    assert posts.read_labels(spark, str(tmp_path / "l.jsonl")).first().evidence_quality == "none"
    (tmp_path / "m.jsonl").write_text(json.dumps(label | {"post_type": "odd"}) + "\n")
    with pytest.raises(Exception, match="unknown post_type"):
        posts.read_labels(spark, str(tmp_path / "m.jsonl")).collect()
    (tmp_path / "d.jsonl").write_text(2 * (json.dumps(label) + "\n"))
    with pytest.raises(ValueError, match="more than once"):
        posts.read_labels(spark, str(tmp_path / "d.jsonl"))
    sinks.write_csv(spark.createDataFrame([("=x", 1.0)], "c string, d double"), str(tmp_path / "csv"))
    assert "'=x" in "".join(x.read_text() for x in (tmp_path / "csv").glob("*.csv"))
    sinks.write_json(spark.createDataFrame([("a", float("nan"))], "c string, d double"), str(tmp_path / "json"))
    assert '"d":null' in "".join(x.read_text() for x in (tmp_path / "json").glob("*.json"))


def test_reports(spark, tmp_path):
    at = str(tmp_path / "r.json")
    for n in (1, 2):
        sinks.write_report(spark, {"b": [1.5, None], "a": n}, at)
    assert json.loads(open(at).read()) == {"a": 2, "b": [1.5, None]} and not os.path.exists(at + ".tmp")
    with pytest.raises(ValueError, match="finite"):
        sinks.write_report(spark, {"a": [float("nan")]}, at)


def test_comments_plan_and_schema(spark):
    p = spark.createDataFrame([("1",), ("2",)], "post_id string")
    c = spark.createDataFrame([("1", 5, "x"), ("1", 9, "y"), ("1", 5, "a")], "post_id string, score int, body string")
    assert {r.post_id: r.top_comments for r in posts.with_top_comments(p, c, 2).collect()} == {"1": ["y", "a"], "2": []}
    assert posts.fetch_plan(["a", "a", " "], ["q"], 150) == [("feed", "a", 75), ("search", "q", 75)]
    from pyspark.sql import types as T

    df = tables.ensure_schema(p, T.StructType([T.StructField("post_id", T.LongType()), T.StructField("n", T.IntegerType())]), {"n": 3})
    assert [tuple(r) for r in df.collect()] == [(1, 3), (2, 3)]


def test_streams(spark, tmp_path):
    e = spark.sql("select * from values (1L, timestamp'2024-01-01 00:00:00', 1.5D, 'u'), (1L, timestamp'2024-01-01 00:00:00', 1.5D, 'u'), (2L, timestamp'2024-01-01 00:10:00', 2D, 'u'), (3L, timestamp'2024-01-02 00:10:00', 2D, 'v') as t(id, ts, v, user)")
    e.write.parquet(str(tmp_path / "e"))
    read = lambda: streams.read_stream(spark, str(tmp_path / "e"), "ts")
    days = {str(r.day): (r.n, r.total) for r in streams.updated(streams.daily_sums(read(), "ts", "v"), "day", ["n"]).collect()}
    assert days == {"2024-01-01": (3, 5.0), "2024-01-02": (1, 2.0)}
    assert sorted(r.id for r in streams.drained(streams.unique_events(read(), "id", "ts", "9 days").select("id")).collect()) == [1, 2, 3]
    s = {(r.user, r.n) for r in streams.drained(streams.sessions(read(), "user", "ts", late="0 seconds")).collect()}
    assert s == {("u", 3)}  # later events may still reach the last one
    late = spark.read.parquet(str(tmp_path / "e"))
    assert streams.lateness(late, "user", "ts") == "601 seconds" and streams.lateness(late.limit(0), "user", "ts") == "1 seconds"
    store = str(tmp_path / "store")
    streams.apply_batches(read().select("id", "v"), store, lambda old, new: old.unionByName(new).dropDuplicates(["id"]), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(store + "/v=0").count() == 3


def test_statuses_of_a_stream(spark, tmp_path):
    rows = spark.sql("select * from values ('a', 1, 'failed', 'x'), ('a', 2, 'done', 'left'), ('b', 5, 'failed', repeat('y', 2000)) as t(job, at, state, error)")
    old = rows.limit(0)
    one = streams.status_of(old, rows, "job", "at", "state")
    assert {r.job: (r.state, r.error) for r in one.collect()} == {"a": ("done", None), "b": ("failed", "y" * 1000)}


def test_feeds_fall_back(spark, tmp_path):
    child = {"id": "a1", "title": " T ", "selftext": "b", "permalink": "/r/x/1", "score": "7", "created_utc": 1700000000.5, "top_comments": ["c", " "], "author": ""}
    files = {"rich/one": json.dumps([child]), "oauth/one": "{broken", "oauth/two": "{broken", "json/two": json.dumps({"data": {"children": [{"kind": "t3", "data": child | {"id": "b2", "score": "x"}}, {"kind": "t5", "data": child}, {"data": {"id": ""}}]}}), "lines/three": json.dumps(child | {"id": "c3"}) + "\n\n", "json/four": "x" * 999}
    for name, body in files.items():
        at = tmp_path / f"{name}.json"
        at.parent.mkdir(exist_ok=True)
        at.write_text(body)
    landed.register(spark)
    read = lambda **o: spark.read.format("feeds").options(path=str(tmp_path), **o).load()
    got = {r.post_id: (r.title, r.score, r.permalink, r.top_comments, r.author_name) for r in read(feeds="one,two,three,one").collect()}
    assert got == {"reddit:a1": ("T", 7, "https://www.reddit.com/r/x/1", ["c"], None), "reddit:b2": ("T", 0, "https://www.reddit.com/r/x/1", ["c"], None), "reddit:c3": ("T", 7, "https://www.reddit.com/r/x/1", ["c"], None)}
    with pytest.raises(Exception, match="no tier has feed four"):
        read().collect()
    assert read(failWhenEmpty="false").count() == 3 and read(feeds="two", tiers="oauth", failWhenEmpty="false").count() == 0
    assert read(feeds="one", maxBytes="10", failWhenEmpty="false").count() == 0


def test_reviews_caps_and_preview(spark):
    rows = spark.createDataFrame([(0, "a", i, f"r{i}", 1.0) for i in range(4)] + [(1, "b", i, f"s{i}", 2.0) for i in range(4)], "target_no int, target string, position int, body string, rating double")
    assert [(r.target, r.position) for r in landed.capped_reviews(rows, 2, 3).collect()] == [("a", 0), ("a", 1), ("b", 0)]
    assert landed.capped_reviews(rows, 2).count() == 4
    made = landed.review_posts(rows.withColumns({"site": F.lit("s"), "slug": F.lit("t"), "url": F.lit("u"), "score": F.lit(5)})).collect()
    assert len({r.post_id for r in made}) == 8 and all(r.post_id.startswith("review:s:t:") and r.source == "review:s" for r in made)
    good = spark.createDataFrame([("p",)], "post_id string")
    bad = good.withColumn("post_id", F.raise_error(F.lit("down")))
    assert landed.preview({"x": good})[0] == 0 and landed.preview({"x": good, "y": bad})[0] == 1 and landed.preview({"y": bad, "z": good.limit(0)})[0] == 2 and landed.preview({})[0] == 2
    code, found = landed.preview({"x": good, "y": bad})
    assert found["x"]["first"] == [{"post_id": "p"}] and found["y"]["count"] == 0 and "error" in found["y"]


def test_health(spark, tmp_path):
    df = spark.createDataFrame([("", 1), ("m", 2)], "model string, id int")
    df.write.parquet(str(tmp_path / "t"))
    got = landed.health(spark, {str(tmp_path / "t"): ["model"], str(tmp_path / "no"): []}, {"blank": F.col("model") == "", "negative": F.col("id") < 0}, df)
    assert list(got.values()) == [True, False, False, True]


def test_scratch_tables_are_deleted(spark, tmp_path):
    one = tables.written(spark.range(3).toDF("x"), "one")
    assert one.count() == 3
    at = tables.scratch_dir(spark).removeprefix("file://")
    assert os.listdir(at)
    tables.drop_scratch()
    assert not os.path.exists(at)


def test_entry_without_llm(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
