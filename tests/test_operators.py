import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalloom.functions import columns as C
from signalloom.functions.udfs import bag_vector, match_form, review_id
from signalloom.operators import answers as A
from signalloom.plans import analysis
from signalloom.operators import clusters, enrich, evaluation, evidence, features, graph, similarity, store, trends, usage, views


def brute_components(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


def brute_greedy(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = {}
    for x in sorted(near):
        if x not in out:
            out[x] = x
            for y in near[x]:
                if y > x and y not in out:
                    out[y] = x
    return out


@pytest.mark.parametrize("seed", range(4))
def test_graphs(spark, seed):
    r = random.Random(seed)
    edges = list({tuple(sorted(r.sample(range(40), 2))) for _ in range(30)})
    df = spark.createDataFrame(edges + edges[:3], "a long, b long")
    assert {x.node: x.component for x in graph.components(df).collect()} == brute_components(edges)
    assert {x.node: x.survivor for x in graph.greedy_merge(df).collect()} == brute_greedy(edges)


def test_long_path_and_empty_graph(spark):
    path = [(i, i + 1) for i in range(60)]
    assert {x.component for x in graph.components(spark.createDataFrame(path, "a long, b long")).collect()} == {0}
    empty = spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")
    assert graph.components(empty).count() == 0
    assert graph.greedy_merge(empty).count() == 0
    edges = spark.createDataFrame(path + [(100, 130), (100, 120), (120, 130), (130, 140)], "a long, b long")
    assert {x.node: x.survivor for x in graph.greedy_merge(edges).collect()} == brute_greedy([tuple(r) for r in edges.collect()])


def test_similarity_is_exact(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(120, 8))
    rows = [(i, v[i].tolist(), i % 3) for i in range(120)] + [(200, [0.0] * 8, 1), (201, None, 1), (None, [1.0] * 8, 1)]
    df = spark.createDataFrame(rows, "id long, v array<double>, g int")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if s[i, j] >= 0.6}
    assert {(r.a, r.b) for r in similarity.similar_pairs(df, "id", "v", 0.6, blocks=3).collect()} == want
    cross = {(i, j) for i, j in want if i % 3 != j % 3}
    assert {(r.a, r.b) for r in similarity.similar_pairs(df, "id", "v", 0.6, group_col="g", blocks=3).collect()} == cross
    best = similarity.best_matches(df.where("id < 40"), df, "id", "v", 0.3, group_col="g", block=16).collect()
    for r in best:
        allowed = [j for j in range(120) if j % 3 != r.id % 3]
        assert r.match_id == max(allowed, key=lambda j: (s[r.id, j], -j))
    assert len(best) == sum(max(s[i, j] for j in range(120) if j % 3 != i % 3) >= 0.3 for i in range(40))


def test_evidence(spark):
    rows = [("p1", "Exports fail", "The CSV is broken. Ｗｅ pay daily!", ["broken.", "we pay   daily", "never said", " ", None, "here broken it"], ["Same here, broken", "It is"]), ("p2", None, None, [], [])]
    df = spark.createDataFrame(rows, "post_id string, title string, body string, q array<string>, c array<string>")
    got = {r.position: (r.match_type, r.source, r.confidence) for r in evidence.verify_quotes(df, "q", "c").collect()}
    assert got == {0: ("exact", "body", 1.0), 1: ("fuzzy", "body", 0.9), 2: ("none", "", 0.0), 3: ("none", "", 0.0), 5: ("none", "", 0.0)}


def test_features(spark):
    rows = [("Can't export", "I hate this. How do I fix the jira sync daily?"), (None, None), ("Best xbox game", "fun"), ("jira vs asana", "compare")]
    t = features.post_text()
    df = spark.createDataFrame(rows, "title string, body string").withColumn("t", t)
    out = df.select(features.keyword_score(F.col("t")).alias("k"), features.keyword_category(F.col("t")).alias("c"), features.consumer_noise(F.col("t")).alias("n"), features.evidence_spans(C.text("title"), C.text("body")).alias("s")).collect()
    assert [r.k for r in out] == [3, 0, 0, 0]
    assert [r.c for r in out] == ["complaint", "wish", "wish", "wish"]
    assert [r.n for r in out] == [False, False, True, False]
    assert out[0].s[0] == "Can't export" and out[1].s == []


def test_columns(spark):
    df = spark.createDataFrame([(' ["A", " b ", "a", ""] ', "=1+1", "http://10.0.0.1/x", "https://shop.example/x"), ("{", "x", "http://localhost", "ftp://a.b"), (None, None, None, None)], "j string, c string, u string, w string")
    out = df.select(C.tags(C.json_list("j")).alias("t"), C.escaped_cell(F.col("c")).alias("c"), C.public_url(F.col("u")).alias("u"), C.public_url(F.col("w")).alias("w")).collect()
    assert [r.t for r in out] == [["a", "b"], [], []]
    assert [r.c for r in out] == ["'=1+1", "x", None]
    assert [r.u for r in out] == [False, False, False] and [r.w for r in out] == [True, False, False]
    v = spark.range(1).select(C.unit(F.array(F.lit(3.0), F.lit(4.0))).alias("u"), C.unit(F.array(F.lit(0.0))).alias("z"), C.without_markup(F.lit("<b>a&amp;b</b>\n c")).alias("m")).first()
    assert v.u == [0.6, 0.8] and v.z is None and v.m == "a&b c"


def test_udfs():
    assert match_form("Ｈｅｌｌｏ,  Wörld!") == "hello wörld" and match_form(None) is None
    v = bag_vector("Alpha beta alpha")
    assert len(v) == 96 and abs(sum(x * x for x in v) - 1) < 1e-12 and bag_vector(None) == [0.0] * 96


def test_store(spark):
    schema = "post_id string, severity string, author_name string, triage_status string, deep_dive_status string, cross_source_count long"
    old = spark.createDataFrame([("a", "low", "ann", "favorite", "completed", 3), ("b", "low", None, "new", "queued", 1)], schema)
    new = spark.createDataFrame([("a", "high", None, "new", "running", 9), ("c", "high", "cy", "new", "queued", 1)], schema)
    got = {r.post_id: tuple(r)[1:] for r in store.upsert(old, new).collect()}
    assert got == {"a": ("high", "ann", "favorite", "completed", 3), "b": ("low", None, "new", "queued", 1), "c": ("high", "cy", "new", "queued", 1)}
    pairs = spark.createDataFrame([("b", "a"), ("b", "a"), ("b", "zz")], "canonical_id string, duplicate_id string")
    got = {r.post_id: (r.triage_status, r.cross_source_count) for r in store.merge_duplicates(old, pairs).collect()}
    assert got == {"a": ("merged", 3), "b": ("favorite", 3)}  # an unknown duplicate counts too
    kids = spark.createDataFrame([("a", "x"), ("b", "y")], "post_id string, tag string")
    repl = spark.createDataFrame([("a", "z"), ("a", "z")], "post_id string, tag string")
    assert {tuple(r) for r in store.replace_children(kids, repl, "post_id").collect()} == {("a", "z"), ("b", "y")}


def test_usage_counts_deliveries_once(spark):
    u = spark.sql("select * from values (1L, 0.6D, timestamp_ntz'2024-01-01 01:00:00'), (1L, 0.6D, timestamp_ntz'2024-01-01 02:00:00'), (2L, 0.5D, timestamp_ntz'2024-01-01 01:30:00'), (3L, null, timestamp_ntz'2024-01-02 00:00:00') as t(id, cost_usd, created_at)")
    assert [tuple(r)[1:] for r in usage.daily_spend(u).orderBy("day").collect()] == [(2, 1.1), (1, 0.0)]
    assert [(r.id, r.spent) for r in usage.crossings(u, 1.0).collect()] == [(2, 1.1)]


def test_views_on_empty_tables(spark):
    empty = spark.createDataFrame([], "g string, v string, triage_status string")
    assert views.top_counts(views.active(empty), "v", 3).count() == 0
    assert trends.top_of_group(empty, "g", "v", 3, "vs").count() == 0


def test_enrichers(spark):
    posts = spark.createDataFrame([("a", "Jira is broken", "we hate it daily"), ("b", "Best xbox", None), ("c", None, None)], "post_id string, title string, body string")
    good = '{"category": "wish", "severity": "high", "summary": "s", "is_monetizable": false, "pain_level": 4, "willingness_to_pay": 9, "niche_category": "n", "competitor_tags": [" Jira ", "jira"]}'
    answers = spark.createDataFrame([("a", f"```json\n{good}\n```"), ("a", "{"), ("b", good.replace("wish", "odd")), ("c", good.replace("9", "99"))], "post_id string, payload string")
    got = {r.post_id: r for r in enrich.classified(posts, answers).collect()}
    assert (got["a"].analysis_mode, got["a"].category, got["a"].willingness_to_pay, got["a"].competitor_tags, got["a"].fallback_reason) == ("primary", "wish", 3, ["jira"], "structured_missing")
    assert got["b"].analysis_mode == got["c"].analysis_mode == "keyword" and got["b"].pain_level == 0 and got["c"].category == "wish" and got["b"].fallback_reason == "structured_missing,primary_missing,legacy_missing"
    plain = {r.post_id: (r.analysis_mode, r.fallback_reason) for r in enrich.classified(posts).collect()}
    assert set(plain.values()) == {("keyword", None)}
    older = answers.withColumn("operation", F.lit("legacy"))
    assert enrich.classified(posts, older, mode="b2b").where("analysis_mode <> 'keyword'").count() == 0
    modes = {r.post_id: (r.analysis_mode, r.category, r.pain_level, r.post_type) for r in enrich.classified(posts, older, mode="legacy").collect()}
    assert modes["a"][:2] == ("legacy", "wish") and modes["a"][2] > 4 and modes["c"] == ("legacy", "wish", 4, "advice_thread")
    cache = spark.createDataFrame([("k", "1"), ("k", "2"), (None, "3")], "cache_key string, response_json string")
    assert [r.response_json for r in enrich.with_cached(posts, cache, F.when(F.col("post_id") == "a", F.lit("k"))).orderBy("post_id").collect()] == ["2", None, None]
    dives = spark.createDataFrame([("a", "deep")], "post_id string, deep_dive_summary string")
    clusters = spark.createDataFrame([("a", "old", 1), ("a", "new", 2)], "post_id string, label string, created_at int")
    ctx = {r.post_id: r.context for r in enrich.with_context(posts.withColumn("summary", F.lit("sum")), dives, clusters).collect()}
    assert ctx["a"] == "Title: Jira is broken\nSummary: sum\nDeep dive: deep\nTrend: new" and ctx["c"] == "Summary: sum"


def test_answer_contracts(spark):
    base = {"category": "complaint", "severity": "low", "summary": " s ", "is_monetizable": False, "pain_level": 3, "willingness_to_pay": 9, "niche_category": " n ", "competitor_tags": [" Jira ", ""], "evidence_spans": ["a" * 200, " ", "b", "c", "d"]}
    bad = [{"pain_level": True}, {"pain_level": 3.5}, {"pain_level": 11}, {"summary": " "}, {"summary": 3}, {"category": "odd"}, {"competitor_tags": [1]}, {"competitor_tags": "x"}, {"evidence_spans": None}, {"post_type": "odd"}, {"is_monetizable": 1}, {"niche_category": None}]
    rows = [json.dumps(base), "```json\n" + json.dumps(base) + "\n```"] + [json.dumps(base | x) for x in bad] + ["{", "[]", "3", None, "", json.dumps(base) + "{}", json.dumps(base) + "," + json.dumps(base)]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, p string")
    got = [r.a for r in df.select("i", A.primary(F.col("p")).alias("a")).orderBy("i").collect()]
    assert got[0] == got[1] and got[0].willingness_to_pay == 3 and got[0].competitor_tags == ["jira"] and got[0].post_type == "first_person_pain"
    assert got[0].evidence_spans == ["a" * 160, "b", "c"] and got[0].summary == "s" and got[0].niche_category == "n"
    assert got[2:] == [None] * (len(rows) - 2)
    tolerant = [r.a for r in df.select("i", A.legacy(F.col("p")).alias("a")).orderBy("i").collect()]
    assert [x is not None for x in tolerant[2:14]] == [True, True, True, False, False, False, True, True, True, False, True, True] and tolerant[8].competitor_tags == []
    others = [
        ("deep_dive", {"workarounds": ["x", " "], "competitors": [], "feature_wishlist": [], "buying_signals": [], "icp_hypothesis": "i", "actionable_summary": "a"}, [{"workarounds": None}, {"competitors": [1]}, {"icp_hypothesis": ""}]),
        ("cluster_label", {"label": "l", "summary": "s", "estimated_monetization_signal": "high", "key_complaints": ["k"]}, [{"label": ""}, {"estimated_monetization_signal": "huge"}, {"key_complaints": "k"}]),
        ("gtm", {"name_options": ["a", "b", "c"], "hero_h1": "h", "hero_h2": "h", "mvp_features": ["a", "b", "c"], "pricing_tier": "p", "positioning_rationale": "r"}, [{"name_options": ["a", "b"]}, {"mvp_features": ["a", "b", " "]}, {"hero_h2": None}]),
        ("structured", {k: v for k, v in base.items() if k != "evidence_spans"}, [{"severity": "odd"}, {"willingness_to_pay": "3"}]),
    ]
    for name, ok, wrong in others:
        df = spark.createDataFrame([(json.dumps(x),) for x in [ok] + [ok | w for w in wrong]], "p string")
        assert [r[0] is not None for r in df.select(A.SHAPES[name](F.col("p"))).collect()] == [True] + [False] * len(wrong), name
    usage_rows = spark.createDataFrame([(1, '{"usage": {"prompt_tokens": 5, "completion_tokens": -2}}'), (2, '{"usage": 3}'), (3, "{"), (4, None)], "id int, response_json string")
    assert [tuple(r) for r in A.usage_events(usage_rows).collect()] == [(1, 5, 0)]
    tiers = spark.createDataFrame([(None, "b"), ("a", "b"), (None, None)], "x string, y string")
    answer, mode, reason = A.first_valid([("x", F.col("x")), ("y", F.col("y"))])
    assert [tuple(r) for r in tiers.select(answer, mode, reason).collect()] == [("b", "y", "x_invalid"), ("a", "x", None), (None, None, "x_invalid,y_invalid")]


def test_store_updates(spark):
    rows = spark.createDataFrame([("a", "new", "queued", None, None, "[]", 1), ("b", "favorite", "completed", "told", None, None, None), ("c", "merged", "failed", None, "[1.0]", "[]", 1)], "post_id string, triage_status string, deep_dive_status string, deep_dive_summary string, emb_vector string, cross_source_ids string, cross_source_count long")
    pairs = spark.createDataFrame([("a", "b", "[0.5]"), ("a", "b", "[0.5]"), ("zz", "c", "[1]"), ("a", "a", "[1]")], "canonical_id string, duplicate_id string, emb_vector string")
    one = store.merge_duplicates(rows, pairs)
    got = {r.post_id: tuple(r)[1:] for r in one.collect()}
    assert got == {"a": ("favorite", "completed", "told", None, '["b"]', 2), "b": ("merged", "completed", "told", "[0.5]", None, 1), "c": ("merged", "failed", None, "[1.0]", "[]", 1)}
    assert {r.post_id: tuple(r)[1:] for r in store.merge_duplicates(one, pairs).collect()}["a"][-1] == 2
    say = lambda *x: spark.createDataFrame(list(x), "post_id string, triage_status string")
    assert {r.post_id: r.triage_status for r in store.set_triage(rows, say(("a", "discarded"), ("q", "new"))).collect()} == {"a": "discarded", "b": "favorite", "c": "merged"}
    with pytest.raises(Exception, match="unsupported triage_status"):
        store.set_triage(rows, say(("a", "odd"))).collect()
    dives = spark.createDataFrame([("a", "failed", None, "boom"), ("b", "completed", "new", "boom"), ("c", "running", "", None)], "post_id string, deep_dive_status string, summary string, error string")
    assert {r.post_id: (r.deep_dive_status, r.deep_dive_summary) for r in store.set_deep_dive(rows, dives).collect()} == {"a": ("failed", "Deep dive error: boom"), "b": ("completed", "new"), "c": ("running", None)}
    vectors = spark.createDataFrame([("a", [1.0, 0.0])], "post_id string, vector array<double>")
    stored = store.set_vectors(rows, vectors)
    assert {r.post_id: r.emb_vector for r in stored.collect()} == {"a": "[1.0,0.0]", "b": None, "c": "[1.0]"}
    assert [r.post_id for r in store.without_vector(stored).collect()] == ["b"] and [r.post_id for r in store.with_vector(stored).collect()] == ["a"]
    with pytest.raises(Exception, match="isn't finite"):
        store.set_vectors(rows, spark.createDataFrame([("a", [float("nan")])], "post_id string, vector array<double>")).collect()
    good, bad = store.readable_answers(spark.createDataFrame([("{}",), ("[]",), ("{",), (None,), ("{}{}",)], "response_json string"))
    assert good.count() == 1 and bad.count() == 4
    said = spark.createDataFrame([(" Useful ",), ("odd",)], "feedback_value string")
    assert [r[0] for r in store.checked_feedback(said, ("useful",), strict=False).collect()] == ["useful"]
    with pytest.raises(Exception, match="unsupported feedback_value"):
        store.checked_feedback(said, ("useful",)).collect()
    runs = spark.createDataFrame([("j", 1, "x" * 2000), ("j", 2, None), ("k", 1, None), ("k", 3, "y" * 2000)], "job_name string, at int, error string")
    old = spark.createDataFrame([("j", 0, 0, "old"), ("m", 5, None, "kept")], "job_name string, last_run int, last_success int, last_error string")
    assert {r.job_name: (r.last_run, r.last_success, r.last_error) for r in store.status_after(old, runs).collect()} == {"j": (2, 2, None), "k": (3, 1, "y" * 1000), "m": (5, None, "kept")}


def test_cluster_run(spark, tmp_path):
    stamp = "timestamp_ntz'2026-04-01 00:00:00'"
    line = lambda i, t, w, s="new", b="current_opportunity": f"({i}L, 'p{i}', '{t}', 'sum', null, '[\"quickbooks\",\"Jira\"]', '{s}', {stamp}, {50 - i}.0D, {w}, 5, '{b}', 0.8D, 1700000000L)"
    rows = [line(1, "invoice export broken again", 9), line(2, "invoice export broken", 9, "favorite", "evergreen_pain"), line(3, "quantum gardening", 1), line(4, "totally unrelated zebra topic", 9), line(5, "invoice export broken", 9, "merged")]
    names = "id, post_id, title, summary, deep_dive_summary, competitor_tags, triage_status, created_at, opportunity_score, willingness_to_pay, pain_level, opportunity_bucket, buyer_authority_score, source_created_ts"
    df = spark.sql(f"select * from values {', '.join(rows)} as t({names})")
    counts, heads, members = clusters.run(df, "2026-04-21 00:00:00", 30, threshold=0.6, min_size=2)
    assert tuple(counts.first()) == (30, 3, 1)
    (h,) = heads.collect()
    assert (h.item_count, h.aggregate_wtp, h.fresh_post_count, h.evergreen_post_count, h.incumbents, h.signal) == (2, 18.0, 1, 1, ["jira", "quickbooks"], "high")
    assert h.canonical_key == "broken-export-invoice" and h.label == "Broken Export Invoice" and h.summary.startswith("2 related pain posts") and h.avg_opportunity_score == 48.5
    near = {r.post_id: r.similarity for r in members.collect()}
    assert set(near) == {"p1", "p2"} and all(0.5 < x <= 1 for x in near.values())
    clusters.save(str(tmp_path / "s"), 7, "2026-04-21 00:00:00", counts, heads, members)
    assert spark.read.parquet(str(tmp_path / "s/headers")).first().run_id == 7
    none = clusters.run(df.limit(0), "2026-04-21 00:00:00", 30)
    assert tuple(none[0].first()) == (30, 0, 0) and none[1].count() == none[2].count() == 0
    labels = spark.createDataFrame([(h.cluster, "Zebra", "given", "low", ["quagga"]), (99, "Trend Detected", "s", "low", [])], "cluster long, label string, summary string, signal string, key_complaints array<string>")
    (g,) = clusters.run(df, "2026-04-21 00:00:00", 30, threshold=0.6, min_size=2, labels=labels)[1].collect()
    assert (g.label, g.summary, g.signal) == ("Zebra", "given", "low") and g.canonical_key.startswith("quagga-zebra")


def test_places_and_names(spark):
    df = spark.range(500).selectExpr("id", "id % 7 k")
    got = {r.id: r.place for r in views.with_place(df, [F.col("k").desc(), F.col("id").asc()], "place").collect()}
    want = sorted(range(500), key=lambda i: (-(i % 7), i))
    assert [got[i] for i in want] == list(range(500))
    assert views.with_place(df.limit(0), [F.col("id").asc()], "place").count() == 0
    assert [r.id for r in views.page(df, [F.col("id").asc()], 2, 5).collect()] == [10, 11, 12, 13, 14]
    names = spark.createDataFrame([("../a b/c",), ("",), (None,), ("..-_",), ("ok",)], "n string")
    assert [r[0] for r in names.select(views.artifact_stem(F.col("n"))).collect()] == ["a_b_c", "scope", "scope", "scope", "ok"]
    assert [len(r[0]) for r in spark.range(1).select(views.worksheet_name(F.lit("p"), F.lit("x" * 300))).collect()] == [100]


def test_evaluation_checks(spark):
    posts = spark.createDataFrame([("a",), ("b",)], "post_id string")
    label = spark.createDataFrame([("a", 5), ("b", 5)], "post_id string, reference_now_ts long")
    assert evaluation.checked(label, posts, posts).count() == 2
    for bad in ((label.unionAll(label), posts), (spark.createDataFrame([("z", 5)], label.schema), posts), (spark.createDataFrame([("a", 5), ("b", 6)], label.schema), posts), (label, posts.unionAll(posts))):
        with pytest.raises(ValueError):
            evaluation.checked(bad[0], bad[1], posts)
    s = spark.range(1).select(evaluation.calibration_score(F.expr("map('intensity', 2.0D, 'wtp', double('NaN'), 'other', 1.0D)"), F.expr("map('x', 0.05D, 'y', -3.0D)")).alias("s"), evaluation.calibration_score(F.lit(None).cast("map<string,double>"), F.lit(None).cast("map<string,double>")).alias("n")).first()
    assert (s.s, s.n) == (13.0, 0.0)
    assert evaluation.contract(label.withColumn("cluster_useful", F.lit(True)))["cluster_useful"]["useful_rate"] == 1.0


def test_quotes_and_buyers(spark):
    rows = spark.createDataFrame([("g", 1, "Manager", "we pay", ["We pay $5", "we PAY $5", "budget is set"], " why "), ("g", 2, "owner", None, ["paid twice", "licence fee"], "Why"), ("h", 3, None, None, [], None)], "g string, id int, buyer_authority string, body string, q array<string>, r string")
    ev = F.transform("q", lambda x: F.struct(x.alias("quote"), F.lit("exact").alias("match_type")))
    got = {r.g: (r.wtp_quotes, r.uncertainties) for r in trends.buyer_words(rows, "g", ev, F.col("r")).collect()}
    assert got == {"g": (["We pay $5", "budget is set", "paid twice"], ["why"]), "h": ([], [])}
    assert [(r.role, r.n, r.place) for r in trends.buyer_roles(rows, "g").orderBy("place").collect()] == [("manager", 1, 1), ("owner", 1, 2)]
    assert review_id("s", "t", " HTTP://X ", 1.0, "Bad  App") == review_id("s", "t", "http://x", 1.0, "bad app") != review_id("s", "t", "http://x", 2.0, "bad app")


def test_a_run_from_end_to_end(spark):
    posts = spark.createDataFrame([("a", "Jira export is broken", "We hate the manual csv export daily. We would pay.", ["same here", "book a demo http://x.y"], 1776000000), ("b", "Nothing", None, [], None), ("c", "Jira sync fails", "my team is stuck", None, 1700000000), ("k", "Jira broken", "known", [], 1)], "post_id string, title string, body string, top_comments array<string>, source_created_ts long")
    posts = posts.withColumns({"source": F.lit("reddit"), "top_comments": F.coalesce("top_comments", F.array().cast("array<string>"))})
    signals, counts = analysis.run(posts, posts.where("post_id = 'k'").select("post_id"), 1776729600)
    assert counts.first().asDict() == {"dropped": 1, "kept": 2, "capped": 0, "known": 1}
    got = {r.post_id: r for r in signals.collect()}
    assert set(got) == {"a", "c"} and got["a"].analysis_mode == "keyword" and got["a"].opportunity_bucket == "current_opportunity" and got["c"].opportunity_bucket == "evergreen_pain"
    made = json.loads(got["a"].score_components_json)
    assert made["opportunity_score"] == got["a"].opportunity_score > 0 and made["verified_evidence_count"] == made["exact_evidence_count"] == len(json.loads(got["a"].evidence_spans_json)) > 0 and made["comment_same_here_count"] == 1
    assert analysis.run(posts, posts.limit(0).select("post_id"), 1776729600, most=1)[1].first().asDict() == {"dropped": 1, "kept": 1, "capped": 2, "known": 0}
    assert analysis.run(posts.limit(0), posts.select("post_id"), 1776729600)[0].count() == 0


def test_stored_form(spark):
    rows = spark.createDataFrame([(1, "odd", None, json.dumps(["x" * 200, " ", "b", "c", "d"]), '["A", "a", "B "]', 1.0), (2, "new", "evergreen_pain", None, None, None)], "id int, triage_status string, opportunity_bucket string, evidence_spans_json string, competitor_tags string, opportunity_score double")
    got = {r.id: tuple(r)[1:] for r in store.stored_form(rows).collect()}
    assert got == {1: ("new", "unknown_age", json.dumps(["x" * 160, "b", "c"], separators=(",", ":")), '["a","b"]', 1.0), 2: ("new", "evergreen_pain", None, None, None)}
    with pytest.raises(Exception, match="opportunity_score must be finite"):
        store.stored_form(rows.withColumn("opportunity_score", F.lit(float("inf")))).collect()
