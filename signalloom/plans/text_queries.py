"""Queries on what texts say, with the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import lexicons as L
from ..functions import columns as C
from ..functions.udfs import bag_vector_udf
from ..operators import enrich, evidence, features, scoring
from ..sources.tables import spread, table

#: The time that ages are reckoned from, in epoch seconds.
AS_OF = 1_776_729_600


def _any(t: str, terms) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(t, x.replace("'", "''")) for x in terms) + ")"


def _hits(t: str, terms) -> str:
    return "(" + " + ".join("CAST(contains({}, '{}') AS INTEGER)".format(t, x.replace("'", "''")) for x in terms) + ")"


_POST = "lower(concat(coalesce(title, ''), ' ', coalesce(body, '')))"
_LIST = "CASE WHEN json_valid({0}) AND json_type({0}) = 'ARRAY' THEN list_filter(from_json({0}, '[\"VARCHAR\"]'), lambda x: x IS NOT NULL) ELSE [] END"
_TRIM = r"regexp_replace({0}, '^[\s\p{{Z}}\x{{85}}]+|[\s\p{{Z}}\x{{85}}]+$', '', 'g')"
_COMMENTS = f"list_filter(list_transform({_LIST.format('comment_sample_json')}, lambda x: {_TRIM.format('x')}), lambda x: x <> '')"
_CATEGORY = f"CASE WHEN {_any('t', L.COMPLAINT)} THEN 'complaint' WHEN {_any('t', L.UNSOLVED)} THEN 'unsolved' ELSE 'wish' END"
_KEYWORD = f"least(3, 2 * CAST({_any('t', L.COMPLAINT)} AS INTEGER) + CAST({_any('t', L.UNSOLVED)} AS INTEGER) + CAST({_any('t', L.WISH)} AS INTEGER))"
_TYPE = f"""CASE WHEN {_any('t', L.COMPARISON)} THEN 'tool_comparison' WHEN {_any('t', L.PITCH)} THEN 'founder_pitch' WHEN {_any('t', L.NEWS)} THEN 'news_analysis'
    WHEN category = 'complaint' AND {_any('t', L.COMPETITORS)} THEN 'vendor_rant' WHEN category = 'unsolved' THEN 'solution_request'
    WHEN category = 'complaint' THEN 'first_person_pain' ELSE 'advice_thread' END"""
_HANDNESS = f"""CASE WHEN kind = 'news_analysis' THEN 'speculative' WHEN {_any("concat(' ', t, ' ')", L.AGGREGATED)} THEN 'aggregated' WHEN {_any("concat(' ', t, ' ')", L.SECOND_HAND)} THEN 'second_hand'
    WHEN {_any("concat(' ', t, ' ')", L.FIRST_HAND)} THEN 'first_hand' WHEN {_any("concat(' ', t, ' ')", L.HEARSAY)} THEN 'aggregated' ELSE 'unknown' END"""
_AUTHORITY = "CASE " + " ".join(f"WHEN {_any('t', terms)} THEN '{name}'" for name, terms in L.AUTHORITY) + " ELSE 'unknown' END"
_BASE = f"""base AS (SELECT *, {_HANDNESS} AS handness FROM (SELECT *, {_TYPE} AS kind FROM (SELECT *, {_CATEGORY} AS category_now, {_CATEGORY} AS category
    FROM (SELECT id, post_id, {_POST} AS t, {_COMMENTS} AS comments FROM pain_points))))"""


def _posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(table(spark, sf_dir, "pain_points", "id", "post_id", "title", "body", "comment_sample_json"))
    rows = rows.select("id", "post_id", features.post_text().alias("t"), C.filled(C.json_list("comment_sample_json")).alias("comments"))
    rows = rows.withColumn("category", features.keyword_category(F.col("t")))
    rows = rows.withColumn("kind", features.post_type(F.col("t"), F.col("category")))
    return rows.withColumn("handness", features.first_handness(F.col("t"), F.col("kind")))


def keyword_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("t")
    return _posts(spark, sf_dir).select("id", features.keyword_score(t).alias("keyword_score"), "category", features.consumer_noise(t).alias("consumer_noise"))


def post_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _posts(spark, sf_dir).select("id", F.col("kind").alias("post_type"), F.col("handness").alias("first_handness"), features.buyer_authority(F.col("t")).alias("buyer_authority"), F.array_join(features.competitor_hints(F.col("t")), ",").alias("hints"))


def prescreen_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prescreen's score of each post, and whether it is enough."""
    scored = _posts(spark, sf_dir).select("id", features.prescreen_score(F.col("t"), F.col("comments"), F.col("handness")).alias("score"))
    return scored.withColumn("kept", F.col("score") >= 2)


def prescreen_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 posts of the highest score, earlier ids first."""
    # filtered after the limit, which takes the best first anyway: before it, every score would be made twice
    return prescreen_rank(spark, sf_dir).orderBy(F.col("score").desc(), "id").limit(100).where("kept").select("id", "score")


def comment_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(table(spark, sf_dir, "pain_points", "id", "comment_sample_json"))
    out = features.comment_signals(rows, C.json_list("comment_sample_json"), F.array().cast("array<string>"))
    return out.select("id", "consensus_n", "same_here_n", "workaround_n", F.array_join("tool_mentions", ",").alias("tools"), "shill_risk", F.size("comment_sample").alias("sample_n"))


def evidence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(table(spark, sf_dir, "pain_points", "id", "title", "body"))
    return rows.select("id", F.array_join(features.evidence_spans(C.text("title"), C.text("body")), "|").alias("spans"))


def text_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(table(spark, sf_dir, "pain_points", "id", "title", "body", "comment_sample_json", "post_type", "pain_level", "willingness_to_pay", "comment_workaround_count"))
    rows = rows.withColumn("t", features.thread_text(C.filled(C.json_list("comment_sample_json"))))
    t, zero = F.col("t"), F.lit(0)
    return rows.select("id", F.round(features.workflow_frequency(t, C.text("post_type")), 3).alias("frequency"), F.round(features.impact(t, F.coalesce("pain_level", zero), F.coalesce("willingness_to_pay", zero)), 3).alias("impact"), F.round(features.solved_penalty(t, F.coalesce("comment_workaround_count", zero)), 3).alias("solved"))


def evidence_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(table(spark, sf_dir, "pain_points", "post_id", "title", "body", "evidence_spans_json", "comment_sample_json"))
    rows = rows.withColumns({"q": C.json_list("evidence_spans_json"), "c": C.json_list("comment_sample_json")})
    found = evidence.verify_quotes(rows, "q", "c", fuzzy=False)
    return found.select("post_id", F.col("position").cast("long").alias("position"), "match_type", "source")


def evidence_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(table(spark, sf_dir, "pain_points", "post_id", "title", "body", "evidence_spans_json", "comment_sample_json"))
    rows = rows.withColumns({"q": C.json_list("evidence_spans_json"), "c": C.json_list("comment_sample_json")})
    return evidence.verify_quotes(rows, "q", "c")


def opportunity_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    posted = F.col("source_created_ts")
    score, penalty = scoring.recency(posted, AS_OF)
    rows = table(spark, sf_dir, "pain_points", "id", "source_created_ts")
    return rows.select("id", scoring.opportunity_bucket(posted, AS_OF).alias("bucket"), F.round(score, 3).alias("recency"), F.round(penalty, 3).alias("stale"))


def _score_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, Column]]:
    c = ("id", "pain_level", "willingness_to_pay", "buyer_authority", "first_handness", "post_type", "source_created_ts", "workflow_frequency_score", "impact_score", "solved_penalty", "comment_shill_risk", "comment_consensus_count", "comment_workaround_count", "competitor_tags", "comment_tool_mentions_json", "evidence_spans_json", "is_monetizable")
    rows = table(spark, sf_dir, "pain_points", *c)
    num = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("double")
    fresh, stale = scoring.recency(F.col("source_created_ts"), AS_OF)
    ev = scoring.evidence_score(F.size(C.json_list("evidence_spans_json")).cast("double"))
    kind = C.text("post_type")
    return rows, {
        "pain": num("pain_level") / 10, "wtp": num("willingness_to_pay") / 10, "authority": C.lookup(F.col("buyer_authority"), L.AUTHORITY_SCORES, "unknown"), "handness": C.lookup(F.col("first_handness"), L.HANDNESS_SCORES, "unknown"),
        "frequency": num("workflow_frequency_score"), "impact": num("impact_score"), "consensus": scoring.consensus_score(num("comment_consensus_count"), ev),
        "incumbent": scoring.incumbent_failure_score(F.size(C.json_list("competitor_tags")), F.size(C.json_list("comment_tool_mentions_json")), num("comment_workaround_count"), kind),
        "recency": fresh, "evidence": ev, "stale": stale, "solved": num("solved_penalty"), "shill": num("comment_shill_risk"), "type": scoring.type_penalty(kind, C.text("first_handness")),
    }


def opportunity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, parts = _score_parts(spark, sf_dir)
    return rows.select("id", F.round(scoring.opportunity_score(parts), 2).alias("score"))


def score_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each score is made of; signals that aren't monetisable may not be promoted and are capped."""
    rows, parts = _score_parts(spark, sf_dir)
    n = F.size(C.json_list("evidence_spans_json"))
    made = scoring.components(parts, verified=n, exact=n, comments={"consensus_count": F.coalesce("comment_consensus_count", F.lit(0)), "shill_risk": parts["shill"]}, score=scoring.opportunity_score(parts), reason=F.when(F.coalesce("is_monetizable", F.lit(0)) != 1, "not_monetizable"))
    return rows.select("id", made.alias("s")).select("id", "s.*")


def display_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells, previews, token estimates and plain text of documents."""
    rows = table(spark, sf_dir, "documents", "doc_id", "text")
    t = C.text("text")
    return rows.select("doc_id", C.escaped_cell(C.preview(t, 80)).alias("cell"), F.greatest(F.lit(1), F.floor((F.length(t) + 3) / 4)).cast("long").alias("token_estimate"), F.sha2(t, 256).alias("content_hash"))


def plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents", "doc_id", "text")
    return rows.select("doc_id", F.md5(C.without_markup(C.text("text"))).alias("plain_hash"))


def tag_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pain_points", "id", "competitor_tags")
    return rows.select("id", F.array_join(C.tags(C.json_list("competitor_tags")), ",").alias("tags"))


def valid_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pain_points", "id", "url").select("id", C.public_url(F.col("url")).alias("public"))


def bag_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashed word vectors of titles and summaries."""
    rows = spread(table(spark, sf_dir, "pain_points", "id", "title", "summary"))
    return rows.select("id", bag_vector_udf(F.concat_ws(" | ", "title", "summary")).alias("vector"))


def keyword_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts as the keyword classifier sees them."""
    rows = spread(table(spark, sf_dir, "pain_points", "id", "post_id", "title", "body"))
    return enrich.classified(rows).select("id", "category", "severity", "is_monetizable", F.col("pain_level"), "willingness_to_pay", "analysis_mode")


def text_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each source: how many, with text, and their lengths; ranked by number."""
    rows = table(spark, sf_dir, "documents", "source", "text").groupBy("source").agg(F.count("*").alias("n"), F.count("text").alias("with_text"), F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0)).alias("chars"))
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.col("n").desc(), "source")).cast("long"))


_ALL_TERMS = (*L.COMPLAINT, *L.UNSOLVED, *L.WISH, *L.EVIDENCE)
_AGE = f"CASE WHEN source_created_ts > 0 THEN greatest(CAST(0 AS DOUBLE), ({AS_OF} - source_created_ts) / CAST(86400 AS DOUBLE)) END"
_D = lambda x: f"CAST({x} AS DOUBLE)"
_RECENCY = f"""CASE WHEN age IS NULL THEN {_D(0.35)} WHEN age <= 180 THEN least({_D(1)}, greatest({_D(0.45)}, 1 - age / 180 * {_D(0.55)}))
    ELSE greatest({_D(0.18)}, {_D(0.45)} - least({_D(365)}, greatest({_D(0)}, age - 180)) / 365 * {_D(0.22)}) END"""
_STALE = f"""CASE WHEN age IS NULL THEN {_D(0.08)} WHEN age <= 180 THEN {_D(0)} ELSE least({_D(0.55)}, {_D(0.1)} + least({_D(365)}, greatest({_D(0)}, age - 180)) / 365 * {_D(0.25)}) END"""


def _scores(column: str, values: dict[str, float]) -> str:
    return f"CASE lower(trim({column})) " + " ".join(f"WHEN '{k}' THEN {_D(v)}" for k, v in values.items()) + f" ELSE {_D(values['unknown'])} END"


QUERIES = {f.__name__: f for f in (keyword_scores, post_kinds, prescreen_rank, prescreen_shortlist, comment_signals, evidence_spans, text_scores, evidence_exact, evidence_verified, opportunity_buckets, opportunity_scores, score_components, display_fields, plain_text, tag_lists, valid_urls, bag_vectors, keyword_classes, text_by_source)}

_PRESCREEN = f"""greatest(0, least(7, {_KEYWORD} + CAST({_any('t', L.BUSINESS)} AS INTEGER) + CAST({_any('t', L.PROCESS)} AS INTEGER) + CAST({_any('t', L.HIGH_FREQUENCY)} AS INTEGER)
    + CAST({_any('t', L.COMPETITORS)} AS INTEGER) + CAST(len(comments) > 0 AS INTEGER) + CAST(handness = 'first_hand' AS INTEGER) - CAST({_any('t', L.CONSUMER)} AND NOT {_any('t', L.BUSINESS)} AS INTEGER)))"""
_N = lambda terms: f"len(list_filter(low, lambda x: {_any('x', terms)}))"

ORACLE = {
    "keyword_scores": f"WITH {_BASE} SELECT id, {_KEYWORD} AS keyword_score, category, {_any('t', L.CONSUMER)} AND NOT {_any('t', L.BUSINESS)} AS consumer_noise FROM base",
    "post_kinds": f"WITH {_BASE} SELECT id, kind AS post_type, handness AS first_handness, {_AUTHORITY} AS buyer_authority, array_to_string(list_filter([{', '.join(repr(x) for x in sorted(L.COMPETITORS))}], lambda x: contains(t, x)), ',') AS hints FROM base",
    "prescreen_rank": f"WITH {_BASE} SELECT id, score, score >= 2 AS kept FROM (SELECT id, {_PRESCREEN} AS score FROM base)",
    "prescreen_shortlist": f"WITH {_BASE} SELECT id, score FROM (SELECT id, {_PRESCREEN} AS score FROM base) WHERE score >= 2 ORDER BY score DESC, id LIMIT 100",
    "comment_signals": f"""WITH c AS (SELECT id, {_COMMENTS} AS cs FROM pain_points), d AS (SELECT id, cs, list_transform(cs, lambda x: lower(x)) AS low FROM c)
        SELECT id, CAST({_N((*L.SAME_HERE, *L.CONSENSUS))} AS INTEGER) AS consensus_n, CAST({_N(L.SAME_HERE)} AS INTEGER) AS same_here_n, CAST({_N(L.WORKAROUND)} AS INTEGER) AS workaround_n,
        array_to_string(list_filter([{', '.join(repr(x) for x in sorted(L.COMPETITORS))}], lambda k: len(list_filter(low, lambda x: contains(x, k))) > 0), ',') AS tools,
        CASE WHEN len(cs) > 0 THEN round({_N((*L.SHILL, *L.LINKS))} / CAST(len(cs) AS DOUBLE), 3) ELSE CAST(0 AS DOUBLE) END AS shill_risk, CAST(least(5, len(cs)) AS INTEGER) AS sample_n FROM d""",
    "evidence_spans": f"""WITH p AS (SELECT id, coalesce(title, '') AS ti, array_to_string(list_filter([coalesce(title, ''), coalesce(body, '')], lambda x: x <> ''), chr(10)) AS w FROM pain_points),
        s AS (SELECT id, ti, w, list_filter(list_filter(list_transform(regexp_split_to_array(w, '[\\n.!?]+'), lambda x: {_TRIM.format('x')}), lambda x: x <> ''), lambda x: {_any('lower(x)', _ALL_TERMS)})[1:3] AS sp FROM p)
        SELECT id, CASE WHEN trim(w) = '' THEN '' WHEN len(sp) > 0 THEN array_to_string(list_transform(sp, lambda x: substring(x, 1, 160)), '|') ELSE substring(ti, 1, 160) END AS spans FROM s""",
    "text_scores": f"""WITH p AS (SELECT id, coalesce(post_type, '') AS k, coalesce(pain_level, 0) AS pl, coalesce(willingness_to_pay, 0) AS w, coalesce(comment_workaround_count, 0) AS wc,
        lower(array_to_string(list_filter(list_concat([coalesce(title, ''), coalesce(body, '')], {_COMMENTS}), lambda x: x <> ''), chr(10))) AS t FROM pain_points)
        SELECT id, round(least({_D(1)}, {_D(0.32)} + CASE WHEN {_any('t', L.HIGH_FREQUENCY)} THEN {_D(0.33)} ELSE {_D(0)} END + CASE WHEN {_any('t', (*L.WORKAROUND, *L.FREQUENCY_CONTEXT))} THEN {_D(0.2)} ELSE {_D(0)} END
        + CASE WHEN k IN ('first_person_pain', 'solution_request', 'vendor_rant') THEN {_D(0.1)} ELSE {_D(0)} END), 3) AS frequency,
        round(least({_D(1)}, {_D(0.2)} + least({_D(0.45)}, greatest(pl, w) / {_D(10)} * {_D(0.45)}) + CASE WHEN {_any('t', L.HIGH_IMPACT)} THEN {_D(0.25)} ELSE {_D(0)} END + CASE WHEN {_any('t', L.MEDIUM_IMPACT)} THEN {_D(0.12)} ELSE {_D(0)} END), 3) AS impact,
        round(CASE WHEN {_hits('t', L.SOLVED)} = 0 THEN {_D(0)} ELSE least({_D(0.65)}, {_D(0.18)} * {_hits('t', L.SOLVED)} + {_D(0.04)} * wc) END, 3) AS solved FROM p""",
    "evidence_exact": f"""WITH p AS (SELECT post_id, coalesce(title, '') AS title, coalesce(body, '') AS body, {_LIST.format('evidence_spans_json')} AS q, {_LIST.format('comment_sample_json')} AS c FROM pain_points),
        u AS (SELECT post_id, title, body, c, q, unnest(range(len(q))) AS position FROM p), v AS (SELECT *, q[position + 1] AS quote FROM u),
        w AS (SELECT post_id, position, CASE WHEN trim(quote) = '' THEN '' WHEN contains(title, quote) THEN 'title' WHEN contains(body, quote) THEN 'body' WHEN len(list_filter(c, lambda x: contains(x, quote))) > 0 THEN 'comment' ELSE '' END AS source FROM v)
        SELECT post_id, position, CASE WHEN source = '' THEN 'none' ELSE 'exact' END AS match_type, source FROM w""",
    "opportunity_buckets": f"""SELECT id, CASE WHEN age IS NULL THEN 'unknown_age' WHEN age <= 180 THEN 'current_opportunity' ELSE 'evergreen_pain' END AS bucket, round({_RECENCY}, 3) AS recency, round({_STALE}, 3) AS stale
        FROM (SELECT id, {_AGE} AS age FROM pain_points)""",
    "opportunity_scores": f"""WITH p AS (SELECT *, {_AGE} AS age, least({_D(1)}, len({_LIST.format('evidence_spans_json')}) / {_D(3)}) AS ev, len({_LIST.format('competitor_tags')}) AS nt, len({_LIST.format('comment_tool_mentions_json')}) AS nm,
        coalesce(post_type, '') AS k FROM pain_points)
        SELECT id, round(greatest({_D(0)}, {_D(0)} + coalesce(pain_level, 0) / {_D(10)} * 22 + coalesce(willingness_to_pay, 0) / {_D(10)} * 18 + {_scores('buyer_authority', L.AUTHORITY_SCORES)} * 14 + {_scores('first_handness', L.HANDNESS_SCORES)} * 8
        + coalesce(workflow_frequency_score, 0) * 10 + coalesce(impact_score, 0) * 12 + least({_D(1)}, {_D(0.18)} + {_D(0.22)} * coalesce(comment_consensus_count, 0) + {_D(0.18)} * ev) * 10
        + least({_D(1)}, {_D(0.18)} + {_D(0.16)} * nt + {_D(0.05)} * nm + {_D(0.11)} * coalesce(comment_workaround_count, 0) + CASE WHEN k IN ('vendor_rant', 'tool_comparison') THEN {_D(0.14)} ELSE {_D(0)} END) * 8
        + ({_RECENCY}) * 10 + ev * 6 + ({_STALE}) * -10 + coalesce(solved_penalty, 0) * -12 + coalesce(comment_shill_risk, 0) * -6
        + CASE WHEN k IN ('founder_pitch', 'news_analysis') AND coalesce(first_handness, '') <> 'first_hand' THEN {_D(0.22)} WHEN k = 'advice_thread' THEN {_D(0.08)} ELSE {_D(0)} END * -10), 2) AS score FROM p""",
    "display_fields": """WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), e AS (SELECT doc_id, t, CASE WHEN length(t) > 80 THEN concat(rtrim(substring(t, 1, 77), ' '), '...') ELSE t END AS c FROM d)
        SELECT doc_id, CASE WHEN regexp_matches(ltrim(c, ' '), '^[=+\\-@]') THEN concat('''', c) ELSE c END AS cell, greatest(1, CAST(floor((length(t) + 3) / 4.0) AS BIGINT)) AS token_estimate, sha256(t) AS content_hash FROM e""",
    "plain_text": r"""SELECT doc_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(coalesce(text, ''), '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ')) AS plain_hash FROM documents""",
    "valid_urls": r"""WITH h AS (SELECT id, lower(regexp_extract(url, '(?i)^https?://([^/?#:@]+)(?::\d+)?(?:[/?#]|$)', 1)) AS h FROM pain_points)
        SELECT id, coalesce(h <> '' AND CASE WHEN regexp_matches(h, '^\d+(\.\d+){0,3}$|^0x') THEN regexp_full_match(h, '\d{1,3}(\.\d{1,3}){3}') AND NOT regexp_matches(h, '^(0|10|127|169\.254|192\.168|172\.(1[6-9]|2\d|3[01])|100\.(6[4-9]|[7-9]\d|1[01]\d|12[0-7])|22[4-9]|2[345]\d)\.')
        ELSE h <> 'localhost' AND NOT regexp_matches(h, '\.(local|internal|localhost)$') AND contains(h, '.') END, false) AS public FROM h""",
    "keyword_classes": f"""WITH {_BASE.replace(_COMMENTS, "[]")}, h AS (SELECT id, category, greatest({_KEYWORD}, least(3, {_PRESCREEN})) AS h, {_any('t', L.CONSUMER)} AND NOT {_any('t', L.BUSINESS)} AS noise FROM base)
        SELECT id, category, CASE WHEN h >= 2 THEN 'medium' ELSE 'low' END AS severity, h >= 2 AND NOT noise AS is_monetizable, CASE WHEN noise THEN 0 ELSE least(10, 4 + 2 * h) END AS pain_level,
        CASE WHEN h >= 2 AND NOT noise THEN least(10, 3 + 2 * h) ELSE least(3, CASE WHEN noise THEN 0 ELSE least(10, 3 + 2 * h) END) END AS willingness_to_pay, 'keyword' AS analysis_mode FROM h""",
    "tag_lists": f"""WITH t AS (SELECT id, list_filter(list_transform({_LIST.format('competitor_tags')}, lambda x: substring(lower({_TRIM.format('x')}), 1, 64)), lambda x: x <> '') AS a FROM pain_points)
        SELECT id, array_to_string(list_filter(a, lambda x, i: list_position(a, x) = i), ',') AS tags FROM t""",
    "text_by_source": "SELECT source, n, with_text, CAST(chars AS BIGINT) AS chars, row_number() OVER (ORDER BY n DESC, source) AS place FROM (SELECT source, count(*) AS n, count(text) AS with_text, coalesce(sum(length(text)), 0) AS chars FROM documents GROUP BY source)",
}


def _score_sql() -> str:
    head, _, tail = ORACLE["opportunity_scores"].partition("SELECT id, round(")
    score = tail.rpartition(", 2) AS score FROM p")[0]
    capped = f"CASE WHEN coalesce(is_monetizable, 0) = 1 THEN {score} ELSE least({_D(35)}, {score}) END"
    kind = f"CASE WHEN k IN ('founder_pitch', 'news_analysis') AND coalesce(first_handness, '') <> 'first_hand' THEN {_D(0.22)} WHEN k = 'advice_thread' THEN {_D(0.08)} ELSE {_D(0)} END"
    r = lambda x: f"round({x}, 3)"
    incumbent = f"least({_D(1)}, {_D(0.18)} + {_D(0.16)} * nt + {_D(0.05)} * nm + {_D(0.11)} * coalesce(comment_workaround_count, 0) + CASE WHEN k IN ('vendor_rant', 'tool_comparison') THEN {_D(0.14)} ELSE {_D(0)} END)"
    return f"""{head}SELECT id, {_scores('buyer_authority', L.AUTHORITY_SCORES)} AS buyer_authority_score, {_scores('first_handness', L.HANDNESS_SCORES)} AS first_handness_score, {r('coalesce(workflow_frequency_score, 0)')} AS workflow_frequency_score, {r('coalesce(impact_score, 0)')} AS impact_score,
        {r(f'least({_D(1)}, {_D(0.18)} + {_D(0.22)} * coalesce(comment_consensus_count, 0) + {_D(0.18)} * ev)')} AS consensus_score, {r(incumbent)} AS incumbent_failure_score, {r(f'({_RECENCY})')} AS recency_score, {r(f'({_STALE})')} AS stale_penalty, {r(f'(coalesce(solved_penalty, 0) + {kind})')} AS solved_penalty,
        {r('ev')} AS evidence_score, CAST(len({_LIST.format('evidence_spans_json')}) AS INTEGER) AS verified_evidence_count, CAST(len({_LIST.format('evidence_spans_json')}) AS INTEGER) AS exact_evidence_count, {r(kind)} AS type_penalty, coalesce(comment_consensus_count, 0) AS comment_consensus_count, coalesce(comment_shill_risk, 0) AS comment_shill_risk,
        coalesce(is_monetizable, 0) = 1 AS promotion_eligible, CASE WHEN coalesce(is_monetizable, 0) <> 1 THEN 'not_monetizable' END AS evidence_rejection_reason, CASE WHEN coalesce(is_monetizable, 0) <> 1 THEN {_D(35)} END AS promotion_score_cap, round({capped}, 2) AS opportunity_score FROM p"""


ORACLE["score_components"] = _score_sql()
