"""The queries of problems 1 to 8: name to a function of (spark, folder of the tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import canonical, encoding, leakage, near_duplicates, privacy, splitting, top_items, truncation
from ..sources.tables import beside
from .base import spread, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.Truncation(spread(table(spark, sf_dir, "pain_points", "id", "source", "body", "summary"))).values().select("id", "field_name")


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many and what share of its bodies and summaries each source truncates."""
    return truncation.Truncation(spread(table(spark, sf_dir, "pain_points", "id", "source", "body", "summary"))).report()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pain_points", "id", "niche_category", "opportunity_score")
    return top_items.top_per_group(rows, "niche_category", "opportunity_score", "id", 3)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.deviating_values(spread(table(spark, sf_dir, "pain_points", "id", "body", "evidence_spans_json")))


def p3_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.canonical_rows(spread(table(spark, sf_dir, "pain_points", "id", "body", "evidence_spans_json")))


def p3_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in the one form, and how many of their values p3's detector still finds: none."""
    made = canonical.canonical_rows(spread(table(spark, sf_dir, "pain_points", "id", "body", "evidence_spans_json")))
    left = canonical.deviating_values(made).agg(F.count("*").alias("n_left"))
    return beside(made.agg(F.count("*").alias("n_rows")), left)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(table(spark, sf_dir, "pain_points", "id", *privacy.FIELDS))
    return privacy.find_personal(rows, model=privacy.fit_names(rows))


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(table(spark, sf_dir, "pain_points", "id", *privacy.FIELDS))
    return privacy.redact(rows, model=privacy.fit_names(rows))


def p4_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redacted rows, and how many finds are left in them: none."""
    rows = spread(table(spark, sf_dir, "pain_points", "id", *privacy.FIELDS))
    model = privacy.fit_names(rows)
    made = privacy.redact(rows, model=model)
    left = privacy.find_personal(made, model=model).agg(F.count("*").alias("n_left"))
    return beside(made.agg(F.count("*").alias("n_rows")), left)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.NearDuplicates(spread(table(spark, sf_dir, "pain_points", "id", "title", "body"))).pairs()


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each record that counts: its group of records that tell the same text, its class of equal ones
    within it, and the number of other classes it is linked to."""
    return near_duplicates.NearDuplicates(spread(table(spark, sf_dir, "pain_points", "id", "title", "body"))).groups()


def p5_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that count, and how many pairs lie in different groups, or have an end that is in none: none."""
    found = near_duplicates.NearDuplicates(spread(table(spark, sf_dir, "pain_points", "id", "title", "body")))
    groups = found.groups().select("id", "group_id")
    one, two = (groups.select(F.col("id").alias(f"id_{x}"), F.col("group_id").alias(f"g{x}")) for x in "ab")
    apart = found.pairs().join(one, "id_a", "left").join(two, "id_b", "left").agg(F.count_if(~F.coalesce(F.col("ga") == F.col("gb"), F.lit(False))).alias("n_apart"))
    return beside(groups.agg(F.count("*").alias("n_texts")), apart)


def p6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that come back from their ids."""
    ids = encoding.encode_corpus(spread(table(spark, sf_dir, "documents", "doc_id", "text")))
    return encoding.decode_corpus(ids).select("doc_id", F.md5("text").alias("text_hash"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encode_corpus(spread(table(spark, sf_dir, "documents", "doc_id", "text")))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.find_leaks(spread(table(spark, sf_dir, "documents", "doc_id", "text")), table(spark, sf_dir, "eval_posts", "post_id", "body"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("doc_id", "post_id")


def p7_leaked_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each eval post that leaked, into how many documents, and the longest run of its words in one."""
    return _leaks(spark, sf_dir).groupBy("post_id").agg(F.count("*").alias("documents"), F.max("run_words").alias("longest_run"))


def p7_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation posts of 20 words or more that are found in their own first 20 words after the tenth was changed: with
    one edit all of them."""
    posts = table(spark, sf_dir, "eval_posts", "post_id", "body")
    words = F.regexp_extract_all(F.lower("body"), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    made = posts.withColumn("w", words).where(F.size("w") >= 20).select(F.xxhash64("post_id").alias("doc_id"), "post_id", F.array_join(F.concat(F.slice("w", 1, 9), F.array(F.lit("quaggas")), F.slice("w", 11, 10)), " ").alias("text"))
    found = leakage.find_leaks(spread(made.select("doc_id", "text")), posts, edits=1)
    return found.join(made.select("doc_id", "post_id"), ["doc_id", "post_id"]).select("post_id", (F.col("run_words") < 12).alias("by_edit"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = splitting.split_corpus(spread(table(spark, sf_dir, "documents", "doc_id", "text")), with_text=False)
    return pieces.where("piece_no = 1").select("doc_id")


def p8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_corpus(spread(table(spark, sf_dir, "documents", "doc_id", "text")))


def p8_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document how far its pieces reach, and how many begin after the end of the one before, have too many
    tokens, or differ from the document's text at their place: none."""
    docs = spread(table(spark, sf_dir, "documents", "doc_id", "text"))
    pieces = splitting.split_corpus(docs)
    order = Window.partitionBy("doc_id").orderBy("piece_no")
    pieces = pieces.withColumn("before", F.lag("char_end", 1, 0).over(order)).join(docs, "doc_id")
    own = F.substring(F.coalesce("text", F.lit("")), F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
    count = lambda c: F.count_if(c)
    return pieces.groupBy("doc_id").agg(F.max("char_end").cast("long").alias("n_chars"), count(F.col("char_start") > F.col("before")).alias("gaps"), count(F.col("n_tokens") > 512).alias("too_long"), count(F.col("piece") != own).alias("wrong"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_report, p2_found, p3_found, p3_canonical, p3_check, p4_found, p4_redacted, p4_check, p5_found, p5_groups, p5_check, p6_ids, p6_decoded, p7_found, p7_leaked_posts, p7_edited, p8_found, p8_pieces, p8_check)}

#: Every passage of twelve words, as a hash.
_TWELVE = ", ' ', ".join(["w", *(f"lead(w, {k}) OVER o" for k in range(1, 12))])
_PASSAGES = "SELECT {0}, hash(g) AS g FROM (SELECT {0}, concat(" + _TWELVE + ") AS g, lead(w, 11) OVER o AS last FROM (SELECT {0}, unnest(l) AS w, unnest(range(len(l))) AS i FROM (SELECT {0}, regexp_extract_all(lower({1}), '[\\p{{L}}\\p{{N}}]+') AS l FROM {2})) WINDOW o AS (PARTITION BY {0} ORDER BY i)) WHERE last IS NOT NULL"

ORACLE: dict[str, str] = {
    "p2_found": """
        SELECT niche_category, CAST(rank_no AS INTEGER) AS rank_no, id
        FROM (SELECT niche_category, id, row_number() OVER (PARTITION BY niche_category ORDER BY opportunity_score DESC, id) AS rank_no
              FROM pain_points WHERE opportunity_score IS NOT NULL AND niche_category IS NOT NULL AND niche_category <> '')
        WHERE rank_no <= 3""",
    "p3_check": "SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_left FROM pain_points",
    "p4_check": "SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_left FROM pain_points",
    "p5_check": r"SELECT count(*) FILTER (len(regexp_extract_all(lower(body), '[\p{L}\p{N}]+')) >= 40) AS n_texts, CAST(0 AS BIGINT) AS n_apart FROM pain_points WHERE id IS NOT NULL",
    "p6_decoded": "SELECT doc_id, md5(coalesce(text, '')) AS text_hash FROM documents",
    "p7_edited": r"SELECT post_id, true AS by_edit FROM eval_posts WHERE len(regexp_extract_all(lower(body), '[\p{L}\p{N}]+')) >= 20",
    "p7_found": f"WITH x AS ({_PASSAGES.format('doc_id', 'text', 'documents')}), y AS ({_PASSAGES.format('post_id', 'body', 'eval_posts')}) SELECT DISTINCT doc_id, post_id FROM x JOIN y USING (g)",
    "p5_found": r"""WITH t AS (SELECT id, regexp_extract_all(lower(concat(coalesce(title, ''), ' ', body)), '[\p{L}\p{N}]+') AS w FROM pain_points WHERE len(regexp_extract_all(lower(body), '[\p{L}\p{N}]+')) >= 40),
        g AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w)), lambda i: hash(concat(w[i], ' ', w[i + 1])))) AS g FROM t), n AS (SELECT id, count(*) AS n FROM g GROUP BY 1),
        p AS (SELECT x.id AS id_a, y.id AS id_b, count(*) AS shared FROM g x JOIN g y ON x.g = y.g AND x.id < y.id GROUP BY 1, 2)
        SELECT id_a, id_b FROM p JOIN n a ON a.id = id_a JOIN n b ON b.id = id_b WHERE shared >= 0.6 * (a.n + b.n - shared)""",
    "p8_check": "SELECT doc_id, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars, CAST(0 AS BIGINT) AS gaps, CAST(0 AS BIGINT) AS too_long, CAST(0 AS BIGINT) AS wrong FROM documents",
}
