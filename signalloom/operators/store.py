"""Keyed tables without a merge-capable format: the next version of a table as a join of the old and new rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import filled, json_list, tags, trimmed

#: What a status may be.
TRIAGE = ("new", "favorite", "discarded", "merged")
DEEP_DIVE = ("not_requested", "queued", "running", "completed", "failed")
BUCKETS = ("current_opportunity", "evergreen_pain", "unknown_age")

#: Columns whose stored value stays when a new one is null, and those that an update never touches.
KEEP_OLD_IF_NULL = ("source_created_at", "source_created_ts", "author_name", "deep_dive_summary")
NEVER_TOUCHED = ("triage_status", "emb_vector", "cross_source_count", "cross_source_ids", "created_at")


def upsert(old: DataFrame, new: DataFrame, key: str = "post_id") -> DataFrame:
    """Old rows updated by new ones of their key, and new rows added.

    A finished deep dive stays finished.  Keys are unique in both; a null key is never matched."""
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    had, has = F.col(f"o.{key}").isNotNull(), F.col(f"n.{key}").isNotNull()

    def value(c: str):
        x, y = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c == key:
            return F.coalesce(x, y)
        if c in NEVER_TOUCHED:
            return F.when(had, x).otherwise(y)
        if c in KEEP_OLD_IF_NULL:
            return F.coalesce(y, x)
        if c == "deep_dive_status":
            return F.when(had & (x == "completed"), x).when(has, y).otherwise(x)
        return F.when(has, y).otherwise(x)

    return joined.select(*(value(c).alias(c) for c in old.columns))


def replace_children(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Children of the keys in `new` replaced by its rows, each once; other keys' children stay."""
    kept = old.join(new.select(key).distinct(), key, "left_anti")
    return kept.select(*old.columns).unionByName(new.select(*old.columns).distinct())


def merge_duplicates(rows: DataFrame, pairs: DataFrame, key: str = "post_id") -> DataFrame:
    """Rows with what their duplicates bring: pairs has (canonical_id, duplicate_id) and may have the duplicate's emb_vector.

    A canonical row takes up the ids of its duplicates in `cross_source_ids` (a JSON list) once each and counts the new
    ones, so the same pairs again change nothing.  It becomes a favourite if a duplicate is one; a completed deep dive of
    a duplicate completes it and fills its summary where it had none of its own.  A duplicate becomes merged.  Pairs
    of unknown canonical rows do nothing; unknown duplicates are counted, but bring nothing else.  Of several
    duplicates with a deep dive the one of the smallest id counts.  Columns that `rows` lacks are left alone."""
    columns = set(rows.columns)
    given = pairs.select("canonical_id", "duplicate_id", *(["emb_vector"] if "emb_vector" in pairs.columns else [])).where("canonical_id <> duplicate_id")
    known = given.join(rows.select(F.col(key).alias("canonical_id")), "canonical_id", "left_semi")
    links = known.select("canonical_id", "duplicate_id").distinct()
    deep = {"deep_dive_status", "deep_dive_summary"} <= columns
    status = rows.select(F.col(key).alias("duplicate_id"), F.col("triage_status").alias("s"), *((F.col("deep_dive_status").alias("d"), F.col("deep_dive_summary").alias("t")) if deep else ()))
    done = [F.max(F.coalesce(F.col("d") == "completed", F.lit(False))).alias("done"), F.min_by(F.when(F.col("d") == "completed", F.col("t")), F.when((F.col("d") == "completed") & F.col("t").isNotNull(), F.col("duplicate_id"))).alias("told")] if deep else []
    gain = links.join(status, "duplicate_id", "left").groupBy(F.col("canonical_id").alias(key)).agg(F.array_sort(F.collect_set("duplicate_id")).alias("brought"), F.max(F.coalesce(F.col("s") == "favorite", F.lit(False))).alias("favourite"), *done)
    lost = known.groupBy(F.col("duplicate_id").alias(key)).agg(F.lit(True).alias("lost"), *([F.max("emb_vector").alias("vector")] if "emb_vector" in pairs.columns else []))
    out = rows.join(gain, key, "left").join(lost, key, "left")
    gained = F.col("brought").isNotNull()
    values = {"triage_status": F.when(F.col("lost"), "merged").when(F.col("favourite"), "favorite").otherwise(F.col("triage_status"))}
    ids = F.coalesce(F.from_json("cross_source_ids", "array<string>"), F.array().cast("array<string>")) if "cross_source_ids" in columns else F.array().cast("array<string>")
    fresh = F.array_except(F.coalesce("brought", F.array().cast("array<string>")), ids)
    if "cross_source_ids" in columns:
        values["cross_source_ids"] = F.when(gained, F.to_json(F.concat(ids, fresh))).otherwise(F.col("cross_source_ids"))
    if "cross_source_count" in columns:
        values["cross_source_count"] = F.coalesce("cross_source_count", F.lit(1)) + F.size(fresh)
    if deep:
        had = F.coalesce(F.col("deep_dive_status") == "completed", F.lit(False))
        values["deep_dive_status"] = F.when(F.col("done"), "completed").otherwise(F.col("deep_dive_status"))
        values["deep_dive_summary"] = F.when(F.col("done") & (~had | F.col("deep_dive_summary").isNull()), F.coalesce("told", "deep_dive_summary")).otherwise(F.col("deep_dive_summary"))
    if "emb_vector" in columns and "emb_vector" in pairs.columns:
        values["emb_vector"] = F.when(F.col("lost"), F.col("vector")).otherwise(F.col("emb_vector"))
    return out.withColumns(values).select(*rows.columns)


def _known(df: DataFrame, column: str, allowed: tuple[str, ...]) -> DataFrame:
    """The rows, with an error for a value that isn't allowed."""
    good = F.col(column).isin(*allowed)
    return df.withColumn(column, F.when(good, F.col(column)).otherwise(F.raise_error(F.concat(F.lit(f"unsupported {column}: "), F.coalesce(column, F.lit("null"))))))


#: Numbers of a signal that must be finite.
FINITE = ("buyer_authority_score", "workflow_frequency_score", "impact_score", "consensus_score", "incumbent_failure_score", "recency_score", "stale_penalty", "solved_penalty", "opportunity_score", "comment_shill_risk")


def stored_form(rows: DataFrame) -> DataFrame:
    """Signals as they are stored, of the columns that they have: unknown statuses and buckets become the default, at most
    3 quotes of 160 and 5 comments of 240 characters stay, none blank, tags are normal, and a number that isn't finite
    raises.  Null numbers and lists stay null."""
    have, values = set(rows.columns), {}
    for name, allowed, default in (("triage_status", TRIAGE, "new"), ("deep_dive_status", DEEP_DIVE, "not_requested"), ("opportunity_bucket", BUCKETS, "unknown_age")):
        if name in have:
            values[name] = F.when(F.col(name).isin(*allowed), F.col(name)).otherwise(default)
    cut = lambda name, chars, most: F.slice(F.transform(filled(json_list(name)), lambda x: F.substring(x, 1, chars)), 1, most)
    for name, chars, most in (("evidence_spans_json", 160, 3), ("comment_sample_json", 240, 5)):
        if name in have:
            values[name] = F.when(F.col(name).isNotNull(), F.to_json(cut(name, chars, most)))
    for name in ("competitor_tags", "comment_tool_mentions_json"):
        if name in have:
            values[name] = F.when(F.col(name).isNotNull(), F.to_json(tags(json_list(name))))
    for name in FINITE:
        if name in have:
            bad = F.isnan(name) | (F.abs(name) == F.lit(float("inf")))
            values[name] = F.when(bad, F.raise_error(F.lit(f"{name} must be finite")).cast("double")).otherwise(F.col(name))
    return rows.withColumns(values)


def set_triage(rows: DataFrame, changes: DataFrame, key: str = "post_id") -> DataFrame:
    """Rows with the new triage_status of their key; an unknown status raises, unknown keys do nothing.

    changes (key, triage_status) has a key once; a key without a row can be found by an anti-join before."""
    new = _known(changes.select(key, "triage_status"), "triage_status", TRIAGE).withColumnRenamed("triage_status", "new_")
    return rows.join(new, key, "left").withColumn("triage_status", F.coalesce("new_", "triage_status")).select(*rows.columns)


def set_deep_dive(rows: DataFrame, changes: DataFrame, key: str = "post_id") -> DataFrame:
    """Rows with the new deep_dive_status; the summary is the given one, or else the error's text, or else stays.

    changes (key, deep_dive_status, summary, error) has a key once; an unknown status raises."""
    told = F.coalesce(F.nullif("summary", F.lit("")), F.when(F.nullif("error", F.lit("")).isNotNull(), F.concat(F.lit("Deep dive error: "), "error")))
    new = _known(changes, "deep_dive_status", DEEP_DIVE).select(key, F.col("deep_dive_status").alias("new_"), told.alias("told_"))
    joined = rows.join(new, key, "left")
    return joined.withColumns({"deep_dive_summary": F.coalesce("told_", "deep_dive_summary"), "deep_dive_status": F.coalesce("new_", "deep_dive_status")}).select(*rows.columns)


def set_vectors(rows: DataFrame, vectors: DataFrame, key: str = "post_id") -> DataFrame:
    """Rows with the vectors (key, vector array<double>) of their keys stored as JSON; a vector with a number that isn't
    finite raises."""
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    text = F.when(bad, F.raise_error(F.lit("emb_vector has a number that isn't finite"))).otherwise(F.to_json("vector"))
    return rows.join(vectors.select(key, text.alias("new_")), key, "left").withColumn("emb_vector", F.coalesce("new_", "emb_vector")).select(*rows.columns)


def without_vector(rows: DataFrame) -> DataFrame:
    """Rows that a backfill of vectors takes: none stored, and not merged."""
    return rows.where(F.col("emb_vector").isNull() & (F.col("triage_status") != "merged"))


def with_vector(rows: DataFrame) -> DataFrame:
    """Rows that duplicates are looked for among: a vector stored, and not merged."""
    return rows.where(F.col("emb_vector").isNotNull() & (F.col("triage_status") != "merged"))


def put_keyed(old: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Old rows replaced by the new ones of their key; of several new rows the one with the largest `order` columns wins."""
    last = new.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*old.columns), F.struct(*order)).alias("r")).select("r.*")
    return old.join(last.select(key), key, "left_anti").select(*old.columns).unionByName(last)


def readable_answers(cache: DataFrame, payload: str = "response_json") -> tuple[DataFrame, DataFrame]:
    """(rows whose payload is a JSON object, rows to drop because it isn't)."""
    listed = F.try_parse_json(F.concat(F.lit("["), F.col(payload), F.lit("]")))
    good = F.coalesce(F.schema_of_variant(F.try_variant_get(listed, "$[0]", "variant")).startswith("OBJECT") & F.try_variant_get(listed, "$[1]", "variant").isNull(), F.lit(False))
    return cache.where(good), cache.where(~good)


def status_after(old: DataFrame, runs: DataFrame, name: str = "job_name") -> DataFrame:
    """(name, last_run, last_success, last_error) after runs (name, at, error): the latest run wins, success clears the
    error, an error is cut to 1000 characters, and the last success stays."""
    last = runs.groupBy(name).agg(F.max("at").alias("at"), F.max(F.when(F.col("error").isNull(), F.col("at"))).alias("ok"), F.max_by("error", F.struct("at", F.coalesce("error", F.lit("")))).alias("error"))
    joined = old.join(last, name, "full_outer")
    newer = F.col("at").isNotNull() & (F.col("last_run").isNull() | (F.col("at") >= F.col("last_run")))
    return joined.select(name, F.greatest("last_run", "at").alias("last_run"), F.greatest("last_success", "ok").alias("last_success"), F.when(newer, F.substring("error", 1, 1000)).otherwise(F.col("last_error")).alias("last_error"))


def checked_feedback(rows: DataFrame, allowed: tuple[str, ...], *, strict: bool = True) -> DataFrame:
    """Feedback with its value trimmed and in lower case; an unknown value raises, or is left out where not strict."""
    value = F.lower(trimmed(F.col("feedback_value")))
    out = rows.withColumn("feedback_value", value)
    return _known(out, "feedback_value", allowed) if strict else out.where(F.col("feedback_value").isin(*allowed))
