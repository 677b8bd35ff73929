"""Quotes held against the texts they are said to come from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import text
from ..functions.udfs import match_form_udf, match_forms_udf

SOURCES = ("title", "body", "comment")


def verify_quotes(df: DataFrame, quotes: str, comments: str, *, fuzzy: bool = True) -> DataFrame:
    """(post_id, position, quote, match_type, source, confidence): each quote of a row's list, exact if it stands
    in the title, body or a comment as it is (1.0), fuzzy if it does in their matching form (0.9), else none.

    The first source with a match counts, and a quote must stand in one comment, not across two.  Only texts of rows
    with a quote that isn't exact are brought to the matching form.  Blank quotes match nothing; rows without quotes give none; repeated rows are each kept."""
    rows = df.select("post_id", text("title").alias("title"), text("body").alias("body"), F.col(comments).alias("c"), F.posexplode(F.col(quotes)).alias("position", "quote")).where("quote is not null")
    inside = lambda x: F.contains(x, F.col("quote"))
    exact = F.when(F.trim("quote") == "", None).when(inside(F.col("title")), "title").when(inside(F.col("body")), "body").when(F.exists("c", inside), "comment")
    rows = rows.withColumn("exact", exact)
    if not fuzzy:
        near = F.lit(None).cast("string")
    else:
        unsure = F.col("exact").isNull()
        for name, value in (("fq", F.col("quote")), ("ft", F.col("title")), ("fb", F.col("body"))):
            rows = rows.withColumn(name, match_form_udf(F.when(unsure, value)))
        rows = rows.withColumn("fc", match_forms_udf(F.when(unsure, F.col("c"))))
        near = F.when(F.coalesce(F.col("fq"), F.lit("")) == "", None).when(F.contains("ft", F.col("fq")), "title").when(F.contains("fb", F.col("fq")), "body").when(F.exists("fc", lambda x: F.contains(x, F.col("fq"))), "comment")
    return rows.withColumn("near", near).select(
        "post_id", "position", "quote",
        F.when(F.col("exact").isNotNull(), "exact").when(F.col("near").isNotNull(), "fuzzy").otherwise("none").alias("match_type"),
        F.coalesce("exact", "near", F.lit("")).alias("source"),
        F.when(F.col("exact").isNotNull(), 1.0).when(F.col("near").isNotNull(), 0.9).otherwise(0.0).alias("confidence"),
    )
