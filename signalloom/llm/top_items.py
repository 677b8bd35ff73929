"""Problem 2: the N best items of every group, by descending score bands."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import cut, written

#: Rows of the top band, about; each further one is as large as all above it together, and there are at most so many.
TOP_BAND, MOST_BANDS = 20_000, 12
#: The most filled groups sent to all tasks; more are joined by a shuffle.
SMALL_SIDE = 250_000


def top_per_group(df: DataFrame, group_col: str, score_col: str, id_col: str, n: int = 3, *, bands: int | None = None) -> DataFrame:
    """(group_col, rank_no from 1 to n, id_col): the n rows of highest score in every group; ties by id ascending.

    Rows with a null score, or a null or empty group, are left out; groups are compared as stored.  NaN scores
    rank first, null ids after other ids of their score, and equal rows are each ranked.  An empty table gives an
    empty result; other columns aren't read.

    One pass counts the rows of each group and takes approximate quantiles of the score as limits of the bands, of
    which there are more the more rows there are.  A second deals the narrow rows into bands, without a shuffle and
    by as many tasks as read them.  Bands are taken from the top: rows of groups that higher bands have filled are
    dropped by an anti-join, the rest are cut to the n best of each group in each task before the shuffle, and a
    group's boundary band is finished by exact ranking, ties by id.  All rows of a score lie in one band, so ranks
    go on from the rows already kept, which all rank higher.  It ends when no group with rows left lacks one."""
    if n < 1 or bands is not None and bands < 1:
        raise ValueError("n and bands must be positive")
    spark = df.sparkSession
    usable = df.select(F.col(group_col).alias("g"), F.col(score_col).alias("s"), F.col(id_col).alias("i")).where("g is not null and s is not null")
    if dict(usable.dtypes)["g"] == "string":
        usable = usable.where("g <> ''")
    height = F.nanvl(F.col("s").cast("double"), F.lit(float("inf")))
    most = max(MOST_BANDS, bands or 1)
    total, halves = usable.agg(F.count("*"), F.percentile_approx(height, [1 - 0.5**k for k in range(1, most)] or [0.5], 10_000)).first()
    wanted = bands or min(MOST_BANDS, 1 + max(0, total // TOP_BAND).bit_length())
    limits = sorted(set((halves or [])[: wanted - 1]), reverse=True)
    band = sum((F.when(height < limit, 1).otherwise(0) for limit in limits), F.lit(0))
    rows = written(usable.withColumn("band", band), "bands", partition_by="band")
    needs = cut(usable.groupBy("g").agg(F.least(F.count("*"), F.lit(n)).alias("needs")))
    order = [F.col("s").desc(), F.col("i").asc_nulls_last()]
    kept = filled = None
    for own_band in range(len(limits) + 1):
        own = rows.where(F.col("band") == own_band).select("g", "s", "i")
        few = filled is not None and filled.count() <= SMALL_SIDE
        if few:
            own = own.join(F.broadcast(filled), "g", "left_anti")
        ranked = own.withColumn("place", F.row_number().over(Window.partitionBy("g").orderBy(*order))).where(F.col("place") <= n)
        if filled is not None and not few:  # after the cut, so that a hot group isn't shuffled
            ranked = ranked.join(filled, "g", "left_anti")
        if kept is None:
            kept = cut(ranked.select("g", "i", F.col("place").alias("rank_no")))
        else:
            before = kept.groupBy("g").agg(F.max("rank_no").alias("had"))
            ranked = ranked.join(before, "g", "left").select("g", "i", (F.col("place") + F.coalesce("had", F.lit(0))).alias("rank_no")).where(F.col("rank_no") <= n)
            kept = kept.unionAll(cut(ranked))
        if own_band < len(limits):
            reached = kept.groupBy("g").agg(F.max("rank_no").alias("had")).join(needs, "g", "right")
            filled = cut(reached.where("had = needs").select("g"))
            if reached.where("had is null or had < needs").isEmpty():
                break
    return kept.select(F.col("g").alias(group_col), F.col("rank_no").cast("int").alias("rank_no"), F.col("i").alias(id_col))
