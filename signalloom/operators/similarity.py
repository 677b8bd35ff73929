"""Similar pairs and best matches of vectors, exactly, by blocks of matrix products."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import unit


#: Rows of a block of similar_pairs().
BLOCK = 2000


def _units(df: DataFrame, id_col: str, vector_col: str, group_col: str | None) -> DataFrame:
    group = F.col(group_col).cast("string") if group_col else F.lit(None).cast("string")
    return df.select(F.col(id_col).cast("long").alias("id"), group.alias("g"), unit(F.col(vector_col)).alias("v")).where("id is not null and v is not null")


def similar_pairs(df: DataFrame, id_col: str, vector_col: str, threshold: float, *, group_col: str | None = None, blocks: int | None = None) -> DataFrame:
    """(a, b, similarity), a < b: the pairs of unit vectors whose inner product reaches the threshold; with
    group_col only of different groups.

    Rows are dealt into blocks by a hash of their id; every pair of blocks is one matrix product in a task of its
    own, which gives back only what reaches the threshold.  The work is quadratic, as the exact answer asks for, but no
    task holds more than two blocks of about BLOCK rows, of which there are as many as the rows ask for.  Null, empty and zero vectors, and null ids, are left out."""
    units = _units(df, id_col, vector_col, group_col)
    blocks = blocks or max(4, -(-df.count() // BLOCK))
    rows = units.withColumn("k", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    # block k meets every block; the cell is named by the smaller and larger one
    cells = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    cells = cells.withColumns({"i": F.least("k", "other"), "j": F.greatest("k", "other")}).drop("other")

    def products(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = key
        left, right = pdf[pdf.k == i], pdf[pdf.k == j]
        empty = pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64"), "similarity": pd.Series(dtype="float64")})
        if left.empty or right.empty:
            return empty
        u, w = np.stack(left.v.to_numpy()), np.stack(right.v.to_numpy()).T
        found = []
        for k in range(0, len(u), 256):  # so that the products of few rows are held at once
            part = u[k : k + 256] @ w
            x, y = np.nonzero(part >= threshold - 1e-9)
            found.append((x + k, y, part[x, y]))
        x, y, s = (np.concatenate(c) for c in zip(*found))
        a, b = left.id.to_numpy()[x], right.id.to_numpy()[y]
        keep = a < b if i == j else a != b
        if group_col:
            g, h = left.g.to_numpy()[x], right.g.to_numpy()[y]
            keep &= g != h
        a, b, s = a[keep], b[keep], s[keep]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "similarity": s})

    return cells.groupBy("i", "j").applyInPandas(products, "a long, b long, similarity double").where(F.col("similarity") >= threshold)


def best_matches(queries: DataFrame, rows: DataFrame, id_col: str, vector_col: str, threshold: float, *, group_col: str | None = None, block: int = 4096) -> DataFrame:
    """(id, match_id, similarity): the best row of another group for each query, of at least the threshold and over
    0; ties go to the smaller id.

    The stated queries are read to the driver in blocks of at most `block` vectors; each block is sent to all tasks
    and held against all rows, and only the best of each task is passed on."""
    q = _units(queries, id_col, vector_col, group_col)
    held = _units(rows, id_col, vector_col, group_col)
    found, ids, groups, vectors = None, [], [], []

    def against() -> DataFrame:
        sent = queries.sparkSession.sparkContext.broadcast((np.array(ids), np.array(groups, object), np.array(vectors)))

        def best(batches):
            qi, qg, qv = sent.value
            for pdf in batches:
                if pdf.empty:
                    continue
                pdf = pdf.sort_values("id", kind="stable")
                s = qv @ np.stack(pdf.v.to_numpy()).T
                own = pdf.id.to_numpy()
                s[qi[:, None] == own[None, :]] = -2
                if group_col:
                    s[qg[:, None] == pdf.g.to_numpy()[None, :]] = -2
                at = s.argmax(axis=1)
                top = s[np.arange(len(qi)), at]
                good = (top >= threshold) & (top > 0)
                yield pd.DataFrame({"id": qi[good], "match_id": own[at[good]], "similarity": top[good]})

        return held.mapInPandas(best, "id long, match_id long, similarity double")

    for r in q.toLocalIterator():
        ids.append(r.id)
        groups.append(r.g)
        vectors.append(r.v)
        if len(ids) == block:
            found = against() if found is None else found.unionAll(against())
            ids, groups, vectors = [], [], []
    if ids:
        found = against() if found is None else found.unionAll(against())
    if found is None:
        return held.sparkSession.createDataFrame([], "id long, match_id long, similarity double")
    order = Window.partitionBy("id").orderBy(F.col("similarity").desc(), "match_id")
    return found.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")
