"""Files that results are written to."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import escaped_cell


def write_csv(df: DataFrame, path: str, *, mode: str = "error") -> None:
    """CSV files with a header; texts that a spreadsheet would take for formulas are escaped."""
    cells = {c: escaped_cell(F.col(f"`{c}`")) for c, kind in df.dtypes if kind == "string"}
    df.withColumns(cells).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str, *, mode: str = "error") -> None:
    """JSON lines; numbers that aren't finite become null."""
    finite = {c: F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.col(c)) for c, kind in df.dtypes if kind in ("double", "float")}
    df.withColumns(finite).write.mode(mode).option("ignoreNullFields", False).json(path)


def append(df: DataFrame, path: str) -> None:
    """Rows added to a Parquet table."""
    df.write.mode("append").parquet(path)


def write_report(spark: SparkSession, report: dict | list, path: str) -> None:
    """A small report as one JSON file, keys in order; it appears at its path only when whole.  A number that isn't finite
    raises."""

    def check(value) -> None:
        if isinstance(value, float) and not math.isfinite(value):
            raise ValueError("a report's numbers must be finite")
        for x in value.values() if isinstance(value, dict) else value if isinstance(value, list) else ():
            check(x)

    check(report)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    part = hadoop(f"{path}.tmp")
    out = files.create(part, True)
    try:
        out.write(bytearray((json.dumps(report, indent=2, sort_keys=True, ensure_ascii=False) + "\n").encode()))
    finally:
        out.close()
    files.delete(hadoop(path), False)
    if not files.rename(part, hadoop(path)):
        raise OSError(f"cannot write {path}")
