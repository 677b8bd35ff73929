"""Reading the stored tables, their schema repair and the shared folder for intermediate results."""

from __future__ import annotations

import atexit
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of one Parquet table of the data folder."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer partitions than there are cores, dealt out to all; a larger one stays as it is.

    Only for a plain scan of narrow columns before costly work on each row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def beside(*rows: DataFrame) -> DataFrame:
    """The columns of frames of one row each in one row."""
    columns = [c for df in rows for c in df.columns]
    whole = rows[0]
    for df in rows[1:]:
        whole = whole.unionByName(df, allowMissingColumns=True)
    return whole.agg(*(F.max(c).alias(c) for c in columns))


def ensure_schema(df: DataFrame, schema: T.StructType, defaults: dict[str, object] | None = None) -> DataFrame:
    """With every column of the schema: missing ones are added with their default (or null), present ones are cast
    where a value allows it, further ones stay."""
    defaults = defaults or {}
    have = set(df.columns)
    return df.withColumns({f.name: (F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in have else F.lit(defaults.get(f.name)).cast(f.dataType)) for f in schema.fields})


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it; a local one is set only where none is named, on a
    single machine."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = f"file:///tmp/signalloom-{os.getuid()}"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows with the lineage cut by a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_folders: dict[str, object] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The application's own folder for intermediate tables in the shared one; it is deleted when this process ends,
    or by drop_scratch()."""
    at = f"{shared_dir(spark).rstrip('/')}/tables-{spark.sparkContext.applicationId}"
    if at not in _folders:
        if not _folders:
            atexit.register(drop_scratch)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        _folders[at] = (path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path)
    return at


def drop_scratch() -> None:
    """Delete the intermediate tables written so far; results that read them must have been taken."""
    while _folders:
        files, path = _folders.popitem()[1]
        try:
            files.delete(path, True)
        except Exception:  # noqa: BLE001  the session may be gone
            pass


def written(df: DataFrame, name: str, *, partition_by: str | None = None) -> DataFrame:
    """The same rows, read back from Parquet in the application's folder; they outlive lost executors."""
    spark = df.sparkSession
    at = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(at)
    return spark.read.schema(df.schema).parquet(at)
