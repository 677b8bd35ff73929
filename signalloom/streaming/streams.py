"""Streams over the event tables: sums by day, events once each, last states, a running limit."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import scratch_dir


def read_stream(spark: SparkSession, path: str, time: str, *, files_per_batch: int = 64) -> DataFrame:
    """A folder of Parquet files, or one file, as a stream; the schema is that of what is there now."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        folder, _, name = path.rpartition("/")
        df = reader.option("pathGlobFilter", name).parquet(folder)
    else:
        df = reader.parquet(path)
    return df.withColumn(time, F.col(time).cast("timestamp"))


def unique_events(events: DataFrame, key: str, time: str, late: str = "1 day") -> DataFrame:
    """Each event once, as long as its copies come within the lateness allowed."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def daily_sums(events: DataFrame, time: str, value: str, late: str = "1 day") -> DataFrame:
    """(day, n, total) of tumbling UTC days; decimal sums don't depend on the order of batches."""
    days = events.withWatermark(time, late).groupBy(F.window(time, "1 day"))
    return days.agg(F.count("*").alias("n"), F.sum(F.col(value).cast("decimal(18,4)")).cast("double").alias("total")).select(F.col("window.start").cast("date").alias("day"), "n", "total")


def sessions(events: DataFrame, user: str, time: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """(user, start, end, n): a user's events with pauses shorter than the gap."""
    grouped = events.withWatermark(time, late).groupBy(user, F.session_window(time, gap).alias("w"))
    return grouped.agg(F.count("*").alias("n")).select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def last_states(events: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """(key, time, value): the latest value of each key, for update mode; ties go to the larger value.  State holds one row
    for each key."""
    best = F.max(F.struct(time, value))
    return events.groupBy(key).agg(best.alias("b")).select(key, F.col(f"b.{time}").alias(time), F.col(f"b.{value}").alias(value))


def lateness(events: DataFrame, key: str, time: str) -> str:
    """How far apart deliveries of one event lie at most in a table, as an interval for unique_events()."""
    spans = events.where(F.col(time).isNotNull()).groupBy(key).agg((F.unix_micros(F.max(F.col(time).cast("timestamp"))) - F.unix_micros(F.min(F.col(time).cast("timestamp")))).alias("s"))
    most = spans.agg(F.max("s")).first()[0] or 0
    return f"{most // 1_000_000 + 1} seconds"


def apply_batches(stream: DataFrame, store: str, merge: Callable[[DataFrame, DataFrame], DataFrame], checkpoint: str, *, mode: str = "append"):
    """Run a stream into a versioned Parquet table: each batch is merged with the last version into a new folder.

    A batch that is run again after a failure finds its version written and leaves it."""

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        target, before = f"{store}/v={number}", f"{store}/v={number - 1}"
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        files = hadoop(store).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if files.exists(hadoop(f"{target}/_SUCCESS")):
            return
        old = spark.read.parquet(before) if files.exists(hadoop(f"{before}/_SUCCESS")) else batch.limit(0)
        merge(old, batch).write.mode("overwrite").parquet(target)

    return stream.writeStream.foreachBatch(one).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest(old: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """For apply_batches(): each key's row with the largest `order` columns."""
    both = old.unionByName(new)
    return both.groupBy(key).agg(F.max_by(F.struct(*both.columns), F.struct(*order)).alias("r")).select("r.*")


def status_of(old: DataFrame, new: DataFrame, key: str, time: str, state: str) -> DataFrame:
    """For apply_batches(): (key, time, state, error) where success clears the error; new rows have no more than these."""
    return newest(old, new.withColumn("error", F.when(F.col(state) == "failed", F.substring(F.coalesce("error", F.lit("")), 1, 1000))), key, [time, state])


def current(spark: SparkSession, store: str) -> DataFrame:
    """The last version of a table that apply_batches() keeps."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    versions = [f.getPath().getName() for f in files.listStatus(hadoop)]
    done = [int(v[2:]) for v in versions if v.startswith("v=") and files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{store}/{v}/_SUCCESS"))]
    return spark.read.parquet(f"{store}/v={max(done)}")


def drained(stream: DataFrame) -> DataFrame:
    """All that a stream in append mode gives on what is there now, as Parquet in the application's folder; nothing passes
    through the driver."""
    at = f"{scratch_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/rows")


def kept(stream: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    """The table that apply_batches() makes of what is there now."""
    at = f"{scratch_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    apply_batches(stream, f"{at}/store", merge, f"{at}/checkpoint", mode=mode).awaitTermination()
    return current(stream.sparkSession, f"{at}/store")


def updated(stream: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key that a stream in update mode gives on what is there now."""
    return kept(stream, lambda old, new: newest(old, new, key, order), "update")
