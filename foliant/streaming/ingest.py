"""Streams: incremental index upkeep by files, and windowed event counts with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.session import Stash


def latest_rows(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of each key the row with the largest ``order``; nulls come first, ties go to the smallest whole row."""
    rest = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(order, *(F.hash(F.col(c)) for c in rest))).alias("r"))
    return best.select(key, "r.*")


def ingest(spark: SparkSession, folder: str, target: str, checkpoint: str, key: str, order: str, glob: str = "*.parquet", files: int = 16) -> DataFrame:
    """Reads the files that came since the last call, once each, and keeps the latest row of every key in ``target``.

    Batches are appended to a log under the target; the checkpoint remembers which files were read, so a lost run goes on where it
    was, and a batch that runs again overwrites itself. Returns the latest rows.
    """
    schema = spark.read.option("pathGlobFilter", glob).parquet(folder).schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files).parquet(folder)

    def keep(batch: DataFrame, number: int) -> None:
        latest_rows(batch, key, order).write.mode("overwrite").parquet(f"{target}/batch={number}")

    query = source.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return latest_rows(spark.read.parquet(target).drop("batch"), key, order)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, value_sum) of tumbling windows; on a stream, events later than the watermark are dropped."""
    counted = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value_sum"))
    return counted.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "value_sum")


def stream_counts(spark: SparkSession, folder: str, width: str = "1 hour", late: str = "3650 days") -> DataFrame:
    """The windowed counts of a folder's events, computed as a stream to its present end."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    stash = Stash(spark)
    out = f"{stash.root}/counts"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    counted = windowed_counts(source, width, late)
    query = counted.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{stash.root}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out)


def sessions(events: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """(user_id, session_no, begin, finish, n): a user's events, a pause of more than the gap ends a session."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    pause = micros - F.lag(micros).over(order) > gap_minutes * 60_000_000
    marked = events.where("user_id is not null and ts is not null").withColumn("_new", F.coalesce(pause.cast("int"), F.lit(1)))
    numbered = marked.withColumn("session_no", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("user_id", "session_no").agg(F.min("ts").alias("begin"), F.max("ts").alias("finish"), F.count("*").alias("n"))
