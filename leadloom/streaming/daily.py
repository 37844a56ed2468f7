"""Submissions as a stream: statistics by Japan day and targeting. The watermark is our choice; there is none in the batch jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.functions.dates import jst_date
from leadloom.sources import files
from leadloom.sources.views import SUBMISSION_RULES, table

WATERMARK = "10 minutes"


def events_stream(spark: SparkSession, sf_dir: str, files: int = 1) -> DataFrame:
    """events.parquet as a file stream."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def submissions_stream(events: DataFrame) -> DataFrame:
    rows = events.select(*[F.expr(e).alias(c) for c, e in SUBMISSION_RULES.items()])
    return rows.withColumn("submitted_at", F.col("submitted_at").cast("timestamp")).withWatermark("submitted_at", WATERMARK)


def daily_totals(submissions: DataFrame) -> DataFrame:
    """jst_date, targeting_id, total, successes."""
    day = jst_date(F.col("submitted_at").cast("timestamp_ntz"))
    return submissions.groupBy(day.alias("jst_date"), "targeting_id").agg(F.count("*").alias("total"), F.count_if("success").alias("successes"))


def hourly_windows(submissions: DataFrame) -> DataFrame:
    """start, total for each hour; emitted once the watermark has passed it."""
    hours = submissions.groupBy(F.window("submitted_at", "1 hour")).agg(F.count("*").alias("total"))
    return hours.select(F.col("window.start").alias("start"), "total")


def drain(stream: DataFrame, keys: list[str], mode: str = "update") -> DataFrame:
    """Run a stream over what there is, write each batch to the shared folder, and read the latest row of each key.

    No row passes through the driver; a batch that runs again overwrites itself.
    """
    spark = stream.sparkSession
    path = f"{files.shared_folder(spark)}/stream-{uuid.uuid4().hex[:12]}"
    batch = "__batch"

    def write(df: DataFrame, number: int) -> None:
        df.withColumn(batch, F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/batches/{number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    schema = stream.schema
    if query.lastProgress is None:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(stream.withColumn(batch, F.lit(0).cast("long")).schema).parquet(f"{path}/batches/*")
    if not keys:
        return rows.drop(batch)
    rest = F.struct(*[c for c in schema.fieldNames() if c not in keys])
    latest = rows.groupBy(*keys).agg(F.max_by(rest, batch).alias("r"))
    return latest.select(*[F.col(c) if c in keys else F.col(f"r.{c}").alias(c) for c in schema.fieldNames()])
