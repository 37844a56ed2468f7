"""Workers as streams: sessions of heartbeats, claims and their completions, and repeats.

Watermarks are our choice, as the batch jobs have none. Each stream, drained, gives what a batch over the same rows gives, as far as its watermark has come.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.streaming.daily import WATERMARK

#: A worker that is silent for so long has stopped; a completion belongs to a claim up to so long before it.
SILENCE, ANSWER = "6 hours", "1 hour"
CLAIMS, ENDS = ("view", "click"), ("purchase", "signup")


def _timed(events: DataFrame, name: str = "moment") -> DataFrame:
    return events.withColumn(name, F.col("ts").cast("timestamp")).withWatermark(name, WATERMARK)


def silent_workers(events: DataFrame, silence: str = SILENCE) -> DataFrame:
    """worker, first, silent_from, beats: sessions that ended, once the watermark has passed them."""
    sessions = _timed(events).groupBy(F.col("user_id").alias("worker"), F.session_window("moment", silence).alias("s")).agg(F.count("*").alias("beats"), F.max("moment").alias("last"))
    return sessions.select("worker", F.col("s.start").alias("first"), F.col("last").alias("silent_from"), "beats")


def _sides(claims: DataFrame, ends: DataFrame) -> tuple[DataFrame, DataFrame]:
    left = _timed(claims.where(F.col("event_type").isin(*CLAIMS)), "claimed").select("claimed", F.col("user_id").alias("worker"), F.col("event_id").alias("claim_id"))
    right = _timed(ends.where(F.col("event_type").isin(*ENDS)), "ended").select("ended", F.col("user_id").alias("of_worker"), F.col("event_id").alias("end_id"))
    return left, right


def answers(claims: DataFrame, ends: DataFrame, how: str = "inner", within: str = ANSWER) -> DataFrame:
    """worker, claim_id, end_id of claims and the completions that follow within a time; "left_outer" gives claims without one, too, when none can come any more."""
    left, right = _sides(claims, ends)
    near = (F.col("worker") == F.col("of_worker")) & (F.col("ended") >= F.col("claimed")) & (F.col("ended") <= F.col("claimed") + F.expr(f"interval {within}"))
    return left.join(right, near, how).select("worker", "claim_id", "end_id")


def without_repeats(events: DataFrame, key: str = "event_id") -> DataFrame:
    """Events that are delivered several times, once; an id is remembered until the watermark has passed its event."""
    return _timed(events).dropDuplicatesWithinWatermark([key]).drop("moment")
