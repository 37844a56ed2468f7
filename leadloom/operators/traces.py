"""Judgement traces: hit rates, stage statistics, bottlenecks and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hit_rates(checks: DataFrame, top: int = 5) -> DataFrame:
    """pattern, checked, matched, hit_rate: the most often matched patterns."""
    counts = checks.groupBy("pattern").agg(F.count("*").alias("checked"), F.count_if("matched").alias("matched"))
    return counts.withColumn("hit_rate", F.col("matched") / F.col("checked")).orderBy(F.desc("matched"), "pattern").limit(top)


def stage_stats(stages: DataFrame) -> DataFrame:
    """stage, n, avg_ms (of an exact sum to six digits), max_ms, slowest_trace."""
    total = F.sum(F.col("ms").cast("decimal(18,6)")).cast("double")
    return stages.groupBy("stage").agg(
        F.count("*").alias("n"), (total / F.count("*")).alias("avg_ms"), F.max("ms").alias("max_ms"), F.max_by("trace_id", F.struct("ms", (-F.col("trace_id")).alias("t"))).alias("slowest_trace")
    )


def bottlenecks(stages: DataFrame) -> DataFrame:
    """Stages that took over twice the mean of their trace; severe at three times."""
    mean = stages.groupBy("trace_id").agg(F.avg("ms").alias("mean_ms"))
    slow = stages.join(mean, "trace_id").where(F.col("ms") > 2 * F.col("mean_ms"))
    return slow.withColumn("severity", F.when(F.col("ms") > 3 * F.col("mean_ms"), "high").otherwise("medium"))


def efficiency(ms: Column, stages: Column, errors: Column) -> Column:
    """100 minus penalties for time, stages and errors, not below 0."""
    return F.greatest(F.lit(0.0), 100.0 - F.least(F.lit(50.0), ms / 100.0) - F.greatest(F.lit(0), stages - 3) * 5.0 - errors * 10.0)
