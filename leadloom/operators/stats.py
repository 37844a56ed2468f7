"""Statistics: funnels, rates, Japan days, minute slots and moving windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.functions.dates import between_days, to_jst


def rate(part: Column, whole: Column, digits: int = 2) -> Column:
    """Percent, half away from zero; 0 without rows."""
    exact = (part.cast("decimal(20,0)") * 100 / whole.cast("decimal(20,0)")).cast("decimal(30,10)")
    return F.when(whole > 0, F.round(exact, digits)).otherwise(F.lit(0)).cast("double")


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def company_funnel(companies: DataFrame) -> DataFrame:
    url, dup, black, prohibited = (F.col(c) for c in ("company_url", "duplication", "black", "prohibition_detected"))
    return companies.agg(
        F.count("*").alias("total_count"), F.count_if(url.isNotNull()).alias("with_company_url_count"),
        F.count_if(url.isNotNull() & F.col("form_found").isNull() & dup.isNull()).alias("form_not_explored_count"),
        F.count_if(F.col("form_found")).alias("with_form_url_count"),
        F.count_if(F.col("form_found") & prohibited.isNull() & dup.isNull() & black.isNull()).alias("valid_form_count"),
    )


def targeting_totals(submissions: DataFrame, day: str | None = None) -> DataFrame:
    """targeting_id, total, successes: of all time, or of a Japan day."""
    rows = submissions if day is None else submissions.where(between_days(F.col("submitted_at"), day, 0, 1))
    return rows.groupBy("targeting_id").agg(F.count("*").alias("total"), F.count_if("success").alias("successes"))


def zero_filled(ids: DataFrame, totals: DataFrame) -> DataFrame:
    return ids.join(totals, "targeting_id", "left").fillna(0, ["total", "successes"])


def sheet_rates(ids: DataFrame, all_time: DataFrame, today: DataFrame) -> DataFrame:
    """A row a targeting: totals and rates; inactive ones keep totals but blank today."""
    total = zero_filled(ids, all_time)
    now = today.select("targeting_id", F.col("total").alias("t_total"), F.col("successes").alias("t_won"))
    both = total.join(now, "targeting_id", "left").fillna(0, ["t_total", "t_won"])
    active = F.col("active")
    return both.select(
        "targeting_id", "active", "total", "successes", rate(F.col("successes"), F.col("total")).alias("success_rate"),
        F.when(active, F.col("t_total")).alias("today_total"), F.when(active, F.col("t_won")).alias("today_successes"),
        F.when(active, rate(F.col("t_won"), F.col("t_total"))).alias("today_rate"),
    )


def finder_progress(companies: DataFrame) -> DataFrame:
    counts = companies.where(F.col("company_url").isNotNull()).agg(
        F.count("*").alias("total"), F.count_if("form_found").alias("found"), F.count_if(F.col("form_found").isNull()).alias("pending")
    )
    return counts.withColumn("discovery_rate", rate(F.col("found"), F.col("total"), 1))


def processing_stats(companies: DataFrame) -> DataFrame:
    done = F.col("company_url").isNotNull() & (F.col("company_url") != "")
    return companies.agg(F.count("*").alias("total"), F.count_if(done).alias("completed"), F.count_if("fetch_detail_queued").alias("queued"))


def analyzer_stats(companies: DataFrame, stuck_hours: int = 200) -> DataFrame:
    found, waiting = F.col("form_url").isNotNull(), F.col("form_analyzer_queued")
    counts = companies.agg(
        F.count_if(found).alias("total"), F.count_if(found & F.col("instruction_json").isNull()).alias("pending"),
        F.count_if(found & waiting.isNull()).alias("not_queued"), F.count_if(waiting & (F.col("analyzer_queued_hours") < stuck_hours)).alias("stuck"),
    )
    share = lambda c: F.when(F.col("total") > 0, half_up(F.col(c) * 100.0 / F.col("total"))).otherwise(F.lit(0)).cast("long")
    return counts.withColumns({"pending_rate": share("pending"), "stuck_rate": share("stuck")})


def capped_count(rows: DataFrame, page: int = 1000, pages: int = 10) -> DataFrame:
    """n (exact) and n_paged, which a paged scan of at most pages * page rows reports."""
    return rows.agg(F.count("*").alias("n")).withColumn("n_paged", F.least("n", F.lit(page * pages)))


def minute_slots(samples: DataFrame) -> DataFrame:
    """slot, ts, stats: the last sample of each minute of the day (1,440 slots that later days overwrite)."""
    slot = F.hour(to_jst(F.col("ts"))) * 60 + F.minute(to_jst(F.col("ts")))
    return samples.groupBy(slot.alias("slot")).agg(F.max("ts").alias("ts"), F.max_by("total", F.struct("ts", "total")).alias("total"))


def minute_delta(samples: DataFrame, hours: int) -> DataFrame:
    """minute, total, delta: minus the total of the same minute some hours before, '-' if there is none."""
    minutes = samples.groupBy(F.date_trunc("minute", "ts").alias("minute")).agg(F.count("*").alias("total"))
    past = minutes.select((F.col("minute") + F.expr(f"interval {hours} hours")).alias("minute"), F.col("total").alias("before"))
    joined = minutes.join(past, "minute", "left")
    return joined.select("minute", "total", F.when(F.col("before").isNull(), "-").otherwise((F.col("total") - F.col("before")).cast("string")).alias("delta"))


def moving_stats(samples: DataFrame, key: str, order: list[str], value: str, n: int = 10) -> DataFrame:
    """The mean and maximum of the last n samples."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-(n - 1), 0)
    return samples.withColumns({"avg_n": F.avg(value).over(w), "max_n": F.max(value).over(w)})


def load_level(memory: Column, cpu: Column) -> Column:
    top = F.greatest(memory, cpu)
    return F.when(top >= 90, "critical").when(top >= 75, "high").when(top >= 40, "normal").otherwise("low")


def stable(samples: DataFrame, key: str, order: list[str], level: str, n: int = 3) -> DataFrame:
    """stable: the last n levels are the same, and there are as many."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-(n - 1), 0)
    same = (F.count("*").over(w) == n) & (F.min(level).over(w) == F.max(level).over(w))
    return samples.withColumn("stable", same)


def priority_batches(first: DataFrame, second: DataFrame, limit: int) -> DataFrame:
    """id, batch: ids of the first list, then of the second as far as the limit goes."""
    both = first.select("id", F.lit(1).alias("batch")).unionByName(second.join(first.select("id"), "id", "left_anti").select("id", F.lit(2).alias("batch")))
    return both.orderBy("batch", "id").limit(limit)


def status_counts(rows: DataFrame, statuses: list[str]) -> DataFrame:
    """targeting_id and a column a status."""
    return rows.groupBy("targeting_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in statuses])
