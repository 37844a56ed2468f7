"""The work queue as a state machine over snapshots: every step maps a queue to the next queue or to the rows that it hands out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.dates import between_days


def _ts(t: str) -> Column:
    return F.lit(t).cast("timestamp_ntz")


def capacity(queue, submissions, targeting_id, day, now, max_daily, grace_minutes=2) -> DataFrame:
    """One row: left_today, what the daily cap leaves: minus today's successes and the rows that are assigned for longer than the grace."""
    if max_daily > 10_000:
        raise ValueError("max_daily exceeds 10000")
    won = F.count_if((F.col("targeting_id") == targeting_id) & F.col("success") & between_days(F.col("submitted_at"), day, 0, 1))
    old = F.col("assigned_at").isNull() | (F.col("assigned_at") < _ts(now) - F.expr(f"interval {grace_minutes} minutes"))
    held = F.count_if((F.col("targeting_id") == targeting_id) & (F.col("status") == "assigned") & old)
    both = submissions.agg(won.alias("won")).crossJoin(F.broadcast(queue.agg(held.alias("held"))))  # a row each
    return both.select(F.greatest(F.lit(0), F.lit(max_daily) - F.col("won") - F.col("held")).alias("left_today"))


def claim(queue: DataFrame, targeting_id: int, limit: int, shard: int | None = None) -> DataFrame:
    """company_id, queue_id of the first pending rows by priority and id. One writer per targeting: see streaming.leases."""
    pending = queue.where((F.col("targeting_id") == targeting_id) & (F.col("status") == "pending"))
    if shard is not None:
        pending = pending.where(F.col("shard_id") == shard)
    return pending.orderBy("priority", "id").limit(limit).select("company_id", F.col("id").alias("queue_id"))


def assign(queue: DataFrame, claimed: DataFrame, run_id: str, now: str) -> DataFrame:
    """The queue with claimed rows assigned to a run."""
    hit = F.col("queue_id").isNotNull()
    marked = queue.join(claimed.select("queue_id"), F.col("id") == F.col("queue_id"), "left")
    return marked.withColumns({
        "status": F.when(hit, "assigned").otherwise(F.col("status")), "assigned_by": F.when(hit, run_id).otherwise(F.col("assigned_by")),
        "assigned_at": F.when(hit, _ts(now)).otherwise(F.col("assigned_at")),
    }).drop("queue_id")


def complete(queue: DataFrame, results: DataFrame) -> DataFrame:
    """The queue after results (id, run_id, success): only the owner, or anyone for a row without one, may end a row."""
    theirs = results.select(F.col("id").alias("rid"), F.col("run_id"), F.col("success").alias("won"))
    ends = F.col("rid").isNotNull() & (F.col("assigned_by").isNull() | (F.col("assigned_by") == F.col("run_id")))
    joined = queue.join(theirs, F.col("id") == F.col("rid"), "left")
    return joined.withColumns({
        "status": F.when(ends, F.when(F.col("won"), "done").otherwise("failed")).otherwise(F.col("status")),
        "attempts": F.when(ends, F.col("attempts") + 1).otherwise(F.col("attempts")),
    }).drop("rid", "run_id", "won")


def recorded(queue: DataFrame, results: DataFrame) -> DataFrame:
    """Results that become facts: the owner's, and those without a queue row."""
    owners = queue.select("id", "assigned_by", F.lit(True).alias("queued"))
    kept = F.col("queued").isNull() | F.col("assigned_by").isNull() | (F.col("assigned_by") == F.col("run_id"))
    return results.join(owners, "id", "left").where(kept).drop("assigned_by", "queued")


def requeue_stale(queue: DataFrame, now: str, minutes: int) -> DataFrame:
    """Assigned rows older than the limit are pending again."""
    stale = (F.col("status") == "assigned") & (F.col("assigned_at") < _ts(now) - F.expr(f"interval {minutes} minutes"))
    return queue.withColumns({
        "status": F.when(stale, "pending").otherwise(F.col("status")), "assigned_by": F.when(~F.coalesce(stale, F.lit(False)), F.col("assigned_by")),
        "assigned_at": F.when(~F.coalesce(stale, F.lit(False)), F.col("assigned_at")),
    })


def lock_pending(companies: DataFrame, limit: int) -> DataFrame:
    """The first companies without a URL that nobody works on."""
    return companies.where(F.col("company_url").isNull() & F.col("fetch_detail_queued").isNull()).orderBy("id").limit(limit).select("id", F.lit(True).alias("fetch_detail_queued"))


def reset_unprocessed(companies: DataFrame, processed: DataFrame | None, flag: str = "form_finder_queued") -> DataFrame:
    """Queued companies that were not processed lose the flag; without a list all do."""
    if processed is None:
        return companies.withColumn(flag, F.lit(None).cast("boolean"))
    done = companies.join(processed.select(F.col("id").alias("pid")).distinct(), F.col("id") == F.col("pid"), "left")
    return done.withColumn(flag, F.when(F.col("pid").isNotNull(), F.col(flag))).drop("pid")


def clear_stuck(companies: DataFrame, queued_at: Column, now: str, hours: int) -> DataFrame:
    """Analyzer flags older than some hours go."""
    stuck = F.col("form_analyzer_queued") & (queued_at < _ts(now) - F.expr(f"interval {hours} hours"))
    return companies.withColumn("form_analyzer_queued", F.when(~F.coalesce(stuck, F.lit(False)), F.col("form_analyzer_queued")))


def delete_tail(companies: DataFrame, last_id: int) -> DataFrame:
    """One row: deleted, kept, next_id."""
    kept = F.col("id") <= last_id
    return companies.agg(F.count_if(~kept).alias("deleted"), F.count_if(kept).alias("kept"), (F.coalesce(F.max(F.when(kept, F.col("id"))), F.lit(0)) + 1).alias("next_id"))


def clear_targeting(queue: DataFrame, targeting_id: int | None) -> tuple[DataFrame, DataFrame]:
    """(the queue without the targeting's rows, how many went)."""
    gone = F.lit(True) if targeting_id is None else F.col("targeting_id") == targeting_id
    return queue.where(~gone), queue.agg(F.count_if(gone).alias("cleared"))


def run_shard(run_base: int, task_index: Column, shards: int) -> tuple[Column, Column]:
    """(run_index, shard_index) of a batch task."""
    run = F.lit(run_base) + task_index + 1
    return run, F.pmod(run - 1, F.lit(shards))


def lock_key(targeting_id: Column, day: Column) -> Column:
    """The first 64 bits of md5('id:yyyymmdd'), as a signed number."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", targeting_id.cast("string"), F.date_format(day, "yyyyMMdd"))), 1, 16), 16, -10).cast("long")


def latest_executions(events: DataFrame) -> DataFrame:
    """Per (targeting_id, run_base): the last state; a terminal state stays, whatever follows."""
    terminal = F.col("status").isin("succeeded", "failed", "cancelled")
    ends = events.where(terminal).groupBy("targeting_id", "run_base").agg(F.min("ts").alias("first_end"))
    valid = events.join(ends, ["targeting_id", "run_base"], "left").where(F.col("first_end").isNull() | (F.col("ts") <= F.col("first_end")))
    last = F.struct("ts", "id")
    return valid.groupBy("targeting_id", "run_base").agg(F.max_by("status", last).alias("status"), F.count("*").alias("n_events"), F.max("ts").alias("last_ts"))


def worker_health(silent_s: Column, queue_size: Column, stopping: Column, timeout_s: int = 120) -> Column:
    return (
        F.when(stopping, "shutdown").when(silent_s > 2 * timeout_s, "unresponsive").when(silent_s > timeout_s, "degraded")
        .when(queue_size > 150, "backpressure").when(queue_size < 70, "healthy").otherwise("busy")
    )


def backoff(attempt: Column, base: float = 1.0, cap: float = 60.0) -> Column:
    """Seconds before the next try: doubles up to the cap (jitter is the caller's)."""
    return F.least(F.lit(cap), F.lit(base) * F.pow(F.lit(2.0), attempt))


def requeue_own(queue: DataFrame, failed: DataFrame) -> DataFrame:
    """The queue after checks (company_id, targeting_id, run_id, assigned_at or null) that failed: a run's own assigned row is pending again, if its lease is the one that the run had."""
    theirs = failed.select(F.col("company_id").alias("fc"), F.col("targeting_id").alias("ft"), F.col("run_id").alias("fr"), F.col("assigned_at").alias("fa"))
    own = (
        (F.col("company_id") == F.col("fc")) & (F.col("targeting_id") == F.col("ft")) & (F.col("status") == "assigned") & (F.col("assigned_by") == F.col("fr"))
        & (F.col("fa").isNull() | (F.col("assigned_at") == F.col("fa")))
    )
    back = F.col("fc").isNotNull()
    joined = queue.join(theirs, own, "left")
    return joined.withColumns({
        "status": F.when(back, "pending").otherwise(F.col("status")), "assigned_by": F.when(~back, F.col("assigned_by")), "assigned_at": F.when(~back, F.col("assigned_at")),
    }).drop("fc", "ft", "fr", "fa")


def jittered(wait: Column, key: Column, share: float = 0.2) -> Column:
    """The wait, more or less by up to a share of it, as a hash of the key says."""
    return wait * (1 + share * (2 * F.pmod(F.xxhash64(key), F.lit(10_001)) / 10_000.0 - 1))


def circuit(failures: Column, last_failure_s: Column, limit: int = 5, cool_s: int = 300) -> Column:
    """closed under the limit of failures in a row, open until the last one is long enough ago, then half_open."""
    return F.when(failures < limit, "closed").when(last_failure_s < cool_s, "open").otherwise("half_open")
