"""Streaming queries, each run over what there is."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadloom.plans.relational import _TOTALS, with_sql
from leadloom.streaming import daily, heartbeats, leases


def stream_daily_stats(spark, d):
    totals = daily.daily_totals(daily.submissions_stream(daily.events_stream(spark, d)))
    return daily.drain(totals, ["jst_date", "targeting_id"])


def _with_provider(spark, run):
    """run() with the state store that timers and expiring state need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, leases.PROVIDER)
    try:
        return run()
    finally:
        spark.conf.set(name, before)


def stream_lease_counts(spark, d):
    return _with_provider(spark, lambda: daily.drain(leases.lease_counts(daily.events_stream(spark, d)), ["owner"]))


def stream_silent_workers(spark, d):
    """worker, first, silent_from, beats: sessions of heartbeats that ended."""
    found = daily.drain(heartbeats.silent_workers(daily.events_stream(spark, d)), [], "append")
    return found.select("worker", F.col("first").cast("timestamp_ntz").alias("first"), F.col("silent_from").cast("timestamp_ntz").alias("silent_from"), "beats")


def stream_answers(spark, d):
    """worker, claim_id, end_id: claims with the completions that follow within an hour."""
    return daily.drain(heartbeats.answers(daily.events_stream(spark, d), daily.events_stream(spark, d)), [], "append")


def stream_unanswered(spark, d):
    """worker, claim_id of claims without a completion, once none can come any more."""
    both = daily.drain(heartbeats.answers(daily.events_stream(spark, d), daily.events_stream(spark, d), "left_outer"), [], "append")
    return both.where("end_id is null").select("worker", "claim_id")


def stream_without_repeats(spark, d):
    """event_id, user_id, event_type of events that come twice."""
    twice = daily.events_stream(spark, d).unionByName(daily.events_stream(spark, d))
    return daily.drain(heartbeats.without_repeats(twice), [], "append").select("event_id", "user_id", "event_type")


def stream_hourly_windows(spark, d):
    """Hours that the watermark has passed; the last ones are still open."""
    hours = daily.drain(daily.hourly_windows(daily.submissions_stream(daily.events_stream(spark, d))), [], "append")
    return hours.select(F.col("start").cast("timestamp_ntz").alias("start"), "total")


QUERIES = {
    f.__name__: f
    for f in (stream_daily_stats, stream_lease_counts, stream_hourly_windows, stream_silent_workers, stream_answers, stream_unanswered, stream_without_repeats)
}
# a lease that an event finds: over if it is older than an hour
_HELD, _OVER = "(case when a.lease >= 0 and x.moment - a.lease > 3600 then -1.0 else a.lease end)", "(a.lease >= 0 and x.moment - a.lease > 3600)"
_LEASES = f"""with e as (select user_id, event_id, epoch(ts) as t, case when event_type in ('view', 'click') then 'claim' when event_type = 'error' then 'failed' else 'done' end as k from events),
l as (select user_id, list(struct_pack(lease := -1.0::double, claims := 0::bigint, done := 0::bigint, failed := 0::bigint, expired := 0::bigint, refused := 0::bigint, moment := t::double, k := k) order by t, event_id) as es from e group by 1),
r as (select user_id, list_reduce(list_concat([struct_pack(lease := -1.0::double, claims := 0::bigint, done := 0::bigint, failed := 0::bigint, expired := 0::bigint, refused := 0::bigint, moment := 0::double, k := '')], es), lambda a, x: struct_pack(
  lease := case when x.k = 'claim' then case when {_HELD} < 0 then x.moment else {_HELD} end else -1.0 end,
  claims := a.claims + (x.k = 'claim' and {_HELD} < 0)::int, done := a.done + (x.k = 'done' and {_HELD} >= 0)::int, failed := a.failed + (x.k = 'failed' and {_HELD} >= 0)::int, expired := a.expired + {_OVER}::int,
  refused := a.refused + ((x.k = 'claim') = ({_HELD} >= 0))::int, moment := x.moment, k := x.k)) as s from l),
c as (select epoch(max(ts)) - 600 as clock from events)
select user_id as owner, s.claims as claims, s.done as done, s.failed as failed, s.expired + (s.lease >= 0 and clock - s.lease > 3600)::int as expired, s.refused as refused from r, c"""
_ENDED = "(select max(ts) from events) - interval 10 minute"
_PASSED = "(select least(max(ts) filter (where event_type in ('view', 'click')), max(ts) filter (where event_type in ('purchase', 'signup'))) from events) - interval 10 minute"
_CLAIMS = "c as (select event_id, user_id, ts from events where event_type in ('view', 'click')), e as (select event_id, user_id, ts from events where event_type in ('purchase', 'signup'))"
_NEAR = "e.user_id = c.user_id and e.ts >= c.ts and e.ts <= c.ts + interval 1 hour"
ORACLES = {
    "stream_lease_counts": _LEASES,
    "stream_silent_workers": f"""with g as (select user_id, ts, event_id, coalesce(ts > lag(ts) over w + interval 6 hour, true) as opens from events window w as (partition by user_id order by ts, event_id)),
s as (select user_id, ts, sum(opens::int) over (partition by user_id order by ts, event_id) as k from g)
select user_id as worker, min(ts) as first, max(ts) as silent_from, count(*) as beats from s group by user_id, k having max(ts) + interval 6 hour <= {_ENDED}""",
    "stream_answers": f"with {_CLAIMS} select c.user_id as worker, c.event_id as claim_id, e.event_id as end_id from c join e on {_NEAR}",
    "stream_unanswered": f"with {_CLAIMS} select c.user_id as worker, c.event_id as claim_id from c where not exists (select 1 from e where {_NEAR}) and c.ts + interval 1 hour < {_PASSED}",
    "stream_without_repeats": "select event_id, user_id, event_type from events",
    "stream_daily_stats": with_sql("submissions") + _TOTALS.replace("select targeting_id", "select cast(submitted_at + interval 9 hour as date) as jst_date, targeting_id") + " group by 1, 2",
    "stream_hourly_windows": "with h as (select date_trunc('hour', ts) as start, count(*) as total from events group by 1) select start, total from h where start + interval 1 hour <= (select max(ts) - interval 10 minute from events)",
}
