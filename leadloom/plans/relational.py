"""Relational queries: targeting, queue, upserts, statistics. QUERIES by name; ORACLES states the same for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadloom.functions import dates
from leadloom.operators import queue_state, stats, targeting, traces, upserts
from leadloom.sources.views import companies, companies_extra, send_queue, submissions, table, with_sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
DAYS = {"early": "2024-01-25", "mid": "2024-02-20", "late": "2024-03-15"}
#: The second stage has candidates only once the last success or try of a company is old enough.
RETRY_DAYS = {"early": "2024-03-01", "mid": "2024-03-03", "late": "2024-03-15"}
TARGETING, LIMIT, TENANT_TARGETING = 1, targeting.LIMIT, 40


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return add


# ---- targeting and the queue -------------------------------------------------------------------------------------------
ELIGIBLE = "form_url is not null and black is null and coalesce(prohibition_detected, false) = false and duplication is null"
NAMES = " and ".join(f"company_name not like '%{w}%'" for w in targeting.NAME_POLICY)


def _span(day: str, first: int, last: int) -> str:
    start = f"timestamp '{day} 00:00:00' - interval 9 hour"
    return f"submitted_at >= {start} + interval ({first}) day and submitted_at < {start} + interval ({last}) day"


def _fresh(day: str, days: int | None, extra: str = "true", source: str = "companies", tid: int = TARGETING) -> str:
    failed = "" if days is None else f" and id not in (select company_id from submissions where {_span(day, -days, 1)} and coalesce(success, false) = false)"
    return f"select id from {source} where {ELIGIBLE} and {NAMES} and {extra} and id not in (select company_id from submissions where targeting_id = {tid}){failed}"


def _retry(day: str, days: int | None, tid: int = TARGETING) -> str:
    failed = "" if days is None else f" and id not in (select company_id from submissions where {_span(day, -days, 1)} and coalesce(success, false) = false)"
    return (
        f"select id from companies where {ELIGIBLE} and {NAMES} and id in (select company_id from submissions where targeting_id = {tid} group by 1 "
        f"having not coalesce(bool_or(success), false) and not bool_or({_span(day, -14, 1)})){failed}"
    )


def _ranked(inner: str, day: str, limit: str, base: str = "0", tid: int = TARGETING) -> str:
    return (
        f"select date '{day}' as target_date_jst, cast({tid} as bigint) as targeting_id, id as company_id, cast({base} + row_number() over (order by id) as int) as priority, "
        f"cast(id % 8 as int) as shard_id, 'pending' as status, 0 as attempts from ({inner} order by id limit {limit})"
    )


for _tag, _day in DAYS.items():
    _again = RETRY_DAYS[_tag]

    def _stage1(spark, d, day=_day):
        return targeting.ranked(targeting.fresh_candidates(companies(spark, d), submissions(spark, d), TARGETING, day), TARGETING, day, LIMIT)

    def _stage2(spark, d, day=_again):
        return targeting.ranked(targeting.retry_candidates(companies(spark, d), submissions(spark, d), TARGETING, day), TARGETING, day, LIMIT)

    query(with_sql("companies", "submissions") + _ranked(_fresh(_day, 30), _day, str(LIMIT)), f"queue_stage1_{_tag}")(_stage1)
    query(with_sql("companies", "submissions") + _ranked(_retry(_again, 30), _again, str(LIMIT)), f"queue_stage2_{_tag}")(_stage2)

_LATE = DAYS["late"]


@query(
    with_sql("companies", "submissions")
    + f", one as ({_ranked(_fresh(_LATE, 30), _LATE, '10000')}), two as ({_ranked(_retry(_LATE, 30), _LATE, '(select 10000 - count(*) from one)', '(select coalesce(max(priority), 0) from one)')}) "
    "select * from one union all select * from two"
)
def queue_full(spark, d):
    return targeting.build_queue(companies(spark, d), submissions(spark, d), TARGETING, _LATE)


@query(with_sql("companies_extra", "submissions") + _ranked(_fresh("2024-02-07", 7, "client = 'client_1'", "companies_extra", TENANT_TARGETING), "2024-02-07", "100", tid=TENANT_TARGETING))
def queue_extra_7d(spark, d):
    tenant = companies_extra(spark, d).where(F.col("client") == "client_1")
    rows = targeting.fresh_candidates(tenant, submissions(spark, d), TENANT_TARGETING, "2024-02-07", failure_days=7)
    return targeting.ranked(rows, TENANT_TARGETING, "2024-02-07", 100)


@query(
    with_sql("companies", "submissions") + f", w as ({_fresh(_LATE, 30, 'id > 100 and id <= 700')} order by id limit 150) "
    "select count(*) as inserted, coalesce(max(id), 700) as last_id, (count(*) = 150 or coalesce(max(id), 0) >= 700) as has_more from w"
)
def queue_step_window(spark, d):
    return targeting.build_window(companies(spark, d), submissions(spark, d), TARGETING, _LATE, 100, 600, 150)


@query(
    with_sql("companies", "submissions", "send_queue")
    + f", held as (select distinct company_id from send_queue where targeting_id = {TARGETING}) "
    f"select * from ({_ranked(_fresh(_LATE, 30), _LATE, str(LIMIT))}) where company_id not in (select company_id from held)"
)
def queue_insert_ignore(spark, d):
    held = send_queue(spark, d).where(F.col("targeting_id") == TARGETING).select(F.lit(_LATE).cast("date").alias("target_date_jst"), "targeting_id", "company_id").distinct()
    rows = targeting.ranked(targeting.fresh_candidates(companies(spark, d), submissions(spark, d), TARGETING, _LATE), TARGETING, _LATE, LIMIT)
    return targeting.insert_new(rows, held)


_LEGACY = "form_url is not null and instruction_json is not null and (instruction_valid is null or instruction_valid) and bot_protection_detected is null and id >= 10"


@query(
    with_sql("companies") + f"select id, company_name, form_url, instruction_json, instruction_valid from companies where {_LEGACY} "
    "and (capital > 1000 and prefecture <> 'CHINA') and not regexp_matches(company_name, '00000001|医療') and id not in (22, 34, 46) order by id limit 300"
)
def target_companies_sql(spark, d):
    return targeting.target_companies(companies(spark, d), 10, 300, "WHERE capital > 1000 and prefecture <> 'CHINA'", "00000001，医療", [22, 34, 46])


@query(
    with_sql("companies", "submissions")
    + f", h as (select company_id, bool_or(success) as won, bool_or(not success) as lost from submissions where targeting_id = {TARGETING} group by 1) "
    f"select id, company_name, form_url, case when company_id is null then 0 else 1 end as contacted from companies left join h on id = company_id where {_LEGACY} "
    "and (company_id is null or (won = false and (true or lost = false))) order by contacted, id limit 400"
)
def target_companies_with_history(spark, d):
    return targeting.target_companies_with_history(companies(spark, d), submissions(spark, d), TARGETING, 10, 400)


@query(with_sql("companies") + f"select id, company_name from companies where {ELIGIBLE} and {NAMES} and not (company_name in ('Customer#000000011', 'Customer#000000021'))")
def deny_list_exact(spark, d):
    df = companies(spark, d)
    return df.where(targeting.eligible() & targeting.name_allowed() & targeting.not_denied("Customer#000000011， Customer#000000021")).select("id", "company_name")


_STEPS = [
    ("step1_total", "true"), ("step2_form_url", "form_url is not null"), ("step3_instruction", "instruction_json is not null"),
    ("step4_valid", "(instruction_valid is null or instruction_valid)"), ("step5_bot", "bot_protection_detected is null"),
    ("step6_start", "id >= 50"), ("step7_employees", "employee_count < 200"), ("step8_black", "black is null"),
]


@query(
    with_sql("companies")
    + " union all ".join(f"select '{n}' as step, count(*) as n from companies where {' and '.join(s for _, s in _STEPS[: k + 1])}" for k, (n, _) in enumerate(_STEPS))
)
def waterfall_counts(spark, d):
    return targeting.waterfall(companies(spark, d), [(n, F.expr(s)) for n, s in _STEPS])


_CHECKS = [
    ("total_companies", "true"), ("with_form_url", "form_url is not null"), ("instruction_valid_null", "instruction_valid is null"),
    ("instruction_valid_true", "instruction_valid"), ("instruction_valid_false", "not instruction_valid"), ("bot_protection_true", "bot_protection_detected"),
    ("employee_count_under_100", "employee_count < 100"), ("employee_count_null", "employee_count is null"),
]


@query(
    with_sql("companies")
    + " union all ".join(
        f"select '{n}' as check_name, count(*) as n, (select string_agg(cast(id as varchar), ',' order by id) from (select id from companies where {s} order by id limit 5)) as sample_ids from companies where {s}"
        for n, s in _CHECKS
    )
)
def column_profile(spark, d):
    return targeting.profile(companies(spark, d), [(n, F.expr(s)) for n, s in _CHECKS])


# ---- queue state ------------------------------------------------------------------------------------------------------
@query(with_sql("send_queue") + "select company_id, id as queue_id from send_queue where targeting_id = 3 and status = 'pending' and shard_id = 3 order by priority, id limit 50")
def claim_topk(spark, d):
    return queue_state.claim(send_queue(spark, d), 3, 50, 3)


_STATES = "select id, targeting_id, company_id, status, assigned_by, assigned_at, attempts from q"


def _states(queue):
    return queue.select("id", "targeting_id", "company_id", "status", "assigned_by", "assigned_at", "attempts")


@query(
    with_sql("send_queue") + ", c as (select id as cid from send_queue where targeting_id = 3 and status = 'pending' order by priority, id limit 50), "
    "q as (select id, targeting_id, company_id, case when cid is not null then 'assigned' else status end as status, case when cid is not null then 'run-9' else assigned_by end as assigned_by, "
    "case when cid is not null then timestamp '2024-01-10 00:00:00' else assigned_at end as assigned_at, attempts from send_queue left join c on id = cid) " + _STATES
)
def claim_assign(spark, d):
    q = send_queue(spark, d)
    return _states(queue_state.assign(q, queue_state.claim(q, 3, 50), "run-9", "2024-01-10 00:00:00"))


_RESULTS = "r as (select o_orderkey as rid, 'run-' || cast(o_orderkey % 3 as varchar(20)) as run_id, o_totalprice > 150000 as won from orders where o_orderkey % 5 = 0)"


def _results(spark, d):
    o = table(spark, d, "orders").where("o_orderkey % 5 = 0")
    return o.select(F.col("o_orderkey").alias("id"), F.expr("'run-' || cast(o_orderkey % 3 as varchar(20))").alias("run_id"), (F.col("o_totalprice") > 150000).alias("success"))


@query(
    with_sql("send_queue") + f", {_RESULTS}, q as (select id, targeting_id, company_id, case when ok then case when won then 'done' else 'failed' end else status end as status, assigned_by, assigned_at, case when ok then attempts + 1 else attempts end as attempts "
    "from (select *, rid is not null and (assigned_by is null or assigned_by = run_id) as ok from send_queue left join r on id = rid)) " + _STATES
)
def mark_done_apply(spark, d):
    return _states(queue_state.complete(send_queue(spark, d), _results(spark, d)))


@query(with_sql("send_queue") + f", {_RESULTS} select rid as id, run_id, won as success from r left join send_queue q on q.id = rid where q.id is null or assigned_by is null or assigned_by = run_id")
def mark_done_facts(spark, d):
    return queue_state.recorded(send_queue(spark, d), _results(spark, d))


_NOW = "2024-01-20 00:00:00"


@query(
    with_sql("send_queue") + f", q as (select id, targeting_id, company_id, case when stale then 'pending' else status end as status, case when not coalesce(stale, false) then assigned_by end as assigned_by, "
    "case when not coalesce(stale, false) then assigned_at end as assigned_at, attempts "
    f"from (select *, status = 'assigned' and assigned_at < timestamp '{_NOW}' - interval 60 minute as stale from send_queue)) " + _STATES
)
def requeue_stale(spark, d):
    return _states(queue_state.requeue_stale(send_queue(spark, d), _NOW, 60))


@query(with_sql("companies") + "select id, true as fetch_detail_queued from companies where company_url is null and fetch_detail_queued is null order by id limit 40")
def lock_pending_batch(spark, d):
    return queue_state.lock_pending(companies(spark, d), 40)


@query(with_sql("companies") + "select form_finder_queued, count(*) as n from (select case when id in (select user_id from events) then form_finder_queued end as form_finder_queued from companies) group by 1")
def reset_unprocessed(spark, d):
    done = table(spark, d, "events").select(F.col("user_id").alias("id"))
    return queue_state.reset_unprocessed(companies(spark, d), done).groupBy("form_finder_queued").agg(F.count("*").alias("n"))


@query(with_sql("companies") + "select count(*) filter (where id > 900) as deleted, count(*) filter (where id <= 900) as kept, coalesce(max(case when id <= 900 then id end), 0) + 1 as next_id from companies")
def delete_tail(spark, d):
    return queue_state.delete_tail(companies(spark, d), 900)


@query(with_sql("send_queue") + "select count(*) filter (where targeting_id = 4) as cleared from send_queue")
def clear_targeting(spark, d):
    return queue_state.clear_targeting(send_queue(spark, d), 4)[1]


@query(
    "with e as (select event_id as id, user_id % 50 as targeting_id, user_id % 3 as run_base, ts, case event_type when 'purchase' then 'succeeded' when 'error' then 'failed' when 'signup' then 'cancelled' else 'running' end as status from events), "
    "f as (select *, min(case when status in ('succeeded', 'failed', 'cancelled') then ts end) over (partition by targeting_id, run_base) as fe from e) "
    "select targeting_id, run_base, arg_max(status, (ts, id)) as status, count(*) as n_events, max(ts) as last_ts from f where fe is null or ts <= fe group by 1, 2"
)
def execution_latest(spark, d):
    status = F.expr("case event_type when 'purchase' then 'succeeded' when 'error' then 'failed' when 'signup' then 'cancelled' else 'running' end")
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.expr("user_id % 50").alias("targeting_id"), F.expr("user_id % 3").alias("run_base"), "ts", status.alias("status"))
    return queue_state.latest_executions(e)


@query("select o_orderkey as task, cast(100 + o_orderkey % 64 + 1 as int) as run_index, cast((100 + o_orderkey % 64) % 8 as int) as shard_index from orders")
def shard_maths(spark, d):
    run, shard = queue_state.run_shard(100, F.col("o_orderkey") % 64, 8)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("task"), run.cast("int").alias("run_index"), shard.cast("int").alias("shard_index"))


@query(
    "select event_id, case when event_type = 'signup' then 'shutdown' when value > 240 then 'unresponsive' when value > 120 then 'degraded' when user_id % 200 > 150 then 'backpressure' "
    "when user_id % 200 < 70 then 'healthy' else 'busy' end as health from events"
)
def worker_health(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", queue_state.worker_health(F.col("value"), F.expr("user_id % 200"), F.col("event_type") == "signup").alias("health"))


@query("select s_suppkey, least(60.0, 1.0 * pow(2.0, s_suppkey % 10)) as wait_s from supplier")
def backoff_schedule(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", queue_state.backoff(F.expr("s_suppkey % 10")).alias("wait_s"))


# ---- upserts ----------------------------------------------------------------------------------------------------------
_CHANGES = "ch as (select s_suppkey as id, case when s_suppkey % 3 = 0 then null when s_suppkey % 3 = 1 then '' else 'https://new' || cast(s_suppkey as varchar(20)) end as company_url, case when s_suppkey % 2 = 0 then cast(floor(s_acctbal) as bigint) end as capital from supplier)"


def _changes(spark, d):
    return table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("id"), F.expr("case when s_suppkey % 3 = 0 then null when s_suppkey % 3 = 1 then '' else 'https://new' || cast(s_suppkey as varchar(20)) end").alias("company_url"),
        F.expr("case when s_suppkey % 2 = 0 then cast(floor(s_acctbal) as bigint) end").alias("capital"),
    )


@query(with_sql("companies") + f", {_CHANGES} select c.id, coalesce(nullif(ch.company_url, ''), c.company_url) as company_url, coalesce(ch.capital, c.capital) as capital from companies c left join ch on c.id = ch.id")
def coalesce_update(spark, d):
    return upserts.coalesce_update(companies(spark, d), _changes(spark, d), "id", ["company_url", "capital"], blank_keeps=True).select("id", "company_url", "capital")


@query(with_sql("companies") + f", {_CHANGES} select id, company_url, capital from companies where id not in (select id from ch) union all select id, company_url, capital from ch")
def bulk_upsert(spark, d):
    return upserts.upsert(companies(spark, d).select("id", "company_url", "capital"), _changes(spark, d), "id")


@query(with_sql("companies") + f", {_CHANGES} select ch.id, ch.company_url as expected, c.company_url as actual from ch left join companies c on c.id = ch.id where ch.company_url is distinct from c.company_url")
def upsert_verify(spark, d):
    return upserts.differences(companies(spark, d), _changes(spark, d), "id", "company_url")


@query(
    with_sql("companies") + f", {_CHANGES}, r as (select count(*) filter (where c.id is not null) as processed, count(*) filter (where c.id is null) as missing from ch left join companies c on c.id = ch.id) "
    "select processed, missing, cast(round(processed * 100.0 / (processed + missing), 2) as double) as success_rate, round(processed * 100.0 / (processed + missing), 2) >= 70 as success from r"
)
def update_report(spark, d):
    return upserts.update_report(companies(spark, d), _changes(spark, d), "id")


_FOUND = "f as (select page_id as id, case page_id % 4 when 0 then null when 1 then 'about:blank' else url end as url from pages)"


@query(
    with_sql("companies") + f", {_FOUND}, j as (select c.id, c.form_url as old, f.url, coalesce(trim(f.url) <> '' and length(trim(f.url)) <= 2048 and (trim(f.url) like 'http://%' or trim(f.url) like 'https://%') and f.url not like '%about:%', false) as ok from companies c join f on c.id = f.id) "
    "select id, ok as form_found, case when ok then url else old end as form_url, cast(null as boolean) as form_finder_queued from j"
)
def bulk_form_success(spark, d):
    found = table(spark, d, "pages").select(F.col("page_id").alias("id"), F.expr("case page_id % 4 when 0 then null when 1 then 'about:blank' else url end").alias("url"))
    return upserts.apply_form_urls(companies(spark, d), found)


# ---- statistics -------------------------------------------------------------------------------------------------------
@query(
    with_sql("companies") + "select count(*) as total_count, count(company_url) as with_company_url_count, count(*) filter (where company_url is not null and form_found is null and duplication is null) as form_not_explored_count, "
    "count(*) filter (where form_found) as with_form_url_count, count(*) filter (where form_found and prohibition_detected is null and duplication is null and black is null) as valid_form_count from companies"
)
def companies_funnel(spark, d):
    return stats.company_funnel(companies(spark, d))


_TOTALS = "select targeting_id, count(*) as total, count(*) filter (where success) as successes from submissions"


@query(with_sql("submissions") + f"{_TOTALS} group by 1")
def targeting_stats_all(spark, d):
    return stats.targeting_totals(submissions(spark, d))


_TODAY = "2024-01-15"


@query(with_sql("submissions") + f"{_TOTALS} where {_span(_TODAY, 0, 1)} group by 1")
def targeting_stats_today(spark, d):
    return stats.targeting_totals(submissions(spark, d), _TODAY)


_RATE = "case when {1} > 0 then cast(round(cast({0} as decimal(20, 0)) * 100 / {1}, 2) as double) else 0.0 end"


@query(
    with_sql("submissions") + f", ids as (select cast(n_nationkey as bigint) as targeting_id, n_nationkey % 3 <> 0 as active from nation), a as ({_TOTALS} group by 1), t as ({_TOTALS} where {_span(_TODAY, 0, 1)} group by 1), "
    "j as (select ids.*, coalesce(a.total, 0) as total, coalesce(a.successes, 0) as successes, coalesce(t.total, 0) as tt, coalesce(t.successes, 0) as tw from ids left join a using (targeting_id) left join t using (targeting_id)) "
    f"select targeting_id, active, total, successes, {_RATE.format('successes', 'total')} as success_rate, case when active then tt end as today_total, case when active then tw end as today_successes, case when active then {_RATE.format('tw', 'tt')} end as today_rate from j"
)
def targeting_sheet_rates(spark, d):
    ids = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("targeting_id"), F.expr("n_nationkey % 3 <> 0").alias("active"))
    s = submissions(spark, d)
    return stats.sheet_rates(ids, stats.targeting_totals(s), stats.targeting_totals(s, _TODAY))


@query(
    with_sql("companies") + ", c as (select count(*) as total, count(*) filter (where form_found) as found, count(*) filter (where form_found is null) as pending from companies where company_url is not null) "
    "select *, case when total > 0 then cast(round(cast(found as decimal(20, 0)) * 100 / total, 1) as double) else 0.0 end as discovery_rate from c"
)
def form_finder_progress(spark, d):
    return stats.finder_progress(companies(spark, d))


@query(with_sql("companies") + "select count(*) as total, count(*) filter (where company_url <> '') as completed, count(*) filter (where fetch_detail_queued) as queued from companies")
def processing_stats(spark, d):
    return stats.processing_stats(companies(spark, d))


@query(
    with_sql("companies") + ", c as (select count(form_url) as total, count(*) filter (where form_url is not null and instruction_json is null) as pending, count(*) filter (where form_url is not null and form_analyzer_queued is null) as not_queued, "
    "count(*) filter (where form_analyzer_queued and analyzer_queued_hours < 200) as stuck from companies) select *, cast(floor(pending * 100.0 / total + 0.5) as bigint) as pending_rate, cast(floor(stuck * 100.0 / total + 0.5) as bigint) as stuck_rate from c"
)
def analyzer_stats(spark, d):
    return stats.analyzer_stats(companies(spark, d))


@query("select count(*) as n, least(count(*), 10000) as n_paged from lineitem")
def scan_counts(spark, d):
    return stats.capped_count(table(spark, d, "lineitem").select(F.lit(1)))


_SAMPLES = "s as (select ts, user_id as total from events)"


def _samples(spark, d):
    return table(spark, d, "events").select("ts", F.col("user_id").alias("total"))


@query(f"with {_SAMPLES} select cast(hour(ts + interval 9 hour) * 60 + minute(ts + interval 9 hour) as int) as slot, max(ts) as ts, arg_max(total, (ts, total)) as total from s group by 1")
def minute_slot_log(spark, d):
    return stats.minute_slots(_samples(spark, d))


@query(
    f"with {_SAMPLES}, m as (select date_trunc('minute', ts) as minute, count(*) as total from s group by 1) select m.minute, m.total, coalesce(cast(m.total - p.total as varchar), '-') as delta "
    "from m left join m p on m.minute = p.minute + interval 1 hour"
)
def minute_slot_delta(spark, d):
    return stats.minute_delta(_samples(spark, d), 1)


@query("select event_id, user_id, avg(value) over w as avg_n, max(value) over w as max_n from events window w as (partition by user_id order by ts, event_id rows between 9 preceding and current row)")
def last10_moving_avg(spark, d):
    return stats.moving_stats(table(spark, d, "events").select("event_id", "user_id", "ts", "value"), "user_id", ["ts", "event_id"], "value").select("event_id", "user_id", "avg_n", "max_n")


_LEVEL = "case when greatest(value % 100, cast(user_id % 100 as double)) >= 90 then 'critical' when greatest(value % 100, cast(user_id % 100 as double)) >= 75 then 'high' when greatest(value % 100, cast(user_id % 100 as double)) >= 40 then 'normal' else 'low' end"


def _levels(spark, d):
    level = stats.load_level(F.expr("value % 100"), F.expr("cast(user_id % 100 as double)"))
    return table(spark, d, "events").select("event_id", "user_id", "ts", level.alias("level"))


@query(f"select level, count(*) as n from (select {_LEVEL} as level from events) group by 1")
def load_level(spark, d):
    return _levels(spark, d).groupBy("level").agg(F.count("*").alias("n"))


@query(f"with l as (select event_id, user_id, ts, {_LEVEL} as level from events) select event_id, (count(*) over w = 3 and min(level) over w = max(level) over w) as stable from l window w as (partition by user_id order by ts, event_id rows between 2 preceding and current row)")
def stability_window(spark, d):
    return stats.stable(_levels(spark, d), "user_id", ["ts", "event_id"], "level").select("event_id", "stable")


@query(
    with_sql("companies") + ", a as (select id from companies where form_analyzer_queued and form_url is not null), b as (select id from companies where instruction_json is null), "
    "u as (select id, 1 as batch from a union all select id, 2 from b where id not in (select id from a)) select * from u order by batch, id limit 220"
)
def two_priority_batch(spark, d):
    c = companies(spark, d)
    return stats.priority_batches(c.where("form_analyzer_queued and form_url is not null"), c.where("instruction_json is null"), 220)


@query(with_sql("send_queue") + "select targeting_id, count(*) filter (where status = 'pending') as pending, count(*) filter (where status = 'assigned') as assigned, count(*) filter (where status = 'done') as done, count(*) filter (where status = 'failed') as failed from send_queue group by 1")
def status_partition(spark, d):
    return stats.status_counts(send_queue(spark, d), ["pending", "assigned", "done", "failed"])


# ---- traces -----------------------------------------------------------------------------------------------------------
_STAGES = "s as (select l_orderkey as trace_id, l_linenumber as stage, l_extendedprice as ms, l_returnflag = 'R' as matched, l_shipmode as pattern from lineitem)".replace("l_shipmode", "l_linestatus || l_returnflag || cast(l_linenumber as varchar(5))")


def _stages(spark, d):
    rows = table(spark, d, "lineitem")
    return rows.select(
        F.col("l_orderkey").alias("trace_id"), F.col("l_linenumber").alias("stage"), F.col("l_extendedprice").alias("ms"),
        (F.col("l_returnflag") == "R").alias("matched"), F.expr("l_linestatus || l_returnflag || cast(l_linenumber as varchar(5))").alias("pattern"),
    )


@query(f"with {_STAGES} select pattern, count(*) as checked, count(*) filter (where matched) as matched, count(*) filter (where matched) / count(*) as hit_rate from s group by 1 order by matched desc, pattern limit 5")
def pattern_hit_rates(spark, d):
    return traces.hit_rates(_stages(spark, d))


@query(f"with {_STAGES} select stage, count(*) as n, round(cast(sum(cast(ms as decimal(18, 6))) as double) / count(*), 4) as avg_ms, max(ms) as max_ms, arg_max(trace_id, (ms, -trace_id)) as slowest_trace from s group by 1")
def trace_stage_stats(spark, d):
    return traces.stage_stats(_stages(spark, d)).withColumn("avg_ms", F.round("avg_ms", 4))


@query(f"with {_STAGES}, m as (select *, avg(ms) over (partition by trace_id) as mean_ms from s) select trace_id, stage, ms, case when ms > 3 * mean_ms then 'high' else 'medium' end as severity from m where ms > 2 * mean_ms")
def bottlenecks(spark, d):
    return traces.bottlenecks(_stages(spark, d)).select("trace_id", "stage", "ms", "severity")


@query(
    f"with {_STAGES}, t as (select trace_id, cast(sum(cast(ms as decimal(18, 2))) as double) / 1000.0 as ms, count(*) as n, count(*) filter (where matched) as errors from s group by 1) select trace_id, round(greatest(0.0, 100.0 - least(50.0, ms / 100.0) - greatest(0, n - 3) * 5.0 - errors * 10.0), 8) as score from t"
)
def efficiency_score(spark, d):
    t = _stages(spark, d).groupBy("trace_id").agg((F.sum(F.col("ms").cast("decimal(18,2)")).cast("double") / 1000.0).alias("ms"), F.count("*").alias("n"), F.count_if("matched").alias("errors"))
    return t.select("trace_id", F.round(traces.efficiency(F.col("ms"), F.col("n"), F.col("errors")), 8).alias("score"))


# ---- dates ------------------------------------------------------------------------------------------------------------
@query("select event_id, cast(ts + interval 9 hour as date) as jst_date from events")
def jst_dates(spark, d):
    return table(spark, d, "events").select("event_id", dates.jst_date(F.col("ts")).alias("jst_date"))


@query(
    "select event_id, isodow(ts + interval 9 hour) <= 5 and hour(ts + interval 9 hour) * 60 + minute(ts + interval 9 hour) between 540 and 1080 as open from events"
)
def business_hours(spark, d):
    return table(spark, d, "events").select("event_id", dates.within_hours(F.col("ts")).alias("open"))


@query(
    "with h as (select unnest([date '1996-01-01', date '1996-01-02', date '1996-01-15']) as day), o as (select distinct cast(o_orderdate as date) as day from orders), "
    "c as (select o.day, cast(o.day + cast(k as int) as date) as d from o, range(0, 17) r(k)) select day, min(d) as next_day from c where isodow(d) <= 5 and d not in (select day from h) group by 1"
)
def next_business_day(spark, d):
    days = table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    return days.withColumn("next_day", dates.next_business_day(F.col("day"), ["1996-01-01", "1996-01-02", "1996-01-15"]))


@query("select distinct cast(o_orderdate as date) as day, cast(o_orderdate as date) + interval 1082 minute - interval 9 hour as deadline from orders")
def send_deadline(spark, d):
    days = table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    return days.withColumn("deadline", dates.deadline(F.col("day")))



# ---- leases that go back
_FAILED = (
    "f as (select o_custkey as fc, o_orderkey % 20 as ft, 'run-' || cast((o_orderkey + o_orderkey % 3 // 2) % 4 as varchar(20)) as fr, case when o_orderkey % 2 = 0 then o_orderdate end as fa "
    "from orders where o_orderstatus = 'P' and o_orderkey % 5 = 1)"
)


@query(
    with_sql("send_queue") + f", {_FAILED}, b as (select distinct id as bid from send_queue join f on company_id = fc and targeting_id = ft and status = 'assigned' and assigned_by = fr and (fa is null or assigned_at = fa)), "
    "q as (select id, targeting_id, company_id, case when bid is not null then 'pending' else status end as status, case when bid is null then assigned_by end as assigned_by, "
    "case when bid is null then assigned_at end as assigned_at, attempts from send_queue left join b on id = bid) " + _STATES
)
def requeue_own(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'P' and o_orderkey % 5 = 1")
    failed = o.select(
        F.col("o_custkey").alias("company_id"), F.expr("o_orderkey % 20").alias("targeting_id"), F.expr("'run-' || cast((o_orderkey + (o_orderkey % 3) div 2) % 4 as varchar(20))").alias("run_id"),
        F.expr("case when o_orderkey % 2 = 0 then o_orderdate end").alias("assigned_at"),
    )
    return _states(queue_state.requeue_own(send_queue(spark, d), failed)).distinct()


@query(with_sql("companies") + "select id, case when form_analyzer_queued and timestamp '2024-01-20' - to_hours(cast(analyzer_queued_hours as int)) < timestamp '2024-01-20' - interval 100 hour then null else form_analyzer_queued end as form_analyzer_queued from companies")
def clear_stuck(spark, d):
    at = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz") - F.make_interval(hours=F.col("analyzer_queued_hours").cast("int"))
    return queue_state.clear_stuck(companies(spark, d), at, "2024-01-20 00:00:00", 100).select("id", "form_analyzer_queued")


@query(
    with_sql("submissions", "send_queue") + ", w as (select count(*) as n from submissions where targeting_id = 3 and success and submitted_at >= timestamp '2024-01-09 15:00:00' and submitted_at < timestamp '2024-01-10 15:00:00'), "
    "h as (select count(*) as n from send_queue where targeting_id = 3 and status = 'assigned' and (assigned_at is null or assigned_at < timestamp '1997-01-01 00:00:00' - interval 2 minute)) select greatest(0, 500 - w.n - h.n) as left_today from w, h"
)
def claim_capacity(spark, d):
    return queue_state.capacity(send_queue(spark, d), submissions(spark, d), 3, "2024-01-10", "1997-01-01 00:00:00", 500)


@query("select id, name, value from (select c_custkey as id, unnest(['form_url', 'capital']) as name, unnest([json_extract_string(j, '$.form_url'), json_extract_string(j, '$.capital')]) as value from (select c_custkey, '{\"form_url\": \"u' || c_custkey || '\", \"capital\": ' || c_custkey % 7 || '}' as j from customer where c_custkey % 3 = 0)) where value is not null")
def update_from_json(spark, d):
    rows = table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.expr("'{\"form_url\": \"u' || c_custkey || '\", \"capital\": ' || c_custkey % 7 || '}'").alias("changes"))
    return upserts.json_changes(rows, "id", "changes")
