"""Queries that write and read back: versions of tables, bucketed history, facts by day, sheets, result files and request lines."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from leadloom.operators import queue_state, targeting
from leadloom.plans.relational import _CHANGES, _LATE, _RESULTS, ORACLES as RELATIONAL, TARGETING, _changes, _results
from leadloom.sources import files, history, modes
from leadloom.sources.versioned import VersionedTable
from leadloom.sources.views import companies, send_queue, submissions, table, with_sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def _folder(spark, name: str) -> str:
    return f"{files.shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


# ---- versions
@query(
    with_sql("companies") + f""", {_CHANGES}
select 1 as version, id, company_url, capital from companies
union all
select 2, coalesce(c.id, ch.id), coalesce(nullif(ch.company_url, ''), c.company_url), coalesce(ch.capital, c.capital) from companies c full join ch on c.id = ch.id
"""
)
def upsert_commit(spark, d):
    """version, id, company_url, capital: the companies before and after a merge of found addresses and capitals."""
    held = VersionedTable(spark, _folder(spark, "companies"), "id")
    first = held.create(companies(spark, d).select("id", "company_url", "capital"))
    second = held.merge(_changes(spark, d), blank_keeps=True)
    return held.read(first).select(F.lit(first).alias("version"), "*").unionByName(held.read(second).select(F.lit(second).alias("version"), "*"))


def _replace(column, was, new):
    return new


_STATE = ("id", "status", "assigned_by", "assigned_at", "attempts")


@query(
    with_sql("send_queue") + f""", {_RESULTS},
c as (select id as cid from send_queue where targeting_id = 3 and status = 'pending' order by priority, id limit 50),
a as (
  select id, targeting_id, company_id, priority, shard_id, case when cid is not null then 'assigned' else status end as status, attempts,
    case when cid is not null then 'run-9' else assigned_by end as assigned_by, case when cid is not null then timestamp '2024-01-10 00:00:00' else assigned_at end as assigned_at
  from send_queue left join c on id = cid
),
e as (select *, rid is not null and (assigned_by is null or assigned_by = run_id) as ends from a left join r on id = rid),
f as (select id, case when ends then case when won then 'done' else 'failed' end else status end as status, assigned_by, assigned_at, case when ends then attempts + 1 else attempts end as attempts from e),
s as (select *, coalesce(status = 'assigned' and assigned_at < timestamp '2024-01-20 00:00:00' - interval 60 minute, false) as stale from f)
select id, case when stale then 'pending' else status end as status, case when not stale then assigned_by end as assigned_by, case when not stale then assigned_at end as assigned_at, attempts from s
"""
)
def queue_commit(spark, d):
    """id and state of the queue after a claim, the results of runs and the return of stale rows, each committed as a version of the queue."""
    held = VersionedTable(spark, _folder(spark, "queue"), "id")
    held.create(send_queue(spark, d))
    steps = (
        lambda q: queue_state.assign(q, queue_state.claim(q, 3, 50), "run-9", "2024-01-10 00:00:00"),
        lambda q: queue_state.complete(q, _results(spark, d)),
        lambda q: queue_state.requeue_stale(q, "2024-01-20 00:00:00", 60),
    )
    for step in steps:
        before = held.read()
        # a step keeps other columns: a row is compared with what it was, in place
        now = step(before.withColumn("__was", F.struct(*_STATE)))
        changed = now.where(~F.struct(*_STATE).eqNullSafe(F.col("__was"))).select(*_STATE)
        held.merge(files.written(changed, "queue-changes"), insert=False, keep=_replace)
    return held.read().select(*_STATE)


# ---- history
@query(RELATIONAL["queue_full"])
def queue_bucketed(spark, d):
    """The daily queue from companies and facts that are bucketed by company."""
    known, facts = history.bucketed(companies(spark, d), "id"), history.bucketed(submissions(spark, d), "company_id")
    return targeting.build_queue(known, facts, TARGETING, _LATE)


@query(with_sql("companies", "submissions") + " select id, company_name from companies where id not in (select company_id from submissions where targeting_id < 5 and success)")
def untried_companies(spark, d):
    """id, company_name of companies that none of five targetings has reached, by bitmaps of ids."""
    won = submissions(spark, d).where("targeting_id < 5 and success")
    bits = history.merged(history.tried_bitmaps(won, "targeting_id"))
    return history.untried(companies(spark, d), bits).select("id", "company_name")


# ---- facts, sheets, results, requests
@query(with_sql("submissions") + " select id, company_id, cast(submitted_at + interval 9 hour as date) as jst_date from submissions where cast(submitted_at + interval 9 hour as date) between date '2024-01-05' and date '2024-01-08'")
def facts_by_day(spark, d):
    """id, company_id, jst_date of the facts of four days, from folders of days to which two batches were appended."""
    path, facts = _folder(spark, "facts"), submissions(spark, d)
    files.append_facts(facts.where("id % 2 = 0"), path)
    files.append_facts(facts.where("id % 2 = 1"), path)
    days = F.col("jst_date").between(F.lit("2024-01-05").cast("date"), F.lit("2024-01-08").cast("date"))
    return spark.read.parquet(path).where(days).select("id", "company_id", "jst_date")


@query("select p_name, p_brand, p_retailprice from part")
def sheet_scan(spark, d):
    """Columns of a CSV sheet, asked for by name in another order than the sheet's."""
    path = _folder(spark, "sheet")
    table(spark, d, "part").select("p_brand", "p_partkey", "p_retailprice", "p_name").write.option("header", True).csv(path)
    sheet = files.read_sheet(spark, path, ["p_name", "p_brand", "p_retailprice"])
    return sheet.select("p_name", "p_brand", F.col("p_retailprice").cast("double").alias("p_retailprice"))


@query(
    "select s_suppkey as targeting_id, n_name as client_name, s_name as subject, s_suppkey % 3 < 2 as active from supplier join nation on n_nationkey = s_nationkey"
)
def config_join(spark, d):
    """targeting_id, client_name, subject, active from two sheets: targetings and their clients."""
    clients, targetings = _folder(spark, "clients"), _folder(spark, "targetings")
    table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), "n_name").write.option("header", True).csv(clients)
    word = F.element_at(F.array(F.lit(" TRUE"), F.lit("yes"), F.lit("no")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("targeting_id"), F.col("s_nationkey").alias("client_id"), word.alias("active"), F.col("s_name").alias("subject"))
    rows.write.option("header", True).csv(targetings)
    both = files.client_config(files.read_sheet(spark, clients, ["id"]), files.read_sheet(spark, targetings, ["client_id", "active"]))
    return both.select(F.col("targeting.targeting_id").cast("long").alias("targeting_id"), F.col("client.n_name").alias("client_name"), "targeting.subject", "active")


@query("select page_id, url, length(html) as n_chars from pages")
def result_files(spark, d):
    """page_id, url, n_chars from JSON result files with quoted markup in them."""
    path = _folder(spark, "results")
    some = table(spark, d, "pages").groupBy((F.col("page_id") / 50).cast("long").alias("batch")).agg(F.collect_list(F.struct("page_id", "url", "html")).alias("found"))
    some.select("batch", F.to_json("found").alias("value")).write.partitionBy("batch").text(path)  # an array of fifty results a file
    found = files.read_results(spark, path, "page_id long, url string, html string")
    return found.select("page_id", "url", F.length("html").alias("n_chars"))


@query("select o_orderkey, o_totalprice from orders where o_orderstatus = 'P'")
def newest_result(spark, d):
    """The rows of the result that was written last, of three in a folder."""
    path = _folder(spark, "newest")
    for status in ("F", "O", "P"):
        table(spark, d, "orders").where(F.col("o_orderstatus") == status).select("o_orderkey", "o_totalprice").coalesce(1).write.json(f"{path}/{status}")
    return spark.read.schema("o_orderkey long, o_totalprice double").json(files.newest_file(spark, f"{path}/*/*.json"))


@query("select doc_id as company_id, text as user_text, 'You read ' || lang as system_text from documents where trim(text) <> ''")
def request_lines(spark, d):
    """company_id and both messages of the request lines that were written for documents."""
    path = _folder(spark, "requests")
    prompts = table(spark, d, "documents").select(F.col("doc_id").alias("company_id"), F.concat(F.lit("You read "), "lang").alias("system"), F.col("text").alias("user"))
    files.write_requests(prompts, path, "model-1")
    line = F.from_json("value", "custom_id string, body struct<messages:array<struct<role:string,content:string>>>")
    rows = spark.read.text(path).select(line.alias("r"))
    number = F.regexp_extract("r.custom_id", r"^company_(\d+)$", 1).cast("long")
    return rows.select(number.alias("company_id"), F.col("r.body.messages")[1]["content"].alias("user_text"), F.col("r.body.messages")[0]["content"].alias("system_text"))


@query(
    "select o_orderkey, ('0x' || substr(md5(concat(o_custkey, ':', strftime(o_orderdate, '%Y%m%d'))), 1, 16))::ubigint::hugeint "
    "- case when ('0x' || substr(md5(concat(o_custkey, ':', strftime(o_orderdate, '%Y%m%d'))), 1, 16))::ubigint >= 9223372036854775808 then 18446744073709551616::hugeint else 0 end as lock from orders"
)
def lock_keys(spark, d):
    """The lock of a targeting and day."""
    return table(spark, d, "orders").select("o_orderkey", queue_state.lock_key(F.col("o_custkey"), F.col("o_orderdate")).alias("lock"))


__all__ = ["ORACLES", "QUERIES"]


# ---- modes
def _mode_sql(mode: str, companies_view: str) -> str:
    own = {"primary": "targeting_id < 16", "extra": "targeting_id in (16, 17)", "test": "targeting_id in (18, 19)"}[mode]
    return (
        f"select '{mode}' as mode, targeting_id, count(*) filter (where status = 'pending') as pending, count(*) filter (where c.id is not null) as known, "
        f"(select count(*) from submissions where {own}) as facts from send_queue q left join {companies_view} c on c.id = q.company_id where {own} group by 2"
    )


@query(with_sql("companies", "companies_extra", "send_queue", "submissions") + " " + " union all ".join(_mode_sql(*x) for x in (("primary", "companies"), ("extra", "companies_extra"), ("test", "companies"))))
def table_modes(spark, d):
    """mode, targeting_id, pending, known, facts: one query over the tables of each mode."""
    found = None
    for mode, settings in (("primary", {}), ("extra", {"COMPANY_TABLE": "companies_extra"}), ("test", {"TEST_MODE": "true"})):
        _, known, queue, facts = modes.tables(spark, d, settings)
        total = facts.agg(F.count("*").alias("facts"))  # one row
        rows = queue.join(known.select(F.col("id").alias("company_id"), F.lit(True).alias("here")), "company_id", "left").groupBy("targeting_id")
        rows = rows.agg(F.count_if(F.col("status") == "pending").alias("pending"), F.count_if("here").alias("known")).crossJoin(F.broadcast(total))
        rows = rows.select(F.lit(mode).alias("mode"), "targeting_id", "pending", "known", "facts")
        found = rows if found is None else found.unionByName(rows)
    return found
