"""Targeting: which companies may be contacted, and the daily queue that follows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.functions.dates import between_days

# fixed values: words of names that are never contacted
NAME_POLICY = ("医療法人", "病院", "法律事務所", "弁護士", "税理士", "弁理士", "学校")
# fixed values: what a predicate may not hold
FORBIDDEN_TOKEN = re.compile(r";|--|/\*|\*/|\\x00", re.I)
FORBIDDEN_WORD = re.compile(r"\b(insert|update|delete|drop|alter|create|grant|revoke|truncate|commit|rollback|with|union)\b", re.I)
LIMIT, SHARDS = 10_000, 8


class PredicateError(ValueError):
    """A targeting predicate that is not allowed."""


def check_predicate(fragment: str | None) -> str | None:
    """The fragment without a leading WHERE, or None. Raises on statements, comments and subqueries."""
    text = re.sub(r"^\s*where\s+", "", fragment or "", flags=re.I).strip()
    if not text:
        return None
    if found := FORBIDDEN_TOKEN.search(text):
        raise PredicateError(f"forbidden token: {found[0]}")
    if found := FORBIDDEN_WORD.search(text):
        raise PredicateError(f"forbidden statement: {found[1]}")
    if re.search(r"\bselect\b", text, re.I):
        raise PredicateError("subqueries are not allowed")
    return text


def predicate_verdict(fragment: Column) -> Column:
    """``check_predicate`` over a column of stored fragments: ok, none, or what speaks against it (token, statement, subquery)."""
    t = F.trim(F.regexp_replace(F.coalesce(fragment, F.lit("")), r"(?i)^\s*where\s+", ""))
    return (
        F.when(t == "", "none").when(t.rlike(f"(?i){FORBIDDEN_TOKEN.pattern}"), "token").when(t.rlike(f"(?i){FORBIDDEN_WORD.pattern}"), "statement")
        .when(t.rlike(r"(?i)\bselect\b"), "subquery").otherwise("ok")
    )


def predicate(fragment: str | None) -> Column:
    text = check_predicate(fragment)
    return F.expr(text) if text else F.lit(True)


def eligible() -> Column:
    """Flags are tri-state: a false black or duplication flag is not eligible, a false prohibition is."""
    return (
        F.col("form_url").isNotNull() & F.col("black").isNull()
        & (F.coalesce("prohibition_detected", F.lit(False)) == F.lit(False)) & F.col("duplication").isNull()
    )


def eligible_legacy(start_id: int = 0) -> Column:
    return (
        F.col("form_url").isNotNull() & F.col("instruction_json").isNotNull()
        & (F.col("instruction_valid").isNull() | F.col("instruction_valid")) & F.col("bot_protection_detected").isNull() & (F.col("id") >= start_id)
    )


def name_allowed(words: tuple = NAME_POLICY) -> Column:
    """No word of the policy is in the name; a null name is never allowed."""
    allowed = F.lit(True)
    for w in words:
        allowed = allowed & ~F.col("company_name").contains(w)
    return allowed


def deny_names(listed: str | None) -> list[str]:
    return [n for n in (listed or "").replace("，", ",").replace(" ", "").split(",")] if (listed or "").strip() else []


def not_denied(listed: str | None) -> Column:
    """The name is none of those listed (a null name is dropped once there is a list)."""
    names = deny_names(listed)
    return ~F.col("company_name").isin(*names) if names else F.lit(True)


def not_matching(listed: str | None, escape: bool = False) -> Column:
    """The name matches none of the listed patterns."""
    names = deny_names(listed)
    return ~F.col("company_name").rlike("|".join(map(re.escape, names) if escape else names)) if names else F.lit(True)


def recent_failures(submissions: DataFrame, day: str, days: int | None) -> DataFrame:
    """Companies with a failed or undecided submission in the last days and the day itself, whichever targeting it was for."""
    failed = F.coalesce("success", F.lit(False)) == F.lit(False)
    return submissions.where(between_days(F.col("submitted_at"), day, -days, 1) & failed).select(F.col("company_id").alias("id")).distinct()


def fresh_candidates(companies, submissions, targeting_id, day, fragment=None, denied=None, failure_days: int | None = 30) -> DataFrame:
    """Companies that this targeting never contacted."""
    contacted = submissions.where(F.col("targeting_id") == targeting_id).select(F.col("company_id").alias("id")).distinct()
    found = companies.where(eligible() & predicate(fragment) & not_denied(denied) & name_allowed())
    found = found.join(contacted, "id", "left_anti")
    if failure_days is not None:
        found = found.join(recent_failures(submissions, day, failure_days), "id", "left_anti")
    return found.select("id")


def retry_candidates(companies, submissions, targeting_id, day, fragment=None, denied=None, failure_days: int | None = 30) -> DataFrame:
    """Companies that this targeting contacted without success, neither today nor in the 14 days before."""
    own = submissions.where(F.col("targeting_id") == targeting_id)
    history = own.groupBy(F.col("company_id").alias("id")).agg(
        F.bool_or(F.col("success")).alias("has_success"), F.bool_or(between_days(F.col("submitted_at"), day, -14, 1)).alias("lately")
    )
    tried = history.where((F.coalesce("has_success", F.lit(False)) == F.lit(False)) & ~F.col("lately")).select("id")
    found = companies.where(eligible() & predicate(fragment) & not_denied(denied) & name_allowed()).join(tried, "id", "left_semi")
    if failure_days is not None:
        found = found.join(recent_failures(submissions, day, failure_days), "id", "left_anti")
    return found.select("id")


def ranked(candidates: DataFrame, targeting_id: int, day: str, limit: int, base: int | Column = 0, shards: int = SHARDS) -> DataFrame:
    """Queue rows of the first ``limit`` candidates by id. The limit bounds the window's single partition."""
    first = candidates.orderBy("id").limit(limit)
    return _queue_rows(first, targeting_id, day, F.lit(base) + F.row_number().over(Window.orderBy("id")), shards)


def _queue_rows(rows: DataFrame, targeting_id: int, day: str, priority: Column, shards: int) -> DataFrame:
    return rows.select(
        F.lit(day).cast("date").alias("target_date_jst"), F.lit(targeting_id).cast("long").alias("targeting_id"), F.col("id").cast("long").alias("company_id"),
        priority.cast("int").alias("priority"), F.pmod("id", F.lit(shards)).cast("int").alias("shard_id"), F.lit("pending").alias("status"), F.lit(0).alias("attempts"),
    )


def insert_new(rows: DataFrame, queue: DataFrame | None) -> DataFrame:
    """rows that the queue does not hold yet. The limit came first, so queued ids use it up and leave gaps in priority."""
    key = ["target_date_jst", "targeting_id", "company_id"]
    return rows if queue is None else rows.join(queue.select(*key), key, "left_anti")


def build_queue(companies, submissions, targeting_id, day, limit=LIMIT, queue=None, fragment=None, denied=None, failure_days=30, shards=SHARDS) -> DataFrame:
    """Rows to add: fresh companies first, then retries as far as the limit goes. At most ``limit`` rows of the queue are counted."""
    fresh = fresh_candidates(companies, submissions, targeting_id, day, fragment, denied, failure_days)
    retry = retry_candidates(companies, submissions, targeting_id, day, fragment, denied, failure_days)
    if queue is None:  # one plan: both lists, cut at the limit
        both = fresh.orderBy("id").limit(limit).withColumn("stage", F.lit(1)).unionByName(retry.orderBy("id").limit(limit).withColumn("stage", F.lit(2)))
        return _queue_rows(both.orderBy("stage", "id").limit(limit), targeting_id, day, F.row_number().over(Window.orderBy("stage", "id")), shards)
    own = queue.where((F.col("targeting_id") == targeting_id) & (F.col("target_date_jst") == F.lit(day).cast("date")))
    first = insert_new(ranked(fresh, targeting_id, day, limit, 0, shards), own)
    count, base = first.select("priority").unionByName(own.select("priority")).agg(F.count("*"), F.coalesce(F.max("priority"), F.lit(0))).first()
    if count >= limit:
        return first
    return first.unionByName(insert_new(ranked(retry, targeting_id, day, limit - count, base, shards), own))


def build_window(companies, submissions, targeting_id, day, after_id, window, limit, base=0, failure_days=30) -> DataFrame:
    """One row: inserted, last_id, has_more, for the fresh companies in (after_id, after_id + window]."""
    part = companies.where((F.col("id") > after_id) & (F.col("id") <= after_id + window))
    rows = ranked(fresh_candidates(part, submissions, targeting_id, day, failure_days=failure_days), targeting_id, day, limit, base)
    return rows.agg(
        F.count("*").alias("inserted"), F.coalesce(F.max("company_id"), F.lit(after_id + window)).cast("long").alias("last_id"),
        ((F.count("*") == limit) | (F.coalesce(F.max("company_id"), F.lit(0)) >= after_id + window)).alias("has_more"),
    )


def target_companies(companies, start_id, limit, fragment=None, denied=None, excluded: list[int] | None = None) -> DataFrame:
    """The legacy targeting query."""
    found = companies.where(eligible_legacy(start_id) & predicate(fragment) & not_matching(denied))
    if excluded:
        found = found.where(~F.col("id").isin(*excluded))
    return found.orderBy("id").limit(limit).select("id", "company_name", "form_url", "instruction_json", "instruction_valid")


def target_companies_with_history(companies, submissions, targeting_id, start_id, limit, allow_failed=True) -> DataFrame:
    """The same with history: never contacted companies first. A history of undecided outcomes only is dropped (null is not false)."""
    history = submissions.where(F.col("targeting_id") == targeting_id).groupBy(F.col("company_id").alias("hid")).agg(
        F.bool_or(F.col("success")).alias("has_success"), F.bool_or(~F.col("success")).alias("has_failed")
    )
    found = companies.where(eligible_legacy(start_id)).join(history, F.col("id") == F.col("hid"), "left")
    retry = (F.col("has_success") == F.lit(False)) & (F.lit(allow_failed) | (F.col("has_failed") == F.lit(False)))
    found = found.where(F.col("hid").isNull() | retry)
    rank = F.when(F.col("hid").isNull(), 0).otherwise(1)
    return found.orderBy(rank, "id").limit(limit).select("id", "company_name", "form_url", rank.alias("contacted"))


def waterfall(companies: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """step, n: how many rows pass the predicates up to each, in one pass."""
    so_far, counts = F.lit(True), []
    for _, p in steps:
        so_far = so_far & p
        counts.append(F.count_if(so_far))
    wide = companies.agg(*[c.alias(f"s{k}") for k, c in enumerate(counts)])
    pairs = F.array(*[F.struct(F.lit(name).alias("step"), F.col(f"s{k}").alias("n")) for k, (name, _) in enumerate(steps)])
    return wide.select(F.inline(pairs))


def profile(companies: DataFrame, checks: list[tuple[str, Column]], top: int = 5) -> DataFrame:
    """check_name, n, sample_ids: counts, and the first ids by a ranking that keeps few rows a task."""
    names = F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in checks]), lambda x: x.isNotNull())
    tagged = companies.select("id", F.explode(names).alias("check_name"))
    first = tagged.withColumn("rank", F.row_number().over(Window.partitionBy("check_name").orderBy("id"))).where(F.col("rank") <= top)
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",")
    samples = first.groupBy("check_name").agg(ids.alias("sample_ids"))
    return tagged.groupBy("check_name").agg(F.count("*").alias("n")).join(samples, "check_name")
