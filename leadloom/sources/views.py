"""The lead tables as views over the driver tables.

Column rules are plain SQL expressions that Spark and DuckDB read alike, so that a query and its oracle see equal inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMPANY_RULES = {
    "id": "c_custkey",
    "company_name": "case when c_custkey % 97 = 13 then null when c_custkey % 41 = 5 then '医療法人' || c_name when c_custkey % 43 = 7 then c_name || '学校' "
    "when c_custkey % 47 = 9 then c_name || '法律事務所' else c_name end",
    "prefecture": "n_name",
    "region": "r_name",
    "industry": "c_mktsegment",
    "capital": "cast(floor(c_acctbal) as bigint)",
    "employee_count": "case when c_custkey % 19 = 2 then null else c_custkey % 400 end",
    "company_url": "case when c_custkey % 11 = 0 then null else 'https://www.c' || cast(c_custkey as varchar(20)) || '.example' end",
    "form_url": "case when c_custkey % 7 = 0 then null else 'https://www.c' || cast(c_custkey as varchar(20)) || '.example/contact' end",
    "instruction_json": "case when c_custkey % 13 = 0 then null else '{}' end",
    "instruction_valid": "case c_custkey % 4 when 1 then true when 2 then false when 3 then true end",
    "black": "case c_custkey % 10 when 3 then true when 7 then false end",
    "prohibition_detected": "case c_custkey % 6 when 0 then true when 1 then false end",
    "duplication": "case c_custkey % 15 when 4 then true when 9 then false end",
    "bot_protection_detected": "case c_custkey % 12 when 5 then true when 8 then false end",
    "form_found": "case c_custkey % 5 when 1 then true when 2 then false when 3 then true when 4 then true end",
    "fetch_detail_queued": "case when c_custkey % 8 = 1 then true end",
    "form_finder_queued": "case when c_custkey % 9 = 4 then true end",
    "form_analyzer_queued": "case when c_custkey % 9 = 2 then true end",
    "analyzer_queued_hours": "c_custkey % 240",
}
COMPANIES_SQL = (
    "companies as (select " + ", ".join(f"{e} as {c}" for c, e in COMPANY_RULES.items())
    + " from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"
)

EXTRA_RULES = {
    "id": "s_suppkey",
    "company_name": "s_name",
    "client": "'client_' || cast(s_suppkey % 3 as varchar(20))",
    "form_url": "case when s_suppkey % 7 = 0 then null else 'https://s' || cast(s_suppkey as varchar(20)) || '.example/form' end",
    "black": "case s_suppkey % 10 when 3 then true when 7 then false end",
    "prohibition_detected": "case s_suppkey % 6 when 0 then true when 1 then false end",
    "duplication": "case s_suppkey % 15 when 4 then true when 9 then false end",
}
EXTRA_SQL = "companies_extra as (select " + ", ".join(f"{e} as {c}" for c, e in EXTRA_RULES.items()) + " from supplier)"

SUBMISSION_RULES = {
    "id": "event_id",
    "targeting_id": "event_id % 20",
    "company_id": "user_id",
    "submitted_at": "ts",
    "success": "case event_type when 'purchase' then true when 'error' then false end",
    "classify_detail": "props",
    "value": "value",
}
SUBMISSIONS_SQL = "submissions as (select " + ", ".join(f"{e} as {c}" for c, e in SUBMISSION_RULES.items()) + " from events)"

QUEUE_RULES = {
    "id": "o_orderkey",
    "targeting_id": "o_orderkey % 20",
    "company_id": "o_custkey",
    "priority": "cast(o_orderkey % 1000 as int)",
    "shard_id": "cast(o_orderkey % 8 as int)",
    "status": "case o_orderstatus when 'O' then 'pending' when 'P' then 'assigned' else case when o_orderkey % 2 = 0 then 'done' else 'failed' end end",
    "attempts": "cast(o_orderkey % 3 as int)",
    "assigned_by": "case when o_orderstatus = 'P' then 'run-' || cast(o_orderkey % 4 as varchar(20)) end",
    "assigned_at": "case when o_orderstatus = 'P' then o_orderdate end",
}
QUEUE_SQL = "send_queue as (select " + ", ".join(f"{e} as {c}" for c, e in QUEUE_RULES.items()) + " from orders)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored_bytes(spark: SparkSession, sf_dir: str, name: str) -> int:
    """How long the files of a table are."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def _rules(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    return df.select(*[F.expr(e).alias(c) for c, e in rules.items()])


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")  # 25 and 5 rows: Spark broadcasts them by size
    joined = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return _rules(joined, COMPANY_RULES)


def companies_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rules(table(spark, sf_dir, "supplier"), EXTRA_RULES)


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rules(table(spark, sf_dir, "events"), SUBMISSION_RULES)


def send_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rules(table(spark, sf_dir, "orders"), QUEUE_RULES)


def with_sql(*views: str) -> str:
    """A WITH clause of the named views."""
    known = {"companies": COMPANIES_SQL, "companies_extra": EXTRA_SQL, "submissions": SUBMISSIONS_SQL, "send_queue": QUEUE_SQL}
    return "with " + ", ".join(known[v] for v in views)
