"""Queries of the element scores, over boxes and labels made from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadloom.functions import documents
from leadloom.operators import elements
from leadloom.sources.views import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_STYLE = "case p_partkey % 5 when 0 then 'display: none' when 1 then 'position: absolute; left: -9999px' when 2 then 'opacity: 0.0;' when 3 then 'opacity: 0.5' end"
_TYPE, _ARIA, _TAB = "case p_partkey % 6 when 0 then 'hidden' else 'text' end", "case p_partkey % 4 when 0 then 'true' end", "case p_partkey % 3 when 0 then '-1' else '0' end"


@query(
    f"with e as (select p_partkey, p_size > 5 as v, p_size > 10 as n, replace(coalesce({_STYLE}, ''), ' ', '') as s, {_TYPE} as t, {_ARIA} as a, {_TAB} as b from part) select p_partkey, "
    "cast((case when not v then -200 else 0 end) + (case when not n then -100 else 0 end) + (case when regexp_matches(s, 'display:none|visibility:hidden|pointer-events:none|opacity:0+(\\.0+)?(;|$)') then -200 else 0 end) + (case when t = 'hidden' then -200 else 0 end) "
    "+ (case when a = 'true' then -200 else 0 end) + (case when b = '-1' then -100 else 0 end) + (case when contains(s, 'position:absolute') and regexp_matches(s, 'left:-9999px') then -200 else 0 end) as int) as penalty from e"
)
def visibility_penalty(spark, d):
    p = table(spark, d, "part")
    cost = elements.visibility_penalty(F.col("p_size") > 5, F.col("p_size") > 10, F.expr(_STYLE), F.expr(_TYPE), F.expr(_ARIA), F.expr(_TAB))
    return p.select("p_partkey", cost.cast("int").alias("penalty"))


_FIELD = "case p_partkey % 6 when 0 then 'email' when 1 then 'message' when 2 then 'company' when 3 then 'phone' when 4 then 'address' else 'full_name' end"


@query(f"with e as (select p_partkey, {_FIELD} as f, p_size % 3 as done from part) select p_partkey, cast(case when f = 'phone' then 120 when f in ('email', 'message') then 70 when f in ('company', 'full_name') then 150 when done >= 2 then 200 else 150 end as int) as threshold from e")
def dynamic_threshold(spark, d):
    value = elements.dynamic_threshold(F.expr(_FIELD), F.col("p_size") % 3, per_field={"phone": 120})
    return table(spark, d, "part").select("p_partkey", value.cast("int").alias("threshold"))


# forms of ten elements, however many there are
_EL = "select s_suppkey as id, s_suppkey // 10 as form, case s_suppkey % 3 when 0 then 'input' else 'select' end as tag, case s_suppkey % 2 when 0 then 'text' else 'tel' end as type, case s_suppkey % 4 when 0 then 'td' else 'div' end as parent, case s_suppkey % 5 when 0 then null when 1 then 'a b' when 2 then 'b c' else 'c' end as classes from supplier"
_OVER = "case when x.classes is null or y.classes is null then 0.0 else len(list_intersect(string_split(x.classes, ' '), string_split(y.classes, ' '))) / len(list_distinct(list_concat(string_split(x.classes, ' '), string_split(y.classes, ' ')))) end"


@query(
    f"with e as ({_EL}) select x.id as a, y.id as b, round((case when x.tag = y.tag then 0.3 else 0.0 end) + (case when x.type = y.type then 0.2 else 0.0 end) + (case when x.parent = y.parent then 0.3 else 0.0 end) + {_OVER} * 0.2, 6) as similarity "
    "from e x join e y on x.form = y.form and x.id < y.id"
)
def structure_similarity(spark, d):
    e = table(spark, d, "supplier").selectExpr(
        "s_suppkey as id", "s_suppkey div 10 as form", "named_struct('tag', case s_suppkey % 3 when 0 then 'input' else 'select' end, 'type', case s_suppkey % 2 when 0 then 'text' else 'tel' end, 'parent', case s_suppkey % 4 when 0 then 'td' else 'div' end, "
        "'classes', case s_suppkey % 5 when 0 then null when 1 then 'a b' when 2 then 'b c' else 'c' end) as e",
    )
    a, b = e.toDF("a", "form", "ea"), e.toDF("b", "form", "eb")
    return a.join(b, "form").where("a < b").select("a", "b", F.round(elements.structure_similarity(F.col("ea"), F.col("eb")), 6).alias("similarity"))


_LABEL = "case p_partkey % 7 when 0 then 'お名前 必須' when 1 then 'メールを入力してください' when 2 then '12345' when 3 then p_name when 4 then 'x' when 5 then 'Company name *' end"
_CTX = (
    "case when t is null or not length(trim(t)) between 2 and 200 or regexp_matches(lower(trim(t)), '^[0-9\\s]*$|copyright|©|all rights reserved') then 0.0 else least(1.0, p_size / 100.0 "
    "+ (case when {f} then 0.3 else 0.0 end) + (case when {r} then 0.2 else 0.0 end) + (case when {g} then 0.15 else 0.0 end) + (case when {p} then 0.1 else 0.0 end)) end"
).format(**{k: " or ".join(f"contains({'lower(t)' if k == 'f' else 't'}, '{w}')" for w in ws) for k, ws in (("f", elements.FIELD_WORDS), ("r", elements.REQUIRED_WORDS), ("g", elements.GUIDE_WORDS), ("p", elements.POLITE_WORDS))})


@query(f"select p_partkey, round({_CTX}, 6) as score from (select p_partkey, p_size, {_LABEL} as t from part)")
def context_score(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(elements.context_score(F.expr(_LABEL), F.col("p_size") / 100.0), 6).alias("score"))


@query(
    f"with s as (select p_partkey // 40 as el, p_partkey as position, t as text, {_CTX} as score from (select p_partkey, p_size, {_LABEL} as t from part)), o as (select *, row_number() over (partition by el, lower(trim(text)) order by round(score, 6) desc, position) as r1 from s where score >= 0.3), "
    "k as (select el, position, row_number() over (partition by el order by round(score, 6) desc, position) as rank from o where r1 = 1) select el, position, rank from k where rank <= 5"
)
def best_contexts(spark, d):
    rows = table(spark, d, "part").select(F.expr("p_partkey div 40").alias("el"), F.col("p_partkey").alias("position"), F.expr(_LABEL).alias("text"), elements.context_score(F.expr(_LABEL), F.col("p_size") / 100.0).alias("score"))
    return elements.best_contexts(rows, "el").select("el", "position", "rank")


# a form has so many cells and boxes, however many forms there are
_CELLS = "select c_custkey as id, c_custkey // 150 as form, (c_custkey * 37) % 300 as x, (c_custkey * 53) % 300 as y, 100 + c_custkey % 90 as w, 80 + c_custkey % 70 as h from customer"
_BOXES = "select s_suppkey as id, s_suppkey // 10 as form, (s_suppkey * 71) % 320 as x, (s_suppkey * 29) % 320 as y, 20 + s_suppkey % 30 as w, 20 as h from supplier"


@query(f"with c as ({_CELLS}), e as ({_BOXES}) select e.form, e.id as element, arg_min(c.id, (c.w * c.h, c.id)) as cell from e join c on e.form = c.form and e.x >= c.x and e.y >= c.y and e.x + e.w <= c.x + c.w and e.y + e.h <= c.y + c.h group by 1, 2")
def cell_containment(spark, d):
    cells = table(spark, d, "customer").selectExpr("c_custkey as id", "c_custkey div 150 as form", "(c_custkey * 37) % 300 as x", "(c_custkey * 53) % 300 as y", "100 + c_custkey % 90 as w", "80 + c_custkey % 70 as h")
    boxes = table(spark, d, "supplier").selectExpr("s_suppkey as id", "s_suppkey div 10 as form", "(s_suppkey * 71) % 320 as x", "(s_suppkey * 29) % 320 as y", "20 + s_suppkey % 30 as w", "20L as h")
    return elements.contained(cells, boxes, "form")


@query(
    f"with c as ({_CELLS}), o as (select form, id, row_number() over v as \"order\", x - lag(x + w) over v as gap, abs(y - lag(y) over v) <= 10 as line from c window v as (partition by form order by y * 1000 + x, id)) "
    "select form, id, \"order\", gap, coalesce(line and gap between 0 and 50, false) as adjacent from o"
)
def input_geometry(spark, d):
    cells = table(spark, d, "customer").selectExpr("c_custkey as id", "c_custkey div 150 as form", "(c_custkey * 37) % 300 as x", "(c_custkey * 53) % 300 as y", "100 + c_custkey % 90 as w", "80 + c_custkey % 70 as h")
    return elements.reading_order(cells, "form").select("form", "id", "order", "gap", "adjacent")


@query(
    "with x as (select event_id, event_id % 5 as n, event_id % 3 as g, event_id % 2 as k, user_id % 2 = 0 as t from events), s as (select *, case when n > 0 then least(100, case when t then 75 else 60 end + 10 * g + 15 * k + case when n >= 3 then 10 when n = 2 then 5 else 0 end) else 0 end as score from x) "
    "select event_id, cast(score as bigint) as score, case when n = 0 then 'none' when score >= 90 then 'high' when score >= 70 then 'medium' when score >= 50 then 'low' else 'very_low' end as level from s"
)
def prohibition_confidence(spark, d):
    e = F.col("event_id")
    score, level = elements.prohibition_confidence(e % 5, e % 3, e % 2, F.col("user_id") % 2 == 0)
    return table(spark, d, "events").select("event_id", score.cast("long").alias("score"), level.alias("level"))


_EVENTS = "case event_id % 4 when 0 then {0}'VM started ', 'Spot preempted'{1} when 1 then {0}' ', ''{1} when 2 then {0}'ok', event_type{1} end"


@query(
    f"with x as (select event_id, {_EVENTS.format('[', ']')} as e from events), y as (select *, list_filter(list_transform(e, lambda t: trim(t)), lambda t: t <> '') as f from x) "
    "select event_id, len(list_filter(e, lambda t: regexp_matches(lower(t), 'resource exhausted|capacity|quota|preempt|spot|unavailable'))) > 0 as fallback, case when len(f) > 0 then array_to_string(f, '; ')[1:512] end as summary from y"
)
def event_summary(spark, d):
    rows = table(spark, d, "events").select("event_id", F.expr(_EVENTS.format("array(", ")")).alias("e"))
    return rows.select("event_id", elements.spot_fallback(F.col("e")).alias("fallback"), elements.event_summary(F.col("e")).alias("summary"))


_CFG = "select c_custkey, case when c_custkey % 4 = 0 then 'bad' when c_custkey % 9 = 1 then null else 'a@b.example' end as email, case when c_custkey % 5 = 0 then '9:00' else '09:00' end as st, case when c_custkey % 6 = 0 then '08:00' else '18:00' end as en, c_custkey % 8 as dy, c_custkey % 12000 as md from customer"


@query(
    f"with c as ({_CFG}) select c_custkey, list_filter([case when not coalesce(regexp_matches(email, '^[^@\\s]+@[^@\\s]+\\.[a-z]+$'), false) then 'email' end, case when not regexp_matches(st, '^([01]\\d|2[0-3]):[0-5]\\d$') then 'start' end, case when not regexp_matches(en, '^([01]\\d|2[0-3]):[0-5]\\d$') then 'end' end, "
    "case when not st < en then 'order' end, case when dy > 6 then 'days' end, case when not md between 1 and 10000 then 'max_daily' end], lambda x: x is not null) as errors from c"
)
def config_validation(spark, d):
    c = table(spark, d, "customer").selectExpr(
        "c_custkey", "case when c_custkey % 4 = 0 then 'bad' when c_custkey % 9 = 1 then null else 'a@b.example' end as email", "case when c_custkey % 5 = 0 then '9:00' else '09:00' end as st",
        "case when c_custkey % 6 = 0 then '08:00' else '18:00' end as en", "array(0L, c_custkey % 8) as dy", "c_custkey % 12000 as md",
    )
    return c.select("c_custkey", elements.config_errors(F.col("email"), F.col("st"), F.col("en"), F.col("dy"), F.col("md")).alias("errors"))


@query("select o_orderkey, o_custkey || '-ri' || (o_orderkey % 8 + 1) || '-a' || (o_orderkey % 3) || '-' || epoch(o_orderdate)::bigint as run_id, cast(o_orderkey % 8 + 1 as int) as run_index from orders")
def run_ids(spark, d):
    seconds = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    rid = F.concat_ws("-", F.col("o_custkey").cast("string"), F.concat(F.lit("ri"), F.expr("o_orderkey % 8 + 1")), F.concat(F.lit("a"), F.expr("o_orderkey % 3")), seconds.cast("string"))
    return table(spark, d, "orders").select("o_orderkey", rid.alias("run_id")).withColumn("run_index", F.regexp_extract("run_id", r"-ri(\d+)-", 1).cast("int"))


@query("select event_id, '{\"a\": {\"b\": 1, \"k\": ' || json_extract_string(props, '$.k') || '}, \"c\": \"' || event_type || '\"}' as merged from events where json_extract_string(props, '$.k') is not null")
def metadata_merge(spark, d):
    rows = table(spark, d, "events").where(F.get_json_object("props", "$.k").isNotNull())
    patch = F.concat(F.lit('{"a":'), "props", F.lit(',"c":"'), "event_type", F.lit('","d":null}'))
    return rows.select("event_id", documents.deep_merge(F.lit('{"a": {"b": 1}, "c": null}'), patch).alias("merged"))


# these texts hold no compatibility forms; widths have their own cases
@query("select doc_id, md5(lower(nfc_normalize(text))) as digest from documents")
def folded_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(documents.nfkc_lower(F.col("text"))).alias("digest"))
