"""Texts, numbers, settings, hosts, templates and documents from columns of the tables. The oracles state the rules by themselves."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from leadloom.functions import dates, documents, numbers, redaction, text, urls
from leadloom.operators import elements, mapping, prohibition, queue_state, scoring, targeting
from leadloom.sources.derived import choose, fields, messages, with_sql
from leadloom.sources.views import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


# ---- words
_TOKEN = r"(^|[\s_\-\[\](){{}}（）「」・:：/.,、。]){0}($|[\s_\-\[\](){{}}（）「」・:：/.,、。])"


@query(
    with_sql("fields") + rf""" select form, pos, regexp_matches(label, '[぀-ヿ㐀-鿿ｦ-ﾟ]') as cjk, regexp_matches(name, '{_TOKEN.format("name")}') as says_name,
  regexp_matches(label, '{_TOKEN.format("姓")}') or contains(label, '姓') as family, regexp_matches(label, '{_TOKEN.format("名")}') as first,
  replace(replace(replace(concat(name, '\n', label, '\t', classes), '\r', chr(13)), '\n', chr(10)), '\t', chr(9)) as decoded from fields"""
)
def field_words(spark, d):
    """Signs in names and labels: Japanese letters, words with borders, and escapes of line breaks and tabs."""
    raw = F.concat("name", F.lit("\\n"), "label", F.lit("\\t"), "classes")
    return fields(spark, d).select(
        "form", "pos", text.has_cjk(F.col("label")).alias("cjk"), text.contains_token(F.col("name"), "name").alias("says_name"), text.contains_token(F.col("label"), "姓").alias("family"),
        text.contains_token(F.col("label"), "名").alias("first"), text.unescape(raw).alias("decoded"),
    )


_SPELT = choose("p_partkey", ("my_email", "user name", "zip-code", "phone", "company_name", "privacy", "contact-form", "message", "x", "E Mail", "tel")) + " || case when p_size % 3 = 0 then '_' || cast(p_size as varchar(9)) else '' end"


@query(
    f"""with a as (select p_partkey, {_SPELT} as name from part), b as (select *, lower(name) as l from a)
select p_partkey, list_sort(list_distinct(list_concat([name, replace(name, '_', '-'), replace(name, '-', '_'), replace(name, ' ', ''), replace(name, ' ', '_')], case
  when contains(l, 'name') then ['name', 'お名前', '氏名', 'nama', 'fullname'] when contains(l, 'email') then ['email', 'メール', 'mail', 'e-mail', 'eメール'] when contains(l, 'phone') then ['phone', '電話', 'tel', 'telephone', '電話番号']
  when contains(l, 'company') then ['company', '会社', '会社名', 'corp', 'corporation'] when contains(l, 'message') then ['message', 'メッセージ', '内容', 'content', 'inquiry']
  when contains(l, 'privacy') then ['privacy', 'プライバシー', '個人情報', 'consent', '同意'] when contains(l, 'contact') then ['contact', '連絡', 'renraku'] else [] end))) as names from b"""
)
def name_variations(spark, d):
    return table(spark, d, "part").select("p_partkey", F.expr(_SPELT).alias("name")).select("p_partkey", text.variations(F.col("name")).alias("names"))


# ---- numbers and settings
_SAID_NUMBER = "cast(c_custkey * 37 % 1300 as varchar(9))"
_SAID = (
    f"concat({choose('c_custkey', ('', '月給 ', '従業員 ', '約', '年齢'))}, case when c_custkey % 3 = 0 then concat(cast(c_custkey % 9 + 1 as varchar(9)), ',', lpad({_SAID_NUMBER}, 3, '0')) when c_custkey % 3 = 1 then concat({_SAID_NUMBER}, '.5') "
    f"else translate({_SAID_NUMBER}, '0123456789', '０１２３４５６７８９') end, {choose('c_nationkey', ('千円', '円', '歳', '人', '名', '月', '', '人以上'))})"
)
_MISSING_OR = f"case c_custkey % 23 when 7 then '-' when 8 then 'N/A' when 9 then '' when 10 then null else {_SAID} end"
_UNIT = "try_cast(nullif(replace(regexp_extract({0}, '([0-9][0-9,]*(?:\\.[0-9]+)?)\\s*{1}', 1), ',', ''), '') as double)"


@query(
    f"""with a as (select c_custkey, {_MISSING_OR} as v from customer), b as (select c_custkey, translate(v, '０１２３４５６７８９，．', '0123456789,.') as t, case when trim(v) not in ('-', '', 'None', 'null', 'N/A') then translate(trim(v), '０１２３４５６７８９，．', '0123456789,.') end as u from a),
c as (select *, floor({_UNIT.format('u', '(?:歳)')})::bigint as years, floor({_UNIT.format('u', '(?:人|名)')})::bigint as people, floor({_UNIT.format('u', '(?:月)')})::bigint as month from b)
select c_custkey, (case when contains(t, '千円') then floor({_UNIT.format('t', '千円')}) * 1000 else floor({_UNIT.format('t', '')}) end)::bigint as salary,
  try_cast(nullif(regexp_extract(replace(u, ',', ''), '([0-9]{{1,18}})', 1), '') as bigint) as first, case when years between 0 and 120 then years end as age, case when people >= 0 then people end as staff, case when month between 1 and 12 then month end as closing_month from c"""
)
def said_numbers(spark, d):
    """Salary, first number, age, employees and closing month of what companies say."""
    v = F.col("v")
    return table(spark, d, "customer").select("c_custkey", F.expr(_MISSING_OR).alias("v")).select(
        "c_custkey", numbers.salary(v).alias("salary"), numbers.first_number(v).alias("first"), numbers.whole_number(v, "歳", 0, 120).alias("age"), numbers.whole_number(v, "人|名").alias("staff"),
        numbers.whole_number(v, "月", 1, 12).alias("closing_month"),
    )


_CLOCK = "concat(case when o_orderkey % 4 = 1 then cast(o_orderkey % 27 as varchar(9)) else lpad(cast(o_orderkey % 27 as varchar(9)), 2, '0') end, ':', lpad(cast(o_custkey % 66 as varchar(9)), 2, '0'))"
_DAYS = "case o_custkey % 5 when 0 then 'x' when 1 then '[]' when 2 then null else concat('[', cast(o_orderkey % 9 as varchar(9)), ', ', cast(o_custkey % 8 as varchar(9)), ']') end"
_HOURS = "case o_orderkey % 6 when 0 then null when 1 then 'z' when 2 then '-1' when 3 then '0' else concat(' ', cast(o_custkey % 13 as varchar(9)), '.5 ') end"
_SHARED = "case o_custkey % 4 when 0 then '4' when 1 then '' when 2 then null else '6' end"


@query(
    f"""with a as (select o_orderkey, {_CLOCK} as c, {_DAYS} as ds, {_HOURS} as own, {_SHARED} as shared, o_orderkey % 9 as d1, o_custkey % 8 as d2, o_custkey % 5 as k from orders),
b as (select *, regexp_extract(c, '^([01]?\\d|2[0-3]):([0-5]\\d)$', 1) as h, regexp_extract(c, '^([01]?\\d|2[0-3]):([0-5]\\d)$', 2) as m, list_filter([d1, d2], lambda x: x between 0 and 6) as ok, nullif(greatest(try_cast(trim(own) as double), 0), 0) as own_h, nullif(greatest(try_cast(trim(shared) as double), 0), 0) as shared_h from a)
select o_orderkey, case when h <> '' then h::int * 60 + m::int end as minutes, case when k >= 3 and len(ok) > 0 then ok::int[] else [0, 1, 2, 3, 4] end as days, coalesce(own_h, shared_h, 8.0) as hours from b"""
)
def client_settings(spark, d):
    """Minutes of clock times, week days and session hours of settings that may be malformed."""
    rows = table(spark, d, "orders").select("o_orderkey", F.expr(_CLOCK).alias("c"), F.expr(_DAYS).alias("ds"), F.expr(_HOURS).alias("own"), F.expr(_SHARED).alias("shared"))
    return rows.select("o_orderkey", dates.parse_clock(F.col("c")).alias("minutes"), dates.parse_days(F.col("ds")).cast("array<int>").alias("days"), dates.session_hours(F.col("own"), F.col("shared")).alias("hours"))


_WORKER = {
    "num_workers": "case when l_partkey % 11 = 3 then null else l_linenumber - 1 end", "max_workers": "cast(l_suppkey % 7 as int)", "batch_size": "cast(l_partkey % 5 + 1 as int)", "max_pending_tasks": "cast(l_suppkey % 60 as int)",
    "memory_per_worker_mb": "cast(512 * (l_partkey % 6) as int)", "page_load": "cast(l_partkey % 41 as int)", "element_wait": "case when l_suppkey % 8 = 1 then null else cast(l_suppkey % 40 as int) end", "pre_processing_max": "30",
}


@query(
    "with w as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, " + ", ".join(f"{e} as {c}" for c, e in _WORKER.items()) + " from lineitem) select l_orderkey, l_linenumber, l_partkey, l_suppkey, "
    "list_filter([case when num_workers < 1 then 'num_workers' end, case when max_workers < num_workers then 'max_workers' end, case when max_pending_tasks < batch_size * num_workers * 2 then 'max_pending_tasks' end, "
    "case when memory_per_worker_mb * num_workers + 2048 > 10240 or memory_per_worker_mb > 2048 then 'memory' end, case when page_load > 30 then 'page_load' end, case when element_wait > 30 then 'element_wait' end], lambda x: x is not null) as errors from w"
)
def worker_settings(spark, d):
    """The rules that a worker's settings break."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.struct(*[F.expr(e).alias(c) for c, e in _WORKER.items()]).alias("c"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", elements.worker_errors(F.col("c")).alias("errors"))


@query(
    """with b as (select user_id, ts, event_id, event_type = 'error' as bad from events), l as (select user_id, max(ts) filter (where not bad) as good, max(ts) as last from b group by 1),
r as (select b.user_id, count(*) filter (where bad and (good is null or ts > good)) as failures, max(ts) filter (where bad) as failed from b join l using (user_id) group by 1),
n as (select max(ts) as now from events)
select user_id, failures, case when failures < 2 then 'closed' when epoch(now) - epoch(failed) < 86400 then 'open' else 'half_open' end as state from r, n"""
)
def circuit_states(spark, d):
    """user_id, failures (since the last event that was none), state of the circuit at the last event of all."""
    e = table(spark, d, "events").withColumn("bad", F.col("event_type") == "error")
    good = e.groupBy("user_id").agg(F.max(F.when(~F.col("bad"), F.col("ts"))).alias("good"))
    now = e.agg(F.max("ts").alias("now"))  # one row
    counted = e.join(good, "user_id").groupBy("user_id").agg(
        F.count_if(F.col("bad") & (F.isnull("good") | (F.col("ts") > F.col("good")))).alias("failures"), F.max(F.when(F.col("bad"), F.col("ts"))).alias("failed")
    )
    ago = F.unix_timestamp(F.col("now").cast("timestamp")) - F.unix_timestamp(F.col("failed").cast("timestamp"))
    return counted.crossJoin(F.broadcast(now)).select("user_id", "failures", queue_state.circuit(F.col("failures"), ago, limit=2, cool_s=86400).alias("state"))


@query("select event_id, true as near, least(60.0, pow(2.0, user_id % 9)) as wait_s from events")
def jitter_bounds(spark, d):
    """Whether a wait with jitter is within a fifth of the wait without."""
    wait = queue_state.backoff(F.col("user_id") % 9)
    return table(spark, d, "events").select("event_id", (F.abs(queue_state.jittered(wait, F.col("event_id")) / wait - 1) <= 0.2).alias("near"), wait.alias("wait_s"))


# ---- hosts, templates, documents
_HOST = "lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1))"


@query(
    f"""with h as (select page_id, {_HOST} as h from pages) select page_id, h = 'example.com' or ends_with(h, '.example.com') or h = 'example.org' or ends_with(h, '.example.org') as matches,
  case when regexp_matches(h, '[^.]+\\.(?:co|or|ne|ac|ad|ed|go|gr|lg|com|net|org|gov|edu)\\.[a-z]{{2}}$') then regexp_extract(h, '([^.]+\\.[a-z]+\\.[a-z]{{2}})$', 1) else array_to_string(list_slice(string_split(h, '.'), -2, -1), '.') end as domain from h"""
)
def host_domains(spark, d):
    """Whether a page's host is below listed domains, and the domain that is registered."""
    h = urls.host(F.col("url"))
    return table(spark, d, "pages").select("page_id", urls.host_matches(h, ["example.com", ".example.org", ""]).alias("matches"), urls.registrable(h).alias("domain"))


_TEMPLATE = (
    "concat(" + choose("c_custkey", ("{company} 御中 ", "[{company}様、]", "{client.name} ", "", "[{city}の]皆様 ", "{ company } ")) + ", " + choose("c_nationkey", ("こんにちは ", "[note] ", "{city}", "{targeting.subject} ")) + ", "
    + choose("c_custkey + c_nationkey", ("[{city}から]", "{company}", "以上")) + ")"
)
_CITY = "case when c_custkey % 3 = 0 then null else n_name end"
_BLOCK = r"\[([^\[\]]*\{{\s*{0}\s*\}}[^\[\]]*)\]"


@query(
    f"""with a as (select c_custkey, {_TEMPLATE} as t, case when c_custkey % 4 = 0 then '' else c_name end as company, {_CITY} as city from customer join nation on n_nationkey = c_nationkey),
b as (select *, list_transform(regexp_extract_all(t, '\\{{([^}}]+)\\}}', 1), lambda x: trim(x)) as n, case when company = '' then regexp_replace(t, '{_BLOCK.format("company")}', '', 'g') else regexp_replace(t, '{_BLOCK.format("company")}', '\\1', 'g') end as s from a),
c as (select *, replace(s, '{{company}}', company) as s2 from b),
e as (select *, case when coalesce(city, '') = '' then regexp_replace(s2, '{_BLOCK.format("city")}', '', 'g') else regexp_replace(s2, '{_BLOCK.format("city")}', '\\1', 'g') end as s3 from c)
select c_custkey, list_filter(n, lambda x, i: not contains(x, 'client.') and not contains(x, 'targeting.') and list_position(n, x) = i) as names, replace(s3, '{{city}}', coalesce(city, '')) as message from e"""
)
def template_messages(spark, d):
    """The placeholders of a template, and the message that it gives for a company and its city."""
    nation = table(spark, d, "nation")
    rows = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", F.expr(_TEMPLATE).alias("t"), F.expr("case when c_custkey % 4 = 0 then '' else c_name end").alias("company"), F.expr(_CITY).alias("city")
    )
    return rows.select("c_custkey", text.placeholders(F.col("t")).alias("names"), text.expand(F.col("t"), {"company": F.col("company"), "city": F.col("city")}).alias("message"))


_SAMPLE = choose("c_custkey", ("山田太郎", "03", "1234-5678", "お問い合わせ", "plain", "東京都千代田区", "営業部 部長"))
_SAMPLE_MARK = choose(
    "c_custkey", ("{client.last_name}{client.first_name}", "{client.phone_1}", "{client.phone_2}-{client.phone_3}", "{targeting.subject}", "plain", "{client.address_1}{client.address_2}", "{client.department} {client.position}"),
)
_SAMPLE_DOCUMENT = "concat('{{\"山田\": \"', {0}, '\", \"n\": 1234, \"deep\": [\"', c_name, '\", {{\"03\": \"', {0}, ' x\"}}]}}')"


@query(f"select c_custkey, {_SAMPLE_DOCUMENT.format(_SAMPLE_MARK).replace('{{', '{').replace('}}', '}')} as document from customer where c_custkey % 1234 <> 0 and not regexp_matches(c_name, '03|1234|5678|100|0001')")
def sample_documents(spark, d):
    """Documents with the samples in their values, not in their names, as placeholders."""
    rows = table(spark, d, "customer").where("c_custkey % 1234 <> 0 and not regexp(c_name, '03|1234|5678|100|0001')")
    return rows.select("c_custkey", text.with_placeholders(F.expr(_SAMPLE_DOCUMENT.format(_SAMPLE).replace("{{", "{").replace("}}", "}"))).alias("document"))


_JSON = "concat('{\"b\": ', case when user_id % 3 = 0 then 'NaN' else cast(event_id as varchar(20)) end, ', \"a\": {\"element\": 1, \"x\": [1, ', cast(user_id as varchar(20)), '], \"d\": {\"d\": {\"d\": {\"d\": {\"d\": ', cast(event_id as varchar(20)), '}}}}}, \"t\": \"', event_type, '\"}')"


@query(
    "select event_id, concat('{\"a\": {\"d\": {\"d\": {\"d\": {\"d\": {\"d\": \"<max_depth_reached>\"}}}}, \"x\": [1, ', user_id, ']}, \"b\": ', case when user_id % 3 = 0 then 'null' else event_id::varchar end, ', \"t\": \"', event_type, '\"}') as safe from events"
)
def safe_documents(spark, d):
    """Documents as they may be stored: without elements, not-a-numbers and what lies too deep."""
    return table(spark, d, "events").select("event_id", documents.json_safe(F.expr(_JSON)).alias("safe"))


# ---- redaction: parts that a rule finds or leaves, drawn by columns
_PLAIN_PART = ("plain words", "abc", "hello", "nothing of note")
_SECURE = ("call 03-1234-5678", "pwd: hunter2", "from 10.0.0.1", "zip 123-4567", "abcdefghij0123456789ABC end", "or 0312345678")
_SECURE_CLEAN = ("call ***-****-****", "pwd=***", "from ***.***.***.**", "zip ***-****", "***TOKEN*** end", "or ***********")


def _line(parts: tuple) -> str:
    return f"concat('user ', cast(user_id as varchar(20)), ' / ', {choose('event_id', parts + _PLAIN_PART)}, ' / ', {choose('event_id + user_id', _PLAIN_PART)})"


@query(f"select event_id, {_line(_SECURE_CLEAN)} as clean from events")
def redaction_secure(spark, d):
    return table(spark, d, "events").select("event_id", redaction.secure(F.expr(_line(_SECURE))).alias("clean"))


_SIGNLESS = ("record_id: 12 and id=7", "id = 5 あいう", "ok あいうえお", "at a.example.org/x", "Acme Ltd", "plain")
_SIGNLESS_CLEAN = ("record_id: 12 and id=***ID_REDACTED***", "id=***ID_REDACTED*** ***JP_TEXT***", "ok ***JP_TEXT***", "at a.example.org/x", "Acme Ltd", "plain")
_KEYED = ("record_id: 12 and id=7 key", "at a.example.com/x key", "id = 5 あいう key", "key ok", "Acme Corp key", "key 山 b.co.jp c")
_KEYED_CLEAN = ("record_id=***ID_REDACTED*** and id=***ID_REDACTED*** key", "at a.***DOMAIN_REDACTED*** key", "id=***ID_REDACTED*** ***JP_TEXT*** key", "key ok", "Acme ***COMPANY_REDACTED***", "key 山 ***DOMAIN_REDACTED*** c")


def _strict(signless: tuple, keyed: tuple) -> str:
    return f"concat('no ', cast(user_id as varchar(20)), ' ', case when user_id % 2 = 0 then {choose('event_id', signless)} else {choose('event_id', keyed)} end)"


@query(f"select event_id, {_strict(_SIGNLESS_CLEAN, _KEYED_CLEAN)} as clean from events")
def redaction_strict(spark, d):
    """Log lines for shared logs: those with a sign get all rules, the others the rules for ids and Japanese text."""
    return table(spark, d, "events").select("event_id", redaction.strictly_redacted(F.expr(_strict(_SIGNLESS, _KEYED))).alias("clean"))


_RUNS = ("あいうえおかきくけこさしすせそたちつてとなにぬねの", "これは長い文章でありますがエラーという言葉がありますから頭と尾が残るはずであります", "これは長い文章でありますから全部が隠されるはずであるとおもわれますがどうでしょう", "短い文", "")


@query(
    f"""with a as (select event_id, user_id, {choose('event_id', _RUNS)} as x, {choose('user_id', _RUNS)} as y from events), b as (select *, concat(x, y) as run from a)
select event_id, concat('n', user_id, case when length(run) < 30 then run when not regexp_matches(run, 'エラー') then '***TEXT_REDACTED***'
  when length(run) > 50 then concat(run[:20], '***[PARTIAL_REDACTED]***', run[-15:]) else concat(run[:15], '***[INFO_REDACTED]***', run[-10:]) end, 'b') as clean from b"""
)
def redaction_long(spark, d):
    """Long Japanese texts go; of technical ones head and tail stay."""
    line = F.expr(f"concat('n', cast(user_id as varchar(20)), {choose('event_id', _RUNS)}, {choose('user_id', _RUNS)}, 'b')")
    return table(spark, d, "events").select("event_id", redaction.long_texts(line).alias("clean"))


@query(
    """select c_custkey, case when c_custkey % 5 = 0 then concat('not json: mail ***EMAIL_REDACTED*** of ', c_mktsegment)
  else concat('{"Company_Name":"***REDACTED***","n":', c_custkey, ',"deep":[{"note":"mail ***EMAIL_REDACTED***"},2.5,null,true],"seg":"', c_mktsegment, '","see":"***URL_REDACTED***"}') end as clean from customer"""
)
def redaction_documents(spark, d):
    """JSON documents with secret members masked and texts redacted; a text that is no document is redacted as it stands."""
    mail = "'user', cast(c_custkey as varchar(20)), '@a.example"
    line = (
        f"case when c_custkey % 5 = 0 then concat('not json: mail ', {mail} of ', c_mktsegment) else concat('{{\"Company_Name\": \"', c_name, '\", \"n\": ', cast(c_custkey as varchar(20)), ', \"deep\": [{{\"note\": \"mail ', {mail}\"}}, 2.5, null, true], "
        "\"seg\": \"', c_mktsegment, '\", \"see\": \"https://x.example/', cast(c_custkey as varchar(20)), '\"}') end"
    )
    return table(spark, d, "customer").select("c_custkey", redaction.redacted_json(F.expr(line)).alias("clean"))


# ---- predicates
_PREDICATE = "concat(" + choose("event_id", ("", " WHERE ", "where ")) + ", " + choose("user_id", ("capital > ", "id in (select ", "a = 1; drop table ", "created = ", "x union all ", "name like ''%", "/* c */ ", "with_x = ", "Delete ")) + ", cast(event_id as varchar(20)), " + choose("event_id + user_id", ("", " -- x", " and b", "")) + ")"


@query(
    f"""with a as (select event_id, trim(regexp_replace({_PREDICATE}, '(?i)^\\s*where\\s+', '')) as t from events)
select event_id, case when t = '' then 'none' when regexp_matches(t, ';|--|/\\*|\\*/') then 'token' when regexp_matches(t, '(?i)\\b(insert|update|delete|drop|alter|create|grant|revoke|truncate|commit|rollback|with|union)\\b') then 'statement'
  when regexp_matches(t, '(?i)\\bselect\\b') then 'subquery' else 'ok' end as verdict from a"""
)
def predicate_verdicts(spark, d):
    """Whether stored targeting predicates may run, and what speaks against them."""
    return table(spark, d, "events").select("event_id", targeting.predicate_verdict(F.expr(_PREDICATE)).alias("verdict"))


# ---- names of a form
_NAME_FIELD = choose("l_partkey + l_linenumber", ("姓", "名", "姓カナ", "名カナ", "姓ひらがな", "名ひらがな", "統合氏名", "統合氏名カナ"))
_NAME_ATTR = choose("l_suppkey", ("first", "last", "sei", "mei", "first_kana", "last_kana", "x", "kana_mei", "kana_sei"))
_NAME_HINT = choose("l_suppkey + l_linenumber", ("", "姓", "名", "ふりがな", "フリガナ", "セイ", "メイ", "First name"))
_NAME_SAID = choose("l_partkey", ("", "お名前", "住所", "部署名", "名 last", "姓 first", "郵便番号"))


@query(
    f"""with n as (select l_orderkey as form, {_NAME_FIELD} as field, {_NAME_ATTR} as a, {_NAME_HINT} as h, {_NAME_SAID} as s, cast(80 + l_partkey % 11 as int) as v, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice from lineitem
  qualify row_number() over (partition by l_orderkey, {_NAME_FIELD} order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) = 1),
w as (select form, bool_or(field = '統合氏名') as whole from n group by 1),
p as (select form, field, a, h, s from n join w using (form) where not (whole and field in ('姓', '名') and (regexp_matches(s, '住所|マンション名|建物名|ふりがな|フリガナ|カナ|かな|ひらがな|郵便|郵便番号|商品名|部署|部署名') or regexp_matches(concat(a, ' ', h), 'kana|furigana|katakana|hiragana') or v < 85))),
f0 as (select form, max(a) filter (where field = '姓') as a1, max(lower(h)) filter (where field = '姓') as h1, max(s) filter (where field = '姓') as s1, max(a) filter (where field = '名') as a2, max(lower(h)) filter (where field = '名') as h2, max(s) filter (where field = '名') as s2 from p group by 1),
f1 as (select form, coalesce((contains(a1, 'first') and contains(a2, 'last')) or (contains(a1, 'mei') and contains(a2, 'sei')), false) as c1, * exclude (form) from f0),
f2 as (select form, c1, case when c1 then s2 else s1 end as s1, case when c1 then s1 else s2 end as s2, case when c1 then h2 else h1 end as h1, case when c1 then h1 else h2 end as h2 from f1),
f3 as (select *, coalesce((contains(s1, 'first') and contains(s2, 'last')) or (contains(s1, '名') and contains(s1, 'last') and contains(s2, '姓') and contains(s2, 'first')), false) as c2 from f2),
f4 as (select *, case when c2 then h2 else h1 end as k1, case when c2 then h1 else h2 end as k2 from f3),
f5 as (select form, (c1::int + c2::int + coalesce(regexp_matches(k1, '名|first name|given name') and regexp_matches(k2, '姓|last name|family name'), false)::int) % 2 = 1 as swapped from f4)
select p.form, max(p.a) filter (where p.field = case when swapped then '名' else '姓' end and exists (select 1 from p q where q.form = p.form and q.field = '姓')) as family from p join f5 using (form) group by 1"""
)
def family_names(spark, d):
    """form, family: the name of the element that is taken for the family name, after parts that name something else went and mixed-up parts changed places."""
    order = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    e = F.struct(F.expr(_NAME_ATTR).alias("name"), F.lit("").alias("id"), F.lit("").alias("classes"), F.expr(_NAME_HINT).alias("placeholder"), F.expr(_NAME_SAID).alias("context"), F.expr("cast(80 + l_partkey % 11 as int)").alias("score"))
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("form"), F.expr(_NAME_FIELD).alias("field"), F.struct(*order).alias("o"), e.alias("e"))
    first = rows.groupBy("form", "field").agg(F.min_by("e", "o").alias("e"))
    forms = first.groupBy("form").agg(F.map_from_entries(F.collect_list(F.struct("field", "e"))).alias("m"))
    kept = mapping.swapped_names(mapping.pruned_names(F.col("m")))
    return forms.where(F.size(mapping.pruned_names(F.col("m"))) > 0).select("form", F.try_element_at(kept, F.lit("姓"))["name"].alias("family"))


# ---- notices that forbid sales contact: sentences of a subject, a link and an end
_SUBJECT = ("営業", "営業時間", "セールス", "勧誘", "売り込み", "販売", "商業目的", "営業部", "迷惑", "業務", "取材", "営業目的", "お客様サポートの営業", "スパム", "営業等")
_LINK = ("の電話は", "メールについて", "のお問い合わせは", "を目的とした連絡は", "などのご利用は", "活動に関するご案内は", "の訪問、", "のお知らせ")
_END = ("お断りします", "ご遠慮ください", "できません", "禁止しています", "お受けしておりません", "お待ちしています", "お控えください", "対応しております", "9時からです")
_ENGLISH_SAID = ("no solicitation calls please", "we do not accept sales or vendors", "our sales team is glad to help", "please do not contact us for marketing", "telemarketing is prohibited here")
_SENTENCE = f"case when event_id % 11 = 4 then {choose('user_id', _ENGLISH_SAID)} else concat({choose('event_id', _SUBJECT)}, {choose('user_id', _LINK)}, {choose('event_id + user_id', _END)}) end"
_SECOND = f"case when user_id % 3 = 0 then 'お気軽にお問い合わせください' else concat({choose('user_id * 7 + event_id', _SUBJECT)}, {choose('event_id', _LINK)}, {choose('event_id * 5 + user_id', _END)}) end"
# what follows 営業 where it does not mean sales, and words of sentences about something else
_AFTER = "日|時間|中|再開|停止|休止|開始|終了|年数|経験|歴|所|部|課|担当|マン|員|職|窓口|チーム|組織|体制|拠点|店舗|エリア|地域|範囲|区域|車|車両|用|向け|秘密|機密|情報|データ|資料|ツール|支援|システム|管理|統計|分析|実績|成績|利益|収益|報告|会議|指標|目標|計画|予算|費用|コスト|効率|生産性|品質|戦略|方針|ノウハウ|スキル|力|サービス|対応|強化|拡大|促進|推進|改善|革新|改革|最適化|効果|結果|成果|業績|実態|状況|環境|市場|競争|優位|価値|価格|単価|金額|売上|収入|損益|黒字|赤字|キャッシュフロー"
_ELSE = "なりすまし|詐欺|偽サイト|フィッシング|悪質|不審|偽装|模倣|違法|不正|注意喚起|警戒|被害|トラブル|セキュリティ|お客様|カスタマー|サポート|ヘルプ|サービス|お問い合わせ窓口|相談窓口|受付窓口|案内|説明|ガイド|マニュアル|手順|方法|個人情報|プライバシー|データ保護|利用規約|約款|規約|方針|ポリシー|法的|法律|法令|規則|条例|コンプライアンス|運営|管理|システム|メンテナンス|更新|改善|品質|向上|利便性|機能|特徴|メリット|効果|実績"
_KEYS = "営業目的|営業を目的|営業による|営業のため|営業に関する|営業活動|営業行為|営業案内|営業電話|営業メール|営業連絡|営業訪問|"
_OTHER_KEYS = "セールス目的|セールスを目的|セールスのため|セールスに関する|セールス活動|セールス行為|セールス案内|セールス電話|セールスメール|セールス連絡|セールス訪問|販売目的|販売を目的|販売のため|販売に関する|販売活動|販売行為|勧誘目的|勧誘を目的|勧誘による|勧誘のため|勧誘に関する|勧誘活動|勧誘行為|勧誘案内|勧誘電話|勧誘メール|勧誘連絡|宣伝目的|宣伝を目的|宣伝のための|宣伝に関する|宣伝活動|宣伝行為|広告目的|広告宣伝|PR目的|プロモーション目的|売り込み|売込|商業目的|商業利用|商業的利用|ビジネス目的|ビジネス利用|営利目的|営利利用|迷惑行為|迷惑電話|スパム|spam|SPAM"
_NO, _CANNOT = "お断り|断り|遠慮|禁止", "できません|いたしかねます|しておりません|お受けしておりません|対応しておりません|受け付けておりません"
_KINDLY, _NOT = "お控えください|ご遠慮ください|お断りします|お断りいたします|控えていただけ|遠慮していただけ", "ません|ないため|いたしかねます"
_WAY = "(?:問い合わせ|連絡|メール|電話|訪問)"
_BOTH = (
    (f"(?:営業|セールス|勧誘|販売).*?{_WAY}", f"(?:{_NO})"), ("売り?込み", f"(?:{_NO})"), (f"営業.*?{_WAY}", f"(?:{_KINDLY})"), ("(?:営業|セールス|勧誘|販売)(?:電話|メール|連絡)", f"(?:{_NO}|{_CANNOT}|{_KINDLY})"),
    ("(?:営業|セールス|勧誘|販売|商業|営利).*?目的", f"(?:{_NO}|{_CANNOT}|{_KINDLY})"), ("迷惑.*?(?:電話|連絡|行為)", f"(?:{_NO})"),
)
_FORWARD = (
    ("(?:営業|セールス|勧誘|販売).*?(?:お受け|対応)", f"(?:{_CANNOT})"), (f"(?:営業|セールス|勧誘).*?{_WAY}", f"(?:{_KINDLY}|{_NOT})"), (f"業務.*?{_WAY}", f"(?:{_KINDLY}|{_CANNOT})"),
    ("(?:取材|(?:営業|□□)等?).*?(?:電話|連絡|お問い合わせ)", f"(?:{_CANNOT}|{_KINDLY})"), ("(?:営業|□□|勧誘|セールス).*?(?:等|など)", f"(?:{_CANNOT}|{_KINDLY})"),
)
_ENGLISH_NO = (
    r"\bno\s+(?:sales|solicitations?|cold\s*calls?|telemarketing|vendor\s+solicitations?)\b", r"\bno\s+vendors?\s*(?:contact|calls|emails)\b",
    r"\b(?:do\s*not|don''t|we\s*do\s*not|we\s*don''t|not)\s+(?:accept|take|allow|permit)\s+(?:sales|solicitations?|vendor\s+(?:contacts?|inquiries?)|cold\s*calls?|telemarketing)\b",
    r"\b(?:sales|solicitations?|telemarketing|cold\s*calls?|vendor\s+inquiries?)\s+(?:are|is)\s+(?:not\s+accepted|prohibited|forbidden)\b",
    r"\bplease\s+do\s+not\s+contact\s+us\s+for\s+(?:sales|marketing|business\s+proposals?)\b",
)
_FORBID = "(?i)" + "|".join([f"{a}.*?{b}" for a, b in (*_BOTH, *_FORWARD)] + [f"{b}.*?{a}" for a, b in _BOTH] + list(_ENGLISH_NO))


def _marked(c: str) -> str:
    """営業 that means business in general is written otherwise, so that patterns for sales pass it by."""
    return f"regexp_replace({c}, '営業({_AFTER})', '□□\\1', 'g')"


def _forbids(c: str) -> str:
    return f"(regexp_matches({c}, '{_KEYS}{_OTHER_KEYS}') or regexp_matches({_marked(c)}, '{_FORBID}'))"


def _prohibited(c: str) -> str:
    hit = f"regexp_extract({_marked(c)}, '({_FORBID})', 1)"
    words = "list_concat(list_transform(string_split('" + _AFTER + "', '|'), lambda w: concat('営業', w)), string_split('" + _ELSE + "', '|'))"
    other = f"(regexp_matches({c}, '{_OTHER_KEYS}') or ({hit} <> '' and not contains({hit}, '営業') and not contains({hit}, '□□')))"
    replaced = f"replace({c}, w, '')"
    return f"({_forbids(c)} and ({other} or len(list_filter({words}, lambda w: contains({c}, w) and not {_forbids(replaced)})) = 0))"


@query(
    f"""with a as (select event_id, user_id, {_SENTENCE} as s, {_SECOND} as t from events), b as (select *, {_prohibited('s')} as first, {_prohibited('t')} as second from a),
c as (select *, first::int + second::int as n,
  case when first then case when regexp_matches(s, 'ません|お断り|ご遠慮|お控え|do not|don''t|no |not accept|not be accepted|not allowed|not permitted') then 10 else 0 end
    + case when regexp_matches(s, '営業|セールス|勧誘|販売|sales|solicitation|telemarketing') and regexp_matches(s, '問い合わせ|連絡|電話|メール|contact|call|phone|email') then 15 else 0 end else 0 end
  + case when second then case when regexp_matches(t, 'ません|お断り|ご遠慮|お控え|do not|don''t|no |not accept|not be accepted|not allowed|not permitted') then 10 else 0 end
    + case when regexp_matches(t, '営業|セールス|勧誘|販売|sales|solicitation|telemarketing') and regexp_matches(t, '問い合わせ|連絡|電話|メール|contact|call|phone|email') then 15 else 0 end else 0 end as more from b),
d as (select *, case when n > 0 then least(100, case when user_id % 2 = 0 then 75 else 60 end + more + case when n = 2 then 5 else 0 end) else 0 end as score from c)
select event_id, first, second, score, case when n = 0 then 'none' when score >= 90 then 'high' when score >= 70 then 'medium' when score >= 50 then 'low' else 'very_low' end as level from d"""
)
def sales_notices(spark, d):
    """event_id, first, second, score, level: which of two sentences forbid sales contact, and how sure that is."""
    rows = table(spark, d, "events").select("event_id", "user_id", F.expr(_SENTENCE).alias("s"), F.expr(_SECOND).alias("t"))
    hits = rows.select("event_id", "user_id", "s", "t", prohibition.prohibited(F.col("s")).alias("first"), prohibition.prohibited(F.col("t")).alias("second"))
    found = F.filter(F.array(F.when(F.col("first"), F.col("s")), F.when(F.col("second"), F.col("t"))), lambda x: x.isNotNull())
    sure = hits.withColumn("c", prohibition.confidence(found, F.col("user_id") % 2 == 0))
    return sure.select("event_id", "first", "second", "c.score", "c.level")


_PHRASED = (
    "ご注意：営業のお電話はお断りします", "勧誘お断り、営業お断り", "商品のご紹介、サービスのご紹介はこちら", "PR目的での投稿", "同業者からのお問い合わせ", "いたずら目的でのお問い合わせは禁止です", "テレアポお断り", "普通の文です", "",
    "営業メールお断り・売り込みはお断り", "宣伝目的での利用に注意", "関係者以外のお問い合わせはご遠慮ください", "セールスのお電話",
)
_ELEMENTS = ("form", "p", "div", "span", "small", "em", "strong", "li", "td")
_SAYS_IT = (
    ("直接的な営業禁止", "0.9", "営業のお電話はお断り|営業電話お断り|営業電話はお断り|営業メールお断り|営業活動はお断り|営業目的でのご連絡はお断り|営業・勧誘はお断り|勧誘のお電話はお断り|勧誘電話お断り|売り込み電話お断り|売り込みはお断り|セールス電話お断り|テレアポお断り|営業お断り|勧誘お断り"),
    ("間接的な営業禁止", "0.7", "商品・サービスの売り込み|商品の売り込み|サービスの売り込み|宣伝目的での|広告目的での|PR目的での|商品のご紹介|サービスのご紹介|商材の紹介|ご提案のお電話|セールスのお電話|営業のご連絡"),
    ("条件付き制限", "0.6", "お客様以外からのお問い合わせはご遠慮|関係者以外のお問い合わせ|同業者からのお問い合わせ|競合他社からのお問い合わせ|イタズラ目的でのお問い合わせ|いたずら目的でのお問い合わせ"),
)


@query(
    f"""with a as (select event_id, 1 as place, {choose('event_id', _PHRASED)} as t, {choose('user_id', _ELEMENTS)} as e from events union all select event_id, 2, {choose('user_id + event_id', _PHRASED)}, {choose('event_id', _ELEMENTS)} from events),
p as (select category, w::double as w, unnest(string_split(ps, '|')) as phrase from (values {', '.join(f"('{c}', {w}, '{ps}')" for c, w, ps in _SAYS_IT)}) v(category, w, ps)),
m as (select event_id, place, phrase, category, least(1.0::double, w * case e when 'form' then 1.0::double when 'p' then 0.9::double when 'div' then 0.8::double when 'span' then 0.7::double when 'small' then 0.9::double when 'em' then 0.8::double when 'strong' then 0.8::double else 0.6::double end
  + 0.1::double * (contains(t, 'お問い合わせ')::int + contains(t, '注意')::int + contains(t, '注意事項')::int + contains(t, 'ご注意')::int + contains(t, '禁止')::int + contains(t, 'お断り')::int)) as sure from a join p on contains(lower(t), lower(phrase))),
u as (select * from m where sure >= 0.6::double qualify row_number() over (partition by event_id, phrase order by place) = 1),
g as (select event_id, count(*) as n, count(*) filter (where category = '直接的な営業禁止') as direct, max(sure) as most from u group by 1)
select event_id, coalesce(n, 0)::int as n, coalesce(direct, 0)::int as direct, round(coalesce(most, 0), 6) as confidence, case when coalesce(n, 0) = 0 then 'none' when direct >= 2 or most >= 0.9::double then 'strict' when direct >= 1 or most >= 0.8::double then 'moderate'
  when n >= 2 or most >= 0.7::double then 'mild' else 'weak' end as level from events left join g using (event_id)"""
)
def prohibition_levels(spark, d):
    """event_id, n, direct, confidence, level: phrases that forbid contact in two elements of a page, by category and element."""
    text = lambda said, kind: F.struct(F.expr(said).alias("text"), F.expr(kind).alias("element"))
    both = F.array(text(choose("event_id", _PHRASED), choose("user_id", _ELEMENTS)), text(choose("user_id + event_id", _PHRASED), choose("event_id", _ELEMENTS)))
    found = table(spark, d, "events").select("event_id", prohibition.phrase_level(prohibition.phrase_matches(both)).alias("l"))
    return found.select("event_id", "l.n", "l.direct", F.round("l.confidence", 6).alias("confidence"), "l.level")


@query(
    f"""with p as ({ORACLES['prohibition_levels']}), s as ({ORACLES['sales_notices']})
select p.event_id, (case p.level when 'weak' then 0 when 'mild' then 1 when 'strict' then 3 else 2 end >= 2) or s.level = 'high' or greatest(0, least(100, s.score)) >= 80 or p.n >= 2 as abort from p join s using (event_id)"""
)
def early_abort(spark, d):
    """event_id, abort: whether what two elements and two sentences of a page say is enough to stop."""
    both = prohibition_levels(spark, d).join(sales_notices(spark, d).select("event_id", "score", F.col("level").alias("sure")), "event_id")
    return both.select("event_id", scoring.abort_early(F.col("level"), F.col("sure"), F.col("score").cast("double"), F.col("n")).alias("abort"))


@query(
    with_sql("messages") + """, l as (select m.id, list(m.status) over (partition by e.user_id order by e.ts, m.id rows between 3 preceding and current row) as last from messages m join events e on e.event_id = m.id),
s as (select id, list_filter(last, lambda x: x is not null) as s from l)
select id, case when list_contains(s, 429) then 429 when list_contains(s, 403) then 403 when len(list_filter(s, lambda x: x between 500 and 599)) > 0 then list_filter(s, lambda x: x between 500 and 599)[1] else s[-1] end as status from s"""
)
def http_status_priority(spark, d):
    """id, status: which of a worker's last four answers counts."""
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), "user_id", "ts")
    rows = Window.partitionBy("user_id").orderBy("ts", "id").rowsBetween(-3, 0)
    last = messages(spark, d).select("id", "status").join(e, "id").select("id", F.collect_list("status").over(rows).alias("s"))
    return last.select("id", scoring.http_priority(F.col("s")).alias("status"))
