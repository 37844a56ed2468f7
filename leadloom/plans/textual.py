"""Queries over texts, pages and messages: scalar functions, links, scores. ORACLES states them for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadloom.functions import documents, numbers, redaction, text, urls
from leadloom.operators import prohibition, scoring
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



def _words(words, c: str) -> str:
    return "(" + " or ".join(f"contains({c}, '{w}')" for w in words) + ")"


# ---- text -------------------------------------------------------------------------------------------------------------
_SENTENCES = "list_filter(list_transform(string_split_regex({0}, '[。！？\\n\\r]+'), lambda x: trim(x)), lambda x: length(x) >= 10)"


@query(f"select doc_id, len(s) as n, coalesce(list_sum(list_transform(s, lambda x: length(x))), 0)::bigint as chars, md5(array_to_string(s, '|')) as digest from (select doc_id, {_SENTENCES.format('text')} as s from documents)")
def sentence_split(spark, d):
    s = text.sentences(F.col("text"))
    chars = F.aggregate(s, F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    return table(spark, d, "documents").select("doc_id", F.size(s).cast("long").alias("n"), chars.alias("chars"), F.md5(F.array_join(s, "|")).alias("digest"))


@query(
    f"select doc_id, count(*) as n, count(*) filter (where length(s) between 5 and 500 and not regexp_matches(s, '^[\\s\\d\\-_=+*#@\\[\\]()]+$') and not regexp_matches(s, '^[a-zA-Z\\s]+$')) as kept from (select doc_id, unnest({_SENTENCES.format('text')}) as s from documents) group by 1"
)
def meaningful_sentences(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.explode(text.sentences(F.col("text"))).alias("s"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(text.meaningful(F.col("s"))).alias("kept"))


_CHARS = "list_distinct(string_split({0}, ''))"


@query(
    f"select a.n_name as a, b.n_name as b, round(len(list_intersect({_CHARS.format('a.n_name')}, {_CHARS.format('b.n_name')})) / len(list_distinct(list_concat({_CHARS.format('a.n_name')}, {_CHARS.format('b.n_name')}))), 6) as similarity "
    "from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey"
)
def char_similarity(spark, d):
    n = table(spark, d, "nation")
    a, b = n.select(F.col("n_name").alias("a"), F.col("n_nationkey").alias("ka"), "n_regionkey"), n.select(F.col("n_name").alias("b"), F.col("n_nationkey").alias("kb"), "n_regionkey")
    return a.join(b, "n_regionkey").where("ka < kb").select("a", "b", F.round(text.char_jaccard(F.col("a"), F.col("b")), 6).alias("similarity"))


# the rules once more, written for DuckDB by hand; those for Japanese names and long texts find nothing in these documents
_SIGNS_SQL = (
    "length(text) >= 5 and (contains(low, 'password') or contains(low, 'secret') or contains(low, 'token') or contains(low, 'key') or contains(low, 'api') "
    "or contains(low, 'https://') or contains(low, 'http://') or contains(low, '@') or contains(low, '.com') or contains(low, '.jp') or contains(low, '株式会社') "
    "or contains(low, '有限会社') or contains(low, 'company_name') or contains(low, 'form_url') or contains(low, 'email'))"
)
_REDACT_STEPS = [
    (r"""(?i)(api[_-]?key|token|secret|password)\s*[=:]\s*["'']?([a-zA-Z0-9_-]{8,})["'']?""", r"\1=***REDACTED***"),
    (r"https?://[^\s]+", "***URL_REDACTED***"),
    (r"""(?i)(company[_-]?name|企業名|会社名)\s*[=:\-]\s*["'']?([^"''\s\n,}{]+)["'']?""", r"\1=***COMPANY_NAME_REDACTED***"),
    (r"""(?i)(form[_-]?url|page[_-]?url|target[_-]?url)\s*[=:\-]\s*["'']?([^"''\s\n,}{]+)["'']?""", r"\1=***FORM_URL_REDACTED***"),
    (r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "***EMAIL_REDACTED***"),
    (r"\b(0\d{1,4}-?\d{1,4}-?\d{3,4})\b", "***-***-****"),
    (r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b", "****-****-****-****"),
    (r"""(?i)(password\s*=\s*["''])([^"'']+)(["''])""", r"\1***REDACTED***\3"),
    (r"""(?i)("(?:password|secret|token|key|company_name|form_url|company_url)"\s*:\s*")([^"]+)(")""", r"\1***REDACTED***\3"),
    (r"(?i)(企業|company|会社)[^\s]*[:\s]*([^\s\n,}{]+)", r"\1: ***COMPANY_REDACTED***"),
    (r"""(?i)(message|inquiry|comment|content|body|text|問い合わせ|メッセージ|本文|内容)\s*[=:]\s*["'']?([^"'']{50,})["'']?""", r"\1=***MESSAGE_REDACTED***"),
]
_REDACT_SQL = "text"
for _pattern, _mark in _REDACT_STEPS:
    _REDACT_SQL = f"regexp_replace({_REDACT_SQL}, '{_pattern}', '{_mark}', 'g')"


@query(
    f"select doc_id, length(r) as n, md5(r) as digest, r <> text as changed from (select doc_id, text, case when {_SIGNS_SQL} then {_REDACT_SQL} else text end as r "
    "from (select doc_id, text, lower(text) as low from documents))"
)
def redact_text(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "text", redaction.redacted(F.col("text")).alias("r"))
    return rows.select("doc_id", F.length("r").cast("long").alias("n"), F.md5("r").alias("digest"), (F.col("r") != F.col("text")).alias("changed"))


_AUDIT_SQL = [
    ("CRITICAL", "url", r"(?i)https?://[^\s]+"), ("CRITICAL", "email", r"(?i)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
    ("CRITICAL", "secret", r"""(?i)(?:api[_-]?key|secret|token|password)\s*[=:]\s*["'']?(?:[a-zA-Z0-9_-]{8,})["'']?"""),
    ("CRITICAL", "domain", r"(?i)\b[a-zA-Z0-9-]+\.(?:com|co\.jp|jp|net|org|info|biz)[^\s]*"),
    ("CRITICAL", "person_field", r"""(?i)(?:name|email|message|phone|address|氏名|名前|メール|問い合わせ|電話|住所)\s*[=:\-]\s*["'']?(?:[^"''\s\n,}{]{3,})["'']?"""),
    ("LOW", "phone", r"\b0\d{1,4}-?\d{1,4}-?\d{3,4}\b"),
]


@query(
    "select * from (" + " union all ".join(
        f"select '{level}' as level, '{kind}' as kind, count(*) filter (where k > 0) as docs, coalesce(sum(k), 0)::bigint as hits from (select len(regexp_extract_all(text, '{p}')) as k from documents)"
        for level, kind, p in _AUDIT_SQL
    ) + ") where hits > 0"
)
def leak_audit(spark, d):
    """level, kind, docs, hits: the matches of an audit, by kind."""
    found = table(spark, d, "documents").select("doc_id", F.inline(redaction.audit(F.col("text"))))
    each = found.groupBy("doc_id", "level", "kind").agg(F.count("*").alias("k"))
    kinds = F.col("kind").isin("url", "email", "secret", "domain", "person_field", "phone")  # the others have their own cases
    return each.where(kinds).groupBy("level", "kind").agg(F.count("*").alias("docs"), F.sum("k").cast("long").alias("hits"))


_KEYWORDS = ("License", "the and", "idiot", "ung", "tion")


@query(f"select doc_id, list_filter(['{chr(39).join(()) or (chr(39) + ', ' + chr(39)).join(_KEYWORDS)}'], lambda w: contains(lower(text), lower(w))) as words from documents")
def keyword_match(spark, d):
    return table(spark, d, "documents").select("doc_id", text.matched_keywords(F.col("text"), list(_KEYWORDS)).alias("words"))


@query("select c_custkey, case when length(c_name) <= 2 then repeat('*', length(c_name)) else left(c_name, 1) || repeat('*', length(c_name) - 2) || right(c_name, 1) end as masked, left(c_name, 1) || '***@' || lower(c_mktsegment) || '.example' as email from customer")
def mask_fields(spark, d):
    email = F.concat(F.col("c_name"), F.lit("@"), F.lower("c_mktsegment"), F.lit(".example"))
    return table(spark, d, "customer").select("c_custkey", text.mask_edges(F.col("c_name")).alias("masked"), text.mask_email(email).alias("email"))


_TEMPLATE = "{company} 御中 {name} 様 ({city}) {missing}"


@query("select c_custkey, c_mktsegment || ' 御中 ' || c_name || ' 様 (' || coalesce(case when c_custkey % 5 <> 0 then n_name end, '') || ') {missing}' as message from customer join nation on c_nationkey = n_nationkey")
def template_expand(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    city = F.when(F.expr("c_custkey % 5 <> 0"), F.col("n_name"))
    return rows.select("c_custkey", text.expand(F.lit(_TEMPLATE), {"company": F.col("c_mktsegment"), "name": F.col("c_name"), "city": city}).alias("message"))


@query("select s_suppkey, array_to_string(list_filter([case when s_suppkey % 3 = 0 then '' else '03' end, cast(s_suppkey as varchar), case when s_suppkey % 4 = 0 then null else '99' end], lambda x: coalesce(x, '') <> ''), '-') as value from supplier")
def combine_values(spark, d):
    parts = [F.expr(e) for e in ("case when s_suppkey % 3 = 0 then '' else '03' end", "cast(s_suppkey as string)", "case when s_suppkey % 4 = 0 then null else '99' end")]
    return table(spark, d, "supplier").select("s_suppkey", text.joined(*parts, by="-").alias("value"))


_PHONE = "case p_partkey % 5 when 0 then 'tel[' || cast(p_partkey % 3 as varchar(5)) || ']' when 1 then 'phone' || cast(p_partkey % 3 + 1 as varchar(5)) when 2 then 'fax' when 3 then 'mail' || cast(p_partkey % 3 as varchar(5)) else 'TEL' end"


@query(
    f"select p_partkey, case when regexp_matches(lower(f), 'tel|phone|fax|電話') then case when regexp_extract(lower(f), '\\[(\\d+)\\]', 1) <> '' then cast(regexp_extract(lower(f), '\\[(\\d+)\\]', 1) as int) + 1 "
    f"when regexp_extract(lower(f), '(\\d)$', 1) <> '' then cast(regexp_extract(lower(f), '(\\d)$', 1) as int) else 1 end end as part from (select p_partkey, {_PHONE} as f from part)"
)
def phone_part(spark, d):
    return table(spark, d, "part").select("p_partkey", F.expr(_PHONE).alias("f")).select("p_partkey", text.phone_index(F.col("f")).alias("part"))


# ---- URLs -------------------------------------------------------------------------------------------------------------
@query(
    "select page_id, lower(split_part(split_part(rtrim(url, '/'), '#', 1), '?', 1)) as normalised, case when regexp_matches(lower(url), 'error|fail|invalid') then 'error' when regexp_matches(lower(url), 'thank|complete|success|finish|done|sent') then 'success' else 'other' end as kind from pages"
)
def url_normalize(spark, d):
    return table(spark, d, "pages").select("page_id", urls.normalised(F.col("url")).alias("normalised"), urls.kind(F.col("url")).alias("kind"))


@query("select u as normalised, count(*) as n, min(page_id) as first_page from (select page_id, lower(split_part(split_part(rtrim(url, '/'), '#', 1), '?', 1)) as u from pages) group by 1")
def url_normalize_dedup(spark, d):
    return table(spark, d, "pages").groupBy(urls.normalised(F.col("url")).alias("normalised")).agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


_HOST = "regexp_extract(lower({0}), '^[a-z][a-z0-9+.-]*://([^/?#:]*)', 1)"


@query(
    f"select page_id, regexp_matches(lower(url), '^https?://') and length(url) <= 2048 and not regexp_matches(url, '[\\s<>\"]') and regexp_matches({_HOST.format('url')}, '^([a-z0-9]([a-z0-9-]{{0,61}}[a-z0-9])?\\.)+[a-z]{{2,}}$') as ok from pages"
)
def url_valid(spark, d):
    return table(spark, d, "pages").select("page_id", urls.valid(F.col("url")).alias("ok"))


@query("select page_id, regexp_replace(url || case when contains(url, '?') then '&' else '?' end || 'token=abc' || page_id || '&q=1', '(?i)([?&](?:token|key|secret|password|auth)=)[^&#]*', '\\1***', 'g') as url from pages")
def redact_url_params(spark, d):
    u = F.concat("url", F.when(F.col("url").contains("?"), "&").otherwise("?"), F.lit("token=abc"), F.col("page_id").cast("string"), F.lit("&q=1"))
    return table(spark, d, "pages").select("page_id", urls.redact_params(u).alias("url"))


# ---- links ------------------------------------------------------------------------------------------------------------
_LINKS = (
    "l as (select page_id, url, unnest(regexp_extract_all(html, '<a\\s+href=\"([^\"]*)\"[^>]*>([^<]*)</a>', 1)) as href, unnest(regexp_extract_all(html, '<a\\s+href=\"([^\"]*)\"[^>]*>([^<]*)</a>', 2)) as text, "
    "unnest(range(len(regexp_extract_all(html, '<a\\s+href=\"([^\"]*)\"[^>]*>([^<]*)</a>', 1)))) as dom_index from pages)"
)


def _links(spark, d):
    return scoring.page_links(table(spark, d, "pages"))


@query(f"with {_LINKS} select page_id, count(*) as n, count(distinct href) as n_distinct, md5(string_agg(href || '|' || text, ',' order by dom_index)) as digest from l group by 1")
def page_links(spark, d):
    pairs = F.array_sort(F.collect_list(F.struct("dom_index", F.concat("href", F.lit("|"), "text").alias("v"))))
    return _links(spark, d).groupBy("page_id").agg(F.count("*").alias("n"), F.count_distinct("href").alias("n_distinct"), F.md5(F.array_join(F.transform(pairs, lambda p: p["v"]), ",")).alias("digest"))


_ALIKE = "len(list_intersect({a}, {b})) / greatest(1, len(list_distinct(list_concat({a}, {b}))))".format(a=_CHARS.format("k"), b=_CHARS.format("x[1]"))


@query(
    f"with {_LINKS}, t as (select page_id, list([text] order by length(text) desc, text) as texts from (select distinct page_id, text from l where text <> '') group by 1) "
    f"select page_id, list_reduce(texts, lambda acc, x: case when len(list_filter(acc, lambda k: contains(k, x[1]) or {_ALIKE} > 0.8)) > 0 then acc else list_concat(acc, x) end) as kept from t"
)
def fuzzy_dedup(spark, d):
    """page_id, kept: link texts of a page without those that a longer one contains or resembles."""
    links = scoring.page_links(table(spark, d, "pages"))
    return links.where("text <> ''").groupBy("page_id").agg(F.collect_set("text").alias("texts")).select("page_id", text.distinct_longest(F.col("texts")).alias("kept"))


# anchors of the pages never name a contact page, so words of the prose stand in for some of them
_TWISTED = "t as (select page_id, url, dom_index, case when dom_index = 1 then 'https://' || text || '.example/contact.pdf' when dom_index = 2 then '/Contact' when dom_index = 3 and page_id % 3 = 0 then 'mailto:x' else href end as href, case when dom_index = 2 and page_id % 2 = 0 then 'Contact us' when dom_index = 4 then 'Support careers' else text end as text from l)"


def _twisted(spark, d):
    k, p = F.col("dom_index"), F.col("page_id")
    href = F.when(k == 1, F.concat(F.lit("https://"), "text", F.lit(".example/contact.pdf"))).when(k == 2, "/Contact").when((k == 3) & (p % 3 == 0), "mailto:x").otherwise(F.col("href"))
    name = F.when((k == 2) & (p % 2 == 0), "Contact us").when(k == 4, "Support careers").otherwise(F.col("text"))
    return _links(spark, d).select("page_id", "url", "dom_index", href.alias("href"), name.alias("text"))


@query(
    f"with {_LINKS}, {_TWISTED} select page_id, count(*) filter (where {_HOST.format('href')} <> '' and {_HOST.format('href')} <> {_HOST.format('url')} and not ends_with(replace({_HOST.format('href')}, 'www.', ''), '.' || replace({_HOST.format('url')}, 'www.', ''))) as n_external from t group by 1"
)
def external_links(spark, d):
    return _twisted(spark, d).groupBy("page_id").agg(F.count_if(urls.external(F.col("href"), F.col("url"))).alias("n_external"))


# ---- numbers ----------------------------------------------------------------------------------------------------------
_CAPITAL = "case c_custkey % 5 when 0 then '資本金 1,' || lpad(cast(c_custkey % 1000 as varchar(9)), 3, '0') || '百万円' when 1 then cast(c_custkey % 90 as varchar(9)) || '.5億円' when 2 then cast(c_custkey % 3000 as varchar(9)) || '千円' when 3 then '12,345' else '非公開' end"
_DIGITS = "nullif(replace(regexp_extract(t, '([0-9][0-9,]*(?:\\.[0-9]+)?)\\s*{0}', 1), ',', ''), '')"


@query(
    f"with x as (select c_custkey, {_CAPITAL} as t from customer), a as (select c_custkey, t, cast({_DIGITS.format('百万円')} as double) as m, cast({_DIGITS.format('億円')} as double) as h, cast({_DIGITS.format('千円')} as double) / 1000 as k, cast({_DIGITS.format('')} as double) as g from x) "
    "select c_custkey, cast(case when contains(t, '百万円') then floor(m) when contains(t, '億円') then round_even(h * 100, 0) when contains(t, '千円') then case when k >= 1 then round_even(k, 0) when k is not null then 0 end else floor(g) end as bigint) as millions from a"
)
def capital_parse(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.expr(_CAPITAL).alias("t")).select("c_custkey", numbers.capital_millions(F.col("t")).alias("millions"))


_DATE = "case p_partkey % 5 when 0 then cast(1790 + p_partkey % 250 as varchar(9)) || '年' || cast(p_partkey % 15 as varchar(9)) || '月' when 1 then '設立 ' || cast(1900 + p_partkey % 150 as varchar(9)) || '年' when 2 then cast(1950 + p_partkey % 70 as varchar(9)) || '/' || lpad(cast(p_partkey % 14 as varchar(9)), 2, '0') when 3 then '不明' else '2001-07-15' end"


@query(
    f"with x as (select p_partkey, {_DATE} as t from part), a as (select p_partkey, try_cast(regexp_extract(t, '([0-9]{{4}})年\\s*([0-9]{{1,2}})月', 1) as int) as ky, try_cast(regexp_extract(t, '([0-9]{{4}})年\\s*([0-9]{{1,2}})月', 2) as int) as km, "
    "try_cast(regexp_extract(t, '([0-9]{4})年', 1) as int) as py, try_cast(regexp_extract(t, '([0-9]{4})[/-]([0-9]{1,2})', 1) as int) as sy, try_cast(regexp_extract(t, '([0-9]{4})[/-]([0-9]{1,2})', 2) as int) as sm from x), "
    "b as (select *, ky between 1800 and 2025 and km between 1 and 12 as f, py between 1800 and 2025 as o, sy between 1800 and 2025 and sm between 1 and 12 as s from a) "
    "select p_partkey, case when f then ky when o then py when s then sy end as year, case when f then km when o then null when s then sm end as month from b"
)
def established_date(spark, d):
    year, month = numbers.established(F.col("t"), 2025)
    return table(spark, d, "part").select("p_partkey", F.expr(_DATE).alias("t")).select("p_partkey", year.alias("year"), month.alias("month"))


@query("select o_orderkey, lpad(cast(o_orderkey % 10000000 as varchar), 7, '0')[:3] || '-' || lpad(cast(o_orderkey % 10000000 as varchar), 7, '0')[4:] as postal, case when o_orderkey % 2 = 0 then '03-' || lpad(cast(o_orderkey % 10000 as varchar), 4, '0') || '-5678' else '090-' || lpad(cast(o_orderkey % 10000 as varchar), 4, '0') || '-5678' end as phone from orders")
def postal_phone(spark, d):
    n = F.col("o_orderkey")
    p = F.concat(F.when(n % 2 == 0, "03").otherwise("090"), F.lpad((n % 10000).cast("string"), 4, "0"), F.lit("5678"))
    return table(spark, d, "orders").select("o_orderkey", numbers.postal(F.lpad((n % 10000000).cast("string"), 7, "0")).alias("postal"), numbers.phone(p).alias("phone"))


@query("select p_partkey, cast(ceil(p_size * 100 / 256.0) * 256 as bigint) as mb from part")
def resource_size(spark, d):
    return table(spark, d, "part").select("p_partkey", numbers.memory_size(F.col("p_size") * 100).alias("mb"))


# ---- classes ----------------------------------------------------------------------------------------------------------
_JUDGED = (
    "with x as (select event_id, event_id % 11 = 0 as p, event_id % 13 = 0 as b, event_id % 17 = 0 as e, event_id % 3 as r, event_id % 2 = 0 as u, event_id % 4 = 0 as sp, event_id % 5 = 0 as oh, "
    "event_id % 6 as st, event_id % 3 as fb, event_id % 2 as fn, event_id % 50 as eb, event_id % 31 as en from events), "
    "y as (select *, case when eb > 0 then 1 - en / eb else 0.0 end as sh from x), "
    "z as (select event_id, case when p or b or e then 0 when r >= 2 and st = 0 and not sp then 0 when u then 1 when st > 0 then 2 when fb > 0 and fn = 0 then 3 when sh > 0.5 then 4 "
    "when {0} then 5 else 6 end as k, * exclude (event_id) from y) "
    "select event_id, {1} as success, round(case when p then 1.0 when b then 0.95 when e then 0.9 when k = 0 then 0.85 when k = 1 then case when sp then 0.95 when oh then 0.85 else 0.9 end "
    "when k = 2 then least(0.95, 0.88 + least(0.02 * st, 0.07)) when k = 3 then 0.85 when k = 4 then least(0.83, 0.75 + 0.1 * sh) when k = 5 then {2} else 0.65 end, 6) as confidence, "
    "case when k = 4 then 3 else k end as stage from z"
)


def _judged(spark, d, compat: bool):
    e = F.col("event_id")
    out = scoring.judge(e % 11 == 0, e % 13 == 0, e % 17 == 0, e % 3, e % 2 == 0, e % 4 == 0, e % 5 == 0, e % 6, e % 3, e % 2, e % 50, e % 31, compat=compat)
    return table(spark, d, "events").select("event_id", out.alias("j")).select("event_id", "j.success", F.round("j.confidence", 6).alias("confidence"), "j.stage")


@query(_JUDGED.format("r > 0", "k not in (0, 5)", "least(0.75, 0.7 + 0.01 * r)"))
def success_judge(spark, d):
    return _judged(spark, d, compat=False)


@query(_JUDGED.format("true", "k <> 0", "0.72"))
def success_judge_compat(spark, d):
    return _judged(spark, d, compat=True)


_CONSENT = "case event_id % 6 when 0 then 'I agree to the privacy policy' when 1 then '個人情報の取り扱いに同意する' when 2 then 'terms' when 3 then 'newsletter 同意' when 4 then 'Privacy' else 'x' end"


@query(
    f"with c as (select event_id, lower({_CONSENT}) as t, value as dist from events) select event_id, round(case when regexp_matches(t, 'メルマガ|newsletter|配信') then 0.0 else (case when regexp_matches(t, '同意|agree|accept|consent') then 2.5 else 0.0 end) + least(3.0, (case when regexp_matches(t, 'プライバシー|privacy') then 1.5 else 0.0 end) "
    "+ (case when regexp_matches(t, '規約|terms') then 1.0 else 0.0 end) + (case when regexp_matches(t, '個人情報|personal') then 1.0 else 0.0 end)) + greatest(0.0, 2.0 - dist / 100.0) end, 6) as score from c"
)
def consent_score(spark, d):
    return table(spark, d, "events").select("event_id", F.round(scoring.consent_score(F.expr(_CONSENT), F.col("value")), 6).alias("score"))


@query(
    "with f as (select event_id, user_id, ts, event_type = 'error' as bad from events), b as (select *, sum(case when bad then 0 else 1 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as blk from f) "
    "select event_id, cast(sum(case when bad then 1 else 0 end) over w as bigint) as streak, sum(case when bad then 1 else 0 end) over w >= 3 as stop from b window w as (partition by user_id, blk order by ts, event_id rows unbounded preceding)"
)
def error_streaks(spark, d):
    rows = scoring.running_errors(table(spark, d, "events").select("event_id", "user_id", "ts", "event_type"), "user_id", ["ts", "event_id"], F.col("event_type") == "error")
    return rows.select("event_id", "streak", "stop")


#: Notices that are put behind the documents, none of which has one, and how many each page then has.
_NOTICES = [("営業目的のお問い合わせはお断りします", 1), ("営業時間は9時から18時までとなります", 0), ("セールスのお電話はご遠慮ください。勧誘メールはお受けしておりません", 2), ("we do not accept sales calls, thank you", 1)]


@query("select doc_id, cast(v.n as int) as n_prohibited from documents join (values " + ", ".join(f"({k}, {n})" for k, (_, n) in enumerate(_NOTICES)) + ") v(k, n) on doc_id % 4 = v.k")
def prohibition_scan(spark, d):
    """doc_id, n_prohibited, over all documents with a notice behind their text."""
    notice = F.element_at(F.array(*[F.lit(t) for t, _ in _NOTICES]), (F.col("doc_id") % 4 + 1).cast("int"))
    rows = table(spark, d, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("。"), notice, F.lit("。")).alias("page"))
    return rows.select("doc_id", F.size(prohibition.notices(F.col("page"))).alias("n_prohibited"))


# ---- JSON -------------------------------------------------------------------------------------------------------------
_JSON = "case event_id % 5 when 0 then '{ }' when 1 then ' [\n]' when 2 then 'null' when 3 then null else props end"


@query(f"select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, event_id % 5 <> 4 or props is null as empty from events")
def json_fields(spark, d):
    return table(spark, d, "events").select("event_id", documents.json_number(F.col("props"), "k").alias("k"), documents.json_empty(F.expr(_JSON)).alias("empty"))


@query("select event_id, '{\"batch\":{\"k\":' || json_extract_string(props, '$.k') || ',\"type\":\"' || event_type || '\"}}' as metadata from events where json_extract_string(props, '$.k') is not null")
def metadata_reshape(spark, d):
    rows = table(spark, d, "events").withColumn("k", documents.json_number(F.col("props"), "k")).where("k is not null")
    return rows.select("event_id", documents.nested("batch", {"k": F.col("k"), "type": F.col("event_type")}).alias("metadata"))


_LINE = "'{\"custom_id\":\"company_' || cast(conv_id as varchar(20)) || '\",\"status\":' || case when turn % 4 = 3 then '500' else '200' end || ',\"body\":' || case turn % 3 when 0 then '\"{}\"' when 1 then '\"ok\"' else 'null' end || '}'"


@query(
    f"with l as (select conv_id, turn, {_LINE} as line from conversations) select conv_id as company_id, count(*) as n, count(*) filter (where turn % 3 = 1) as success, count(*) filter (where turn % 3 = 0) as empty_form, count(*) filter (where turn % 3 = 2) as no_choices from l where turn % 4 <> 3 group by 1"
)
def llm_results_status(spark, d):
    lines = table(spark, d, "conversations").select(F.expr(_LINE).alias("line"))
    rows = lines.select(F.from_json("line", "custom_id string, status int, body string").alias("r")).where("r.status = 200")
    company = F.regexp_extract("r.custom_id", r"^company_(\d+)$", 1).cast("long")
    b = F.col("r.body")
    return rows.groupBy(company.alias("company_id")).agg(
        F.count("*").alias("n"), F.count_if(b == "ok").alias("success"), F.count_if(b == "{}").alias("empty_form"), F.count_if(b.isNull()).alias("no_choices")
    )
