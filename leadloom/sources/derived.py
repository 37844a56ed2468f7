"""Messages, form fields and clients as views over the driver tables.

Like the lead tables, a column is one SQL expression that Spark and DuckDB read alike. Each draws on columns of its own, so that words meet in
thousands of combinations and a table of more rows has more of them.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.sources.views import stored_bytes, table

#: Of a table's files, what a task takes of the fields.
PART_BYTES = 4 << 20


def choose(number: str, words: tuple) -> str:
    """The word of a number (modulo how many there are); None is null."""
    cases = " ".join(f"when {k} then '{w}'" for k, w in enumerate(words) if w is not None)
    return f"case cast(({number}) % {len(words)} as int) {cases} end"


def picked(number: str, words: tuple) -> str:
    """``choose`` for Spark: a literal array and one lookup, where a case asks for the number again in each branch and grows beyond what is compiled."""
    return f"get(array({', '.join('null' if w is None else f"'{w}'" for w in words)}), cast(({number}) % {len(words)} as int))"


_CENTS = "cast(floor(value * 100) as bigint)"
MESSAGE_A = (
    "", "Error:", "net::ERR_NAME_NOT_RESOLVED", "HTTP 429", "403 Forbidden", "Submit button", "no submit button", "Element", "locator", "Cannot type text into", "json", "connection", "Target closed", "SSL",
    "network", "rate limit", "HTTP 500",
)
MESSAGE_B = (
    "", "selector", "decode", "timeout", "not found", "not found for", "refused", "reset", "input type", "mismatch", "validation", "validation error", "server", "site maintenance", "filling the field",
    "access denied", "missing", "invalid", "required field failed", "instruction", "not visible", "is disabled", "determination failed",
)
MESSAGE_C = (
    "", "in content", "error", "failed", "selector", "not provided", "bot", "cloudflare", "element", "submit", "input", "access", "parse", "token", "timed out", "dns lookup failed", "invalid json", "type mismatch",
    "cannot determine success", "no url change detected", "error indicators found in content", "content analysis failed", "repository", "spreadsheet", "営業時間外", "targeting_id", "client_config", "権限がありません", "必須項目", "malformed", "接続",
)
CONTENT = (
    "", "captcha", "Cloudflare", "Checking your browser", "この項目は必須です", "入力 してください", "メールの形式が正しくありません", "CSRF token mismatch", "既に送信されています", '<input aria-invalid="true">', "required",
    "please enter a name", "invalid email", "ありがとうございました", "トークンの期限", "Akamai reference #12.ab.34", "rc-anchor-x", "duplicate entry", "ようこそ",
)
CODES = (
    "TIMEOUT", "SYSTEM", "ELEMENT_NOT_FOUND", "MAPPING", "BOT_DETECTED", "SUBMIT_BUTTON_NOT_FOUND", "RATE_LIMIT", "DNS_ERROR", "TLS_ERROR", "ACCESS", "SERVER_ERROR", "VALIDATION_FORMAT", "NEW_KIND", "CSRF_ERROR",
    "PAGE_CLOSED", "WAF_CHALLENGE", "DUPLICATE_SUBMISSION", "NO_MESSAGE_AREA", "PROHIBITION_DETECTED", "CONTENT_ANALYSIS_FAILED", None, "",
)


def _message_rules(choose) -> dict[str, str]:
    return {
        "id": "event_id",
        "message": f"nullif(trim(concat_ws(' ', {choose('event_id', MESSAGE_A)}, {choose('user_id', MESSAGE_B)}, {choose(_CENTS, MESSAGE_C)})), '')",
        "content": f"case when event_id % 31 = 5 then null else {choose('cast(floor(value) as bigint) + user_id', CONTENT)} end",
        "selector": choose("user_id", (None, "#send", " ", "button.x")),
        "status": "case cast(floor(value * 10) as bigint) % 14 when 0 then 429 when 1 then 403 when 2 then 500 when 3 then 503 when 4 then 422 when 5 then 404 when 6 then 401 when 7 then 405 when 8 then 200 when 9 then 504 end",
        "code": choose("event_id + user_id", CODES),
        "kind": choose(f"{_CENTS} + event_id", CODES),
        "sure": "cast(user_id % 11 as double) / 10",
    }


MESSAGE_RULES = _message_rules(choose)
MESSAGES_SQL = "messages as (select " + ", ".join(f"{e} as {c}" for c, e in MESSAGE_RULES.items()) + " from events)"

# ---- form fields: an order is a form, and a line of it a field
FIELD_NAMES = (
    "company", "your-name", "last_name", "first_name", "sei_kana", "mei_kana", "email", "mail_confirm", "tel", "tel1", "tel2", "zip", "pref", "addr1", "url", "subject", "message", "fax", "user_kana", "body", "department",
    "honeypot", "x", "", "inquiry_body", "corp-name", "confirmation", "telefax", "hiragana", "postal_code",
)
LABELS = (
    "会社名", "お名前", "姓", "名", "フリガナ", "セイ", "メイ", "メールアドレス", "メールアドレス（確認）", "電話番号", "郵便番号", "都道府県", "住所", "ホームページURL", "件名", "お問い合わせ内容", "部署名", "役職", "性別", "ご意見", "Tel / E-mail", "Company name",
    "", "ホテルのご要望", "知ったきっかけ 役職", "本文", "ふりがな", "ご連絡 時間 電話", "氏名 必須", "Name *", "お名前（任意）",
)
CLASSES = ("", "form-control", "required", "input-fax", "unrequired", "no-print", "mail-box", "faxes", "corp", "field must", "is-required wide", "hissu")
PLACEHOLDERS = (None, "", "例）山田", "フリガナ", "your mail", "03-1234-5678", "姓", "名", "kana", "message here", "Company")
STYLES = (None, "", "color: red", "display: none", "opacity: 0.5", "opacity:0;", "position: absolute; left: -9999px", "visibility:hidden")
FIELDS = (
    "メールアドレス", "電話番号", "郵便番号", "都道府県", "お問い合わせ本文", "住所", "会社名", "姓", "名", "件名", "役職", "姓カナ", "名カナ", "統合氏名", "姓ひらがな", "企業URL", "性別",
)


def _field_rules(choose) -> dict[str, str]:
    return {
        "form": "l_orderkey",
        "pos": "cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as int)",
        "type": choose("l_partkey", ("text", "text", "email", "tel", "url", "textarea", "select", "hidden", "text")),
        "name": choose("l_suppkey * 7 + l_partkey", FIELD_NAMES),
        "ident": choose("l_partkey * 3 + cast(l_quantity as bigint)", FIELD_NAMES),
        "label": choose("l_partkey + l_suppkey + l_orderkey", LABELS),
        "classes": choose("cast(l_quantity as bigint) + l_linenumber", CLASSES),
        "placeholder": choose("l_suppkey + l_linenumber", PLACEHOLDERS),
        "style": choose("l_partkey + cast(round(l_tax * 100) as bigint)", STYLES),
        "visible": "l_suppkey % 9 <> 4",
        "enabled": "l_partkey % 13 <> 6",
        "must": "l_returnflag = 'R' and l_linenumber % 2 = 0",
        "aria": "case cast(round(l_discount * 100) as bigint) % 4 when 0 then 'true' when 1 then 'false' end",
        "field": choose("l_partkey + l_linenumber", FIELDS),
        "score": "cast(60 + (l_partkey + l_suppkey) % 60 as int)",
        "x": "cast(l_suppkey % 7 * 60 as double)",
        "y": "cast(l_partkey % 3 * 40 as double)",
    }


FIELD_RULES = _field_rules(choose)
FIELDS_SQL = (
    "fields as (select *, case when type in ('textarea', 'select') then type else 'input' end as tag from (select " + ", ".join(f"{e} as {c}" for c, e in FIELD_RULES.items()) + " from lineitem) z)"
)

# ---- clients: what a sender fills in


def _client_rules(choose) -> dict[str, str]:
    return {
        "id": "c_custkey",
        "company_name": "case when c_custkey % 17 = 3 then null else c_name end",
        "last_name": choose("c_custkey", ("山田", " 佐藤 ", "", "林", None)),
        "first_name": choose("c_custkey", ("太郎", "花子", "林", "")),
        "last_name_kana": choose("c_custkey", ("ヤマダ", None, "サトウ")),
        "email_1": "case when c_custkey % 7 = 2 then '' else 'user' || cast(c_custkey as varchar(20)) end",
        "email_2": choose("c_custkey", ("a.example", "b.example", None)),
        "phone_1": choose("c_nationkey", ("03", "090", "")),
        "phone_2": "cast(1000 + c_custkey % 9000 as varchar(20))",
        "phone_3": "cast(1000 + c_custkey * 7 % 9000 as varchar(20))",
        "postal_code_1": "cast(100 + c_nationkey as varchar(20))",
        "postal_code_2": "cast(1000 + c_custkey % 8999 as varchar(20))",
        "address_1": choose("c_nationkey", ("東京都", "大阪府", "")),
        "address_2": "'区' || cast(c_nationkey as varchar(20))",
        "address_3": choose("c_custkey", ("神田", "", None)),
        "address_4": "cast(c_custkey % 30 as varchar(20)) || '-1'",
        "address_5": choose("c_custkey", ("ビル5F", "", None, "　")),
        "gender": choose("c_custkey + c_nationkey", ("男性", "女性", "Female", "回答しない", "x", None, " Woman ", "じょせい")),
    }


CLIENT_RULES = _client_rules(choose)
CLIENTS_SQL = "clients as (select " + ", ".join(f"{e} as {c}" for c, e in CLIENT_RULES.items()) + " from customer)"
SQL = {"messages": MESSAGES_SQL, "fields": FIELDS_SQL, "clients": CLIENTS_SQL}


def _view(spark: SparkSession, sf_dir: str, source: str, rules: dict[str, str]) -> DataFrame:
    return table(spark, sf_dir, source).select(*[F.expr(e).alias(c) for c, e in rules.items()])


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "events", _message_rules(picked))


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a field. Lines are numbered first and get their words then: only numbers are dealt by form, and what follows by form is dealt already."""
    rules = _field_rules(picked)
    lines, parts = table(spark, sf_dir, "lineitem"), math.ceil(stored_bytes(spark, sf_dir, "lineitem") / PART_BYTES)
    if parts > int(spark.conf.get("spark.sql.shuffle.partitions")):  # a task sorts a part of bounded size, whatever the table's
        lines = lines.repartition(parts, "l_orderkey")
    numbered = lines.withColumn("__pos", F.expr(rules["pos"]))
    kind = F.when(F.col("type").isin("textarea", "select"), F.col("type")).otherwise("input")
    return numbered.select(*[F.expr("__pos" if c == "pos" else e).alias(c) for c, e in rules.items()]).withColumn("tag", kind)


def clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "customer", _client_rules(picked))


def with_sql(*views: str) -> str:
    return "with " + ", ".join(SQL[v] for v in views)
