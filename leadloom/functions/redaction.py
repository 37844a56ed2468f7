"""Redaction of personal and company data in logs: ordered rules, a second rule set, JSON documents, and an audit of what is left."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: Japanese letters, and words of any script
JP = r"぀-ゟ゠-ヿ一-龯"
KANJI = r"゠-ヿ一-龯"
WORD = r"\p{L}\p{N}_"
FORMS = "株式会社|有限会社|合同会社|合資会社|合名会社|一般社団法人|公益社団法人|一般財団法人|公益財団法人|特定非営利活動法人|NPO法人"
# fixed values: (a cheap sign that the rule may apply, pattern, replacement) in the order in which they are applied
RULES = [
    (r"[=:]", r"(?i)(api[_-]?key|token|secret|password)\s*[=:]\s*[\"']?([a-zA-Z0-9_-]{8,})[\"']?", "$1=***REDACTED***"),
    ("://", r"https?://[^\s]+", "***URL_REDACTED***"),
    (r"[=:-]", r"(?i)(company[_-]?name|企業名|会社名)\s*[=:\-]\s*[\"']?([^\"'\s\n,}{]+)[\"']?", "$1=***COMPANY_NAME_REDACTED***"),
    ("会社|法人", rf"({FORMS})[{JP}{WORD}\s]{{1,50}}", "***COMPANY_REDACTED***"),
    ("会社|法人|コーポ|Corp|Inc|Ltd|Co[.]", rf"[{KANJI}]{{2,}}[{KANJI}{WORD}\s]*(?:株式会社|有限会社|会社|法人|コーポレーション|Corp|Inc|Ltd|Co\.)", "***COMPANY_REDACTED***"),
    ("(?i)url", r"(?i)(form[_-]?url|page[_-]?url|target[_-]?url)\s*[=:\-]\s*[\"']?([^\"'\s\n,}{]+)[\"']?", "$1=***FORM_URL_REDACTED***"),
    ("@", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "***EMAIL_REDACTED***"),
    ("0[0-9]", r"\b(0\d{1,4}-?\d{1,4}-?\d{3,4})\b", "***-***-****"),
    ("[都道府県市区町村]", r"[都道府県市区町村]{1,3}[0-9一二三四五六七八九十\-−]{1,10}", "***住所***"),
    ("[0-9]{4}", r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b", "****-****-****-****"),
    ("(?i)password", r"(?i)(password\s*=\s*['\"])([^'\"]+)(['\"])", "$1***REDACTED***$3"),
    ('"', r'(?i)("(?:password|secret|token|key|company_name|form_url|company_url)"\s*:\s*")([^"]+)(")', "$1***REDACTED***$3"),
    ("(?i)企業|company|会社", r"(?i)(企業|company|会社)[^\s]*[:\s]*([^\s\n,}{]+)", "$1: ***COMPANY_REDACTED***"),
    ("さん|様|氏|殿", rf"[{JP}]{{1,4}}\s*[{JP}]{{1,4}}(\s*(?:さん|様|氏|殿))", "***NAME_REDACTED***$1"),
    ("[田佐鈴高渡伊山中小加吉太花一次]", rf"(?:田中|佐藤|鈴木|高橋|渡辺|伊藤|山本|中村|小林|加藤|吉田|山田|太郎|花子|一郎|次郎)[{JP}]*", "***NAME_REDACTED***"),
    ("[=:]", r"(?i)(message|inquiry|comment|content|body|text|問い合わせ|メッセージ|本文|内容)\s*[=:]\s*[\"']?([^\"']{50,})[\"']?", "$1=***MESSAGE_REDACTED***"),
]
STRICT = [
    ("(?i)id", r"(?i)(id|ID)\s*[=:]\s*(\d+)", "$1=***ID_REDACTED***"),
    ("会社|法人|コーポ|Corp|Inc|Ltd|Co", rf"({FORMS}|会社|法人|コーポレーション|Corp|Inc|Ltd|Co)[{JP}{WORD}\s]{{1,50}}", "***COMPANY_REDACTED***"),
    ("Co|Inc|Ltd|LLC|Limited", r"\b[A-Z][a-zA-Z]{2,}\s+(?:Corp|Inc|Ltd|LLC|Co|Company|Corporation|Limited)\b", "***COMPANY_REDACTED***"),
    ("[.]", r"\b[a-zA-Z0-9-]+\.(com|co\.jp|jp|net|org|info|biz)[^\s]*", "***DOMAIN_REDACTED***"),
]
BATCH = [
    ("/jobs/", r"projects/[A-Za-z0-9\-]+/locations/[A-Za-z0-9\-]+/jobs/[A-Za-z0-9\-]+", "projects/***/locations/***/jobs/***"),
    ("/taskGroups/", r"projects/[A-Za-z0-9\-]+/locations/[A-Za-z0-9\-]+/taskGroups/[A-Za-z0-9\-]+", "projects/***/locations/***/taskGroups/***"),
    ("(?i)batch", r"(?i)(batch_job_name|batch_task_group|batch_service_account_email)\s*[=:\-]\s*[\"']?([^\"'\s\n,}{]+)[\"']?", "$1=***BATCH_REDACTED***"),
]
# fixed values: a text without one of these (in lower case) is left alone; capitals in the list never match a lower-cased text, and stay so
SIGNS = ("password", "secret", "token", "key", "api", "https://", "http://", "@", ".com", ".jp", "株式会社", "有限会社", "company_name", "form_url", "email")
# fixed values: a long text with one of these is a technical message, of which head and tail stay
TECHNICAL = (
    "error|exception|timeout|failed|failure|traceback|エラー|例外|タイムアウト|失敗|processing|connection|response|request|status|処理|接続|応答|リクエスト|ステータス|実行"
    "|success|completed|finished|done|ok|成功|完了|終了|正常|worker|process|thread|queue|buffer|ワーカー|プロセス|キュー|バッファ|debug|info|warning|critical|id:"
)
# fixed values: the second rule set, without regard to case
SECURE = [
    ("@", r"(?i)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "***@***.***"), ("0[0-9]", r"\b0\d{1,4}-\d{1,4}-\d{3,4}\b", "***-****-****"), ("0[0-9]", r"\b0\d{9,11}\b", "***********"),
    ("[=:]", r"(?i)(password|passwd|pwd|pass)\s*[=:]\s*['\"]?([^\s'\"]+)['\"]?", "$1=***"), ("[=:]", r"(?i)(token|secret|key|api_key)\s*[=:]\s*['\"]?([^\s'\"]+)['\"]?", "$1=***"),
    ("://", r"(?i)(https?://)[^:]+:[^@]+@", "$1***:***@"), ("-", r"\b\d{3}-\d{4}\b", "***-****"),
    ("[一-龯ひ-ゖヲ-ヶー]", r"[一-龯ひ-ゖヲ-ヶー]{2,8}\s*[一-龯ひ-ゖヲ-ヶー]{1,8}", "***名前***"), ("会社", r"(株式会社|有限会社|合同会社|合資会社|合名会社)\s*[^\s\n]{2,20}", "$1***"),
    ("[.]", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "***.***.***.**"), ("[0-9]{4}", r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b", "****-****-****-****"),
    ("[A-Za-z0-9]{20}", r"\b[A-Za-z0-9]{20,}\b", "***TOKEN***"),
]
# fixed values: what an audit looks for: level, kind, sign, pattern; without regard to case
AUDIT = [
    ("CRITICAL", "company", "会社|法人|コーポ|(?i)corp|inc|ltd|co[.]", rf"(?i)[{JP}]{{3,}}(?:株式会社|有限会社|会社|法人|コーポレーション|Corp|Inc|Ltd|Co\.)"),
    ("CRITICAL", "url", "(?i)://", r"(?i)https?://[^\s]+"), ("CRITICAL", "email", "@", r"(?i)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
    ("CRITICAL", "secret", "[=:]", r"(?i)(?:api[_-]?key|secret|token|password)\s*[=:]\s*[\"']?(?:[a-zA-Z0-9_-]{8,})[\"']?"),
    ("HIGH", "company_field", "[=:-]", r"(?i)(?:company[_-]?name|企業名|会社名)\s*[=:\-]\s*[\"']?(?:[^\"'\s\n,}{]+)[\"']?"),
    ("HIGH", "english_company", "(?i)co|inc|ltd|llc|limited", r"(?i)\b[A-Z][a-zA-Z]{2,}\s+(?:Corp|Inc|Ltd|LLC|Co|Company|Corporation|Limited)\b"),
    ("HIGH", "domain", "[.]", r"(?i)\b[a-zA-Z0-9-]+\.(?:com|co\.jp|jp|net|org|info|biz)[^\s]*"),
    ("HIGH", "person_field", "[=:-]", r"(?i)(?:name|email|message|phone|address|氏名|名前|メール|問い合わせ|電話|住所)\s*[=:\-]\s*[\"']?(?:[^\"'\s\n,}{]{3,})[\"']?"),
    ("MEDIUM", "japanese", f"[{JP}]", rf"[{JP}]{{3,}}"), ("MEDIUM", "id", "(?i)id", r"(?i)(?<!record_)(?:id)\s*[=:]\s*(?:\d+)"), ("LOW", "phone", "0[0-9]", r"\b0\d{1,4}-?\d{1,4}-?\d{3,4}\b"),
]
# fixed values: members of documents that are masked whole, as parts of their names in capitals
SECRET_KEYS = ("SUPABASE_SERVICE_ROLE_KEY", "SUPABASE_URL", "TARGETING_ID", "COMPANY_NAME", "企業名", "会社名", "FORM_URL", "COMPANY_URL", "PAGE_URL", "TARGET_URL", "NAME", "氏名", "名前", "EMAIL", "メール", "MESSAGE",
               "メッセージ", "問い合わせ", "本文", "内容", "PHONE", "電話", "TEL", "ADDRESS", "住所", "所在地")


def _bound(c: Column, f) -> Column:
    """f(c) with c as a variable: what f repeats is not spelt out again, so that chains of rules stay short."""
    return F.transform(F.array(c), f)[0]


def _applied(c: Column, rules: list[tuple[str, str, str]]) -> Column:
    def rule(sign: str, pattern: str, mark: str):
        return lambda x: F.when(x.rlike(sign), F.regexp_replace(x, pattern, F.lit(mark))).otherwise(x)

    for one in rules:
        c = _bound(c, rule(*one))
    return c


def suspicious(c: Column) -> Column:
    """Five characters or more, with a sign of what is redacted."""
    low = F.lower(c)
    found = F.lit(False)
    for sign in SIGNS:
        found = found | low.contains(sign)
    return (F.length(c) >= 5) & found


def redacted(c: Column, strict: bool = False, batch: bool = False) -> Column:
    """All rules in order, and then long texts, for texts with a sign; others stay."""
    rules = [*RULES, *(STRICT if strict else []), *(BATCH if batch else [])]
    return _bound(c, lambda x: F.when(suspicious(x), long_texts(_applied(x, rules))).otherwise(x))


def long_texts(c: Column) -> Column:
    """Runs of 30 Japanese letters or more: of technical ones head and tail stay, others go. Java replaces by pattern, so texts are cut at the runs."""
    return _bound(c, _long_texts)


def _long_texts(c: Column) -> Column:
    run = rf"[{JP}\s]{{30,}}"
    runs = F.concat(F.regexp_extract_all(c, F.lit(f"({run})"), F.lit(1)), F.array(F.lit("")))
    parts = F.split(c, run, -1)

    def kept(x: Column) -> Column:
        n = F.length(x)
        part = F.when(n > 50, F.concat(F.substring(x, 1, 20), F.lit("***[PARTIAL_REDACTED]***"), F.right(x, F.lit(15)))).otherwise(
            F.concat(F.substring(x, 1, 15), F.lit("***[INFO_REDACTED]***"), F.right(x, F.lit(10)))
        )
        return F.when(x == "", "").when(F.lower(x).rlike(TECHNICAL), part).otherwise("***TEXT_REDACTED***")

    pieces = F.zip_with(parts, F.transform(runs, kept), lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))
    return F.when(c.rlike(f"[{JP}]{{15}}|{run}"), F.array_join(pieces, "")).otherwise(c)


def strictly_redacted(c: Column) -> Column:
    """For shared logs: all rules, then ids but those of records, and every run of three Japanese letters; ``record_id`` with its number stays."""
    out = _masked_ids(redacted(c, strict=True))
    return F.regexp_replace(out, rf"[{JP}]{{3,}}", "***JP_TEXT***")


def _masked_ids(c: Column) -> Column:
    return F.regexp_replace(c, r"(?<!record_)(id|ID)\s*[=:]\s*(\d+)", "$1=***ID_REDACTED***")


def secure(c: Column) -> Column:
    """The log rules, then the second rule set."""
    return _applied(redacted(c), SECURE)


def audit(c: Column, strict: bool = True) -> Column:
    """array<struct<level, kind, matched, start, end>> of every match. strict: HIGH counts as CRITICAL, and MEDIUM is looked for."""
    found = []
    for level, kind, sign, pattern in AUDIT:
        if level == "MEDIUM" and not strict:
            continue
        shown = "CRITICAL" if level == "HIGH" and strict else level
        found.append(F.when(c.rlike(sign), _spans(c, shown, kind, pattern)).otherwise(_spans(F.lit(""), shown, kind, pattern)))
    return F.concat(*found)


def _spans(c: Column, level: str, kind: str, pattern: str) -> Column:
    """Where the matches lie: each begins after the text before it, which is what the splits give."""
    hits, gaps = F.regexp_extract_all(c, F.lit(f"({pattern})"), F.lit(1)), F.split(c, pattern, -1)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<level:string,kind:string,matched:string,start:int,end:int>>").alias("out"))
    pairs = F.zip_with(hits, F.slice(gaps, 1, F.greatest(F.size(hits), F.lit(1))), lambda h, g: F.struct(h.alias("h"), F.coalesce(g, F.lit("")).alias("g")))

    def step(acc, p):
        start = acc["at"] + F.length(p["g"])
        end = start + F.length(p["h"])
        one = F.struct(F.lit(level).alias("level"), F.lit(kind).alias("kind"), p["h"].alias("matched"), start.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    return F.aggregate(F.filter(pairs, lambda p: p["h"].isNotNull()), zero, step, lambda acc: acc["out"])


def audit_report(found: Column) -> Column:
    """struct<critical, high, medium, low, allowed>: counts by level, and whether nothing critical is in the message."""

    def of(level: str):
        return lambda v: v["level"] == level

    def counted(f: Column) -> Column:
        n = {level: F.size(F.filter(f, of(level))) for level in ("CRITICAL", "HIGH", "MEDIUM", "LOW")}
        return F.struct(*[c.alias(k.lower()) for k, c in n.items()], (n["CRITICAL"] == 0).alias("allowed"))

    return _bound(found, counted)


def redacted_json(c: Column) -> Column:
    """A JSON document with the members of secret names masked, and the rules applied to all other texts in it. A text that is no document is one such text."""
    rules = [(re.compile(sign), re.compile(_python(pattern)), re.sub(r"\$(\d)", r"\\\1", mark)) for sign, pattern, mark in RULES]

    def clean(v: str) -> str:
        if len(v) < 5 or not any(s in v.lower() for s in SIGNS):
            return v
        for sign, pattern, mark in rules:
            if sign.search(v):
                v = pattern.sub(mark, v)
        return v

    def walk(v):
        if isinstance(v, dict):
            return {k: "***REDACTED***" if any(s in k.upper() for s in SECRET_KEYS) else walk(x) for k, x in v.items()}
        if isinstance(v, list):
            return [walk(x) for x in v]
        return clean(v) if isinstance(v, str) else v

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        try:
            return json.dumps(walk(json.loads(t)), ensure_ascii=False, separators=(",", ":"))
        except (ValueError, RecursionError):
            return clean(t)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([one(t) for t in texts], dtype="object")

    return run(c)


def _python(pattern: str) -> str:
    return pattern.replace(WORD, r"\w")
