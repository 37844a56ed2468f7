"""Classes of failures, by ordered rules over the message, the page and the HTTP status."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: patterns of messages in lower case, in the order in which they are tried; w stands for words and spaces
MESSAGE_RULES = [
    ("EXTERNAL", (
        r"network[\s\w]*timeout", r"server[\s\w]*error", r"connection[\s\w]*refused", r"site[\s\w]*maintenance", r"cloudflare[\s\w]*protection",
        r"access[\s\w]*denied", r"page\s+load[\s\w]*timeout",
    )),
    ("INSTRUCTION", (
        r"instruction_json[\s\w]*invalid", r"json[\s\w]*decode[\s\w]*error", r"placeholder[\s\w]*not[\s\w]*found", r"missing[\s\w]*instruction", r"invalid[\s\w]*json",
    )),
    ("SUBMIT_BUTTON", (
        r"submit\s*button[\s\w]*not\s*found", r"no\s*submit\s*button[\s\w]*selector", r"submit[\s\w]*selector[\s\w]*not[\s\w]*provided",
        r"button[\s\w]*type[\s\w]*submit[\s\w]*not[\s\w]*found",
    )),
    ("SUCCESS_DETERMINATION_FAILED", (
        r"cannot\s*determine\s*success", r"no[\s\w]*success[\s\w]*indicators", r"success[\s\w]*determination[\s\w]*failed",
        r"no[\s\w]*clear[\s\w]*success[\s\w]*error[\s\w]*indicators",
    )),
    ("CONTENT_ANALYSIS", (
        r"error[\s\w]*indicators[\s\w]*found[\s\w]*in[\s\w]*content", r"no[\s\w]*url[\s\w]*change[\s\w]*detected", r"content[\s\w]*analysis[\s\w]*failed",
        r"error[\s\w]*analyzing[\s\w]*page[\s\w]*content",
    )),
    ("ELEMENT_NOT_FOUND", (r"element[\s\w]*not[\s\w]*found[\s\w]*for", r"selector[\s\w]*not[\s\w]*found", r"element[\s\w]*timeout", r"locator[\s\w]*not[\s\w]*found")),
    ("INPUT_TYPE_MISMATCH", (
        r"cannot\s*type[\s\w]*into\s*input[\s\w]*type", r"input[\s\w]*type[\s\w]*mismatch", r"cannot[\s\w]*fill[\s\w]*field[\s\w]*type", r"error[\s\w]*filling[\s\w]*field",
    )),
    ("FORM_VALIDATION_ERROR", (r"validation[\s\w]*error", r"required[\s\w]*field[\s\w]*failed", r"form[\s\w]*validation[\s\w]*failed", r"invalid[\s\w]*input[\s\w]*value")),
]
# fixed values: signs of the network and of blocks, in the order in which they are tried
TIMEOUT = r"timeout|timed\s*out"
NETWORK_RULES = [
    ("DNS_ERROR", r"err_name_not_resolved|enotfound|dns\s*lookup\s*failed"), ("TLS_ERROR", r"ssl|tls|cert"), ("CONNECTION_RESET", r"econnreset|connection\s*reset|net::err_connection_reset"),
    ("PAGE_CLOSED", r"target\s*closed|execution\s*context\s*was\s*destroyed|frame\s*was\s*detached"),
    ("ELEMENT_NOT_INTERACTABLE", r"not\s*visible|zero\s*size|not\s*interactable|is\s*disabled"), ("BLOCKED_BY_CLIENT", r"err_blocked_by_client"),
    ("RATE_LIMIT", r"rate\s*limit|too\s*many\s*requests|429"),
]
FORBIDDEN = r"403|forbidden|アクセス拒否|権限がありません"
WALL = (
    r"cloudflare|just\s*a\s*moment|checking\s*your\s*browser|ddos\s*protection|akamai|reference\s*#\d+\.\w+\.\w+|incapsula|imperva|perimeterx|px-"
    r"|are\s*you\s*a\s*human|human\s*verification|verify\s*you\s*are\s*human"
)
MORE_RULES = [("RATE_LIMIT", r"throttled|リクエストが多すぎます"), ("WAF_CHALLENGE", r"attention required\s*\|\s*cloudflare|shield|bot manager|web application firewall")]
BOT = r"\b(?:recaptcha|cloudflare|bot)\b"
# fixed values: what pages say
REQUIRED = (
    r"未入力|入力\s*してください|入力されていません|必須\s*項目|必須です|選択\s*してください|チェック\s*してください|空白|空欄|\bfield\s+is\s+required\b|\brequired\s+field\b"
    r"|\bplease\s+(?:enter|select|fill)\b|\b(?:cannot\s+be\s+blank|must\s+not\s+be\s+empty)\b"
)
FORMAT = r"形式が正しくありません|正しく入力してください|invalid\s+format|invalid\s+(?:email|phone|url)|メール.*(?:形式|正しく|無効)|phone.*(?:invalid|format)"
CAPTCHA = r"captcha|私はロボットではありません|\brc-anchor(?:-[a-z0-9_-]+)?\b"
FORGERY = (
    r"(?:csrf|xsrf|forgery|authenticity)[^\n<]{0,80}(?:invalid|mismatch|expired|missing|required|failed|error)"
    r"|(?:csrf|ワンタイム(?:キー|トークン)|トークン)[^\n<]{0,80}(?:無効|不一致|期限|切れ|エラー)"
)
REPEATED = r"重複|既に(?:送信|登録)|duplicate|already\s+submitted"
MARKED = r"aria-invalid=\"true\"|required"
# fixed values: classes by HTTP status
STATUSES = {429: "RATE_LIMIT", 500: "SERVER_ERROR", 502: "SERVER_ERROR", 503: "SERVER_ERROR", 504: "SERVER_ERROR", 422: "FORM_VALIDATION_ERROR", 404: "NOT_FOUND", 401: "UNAUTHORIZED", 405: "METHOD_NOT_ALLOWED"}
# fixed values: what classes mean
CATEGORIES = {
    "HTTP": ("RATE_LIMIT", "SERVER_ERROR", "ACCESS", "UNAUTHORIZED", "NOT_FOUND", "METHOD_NOT_ALLOWED"), "NETWORK": ("DNS_ERROR", "TLS_ERROR", "CONNECTION_RESET", "BLOCKED_BY_CLIENT", "TIMEOUT"),
    "BROWSER": ("PAGE_CLOSED",), "WAF": ("WAF_CHALLENGE", "BOT_DETECTED"), "SECURITY": ("CSRF_ERROR",), "VALIDATION": ("MAPPING", "VALIDATION_FORMAT", "FORM_VALIDATION_ERROR"),
    "BUSINESS": ("DUPLICATE_SUBMISSION", "PROHIBITION_DETECTED"), "FORM_STRUCTURE": ("NO_MESSAGE_AREA",),
}
RETRYABLE = (
    "TIMEOUT", "DNS_ERROR", "TLS_ERROR", "CONNECTION_RESET", "BLOCKED_BY_CLIENT", "RATE_LIMIT", "SERVER_ERROR", "ACCESS", "ELEMENT_EXTERNAL", "INPUT_EXTERNAL", "SYSTEM",
)
COOLDOWN_S = {"RATE_LIMIT": 300, "WAF_CHALLENGE": 300, "SERVER_ERROR": 60, "ACCESS": 60}
RECOVERABLE = (
    "TIMEOUT", "ACCESS", "ELEMENT_EXTERNAL", "INPUT_EXTERNAL", "SYSTEM", "ELEMENT_NOT_FOUND", "CONTENT_ANALYSIS_FAILED", "SUBMIT_BUTTON_NOT_FOUND", "DNS_ERROR", "TLS_ERROR",
    "CONNECTION_RESET", "RATE_LIMIT", "SERVER_ERROR",
)
VETO = r"instruction_valid|placeholder|json decode|invalid selector|malformed|selector missing|not provided|type mismatch|validation error"
LEAST_CONFIDENCE = 0.2
# fixed values: classes of a script's own errors by words of the message, in order
SCRIPT_RULES = [
    ("SPREADSHEET_CONFIG_ERROR", r"spreadsheet|スプレッドシート|シート|が見つかりません|必須カラム|ヘッダー|データがありません"),
    ("GITHUB_API_ERROR", r"github|dispatch|repository|authorization|token|rate limit|http 404|http 403"),
    ("TARGETING_CONFIG_ERROR", r"targeting_id|ターゲティング|client_id|無効な値|設定が見つからない"),
    ("CLIENT_DATA_ERROR", r"company_name|form_sender_name|基本的なクライアント情報|結合|client_config"),
    ("JSON_PARSE_ERROR", r"json|parse|解析|send_days_of_week"), ("BUSINESS_HOURS_ERROR", r"営業時間|営業日|実行時間|時間外"),
    ("NETWORK_ERROR", r"network|timeout|connection|ネットワーク|接続|fetch"), ("PERMISSION_ERROR", r"permission|権限|unauthorized|forbidden|認証"),
]


# fixed values: answers of a service: status, category, severity, whether to try again, and after how many milliseconds
ANSWERS = [(401, "authentication", "high", False, 0), (404, "not_found", "medium", False, 0), (422, "validation", "medium", False, 0), *((k, "server_error", "medium", True, 10_000) for k in (500, 502, 503, 504))]
# fixed values: what a database says before it may work again, and when it will not; and the statuses of both
DATABASE_RETRY, DATABASE_FATAL = "timeout|connection|deadlock|lock_timeout|serialization_failure|temporary failure|service unavailable", "out of memory|configuration error|authentication|permission denied|invalid api key"
DATABASE_RETRY_STATUS, DATABASE_FATAL_STATUS = (429, 500, 502, 503, 504, 408), (401, 403)


def _low(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit("")))


def _first(m: Column, rules) -> Column:
    """The name of the first rule whose pattern is in m, or null."""
    pairs = [(name, p if isinstance(p, str) else "|".join(p)) for name, p in rules]
    return reduce(lambda acc, r: acc.when(m.rlike(r[1]), r[0]), pairs[1:], F.when(m.rlike(pairs[0][1]), pairs[0][0]))


def message_rule(message: Column) -> Column:
    return _first(_low(message), MESSAGE_RULES)


def network_class(message: Column, content: Column, more_rules: bool = False) -> Column:
    """Signs of the network in the message, of walls in the page, and with more_rules a few further ones on either; null if there are none.

    The further rules are off by default: the surveyed code ships them in a file that it cannot read.
    """
    m, c = _low(message), _low(content)
    walled = F.when(c.rlike(WALL), "WAF_CHALLENGE")
    found = [_first(m, NETWORK_RULES), F.when(m.rlike(FORBIDDEN), F.coalesce(walled, F.lit("ACCESS"))), walled]
    if not more_rules:
        return F.coalesce(*found)
    more = reduce(lambda acc, r: acc.when(m.rlike(r[1]) | c.rlike(r[1]), r[0]), MORE_RULES[1:], F.when(m.rlike(MORE_RULES[0][1]) | c.rlike(MORE_RULES[0][1]), MORE_RULES[0][0]))
    return F.coalesce(*found, more)


def page_class(content: Column) -> Column:
    """What the page says; null if nothing."""
    rules = [("MAPPING", REQUIRED), ("VALIDATION_FORMAT", FORMAT), ("BOT_DETECTED", CAPTCHA), ("CSRF_ERROR", FORGERY), ("DUPLICATE_SUBMISSION", REPEATED), ("FORM_VALIDATION_ERROR", MARKED)]
    return _first(_low(content), rules)


def _analysis(m: Column) -> Column:
    return F.when(m.contains("error indicators found"), "FORM_VALIDATION_ERROR").otherwise("CONTENT_ANALYSIS_FAILED")


def error_type(
    message: Column, content: Column | None = None, status: Column | None = None, bot: Column | None = None, timeout: Column | None = None,
    rule: Column | None = None, network: Column | None = None,
) -> Column:
    """Bots and timeouts, the status, the message's rule, the network, then words of the message. rule, network: what is known of the message already."""
    content = F.lit("") if content is None else content
    m, rule = _low(message), message_rule(message) if rule is None else rule
    network = network_class(message, content) if network is None else network
    special = F.when(m.rlike(BOT) | (F.lit(False) if bot is None else bot), "BOT_DETECTED").when(m.rlike(TIMEOUT) | (F.lit(False) if timeout is None else timeout), "TIMEOUT")
    by_status = None
    if status is not None:
        by_status = F.when(status == 403, F.when(_low(content).rlike(WALL), "WAF_CHALLENGE").otherwise("ACCESS"))
        for code, name in STATUSES.items():
            by_status = by_status.when(status == code, name)
    external = F.coalesce(F.when(m.rlike(TIMEOUT), "TIMEOUT"), _first(m, [r for r in NETWORK_RULES if r[0] in ("DNS_ERROR", "TLS_ERROR", "CONNECTION_RESET", "BLOCKED_BY_CLIENT")]), F.lit("ACCESS"))
    button = F.when(m.contains("not found") | ~m.contains("selector"), "SUBMIT_BUTTON_NOT_FOUND").when(m.contains("not provided") | m.contains("missing"), "SUBMIT_BUTTON_SELECTOR_MISSING")
    refined = F.when(rule == "EXTERNAL", external).when(rule == "SUBMIT_BUTTON", button.otherwise("SUBMIT_BUTTON_ERROR")).when(rule == "CONTENT_ANALYSIS", _analysis(m)).otherwise(rule)
    rest = (
        F.when(m.rlike(r"\b(?:parse|decode|invalid|missing)\b"), F.when(m.rlike(r"\b(?:instruction|json)\b"), "INSTRUCTION").otherwise("SYSTEM"))
        .when(m.rlike(r"\b(?:element|selector|locator)\b"), "ELEMENT_EXTERNAL").when(m.contains("input"), "INPUT_EXTERNAL").when(m.contains("submit"), "SUBMIT")
        .when(m.contains("access"), "ACCESS").otherwise("SYSTEM")
    )
    found = [special, *([] if by_status is None else [by_status]), refined, network, rest]
    return F.coalesce(*found)


def submission_error(message: Column, content: Column, selector: Column) -> Column:
    """The class of a failed submission: some rules of the message, what is required or malformed, the network, the page, a missing selector."""
    return _bound(message, content, lambda x: _submission_error(x, selector))


def _bound(message: Column, content: Column, f) -> Column:
    """f of a struct of message, content, rule and network, as a variable: the rules are tried once, however often f looks at what they found."""
    found = F.struct(message.alias("message"), content.alias("content"), message_rule(message).alias("rule"), network_class(message, content).alias("network"))
    return F.transform(F.array(found), f)[0]


def _submission_error(x: Column, selector: Column) -> Column:
    message, content, rule, network = (x[k] for k in ("message", "content", "rule", "network"))
    m, c = _low(message), _low(content)
    early = F.when(rule == "SUBMIT_BUTTON", "SUBMIT_BUTTON_NOT_FOUND").when(rule == "CONTENT_ANALYSIS", _analysis(m)).when(rule.isin("SUCCESS_DETERMINATION_FAILED", "FORM_VALIDATION_ERROR"), rule)
    stated = F.when(c.rlike(REQUIRED) | m.rlike(REQUIRED), "MAPPING").when(c.rlike(FORMAT) | m.rlike(FORMAT), "VALIDATION_FORMAT")
    absent = F.trim(F.coalesce(selector, F.lit(""))) == ""
    lacking = F.when(absent, F.when(m.contains("not found") | m.contains("no submit button"), "SUBMIT_BUTTON_NOT_FOUND").otherwise("SUBMIT_BUTTON_SELECTOR_MISSING"))
    return F.coalesce(early, stated, network, page_class(content), lacking, error_type(message, content, rule=rule, network=network))


def input_error(message: Column) -> Column:
    """The class of a failure to fill a field."""
    m, rule = _low(message), message_rule(message)
    own = F.when(rule.isin("ELEMENT_NOT_FOUND", "INPUT_TYPE_MISMATCH", "FORM_VALIDATION_ERROR"), rule).when(m.contains("not found"), "ELEMENT_NOT_FOUND")
    return F.coalesce(own, error_type(message))


def recoverable(code: Column, message: Column) -> Column:
    return code.isin(*RECOVERABLE) & ~_low(message).rlike(VETO)


def category(code: Column) -> Column:
    pairs = [(name, codes) for name, codes in CATEGORIES.items()]
    return reduce(lambda acc, r: acc.when(code.isin(*r[1]), r[0]), pairs[1:], F.when(code.isin(*pairs[0][1]), pairs[0][0])).otherwise("GENERAL")


def cooldown(code: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in COOLDOWN_S.items() for x in kv])[code], F.lit(0))


def confidence(code: Column, message: Column, content: Column) -> Column:
    """0.6 if the text bears the class out, small additions and deductions, at least 0.2."""
    m, c = _low(message), _low(content)
    network = dict(NETWORK_RULES)
    strong = (
        reduce(lambda a, b: a | b, ((code == k) & m.rlike(network[k]) for k in ("DNS_ERROR", "TLS_ERROR", "CONNECTION_RESET", "RATE_LIMIT")))
        | ((code == "WAF_CHALLENGE") & c.rlike(WALL)) | ((code == "CSRF_ERROR") & (m.rlike(FORGERY) | c.rlike(FORGERY)))
        | (code.isin("MAPPING", "VALIDATION_FORMAT") & (m.rlike(f"{REQUIRED}|{FORMAT}") | c.rlike(f"{REQUIRED}|{FORMAT}")))
    )
    tenths = (
        F.when(strong, 6).otherwise(0) + F.when(m.rlike("http|status|error|forbidden|unauthorized"), 1).otherwise(0) + F.when(c.rlike(CAPTCHA), 1).otherwise(0)
        - F.when(code.isin("SYSTEM", "CONTENT_ANALYSIS_FAILED", "SUBMIT"), 2).otherwise(0) - F.when((m == "") & (c == ""), 2).otherwise(0)
    )
    return F.greatest(F.lit(LEAST_CONFIDENCE), F.least(F.lit(1.0), tenths / 10.0))


def detail(message: Column, content: Column, status: Column) -> Column:
    """struct<code, category, retryable, cooldown_seconds, confidence>; with a status by ``error_type``, else by ``submission_error`` without a selector."""

    def coded(x: Column) -> Column:
        return F.when(status.isNotNull(), error_type(x["message"], x["content"], status, rule=x["rule"], network=x["network"])).otherwise(_submission_error(x, F.lit("")))

    def made(code: Column) -> Column:
        return F.struct(
            code.alias("code"), category(code).alias("category"), code.isin(*RETRYABLE).alias("retryable"), cooldown(code).alias("cooldown_seconds"),
            confidence(code, message, content).alias("confidence"),
        )

    return F.transform(F.array(_bound(message, content, coded)), made)[0]


def failure_detail(kind: Column, base: Column) -> Column:
    """The detail of a failed company: two kinds replace what was found; without anything found, the kind or UNKNOWN of category SYSTEM."""

    def made(code: Column, cat: str, sure: float) -> Column:
        return F.struct(
            code.alias("code"), F.lit(cat).alias("category"), F.lit(False).alias("retryable"), F.lit(0).alias("cooldown_seconds"), F.lit(sure).alias("confidence"),
        )

    return (
        F.when(kind == "PROHIBITION_DETECTED", made(kind, "BUSINESS", 1.0)).when(kind == "NO_MESSAGE_AREA", made(kind, "FORM_STRUCTURE", 1.0))
        .when(base.isNotNull(), base).otherwise(made(F.when(F.coalesce(kind, F.lit("")) == "", "UNKNOWN").otherwise(kind), "SYSTEM", 0.0))
    )


def script_error(message: Column) -> Column:
    """The class of a job script's own error."""
    return F.coalesce(_first(_low(message), SCRIPT_RULES), F.lit("SYSTEM_ERROR"))


def api_error(status: Column, body: Column, error: Column) -> Column:
    """struct<category, severity, retryable, delay_ms> of a service's answer: a broken connection first, then the status."""

    def made(kind: str, severity: str, again: bool, delay: int) -> Column:
        return F.struct(F.lit(kind).alias("category"), F.lit(severity).alias("severity"), F.lit(again).alias("retryable"), F.lit(delay).alias("delay_ms"))

    limited = F.coalesce(body.contains("rate limit"), F.lit(False))
    found = F.when(F.coalesce(error, F.lit("")).rlike("timeout|network"), made("network", "low", True, 5000))
    found = found.when((status == 403) & limited, made("rate_limit", "medium", True, 60_000)).when(status == 403, made("permission", "high", False, 0))
    for code, *rest in ANSWERS:
        found = found.when(status == code, made(*rest))
    found = found.when(status.between(400, 499), made("client_error", "medium", False, 0)).when(status >= 500, made("server_error", "medium", True, 5000))
    return found.otherwise(made("unknown", "medium", False, 0))


def database_error(message: Column, status: Column) -> Column:
    """struct<retryable, fatal, category> of a database's error: what is fatal is not tried again."""
    m = _low(message)
    fatal = m.rlike(DATABASE_FATAL) | F.coalesce(status.isin(*DATABASE_FATAL_STATUS), F.lit(False))
    again = m.rlike(DATABASE_RETRY) | F.coalesce(status.isin(*DATABASE_RETRY_STATUS), F.lit(False))
    kind = F.when(fatal, "FATAL").when(again, "RETRYABLE").otherwise("CLIENT_ERROR")
    return F.struct((again & ~fatal).alias("retryable"), fatal.alias("fatal"), kind.alias("category"))
