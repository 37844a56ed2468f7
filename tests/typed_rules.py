"""Rules on stated cases: errors, prohibition, redaction, hosts, hours, fields and their values."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadloom.functions import html, redaction
from leadloom.operators import errors, mapping, prohibition, safeguards, scores
from typed import cases

# ---- errors
cases(
    "submission_error_cases", "message string, content string, selector string", "code string",
    [
        (("HTTP 429 Too Many Requests", "", "#send"), ("RATE_LIMIT",)), (("net::ERR_NAME_NOT_RESOLVED while navigating", "", "#send"), ("DNS_ERROR",)),
        (("", "必須項目を入力してください", "#send"), ("MAPPING",)), (("", "メールアドレスの形式が正しくありません", "#send"), ("VALIDATION_FORMAT",)),
        (("Submit button not found", "", ""), ("SUBMIT_BUTTON_NOT_FOUND",)), (("No submit button selector", "", ""), ("SUBMIT_BUTTON_NOT_FOUND",)),
        (("odd", "", ""), ("SUBMIT_BUTTON_SELECTOR_MISSING",)), (("odd not found", "", " "), ("SUBMIT_BUTTON_NOT_FOUND",)),
        (("", "<div class=g-recaptcha></div>", "#b"), ("BOT_DETECTED",)), (("", "CSRF token mismatch", "#b"), ("CSRF_ERROR",)), (("", "csrf token", "#b"), ("SYSTEM",)),
        (("", "既に送信されています", "#b"), ("DUPLICATE_SUBMISSION",)), (("", "<input aria-invalid=\"true\">", "#b"), ("FORM_VALIDATION_ERROR",)),
        (("403 Forbidden", "Checking your browser", "#b"), ("WAF_CHALLENGE",)), (("403 Forbidden", "", "#b"), ("ACCESS",)), (("validation error on field", "", "#b"), ("FORM_VALIDATION_ERROR",)),
        (("error indicators found in content", "", "#b"), ("FORM_VALIDATION_ERROR",)), (("no url change detected", "", "#b"), ("CONTENT_ANALYSIS_FAILED",)),
        (("Target closed", "", "#b"), ("PAGE_CLOSED",)), (("element is not visible", "", "#b"), ("ELEMENT_NOT_INTERACTABLE",)), (("request throttled", "", "#b"), ("SYSTEM",)),
        (("Navigation timed out", "", "#b"), ("TIMEOUT",)), (("cannot determine success", "", ""), ("SUCCESS_DETERMINATION_FAILED",)), ((None, None, None), ("SUBMIT_BUTTON_SELECTOR_MISSING",)),
    ],
    lambda c: [errors.submission_error(F.col("message"), F.col("content"), F.col("selector"))],
)
cases(
    "input_error_cases", "message string", "code string",
    [
        (("Element not found for selector",), ("ELEMENT_NOT_FOUND",)), (("locator not found",), ("ELEMENT_NOT_FOUND",)), (("Cannot type text into input type file",), ("INPUT_TYPE_MISMATCH",)),
        (("error filling the field",), ("INPUT_TYPE_MISMATCH",)), (("form validation failed",), ("FORM_VALIDATION_ERROR",)), (("it was not found",), ("ELEMENT_NOT_FOUND",)),
        (("Timeout 30000ms exceeded",), ("TIMEOUT",)), (("bot found",), ("BOT_DETECTED",)), (("connection refused by peer",), ("ACCESS",)), (("ssl handshake",), ("TLS_ERROR",)),
        (("missing json",), ("INSTRUCTION",)), (("missing part",), ("SYSTEM",)), (("bad locator",), ("ELEMENT_EXTERNAL",)), (("bad input",), ("INPUT_EXTERNAL",)), (("submit it",), ("SUBMIT",)),
        (("no access",), ("ACCESS",)), (("?",), ("SYSTEM",)), ((None,), ("SYSTEM",)), (("site under maintenance",), ("ACCESS",)), (("site is in maintenance",), ("ACCESS",)),
    ],
    lambda c: [errors.input_error(F.col("message"))],
)
cases(
    "error_detail_cases", "message string, content string, status int", "code string, category string, retryable boolean, cooldown_seconds int, confidence double",
    [
        (("HTTP 429", "", 429), ("RATE_LIMIT", "HTTP", True, 300, 0.7)), (("", "", 403), ("ACCESS", "HTTP", True, 60, 0.2)), (("", "cloudflare", 403), ("WAF_CHALLENGE", "WAF", False, 300, 0.6)),
        (("", "", 503), ("SERVER_ERROR", "HTTP", True, 60, 0.2)), (("", "", 404), ("NOT_FOUND", "HTTP", False, 0, 0.2)), (("", "", 401), ("UNAUTHORIZED", "HTTP", False, 0, 0.2)),
        (("", "", 405), ("METHOD_NOT_ALLOWED", "HTTP", False, 0, 0.2)), (("", "", 422), ("FORM_VALIDATION_ERROR", "VALIDATION", False, 0, 0.2)),
        (("ENOTFOUND", "", None), ("DNS_ERROR", "NETWORK", True, 0, 0.6)), (("", "この項目は必須です", None), ("MAPPING", "VALIDATION", False, 0, 0.6)),
        (("connection reset: error", "captcha", None), ("CONNECTION_RESET", "NETWORK", True, 0, 0.8)), (("", "", None), ("SUBMIT_BUTTON_SELECTOR_MISSING", "GENERAL", False, 0, 0.2)),
        (("recaptcha", "", 200), ("BOT_DETECTED", "WAF", False, 0, 0.2)), (("", "csrf token expired", None), ("CSRF_ERROR", "SECURITY", False, 0, 0.6)),
    ],
    lambda c: [errors.detail(F.col("message"), F.col("content"), F.col("status"))[x] for x in ("code", "category", "retryable", "cooldown_seconds", "confidence")],
)
cases(
    "error_recoverable_cases", "code string, message string", "recoverable boolean",
    [
        (("TIMEOUT", "timed out"), (True,)), (("SYSTEM", "json decode problem"), (False,)), (("ELEMENT_NOT_FOUND", "x"), (True,)), (("ELEMENT_NOT_FOUND", "Invalid Selector"), (False,)),
        (("MAPPING", ""), (False,)), (("BOT_DETECTED", ""), (False,)), (("SUBMIT_BUTTON_NOT_FOUND", None), (True,)), (("RATE_LIMIT", "type mismatch"), (False,)), (("NEW_KIND", ""), (False,)),
    ],
    lambda c: [errors.recoverable(F.col("code"), F.col("message"))],
)
cases(
    "failure_override", "kind string, code string, sure double", "code string, category string, confidence double",
    [
        (("PROHIBITION_DETECTED", "TIMEOUT", 0.6), ("PROHIBITION_DETECTED", "BUSINESS", 1.0)), (("NO_MESSAGE_AREA", None, None), ("NO_MESSAGE_AREA", "FORM_STRUCTURE", 1.0)),
        (("TIMEOUT", "TIMEOUT", 0.6), ("TIMEOUT", "NETWORK", 0.6)), (("ODD", None, None), ("ODD", "SYSTEM", 0.0)), ((None, None, None), ("UNKNOWN", "SYSTEM", 0.0)), (("", None, None), ("UNKNOWN", "SYSTEM", 0.0)),
        ((None, "MAPPING", 0.2), ("MAPPING", "VALIDATION", 0.2)),
    ],
    lambda c: [
        errors.failure_detail(F.col("kind"), F.when(F.col("code").isNotNull(), F.struct(
            F.col("code").alias("code"), errors.category(F.col("code")).alias("category"), F.lit(True).alias("retryable"), errors.cooldown(F.col("code")).alias("cooldown_seconds"), F.col("sure").alias("confidence")
        )))[x] for x in ("code", "category", "confidence")
    ],
)
cases(
    "script_error_cases", "message string", "kind string",
    [
        (("Spreadsheet is empty",), ("SPREADSHEET_CONFIG_ERROR",)), (("必須カラムがない",), ("SPREADSHEET_CONFIG_ERROR",)), (("GitHub said HTTP 404",), ("GITHUB_API_ERROR",)), (("rate limit",), ("GITHUB_API_ERROR",)),
        (("targeting_id is odd",), ("TARGETING_CONFIG_ERROR",)), (("client_config lacks company_name",), ("CLIENT_DATA_ERROR",)), (("JSON parse",), ("JSON_PARSE_ERROR",)), (("営業時間外です",), ("BUSINESS_HOURS_ERROR",)),
        (("connection lost",), ("NETWORK_ERROR",)), (("権限がない",), ("PERMISSION_ERROR",)), (("?",), ("SYSTEM_ERROR",)), ((None,), ("SYSTEM_ERROR",)),
    ],
    lambda c: [errors.script_error(F.col("message"))],
)

# ---- prohibition
cases(
    "prohibition_sentences", "sentence string", "hit boolean",
    [
        (("営業目的のお問い合わせはお断りします",), (True,)), (("営業時間は9時から18時までとなります",), (False,)), (("セールスのお電話はご遠慮ください",), (True,)), (("勧誘メールはお受けしておりません",), (True,)),
        (("売り込みは固く禁止しています",), (True,)), (("当社の営業部へのお問い合わせはこちら",), (False,)), (("迷惑電話は禁止です、ご了承ください",), (True,)), (("no solicitation calls please",), (True,)),
        (("we do not accept sales or vendors",), (True,)), (("sales are not accepted here",), (True,)), (("our sales team is glad to help",), (False,)), (("please do not contact us for marketing",), (True,)),
        (("営業電話についてはセキュリティ上の理由で記録します",), (True,)), (("商業目的のご利用はお断りします、ご注意",), (True,)), (("お気軽にお問い合わせください、お待ちします",), (False,)), (("営利目的の利用はご遠慮いただいています",), (True,)),
    ],
    lambda c: [prohibition.prohibited(F.col("sentence"))],
)
cases(
    "prohibition_notices", "page string, targeted boolean", "n int, score int, level string",
    [
        (("ようこそ。営業目的のお問い合わせはお断りします。お電話でどうぞ。", True), (1, 100, "high")), (("営業目的のお問い合わせはお断りします。営業目的のお問い合わせはお断りします！", False), (1, 85, "medium")),
        (("ビジネス目的の利用は想定していません。", True), (1, 85, "medium")), (("スパムの投稿について考えます。", False), (1, 60, "low")), (("普通の文章です、何もありません。", True), (0, 0, "none")), (("", False), (0, 0, "none")),
        (("売り込みは固く禁止しています。勧誘メールはお受けしておりません。スパムの投稿について考えます。", True), (3, 100, "high")),
    ],
    lambda c: [F.size(prohibition.notices(F.col("page"))), *[prohibition.confidence(prohibition.notices(F.col("page")), F.col("targeted"))[x] for x in ("score", "level")]],
)

# ---- redaction
cases(
    "redaction_cases", "message string", "clean string",
    [
        (("api_key=abcdefgh12345 done",), ("api_key=***REDACTED*** done",)), (("see https://a.example/x?y=1 now",), ("see ***URL_REDACTED*** now",)), (("mail to a.b@c.example please",), ("mail to ***EMAIL_REDACTED*** please",)),
        (("token or 03-1234-5678 x",), ("token or ***-***-**** x",)), (("key 1234-5678-9012-3456",), ("key ****-****-****-****",)), (('key {"secret": "abc def"}',), ('key {"secret": "***REDACTED***"}',)),
        (("hello 090-1234-5678",), ("hello 090-1234-5678",)), (("abc@",), ("abc@",)), (("key 田中太郎が来た",), ("key ***NAME_REDACTED***",)), (("株式会社ABC の件",), ("***COMPANY: ***COMPANY_REDACTED***",)),
        (("form_url: x.example/a, b",), ("form_url=***FORM_URL_REDACTED***, b",)), (("company_name=Acme x",), ("company: ***COMPANY_REDACTED***",)), ((None,), (None,)),
    ],
    lambda c: [redaction.redacted(F.col("message"))],
)
cases(
    "redaction_strict_cases", "message string", "clean string",
    [
        (("record_id: 12 and id=7 at a.example.com/x key",), ("record_id=***ID_REDACTED*** and id=***ID_REDACTED*** at a.***DOMAIN_REDACTED*** key",)), (("Acme Corp key",), ("Acme ***COMPANY_REDACTED***",)),
        (("id=7 record_id=8 short",), ("id=***ID_REDACTED*** record_id=8 short",)), (("あいうえお id = 5",), ("***JP_TEXT*** id=***ID_REDACTED***",)), (("plain words",), ("plain words",)),
    ],
    lambda c: [redaction.strictly_redacted(F.col("message"))],
)
cases(
    "redaction_secure_cases", "message string", "clean string",
    [
        (("call 03-1234-5678 or 0312345678",), ("call ***-****-**** or ***********",)), (("pwd: hunter2 ok",), ("pwd=*** ok",)), (("from 10.0.0.1 to you",), ("from ***.***.***.** to you",)), (("zip 123-4567",), ("zip ***-****",)),
        (("abcdefghij0123456789ABC end",), ("***TOKEN*** end",)), (("mail x@y.example",), ("mail ***EMAIL_REDACTED***",)), (("山田花子です",), ("***名前***です",)),
    ],
    lambda c: [redaction.secure(F.col("message"))],
)
_LONG, _TECH = "これは長い文章でありますから全部が隠されるはずであるとおもわれますがどうでしょう", "これは長い文章でありますがエラーという言葉がありますから頭と尾が残るはずであります"
cases(
    "redaction_long_cases", "message string", "clean string",
    [
        ((f"x {_LONG} y",), ("x***TEXT_REDACTED***y",)), ((f"a{_TECH}b",), (f"a{_TECH[:15]}***[INFO_REDACTED]***{_TECH[-10:]}b",)), ((_TECH + _LONG,), (f"{_TECH[:20]}***[PARTIAL_REDACTED]***{_LONG[-15:]}",)),
        (("短い文",), ("短い文",)), (("",), ("",)),
    ],
    lambda c: [redaction.long_texts(F.col("message"))],
)
cases(
    "redaction_json_cases", "message string", "clean string",
    [
        (('{"company_name": "Acme", "n": 1, "deep": [{"note": "mail a@b.example"}, 2.5, null, true]}',), ('{"company_name":"***REDACTED***","n":1,"deep":[{"note":"mail ***EMAIL_REDACTED***"},2.5,null,true]}',)),
        (('{"Phone": {"a": 1}, "x": "plain"}',), ('{"Phone":"***REDACTED***","x":"plain"}',)), (("[]",), ("[]",)), (('"https://a.example"',), ('"***URL_REDACTED***"',)), ((None,), (None,)),
    ],
    lambda c: [redaction.redacted_json(F.col("message"))],
)
cases(
    "audit_cases", "message string", "kinds array<string>, first_start int, first_end int, critical int, medium int, low int, allowed boolean",
    [
        (("see https://a.example/x now",), (["url"], 4, 23, 1, 0, 0, False)), (("call 03-1234-5678",), (["phone"], 5, 17, 0, 0, 1, True)), (("あいう and えおか",), (["japanese", "japanese"], 0, 3, 0, 2, 0, True)),
        (("id=5 record_id=6",), (["id"], 0, 4, 0, 1, 0, True)), (("nothing here",), ([], None, None, 0, 0, 0, True)), (("Acme Corp here",), (["english_company"], 0, 9, 1, 0, 0, False)),
        (("name: Bob token=abcdefgh1",), (["secret", "person_field"], 10, 25, 2, 0, 0, False)),
    ],
    lambda c: [
        F.transform(redaction.audit(F.col("message")), lambda v: v["kind"]), F.get(redaction.audit(F.col("message")), F.lit(0))["start"], F.get(redaction.audit(F.col("message")), F.lit(0))["end"],
        *[redaction.audit_report(redaction.audit(F.col("message")))[x] for x in ("critical", "medium", "low", "allowed")],
    ],
)

# ---- pages
_BOX = '<div class="x md:w-[50%]"><p><i class="material-icons">{0}</i>{1}</p><p>-</p><p>{2}</p></div>'
cases(
    "page_records", "html string", "targeted string, labels array<string>, icons array<string>, n_links int, bot string",
    [
        (('<p>body text here</p><footer>notice at the foot</footer>',), ("notice at the foot", [], [], 0, None)), (('<div class="contact-form" id="c">please write to us</div>',), ("please write to us please write to us", [], [], 0, None)),
        (('<h2>A heading of the page</h2><ul><li>short</li></ul>',), ("A heading of the page", [], [], 0, None)), (('<form><label for="m">Mail</label><input id="m"><label>Name <input name="n"></label></form>',), ("", ["m=Mail", "n=Name"], [], 0, None)),
        ((_BOX.format("home", "Address", "Tokyo 1-1") + _BOX.format("call", "Phone", ""),), ("", [], ["home=Tokyo 1-1", "call="], 0, None)),
        (('<a href=/a>A</a><A HREF="b"><b>B</b></A><a name=x>C</a>',), ("", [], [], 3, None)), (('<script src="https://www.google.com/recaptcha/api.js"></script><div class="g-recaptcha"></div>',), ("", [], [], 0, "reCAPTCHA")),
        (('<iframe src="https://x/recaptcha/api2/anchor"></iframe>',), ("", [], [], 0, None)), (('<div id="cf-wrapper">Cloudflare Checking your browser</div>',), ("", [], [], 0, "Cloudflare Challenge")), ((None,), ("", [], [], 0, None)),
    ],
    lambda c: [
        html.page(F.col("html"))["targeted"], F.transform(html.page(F.col("html"))["labels"], lambda x: F.concat_ws("=", x["for"], x["text"])),
        F.transform(html.page(F.col("html"))["icons"], lambda x: F.concat(x["icon"], F.lit("="), F.coalesce(x["value"], F.lit("")))), F.size(html.page(F.col("html"))["links"]),
        html.bot_check(html.page(F.col("html"))["signals"], F.lit("Just a moment..."), F.lit("https://x.example/cdn-cgi/challenge-platform/h"), html.page(F.col("html"))["text"]),
    ],
)

# ---- fields and values
_PLACES = "array<struct<name:string,contexts:array<struct<text:string,source:string,confidence:double>>,x:double,y:double>>"


def _fields(*parts):
    """Fields of (name, said or None, x, y)."""
    return [(n, [(t, "label", 0.8)] if t else [], x, y) for n, t, x, y in parts]


_PHONES = _fields(("tel1", "電話番号", 0.0, 0.0), ("tel2", "電話番号", 100.0, 0.0), ("tel3", "電話番号", 200.0, 0.0))
_NAMES = _fields(("last", "お名前 姓", 0.0, 0.0), ("first", "お名前 名", 50.0, 0.0))
_ZIPS = _fields(("zip1", "郵便番号", 0.0, 0.0), ("zip2", None, 40.0, 0.0))
cases(
    "split_strategy_cases", f"fields {_PLACES}, kind string", "strategy string, confidence double",
    [
        ((_PHONES, "phone"), ("split", 0.95)), ((_fields(("tel1", "ハイフンなし", 0.0, 0.0), ("tel2", "x", 30.0, 0.0)), "phone"), ("combine", 0.7)),
        ((_NAMES, "name"), ("combine", 0.8)), ((_fields(("l", "それぞれ入力", 0.0, 0.0), ("f", "x", 90.0, 0.0)), "name"), ("split", 0.95)), ((_ZIPS, "postal_code"), ("split", 0.4)),
    ],
    lambda c: [F.coalesce(*[F.when(F.col("kind") == k, mapping.split_strategy(k, F.col("fields"))) for k in ("phone", "name", "postal_code")])[x] for x in ("strategy", "confidence")],
)
cases(
    "split_confidence_cases", f"fields {_PLACES}, kind string, ordered boolean", "confidence double",
    [
        ((_PHONES, "phone", True), (1.0,)), ((_PHONES, "phone", False), (0.6925,)), ((_NAMES, "name", True), (1.0,)), ((_ZIPS, "postal_code", False), (0.0,)),
        ((_fields(("a", "odd", 0.0, 0.0), ("b", "odd", 9.0, 0.0)), "name", False), (0.5415,)), ((_fields(("a", None, 0.0, 0.0)), "phone", False), (0.0,)),
    ],
    lambda c: [F.round(F.coalesce(*[F.when(F.col("kind") == k, mapping.split_confidence(k, F.col("fields"), F.col("ordered"))) for k in ("phone", "name", "postal_code")]), 6)],
)
cases(
    "split_value_cases", "kind string, parts array<string>, n int, strategy string", "vals array<string>",
    [
        (("phone", ["03", "1234", "5678"], 1, "split"), (["0312345678"],)), (("phone", ["03", "1234", "5678"], 3, "split"), (["03", "1234", "5678"],)), (("phone", ["03", "1234", "5678"], 2, "combine"), (["031234", "5678"],)),
        (("postal_code", ["123", "4567"], 1, "combine"), (["1234567"],)), (("postal_code", ["123", "4567"], 2, "split"), (["123", "4567"],)), (("email", ["a", "b.example"], 2, "combine"), (["a", "b.example"],)),
        (("name", ["山田", "太郎"], 2, "combine"), (["山田", "太郎"],)), (("address", ["東京都", "千代田区", "神田", "1-1", "ビル"], 1, "split"), (["東京都千代田区神田1-1　ビル"],)),
        (("address", ["東京都", "千代田区", "神田", "1-1", ""], 1, "combine"), (["東京都千代田区神田1-1"],)), (("address", ["東京都", "千代田区", "神田", "1-1", "ビル"], 2, "combine"), (["東京都千代田区神田1-1", "ビル"],)),
        (("address", ["東京都", "千代田区", "神田", "1-1", "ビル"], 3, "combine"), (["東京都", "千代田区神田1-1", "ビル"],)), (("address", ["東京都", "千代田区", "神田", "1-1", "ビル"], 4, "combine"), (["東京都", "千代田区", "神田1-1", "ビル"],)),
    ],
    lambda c: [F.coalesce(*[
        F.when(F.col("kind") == k, mapping.split_values(k, [F.get("parts", F.lit(i)) for i in range(m)], F.col("n"), F.col("strategy")))
        for k, m in (("phone", 3), ("postal_code", 2), ("email", 2), ("name", 2), ("address", 5))
    ])],
)
cases(
    "duplicate_values", f"assigned {mapping.ASSIGNED}", "fields array<string>",
    [
        (([("姓", "山田", 90, False), ("統合氏名", "山田", 80, False)],), (["統合氏名"],)), (([("電話番号", "0312345678", 90, False), ("電話1", "03", 99, False)],), (["電話番号"],)),
        (([("電話1", "03", 90, False), ("電話2", "1234", 90, False), ("電話番号", "0312345678", 10, False)],), (["電話番号"],)), (([("電話1", "03", 9, False), ("電話2", "03", 9, False)],), (["電話1"],)),
        (([("メールアドレス", "a@b", 9, False), ("auto_email_confirm", "a@b", 9, True)],), (["メールアドレス", "auto_email_confirm"],)), (([("auto_email_confirm", "a@b", 9, True)],), ([],)),
        (([("姓", "林", 80, False), ("名", "林", 85, False)],), (["名"],)), (([("姓", "林", 85, False), ("名", "林", 80, False)],), (["姓"],)), (([("件名", "　", 9, False), ("役職", "　", 9, False)],), (["件名", "役職"],)),
        (([("住所", "", 9, False)],), ([],)), (([("郵便番号1", "123", 9, False), ("郵便番号2", "123", 8, False)],), (["郵便番号1"],)),
    ],
    lambda c: [F.transform(mapping.without_duplicates(F.col("assigned")), lambda a: a["field"])],
)
cases(
    "choice_cases", "texts array<string>, vals array<string>", "picked int, method int, male int",
    [
        ((["選択してください", "その他", "サービスについて"], ["", "1", "2"]), (1, 0, 0)), ((["Phone", "Email"], ["a", "b"]), (1, 1, 0)), ((["女性", "男性"], ["f", "m"]), (1, 0, 1)), ((["a", "select one"], ["1", "select"]), (0, 0, 0)),
        ((["お問い合わせ", "その他", "その他"], ["1", "2", "3"]), (2, 0, 0)), ((["Fax", "どちらでも"], ["1", "2"]), (1, 1, 0)), ((["none"], ["none"]), (0, 0, 0)),
    ],
    lambda c: [mapping.pick(F.col("texts"), ["その他|other", "お問い合わせ"], F.col("vals")), mapping.contact_method(F.col("texts")), mapping.gender_choice(F.col("texts"))],
)
cases(
    "gender_cases", "value string", "gender string",
    [(("男性",), ("male",)), (("女",), ("female",)), (("Female",), ("male",)), (("回答しない",), ("other",)), (("x",), (None,)), ((None,), (None,)), ((" Woman ",), ("male",)), (("じょせい",), ("female",))],
    lambda c: [mapping.gender(F.col("value"))],
)
_E = "struct<name:string,id:string,classes:string,placeholder:string,context:string,score:int>"


def _e(name="", placeholder="", context="", score=90):
    return (name, "", "", placeholder, context, score)


cases(
    "name_fields", f"given map<string,{_E}>", "fields array<string>, family string",
    [
        (({"姓": _e("first"), "名": _e("last")},), (["名", "姓"], "last")), (({"姓": _e("last"), "名": _e("first")},), (["名", "姓"], "last")), (({"姓": _e("a", "名"), "名": _e("b", "姓")},), (["名", "姓"], "b")),
        (({"統合氏名": _e("n"), "姓": _e("x", context="住所"), "名": _e("y", score=80)},), (["統合氏名"], None)), (({"統合氏名": _e("n"), "姓": _e("x"), "名": _e("y")},), (["名", "姓", "統合氏名"], "x")),
        (({"姓カナ": _e("k", "ふりがな")},), (["姓ひらがな"], None)), (({"姓ひらがな": _e("k", "フリガナ")},), (["姓カナ"], None)), (({"姓ひらがな": _e("h"), "名ひらがな": _e("h2"), "統合氏名カナ": _e("c")},), (["名ひらがな", "姓ひらがな"], None)),
    ],
    lambda c: [
        F.array_sort(F.map_keys(mapping.kana_by_script(mapping.swapped_names(mapping.pruned_names(F.col("given")))))),
        F.try_element_at(mapping.kana_by_script(mapping.swapped_names(mapping.pruned_names(F.col("given")))), F.lit("姓"))["name"],
    ],
)
cases(
    "exclusion_cases", "name string, ident string, classes string, placeholder string", "excluded boolean, candidate boolean",
    [
        (("fax_number", "", "", ""), (True, True)), (("telefax", "", "", ""), (False, True)), (("", "", "input-fax", ""), (True, True)), (("", "", "faxes", ""), (False, True)), (("user_kana", "", "", ""), (True, True)), (("", "", "", "フリガナ"), (True, True)),
        (("confirmation_mail", "", "", ""), (True, True)), (("honeypot", "", "", ""), (False, False)), (("", "", "no-print", ""), (False, False)), (("name", "id", "c", ""), (False, True)), ((None, None, None, None), (False, True)),
    ],
    lambda c: [
        mapping.excluded(F.col("name"), F.col("ident"), F.col("classes"), F.col("placeholder"), ("fax", "kana", "フリガナ", "confirmation")),
        mapping.candidate(F.col("name"), F.col("ident"), F.col("classes"), F.lit(True), F.lit("opacity: 0.5")),
    ],
)
cases(
    "required_cases", "attribute boolean, aria string, classes string, contexts array<string>", "required boolean",
    [
        ((True, None, None, None), (True,)), ((False, "true", "", []), (True,)), ((None, None, "field required", []), (True,)), ((None, None, "unrequired", []), (False,)), ((None, None, "", ["お名前", "必須"]), (True,)),
        ((None, None, "", ["お名前（任意）"]), (False,)), ((None, None, "", ["必須ではありません 任意"]), (False,)), ((None, None, "", ["Name *"]), (True,)), ((None, None, "", ["Name"]), (False,)),
    ],
    lambda c: [mapping.required(F.col("attribute"), F.col("aria"), F.col("classes"), F.col("contexts"))],
)
cases(
    "submit_button_cases", "buttons array<struct<type:string,text:string,visible:boolean>>", "place int",
    [
        (([("button", "戻る", True), ("submit", "送信する", True)],), (1,)), (([("button", "確認", True), ("button", "送信", True)],), (1,)), (([("button", "確認画面へ", True)],), (0,)), (([("submit", "検索", True), ("button", "問い合わせ", True)],), (1,)),
        (([("submit", "送信", False)],), (None,)), (([],), (None,)), (([("button", "次へ", True), ("button", "キャンセル", True)],), (0,)),
    ],
    lambda c: [mapping.submit_button(F.col("buttons"))],
)
cases(
    "mapping_summary", f"assigned {mapping.ASSIGNED}, n int, needed array<string>", "assigned int, coverage_pct double, required int, required_done int",
    [
        (([("姓", "a", 1, False), ("名", "b", 1, False)], 3, ["姓", "会社名"]), (2, 66.7, 2, 1)), (([], 0, []), (0, 0.0, 0, 0)), (([("姓", "a", 1, False)], 4, ["姓"]), (1, 25.0, 1, 1)),
    ],
    lambda c: [mapping.summary(F.col("assigned"), F.col("n"), F.col("needed"))[x] for x in ("assigned", "coverage_pct", "required", "required_done")],
)

cases(
    "safeguard_cases", "field string, kind string, attrs string, label string", "passes boolean",
    [
        (("メールアドレス", "email", "x", ""), (True,)), (("メールアドレス", "text", "user_mail", ""), (True,)), (("メールアドレス", "text", "x", "お名前"), (False,)), (("電話番号", "text", "x", "電話に出られる時間"), (False,)), (("電話番号", "text", "x", "電話"), (True,)),
        (("電話番号", "text", "tel", "時"), (True,)), (("郵便番号", "text", "zip_confirm", ""), (False,)), (("郵便番号", "text", "yubin", ""), (True,)), (("都道府県", "select", "pref", ""), (True,)), (("都道府県", "select", "x", "国"), (False,)),
        (("お問い合わせ本文", "textarea", "address", ""), (False,)), (("お問い合わせ本文", "textarea", "address", "内容"), (True,)), (("お問い合わせ本文", "textarea", "x", "ホテルのご要望"), (False,)), (("住所", "text", "addr1", ""), (True,)),
        (("住所", "text", "addr_kana", ""), (False,)), (("住所", "text", "x", "部署の住所"), (False,)), (("住所", "text", "x", "ご意見"), (False,)), (("会社名", "text", "company_kana", ""), (False,)), (("会社名", "text", "x", "氏名"), (False,)),
        (("会社名", "text", "company", "御社名"), (True,)), (("姓", "text", "x", "会社名"), (False,)), (("名", "text", "first", "名"), (True,)), (("件名", "text", "subject", ""), (True,)), (("件名", "text", "x", "題名カナ"), (False,)), (("役職", "text", "x", "役職"), (True,)),
        (("役職", "text", "title", "知ったきっかけ"), (False,)), (("姓カナ", "text", "x", "セイ"), (True,)), (("姓カナ", "text", "x", "姓"), (False,)), (("姓ひらがな", "text", "x", "ふりがな"), (True,)), (("名ひらがな", "text", "x", "性別 ひらがな"), (False,)),
        (("統合氏名", "text", "name", "お名前"), (True,)), (("統合氏名", "text", "x", "会社名または氏名"), (False,)), (("企業URL", "text", "x", ""), (True,)),
    ],
    lambda c: [safeguards.passes(F.col("field"), F.col("kind"), F.col("attrs"), F.col("label"))],
)
cases(
    "label_consistency", "field string, label string", "consistent boolean",
    [
        (("メールアドレス", "メールアドレス"), (True,)), (("メールアドレス", "電話番号"), (False,)), (("電話番号", "Tel / E-mail"), (True,)), (("住所", "ご意見"), (True,)), (("会社名", "件名"), (False,)), (("姓", "会社名"), (False,)), (("姓", "姓"), (True,)), (("件名", None), (True,)),
    ],
    lambda c: [safeguards.consistent(F.col("field"), F.col("label"))],
)
_CLIENT = {
    "company_name": "A社", "last_name": "山田", "first_name": "太郎", "last_name_kana": "ヤマダ", "email_1": "a", "email_2": "b.example", "phone_1": "03", "phone_2": "1234", "phone_3": "5678", "postal_code_1": "100", "postal_code_2": "0001",
    "address_1": "東京都", "address_2": "千代田区", "address_3": "神田", "address_4": "1-1", "address_5": "ビル5F", "gender": "男性",
}
_ELEMENT = "struct<tag:string,type:string,name:string,id:string,classes:string,placeholder:string,label:string,style:string,visible:boolean,enabled:boolean,required:boolean>"


def _el(tag="input", type="text", name="", id="", classes="", placeholder="", label="", style="", visible=True, enabled=True, required=False):
    return (tag, type, name, id, classes, placeholder, label, style, visible, enabled, required)


_RULES = [
    scores.Rule("メールアドレス", ("email",), ("input",), "mail", "メール|mail", ("confirm",)), scores.Rule("お問い合わせ本文", ("textarea",), ("textarea",), "message|body|inquiry", "内容|本文", ()),
    scores.Rule("姓カナ", ("text",), ("input",), "kana|sei", "セイ|フリガナ", ()), scores.Rule("会社名", ("text",), ("input",), "company|corp", "会社", ()),
]
cases(
    "element_score_cases", f"e {_ELEMENT}", "mail int, message int, kana int, quick int",
    [
        ((_el(type="email", name="mail"),), (210, 0, 50, 210)), ((_el(type="email", name="mail", label="メール"),), (242, 0, 50, 210)), ((_el(name="mail_confirm"),), (-999, 0, 110, -999)), ((_el(name="x", label="confirm mail"),), (-999, 0, 110, 50)),
        ((_el(tag="textarea", type="textarea", name="body", label="本文"),), (0, 262, 0, 0)), ((_el(name="sei_kana"),), (-999, -999, 210, 50)), ((_el(name="mei_kana"),), (-999, -999, -999, 50)), ((_el(name="x"),), (10, 0, 110, 50)),
        ((_el(type="email", name="mail", visible=False),), (10, 0, 0, 10)), ((_el(type="hidden", name="mail"),), (0, 0, 0, -90)), ((_el(placeholder="your mail", classes="mail-box"),), (120, 0, 110, 120)),
    ],
    lambda c: [scores.element_score(F.col("e"), _RULES[k]) for k in (0, 1, 2)] + [scores.quick_score(F.col("e"), _RULES[0])],
)
cases(
    "form_assignment", f"form array<{_ELEMENT}>", "taken array<string>",
    [
        (([_el(name="company"), _el(type="email", name="mail"), _el(tag="textarea", type="textarea", name="message")],), (["メールアドレス 1", "お問い合わせ本文 2", "会社名 0"],)),
        (([_el(type="email", name="mail"), _el(type="email", name="mail2")],), (["メールアドレス 0"],)), (([_el(tag="div", type="x", classes="corp", required=True)],), (["会社名 0 rescued"],)), (([_el(tag="div", type="x", classes="corp")],), ([],)), (([],), ([],)),
    ],
    lambda c: [F.transform(scores.assigned(F.col("form"), _RULES), lambda a: F.concat_ws(" ", a["field"], a["element"], F.when(a["rescued"], "rescued")))],
)
cases(
    "assigned_values", "field string, kind string, client map<string,string>", "value string",
    [
        (("会社名", "text", _CLIENT), ("A社",)), (("統合氏名", "text", _CLIENT), ("山田　太郎",)), (("統合氏名カナ", "text", _CLIENT), ("ヤマダ",)), (("メールアドレス", "email", _CLIENT), ("a@b.example",)), (("メールアドレス", "email", {"email_1": "a"}), ("",)),
        (("電話番号", "tel", _CLIENT), ("0312345678",)), (("電話2", "tel", _CLIENT), ("1234",)), (("郵便番号", "text", _CLIENT), ("1000001",)), (("都道府県", "select", _CLIENT), ("東京都",)), (("会社名", "select", _CLIENT), ("",)), (("性別", "select", _CLIENT), ("男性",)),
        (("住所", "text", _CLIENT), ("東京都千代田区神田1-1　ビル5F",)), (("住所", "text", {"address_1": "大阪府"}), ("大阪府",)), (("件名", "text", {}), ("用件",)), (("お問い合わせ本文", "textarea", {}), ("本文です",)), (("知らない", "text", _CLIENT), ("",)),
    ],
    lambda c: [safeguards.value_for(F.col("field"), F.col("kind"), F.col("client"), F.lit("用件"), F.lit("本文です"))],
)
