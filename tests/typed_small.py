"""More rules on stated cases: links, hosts, templates, numbers, dates, settings, backoff."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadloom.functions import dates, documents, numbers, text, urls
from leadloom.operators import elements, links, queue_state
from typed import cases

_LINK = "struct<text:string,title:string,aria:string,alt:string,href:string,id:string,classes:string,parent:string,parent_classes:string>"


def _link(text="", href="/x", title="", aria="", alt="", id="", classes="", parent="", parent_classes=""):
    return ((text, title, aria, alt, href, id, classes, parent, parent_classes),)


cases(
    "link_cases", f"link {_LINK}", "excluded boolean, score int",
    [
        (_link("お問い合わせ", "/contact"), (False, 450)), (_link("Document request", "/document-request"), (False, 100)), (_link("x", "/post#comment-5"), (True, 0)), (_link("x", "/post#commentary"), (False, 0)),
        (_link("x", "/blog/comments/3"), (True, 0)), (_link("採用情報", "/recruit"), (True, 0)), (_link("採用のお問い合わせ", "/recruit"), (False, 200)), (_link("Leave a Reply", "/x"), (True, 0)), (_link("", "/a.pdf"), (False, -200)),
        (_link("Contact", "mailto:a@b.example"), (False, -200)), (_link("Support", "/x", title="無料相談", aria="Quote"), (False, 350)), (_link("x", "/x", id="gnav-contact"), (False, 200)), (_link("x", "/x", classes="navbar cta"), (False, 180)),
        (_link("x", "/x", parent="footer", parent_classes="mail-btn"), (False, 200)), (_link("x", "/x", parent="main"), (False, 20)), (_link("x", "https://other.example/x"), (False, -50)), (_link("x", "https://www.home.example/x"), (False, 0)),
        (_link("x", "/x", classes="wp-comment"), (False, 0)), (_link("wp-comment form", "/x"), (True, 0)), (_link("x", ""), (False, -1000)), (_link("job offers", "/x"), (True, 0)),
    ],
    lambda c: [links.excluded(F.col("link")), links.score(F.col("link"), F.lit("https://home.example/"))],
)
cases(
    "host_cases", "host string", "matches boolean, domain string",
    [
        (("www.shop.example.com",), (True, "example.com")), (("example.com",), (True, "example.com")), (("notexample.com",), (False, "notexample.com")), (("a.b.co.jp",), (False, "b.co.jp")), (("x.ads.net",), (True, "ads.net")), (("localhost",), (False, "localhost")),
        ((None,), (None, "")), (("WWW.EXAMPLE.COM",), (True, "example.com")),
    ],
    lambda c: [urls.host_matches(F.col("host"), ["example.com", ".ads.net", ""]), urls.registrable(F.col("host"))],
)
cases(
    "template_cases", "template string, company string", "names array<string>, message string",
    [
        (("{company} 御中 [{city}の]皆様", "A社"), (["company", "city"], "A社 御中 皆様")), (("[{company}様、]こんにちは {client.name}", ""), (["company"], "こんにちは {client.name}")), (("[{company}様、]こんにちは", "B"), (["company"], "B様、こんにちは")),
        (("[note] {targeting.subject}", "B"), ([], "[note] {targeting.subject}")), (("{ company } {company}", "B"), (["company"], "{ company } B")), (("", "B"), ([], "")),
    ],
    lambda c: [text.placeholders(F.col("template")), text.expand(F.col("template"), {"company": F.col("company"), "city": F.lit(None).cast("string")})],
)
cases(
    "sample_placeholders", "document string", "document string",
    [
        (('{"name": "山田太郎", "n": 1234}',), ('{"name": "{client.last_name}{client.first_name}", "n": 1234}',)), (('{"03": ["03", {"x": "1234-5678"}]}',), ('{"03": ["{client.phone_1}", {"x": "{client.phone_2}-{client.phone_3}"}]}',)),
        (('{"a": "say \\"山田\\""}',), ('{"a": "say \\"{client.last_name}\\""}',)), (('{"s": "お問い合わせ"}',), ('{"s": "{targeting.subject}"}',)), (("[]",), ("[]",)), ((None,), (None,)),
    ],
    lambda c: [text.with_placeholders(F.col("document")).alias("d")],
)
cases(
    "field_variations", "name string", "names array<string>",
    [
        (("my_email",), (["e-mail", "email", "eメール", "mail", "my-email", "my_email", "メール"],)), (("user name",), (["fullname", "nama", "name", "user name", "user_name", "username", "お名前", "氏名"],)), (("zip-code",), (["zip-code", "zip_code"],)),
    ],
    lambda c: [text.variations(F.col("name"))],
)
cases(
    "text_cases", "value string", "cjk boolean, decoded string, token boolean",
    [(("日本 x",), (True, "日本 x", False)), (("a\\nb\\tc",), (False, "a\nb\tc", False)), (("user_name",), (False, "user_name", True)), (("username",), (False, "username", False)), (("ｶﾅ",), (True, "ｶﾅ", False)), (("",), (False, "", False))],
    lambda c: [text.has_cjk(F.col("value")), text.unescape(F.col("value")), text.contains_token(F.col("value"), "name")],
)
cases(
    "fold_cases", "value string", "folded string",
    [(("ＡＢＣ１２３",), ("abc123",)), (("ｶﾞｷﾞ",), ("ガギ",)), (("①ﾃﾞ㈱",), ("1デ(株)",)), (("Straße É",), ("straße é",)), ((None,), (None,)), (("",), ("",))],
    lambda c: [documents.nfkc_lower(F.col("value"))],
)
cases(
    "number_cases", "value string", "salary long, first long, age long, staff long, closing_month long",
    [
        (("350千円",), (350000, 350, None, None, None)), (("月給 250,000円",), (250000, 250000, None, None, None)), (("35.5歳",), (35, 35, 35, None, None)), (("従業員 1,200人",), (1200, 1200, None, 1200, None)), (("３月",), (3, 3, None, None, 3)), (("13月",), (13, 13, None, None, None)),
        (("-",), (None, None, None, None, None)), (("N/A",), (None, None, None, None, None)), ((None,), (None, None, None, None, None)), (("20名",), (20, 20, None, 20, None)),
    ],
    lambda c: [
        numbers.salary(F.col("value")), numbers.first_number(F.col("value")), numbers.whole_number(F.col("value"), "歳", 0, 120), numbers.whole_number(F.col("value"), "人|名"), numbers.whole_number(F.col("value"), "月", 1, 12),
    ],
)
cases(
    "setting_cases", "clock string, days string, own string, shared string", "minutes int, days array<int>, hours double",
    [
        (("09:30", "[0, 2, 9]", "6.5", "4"), (570, [0, 2], 6.5)), (("24:00", "[]", "-1", "4"), (None, [0, 1, 2, 3, 4], 4.0)), (("9:05", "x", None, "z"), (545, [0, 1, 2, 3, 4], 8.0)), ((None, None, "0", ""), (None, [0, 1, 2, 3, 4], 8.0)), (("23:59", "[6]", " 3 ", None), (1439, [6], 3.0)),
    ],
    lambda c: [dates.parse_clock(F.col("clock")), dates.parse_days(F.col("days")).cast("array<int>"), dates.session_hours(F.col("own"), F.col("shared"))],
)
cases(
    "worker_settings", "c struct<num_workers:int,max_workers:int,batch_size:int,max_pending_tasks:int,memory_per_worker_mb:int,page_load:int,element_wait:int,pre_processing_max:int>", "errors array<string>",
    [
        (((2, 4, 10, 40, 2048, 10, 5, 30),), ([],)), (((0, 4, 10, 0, 2048, 10, 5, 30),), (["num_workers"],)), (((4, 2, 10, 80, 2048, 10, 5, 30),), (["max_workers"],)), (((2, 4, 10, 39, 2048, 10, 5, 30),), (["max_pending_tasks"],)),
        (((5, 5, 1, 10, 2048, 10, 5, 30),), (["memory"],)), (((1, 1, 1, 2, 4096, 10, 5, 30),), (["memory"],)), (((1, 1, 1, 2, 1024, 31, 40, 30),), (["page_load", "element_wait"],)), (((None, None, None, None, None, None, None, None),), ([],)),
    ],
    lambda c: [elements.worker_errors(F.col("c"))],
)
cases(
    "circuit_cases", "failures int, ago int", "state string",
    [((0, 0), ("closed",)), ((4, 1), ("closed",)), ((5, 1), ("open",)), ((5, 299), ("open",)), ((5, 300), ("half_open",)), ((9, 9999), ("half_open",))],
    lambda c: [queue_state.circuit(F.col("failures"), F.col("ago"))],
)
cases(
    "jitter_cases", "attempt int", "near boolean, wide boolean",
    [((0,), (True, False)), ((3,), (True, False)), ((9,), (True, False))],
    lambda c: [
        F.abs(queue_state.jittered(queue_state.backoff(F.col("attempt")), F.col("event_id")) / queue_state.backoff(F.col("attempt")) - 1) <= 0.2,
        F.abs(queue_state.jittered(queue_state.backoff(F.col("attempt")), F.col("event_id")) / queue_state.backoff(F.col("attempt")) - 1) > 0.2,
    ],
)
cases(
    "json_safe_cases", "document string", "safe string",
    [
        (('{"b": NaN, "a": {"element": 1, "x": [1, 2.5]}}',), ('{"a": {"x": [1, 2.5]}, "b": null}',)), (('{"a": {"b": {"c": {"d": {"e": {"f": 1}}}}}}',), ('{"a": {"b": {"c": {"d": {"e": {"f": "<max_depth_reached>"}}}}}}',)), (('"x"',), ('"x"',)), ((None,), (None,)),
    ],
    lambda c: [documents.json_safe(F.col("document"))],
)
