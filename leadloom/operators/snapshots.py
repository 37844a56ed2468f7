"""A page before and after a form was sent: what changed, and whether that speaks for success.

Both pages are arrays of nodes beside each other (``nodes.node_pairs``), so that every rule is an expression over one row and no row travels. A node is
new if its hash, which covers all that is in it, occurs more often after than before: the difference of two trees is a difference of counts, whatever
moved around it. ``difference`` states the same for node tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions import nodes, urls
from leadloom.operators import scoring

# fixed values: what pages say after a message was sent, in the order in which the patterns are tried
SAID = (
    "送信.*完了|送信.*成功|送信.*ました|送信いたしました|送信致しました", "お問い合わせ.*完了|お問い合わせ.*ました|お問い合わせを受け付けました", "ありがとう.*ございました|ありがとう.*ます|Thank.*you|thanks.*for",
    "受付.*完了|受付.*ました|受け付け.*完了|受け付け.*ました|受付いたしました", "確認.*完了|確認.*ました|お申し込み.*完了|お申し込み.*ました", "メッセージ.*送信.*完了|メール.*送信.*完了|フォーム.*送信.*完了",
    "お問い合わせ内容.*送信|内容.*送信.*完了|データ.*送信.*完了", "正常.*送信|正常.*受付|正常.*完了|成功.*送信|成功.*受付", "message.*sent|successfully.*sent|submission.*complete",
    "送信させていただきました|受付させていただきました|確認させていただきました", "お預かりいたしました|承りました|拝受いたしました|頂戴いたしました", "恐れ入ります.*ありがとう|お忙しい.*ありがとう|ご多忙.*ありがとう",
    "後日.*連絡|後日.*返信|確認.*メール|自動.*返信|返信.*メール", "担当者.*連絡|担当.*から|営業.*連絡|営業.*から|スタッフ.*連絡", "折り返し.*連絡|追って.*連絡|改めて.*連絡|近日中.*連絡",
    "お忙しい中.*ありがとう|貴重.*時間.*ありがとう|ご協力.*ありがとう", "手続き.*完了|処理.*完了|登録.*完了|申請.*完了|予約.*完了", "ご相談.*ありがとう|ご質問.*ありがとう|ご要望.*ありがとう",
    "class.*success|class.*complete|class.*thanks|class.*done", "class.*finish|class.*sent|class.*submitted|class.*confirmation",
)
# fixed values: classes and ids of success, kinds and classes of messages, of what stands around a form and beside it
SUCCESS_NAMES, HEADLINES, MESSAGES = "success|complete|thanks", ("h1", "h2", "h3"), ("message", "alert", "notification")
AROUND, BESIDE = ("form", "contact", "inquiry", "contact-form"), ("success", "complete", "thanks", "message", "alert", "notification", "confirmation", "result", "status")
SUCCESS_CLASSES = "success|complete|thanks|thank|confirmation|confirmed|sent|submitted"
GONE = r"display:none|visibility:hidden"
# fixed values: titles and addresses of success and of failure
TITLE_GOOD, TITLE_BAD = "完了|成功|ありがとう|thank|complete|success|受付", "エラー|失敗|無効|error|failed|invalid"
URL_GOOD, URL_BAD = "/thanks|/thank-you|/complete|/completed|/done|/submitted|/success|/confirm|/confirmation|/kanryou|/uketsuke|/arigatou", "/error|/failed|/failure|/invalid"
PARAM_GOOD, PARAM_BAD = ("success", "completed", "submitted"), ("error", "failed", "invalid")
#: Changed nodes from which on a page counts as rebuilt, and the share of cleared fields that speaks for success.
REBUILT, CLEARED = 5, 0.5


def _said(text: Column, patterns: tuple = SAID) -> Column:
    return text.rlike("(?i)" + "|".join(patterns))


def _count_said(text: Column) -> Column:
    """Matches of all patterns."""
    return sum((F.size(F.regexp_extract_all(text, F.lit(f"(?i)({p})"), F.lit(1))) for p in SAID), F.lit(0))


def _attribute(n: Column, name: str) -> Column:
    return F.try_element_at(n["attrs"], F.lit(name))


def _has_class(n: Column, words: tuple) -> Column:
    return F.map_contains_key(n["attrs"], "class") & F.arrays_overlap(F.split(F.coalesce(_attribute(n, "class"), F.lit("")), r"\s+"), F.array(*[F.lit(w) for w in words]))


def _names(n: Column) -> Column:
    return F.concat_ws(" ", _attribute(n, "class"), _attribute(n, "id"))


def _telling(n: Column) -> Column:
    """Elements whose class or id speaks of success, and messages."""
    return (F.size(n["attrs"]) > 0) & (_names(n).rlike(SUCCESS_NAMES) | _has_class(n, MESSAGES))


def _visible(n: Column) -> Column:
    style = F.replace(F.lower(F.coalesce(_attribute(n, "style"), F.lit(""))), F.lit(" "), F.lit(""))
    return ~style.rlike(GONE) & ~F.map_contains_key(n["attrs"], "hidden")


def _texts(ns: Column) -> Column:
    return F.array_join(F.transform(F.filter(ns, lambda n: n["tag"] == nodes.TEXT), lambda n: n["text"]), " ")


def _inside(page: Column, n: Column) -> Column:
    """The texts inside an element, joined by spaces; null if there is none. A node's place in the page is its number."""
    return F.nullif(_texts(F.slice(page, n["pre"] + 2, n["last"] - n["pre"])), F.lit(""))


def _within(n: Column, elements: Column) -> Column:
    return F.exists(elements, lambda e: (e["pre"] < n["pre"]) & (n["pre"] <= e["last"]))


def _with_facts(rows: DataFrame, page: str, end: str) -> DataFrame:
    """rows and what a page (an array of nodes) shows: title, body (its text), forms, elements (of forms, without buttons), disabled, buttons, headlines; their names end as asked."""
    c = lambda name: f"{name}{end}"
    ns = F.col(page)
    rows = rows.withColumn(c("titles"), F.filter(ns, lambda n: n["tag"] == "title")).withColumn(c("bare"), F.filter(ns, lambda n: ~F.exists(F.col(c("titles")), lambda t: t["pre"].eqNullSafe(n["parent"]))))
    shape = F.filter(ns, lambda n: n["tag"] == "form")
    rows = rows.withColumn(c("shapes"), shape)
    inputs = F.filter(ns, lambda n: n["tag"].isin("input", "textarea", "select", "button") & _within(n, F.col(c("shapes"))))
    told = F.transform(
        F.filter(ns, lambda n: n["tag"].isin("button", "input", *HEADLINES) | _telling(n)),
        lambda n: F.struct(
            n["tag"].alias("tag"), _visible(n).alias("visible"), (n["tag"].isin(*HEADLINES) | _telling(n)).alias("telling"), F.when(n["last"] > n["pre"], _inside(ns, n)).alias("said"),
            (F.lower(F.coalesce(_attribute(n, "type"), F.lit(""))) == "submit").alias("submit"), _attribute(n, "value").alias("value"),
        ),
    )
    rows = rows.withColumns({c("inputs"): inputs, c("told"): told})
    sends = lambda n: n["submit"] | F.when(n["tag"] == "button", n["said"].rlike("送信|確認")).otherwise(n["value"].rlike("送信|確認"))
    count = lambda name, p: F.size(F.filter(F.col(c(name)), p))
    titles = F.filter(F.transform(F.col(c("titles")), lambda t: _inside(ns, t)), lambda t: t.isNotNull())
    return rows.withColumns({
        c("title"): F.coalesce(F.get(titles, F.lit(0)), F.lit("")), c("body"): _texts(F.col(c("bare"))), c("forms"): count("bare", lambda n: n["tag"] == "form"),
        c("elements"): count("inputs", lambda n: n["tag"] != "button"), c("disabled"): count("inputs", lambda n: F.map_contains_key(n["attrs"], "disabled")),
        c("buttons"): count("told", lambda n: n["tag"].isin("button", "input") & sends(n) & n["visible"]), c("headlines"): count("told", lambda n: n["telling"] & n["visible"] & _said(n["said"])),
    })


def difference(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """key, whole, gone, added: hashes of elements and texts that one of two trees has more often."""
    counted = lambda t, n: t.groupBy(key, "whole").agg(F.count("*").alias(n))
    both = counted(before, "was").join(counted(after, "is"), [key, "whole"], "full").fillna(0, ["was", "is"])
    return both.where("was <> is").select(key, "whole", F.greatest(F.col("was") - F.col("is"), F.lit(0)).alias("gone"), F.greatest(F.col("is") - F.col("was"), F.lit(0)).alias("added"))


def _with_siblings(rows: DataFrame, page: str) -> DataFrame:
    """rows and siblings: how many elements of success are new in or around the form of the page after."""
    ns = F.col(page)
    around = F.filter(ns, lambda n: (n["tag"] == "form") | _has_class(n, AROUND) | (_attribute(n, "id") == "form"))
    beside = F.filter(ns, lambda n: (n["added"] > 0) & _has_class(n, BESIDE))
    rows = rows.withColumn("around", around).withColumn("beside", beside)
    shown = F.filter("beside", lambda n: _within(n, F.col("around")) & (F.lower(_names(n)).rlike(SUCCESS_CLASSES) | F.coalesce(_said(_inside(ns, n), SAID[:5]), F.lit(False))))
    rows = rows.withColumn("shown", F.transform(shown, lambda n: F.struct(n["whole"].alias("whole"), n["added"].alias("added"))))
    # of equal ones as many as are new
    new = F.transform(F.array_distinct("shown"), lambda w: F.least(F.size(F.filter("shown", lambda n: n["whole"] == w["whole"])), w["added"]))
    return rows.withColumn("siblings", F.aggregate(new, F.lit(0), lambda a, x: a + x))


def _form_changes(fields: Column) -> dict[str, Column]:
    """switched_off (buttons that were enabled and are not), cleared, compared: fields by name."""
    count = lambda p: F.size(F.filter(fields, p))
    return {
        "switched_off": count(lambda f: (f["tag"] == "button") & ~f["off_was"] & f["off_is"]), "cleared": count(lambda f: (f["tag"] != "button") & (f["v_was"] != "") & (f["v_is"] == "")),
        "compared": count(lambda f: f["tag"] != "button"),
    }


def address_change(before: Column, after: Column) -> Column:
    """True for a new address of success, false for one of failure, null if it says nothing."""
    old, new = F.lower(before), F.lower(after)
    names = lambda u: F.transform(F.split(F.regexp_extract(u, r"\?([^#]*)", 1), "&"), lambda p: F.substring_index(p, "=", 1))
    came = F.array_except(names(new), names(old))
    some = lambda words: F.arrays_overlap(came, F.array(*[F.lit(w) for w in words]))
    return F.when(old == new, None).when(new.rlike(URL_GOOD), True).when(new.rlike(URL_BAD), False).when(some(PARAM_GOOD), True).when(some(PARAM_BAD), False)


def state_change(changes: Column, switched_off: Column, cleared: Column, compared: Column, title_before: Column, title_after: Column, url_before: Column, url_after: Column) -> Column:
    """True, false, or null if nothing decides: a page that was rebuilt, a button that went off, fields that were cleared, the title, the address."""
    old, new = F.lower(title_before), F.lower(title_after)
    title = F.when((old != new) & new.rlike(TITLE_GOOD), True).when((old != new) & new.rlike(TITLE_BAD), False)
    form = F.when((switched_off > 0) | ((compared > 0) & (cleared >= compared * CLEARED)), True)
    return F.coalesce(F.when(changes >= REBUILT, True), form, title, address_change(url_before, url_after))


def judged(pairs: DataFrame, key: str) -> DataFrame:
    """key, success, confidence, stage, state of pairs (key, url_before, url_after, before, after): pages as markup."""
    rows = nodes.node_pairs(pairs.select(key, "url_before", "url_after", "before", "after"), "before", "after")
    rows = _with_siblings(_with_facts(_with_facts(rows, "was", "_was"), "is", ""), "is").withColumns({"n_said": _count_said(F.col("body")), **_form_changes(F.col("fields"))})
    no, other = F.lit(False), F.regexp_extract("url_before", "^[a-z]+://([^/?#]*)", 1) != F.regexp_extract("url_after", "^[a-z]+://([^/?#]*)", 1)
    good = F.lower(F.regexp_extract("url_after", "^[a-z]+://[^/?#]*([^?#]*)", 1)).rlike("|".join(urls.SUCCESS_PATHS))
    verdict = scoring.judge(
        no, no, no, F.lit(0), F.col("url_before") != F.col("url_after"), good, other, F.col("n_said"), F.col("forms_was"), F.col("forms"), F.col("elements_was"), F.col("elements"),
        headlines=F.col("headlines"), buttons=F.col("buttons"), siblings=F.col("siblings"), disabled=F.col("disabled"),
    )
    state = state_change(*[F.col(c) for c in ("changes", "switched_off", "cleared", "compared", "title_was", "title", "url_before", "url_after")])
    return rows.select(key, verdict.alias("v"), state.alias("state")).select(key, "v.success", F.round("v.confidence", 6).alias("confidence"), "v.stage", "state")
