"""From form fields to the values that go into them: exclusions, split fields, duplicates, choices, names, buttons.

A form is small, so its fields are an array of structs, and a step is an expression over that array; steps that depend on
what came before fold over it. Nothing here groups rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom.functions import text

# fixed values: words of attributes that set traps for machines
TRAPS = ("honeypot", "honey", "trap", "botfield", "no-print", "noprint", "dummy")
HIDDEN_STYLE = r"display:none|visibility:hidden|pointer-events:none|z-index:-1|opacity:0*(?:\.0+)?(?:;|$)"
OFF_SCREEN = r"left:-9999px|top:-9999px"
# fixed values: words that matter in classes even if they are short
SHORT_CLASS_WORDS = ("auth", "login", "otp", "csrf", "fax")
# fixed values: what a field of a split group is called, by kind
SPLIT_WORDS = {
    "address": ("住所", "都道府県", "市区町村", "番地", "建物", "address"), "phone": ("電話", "電話番号", "tel", "phone", "市外局番", "局番"),
    "name": ("名前", "姓", "名", "name", "last", "first", "苗字"), "name_hiragana": ("ひらがな", "ふりがな", "せい", "めい", "hiragana"),
    "name_kana": ("カナ", "カタカナ", "フリガナ", "セイ", "メイ", "katakana", "kana"), "email": ("メール", "email", "mail", "e-mail"), "postal_code": ("郵便番号", "postal", "zip", "〒"),
}
# fixed values: hundredths for the number of fields of a kind; and for any other number
SPLIT_COUNTS = {"address": ({2: 25, 3: 20, 4: 15, 5: 10}, -10), "phone": ({3: 30, 2: 20}, -10), "name": ({2: 35, 3: 20, 4: 10}, -15)}
SOURCES = {"dt_label": 1.0, "label": 0.9, "placeholder": 0.7, "adjacent_text": 0.5}
LEAST_SPLIT = 0.45
# fixed values: what a form says about how to fill split fields
SPLIT_SAID = r"それぞれ|各項目|各フィールド|各入力欄|individually|separately|each field|分けて入力|分けてご記入|個別に|別々に|[234]つに分けて"
COMBINE_SAID = r"一度に|一括で|まとめて|続けて入力|連続して|combined|together|as one|ハイフンなし|ハイフンを除く|スペースなし|連結して|結合して"
UNIFIED_SAID = r"フルネーム|full name|氏名|お名前|完全な住所|full address|住所全体|電話番号（ハイフンなし）|phone number|電話番号全体"
#: Fields that are farther apart than so many pixels are clearly separate.
FAR = 80
# fixed values: which field keeps a value that two want
PRIORITY = {
    "メールアドレス": 100, "お問い合わせ本文": 95, "会社名": 90, "統合氏名": 85, "電話番号": 85, "姓": 80, "名": 80, "件名": 75, "会社名カナ": 70, "統合氏名カナ": 70, "姓カナ": 65, "名カナ": 65,
    "役職": 60, "部署名": 55, "企業URL": 50, "郵便番号1": 40, "郵便番号2": 40, "住所": 35, "姓ひらがな": 30, "名ひらがな": 30, "性別": 25, "電話1": 15, "電話2": 10, "電話3": 5,
}
PHONE_PARTS, POSTAL_PARTS = ("電話1", "電話2", "電話3"), ("郵便番号1", "郵便番号2")
CONFIRMATION = (
    "email_confirm|mail_confirm|confirm_email|confirm_mail|メール確認|確認用メール|email_check|mail_check|re_email|re_mail|auto_email_confirm"
)
# fixed values: texts of choices by preference, and what stands for no choice
CONTACT_METHODS = (
    r"mail|メール", r"any|either|no preference|どちらでも|問いません|どれでも", r"phone|tel|call|携帯|モバイル|電話", r"fax|ファックス|ファクス",
)
NO_CHOICE = r"select|choose|---|none"
MALE = r"男|male|man|Men|Male"
# fixed values: genders by words, in order: "female" holds "male" and so counts as male
GENDERS = [("male", "男性|だんせい|男|male|man"), ("female", "女性|じょせい|女|female|woman"), ("other", "その他|未回答|無回答|回答しない|other|prefer not")]
# fixed values: buttons that send or confirm, and those that do not
SEND, SEND_LATER, CONFIRM = r"送信|submit|send", r"お問い合わせ|問い合わせ|申し込|申込|応募|登録", r"確認|confirm|次へ|next|進む"
NOT_SEND = r"戻る|back|キャンセル|cancel|リセット|reset|クリア|clear|検索|search|閉じる|close"
# fixed values: words that say that a field must be filled, or need not
REQUIRED_MARKS, OPTIONAL_MARKS = r"必須|required|mandatory|\*|＊|※|（必須）|\[必須\]", r"任意|optional|省略可|オプション"
REQUIRED_CLASSES = r"(^|[\s_-])(required|require|must|hissu|mandatory)($|[\s_-])|必須"
# fixed values: labels that show that a name field is another one
NOT_NAME = "住所|マンション名|建物名|ふりがな|フリガナ|カナ|かな|ひらがな|郵便|郵便番号|商品名|部署|部署名"


def _low(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit("")))


# ---- exclusion
def bounded(value: Column, word: str) -> Column:
    """The word stands by itself between borders, dashes or underscores."""
    w = word.lower()
    return value.rlike(rf"\b\Q{w}\E\b|[_-]\Q{w}\E[_-]|^\Q{w}\E[_-]|[_-]\Q{w}\E$")


def excluded(name: Column, ident: Column, classes: Column, placeholder: Column, words: tuple) -> Column:
    """One of the words is in an attribute: short and Japanese ones with borders, others as words, long ones anywhere; classes token by token."""
    found = F.lit(False)
    tokens = F.filter(F.split(_low(classes), r"\s+"), lambda t: t != "")
    for word in words:
        w = word.lower()
        if len(w) >= 5 and not any(ch.isspace() for ch in w):  # anywhere: borders and tokens do not matter
            found = reduce(lambda a, c: a | _low(c).contains(w), (name, ident, placeholder, classes), found)
            continue
        japanese = any("぀" <= ch <= "鿿" for ch in w)
        for value in (_low(name), _low(ident), _low(placeholder)):
            if len(w) <= 2 or japanese:
                found = found | text.contains_token(value, w)
            else:
                found = found | bounded(value, w) | (value.contains(w) if len(w) >= 5 else F.lit(False))
        found = found | F.array_contains(tokens, w)
        if w in SHORT_CLASS_WORDS or len(w) >= 5:
            found = found | F.exists(tokens, _class_word(w, len(w) >= 5))
    return found


def _class_word(word: str, anywhere: bool):
    return lambda t: bounded(t, word) | (t.contains(word) if anywhere else F.lit(False))


def candidate(name: Column, ident: Column, classes: Column, visible: Column, style: Column) -> Column:
    """Neither a trap nor hidden."""
    named = F.concat_ws(" ", _low(name), _low(ident), _low(classes))
    s = F.replace(_low(style), F.lit(" "), F.lit(""))
    hidden = s.rlike(HIDDEN_STYLE) | (s.contains("position:absolute") & s.rlike(OFF_SCREEN))
    return F.coalesce(visible, F.lit(True)) & ~named.rlike("|".join(TRAPS)) & ~hidden


# ---- split fields: array<struct<name, contexts: array<struct<text, source, confidence>>, x, y>>
def _said(field: Column) -> Column:
    return _low(F.array_join(F.transform(field["contexts"], lambda c: c["text"]), " "))


def split_confidence(kind: str, fields: Column, in_order: Column) -> Column:
    """0.35, plus the number of fields, the quality of what is said about them, their order and their words; 0 below 0.45."""
    words = [w.lower() for w in SPLIT_WORDS[kind]]
    any_word = lambda t: reduce(lambda a, b: a | b, (t.contains(w) for w in words))
    n = F.size(fields)
    by_count, other = SPLIT_COUNTS.get(kind, ({}, 0))
    count = reduce(lambda acc, kv: acc.when(n == kv[0], kv[1] / 100), list(by_count.items())[1:], F.when(n == next(iter(by_count.items()))[0], next(iter(by_count.items()))[1] / 100)) if by_count else F.when(n < 0, 0.0)
    weights = F.create_map(*[F.lit(x) for kv in SOURCES.items() for x in kv])

    def quality(f):
        one = F.transform(f["contexts"], lambda c: c["confidence"] * F.coalesce(F.try_element_at(weights, c["source"]), F.lit(0.3)) * F.when(any_word(_low(c["text"])), 1.0).otherwise(0.3))
        return F.when(F.size(f["contexts"]) == 0, 0.2).otherwise(F.greatest(F.lit(0.0), F.array_max(one)))

    def keywords(f):
        t = F.concat(_low(f["name"]), F.lit(" "), _said(f))
        hits = sum((F.when(t.contains(w), 1).otherwise(0) for w in words), F.lit(0))
        return F.when(hits == 0, 0.25).otherwise(F.least(F.lit(1.0), hits * 1.5 / len(words)))

    mean = lambda one: F.aggregate(fields, F.lit(0.0), lambda acc, f: acc + one(f)) / n
    total = 0.35 + F.coalesce(count, F.lit(other / 100)) + mean(quality) * 0.25 + F.when(in_order, 0.15).otherwise(-0.25) + mean(keywords) * 0.15
    total = F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))
    return F.when(F.round(total, 9) >= LEAST_SPLIT, total).otherwise(0.0)


def names_in_order(first: Column, second: Column) -> Column:
    """The family name comes first, and neither is the name of a company."""
    company = r"会社名|企業名|法人名|団体名|組織名|company name|organization"
    a, b = _low(first), _low(second)
    return ~a.rlike(company) & ~b.rlike(company) & a.rlike("姓|苗字|せい|last|family|surname") & b.rlike("名|めい|first|given|forename")


def split_strategy(kind: str, fields: Column) -> Column:
    """struct<strategy, confidence>: the votes for split or combined input, in tenths; a draw combines."""
    n = F.size(fields)
    said = F.array_join(F.transform(fields, _said), " ")
    placed = F.filter(fields, lambda f: f["x"].isNotNull() & f["y"].isNotNull())
    near = F.exists(placed, lambda a: F.exists(placed, lambda b: ((a["x"] != b["x"]) | (a["y"] != b["y"])) & (F.hypot(a["x"] - b["x"], a["y"] - b["y"]) <= FAR)))
    same = F.size(F.array_distinct(F.transform(placed, lambda f: F.struct(f["x"], f["y"])))) < F.size(placed)
    separate = (n >= 2) & (F.size(placed) >= 2) & (~(near | same) | (n >= 3))
    vote = lambda cond, k: F.when(cond, k).otherwise(0)
    tends = {"phone": n >= 3, "address": n >= 3, "name": n != 2, "postal_code": F.lit(False)}.get(kind, F.lit(True))
    unified = said.rlike(UNIFIED_SAID)
    split = vote(said.rlike(SPLIT_SAID), 4) + vote(~unified, 3) + vote(separate, 3) + vote(n >= 3, 2) + vote(n == 2, 1) + vote(tends, 2)
    combine = vote(said.rlike(COMBINE_SAID), 4) + vote(unified, 5) + vote(n == 2, 1) + vote(~tends, 2)
    return F.struct(
        F.when(split > combine, "split").otherwise("combine").alias("strategy"), F.least(F.lit(0.95), F.greatest(split, combine) / 10.0).alias("confidence"),
    )


def split_values(kind: str, parts: list[Column], n: Column, strategy: Column) -> Column:
    """array<string> of the values of n fields: all in one; each its part; or parts put together for fewer fields. An address leaves empty parts out."""
    p = [text.stripped(F.coalesce(c, F.lit(""))) for c in parts]
    if kind == "address":
        street, building = F.concat(*p[:4]), p[4]
        whole = F.when(building == "", street).otherwise(F.concat(street, F.lit("　"), building))
        grouped = F.when(n == 2, F.array(street, building)).when(n == 3, F.array(p[0], F.concat(*p[1:4]), building)).otherwise(F.array(p[0], p[1], F.concat(p[2], p[3]), building))
    elif kind == "phone":
        whole = F.concat(*p)
        grouped = F.when(n == 2, F.array(F.concat(p[0], p[1]), p[2])).otherwise(F.array(*p))
    elif kind == "postal_code":
        whole, grouped = F.concat(*p), F.array(*p)
    else:  # names and the two parts of an address of mail
        whole, grouped = F.concat_ws("@" if kind == "email" else "　", *p), F.array(*p)
    return F.when(n == 1, F.array(whole)).when(strategy == "split", F.slice(F.array(*p), F.lit(1), n)).otherwise(grouped)


# ---- duplicates: array<struct<field, value, score, confirm>> in the order of assignment
ASSIGNED = "array<struct<field:string,value:string,score:int,confirm:boolean>>"


def _priority(field: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv]), field), F.lit(0))


def confirmation(field: Column, name: Column, ident: Column, placeholder: Column) -> Column:
    """The field asks for the e-mail address once more."""
    return F.concat_ws(" ", _low(field), _low(name), _low(ident), _low(placeholder)).rlike(CONFIRMATION)


def without_duplicates(assigned: Column) -> Column:
    """One field a value, by priority and then score; the whole phone or its parts; a confirmation only beside the address that it confirms."""

    def better(a, b):
        """Whether a kept one holds its value against a new one."""
        return (_priority(a["field"]) > _priority(b["field"])) | ((_priority(a["field"]) == _priority(b["field"])) & (a["score"] > b["score"]))

    def step(kept, new):
        blank = F.trim(F.replace(new["value"], F.lit("　"), F.lit(""))) == ""
        phone = (new["field"] == "電話番号") | new["field"].isin(*PHONE_PARTS)

        def rival(k):
            other = ((new["field"] == "電話番号") & k["field"].isin(*PHONE_PARTS)) | (new["field"].isin(*PHONE_PARTS) & (k["field"] == "電話番号"))
            same = (k["value"] == new["value"]) & (F.trim(F.replace(k["value"], F.lit("　"), F.lit(""))) != "")
            return F.when(phone & F.exists(kept, lambda x: _rival_phone(new, x)), other).otherwise(same)

        rivals = F.filter(kept, rival)
        add = F.concat(kept, F.array(new))
        primary = F.exists(kept, lambda k: (k["field"] == "メールアドレス") & (k["value"] == new["value"]))
        lost = F.exists(rivals, lambda k: better(k, new))
        return (
            F.when(F.coalesce(new["value"], F.lit("")) == "", kept).when(blank, add).when(new["confirm"], F.when(primary, add).otherwise(kept))
            .when(lost, kept).otherwise(F.concat(F.filter(kept, lambda k: ~rival(k)), F.array(new)))
        )

    return F.aggregate(assigned, F.array().cast(ASSIGNED), step)


def _rival_phone(new: Column, k: Column) -> Column:
    return ((new["field"] == "電話番号") & k["field"].isin(*PHONE_PARTS)) | (new["field"].isin(*PHONE_PARTS) & (k["field"] == "電話番号"))


# ---- choices
def pick(texts: Column, preferred: list[str], values: Column | None = None, not_these: str | None = None) -> Column:
    """The place (from 0) of the last choice of the first preference that matches; else the last choice that is one; else the last."""
    places = F.sequence(F.lit(0), F.size(texts) - 1)
    low = lambda i: _low(F.get(texts, i))

    def is_choice(i):
        ok = F.lit(True)
        if values is not None:
            v = F.trim(F.coalesce(F.get(values, i), F.lit("")))
            ok = ok & (v != "") & ~F.lower(v).rlike(NO_CHOICE)
        return ok & ~low(i).rlike(not_these) if not_these else ok

    def liked(p: str):
        return lambda i: low(i).rlike(p) & is_choice(i)

    options = [F.array_max(F.filter(places, liked(p))) for p in preferred]
    return F.when(F.size(texts) > 0, F.coalesce(*options, F.array_max(F.filter(places, is_choice)), F.size(texts) - 1)).otherwise(0)


def contact_method(texts: Column) -> Column:
    """The place of the first choice by mail, of any way, by phone, by fax; else the first."""
    places = F.sequence(F.lit(0), F.greatest(F.size(texts) - 1, F.lit(0)))

    def names(p: str):
        return lambda i: _low(F.get(texts, i)).rlike(p)

    return F.coalesce(*[F.array_min(F.filter(places, names(p))) for p in CONTACT_METHODS], F.lit(0))


def gender_choice(texts: Column) -> Column:
    places = F.sequence(F.lit(0), F.greatest(F.size(texts) - 1, F.lit(0)))
    return F.coalesce(F.array_min(F.filter(places, lambda i: F.coalesce(F.get(texts, i), F.lit("")).rlike(MALE))), F.lit(0))


def gender(value: Column) -> Column:
    v = F.lower(F.trim(value))
    return reduce(lambda acc, r: acc.when(v.rlike(r[1]), r[0]), GENDERS[1:], F.when(v.rlike(GENDERS[0][1]), GENDERS[0][0]))


# ---- names: map<field, struct<name, id, classes, placeholder, context, score>>
def _attributes(e: Column) -> Column:
    return F.concat_ws(" ", _low(e["name"]), _low(e["id"]), _low(e["classes"]), _low(e["placeholder"]))


def pruned_names(mapping: Column, least: int = 85) -> Column:
    """Beside a whole name, a part whose label or attributes name something else, or whose score is low, goes."""

    def wrong(k, e):
        bad = _low(e["context"]).rlike(NOT_NAME) | _attributes(e).rlike("kana|furigana|katakana|hiragana") | (F.coalesce(e["score"], F.lit(0)) < least)
        return k.isin("姓", "名") & bad

    return F.when(F.map_contains_key(mapping, "統合氏名"), F.map_filter(mapping, lambda k, e: ~wrong(k, e))).otherwise(mapping)


def swapped_names(mapping: Column) -> Column:
    """Family and first name, and their kana, changed over where attributes, labels or placeholders show that they are mixed up."""

    def swap(mapping, a, b, cond):
        """The keys a and b change places. The map is a variable, so that it is not spelt out again at each step."""

        def one(m):
            both = F.map_contains_key(m, a) & F.map_contains_key(m, b)
            return F.when(both & cond(F.try_element_at(m, F.lit(a)), F.try_element_at(m, F.lit(b))), F.transform_keys(m, lambda k, _: F.when(k == a, b).when(k == b, a).otherwise(k))).otherwise(m)

        return F.transform(F.array(mapping), one)[0]

    def attributes(x, y, kana=False):
        p, q = (F.concat_ws(" ", _low(e["name"]), _low(e["id"]), _low(e["classes"])) for e in (x, y))
        mixed = (p.contains("first") & q.contains("last")) | (p.contains("mei") & q.contains("sei"))
        return mixed & p.contains("kana") & q.contains("kana") if kana else mixed

    def labels(x, y):
        p, q = _low(x["context"]), _low(y["context"])
        return (p.contains("first") & q.contains("last")) | (p.contains("名") & p.contains("last") & q.contains("姓") & q.contains("first"))

    def placeholders(first, last):
        return lambda x, y: _low(x["placeholder"]).rlike(first) & _low(y["placeholder"]).rlike(last)

    m = swap(mapping, "姓", "名", attributes)
    m = swap(m, "姓", "名", labels)
    m = swap(m, "姓カナ", "名カナ", lambda x, y: attributes(x, y, kana=True))
    m = swap(m, "姓", "名", placeholders("名|first name|given name", "姓|last name|family name"))
    m = swap(m, "姓カナ", "名カナ", placeholders("メイ|名", "セイ|姓"))
    return swap(m, "姓ひらがな", "名ひらがな", placeholders("めい|名", "せい|姓"))


def kana_by_script(mapping: Column) -> Column:
    """A kana field that asks for hiragana becomes the hiragana field if there is none, and the other way round; both hiragana parts drop the whole kana name."""
    return F.transform(F.array(mapping), _kana_by_script)[0]


def _kana_by_script(mapping: Column) -> Column:

    def script(e):
        blob = F.concat_ws(" ", e["name"], e["id"], e["classes"], e["placeholder"])
        katakana = blob.rlike("カナ|カタカナ|フリガナ")
        return F.when(katakana, "k").when(blob.rlike("ひらがな|ふりがな"), "h")

    def key(k, e):
        out = k
        for kana, hira in (("姓カナ", "姓ひらがな"), ("名カナ", "名ひらがな")):
            out = F.when((k == kana) & (script(e) == "h") & ~F.map_contains_key(mapping, hira), hira).when((k == hira) & (script(e) == "k") & ~F.map_contains_key(mapping, kana), kana).otherwise(out)
        return out

    def whole(m):
        both = F.map_contains_key(m, "姓ひらがな") & F.map_contains_key(m, "名ひらがな")
        return F.map_filter(m, lambda k, _: ~(both & (k == "統合氏名カナ")))

    return F.transform(F.array(F.transform_keys(mapping, key)), whole)[0]


# ---- required fields and buttons
def required(attribute: Column, aria: Column, classes: Column, contexts: Column) -> Column:
    """By attribute, class or a mark in what is said about the field, unless it is said to be optional."""
    said = F.array_join(F.coalesce(contexts, F.array().cast("array<string>")), " ")
    marked = said.rlike(REQUIRED_MARKS) & ~said.rlike(OPTIONAL_MARKS)
    return F.coalesce(attribute, F.lit(False)) | (_low(aria) == "true") | _low(classes).rlike(REQUIRED_CLASSES) | marked


def submit_button(buttons: Column) -> Column:
    """The place (from 0) of the button that sends: of array<struct<type, text, visible>>, by type, by words that send, send later, confirm; null without any."""
    places = F.sequence(F.lit(0), F.greatest(F.size(buttons) - 1, F.lit(0)))
    at = lambda i: F.get(buttons, i)
    ok = lambda i: F.coalesce(at(i)["visible"], F.lit(False)) & ~_low(at(i)["text"]).rlike(NOT_SEND)
    first = lambda cond: F.array_min(F.filter(places, lambda i: ok(i) & cond(i)))

    def says(words: str):
        return lambda i: _low(at(i)["text"]).rlike(words)

    return F.coalesce(first(lambda i: _low(at(i)["type"]) == "submit"), *[first(says(w)) for w in (SEND, SEND_LATER, CONFIRM)])


def summary(assigned: Column, n_fields: Column, required_fields: Column) -> Column:
    """struct<assigned, coverage_pct, required, required_done>: what of a form is mapped. A half of the last digit goes to the even one."""
    names = F.transform(assigned, lambda a: a["field"])
    done = F.size(F.array_intersect(F.array_distinct(names), required_fields))
    return F.struct(
        F.size(assigned).alias("assigned"), F.when(n_fields > 0, F.bround(1000.0 * F.size(assigned) / n_fields, 0) / 10).otherwise(0.0).alias("coverage_pct"),
        F.size(required_fields).alias("required"), done.alias("required_done"),
    )
