"""Text functions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"[぀-ヿ㐀-鿿ｦ-ﾟ]"

def has_cjk(c: Column) -> Column:
    return c.rlike(CJK)


def stripped(c: Column) -> Column:
    """Without white space at the ends, wide spaces included."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def says(value: Column, words: str) -> Column:
    """One of the words (alternatives of a pattern) is in the value; plain words are sought as they are, those that hold another one not at all."""
    if re.search(r"[\\^$.*+?()\[\]{}]", words):
        return value.rlike(words)
    plain = dict.fromkeys(words.split("|"))
    least = [w for w in plain if not any(o != w and o in w for o in plain)]
    return reduce(lambda a, b: a | b, (value.contains(w) for w in least))


def contains_token(text: Column, token: str) -> Column:
    """The token with borders around it; a CJK token also inside a word, but for 名."""
    border = r"[\s_\-\[\](){}（）「」・:：/.,、。]"
    bounded = text.rlike(rf"(^|{border})\Q{token}\E($|{border})")
    inside = any("぀" <= ch <= "鿿" for ch in token) and token != "名"
    return bounded | text.contains(token) if inside else bounded


def sentences(c: Column, least: int = 10) -> Column:
    """Trimmed sentences of at least some characters."""
    return F.filter(F.transform(F.split(c, r"[。！？\n\r]+"), lambda s: F.trim(s)), lambda s: F.length(s) >= least)


def meaningful(c: Column) -> Column:
    """5 to 500 characters that are not only digits and signs, or Latin letters and spaces."""
    return F.length(c).between(5, 500) & ~c.rlike(r"^[\s\d\-_=+*#@\[\]()]+$") & ~c.rlike(r"^[a-zA-Z\s]+$")


def char_jaccard(a: Column, b: Column) -> Column:
    """Similarity of the sets of characters; 0 for two empty texts."""
    x, y = F.array_distinct(F.split(a, "")), F.array_distinct(F.split(b, ""))
    x, y = F.filter(x, lambda s: s != ""), F.filter(y, lambda s: s != "")
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(F.lit(0.0))


def distinct_longest(texts: Column, limit: float = 0.8) -> Column:
    """Texts, the longest first, without those that a kept one contains or resembles; ties by text."""
    order = F.array_sort(texts, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    none = F.array().cast("array<string>")

    def step(kept, t):
        near = F.exists(kept, lambda k: k.contains(t) | (char_jaccard(k, t) > limit))
        return F.when(near, kept).otherwise(F.concat(kept, F.array(t)))

    return F.aggregate(order, none, step)


def unescape(c: Column) -> Column:
    """Backslash sequences for line break, tab and carriage return as the characters."""
    for k, v in ((r"\r", "\r"), (r"\n", "\n"), (r"\t", "\t")):
        c = F.replace(c, F.lit(k), F.lit(v))
    return c


def mask_edges(c: Column) -> Column:
    """All but the first and last character as stars; short texts as stars only."""
    n = F.length(c)
    return F.when(n <= 2, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.substring(c, 1, 1), F.repeat(F.lit("*"), n - 2), F.right(c, F.lit(1))))


def mask_email(c: Column) -> Column:
    """The first character of the name, and the domain."""
    return F.when(c.contains("@"), F.concat(F.substring(c, 1, 1), F.lit("***@"), F.substring_index(c, "@", -1))).otherwise(F.lit("***"))


def matched_keywords(c: Column, words: list[str]) -> Column:
    """The words that occur, in their order."""
    low = F.lower(c)
    return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: low.contains(F.lower(w)))


def placeholders(c: Column) -> Column:
    """Distinct {field} names, with or without an optional block around them, and without those of client and targeting."""
    names = F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"\{([^}]+)\}"), F.lit(1)), lambda n: F.trim(n)))
    return F.filter(names, lambda n: ~n.startswith("client.") & ~n.startswith("targeting."))


def expand(template: Column, values: dict[str, Column]) -> Column:
    """{field} by its value; a missing value is empty. A block [... {field} ...] stays, without its brackets, only if the field has a value."""
    for name, value in values.items():
        given = F.coalesce(value.cast("string"), F.lit(""))
        block = rf"\[([^\[\]]*\{{\s*\Q{name}\E\s*\}}[^\[\]]*)\]"
        template = F.when(given == "", F.regexp_replace(template, block, "")).otherwise(F.regexp_replace(template, block, "$1"))
        template = F.replace(template, F.lit("{" + name + "}"), given)
    return template


# fixed values: samples in stored forms, and the placeholder of each, in the order in which they are replaced
SAMPLES = {
    "株式会社サンプル": "company_name", "カブシキガイシャサンプル": "company_name_kana", "yamada": "email_1", "gmail.com": "email_2", "03": "phone_1", "1234": "phone_2", "5678": "phone_3", "山田": "last_name", "太郎": "first_name",
    "ヤマダ": "last_name_kana", "タロウ": "first_name_kana", "やまだ": "last_name_hiragana", "たろう": "first_name_hiragana", "男性": "gender", "営業部": "department", "部長": "position", "100": "postal_code_1",
    "0001": "postal_code_2", "東京都": "address_1", "千代田区": "address_2", "神田": "address_3", "1-1-1": "address_4", "サンプルビル5F": "address_5", "https://www.sample-corp.co.jp": "website_url",
}
TARGETING_SAMPLES = {"お問い合わせ": "subject", "御社のサービスについて詳しく教えてください。": "message"}


def with_placeholders(document: Column) -> Column:
    """A JSON document with the samples in its texts, and only there, as placeholders: what stands between unescaped quotes and is not a member's name."""
    pieces = F.split(document, r'(?<!\\)"')
    marks = [*((k, f"{{client.{v}}}") for k, v in SAMPLES.items()), *((k, f"{{targeting.{v}}}") for k, v in TARGETING_SAMPLES.items())]

    def replaced(x, i):
        for sample, mark in marks:
            x = F.replace(x, F.lit(sample), F.lit(mark))
        return x

    name = lambda i: F.coalesce(F.get(pieces, i + 1), F.lit("")).rlike(r"^\s*:")
    return F.array_join(F.transform(pieces, lambda x, i: F.when((i % 2 == 1) & ~name(i), replaced(x, i)).otherwise(x)), '"')


# fixed values: other names of fields, by a part of the name
VARIATIONS = [
    ("name", ("name", "お名前", "氏名", "nama", "fullname")), ("email", ("email", "メール", "mail", "e-mail", "eメール")), ("phone", ("phone", "電話", "tel", "telephone", "電話番号")),
    ("company", ("company", "会社", "会社名", "corp", "corporation")), ("message", ("message", "メッセージ", "内容", "content", "inquiry")), ("privacy", ("privacy", "プライバシー", "個人情報", "consent", "同意")),
    ("contact", ("contact", "連絡", "renraku")),
]


def variations(name: Column) -> Column:
    """The distinct other spellings of a field's name, sorted: those of the first part that is in it, and with dashes, underscores or nothing for spaces."""
    low = F.lower(name)
    none = F.array().cast("array<string>")
    known = F.coalesce(*[F.when(low.contains(part), F.array(*[F.lit(w) for w in words])) for part, words in VARIATIONS], none)
    changed = [F.replace(name, F.lit(a), F.lit(b)) for a, b in (("_", "-"), ("-", "_"), (" ", ""), (" ", "_"))]
    return F.array_sort(F.array_distinct(F.concat(F.array(name, *changed), known)))


def joined(*parts: Column, by: str = "") -> Column:
    """Non-empty parts."""
    return F.array_join(F.filter(F.array(*parts), lambda p: F.coalesce(p, F.lit("")) != ""), by)


def phone_index(c: Column) -> Column:
    """The part that a phone field's name asks for: [0] is 1, a last digit itself, else 1; null if it names no phone."""
    low = F.lower(c)
    bracket, digit = F.regexp_extract(low, r"\[(\d+)\]", 1), F.regexp_extract(low, r"(\d)$", 1)
    index = F.when(bracket != "", bracket.cast("int") + 1).when(digit != "", digit.cast("int")).otherwise(F.lit(1))
    return F.when(low.rlike("tel|phone|fax|電話"), index)
