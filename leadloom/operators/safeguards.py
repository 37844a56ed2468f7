"""What must hold before a field takes an element, and whether the label of an element names another field."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom.functions import text

# fixed values: words by theme, as they stand in attributes and labels in lower case
ADDRESS = "住所|address|addr|street|city|prefecture|都道府県|市区町村"
MICROFORMAT = "p-region|p-locality|p-street-address|p-extended-address"
KANA = "カナ|カタカナ|フリガナ|ふりがな|kana|katakana|furigana|セイ|メイ"
HIRAGANA = "hiragana|ひらがな"
DEPARTMENT = "部署|部門|課|係|department|dept|division|section|team"
AUTH = "captcha|verification|token|otp|confirm|確認|認証|quiz|security|セキュリティ|文字を入力|次の文字|表示されている文字|上の文字"
TRAVEL = "宿泊|ホテル|旅館|部屋|客室|レンタカー|旅程|便名|航空券|予約"
ORGANISATION = "会社名|法人名|団体名|組織名|企業名|会社"
PERSON = "お名前|氏名|姓名|full name|first name|given name|last name|family name"
# fixed values: which fields are names in kana, and in hiragana
KANA_FIELDS, HIRAGANA_FIELDS = ("統合氏名カナ", "姓カナ", "名カナ", "会社名カナ"), ("姓ひらがな", "名ひらがな")
# fixed values: fields by what a label says about them; a label that names one and not the field itself speaks against the field
LABELS = {
    "メールアドレス": "メール|e-?mail", "電話番号": "電話|tel|phone|携帯", "郵便番号": "郵便|〒|zip|postal", "住所": "住所|所在地|address", "会社名": "会社|企業|法人|company|organization", "部署名": "部署|部門|department",
    "役職": "役職|職位|position", "件名": "件名|題名|subject", "お問い合わせ本文": "お問い合わせ|本文|内容|メッセージ|message|inquiry", "性別": "性別|gender|sex", "企業URL": "url|ホームページ|サイト|website",
}


def attributes(*parts: Column) -> Column:
    return F.lower(F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts]))


def passes(field: Column, kind: Column, attrs: Column, label: Column) -> Column:
    """Whether the field may take an element of a type, with attributes and a label (both in lower case). Fields without a rule may."""
    either = lambda words: attrs.rlike(words.lower()) | label.rlike(words.lower())
    said = lambda words: label.rlike(words)
    t = F.lower(F.coalesce(kind, F.lit("")))
    message = either("お問い合わせ|メッセージ|本文|内容|message|inquiry|contact")
    phone_time = said("時|午前|午後|連絡方法") | attrs.rlike("timeno|h1|h2")
    rules = [
        (("メールアドレス",), (t == "email") | either("e-?mail|mail|メール")),
        (("電話番号",), (t == "tel") | attrs.rlike("tel|phone|電話|携帯") | (said("電話|tel|phone|携帯|mobile|cell") & ~phone_time)),
        (("郵便番号",), (attrs.rlike("zip|postal|postcode|郵便|〒|yubin|yuubin") | said("郵便|〒|postal|zip")) & ~attrs.rlike("captcha|image_auth|token|otp|verification|confirm|確認")),
        (("都道府県",), attrs.rlike("都道府県|pref") | said("都道府県|prefecture")),
        (("お問い合わせ本文",), ~either(TRAVEL) & (~either(f"{ADDRESS}|{MICROFORMAT}") | message)),
        (("住所",), either(f"{ADDRESS}|所在地|{MICROFORMAT}") & ~either(f"{TRAVEL}|旅行|出発|到着") & ~either(f"{KANA}|{HIRAGANA}|furi") & ~either(DEPARTMENT) & ~either(AUTH)),
        (("会社名",), ~either(f"カナ|フリガナ|ふりがな|{HIRAGANA}|katakana|kana|セイ|メイ") & ~said(PERSON)),
        (("姓", "名"), ~either(ORGANISATION)),
        (("件名",), either("件名|subject|題名") & ~either("フリガナ|ふりがな|カナ|kana|furigana|セイ|メイ")),
        (("役職",), either("役職|職位|position|job title|title|役割|ポジション") & ~said("きっかけ|how did you hear|referrer")),
        (KANA_FIELDS, either(KANA) & ~either("性別|sex|gender")),
        (HIRAGANA_FIELDS, either(f"{HIRAGANA}|ふりがな|フリガナ") & ~either("性別|sex|gender")),
        (("統合氏名",), ~either(f"{ADDRESS}|郵便|zip|postal|postcode") & ~either("会社名")),
    ]
    return reduce(lambda acc, r: acc.when(field.isin(*r[0]), r[1]), rules[1:], F.when(field.isin(*rules[0][0]), rules[0][1])).otherwise(True)


def consistent(field: Column, label: Column) -> Column:
    """The label names the field, or no field at all: not one of the others only."""
    low = F.lower(F.coalesce(label, F.lit("")))
    own = reduce(lambda acc, r: acc.when(field == r[0], low.rlike(r[1])), list(LABELS.items())[1:], F.when(field == next(iter(LABELS)), low.rlike(LABELS[next(iter(LABELS))])))
    others = reduce(lambda a, b: a | b, ((field != k) & low.rlike(words) for k, words in LABELS.items()))
    return F.coalesce(own, F.lit(False)) | ~others


def value_for(field: Column, kind: Column, client: Column, subject: Column, message: Column) -> Column:
    """The value that a field gets from a client (a map of strings): whole and split names, mail, phone, postal code, address; a choice gets only gender and prefecture."""
    part = lambda k: text.stripped(F.coalesce(F.try_element_at(client, F.lit(k)), F.lit("")))
    both = lambda a, b, by="　": F.when(part(a) == "", part(b)).when(part(b) == "", part(a)).otherwise(F.concat(part(a), F.lit(by), part(b)))
    street = F.concat(*[part(f"address_{k}") for k in (1, 2, 3, 4)])
    values = {
        "会社名": part("company_name"), "会社名カナ": part("company_name_kana"), "統合氏名": both("last_name", "first_name"), "統合氏名カナ": both("last_name_kana", "first_name_kana"), "姓": part("last_name"), "名": part("first_name"),
        "姓カナ": part("last_name_kana"), "名カナ": part("first_name_kana"), "姓ひらがな": part("last_name_hiragana"), "名ひらがな": part("first_name_hiragana"),
        "メールアドレス": F.when((part("email_1") != "") & (part("email_2") != ""), F.concat(part("email_1"), F.lit("@"), part("email_2"))).otherwise(""),
        "電話番号": F.concat(part("phone_1"), part("phone_2"), part("phone_3")), "電話1": part("phone_1"), "電話2": part("phone_2"), "電話3": part("phone_3"),
        "郵便番号": F.concat(part("postal_code_1"), part("postal_code_2")), "郵便番号1": part("postal_code_1"), "郵便番号2": part("postal_code_2"), "都道府県": part("address_1"),
        "住所": F.when(part("address_5") == "", street).otherwise(F.concat(street, F.lit("　"), part("address_5"))), "部署名": part("department"), "役職": part("position"), "性別": part("gender"),
        "企業URL": part("website_url"), "件名": F.coalesce(subject, F.lit("")), "お問い合わせ本文": F.coalesce(message, F.lit("")),
    }
    found = reduce(lambda acc, r: acc.when(field == r[0], r[1]), list(values.items())[1:], F.when(field == "会社名", values["会社名"])).otherwise("")
    return F.when((F.lower(kind) == "select") & ~field.isin("性別", "都道府県"), "").otherwise(found)
