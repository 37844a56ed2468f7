"""Notices that forbid sales contact: which sentences of a page are one, and how sure that is.

A sentence counts if a keyword is in it, or a pattern of a sales word, a kind of contact and a refusal. 営業 also means opening hours
and business in general, so a hit by that word alone is dropped if the sentence holds one of the harmless words and nothing forbidding
is left without it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom.functions import text

# fixed values: what follows 営業 where it does not mean sales
AFTER = (
    "日|時間|中|再開|停止|休止|開始|終了|年数|経験|歴|所|部|課|担当|マン|員|職|窓口|チーム|組織|体制|拠点|店舗|エリア|地域|範囲|区域|車|車両|用|向け"
    "|秘密|機密|情報|データ|資料|ツール|支援|システム|管理|統計|分析|実績|成績|利益|収益|報告|会議|指標|目標|計画|予算|費用|コスト|効率|生産性|品質"
    "|戦略|方針|ノウハウ|スキル|力|サービス|対応|強化|拡大|促進|推進|改善|革新|改革|最適化|効果|結果|成果|業績|実態|状況|環境|市場|競争|優位"
    "|価値|価格|単価|金額|売上|収入|損益|黒字|赤字|キャッシュフロー"
)
# fixed values: words of sentences about something else: fraud, service, rules and daily work
HARMLESS = (
    "なりすまし|詐欺|偽サイト|フィッシング|悪質|不審|偽装|模倣|違法|不正|注意喚起|警戒|被害|トラブル|セキュリティ|お客様|カスタマー|サポート|ヘルプ|サービス|お問い合わせ窓口"
    "|相談窓口|受付窓口|案内|説明|ガイド|マニュアル|手順|方法|個人情報|プライバシー|データ保護|利用規約|約款|規約|方針|ポリシー|法的|法律|法令|規則|条例|コンプライアンス"
    "|運営|管理|システム|メンテナンス|更新|改善|品質|向上|利便性|機能|特徴|メリット|効果|実績"
)
# fixed values: keywords of notices: a field of business and what is done in it
KEYWORDS = (
    "営業目的|営業を目的|営業による|営業のため|営業に関する|営業活動|営業行為|営業案内|営業電話|営業メール|営業連絡|営業訪問"
    "|セールス目的|セールスを目的|セールスのため|セールスに関する|セールス活動|セールス行為|セールス案内|セールス電話|セールスメール|セールス連絡|セールス訪問"
    "|販売目的|販売を目的|販売のため|販売に関する|販売活動|販売行為"
    "|勧誘目的|勧誘を目的|勧誘による|勧誘のため|勧誘に関する|勧誘活動|勧誘行為|勧誘案内|勧誘電話|勧誘メール|勧誘連絡"
    "|宣伝目的|宣伝を目的|宣伝のための|宣伝に関する|宣伝活動|宣伝行為|広告目的|広告宣伝|PR目的|プロモーション目的|売り込み|売込"
    "|商業目的|商業利用|商業的利用|ビジネス目的|ビジネス利用|営利目的|営利利用|迷惑行為|迷惑電話|スパム"
    # a word of its own or inflected, not a part of another one
    r"|(?<!\p{IsLatin})spam(?:s|ming|med|mers?)?(?!\p{IsLatin})|(?<!\p{IsLatin})SPAM(?!\p{IsLatin})"
)
# fixed values: kinds of contact, and four ways to refuse
CONTACT = "(?:問い合わせ|連絡|メール|電話|訪問)"
REFUSED, UNABLE = "お断り|断り|遠慮|禁止", "できません|いたしかねます|しておりません|お受けしておりません|対応しておりません|受け付けておりません"
POLITE, NEGATIVE = "お控えください|ご遠慮ください|お断りします|お断りいたします|控えていただけ|遠慮していただけ", "ません|ないため|いたしかねます"
ENGLISH = (
    r"\bno\s+(?:sales|solicitations?|cold\s*calls?|telemarketing|vendor\s+solicitations?)\b", r"\bno\s+vendors?\s*(?:contact|calls|emails)\b",
    r"\b(?:do\s*not|don't|we\s*do\s*not|we\s*don't|not)\s+(?:accept|take|allow|permit)\s+(?:sales|solicitations?|vendor\s+(?:contacts?|inquiries?)|cold\s*calls?|telemarketing)\b",
    r"\b(?:sales|solicitations?|telemarketing|cold\s*calls?|vendor\s+inquiries?)\s+(?:are|is)\s+(?:not\s+accepted|prohibited|forbidden)\b",
    r"\bunsolicited\s+(?:sales|offers|proposals|marketing)\s+(?:are|is)\s+(?:not\s+accepted|prohibited|forbidden)\b",
    r"\bplease\s+do\s+not\s+contact\s+us\s+for\s+(?:sales|marketing|business\s+proposals?)\b", r"\bdo\s+not\s+use\s+this\s+form\s+for\s+(?:sales|solicitations?)\b",
    r"\bwe\s+are\s+not\s+(?:accepting|taking)\s+(?:sales|solicitations?|vendor\s+inquiries?)\b",
)
# fixed values: words of a refusal, of sales and of contact that raise the confidence
REFUSAL = r"ません|お断り|ご遠慮|お控え|do not|don't|no |not accept|not be accepted|not allowed|not permitted"
SALES_WORDS, CONTACT_WORDS = "営業|セールス|勧誘|販売|sales|solicitation|telemarketing", "問い合わせ|連絡|電話|メール|contact|call|phone|email"
# fixed values: a sentence without one of these is no notice
HINTS = "営業|セールス|販売|勧誘|宣伝|広告|目的|売り?込|商業|営利|ビジネス|迷惑|スパム|業務|取材|(?i)spam|sales|solicit|cold|telemarketing|vendor|unsolicited|marketing|proposal"
#: Confidence of a hit in a telling place of the page, and anywhere in it.
TARGETED, ANYWHERE = 75, 60


def patterns() -> list[str]:
    """Every order of a sales word, a contact and a refusal that forbids."""
    sales, any_no = f"営業(?!{AFTER})", f"(?:{REFUSED}|{UNABLE}|{POLITE})"
    kinds, trade = f"(?:{sales}|セールス|勧誘|販売)", f"(?:{sales}|セールス|勧誘|販売|商業|営利)"
    asked = f"(?:{sales}|セールス|勧誘)"
    both = [(kinds + f".*?{CONTACT}", f"(?:{REFUSED})"), ("売り?込み", f"(?:{REFUSED})"), (f"{sales}.*?{CONTACT}", f"(?:{POLITE})"), (f"{kinds}(?:電話|メール|連絡)", any_no),
            (f"{trade}.*?目的", any_no), ("迷惑.*?(?:電話|連絡|行為)", f"(?:{REFUSED})")]
    one_way = [(f"{kinds}.*?(?:お受け|対応)", f"(?:{UNABLE})"), (f"{asked}.*?{CONTACT}", f"(?:{POLITE}|{NEGATIVE})"), (f"業務.*?{CONTACT}", f"(?:{POLITE}|{UNABLE})"),
               ("(?:取材|営業等?).*?(?:電話|連絡|お問い合わせ)", f"(?:{UNABLE}|{POLITE})"), ("(?:営業|勧誘|セールス).*?(?:等|など)", f"(?:{UNABLE}|{POLITE})")]
    return [f"{a}.*?{b}" for a, b in [*both, *one_way]] + [f"{b}.*?{a}" for a, b in both] + list(ENGLISH)


FORBIDS = "(?i)" + "|".join(patterns())
#: Every match of the patterns holds a refusal or is English.
REFUSES = f"{REFUSED}|{UNABLE}|{POLITE}|{NEGATIVE}|(?i)not?\\b|n't|are|is"


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), where f names the value more than once: it is computed a single time a row."""
    return F.transform(F.array(value), f)[0]


def by_heads(words: str) -> str:
    """The same words, those of one head together: where the head is not, none of them is tried."""
    heads: dict[str, list[str]] = {}
    for w in words.split("|"):
        heads.setdefault(w[:2] if w.isalpha() else w, []).append(w)
    return "|".join(h if h in ws else f"{h}(?:{'|'.join(w[2:] for w in ws)})" for h, ws in heads.items())


def forbids(sentence: Column) -> Column:
    """A keyword or a pattern is in the sentence."""
    return sentence.rlike(by_heads(KEYWORDS)) | sentence.rlike(FORBIDS)


def prohibited(sentence: Column) -> Column:
    """The sentence forbids sales contact, harmless uses of 営業 aside."""
    words = F.array(*[F.lit(w) for w in [*(f"営業{a}" for a in AFTER.split("|")), *HARMLESS.split("|")]])
    forbidding = sentence.rlike(by_heads(KEYWORDS))

    def judged(hit: Column) -> Column:
        other_hit = ((hit != "") & ~hit.contains("営業")) | sentence.rlike(by_heads(_without_business(KEYWORDS)))
        harmless = F.exists(words, lambda w: F.contains(sentence, w) & ~forbids(F.replace(sentence, w, F.lit(""))))
        return ((hit != "") | forbidding) & (other_hit | ~harmless)

    # the patterns are matched once a sentence, and only where their words are
    hit = F.when(sentence.rlike(REFUSES), F.regexp_extract(sentence, f"({FORBIDS})", 1)).otherwise("")
    return sentence.rlike(HINTS) & once(hit, judged)


def _without_business(words: str) -> str:
    return "|".join(w for w in words.split("|") if "営業" not in w)


def notices(page_text: Column) -> Column:
    """The distinct prohibiting sentences of a text, the longest first, without those that a longer one holds or resembles."""
    found = F.filter(text.sentences(page_text), lambda s: text.meaningful(s) & prohibited(s))
    return text.distinct_longest(found)


def confidence(found: Column, targeted: Column) -> Column:
    """struct<score, level> of the sentences that were found: where, refusals, sales words with contacts, and how many."""

    def of(found: Column) -> Column:
        each = F.aggregate(
            found, F.lit(0), lambda acc, s: acc + F.when(s.rlike(REFUSAL), 10).otherwise(0) + F.when(s.rlike(SALES_WORDS) & s.rlike(CONTACT_WORDS), 15).otherwise(0)
        )
        n = F.size(found)
        score = F.when(targeted, TARGETED).otherwise(ANYWHERE) + each + F.when(n >= 3, 10).when(n == 2, 5).otherwise(0)
        return F.struct(n.alias("n"), F.when(n > 0, F.least(F.lit(100), score)).otherwise(0).alias("score"))

    def levelled(sure: Column) -> Column:
        steps = [(90, "high"), (70, "medium"), (50, "low")]
        level = reduce(lambda acc, s: acc.when(sure["score"] >= s[0], s[1]), steps, F.when(sure["n"] == 0, "none")).otherwise("very_low")
        return F.struct(sure["score"].alias("score"), level.alias("level"))

    return once(once(found, of), levelled)


# fixed values: phrases by category: said outright, said by the way, said of some; weights of categories and of elements; words that add a tenth each
OUTRIGHT, BY_THE_WAY, OF_SOME = "直接的な営業禁止", "間接的な営業禁止", "条件付き制限"
PHRASES = {
    OUTRIGHT: (
        "営業のお電話はお断り", "営業電話お断り", "営業電話はお断り", "営業メールお断り", "営業活動はお断り", "営業目的でのご連絡はお断り", "営業・勧誘はお断り", "勧誘のお電話はお断り", "勧誘電話お断り", "売り込み電話お断り",
        "売り込みはお断り", "セールス電話お断り", "テレアポお断り", "営業お断り", "勧誘お断り",
    ),
    BY_THE_WAY: (
        "商品・サービスの売り込み", "商品の売り込み", "サービスの売り込み", "宣伝目的での", "広告目的での", "PR目的での", "商品のご紹介", "サービスのご紹介", "商材の紹介", "ご提案のお電話", "セールスのお電話", "営業のご連絡",
    ),
    OF_SOME: (
        "お客様以外からのお問い合わせはご遠慮", "関係者以外のお問い合わせ", "同業者からのお問い合わせ", "競合他社からのお問い合わせ", "イタズラ目的でのお問い合わせ", "いたずら目的でのお問い合わせ",
    ),
}
CATEGORY_WEIGHTS = {OUTRIGHT: 0.9, BY_THE_WAY: 0.7, OF_SOME: 0.6}
ELEMENT_WEIGHTS, OTHER_ELEMENT = {"form": 1.0, "p": 0.9, "div": 0.8, "span": 0.7, "small": 0.9, "em": 0.8, "strong": 0.8}, 0.6
BOOSTS, LEAST_CONFIDENCE = ("お問い合わせ", "注意", "注意事項", "ご注意", "禁止", "お断り"), 0.6


def phrase_matches(texts: Column) -> Column:
    """array<struct<phrase, category, confidence>> of texts (array<struct<text, element>>): phrases with enough confidence, each where it stands first."""
    # the folded phrases are literals, and a text is folded once
    known = [(p, c, CATEGORY_WEIGHTS[c]) for c, ps in PHRASES.items() for p in ps]
    weights = F.create_map(*[F.lit(x) for kv in ELEMENT_WEIGHTS.items() for x in kv])

    def of(t: Column) -> Column:
        return once(F.lower(t["text"]), lambda low: matched(low, t["element"]))

    def matched(low: Column, element: Column) -> Column:
        here = F.array_compact(F.array(*[F.when(low.contains(p.lower()), F.struct(F.lit(p).alias("phrase"), F.lit(c).alias("category"), F.lit(w).alias("weight"))) for p, c, w in known]))
        boost = F.lit(0.1) * sum((F.when(low.contains(w), 1).otherwise(0) for w in BOOSTS), F.lit(0))
        weight = F.coalesce(F.try_element_at(weights, element), F.lit(OTHER_ELEMENT))
        added = F.struct(weight.alias("weight"), boost.alias("boost"))
        sure = once(added, lambda a: F.transform(here, lambda p: F.struct(p["phrase"].alias("phrase"), p["category"].alias("category"), F.least(F.lit(1.0), p["weight"] * a["weight"] + a["boost"]).alias("confidence"))))
        return F.filter(sure, lambda m: m["confidence"] >= LEAST_CONFIDENCE)

    every = F.flatten(F.transform(texts, of))
    none = F.array().cast("array<struct<phrase:string,category:string,confidence:double>>")
    return F.aggregate(every, none, lambda acc, m: F.when(F.exists(acc, lambda k: k["phrase"] == m["phrase"]), acc).otherwise(F.concat(acc, F.array(m))))


def phrase_level(matches: Column) -> Column:
    """struct<n, direct, confidence, level> of matches: two phrases that say it outright, or one that is sure, are strict."""

    def counted(m: Column) -> Column:
        most = F.coalesce(F.array_max(F.transform(m, lambda x: x["confidence"])), F.lit(0.0))
        return F.struct(F.size(m).alias("n"), F.size(F.filter(m, lambda x: x["category"] == OUTRIGHT)).alias("direct"), most.alias("confidence"))

    def levelled(s: Column) -> Column:
        n, direct, most = s["n"], s["direct"], s["confidence"]
        level = (
            F.when(n == 0, "none").when((direct >= 2) | (most >= 0.9), "strict").when((direct >= 1) | (most >= 0.8), "moderate").when((n >= 2) | (most >= 0.7), "mild").otherwise("weak")
        )
        return F.struct(n.alias("n"), direct.alias("direct"), most.alias("confidence"), level.alias("level"))

    return once(once(matches, counted), levelled)
