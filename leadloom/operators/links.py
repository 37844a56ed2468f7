"""Links of a page: which are left out, and how well they name a contact page, with all that is known about a link."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom.functions import urls

# fixed values: links to comments: phrases, names with borders around them, and parts of the address
COMMENT_PHRASES = r"leave a reply|post comment|コメントを送信|コメント投稿|コメントする"
COMMENT_NAMES = r"(?:^|[\s\W_])(?:comment-form|commentform|wp-comment|wp-comments)(?:$|[\s\W_])"
COMMENT_FRAGMENT, COMMENT_PATH = r"^(?:comment|comments|respond)(?:[-_].+|\d.*)?$", r"(^|/)comments?(/|$)"
# fixed values: words that allow a link in spite of recruitment, and those of recruitment
GENERAL = r"お問い合わせ|お問合せ|問い合わせ|contact|inquiry|ご相談|連絡"
RECRUITMENT = r"採用|求人|応募|募集|エントリー|recruit|career|job|employment"
# fixed values: words of texts by rank (each also stands for longer ones that hold it), their scores, and what counts against a link
RANKS = [
    (300, r"お問い合わせ|お問合せ|御問合せ|問い合わせ|問合わせ|お問い合せ|問合せ|お問合わせ|toiawase|といあわせ|contact|連絡|kontakt|聯絡我們|联系我们"),
    (200, r"相談|そうだん|コンタクト|依頼|いらい|get in touch|reach out|お客様窓口|営業窓口|商談|打ち合わせ|うちあわせ|consult|コンサル|ミーティング|meeting|面談|デモ|demo|トライアル|trial|無料体験|導入検討"),
    (100, r"資料請求|見積|みつもり|request|quote|estimate|りょうきん|資料ダウンロード|パンフレット|カタログ|rfp|詳細を聞く|詳しく聞く|inquiry form|business inquiry"),
    (50, r"サポート|ヘルプ|質問|しつもん|support|help|question|inquiry|フィードバック|feedback|ご意見|ご要望|いけん|ようぼう|アンケート|survey|申し込み|もうしこみ|apply|application"),
]
AGAINST = r"採用|求人|応募|recruit|career|プライバシーポリシー|privacy policy|サイトマップ|会員登録|registration|sign up|メールマガジン|メルマガ|newsletter|ダウンロード|download|ログイン|login|sign in|パスワード|password"
# fixed values: addresses, attributes and places that speak for a link, and endings and schemes that speak against it
GOOD_URL = r"/contact|/inquiry|/form|/mail|/support|/ask|/toiawase|/help|/question|/consult|/demo|/trial|/meeting|/appointment|/estimate|/quote|/business-inquiry|/sales-contact"
BAD_END, BAD_START = r"\.(?:pdf|jpg|jpeg|png|gif|bmp|svg|zip|rar|tar|gz|docx|xlsx|csv)$", r"^(?:tel:|mailto:|javascript:|#)"
GOOD_NAME = r"contact|inquiry|form|cta|consult|demo|trial|estimate|quote"
NAV_ID, NAV_CLASS = r"menu|nav|header|footer", r"menu|nav|header|footer|dropdown|hamburger|sidebar"
GOOD_PARENT = r"mail|contact|inquiry|toiawase|cta|call-to-action|consultation|demo|trial|form-wrapper|form-container"


def _low(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit("")))


def excluded(link: Column) -> Column:
    """Comment links first; then links of recruitment, unless they name general contact. link: a struct of text, title, aria, alt, href."""
    href = _low(link["href"])
    said = F.concat_ws(" ", *[_low(link[k]) for k in ("text", "title", "aria", "alt", "href")])
    fragment = F.regexp_extract(href, r"#(.*)$", 1)
    path = F.regexp_extract(F.regexp_replace(href, r"[?#].*$", ""), r"^(?:[a-z][a-z0-9+.-]*:)?(?://[^/]*)?(.*)$", 1)
    comment = fragment.rlike(COMMENT_FRAGMENT) | path.rlike(COMMENT_PATH) | said.rlike(COMMENT_NAMES) | said.rlike(COMMENT_PHRASES)
    return F.when(comment, True).when(said.rlike(GENERAL), False).otherwise(said.rlike(RECRUITMENT))


def text_score(c: Column) -> Column:
    """The first rank of the text, less 100 for what counts against it, not below 0."""
    t = _low(c)
    rank = reduce(lambda acc, r: acc.when(t.rlike(r[1]), r[0]), RANKS[1:], F.when(t.rlike(RANKS[0][1]), RANKS[0][0])).otherwise(0)
    return F.greatest(F.lit(0), rank - F.when(t.rlike(AGAINST), 100).otherwise(0))


def score(link: Column, page_url: Column) -> Column:
    """Texts, address, id and class, navigation, the parent's class and its kind. link: a struct of text, title, aria, alt, href, id, classes, parent, parent_classes."""
    # as a variable: a filter on the score does not spell all rules out again
    return F.transform(F.array(F.struct(link.alias("link"), page_url.alias("url"))), lambda x: _score(x["link"], x["url"]))[0]


def _score(link: Column, page_url: Column) -> Column:
    href = F.trim(F.coalesce(link["href"], F.lit("")))
    low, ident, classes = F.lower(href), _low(link["id"]), _low(link["classes"])
    add = lambda cond, n: F.when(cond, n).otherwise(0)
    total = (
        sum((text_score(F.trim(link[k])) for k in ("text", "alt", "aria", "title")), F.lit(0))
        + add(low.rlike(GOOD_URL), 150) - add(low.rlike(BAD_END), 200) - add(low.rlike(BAD_START), 500) - add(urls.external(href, page_url), 50)
        + add(ident.rlike(GOOD_NAME) | classes.rlike(GOOD_NAME), 100) + add(ident.rlike(NAV_ID), 100) + add(classes.rlike(NAV_CLASS), 80) + add(_low(link["parent_classes"]).rlike(GOOD_PARENT), 150)
        + add(_low(link["parent"]).isin("header", "footer", "nav"), 50) + add(_low(link["parent"]) == "main", 20)
    )
    return F.when(href == "", -1000).otherwise(total)
