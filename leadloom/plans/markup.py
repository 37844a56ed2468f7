"""Pages as nodes: places of links, labels and groups of fields, telling places, icons, signs of bot checks, link rules and crawls."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from leadloom.functions import html, nodes, registry, urls
from leadloom.operators import forms, links, scoring, snapshots
from leadloom.sources import files
from leadloom.sources.derived import choose, fields, with_sql
from leadloom.sources.views import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


# ---- pages as strings of tags, for the oracles
_BARE = "regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<(script|style)[^>]*>.*?</(script|style)>', '', 'gs')"
_TAGS = f"t as (select page_id, unnest(string_split({_BARE}, '<')) as piece, generate_subscripts(string_split({_BARE}, '<'), 1) as i from pages), g as (select *, lower(regexp_extract(piece, '^(/?[a-zA-Z][a-zA-Z0-9]*)', 1)) as tag from t)"


def _plain(c: str) -> str:
    for name, char in (("copy", "©"), ("middot", "·"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("nbsp", " "), ("amp", "&")):
        c = f"replace({c}, '&{name};', '{char}')"
    return f"trim(regexp_replace({c}, '[\\s ]+', ' ', 'g'))"


@query(
    f"""with {_TAGS},
w as (select *, last_value(case when regexp_matches(tag, '^h[1-6]$') then {_plain("substr(piece, strpos(piece, '>') + 1)")} end ignore nulls) over (partition by page_id order by i rows between unbounded preceding and 1 preceding) as heading,
  last_value(case when tag in ('nav', 'header', 'footer', 'main', 'article', 'section', 'aside', 'form') then tag when tag in ('/nav', '/header', '/footer', '/main', '/article', '/section', '/aside', '/form') then '' end ignore nulls) over (partition by page_id order by i) as region,
  last_value(case when tag in ('ul', 'ol', 'dl') then i when tag in ('/ul', '/ol', '/dl') then 0 end ignore nulls) over (partition by page_id order by i) as list from g),
n as (select page_id, list, count(*) filter (where tag = 'li') as items from w where list > 0 group by 1, 2)
select page_id, cast(row_number() over (partition by page_id order by i) - 1 as int) as dom_index, heading, nullif(region, '') as region, items as list_items
from w left join n using (page_id, list) where tag = 'a'"""
)
def link_places(spark, d):
    """page_id, dom_index, heading (the last one before the link), region and list_items (of the innermost region and list around it)."""
    known = files.written(nodes.node_table(table(spark, d, "pages"), "page_id", columns=("pre", "last", "tag", "text")), "nodes")
    heads = known.where(F.col("tag").isin(*nodes.HEADINGS))
    said = nodes.texts_of(heads, known, "page_id").select("page_id", "pre", "said")
    marked = known.where(F.col("tag").isin("a", *nodes.HEADINGS)).select("page_id", "pre", "tag").join(said, ["page_id", "pre"], "left")
    placed = marked.select("page_id", "pre", "tag", nodes.last_before(marked, "page_id", F.when(F.col("tag") != "a", F.coalesce("said", F.lit("")))).alias("heading")).where("tag = 'a'").drop("tag")
    anchors = known.where("tag = 'a'").select("page_id", "pre")
    region = nodes.nearest_around(anchors, known.where(F.col("tag").isin(*nodes.REGIONS)).select("page_id", "pre", "last", "tag"), "page_id", "tag").toDF("page_id", "pre", "region")
    lists = known.where(F.col("tag").isin(*nodes.LISTS)).select("page_id", "pre", "last")
    items = nodes.nearest_around(known.where("tag = 'li'").select("page_id", "pre"), lists, "page_id", "pre").toDF("page_id", "item", "list").groupBy("page_id", "list").agg(F.count("*").alias("list_items"))
    of = nodes.nearest_around(anchors, lists, "page_id", "pre").toDF("page_id", "pre", "list").join(items, ["page_id", "list"], "left").drop("list")
    both = placed.join(region, ["page_id", "pre"], "left").join(of, ["page_id", "pre"], "left")
    order = Window.partitionBy("page_id").orderBy("pre")
    return both.select("page_id", (F.row_number().over(order) - 1).alias("dom_index"), "heading", "region", "list_items")


_INSIDE = "regexp_extract({0}, '<{1}[^>]*>(.*?)</{1}>', 1, 's')"
_WORDS = "array_to_string(list_filter(list_transform(string_split(regexp_replace({0}, '<[^>]*>', chr(1), 'g'), chr(1)), lambda x: " + _plain("x") + "), lambda x: x <> ''), ' ')"


@query(
    f"""with b as (select page_id, {_BARE} as b from pages),
p as (select page_id, list_concat([{_WORDS.format(_INSIDE.format('b', 'footer'))}, {_WORDS.format(_INSIDE.format('b', 'nav'))}, {_WORDS.format(_INSIDE.format('b', 'h1'))}], list_transform(regexp_extract_all(b, '<li[^>]*>(.*?)</li>', 1, 's'), lambda y: {_WORDS.format('y')})) as parts from b),
s as (select page_id, array_to_string(list_filter(parts, lambda x: length(x) >= 10), ' ') as s from p)
select page_id, length(s) as n, md5(s) as digest from s"""
)
def telling_places(spark, d):
    """page_id, n, digest of the text of the places where notices stand."""
    said = table(spark, d, "pages").select("page_id", html.page(F.col("html"))["targeted"].alias("s"))
    return said.select("page_id", F.length("s").alias("n"), F.md5("s").alias("digest"))


# ---- forms as markup: every field in one of four layouts, three fields a group
_CONTROL = "concat('<', tag, ' name=\"', name, '\"', case when pos % 4 = 1 then concat(' id=\"f', cast(pos as varchar(9)), '\"') else '' end, ' type=\"', type, '\">', case when tag = 'input' then '' else concat('</', tag, '>') end)"
_FIELD = (
    f"case pos % 4 when 1 then concat('<p><label for=\"f', cast(pos as varchar(9)), '\">', label, '</label>', {_CONTROL}, '</p>') when 2 then concat('<label><b>', label, '</b> ', {_CONTROL}, '</label>') "
    f"when 3 then concat('<table><tr><th>', label, '<td>', {_CONTROL}, '</table>') else concat('<dl><dt>', label, '<dd>', {_CONTROL}, '</dl>') end"
)
_MARKUP = f"concat(case when pos % 3 = 1 then concat(case when pos > 1 then '</fieldset>' else '' end, '<fieldset><legend>', case when must then 'Required *' else 'Group' end, '</legend>') else '' end, {_FIELD})"


def _form_pages(spark, d):
    rows = fields(spark, d).select("form", F.struct("pos", F.expr(_MARKUP).alias("m")).alias("f"))
    grouped = rows.groupBy("form").agg(F.sort_array(F.collect_list("f")).alias("fs"))
    return grouped.select("form", F.concat(F.lit("<html><body><h1>Form</h1><form method=post>"), F.array_join("fs.m", ""), F.lit("</fieldset></form></body></html>")).alias("html"))


@query(with_sql("fields") + " select form, pos, nullif(label, '') as label, case when label <> '' then case pos % 4 when 1 then 'for' when 2 then 'around' when 3 then 'row' else 'term' end end as source from fields")
def field_labels(spark, d):
    """form, pos, label, source: the label of each field of a page's form, and where it stands."""
    known = nodes.node_table(_form_pages(spark, d), "form", columns=("pre", "tag", "label", "source"), tags=nodes.INPUTS)
    found = nodes.labels(known, "form")
    return found.select("form", F.row_number().over(Window.partitionBy("form").orderBy("pre")).alias("pos"), "label", "source")


@query(
    with_sql("fields") + """, g as (select *, (pos - 1) // 3 as part from fields), h as (select form, part, count(*) as n, bool_or(pos % 3 = 1 and must) as asked from g group by 1, 2)
select form, pos, cast(n as bigint) as group_size, asked as group_required from g join h using (form, part)"""
)
def field_groups(spark, d):
    """form, pos, group_size, group_required: of the group around each field, how many fields it has and whether its legend marks them as required."""
    found = nodes.groups(_form_pages(spark, d), "form")
    return found.select("form", "pos", F.col("size").alias("group_size"), F.coalesce(F.col("legends").rlike(r"必須|(?i)required|\*"), F.lit(False)).alias("group_required"))


_ICONS = (
    "concat('<div class=\"x md:w-[50%]\"><p><i class=\"material-icons\">home</i>Address</p><p>-</p><p>', c_name, '</p></div>', case when c_custkey % 3 = 0 then '' else concat('<div class=\"md:w-[50%]\"><p><i class=\"big material-icons\">call</i>Phone</p><p>', "
    "case when c_custkey % 3 = 1 then cast(c_custkey as varchar(20)) else '' end, '</p></div>') end)"
)


@query("select c_custkey, case c_custkey % 3 when 0 then ['home=' || c_name] when 1 then ['home=' || c_name, 'call=' || c_custkey] else ['home=' || c_name, 'call='] end as icons from customer")
def icon_values(spark, d):
    """c_custkey, icons: what stands beside the icons of a company's page."""
    page = html.page(F.expr(_ICONS))
    rows = table(spark, d, "customer").select("c_custkey", page["icons"].alias("i"))
    return rows.select("c_custkey", F.transform("i", lambda x: F.concat(x["icon"], F.lit("="), F.coalesce(x["value"], F.lit("")))).alias("icons"))


_BOTS = {
    "script": "case when event_id % 3 = 0 then '<script src=\"https://www.google.com/recaptcha/api.js\"></script>' else '' end",
    "frame": "case user_id % 4 when 0 then '<iframe src=\"https://x/recaptcha/api2/anchor?k=1\"></iframe>' when 1 then '<iframe src=\"https://x/recaptcha/b\"></iframe>' else '' end",
    "badge": "case cast(floor(value) as bigint) % 4 when 0 then '<div class=\"g-recaptcha\" data-sitekey=\"k\"></div>' when 1 then '<div class=\"grecaptcha-badge\"></div>' else '' end",
    "wall": "case when event_id % 5 = 0 then '<div id=\"cf-wrapper\">Cloudflare Checking your browser</div>' else '<p>hello</p>' end",
}
_TITLE = "case when user_id % 2 = 0 then 'Just a moment...' else 'Home' end"
_WHERE = "concat('https://s', cast(user_id as varchar(20)), '.example', case when event_id % 2 = 0 then '/cdn-cgi/challenge-platform/h' else '/x' end)"


@query(
    """with s as (select *, event_id % 3 = 0 as script, user_id % 4 in (0, 1) as frame, user_id % 4 = 0 as anchor, cast(floor(value) as bigint) % 4 in (0, 1) as badge, cast(floor(value) as bigint) % 4 = 0 as sitekey from events)
select event_id, case when (anchor and sitekey) or script::int + frame::int + badge::int >= 2 then 'reCAPTCHA' when event_id % 2 = 0 and user_id % 2 = 0 and event_id % 5 = 0 then 'Cloudflare Challenge' end as bot from s"""
)
def bot_pages(spark, d):
    """event_id, bot: the bot check that a page shows."""
    e = table(spark, d, "events").select("event_id", html.page(F.concat(*map(F.expr, _BOTS.values()))).alias("p"), F.expr(_TITLE).alias("title"), F.expr(_WHERE).alias("url"))
    return e.select("event_id", html.bot_check(F.col("p.signals"), F.col("title"), F.col("url"), F.col("p.text")).alias("bot"))


# ---- links: anchors of the pages, of which some are given the words, addresses and places of others
_ANCHORS = f"a as (select page_id, url, i, piece from (select page_id, url, unnest(string_split({_BARE}, '<')) as piece, generate_subscripts(string_split({_BARE}, '<'), 1) as i from pages) where regexp_matches(piece, '^a[\\s>]')), l as (select page_id, url, cast(row_number() over (partition by page_id order by i) - 1 as int) as dom_index, regexp_extract(piece, 'href=\"([^\"]*)\"', 1) as href, {_plain("substr(piece, strpos(piece, '>') + 1)")} as text from a)"
_SAYS = choose("page_id + dom_index", (None, None, "お問い合わせ", "Document request", "採用情報", "採用のお問い合わせ", "Leave a Reply", "Support", None, "wp-comment form", "job offers", "無料相談", "", "Newsletter signup contact", "資料請求", None))
_GOES = choose("page_id * 3 + dom_index", (None, None, "/contact", "/document-request", "/post#comment-5", "/post#commentary", "/blog/comments/3", "/recruit", "/a.pdf", "mailto:a@b.example", "https://other.example/x", "/inquiry?x=1", "", "tel:03", None, "https://www.th.example.com/Form"))
_LINK_RULES = {
    "text": f"coalesce({_SAYS}, text)", "href": f"coalesce({_GOES}, href)", "title": choose("page_id + dom_index * 5", (None, "無料相談", "x")), "aria": choose("page_id + dom_index * 2", (None, "Quote", "")), "alt": "cast(null as varchar(9))",
    "id": choose("page_id + dom_index * 7", ("", "gnav-contact", "top", None)), "classes": choose("page_id * 2 + dom_index", ("", "navbar cta", "wp-comment", "link")), "parent": choose("dom_index", ("li", "footer", "main", "nav", "p")),
    "parent_classes": choose("page_id + dom_index", (None, "mail-btn", "x")),
}
_LINKS = f"{_ANCHORS}, k as (select page_id, url, dom_index, " + ", ".join(f"{e} as {c}" for c, e in _LINK_RULES.items()) + " from l)"


def _ranked(c: str) -> str:
    t = f"lower(trim(coalesce({c}, '')))"
    return f"""greatest(0, case
    when regexp_matches({t}, 'お問い合わせ|お問合せ|御問合せ|問い合わせ|問合わせ|お問い合せ|問合せ|お問合わせ|toiawase|といあわせ|contact|連絡|kontakt|聯絡我們|联系我们') then 300
    when regexp_matches({t}, '相談|そうだん|コンタクト|依頼|いらい|get in touch|reach out|お客様窓口|営業窓口|商談|打ち合わせ|うちあわせ|consult|コンサル|ミーティング|meeting|面談|デモ|demo|トライアル|trial|無料体験|導入検討') then 200
    when regexp_matches({t}, '資料請求|見積|みつもり|request|quote|estimate|りょうきん|資料ダウンロード|パンフレット|カタログ|rfp|詳細を聞く|詳しく聞く|inquiry form|business inquiry') then 100
    when regexp_matches({t}, 'サポート|ヘルプ|質問|しつもん|support|help|question|inquiry|フィードバック|feedback|ご意見|ご要望|いけん|ようぼう|アンケート|survey|申し込み|もうしこみ|apply|application') then 50 else 0 end
    - case when regexp_matches({t}, '採用|求人|応募|recruit|career|プライバシーポリシー|privacy policy|サイトマップ|会員登録|registration|sign up|メールマガジン|メルマガ|newsletter|ダウンロード|download|ログイン|login|sign in|パスワード|password') then 100 else 0 end)"""


_SITE = "replace(lower(regexp_extract({0}, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1)), 'www.', '')"
_LINK_SCORE = f"""case when trim(coalesce(href, '')) = '' then -1000 else {_ranked('text')} + {_ranked('alt')} + {_ranked('aria')} + {_ranked('title')}
  + case when regexp_matches(lower(href), '/contact|/inquiry|/form|/mail|/support|/ask|/toiawase|/help|/question|/consult|/demo|/trial|/meeting|/appointment|/estimate|/quote|/business-inquiry|/sales-contact') then 150 else 0 end
  - case when regexp_matches(lower(trim(href)), '\\.(?:pdf|jpg|jpeg|png|gif|bmp|svg|zip|rar|tar|gz|docx|xlsx|csv)$') then 200 else 0 end - case when regexp_matches(lower(trim(href)), '^(?:tel:|mailto:|javascript:|#)') then 500 else 0 end
  - case when {_SITE.format('href')} <> '' and {_SITE.format('href')} <> {_SITE.format('url')} and not ends_with({_SITE.format('href')}, concat('.', {_SITE.format('url')})) then 50 else 0 end
  + case when regexp_matches(concat(lower(coalesce(id, '')), chr(10), lower(classes)), 'contact|inquiry|form|cta|consult|demo|trial|estimate|quote') then 100 else 0 end + case when regexp_matches(lower(coalesce(id, '')), 'menu|nav|header|footer') then 100 else 0 end
  + case when regexp_matches(lower(classes), 'menu|nav|header|footer|dropdown|hamburger|sidebar') then 80 else 0 end
  + case when regexp_matches(lower(coalesce(parent_classes, '')), 'mail|contact|inquiry|toiawase|cta|call-to-action|consultation|demo|trial|form-wrapper|form-container') then 150 else 0 end
  + case when parent in ('header', 'footer', 'nav') then 50 when parent = 'main' then 20 else 0 end end"""
_LINK_SAID = "concat_ws(' ', lower(coalesce(text, '')), lower(coalesce(title, '')), lower(coalesce(aria, '')), '', lower(coalesce(href, '')))"
_LINK_OUT = f"""case when regexp_matches(regexp_extract(lower(href), '#(.*)$', 1), '^(?:comment|comments|respond)(?:[-_].+|\\d.*)?$')
  or regexp_matches(regexp_extract(regexp_replace(lower(href), '[?#].*$', ''), '^(?:[a-z][a-z0-9+.-]*:)?(?://[^/]*)?(.*)$', 1), '(^|/)comments?(/|$)')
  or regexp_matches({_LINK_SAID}, '(?:^|[\\s\\W_])(?:comment-form|commentform|wp-comment|wp-comments)(?:$|[\\s\\W_])|leave a reply|post comment|コメントを送信|コメント投稿|コメントする') then true
  when regexp_matches({_LINK_SAID}, 'お問い合わせ|お問合せ|問い合わせ|contact|inquiry|ご相談|連絡') then false else regexp_matches({_LINK_SAID}, '採用|求人|応募|募集|エントリー|recruit|career|job|employment') end"""


def _links(spark, d):
    found = table(spark, d, "pages").select("page_id", "url", F.posexplode(html.links(F.col("html"))).alias("dom_index", "l")).select("page_id", "url", "dom_index", "l.href", "l.text")
    return found.select("page_id", "url", "dom_index", F.struct(*[F.expr(e).alias(c) for c, e in _LINK_RULES.items()]).alias("link"))


def _scored(spark, d):
    return _links(spark, d).withColumn("score", links.score(F.col("link"), F.col("url")))


@query(f"with {_LINKS} select page_id, dom_index, {_LINK_SCORE} as score from k")
def link_score(spark, d):
    return _scored(spark, d).select("page_id", "dom_index", "score")


@query(f"with {_LINKS}, s as (select page_id, dom_index, {_LINK_SCORE} as score from k) select *, cast(row_number() over (partition by page_id order by score desc, dom_index) as int) as rank from s qualify rank <= 3")
def link_top_per_page(spark, d):
    return scoring.ranked_links(_scored(spark, d)).select("page_id", "dom_index", "score", "rank")


@query(f"with {_LINKS} select page_id, dom_index, {_LINK_OUT} as excluded from k")
def link_exclusion(spark, d):
    return _links(spark, d).select("page_id", "dom_index", links.excluded(F.col("link")).alias("excluded"))


@query(
    f"""with {_LINKS}, s as (select page_id, dom_index, text, href, {_LINK_SCORE} - 400 as score from k), g as (select distinct page_id from s where score >= 100)
select page_id, dom_index, score from s where score >= 100 union all select page_id, dom_index, 600 from s where page_id not in (select page_id from g)
  and regexp_matches(concat_ws(' ', lower(text), lower(href)), 'お問い合わせ|お問合せ|問い合わせ|toiawase|contact|inquiry')
  and not regexp_matches(concat_ws(' ', lower(text), lower(href)), '採用|求人|応募|recruit|career|privacy policy|サイトマップ|newsletter|download|ダウンロード|login|ログイン|password|パスワード')"""
)
def link_fallback(spark, d):
    """page_id, dom_index, score: the good links of a page (here 400 points are taken off all), or those that name contact at a high score."""
    rows = _scored(spark, d).select("page_id", "dom_index", "link.text", "link.href", (F.col("score") - 400).alias("score"))
    return scoring.boosted(rows).select("page_id", "dom_index", "score")


# ---- crawls: the pages of a host in their order, and each link leads to another of them
_CRAWL = f"""{_LINKS}, s as (select page_id, dom_index, {_LINK_SCORE} as score from k),
n as (select page_id, {_SITE.format('url')} as site, row_number() over (partition by {_SITE.format('url')} order by page_id) - 1 as r, count(*) over (partition by {_SITE.format('url')}) as n from pages),
e as (select site, r as page, (r * 5 + dom_index * 3 + page_id) % n as target, score, dom_index from s join n using (page_id) where score >= 100)"""


@query(
    f"""with recursive {_CRAWL}, c as (
  select site, 0 as step, [0::bigint] as seen, 0 as score from (select distinct site from n)
  union all
  select c.site, c.step + 1, list_append(c.seen, b.best.target), b.best.score from c, lateral (
    select max(struct_pack(score := e.score, a := -list_position(c.seen, e.page), d := -e.dom_index, target := e.target)) as best from e where e.site = c.site and list_contains(c.seen, e.page) and not list_contains(c.seen, e.target)
  ) b where c.step < 4 and b.best is not null
)
select site, step, seen[-1] as page, score from c"""
)
def crawl_order(spark, d):
    """site, step, page, score: the visits of a best-first crawl over the links between a host's pages."""
    site = F.regexp_replace(urls.host(F.col("url")), r"www\.", "")
    hosts = Window.partitionBy("site")
    ranked = table(spark, d, "pages").select("page_id", site.alias("site")).select(
        "page_id", "site", (F.row_number().over(hosts.orderBy("page_id")) - 1).cast("long").alias("r"), F.count("*").over(hosts).alias("n")
    )
    found = _scored(spark, d).join(ranked, "page_id")
    target = (F.col("r") * 5 + F.col("dom_index") * 3 + F.col("page_id")) % F.col("n")
    known = found.select("site", F.col("r").alias("page"), target.alias("url"), "score", "dom_index")
    start = ranked.select("site", F.lit(0).cast("long").alias("url")).distinct()
    return scoring.crawl(start, known, rounds=4).select("site", "step", F.col("url").alias("page"), "score")


# ---- a form before and after it was sent: what stands on both pages follows from the order
_N = "cast(o_orderkey % 5 + 1 as int)"
_AFTER_N = f"case o_custkey % 4 when 1 then 0 when 2 then cast(floor({_N} / 2.0) as int) else {_N} end"
_MESSAGES = ("", "", "<p>送信が完了しました</p>", "<h2>Thank you all</h2>", '<div class="message status">ok</div>', '<div class="success">fine</div>', "", "<p>ようこそ</p>", '<div class="result thanks">承りました</div>')
_MESSAGE, _KEPT_MESSAGE = choose("o_orderkey + o_custkey", _MESSAGES), "o_custkey % 6 = 0"
_OFF, _SEEN, _CLEAR = "o_orderkey % 7 = 2", "o_orderkey % 3 <> 0", "o_custkey % 3 = 0"
_TITLE_AFTER = choose("o_custkey", ("Form", "Form", "送信完了", "Error", "News"))
_URL_AFTER = choose("o_orderkey * 3 + o_custkey", ("https://a.example/f", "https://a.example/f", "https://a.example/f", "https://a.example/thanks", "https://b.example/f", "https://a.example/f?error=1", "https://a.example/x"))


def _snapshots(spark, d):
    # dealt as numbers: pages are built and read in as many tasks as an exchange has, however few row groups the file has
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey").repartition(parts, "o_orderkey").select("o_orderkey", *[F.expr(e).alias(n) for n, e in {
        "n": _N, "m": _AFTER_N, "message": _MESSAGE, "kept": _KEPT_MESSAGE, "off": _OFF, "seen": _SEEN, "clear": _CLEAR, "title": _TITLE_AFTER, "url_after": _URL_AFTER, "gone": "o_custkey % 4 = 1",
    }.items()])

    def inputs(n, value):
        return F.array_join(F.transform(F.filter(F.sequence(F.lit(1), F.lit(5)), lambda k: k <= n), lambda k: F.concat(F.lit('<input name="f'), k.cast("string"), F.lit('" value="'), value, F.lit('">'))), "")

    head = lambda title: F.concat(F.lit("<html><head><title>"), title, F.lit("</title></head><body>"))
    message = F.when(F.col("kept"), F.col("message")).otherwise("")
    before = F.concat(head(F.lit("Form")), F.lit("<form>"), message, inputs(F.col("n"), F.lit("v")), F.lit('<button type="submit" id="b">Go</button></form></body></html>'))
    button = F.concat(F.lit('<button type="submit" id="b"'), F.when(F.col("seen"), "").otherwise(' style="display: none"'), F.when(F.col("off"), " disabled").otherwise(""), F.lit(">Go</button>"))
    form = F.concat(F.lit("<form>"), F.col("message"), inputs(F.col("m"), F.when(F.col("clear"), "").otherwise("v")), button, F.lit("</form>"))
    after = F.concat(head(F.col("title")), F.when(F.col("gone"), F.col("message")).otherwise(form), F.lit("</body></html>"))
    return rows.select("o_orderkey", F.lit("https://a.example/f").alias("url_before"), "url_after", before.alias("before"), after.alias("after"))


@query(
    f"""with o as (select o_orderkey, {_N} as n, {_AFTER_N} as m, (o_orderkey + o_custkey) % 9 as k, {_KEPT_MESSAGE} as kept, {_OFF} as off, {_SEEN} as seen, {_CLEAR} as clear, {_TITLE_AFTER} as title, {_URL_AFTER} as url, o_custkey % 4 = 1 as gone from orders),
w as (select *, case k when 2 then 1 when 3 then 1 when 8 then 1 else 0 end as said, not gone and not kept and k in (5, 8) as sibling, not gone and not seen as no_button, not gone and off as disabled from o),
j as (
  select *, case when url <> 'https://a.example/f' then 1 when said > 0 then 2 when gone then 3 when m < 0.5 * n then 3 when no_button then 3 when sibling then 4 when disabled then 4 else 6 end as stage,
    case when url <> 'https://a.example/f' then case when contains(url, 'thank') then 0.95 when contains(url, 'b.example') then 0.85 else 0.9 end when said > 0 then 0.90 when gone then 0.85 when m < 0.5 * n then least(0.83, 0.75 + 0.1 * (1 - m / n))
      when no_button then 0.78 when sibling then 0.78 when disabled then 0.75 else 0.65 end as confidence,
    -- every node with a change in it is another one: the title and what holds it, the message, inputs, the button, and what holds these
    title <> 'Form' as new_title, not kept and k not in (0, 1, 6) as new_message
  from w
)
select o_orderkey, true as success, round(confidence, 6) as confidence, stage, case
  when gone then true when new_title and (clear or m < n or new_message or off or not seen) then true
  when 2 * (case when clear then m else 0 end) + (n - m) + case when new_title then 6 else 0 end + case when off or not seen then 2 else 0 end + case when not new_message then 0 when k in (2, 7, 3, 4, 5, 8) then 2 else 0 end
    + case when clear and m > 0 or m < n or off or not seen or new_message then 4 else 0 end + case when new_title or clear and m > 0 or m < n or off or not seen or new_message then 2 else 0 end >= 5 then true
  when off or (m > 0 and clear) then true when new_title and title = '送信完了' then true when new_title and title = 'Error' then false
  when contains(url, '/thanks') then true when contains(url, 'error=1') then false end as state from j"""
)
def sent_forms(spark, d):
    """o_orderkey, success, confidence, stage, state: forms before and after they were sent, by what both pages show."""
    return snapshots.judged(_snapshots(spark, d), "o_orderkey")


# ---- SQL alone
@query(
    f"""with {_ANCHORS} select page_id, {_SITE.format('url').replace("replace(", "", 1).replace(", 'www.', '')", "")} as host, dom_index, href, concat(left(text, 1), repeat('*', length(text) - 2), right(text, 1)) as masked
from l where length(text) > 2"""
)
def links_by_sql(spark, d):
    """page_id, host, dom_index, href, masked: links by a query that is SQL alone."""
    registry.register(spark)
    said = "select p.page_id, url_host(p.url) as host, l.dom_index, l.href, mask_edges(l.text) as masked from {pages} p, lateral page_links(p.html) l where length(l.text) > 2"
    return spark.sql(said, pages=table(spark, d, "pages"))


@query(f"with {_TAGS} select tag, count(*) as n, count(distinct page_id) as pages from g where regexp_matches(tag, '^[a-z]') and tag not in ('script', 'style') group by 1")
def nodes_by_sql(spark, d):
    """tag, n, pages: elements of the pages by kind, by a query that is SQL alone."""
    registry.register(spark)
    said = "select tag, count(*) as n, count(distinct page_id) as pages from {pages} p, lateral page_nodes(p.html) where tag not in ('#text', 'script', 'style') group by tag"
    return spark.sql(said, pages=table(spark, d, "pages"))


# ---- forms of pages: the fields of an order, a heading and a button
_INPUT = (
    "concat('<', tag, ' name=\"', name, '\" id=\"', ident, '\"', case when tag = 'input' then concat(' type=\"', type, '\"') else '' end, case when placeholder is null then '' else concat(' placeholder=\"', placeholder, '\"') end, '>', "
    "case when tag = 'input' then '' else concat('</', tag, '>') end)"
)
_HEADING = choose("form", ("", "Contact us", "Newsletter", "採用のご案内", "Hello", "", "お問い合わせ"))
_SEND = choose("form * 3", ("Send", "送信", "Search", "ログイン", "OK", "Post comment", "Send mail"))
_HAS_BUTTON = "form % 9 <> 4"
_FORM_INSIDE = f"concat('<h2>', {_HEADING}, '</h2>', {{0}}, case when {_HAS_BUTTON} then concat('<button>', {_SEND}, '</button>') else '' end)"
_FORM_LIST = with_sql("fields") + f", i as (select form, string_agg({_INPUT}, '' order by pos) as inputs from fields group by 1)"


def _page_forms(spark, d):
    rows = fields(spark, d).select("form", F.struct("pos", F.expr(_INPUT).alias("m")).alias("f")).groupBy("form").agg(F.array_join(F.sort_array(F.collect_list("f"))["m"], "").alias("inputs"))
    inside = F.expr(_FORM_INSIDE.format("inputs"))
    return rows.select(F.col("form").alias("page_id"), F.concat(F.lit("<html><body><p>A page</p><form method=post>"), inside, F.lit("</form></body></html>")).alias("html"))


@query(_FORM_LIST + f" select form as page_id, length(m) as n, md5(m) as digest from (select form, {_FORM_INSIDE.format('inputs')} as m from i)")
def form_markup(spark, d):
    """page_id, n, digest of what stands inside the form of a page."""
    return _page_forms(spark, d).select("page_id", html.form_markup(F.col("html")).alias("m")).select("page_id", F.length("m").alias("n"), F.md5("m").alias("digest"))


_KINDS_SQL = with_sql("fields") + f""", e as (select form, tag, lower(concat_ws(' ', name, ident, type, placeholder)) as s from fields),
g as (select form, count(*) as n, lower(case when {_HAS_BUTTON} then {_SEND} else '' end) as b, lower(concat_ws(' ', nullif({_HEADING}, ''), case when {_HAS_BUTTON} then {_SEND} end)) as t, {_HAS_BUTTON} as sends,
  bool_or(regexp_matches(s, 'search|検索')) as searches, bool_or(regexp_matches(s, 'login|password|ログイン|パスワード')) as logs_in, bool_or(regexp_matches(s, 'newsletter|メルマガ|subscribe')) as news, bool_or(regexp_matches(s, 'comment.?form|post comment|コメント')) as comments,
  bool_or(regexp_matches(s, 'e?-?mail|メール') or tag = 'textarea') as contacts from e group by 1),
k as (select form, n, sends, case when n <= 2 and (searches or regexp_matches(b, 'search|検索')) then 'search' when logs_in or regexp_matches(b, 'login|password|ログイン|パスワード') then 'auth'
  when n <= 2 and (news or regexp_matches(t, 'newsletter|メルマガ|subscribe')) then 'newsletter' when regexp_matches(t, 'recruit|career|採用|応募|エントリー') then 'recruitment'
  when comments or regexp_matches(b, 'comment.?form|post comment|コメント') then 'comment' when contacts or regexp_matches(b, 'e?-?mail|メール') then 'contact' else 'other' end as kind from g)"""


@query(_KINDS_SQL + " select form as page_id, 0 as form_index, kind, kind = 'contact' and sends as usable from k")
def form_quality(spark, d):
    """page_id, form_index, kind, usable of the forms of pages."""
    rows = _page_forms(spark, d).select("page_id", F.posexplode(html.forms(F.col("html"))).alias("form_index", "form"))
    return rows.select("page_id", "form_index", forms.form_kind(F.col("form")).alias("kind"), forms.usable(F.col("form")).alias("usable"))


@query(_KINDS_SQL + " select form as page_id, 0 as form_index, cast(n as int) as n_inputs from k where kind = 'contact' and sends")
def form_top1(spark, d):
    """page_id, form_index, n_inputs of the best form of each page."""
    return forms.best_forms(_page_forms(spark, d), html.forms(F.col("html"))).select("page_id", "form_index", F.size("form.inputs").alias("n_inputs"))


_NAMED = (
    ("email", "e?-?mail|メール", "'email', 'text'"), ("message", "message|body|content|inquiry|comment|本文|内容|お問い合わせ", "'textarea'"), ("company", "company|corp|organization|会社|企業|貴社", "'text'"),
    ("last_name", "last.?name|family|姓|sei", "'text'"), ("first_name", "first.?name|given|mei\\b|(?:^|[^氏])名$", "'text'"), ("full_name", "^name$|your.?name|full.?name|氏名|お名前", "'text'"),
    ("phone", "tel|phone|電話", "'tel', 'text', 'number'"), ("postal", "zip|postal|郵便", "'text', 'tel', 'number'"), ("address", "address|住所", "'text'"), ("subject", "subject|title|件名", "'text'"),
)


def _fits(name: str, words: str, kinds: str) -> str:
    return (
        f"greatest(0, case when regexp_matches(a, '{words}') then 60 else 0 end + case when regexp_matches(h, '{words}') then 40 else 0 end + case when type in ({kinds}) then 50 else -200 end "
        f"+ case when type = '{name}' then 50 else 0 end)"
    )


def _next_taken(step: int, name: str, words: str, kinds: str) -> str:
    free = f"not exists (select 1 from t{step - 1} t where t.form = u.form and t.pos = u.pos)"
    best = f"select form, '{name}' as field, pos, {_fits(name, words, kinds)} as score from u where {_fits(name, words, kinds)} >= 60 and {free} qualify row_number() over (partition by form order by score desc, pos) = 1"
    return f"t{step} as (select * from t{step - 1} union all {best})"


@query(
    _KINDS_SQL + ", u as (select form, pos, type, lower(concat_ws(' ', name, ident)) as a, lower(coalesce(placeholder, '')) as h from fields join (select form from k where kind = 'contact' and sends) using (form)), "
    "t0 as (select 0::bigint as form, '' as field, 0 as pos, 0 as score where false), " + ", ".join(_next_taken(k, *x) for k, x in enumerate(_NAMED, 1))
    + " select form as page_id, field, pos - 1 as element, score from t10"
)
def field_mapping(spark, d):
    """page_id, field, element, score: which input of the best form of a page takes which value."""
    return forms.assign_fields(forms.element_scores(forms.best_forms(_page_forms(spark, d), html.forms(F.col("html")))))
