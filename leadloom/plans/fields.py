"""Form fields, forms and clients: rules over the fields that the lines of orders give. The oracles state the rules by themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadloom.operators import elements, mapping, patterns, safeguards, scores
from leadloom.sources.derived import choose, clients, fields, with_sql
from leadloom.sources.views import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def _bounded(word: str) -> str:
    """A word between borders, on any line."""
    return rf"(?m)\b{word}\b|[_-]{word}[_-]|^{word}[_-]|[_-]{word}$"


_KEY = ("form", "pos")
_SAID = "lower(concat_ws(chr(10), name, ident, placeholder)) as v, lower(regexp_replace(classes, '\\s+', chr(10), 'g')) as k, lower(concat_ws(' ', name, ident, classes)) as n, replace(lower(coalesce(style, '')), ' ', '') as s"


# ---- one field
@query(
    with_sql("fields") + rf""", a as (select *, {_SAID} from fields) select form, pos,
  regexp_matches(v, '{_bounded("fax")}') or regexp_matches(k, '{_bounded("fax")}') or regexp_matches(v, '{_bounded("kana")}') or regexp_matches(k, '(?m)^kana$')
    or contains(v, 'フリガナ') or regexp_matches(k, '(?m)^フリガナ$') or contains(v, 'confirmation') or contains(k, 'confirmation') as excluded,
  coalesce(visible, true) and not regexp_matches(n, 'honeypot|honey|trap|botfield|no-print|noprint|dummy')
    and not regexp_matches(s, 'display:none|visibility:hidden|pointer-events:none|z-index:-1|opacity:0*(?:\.0+)?(?:;|$)') and not (contains(s, 'position:absolute') and regexp_matches(s, 'left:-9999px|top:-9999px')) as candidate from a"""
)
def field_exclusion(spark, d):
    """Whether words of an attribute rule a field out, and whether it may be filled at all."""
    out = mapping.excluded(F.col("name"), F.col("ident"), F.col("classes"), F.col("placeholder"), ("fax", "kana", "フリガナ", "confirmation"))
    ok = mapping.candidate(F.col("name"), F.col("ident"), F.col("classes"), F.col("visible"), F.col("style"))
    return fields(spark, d).select(*_KEY, out.alias("excluded"), ok.alias("candidate"))


@query(
    with_sql("fields") + r""", a as (select *, concat_ws(' ', label, placeholder) as said from fields) select form, pos,
  coalesce(must, false) or coalesce(aria, '') = 'true' or regexp_matches(lower(classes), '(^|[\s_-])(required|require|must|hissu|mandatory)($|[\s_-])|必須')
    or (regexp_matches(said, '必須|required|mandatory|\*|＊|※|（必須）|\[必須\]') and not regexp_matches(said, '任意|optional|省略可|オプション')) as required from a"""
)
def field_required(spark, d):
    asked = mapping.required(F.col("must"), F.col("aria"), F.col("classes"), F.array("label", "placeholder"))
    return fields(spark, d).select(*_KEY, asked.alias("required"))


_ADDRESS, _PLACE = "住所|address|addr|street|city|prefecture|都道府県|市区町村", "p-region|p-locality|p-street-address|p-extended-address"
_TRIP, _KANA = "宿泊|ホテル|旅館|部屋|客室|レンタカー|旅程|便名|航空券|予約", "カナ|カタカナ|フリガナ|ふりがな|kana|katakana|furigana|セイ|メイ"


def _any(words: str) -> str:
    """In the attributes or in the label."""
    return f"regexp_matches(w, '{words.lower()}')"


@query(
    with_sql("fields") + rf""", a as (select *, lower(coalesce(type, '')) as t, lower(concat_ws(' ', coalesce(name, ''), coalesce(ident, ''), coalesce(classes, ''), coalesce(placeholder, ''))) as q, lower(coalesce(label, '')) as l from fields),
b as (select *, concat(q, chr(10), l) as w from a)
select form, pos, field, case
  when field = 'メールアドレス' then t = 'email' or {_any("e-?mail|mail|メール")}
  when field = '電話番号' then t = 'tel' or regexp_matches(q, 'tel|phone|電話|携帯') or (regexp_matches(l, '電話|tel|phone|携帯|mobile|cell') and not (regexp_matches(l, '時|午前|午後|連絡方法') or regexp_matches(q, 'timeno|h1|h2')))
  when field = '郵便番号' then (regexp_matches(q, 'zip|postal|postcode|郵便|〒|yubin|yuubin') or regexp_matches(l, '郵便|〒|postal|zip')) and not regexp_matches(q, 'captcha|image_auth|token|otp|verification|confirm|確認')
  when field = '都道府県' then regexp_matches(q, '都道府県|pref') or regexp_matches(l, '都道府県|prefecture')
  when field = 'お問い合わせ本文' then not {_any(_TRIP)} and (not {_any(_ADDRESS + "|" + _PLACE)} or {_any("お問い合わせ|メッセージ|本文|内容|message|inquiry|contact")})
  when field = '住所' then {_any(_ADDRESS + "|所在地|" + _PLACE)} and not {_any(_TRIP + "|旅行|出発|到着")} and not {_any(_KANA + "|hiragana|ひらがな|furi")} and not {_any("部署|部門|課|係|department|dept|division|section|team")}
    and not {_any("captcha|verification|token|otp|confirm|確認|認証|quiz|security|セキュリティ|文字を入力|次の文字|表示されている文字|上の文字")}
  when field = '会社名' then not {_any("カナ|フリガナ|ふりがな|hiragana|ひらがな|katakana|kana|セイ|メイ")} and not regexp_matches(l, 'お名前|氏名|姓名|full name|first name|given name|last name|family name')
  when field in ('姓', '名') then not {_any("会社名|法人名|団体名|組織名|企業名|会社")}
  when field = '件名' then {_any("件名|subject|題名")} and not {_any("フリガナ|ふりがな|カナ|kana|furigana|セイ|メイ")}
  when field = '役職' then {_any("役職|職位|position|job title|title|役割|ポジション")} and not regexp_matches(l, 'きっかけ|how did you hear|referrer')
  when field in ('統合氏名カナ', '姓カナ', '名カナ', '会社名カナ') then {_any(_KANA)} and not {_any("性別|sex|gender")}
  when field in ('姓ひらがな', '名ひらがな') then {_any("hiragana|ひらがな|ふりがな|フリガナ")} and not {_any("性別|sex|gender")}
  when field = '統合氏名' then not {_any(_ADDRESS + "|郵便|zip|postal|postcode")} and not {_any("会社名")}
  else true end as passes from b"""
)
def field_safeguards(spark, d):
    """Whether a field may take an element."""
    attrs = safeguards.attributes(F.col("name"), F.col("ident"), F.col("classes"), F.col("placeholder"))
    ok = safeguards.passes(F.col("field"), F.col("type"), attrs, F.lower(F.coalesce("label", F.lit(""))))
    return fields(spark, d).select(*_KEY, "field", ok.alias("passes"))


@query(
    with_sql("fields") + """, says(name_of, words) as (values ('メールアドレス', 'メール|e-?mail'), ('電話番号', '電話|tel|phone|携帯'), ('郵便番号', '郵便|〒|zip|postal'), ('住所', '住所|所在地|address'), ('会社名', '会社|企業|法人|company|organization'),
  ('部署名', '部署|部門|department'), ('役職', '役職|職位|position'), ('件名', '件名|題名|subject'), ('お問い合わせ本文', 'お問い合わせ|本文|内容|メッセージ|message|inquiry'), ('性別', '性別|gender|sex'), ('企業URL', 'url|ホームページ|サイト|website')),
h as (select form, pos, field, coalesce(bool_or(name_of = field and regexp_matches(lower(label), words)), false) as own, coalesce(bool_or(name_of <> field and regexp_matches(lower(label), words)), false) as other from fields, says group by 1, 2, 3)
select form, pos, own or not other as consistent from h"""
)
def field_consistency(spark, d):
    """The label names the field, or no field at all."""
    return fields(spark, d).select(*_KEY, safeguards.consistent(F.col("field"), F.col("label")).alias("consistent"))


RULES = [
    scores.Rule("メールアドレス", ("email",), ("input",), "mail", "メール|mail", ("confirm",)), scores.Rule("お問い合わせ本文", ("textarea",), ("textarea",), "message|body|inquiry", "内容|本文", ()),
    scores.Rule("姓カナ", ("text",), ("input",), "kana|sei", "セイ|フリガナ", ()), scores.Rule("会社名", ("text",), ("input",), "company|corp", "会社", ()),
]
_HIRA, _KATA = "hiragana|ひらがな", "katakana|ruby|カタカナ|ｶﾀｶﾅ|カナ|ｶﾅ|ルビ|るび|フリガナ|ふりがな"
_ANY_KANA = "kana|katakana|hiragana|furigana|ruby|ルビ|るび|ｶﾅ|ｶﾀｶﾅ|ﾌﾘｶﾞﾅ|カナ|カタカナ|フリガナ|ふりがな|ひらがな|読み|よみ"
_SCORED = with_sql("fields") + r""", a as (
  select *, concat_ws(' ', coalesce(name, ''), coalesce(ident, ''), coalesce(classes, ''), coalesce(placeholder, '')) as raw, lower(coalesce(label, '')) as l, replace(lower(coalesce(style, '')), ' ', '') as s from fields
), b as (
  select *, lower(raw) as q,
    case when visible then 0 else 200 end + case when enabled then 0 else 100 end + case when regexp_matches(s, 'display:none|visibility:hidden|pointer-events:none|opacity:0+(\.0+)?(;|$)') then 200 else 0 end
      + case when type = 'hidden' then 200 else 0 end + case when contains(s, 'position:absolute') and regexp_matches(s, 'height:1px|width:1px|overflow:hidden|left:-9999px|top:-9999px') then 200 else 0 end as cost,
    case when visible then 0 else 200 end + case when enabled then 0 else 100 end + case when type = 'hidden' then 200 else 0 end as quick_cost
  from a
)
"""


def _score_sql(types: str, tag: str, words: str, label: str, barred: str, extra: str = "0") -> str:
    """The points of a field against a rule. barred: what excludes it."""
    fit = lambda c, n: f"case when regexp_matches(lower(coalesce({c}, '')), '{words}') then {n} else 0 end"
    labelled = f"regexp_matches(l, '{label}')"
    kept = lambda e: f"case when {labelled} then floor(({e}) * 0.7) else {e} end"
    kind = f"case when type = '{types}' then 100 else 0 end"
    name, ident = fit("name", 60), fit("ident", 60)
    nothing = f"({name} + {ident} + {fit('placeholder', 40)} + case when {labelled} then 80 else 0 end) = 0"
    total = (
        f"({kept(kind)}) + ({kept(name)}) + ({kept(ident)}) + case when tag = '{tag}' then 50 else 0 end + {fit('placeholder', 40)} + {fit('classes', 30)} + case when {labelled} then 80 else 0 end + {extra}"
        f" - cost - case when type = 'text' and {nothing} then 40 else 0 end"
    )
    return f"cast(case when {barred} then -999 else greatest(0, {total}) end as int)"


_NOT_CONFIRM = f"regexp_matches(lower(concat_ws(chr(10), name, ident, placeholder)), '{_bounded('confirm')}|confirm') or contains(lower(classes), 'confirm') or contains(l, 'confirm')"
_MAIL = _score_sql("email", "input", "mail", "メール|mail", f"regexp_matches(q, '{_ANY_KANA}') or {_NOT_CONFIRM}")
_BODY = _score_sql("textarea", "textarea", "message|body|inquiry", "内容|本文", f"regexp_matches(q, '{_ANY_KANA}')", "case when tag = 'textarea' then 20 else 0 end")
_SEI = _score_sql("text", "input", "kana|sei", "セイ|フリガナ", f"(regexp_matches(q, '{_HIRA}') and not regexp_matches(q, '{_KATA}')) or (regexp_matches(raw, 'メイ|めい|名|mei|firstname') and not regexp_matches(raw, 'セイ|せい|姓|sei|lastname'))")
_CORP = _score_sql("text", "input", "company|corp", "会社", f"regexp_matches(q, '{_ANY_KANA}')")
_QUICK = (
    "cast(case when " + _NOT_CONFIRM.replace(" or contains(l, 'confirm')", "") + " then -999 else greatest(-999, case when type = 'email' then 100 else 0 end + case when tag = 'input' then 50 else 0 end + "
    + " + ".join(f"case when contains(lower(coalesce({c}, '')), 'mail') then {n} else 0 end" for c, n in (("name", 60), ("ident", 60), ("placeholder", 40), ("classes", 30))) + " - quick_cost) end as int)"
)


def _element():
    return F.struct(
        "tag", "type", "name", F.col("ident").alias("id"), "classes", "placeholder", "label", "style", "visible", "enabled", F.col("must").alias("required"),
    )


@query(_SCORED + f"select form, pos, {_MAIL} as mail, {_BODY} as message, {_SEI} as kana, {_CORP} as company, {_QUICK} as quick from b")
def field_scores(spark, d):
    """How well a field fits four rules, and by attributes alone the first of them."""
    rows = fields(spark, d).select(*_KEY, _element().alias("e"))
    made = [scores.element_score(F.col("e"), r).alias(n) for r, n in zip(RULES, ("mail", "message", "kana", "company"), strict=True)]
    return rows.select(*_KEY, *made, scores.quick_score(F.col("e"), RULES[0]).alias("quick"))


# ---- whole forms
def _forms(spark, d, **columns):
    """A row a form; each column holds one value of each field, in the order of the fields."""
    rows = fields(spark, d).select("form", F.struct("pos", *[c.alias(n) for n, c in columns.items()]).alias("f"))
    grouped = rows.groupBy("form").agg(F.sort_array(F.collect_list("f")).alias("fs"))  # a form has as many fields as its order has lines
    return grouped.select("form", *[F.col(f"fs.{n}").alias(n) for n in columns])


_SAFE_FOR = {
    "メールアドレス": _any("e-?mail|mail|メール") + " or type = 'email'", "お問い合わせ本文": f"not {_any(_TRIP)} and (not {_any(_ADDRESS + '|' + _PLACE)} or {_any('お問い合わせ|メッセージ|本文|内容|message|inquiry|contact')})",
    "会社名": f"not {_any('カナ|フリガナ|ふりがな|hiragana|ひらがな|katakana|kana|セイ|メイ')} and not regexp_matches(l, 'お名前|氏名|姓名|full name|first name|given name|last name|family name')",
}


def _taken(step: int, name: str, score: str, safe: str, rescue: bool) -> str:
    """The field takes the best element that is still free, if it takes one."""
    free = f"not exists (select 1 from t{step - 1} t where t.form = o.form and (t.pos = o.pos or t.field = '{name}'))"
    asked = f"must and {score} >= 1" if rescue else f"{score} >= 70"
    won = f"select form, '{name}' as field, pos, {score} as score, {str(rescue).lower()} as rescued, {step} as step from o where {asked} and ({safe}) and {free} qualify row_number() over (partition by form order by {score} desc, pos) = 1"
    return f"t{step} as (select * from t{step - 1} union all {won})"


_STEPS = [(n, f"s{k}", _SAFE_FOR[n], rescue) for rescue in (False, True) for k, n in enumerate(("メールアドレス", "お問い合わせ本文", "会社名"))]


@query(
    _SCORED + f", o as (select *, concat(q, chr(10), l) as w, {_MAIL} as s0, {_BODY} as s1, {_CORP} as s2 from b), "
    "t0 as (select 0::bigint as form, '' as field, 0 as pos, 0 as score, false as rescued, 0 as step where false), " + ", ".join(_taken(k, *x) for k, x in enumerate(_STEPS, 1))
    + " select form, field, pos, score, rescued from t6"
)
def form_assignment(spark, d):
    """form, field, pos, score, rescued: which element of a form a field takes."""
    rows = fields(spark, d).select(*_KEY, _element().alias("e"))
    taken = scores.assigned_rows(rows, [RULES[0], RULES[1], RULES[3]])
    return taken.select("form", "a.field", (F.col("a.element") + 1).alias("pos"), "a.score", "a.rescued")


@query(
    with_sql("fields") + """, n as (select form, count(*) as all_fields, count(*) filter (where score >= 90) as assigned, list(distinct field) filter (where must) as needed, list(distinct field) filter (where score >= 90) as done from fields group by 1)
select form, cast(assigned as int) as assigned, cast(round_even(1000.0 * assigned / all_fields, 0) / 10 as double) as coverage_pct, cast(coalesce(len(needed), 0) as int) as required, cast(coalesce(len(list_intersect(needed, done)), 0) as int) as required_done from n"""
)
def form_summary(spark, d):
    """What of a form is mapped: the fields of a score of 90 or more stand for those that were assigned."""
    one = _forms(spark, d, field=F.col("field"), score=F.col("score"), must=F.col("must"))
    pairs = F.arrays_zip("field", "score", "must")
    done = F.transform(F.filter(pairs, lambda f: f["score"] >= 90), lambda f: F.struct(f["field"].alias("field"), F.lit("v").alias("value"), f["score"].alias("score"), F.lit(False).alias("confirm")))
    needed = F.array_distinct(F.transform(F.filter(pairs, lambda f: f["must"]), lambda f: f["field"]))
    found = one.select("form", mapping.summary(done, F.size("field"), needed).alias("s"))
    return found.select("form", "s.assigned", "s.coverage_pct", "s.required", "s.required_done")


_PHONES = ("電話番号", "電話1", "電話2", "電話3")
_ASSIGNED_FIELD = choose("l_partkey + l_linenumber", ("姓", "統合氏名", "電話番号", "電話1", "電話2", "メールアドレス", "auto_email_confirm", "名", "件名", "郵便番号1", "郵便番号2"))
_ASSIGNED_VALUE = choose("l_suppkey", ("山田", "03", "1234", "a@b", "林", "", "　", "山田", "a@b", None))
_ASSIGNED = f"select l_orderkey as form, l_linenumber as line, l_partkey as part, l_suppkey as supp, {_ASSIGNED_FIELD} as field, {_ASSIGNED_VALUE} as value, cast(80 + l_partkey % 4 as int) as score from lineitem"
_RANK = {
    "メールアドレス": 100, "統合氏名": 85, "電話番号": 85, "姓": 80, "名": 80, "件名": 75, "郵便番号1": 40, "郵便番号2": 40, "電話1": 15, "電話2": 10,
}
_PRIORITY_SQL = "case field " + " ".join(f"when '{k}' then {v}" for k, v in _RANK.items()) + " else 0 end"
_PARTNER = "((x[1].field = '電話番号' and k.field in ('電話1', '電話2', '電話3')) or (x[1].field in ('電話1', '電話2', '電話3') and k.field = '電話番号'))"
_SAME = "(k.value = x[1].value and trim(replace(k.value, '　', '')) <> '')"
_HAS_PARTNER = f"(x[1].field in ('電話番号', '電話1', '電話2', '電話3') and len(list_filter(acc, lambda k: {_PARTNER})) > 0)"
_RIVAL = f"case when {_HAS_PARTNER} then {_PARTNER} else {_SAME} end"


@query(
    f"""with a as ({_ASSIGNED}), b as (select *, {_PRIORITY_SQL} as p from a),
g as (select form, list([struct_pack(field := field, value := value, score := score, p := p)] order by line, part, supp, value, score) as fs from b group by 1),
r as (select form, list_reduce(list_concat([list_filter(fs[1], lambda k: false)], fs), lambda acc, x: case
  when coalesce(x[1].value, '') = '' then acc
  when trim(replace(x[1].value, '　', '')) = '' then list_concat(acc, x)
  when x[1].field = 'auto_email_confirm' then case when len(list_filter(acc, lambda k: k.field = 'メールアドレス' and k.value = x[1].value)) > 0 then list_concat(acc, x) else acc end
  when len(list_filter(acc, lambda k: ({_RIVAL}) and (k.p > x[1].p or (k.p = x[1].p and k.score > x[1].score)))) > 0 then acc
  else list_concat(list_filter(acc, lambda k: not ({_RIVAL})), x) end) as kept from g)
select form, list_transform(kept, lambda k: k.field) as kept from r"""
)
def form_duplicates(spark, d):
    """form, kept: the fields that keep their value, where several of a form want one."""
    rows = table(spark, d, "lineitem").selectExpr(
        "l_orderkey as form", "l_linenumber as line", "l_partkey as part", "l_suppkey as supp", f"{_ASSIGNED_FIELD} as field", f"{_ASSIGNED_VALUE} as value", "cast(80 + l_partkey % 4 as int) as score"
    )
    order = F.struct("line", "part", "supp", "value", "score", "field")
    grouped = rows.groupBy("form").agg(F.sort_array(F.collect_list(order)).alias("fs"))
    assigned = F.transform("fs", lambda f: F.struct(f["field"].alias("field"), f["value"].alias("value"), f["score"].alias("score"), (f["field"] == "auto_email_confirm").alias("confirm")))
    return grouped.select("form", F.transform(mapping.without_duplicates(assigned), lambda a: a["field"]).alias("kept"))


_CHOICES = ("選択してください", "その他", "サービスについて", "Phone", "Email", "女性", "男性", "select one", "お問い合わせ", "Fax", "どちらでも", "none", "電話", "Men")
_CHOICE, _CHOICE_VALUE = choose("l_partkey + l_suppkey", _CHOICES), choose("l_partkey", ("1", "2", "", "select", "x", "none", None))


@query(
    f"""with c as (select l_orderkey as form, {_CHOICE} as t, {_CHOICE_VALUE} as v, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 as i from lineitem),
o as (select *, trim(coalesce(v, '')) <> '' and not regexp_matches(lower(trim(coalesce(v, ''))), 'select|choose|---|none') as ok, lower(t) as l from c)
select form, cast(coalesce(max(i) filter (where ok and regexp_matches(l, 'その他|other')), max(i) filter (where ok and contains(l, 'お問い合わせ')), max(i) filter (where ok), count(*) - 1) as int) as picked,
  cast(coalesce(min(i) filter (where regexp_matches(l, 'mail|メール')), min(i) filter (where regexp_matches(l, 'any|either|no preference|どちらでも|問いません|どれでも')), min(i) filter (where regexp_matches(l, 'phone|tel|call|携帯|モバイル|電話')),
    min(i) filter (where regexp_matches(l, 'fax|ファックス|ファクス')), 0) as int) as method,
  cast(coalesce(min(i) filter (where regexp_matches(t, '男|male|man|Men|Male')), 0) as int) as male from o group by 1"""
)
def form_choices(spark, d):
    """form, picked, method, male: which of the choices of a form is taken, by preference, for contact and for gender."""
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("form"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", F.expr(_CHOICE).alias("t"), F.expr(_CHOICE_VALUE).alias("v")).alias("c")
    )
    grouped = rows.groupBy("form").agg(F.sort_array(F.collect_list("c")).alias("cs")).select("form", F.col("cs.t").alias("t"), F.col("cs.v").alias("v"))
    return grouped.select("form", mapping.pick(F.col("t"), ["その他|other", "お問い合わせ"], F.col("v")).alias("picked"), mapping.contact_method(F.col("t")).alias("method"), mapping.gender_choice(F.col("t")).alias("male"))


_BUTTON = choose("l_partkey + l_linenumber", ("戻る", "送信する", "確認画面へ", "検索", "問い合わせ", "次へ", "キャンセル", "Submit", "申し込む", "", "Next", None))
_BUTTON_TYPE = choose("l_suppkey", ("button", "submit", "button", "reset", None))


@query(
    f"""with c as (select l_orderkey as form, lower(coalesce({_BUTTON}, '')) as t, lower(coalesce({_BUTTON_TYPE}, '')) as k, l_quantity > 10 as visible, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 as i from lineitem),
o as (select *, visible and not regexp_matches(t, '戻る|back|キャンセル|cancel|リセット|reset|クリア|clear|検索|search|閉じる|close') as ok from c)
select form, cast(coalesce(min(i) filter (where ok and k = 'submit'), min(i) filter (where ok and regexp_matches(t, '送信|submit|send')), min(i) filter (where ok and regexp_matches(t, 'お問い合わせ|問い合わせ|申し込|申込|応募|登録')),
  min(i) filter (where ok and regexp_matches(t, '確認|confirm|次へ|next|進む'))) as int) as place from o group by 1"""
)
def form_buttons(spark, d):
    """form, place: the button that sends."""
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("form"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", F.expr(_BUTTON_TYPE).alias("type"), F.expr(_BUTTON).alias("text"), (F.col("l_quantity") > 10).alias("visible")).alias("c"),
    )
    grouped = rows.groupBy("form").agg(F.sort_array(F.collect_list("c")).alias("cs"))
    buttons = F.transform("cs", lambda c: F.struct(c["type"].alias("type"), c["text"].alias("text"), c["visible"].alias("visible")))
    return grouped.select("form", mapping.submit_button(buttons).alias("place"))


# ---- split fields: the first fields of a form as the parts of a phone, a name or a postal code
_KINDS = ("phone", "name", "postal_code")
_PARTS = with_sql("fields") + ", p as (select form, pos, name, nullif(label, '') as label, x, y, case form % 3 when 0 then 'phone' when 1 then 'name' else 'postal_code' end as kind from fields where pos <= 4)"


@query(
    _PARTS + r""", g as (select form, kind, count(*) as n, lower(string_agg(coalesce(label, ''), ' ' order by pos)) as said, count(distinct (x, y)) as spots from p group by 1, 2),
near as (select distinct a.form from p a join p b on a.form = b.form and (a.x <> b.x or a.y <> b.y) and sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 80),
v as (
  select g.*, regexp_matches(said, 'フルネーム|full name|氏名|お名前|完全な住所|full address|住所全体|電話番号（ハイフンなし）|phone number|電話番号全体') as unified,
    n >= 2 and (not (near.form is not null or spots < n) or n >= 3) as separate, case kind when 'phone' then n >= 3 when 'name' then n <> 2 else false end as tends from g left join near using (form)
),
w as (
  select form, case when regexp_matches(said, 'それぞれ|各項目|各フィールド|各入力欄|individually|separately|each field|分けて入力|分けてご記入|個別に|別々に|[234]つに分けて') then 4 else 0 end + case when unified then 0 else 3 end + case when separate then 3 else 0 end
      + case when n >= 3 then 2 else 0 end + case when n = 2 then 1 else 0 end + case when tends then 2 else 0 end as split,
    case when regexp_matches(said, '一度に|一括で|まとめて|続けて入力|連続して|combined|together|as one|ハイフンなし|ハイフンを除く|スペースなし|連結して|結合して') then 4 else 0 end + case when unified then 5 else 0 end + case when n = 2 then 1 else 0 end + case when tends then 0 else 2 end as combine from v
)
select form, case when split > combine then 'split' else 'combine' end as strategy, least(0.95, greatest(split, combine) / 10) as confidence from w"""
)
def split_strategies(spark, d):
    """form, strategy, confidence: whether the parts of a form are filled one by one."""
    one = _parts(spark, d)
    found = F.coalesce(*[F.when(F.col("kind") == k, mapping.split_strategy(k, F.col("fs"))) for k in _KINDS])
    return one.select("form", found.alias("s")).select("form", "s.strategy", "s.confidence")


def _parts(spark, d):
    said = F.when(F.col("label") != "", F.array(F.struct(F.col("label").alias("text"), F.lit("label").alias("source"), F.lit(0.8).alias("confidence"))))
    none = F.array().cast("array<struct<text:string,source:string,confidence:double>>")
    rows = fields(spark, d).where("pos <= 4").select("form", "pos", F.struct("name", F.coalesce(said, none).alias("contexts"), "x", "y").alias("f"))
    grouped = rows.groupBy("form").agg(F.sort_array(F.collect_list(F.struct("pos", "f"))).alias("fs"))
    kind = F.when(F.col("form") % 3 == 0, "phone").when(F.col("form") % 3 == 1, "name").otherwise("postal_code")
    return grouped.select("form", kind.alias("kind"), F.transform("fs", lambda f: f["f"]).alias("fs"))


_HITS = {
    "phone": ("電話", "電話番号", "tel", "phone", "市外局番", "局番"), "name": ("名前", "姓", "名", "name", "last", "first", "苗字"), "postal_code": ("郵便番号", "postal", "zip", "〒"),
}


def _by_kind(one) -> str:
    return "case kind " + " ".join(f"when '{k}' then {one(k)}" for k in _KINDS) + " end"


def _hits(kind: str, c: str) -> str:
    return "(" + " + ".join(f"case when contains({c}, '{w}') then 1 else 0 end" for w in _HITS[kind]) + ")"


@query(
    _PARTS + f""", h as (select *, lower(coalesce(label, '')) as l, concat(lower(name), ' ', lower(coalesce(label, ''))) as t from p),
q as (select form, kind, count(*) as n, avg(case when label is null then 0.2 when {_by_kind(lambda k: _hits(k, 'l'))} > 0 then 0.8 * 0.9 else 0.8 * 0.9 * 0.3 end) as quality,
  avg(case when {_by_kind(lambda k: _hits(k, 't'))} = 0 then 0.25 else least(1.0, {_by_kind(lambda k: _hits(k, 't'))} * 1.5 / {_by_kind(lambda k: str(len(_HITS[k])))}) end) as words from h group by 1, 2),
r as (select form, 0.35 + case kind when 'phone' then case n when 3 then 0.30 when 2 then 0.20 else -0.10 end when 'name' then case n when 2 then 0.35 when 3 then 0.20 when 4 then 0.10 else -0.15 end else 0 end + quality * 0.25
  + case when form % 2 = 0 then 0.15 else -0.25 end + words * 0.15 as total from q)
select form, round(case when round(greatest(0, least(1, total)), 9) >= 0.45 then greatest(0, least(1, total)) else 0 end, 6) as confidence from r"""
)
def split_confidences(spark, d):
    """form, confidence: how sure it is that the parts of a form belong together."""
    found = F.coalesce(*[F.when(F.col("kind") == k, mapping.split_confidence(k, F.col("fs"), F.col("form") % 2 == 0)) for k in _KINDS])
    return _parts(spark, d).select("form", F.round(found, 6).alias("confidence"))


# ---- values of clients
def _p(c: str) -> str:
    return f"trim(coalesce({c}, ''))"


_STREET = f"concat({_p('address_1')}, {_p('address_2')}, {_p('address_3')}, {_p('address_4')})"
_WHOLE_ADDRESS = f"case when {_p('address_5')} = '' then {_STREET} else concat({_STREET}, '　', {_p('address_5')}) end"


@query(
    with_sql("clients") + f""" select id,
  case id % 5 when 0 then [concat({_p('phone_1')}, {_p('phone_2')}, {_p('phone_3')})] when 1 then [concat({_p('phone_1')}, {_p('phone_2')}), {_p('phone_3')}] when 2 then [{_p('phone_1')}, {_p('phone_2')}] else [{_p('phone_1')}, {_p('phone_2')}, {_p('phone_3')}] end as phone,
  case id % 4 when 0 then [{_WHOLE_ADDRESS}] when 1 then [{_STREET}, {_p('address_5')}] when 2 then [{_p('address_1')}, concat({_p('address_2')}, {_p('address_3')}, {_p('address_4')}), {_p('address_5')}]
    else [{_p('address_1')}, {_p('address_2')}, concat({_p('address_3')}, {_p('address_4')}), {_p('address_5')}] end as address,
  case when id % 2 = 0 then [concat({_p('last_name')}, '　', {_p('first_name')})] else [{_p('last_name')}, {_p('first_name')}] end as name from clients"""
)
def split_client_values(spark, d):
    """id, phone, address, name: the values for as many fields as a form has."""
    c = clients(spark, d)
    part = lambda *names: [F.col(n) for n in names]
    k = F.col("id") % 5
    n_phone = F.when(k == 0, 1).when(k.isin(1, 2), 2).otherwise(3)
    phone = mapping.split_values("phone", part("phone_1", "phone_2", "phone_3"), n_phone, F.when(k == 2, "split").otherwise("combine"))
    address = mapping.split_values("address", part(*[f"address_{i}" for i in range(1, 6)]), (F.col("id") % 4 + 1).cast("int"), F.lit("combine"))
    name = mapping.split_values("name", part("last_name", "first_name"), F.when(F.col("id") % 2 == 0, 1).otherwise(2), F.lit("split"))
    return c.select("id", phone.alias("phone"), address.alias("address"), name.alias("name"))


@query(
    with_sql("clients") + """ select id, case when regexp_matches(g, '男性|だんせい|男|male|man') then 'male' when regexp_matches(g, '女性|じょせい|女|female|woman') then 'female' when regexp_matches(g, 'その他|未回答|無回答|回答しない|other|prefer not') then 'other' end as gender
from (select id, lower(trim(gender)) as g from clients)"""
)
def client_genders(spark, d):
    return clients(spark, d).select("id", mapping.gender(F.col("gender")).alias("gender"))


_WANTED = ("会社名", "統合氏名", "統合氏名カナ", "メールアドレス", "電話番号", "電話2", "郵便番号", "都道府県", "性別", "住所", "件名", "お問い合わせ本文", "知らない", "姓")


def _pair(a: str, b: str) -> str:
    return f"case when {_p(a)} = '' then {_p(b)} when {_p(b)} = '' then {_p(a)} else concat({_p(a)}, '　', {_p(b)}) end"


@query(
    with_sql("clients") + f""", w as (select *, {choose("id", _WANTED)} as field, case when id % 5 = 0 then 'select' else 'text' end as kind from clients)
select id, field, kind, case when kind = 'select' and field not in ('性別', '都道府県') then '' else case field
  when '会社名' then {_p('company_name')} when '統合氏名' then {_pair('last_name', 'first_name')} when '統合氏名カナ' then {_p('last_name_kana')} when '姓' then {_p('last_name')}
  when 'メールアドレス' then case when {_p('email_1')} <> '' and {_p('email_2')} <> '' then concat({_p('email_1')}, '@', {_p('email_2')}) else '' end
  when '電話番号' then concat({_p('phone_1')}, {_p('phone_2')}, {_p('phone_3')}) when '電話2' then {_p('phone_2')} when '郵便番号' then concat({_p('postal_code_1')}, {_p('postal_code_2')}) when '都道府県' then {_p('address_1')}
  when '性別' then {_p('gender')} when '住所' then {_WHOLE_ADDRESS} when '件名' then concat('件 ', id) when 'お問い合わせ本文' then concat('本文 ', company_name) else '' end end as value from (select * replace (coalesce(company_name, '') as company_name) from w)"""
)
def client_values(spark, d):
    """id, field, kind, value: what a client's field is filled with."""
    c = clients(spark, d).withColumns({"field": F.expr(choose("id", _WANTED)), "kind": F.when(F.col("id") % 5 == 0, "select").otherwise("text")})
    names = [n for n in c.columns if n not in ("id", "field", "kind")]
    known = F.map_filter(F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))]), lambda k, v: v.isNotNull())
    value = safeguards.value_for(F.col("field"), F.col("kind"), known, F.concat(F.lit("件 "), "id"), F.concat(F.lit("本文 "), F.coalesce("company_name", F.lit(""))))
    return c.select("id", "field", "kind", value.alias("value"))


# ---- a form as a grid: lines and columns of boxes that overlap
_BOXES = with_sql("fields") + ", b as (select form, pos, type, x + pos % 3 as x0, x + 50 + score % 40 as x1, y * 1.5 + score % 9 as y0, y * 1.5 + score % 9 + 25 as y1 from fields)"


def _island(low: str, high: str, name: str) -> str:
    """The number of the run of overlapping intervals that a box is in."""
    return f"sum(new_{name}::int) over (partition by form order by {low}, pos)"


@query(
    _BOXES + f""", n as (select *, coalesce(y0 > max(y1) over (partition by form order by y0, pos rows between unbounded preceding and 1 preceding), true) as new_line,
  coalesce(x0 > max(x1) over (partition by form order by x0, pos rows between unbounded preceding and 1 preceding), true) as new_column from b),
g as (select form, pos, type, cast({_island('y0', 'y1', 'line')} as bigint) as line, cast({_island('x0', 'x1', 'column')} as bigint) as col from n),
l as (select form, line, count(*) as n, count(distinct col) as columns, count(*) filter (where type in ('text', 'tel')) as texts from g group by 1, 2)
select form, pos, line, col, n as in_line, case when texts between 2 and 4 and columns = n then 'combine' when n > 1 then 'beside' else 'alone' end as advice from g join l using (form, line)"""
)
def field_grids(spark, d):
    """form, pos, line, col, in_line, advice: the grid that the boxes of a form make, and whether the fields of a line belong together."""
    boxes = fields(spark, d).select(
        "form", "pos", "type", (F.col("x") + F.col("pos") % 3).alias("x0"), (F.col("x") + 50 + F.col("score") % 40).alias("x1"), (F.col("y") * 1.5 + F.col("score") % 9).alias("y0"),
        (F.col("y") * 1.5 + F.col("score") % 9 + 25).alias("y1"),
    )
    return elements.line_advice(elements.grid(boxes, "form")).select("form", "pos", "line", "col", "in_line", "advice")


@query(
    _SCORED + f""", q as (select form, pos, {_MAIL} as score, greatest(0, {_QUICK} + 80) as bound from b),
r as (select *, row_number() over (partition by form order by bound desc, pos) as rank from q),
l as (select form, score as lead, pos as lead_pos from r where rank = 1),
w as (select form, count(*) filter (where rank = 1 or bound > lead or (bound = lead and pos < lead_pos)) as detailed from r join l using (form) group by 1),
e as (select form, pos, score from q qualify row_number() over (partition by form order by score desc, pos) = 1)
select form, pos, score, detailed from e join w using (form)"""
)
def best_mail_fields(spark, d):
    """form, pos, score, detailed: the best element for the mail address, found without scoring all in full; the oracle scores all."""
    rows = fields(spark, d).select(*_KEY, _element().alias("e"))
    return scores.best_elements(rows, RULES[0])


# ---- the catalogue of words
_NAME_WORDS = (
    "('company', 'company corp organization'), ('full_name', 'your-name fullname full_name'), ('last_name', 'last_name sei family'), ('first_name', 'first_name mei given'), ('kana', 'kana furigana hiragana'), ('email', 'email mail'), "
    "('phone', 'tel phone fax'), ('postal', 'zip postal'), ('prefecture', 'pref'), ('address', 'addr address'), ('url', 'url website'), ('subject', 'subject title'), ('message', 'message body inquiry content'), ('department', 'department dept')"
)
_LABEL_WORDS = (
    "('company', '会社 企業 法人 company'), ('full_name', 'お名前 氏名'), ('last_name', '姓 セイ'), ('first_name', '名 メイ'), ('kana', 'フリガナ ふりがな'), ('email', 'メール mail'), ('phone', '電話 tel'), ('postal', '郵便'), ('prefecture', '都道府県'), "
    "('address', '住所'), ('url', 'url ホームページ'), ('subject', '件名'), ('message', 'お問い合わせ 本文 内容 ご意見 message'), ('department', '部署')"
)


@query(
    with_sql("fields") + f""", n as (select field, unnest(string_split(ws, ' ')) as word from (values {_NAME_WORDS}) v(field, ws)), l as (select field, unnest(string_split(ws, ' ')) as word from (values {_LABEL_WORDS}) v(field, ws)),
w as (select *, 'name' as attribute, 60 as weight from n union all select *, 'ident', 60 from n union all select *, 'placeholder', 40 from l union all select *, 'label', 80 from l),
a as (select form, pos, unnest(['name', 'ident', 'placeholder', 'label']) as attribute, unnest([name, ident, placeholder, label]) as said from fields)
select form, pos, attribute, w.field, w.word, w.weight from a join w using (attribute) where contains(lower(said), w.word)"""
)
def field_rule_hits(spark, d):
    """form, pos, attribute, field, word, weight: the words of the catalogue that the attributes of fields hold."""
    return patterns.rule_hits(fields(spark, d), list(_KEY))
