"""Contact forms: quality, kind, the best form of a page, and which value goes into which field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: what names fields of a contact form; weight orders the assignment
FIELDS = [
    ("email", 25, r"e?-?mail|メール", ("email", "text")), ("message", 22, r"message|body|content|inquiry|comment|本文|内容|お問い合わせ", ("textarea",)),
    ("company", 16, r"company|corp|organization|会社|企業|貴社", ("text",)), ("last_name", 14, r"last.?name|family|姓|sei", ("text",)), ("first_name", 13, r"first.?name|given|mei\b|(?<!氏)名$", ("text",)),
    ("full_name", 12, r"^name$|your.?name|full.?name|氏名|お名前", ("text",)), ("phone", 10, r"tel|phone|電話", ("tel", "text", "number")), ("postal", 9, r"zip|postal|郵便", ("text", "tel", "number")),
    ("address", 8, r"address|住所", ("text",)), ("subject", 7, r"subject|title|件名", ("text",)),
]
SEARCH, LOGIN, COMMENT, RECRUIT, NEWS = (r"search|検索", r"login|password|ログイン|パスワード", r"comment.?form|post comment|コメント", r"recruit|career|採用|応募|エントリー", r"newsletter|メルマガ|subscribe")
LEAST = 60


def _any(form: Column, pattern: str) -> Column:
    named = F.exists(form["inputs"], lambda i: F.lower(F.concat_ws(" ", i["name"], i["id"], i["type"], i["placeholder"])).rlike(pattern))
    return named | F.exists(form["buttons"], lambda b: F.lower(b["text"]).rlike(pattern))


def form_kind(form: Column) -> Column:
    """search, auth, newsletter, recruitment, comment, contact or other, in this order."""
    n = F.size(form["inputs"])
    contact = _any(form, FIELDS[0][2]) | F.exists(form["inputs"], lambda i: i["tag"] == "textarea")
    return (
        F.when((n <= 2) & _any(form, SEARCH), "search").when(_any(form, LOGIN), "auth").when((n <= 2) & (_any(form, NEWS) | F.lower(form["text"]).rlike(NEWS)), "newsletter")
        .when(F.lower(form["text"]).rlike(RECRUIT), "recruitment").when(_any(form, COMMENT), "comment").when(contact, "contact").otherwise("other")
    )


def usable(form: Column) -> Column:
    """A contact form with inputs and something to send it."""
    return (F.size(form["inputs"]) > 0) & (form_kind(form) == "contact") & (F.size(form["buttons"]) > 0)


def best_forms(pages: DataFrame, forms: Column) -> DataFrame:
    """page_id, form_index, form: the first usable form of each page."""
    rows = pages.select("page_id", F.posexplode(forms).alias("form_index", "form")).where(usable(F.col("form")))
    first = Window.partitionBy("page_id").orderBy("form_index")
    return rows.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")


def element_scores(forms: DataFrame) -> DataFrame:
    """page_id, element, field, weight, score: each input against each rule (a fixed, short list), from 0."""
    elements = forms.select("page_id", F.posexplode("form.inputs").alias("element", "e"))
    name, place, kind = F.lower(F.concat_ws(" ", "e.name", "e.id")), F.lower(F.coalesce("e.placeholder", F.lit(""))), F.coalesce("e.type", F.lit("text"))
    rules = []
    for field, weight, pattern, kinds in FIELDS:
        score = F.when(name.rlike(pattern), 60).otherwise(0) + F.when(place.rlike(pattern), 40).otherwise(0) + F.when(kind.isin(*kinds), 50).otherwise(-200) + F.when(kind == field, 50).otherwise(0)
        rules.append(F.struct(F.lit(field).alias("field"), F.lit(weight).alias("weight"), F.greatest(F.lit(0), score).alias("score")))
    return elements.select("page_id", "element", F.inline(F.array(*rules))).where(F.col("score") >= LEAST)


def assign_fields(scores: DataFrame) -> DataFrame:
    """page_id, field, element, score: fields by weight (then name) take their best free element, the first of several; a fold over the fields of a form."""
    one = F.struct((-F.col("weight")).alias("order"), "field", (-F.col("score")).alias("s"), "element", "score")
    fields = scores.groupBy("page_id").agg(F.sort_array(F.collect_list(one)).alias("all"))  # a form is small
    kind = "array<struct<field:string,element:int,score:int>>"

    def step(done, x):
        taken = F.exists(done, lambda d: (d["field"] == x["field"]) | (d["element"] == x["element"]))
        return F.when(taken, done).otherwise(F.concat(done, F.array(F.struct(x["field"].alias("field"), x["element"].alias("element"), x["score"].alias("score")))))

    chosen = F.aggregate("all", F.array().cast(kind), step)
    return fields.select("page_id", F.inline(chosen))


def split_value(value: Column, parts: int) -> Column:
    """A phone or postal number over as many inputs: 3 (2-4-4 or 3-4-4) or 2 (3-4), else whole."""
    d = F.regexp_replace(value, r"\D", "")
    head = F.when(F.length(d) == 11, 3).otherwise(2)
    three = F.array(F.substring(d, F.lit(1), head), F.substring(d, head + 1, F.lit(4)), F.substring(d, head + 5, F.lit(4)))
    two = F.array(F.substring(d, 1, 3), F.substring(d, 4, 4))
    return three if parts == 3 else two if parts == 2 else F.array(d)
