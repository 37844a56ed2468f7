"""How well an element fits a field: attributes, kind and label against a rule, less what speaks against it; and who gets what of a form.

An element is a struct of tag, type, name, id, classes, placeholder, label, style, visible, enabled, required. A score of -999 excludes it.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.functions import text
from leadloom.operators import elements, mapping, safeguards

EXCLUDED = -999
# fixed values: points
TYPE, LABEL, NAME, TAG, PLACEHOLDER, CLASS, TEXTAREA, GENERIC_TEXT = 100, 80, 60, 50, 40, 30, 20, -40
#: With a label that fits by so much, attributes count for seven tenths.
LABELLED = 40
# fixed values: signs of names in kana, in hiragana and in katakana, and of family and first names
KANA = "kana|katakana|hiragana|furigana|ruby|ルビ|るび|ｶﾅ|ｶﾀｶﾅ|ﾌﾘｶﾞﾅ|カナ|カタカナ|フリガナ|ふりがな|ひらがな|読み|よみ"
HIRAGANA, KATAKANA = "hiragana|ひらがな", "katakana|ruby|カタカナ|ｶﾀｶﾅ|カナ|ｶﾅ|ルビ|るび|フリガナ|ふりがな"
FAMILY, FIRST = "セイ|せい|姓|sei|lastname", "メイ|めい|名|mei|firstname"


ATTRIBUTES = ("name", "id", "classes", "placeholder")
TEXTS = (*ATTRIBUTES, "label", "type", "tag")
HITS = ("type", "tag", "label", "out", "unsuited", "name", "id", "placeholder", "classes")


class Rule(NamedTuple):
    """What names a field. words: patterns of names, ids, classes and placeholders; label: of labels; exclude: words that rule an element out."""

    field: str
    types: tuple[str, ...]
    tags: tuple[str, ...]
    words: str
    label: str
    exclude: tuple[str, ...] = ()


def _low(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit("")))


def _lowered(e: Column) -> Column:
    return F.transform(F.array(*[F.coalesce(e[k], F.lit("")) for k in TEXTS]), F.lower)


def _read(e: Column, low: Column) -> dict[str, Column]:
    """What all rules ask of an element, by name. low: its texts in lower case."""
    visible, enabled = F.coalesce(e["visible"], F.lit(True)), F.coalesce(e["enabled"], F.lit(True))
    return {k: low[i] for i, k in enumerate(TEXTS)} | {
        "raw": F.concat_ws(" ", *[F.coalesce(e[k], F.lit("")) for k in ATTRIBUTES]), "attributes": F.concat_ws(" ", *[low[TEXTS.index(k)] for k in ATTRIBUTES]),
        "visible": visible, "enabled": enabled, "required": F.coalesce(e["required"], F.lit(False)),
        "penalty": elements.visibility_penalty(visible, enabled, e["style"], F.coalesce(e["type"], F.lit("")), F.lit(""), F.lit("")),
    }


def _kana_mismatch(r: dict[str, Column], rule: Rule) -> Column:
    """Kana elements are for kana fields, hiragana for hiragana, and each part of a name for its own field."""
    raw, low, kana_field = r["raw"], r["attributes"], any(k in rule.field for k in ("カナ", "ひらがな", "ふりがな"))
    bad = F.lit(False) if kana_field else r.get("kana", text.says(low, KANA))
    if "カナ" in rule.field:
        bad = bad | (text.says(low, HIRAGANA) & ~text.says(low, KATAKANA))
    if "ひらがな" in rule.field:
        bad = bad | text.says(low, KATAKANA)
    if rule.field in ("姓カナ", "姓ひらがな"):
        bad = bad | (text.says(raw, FIRST) & ~text.says(raw, FAMILY))
    if rule.field in ("名カナ", "名ひらがな"):
        bad = bad | (text.says(raw, FAMILY) & ~text.says(raw, FIRST))
    if rule.field == "統合氏名カナ":
        bad = bad | text.says(raw, f"{FAMILY}|{FIRST}")
    return bad


def _hits(r: dict[str, Column], rule: Rule) -> dict[str, Column]:
    """Where the rule fits, and what speaks against the element (out: by its attributes; unsuited: in all)."""
    out = mapping.excluded(r["name"], r["id"], r["classes"], r["placeholder"], rule.exclude) if rule.exclude else F.lit(False)
    unsuited = _kana_mismatch(r, rule) | out
    for word in rule.exclude:
        unsuited = unsuited | r["label"].contains(word.lower())
    return {"type": r["type"].isin(*rule.types), "tag": r["tag"].isin(*rule.tags), "label": text.says(r["label"], rule.label), "out": out, "unsuited": unsuited} | {
        k: text.says(r[k], rule.words) for k in ("name", "id", "placeholder", "classes")
    }


def _add(cond: Column, n: int) -> Column:
    return F.when(cond, n).otherwise(0)


def _score(r: dict[str, Column], h: dict[str, Column], rule: Rule) -> Column:
    own = lambda share: sum((_add(h[k], math.floor(n * share)) for k, n in (("name", NAME), ("id", NAME))), _add(h["type"], math.floor(TYPE * share)))
    total = F.when(h["label"], own(0.7) + LABEL).otherwise(own(1)) if LABEL >= LABELLED else own(1) + _add(h["label"], LABEL)
    total = total + _add(h["tag"], TAG) + _add(h["placeholder"], PLACEHOLDER) + _add(h["classes"], CLASS) + r["penalty"]
    if rule.field == "お問い合わせ本文":
        total = total + _add(r["tag"] == "textarea", TEXTAREA)
    total = total + _add((r["type"] == "text") & ~(h["name"] | h["id"] | h["placeholder"] | h["label"]), GENERIC_TEXT)
    return F.when(h["unsuited"], EXCLUDED).otherwise(F.greatest(F.lit(0), total)).cast("int")


def element_score(e: Column, rule: Rule) -> Column:
    """All points, at least 0, or -999."""
    r = _read(e, _lowered(e))
    return _score(r, _hits(r, rule), rule)


def _quick(r: dict[str, Column], h: dict[str, Column]) -> Column:
    points = {"type": TYPE, "tag": TAG, "name": NAME, "id": NAME, "placeholder": PLACEHOLDER, "classes": CLASS}
    total = sum((_add(h[k], n) for k, n in points.items()), F.lit(0)) + _add(~r["visible"], -200) + _add(~r["enabled"], -100) + _add(r["type"] == "hidden", -200)
    return F.when(h["out"], EXCLUDED).otherwise(F.greatest(F.lit(EXCLUDED), total)).cast("int")


def quick_score(e: Column, rule: Rule) -> Column:
    """Attributes alone, less for hidden and disabled elements."""
    r = _read(e, _lowered(e))
    return _quick(r, _hits(r, rule))


def _bound(rows: DataFrame, prefix: str, columns: dict[str, Column]) -> tuple[DataFrame, dict[str, Column]]:
    """The columns stand in the rows: what follows asks for each as often as it likes, and has it computed once."""
    return rows.withColumns({prefix + k: c for k, c in columns.items()}), {k: F.col(prefix + k) for k in columns}


def _once(rows: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """Rows (e: the element) that were read."""
    return _bound(rows.withColumn("__low", _lowered(F.col("e"))), "__", _read(F.col("e"), F.col("__low")))


def best_elements(rows: DataFrame, rule: Rule) -> DataFrame:
    """form, pos, score, detailed of the best element of each form (rows: form, pos, e) for a rule, the first of several; detailed: how many were scored in full.

    In two phases: attributes alone and a label that fits bound a score from above. The element of the greatest bound is scored in full, and
    then only those whose bound could still win against it."""
    most = LABEL + (TEXTAREA if rule.field == "お問い合わせ本文" else 0)
    rows, r = _once(rows)
    rows, h = _bound(rows, "__hit_", _hits(r, rule))
    bounded = rows.withColumn("__bound", F.greatest(F.lit(0), _quick(r, h) + most))
    form = Window.partitionBy("form")
    ranked = bounded.withColumn("__rank", F.row_number().over(form.orderBy(F.desc("__bound"), "pos")))
    first = ranked.withColumn("__first", F.when(F.col("__rank") == 1, _score(r, h, rule)))
    lead, at = F.max("__first").over(form), F.max(F.when(F.col("__rank") == 1, F.col("pos"))).over(form)
    may = (F.col("__rank") > 1) & ((F.col("__bound") > lead) | ((F.col("__bound") == lead) & (F.col("pos") < at)))
    scored = first.withColumn("__may", may).withColumn("__score", F.coalesce("__first", F.when(F.col("__may"), _score(r, h, rule))))
    best = F.max(F.struct(F.col("__score").alias("score"), (-F.col("pos")).alias("before")))
    return scored.groupBy("form").agg(best.alias("b"), F.count("__score").alias("detailed")).select("form", (-F.col("b.before")).alias("pos"), "b.score", "detailed")


def _safe(r: dict[str, Column], rule: Rule) -> Column:
    return safeguards.passes(F.lit(rule.field), r["type"], r["attributes"], r["label"])


def _offer(asked: Column, rescue: bool, order: int, rule: Rule, element: Column, score: Column) -> Column:
    """What an element offers to a field, or null. By order of offers: first those of a sufficient score, by field, the greatest score, the first element."""
    return F.when(asked, F.struct(F.lit(rescue).alias("rescued"), F.lit(order).alias("order"), (-score).alias("worse"), element.alias("element"), F.lit(rule.field).alias("field"), score.alias("score")))


def offers(rows: DataFrame, rules: list[Rule], least: int = 70) -> DataFrame:
    """form, offer: what elements (rows: form, pos from 1, e) offer to fields. An element is scored once a rule, as it is read; only offers go on to the form."""
    read, r = _once(rows)
    read, kana = _bound(read, "__", {"kana": text.says(r["attributes"], KANA)})
    read, h = _bound(read, "__", {f"{k}{i}": c for i, rule in enumerate(rules) for k, c in _hits(r | kana, rule).items()})
    found, score = _bound(read, "__score", {str(i): _score(r, {k: h[f"{k}{i}"] for k in HITS}, rule) for i, rule in enumerate(rules)})
    score = list(score.values())
    good, wanted = [s >= least for s in score], [r["required"] & (s >= 1) for s in score]
    made = [_offer(asked[k], asked is wanted, k, rule, F.col("pos") - 1, score[k]) for k, rule in enumerate(rules) for asked in (good, wanted)]
    every = found.select("form", *[r[k] for k in ("type", "attributes", "label")], F.explode(F.array(*made)).alias("offer"))
    safe = reduce(lambda c, x: c | ((F.col("offer.order") == x[0]) & _safe(r, x[1])), enumerate(rules), F.lit(False))
    return every.where(F.col("offer").isNotNull() & safe).select("form", "offer")


def settled(offers: Column) -> Column:
    """array<struct<field, element, score, rescued>>: of all offers of a form the best, as long as field and element are free."""
    kind = "array<struct<field:string,element:int,score:int,rescued:boolean>>"

    def step(done, x):
        taken = F.exists(done, lambda d: (d["field"] == x["field"]) | (d["element"] == x["element"]))
        new = F.struct(x["field"].alias("field"), x["element"].alias("element"), x["score"].alias("score"), x["rescued"].alias("rescued"))
        return F.when(taken, done).otherwise(F.concat(done, F.array(new)))

    return F.aggregate(F.array_sort(offers), F.array().cast(kind), step)


def assigned(form: Column, rules: list[Rule], least: int = 70) -> Column:
    """array<struct<field, element, score, rescued>>: fields in the order of the rules take their best free element of at least a score that passes their safeguard, the first of several.

    Then each required element that no field took goes to the best field that is still free, whatever its score, if that is over 0.
    """

    def made(rescue: bool, order: int, rule: Rule):
        def one(e, i):
            r, score = _read(e, _lowered(e)), element_score(e, rule)
            asked = (r["required"] & (score >= 1)) if rescue else score >= least
            return _offer(asked & _safe(r, rule), rescue, order, rule, i, score)

        return F.transform(form, one)

    every = F.flatten(F.array(*[made(rescue, k, rule) for rescue in (False, True) for k, rule in enumerate(rules)]))
    return settled(F.filter(every, lambda x: x.isNotNull()))


def assigned_rows(rows: DataFrame, rules: list[Rule], least: int = 70) -> DataFrame:
    """form, a: ``assigned`` of forms that are given as rows of their elements (form, pos from 1, e); a row for each field that is taken."""
    taken = offers(rows, rules, least).groupBy("form").agg(settled(F.collect_list("offer")).alias("a"))
    return taken.select("form", F.explode("a").alias("a"))
