"""Scores of form elements and their surroundings, by expression."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HIDDEN = -200
# fixed values: how an element hides, as patterns of its style without spaces
GONE, TRAP = r"display:none|visibility:hidden|pointer-events:none|opacity:0+(\.0+)?(;|$)", r"height:1px|width:1px|overflow:hidden|left:-9999px|top:-9999px"
# fixed values: words around a field and what they add
FIELD_WORDS, REQUIRED_WORDS, GUIDE_WORDS, POLITE_WORDS = ("名前", "氏名", "会社", "メール", "電話", "住所", "件名", "本文", "郵便", "name", "mail", "company", "phone"), ("必須", "※", "*"), ("入力", "記入", "例"), ("ください", "お願い", "ご")
NOISE = r"^[0-9\s]*$|copyright|©|all rights reserved"
# fixed values: a fatal capacity event
CAPACITY = ("resource exhausted", "capacity", "quota", "preempt", "spot", "unavailable")


def _some(c: Column, words: tuple) -> Column:
    return reduce(lambda a, b: a | b, (c.contains(w) for w in words))


def visibility_penalty(visible: Column, enabled: Column, style: Column, kind: Column, aria_hidden: Column, tabindex: Column) -> Column:
    """Each sign of a hidden element costs 200, a disabled or unreachable one 100."""
    s = F.lower(F.replace(F.coalesce(style, F.lit("")), F.lit(" "), F.lit("")))
    cost = lambda p, n: F.when(p, n).otherwise(0)
    return (
        cost(~visible, HIDDEN) + cost(~enabled, HIDDEN // 2) + cost(s.rlike(GONE), HIDDEN) + cost(F.lower(kind) == "hidden", HIDDEN) + cost(F.lower(aria_hidden) == "true", HIDDEN)
        + cost(tabindex == "-1", HIDDEN // 2) + cost(s.contains("position:absolute") & s.rlike(TRAP), HIDDEN)
    )


def dynamic_threshold(field: Column, essential_done: Column, essential=("email", "message"), optional=("company", "full_name"), per_field=None, base=70, boost=80, highest=250, quality_first=True) -> Column:
    """The least score of a field: its own, the base for essential fields, and more once the essential ones are filled."""
    own = F.create_map(*[F.lit(x) for kv in (per_field or {"": base}).items() for x in kv])[field]
    more = min(base + boost, highest)
    late = F.when(essential_done >= len(essential), min(base + boost + 50, 400)).otherwise(more)
    rest = F.when(field.isin(*optional), more).otherwise(late) if quality_first else F.lit(base)
    return F.coalesce(own, F.when(field.isin(*essential), base).otherwise(rest))


def structure_similarity(a: Column, b: Column) -> Column:
    """0.3 for the tag, 0.2 the type, 0.3 the parent's tag, 0.2 times the overlap of classes."""
    x, y = (F.filter(F.array_distinct(F.split(F.coalesce(e["classes"], F.lit("")), r"\s+")), lambda c: c != "") for e in (a, b))
    both = (F.size(x) > 0) & (F.size(y) > 0)
    overlap = F.when(both, F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))).otherwise(0.0)
    hit = lambda p, w: F.when(p, w).otherwise(0.0)
    return hit(a["tag"] == b["tag"], 0.3) + hit(a["type"] == b["type"], 0.2) + hit(a["parent"] == b["parent"], 0.3) + overlap * 0.2


def context_score(text: Column, base: Column) -> Column:
    """0 for noise and texts of under 2 or over 200 characters; else the base and the bonuses, at most 1."""
    low = F.lower(F.trim(text))
    bonus = F.when(_some(low, FIELD_WORDS), 0.3).otherwise(0.0) + F.when(_some(text, REQUIRED_WORDS), 0.2).otherwise(0.0) + F.when(_some(text, GUIDE_WORDS), 0.15).otherwise(0.0) + F.when(_some(text, POLITE_WORDS), 0.1).otherwise(0.0)
    bad = text.isNull() | ~F.length(F.trim(text)).between(2, 200) | low.rlike(NOISE)
    return F.when(bad, 0.0).otherwise(F.least(F.lit(1.0), base + bonus))


def best_contexts(texts: DataFrame, key: str, top: int = 5, least: float = 0.3) -> DataFrame:
    """The best distinct texts (without regard to case) around each element."""
    text = F.lower(F.trim("text"))
    first = Window.partitionBy(key, text).orderBy(F.desc(F.round("score", 6)), "position")
    rank = Window.partitionBy(key).orderBy(F.desc(F.round("score", 6)), "position")
    once = texts.where(F.col("score") >= least).withColumn("r", F.row_number().over(first)).where("r = 1")
    return once.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= top).withColumnRenamed("r", "rank")


def contained(cells: DataFrame, elements: DataFrame, group: str) -> DataFrame:
    """Pairs of an element and the smallest cell of the group that holds its box (x, y, w, h)."""
    c = cells.select(group, F.col("id").alias("cell"), *[F.col(k).alias(f"c{k}") for k in "xywh"])
    inside = "x >= cx and y >= cy and x + w <= cx + cw and y + h <= cy + ch"
    pairs = elements.join(c, group).where(inside)
    return pairs.groupBy(group, F.col("id").alias("element")).agg(F.min_by("cell", F.struct((F.col("cw") * F.col("ch")).alias("area"), "cell")).alias("cell"))


def reading_order(elements: DataFrame, group: str) -> DataFrame:
    """order by y * 1000 + x; gap to the box before; adjacent: in the same line and near."""
    w = Window.partitionBy(group).orderBy(F.col("y") * 1000 + F.col("x"), "id")
    before_end, before_y = F.lag(F.col("x") + F.col("w")).over(w), F.lag("y").over(w)
    placed = elements.withColumns({"order": F.row_number().over(w), "gap": F.col("x") - before_end, "line": F.abs(F.col("y") - before_y) <= 10})
    return placed.withColumn("adjacent", F.coalesce(F.col("line") & F.col("gap").between(0, 50), F.lit(False))).drop("line")


def grid(boxes: DataFrame, group: str) -> DataFrame:
    """boxes (group, pos, x0, x1, y0, y1) with line and col: boxes whose intervals overlap, one by one, are in one line or column. A sweep
    along each axis: a line ends where the next box begins below all boxes before it."""

    def swept(rows: DataFrame, low: str, high: str, name: str) -> DataFrame:
        order = Window.partitionBy(group).orderBy(low, "pos")
        reach = F.max(high).over(order.rowsBetween(Window.unboundedPreceding, -1))
        opens = F.coalesce(F.col(low) > reach, F.lit(True)).cast("long")
        marked = rows.withColumn(f"__{name}", opens)
        return marked.withColumn(name, F.sum(f"__{name}").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop(f"__{name}")

    return swept(swept(boxes, "y0", "y1", "line"), "x0", "x1", "col")


def line_advice(cells: DataFrame, group: str = "form") -> DataFrame:
    """cells of a grid with in_line (how many fields a line has) and advice: two to four texts, each in its column, are parts of one value."""
    line = Window.partitionBy(group, "line")
    columns, n = F.size(F.collect_set("col").over(line)), F.count("*").over(line)
    texts = F.count_if(F.col("type").isin("text", "tel")).over(line)
    advice = F.when(texts.between(2, 4) & (columns == n), "combine").when(n > 1, "beside").otherwise("alone")
    return cells.withColumns({"in_line": n, "advice": advice})


def prohibition_confidence(n_texts: Column, n_negated: Column, n_combined: Column, targeted: Column) -> tuple[Column, Column]:
    """(score, level): 75 in telling places or 60, plus 10 a refusal, 15 a sales word with one, 10 or 5 for several texts; at most 100."""
    score = F.least(F.lit(100), F.when(targeted, 75).otherwise(60) + 10 * n_negated + 15 * n_combined + F.when(n_texts >= 3, 10).when(n_texts == 2, 5).otherwise(0))
    score = F.when(n_texts > 0, score).otherwise(0)
    return score, F.when(n_texts == 0, "none").when(score >= 90, "high").when(score >= 70, "medium").when(score >= 50, "low").otherwise("very_low")


def spot_fallback(descriptions: Column) -> Column:
    return F.exists(descriptions, lambda t: _some(F.lower(t), CAPACITY))


def event_summary(descriptions: Column) -> Column:
    """Non-empty descriptions joined by '; ', 512 characters at most; null without any."""
    texts = F.filter(F.transform(descriptions, lambda t: F.trim(t)), lambda t: t != "")
    return F.when(F.size(texts) > 0, F.substring(F.array_join(texts, "; "), 1, 512))


def config_errors(email: Column, start: Column, end: Column, days: Column, max_daily: Column) -> Column:
    """The names of the rules that a client's settings break."""
    clock = r"^([01]\d|2[0-3]):[0-5]\d$"
    rules = {
        "email": F.coalesce(email.rlike(r"^[^@\s]+@[^@\s]+\.[a-z]+$"), F.lit(False)), "start": F.coalesce(start.rlike(clock), F.lit(False)), "end": F.coalesce(end.rlike(clock), F.lit(False)),
        "order": F.coalesce(start < end, F.lit(False)), "days": F.coalesce(F.forall(days, lambda d: d.between(0, 6)), F.lit(False)), "max_daily": F.coalesce(max_daily.between(1, 10_000), F.lit(False)),
    }
    return F.filter(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules.items()]), lambda x: x.isNotNull())


def worker_errors(c: Column) -> Column:
    """The names of the rules that a worker's settings (a struct of num_workers, max_workers, batch_size, max_pending_tasks, memory_per_worker_mb, page_load, element_wait, pre_processing_max) break."""
    rules = {
        "num_workers": c["num_workers"].isNull() | (c["num_workers"] >= 1), "max_workers": c["num_workers"].isNull() | c["max_workers"].isNull() | (c["max_workers"] >= c["num_workers"]),
        "max_pending_tasks": F.coalesce(c["max_pending_tasks"] >= c["batch_size"] * c["num_workers"] * 2, F.lit(True)),
        "memory": F.coalesce(c["memory_per_worker_mb"] * c["num_workers"] + 2048 <= 10240, F.lit(True)) & F.coalesce(c["memory_per_worker_mb"] <= 2048, F.lit(True)),
        "page_load": F.coalesce(c["page_load"], F.lit(0)) <= F.coalesce(c["pre_processing_max"], F.lit(0)), "element_wait": F.coalesce(c["element_wait"], F.lit(0)) <= F.coalesce(c["pre_processing_max"], F.lit(0)),
    }
    return F.filter(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules.items()]), lambda x: x.isNotNull())
