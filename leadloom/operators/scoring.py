"""Scores and classes by rule tables: links, errors, prohibition, success, forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.functions import html, urls
from leadloom.sources import files

# fixed values: words that speak against a link, and names of contact pages
NEGATIVE_TEXT = "採用|求人|応募|recruit|career|privacy policy|サイトマップ|newsletter|download|ダウンロード|login|ログイン|password|パスワード"
LEAST_SCORE = 100
CONTACT_NAMES = "お問い合わせ|お問合せ|問い合わせ|toiawase|contact|inquiry"

def page_links(pages: DataFrame) -> DataFrame:
    """page_id, url, dom_index, href, text of the anchors, as the parser finds them."""
    rows = pages.select("page_id", "url", F.posexplode(html.links(F.col("html"))).alias("dom_index", "l"))
    return rows.select("page_id", "url", "dom_index", "l.href", "l.text")


def boosted(links: DataFrame, least: int = LEAST_SCORE) -> DataFrame:
    """Links (page_id, dom_index, text, href, score) that reach the least score; of a page without any, those that name contact and nothing negative, at a high score."""
    named = F.concat_ws(" ", F.lower("text"), F.lower("href"))
    wanted = named.rlike(CONTACT_NAMES) & ~named.rlike(NEGATIVE_TEXT)
    good = links.where(F.col("score") >= least)
    without = links.join(good.select("page_id").distinct(), "page_id", "left_anti").where(wanted)
    return good.unionByName(without.withColumn("score", F.lit(max(least + 500, 600)).cast(links.schema["score"].dataType)))


def crawl(start: DataFrame, links: DataFrame, rounds: int = 6, least: int = LEAST_SCORE) -> DataFrame:
    """site, step, url, score: the order in which a best-first crawl visits recorded links.

    start: site, url. links: site, page, url, score, dom_index. In each round every site takes its best open link (score, then the page's
    step, then place in the page), and the links of that page join the open ones; no url is visited twice, and a site
    stops when no link reaches the least score.
    """
    # each round reads what the rounds before it wrote, so that its plan is the same however many there were
    taken = start.select("site", F.lit(0).alias("step"), "url", F.lit(0).cast("int").alias("score"))
    visited = files.written(taken, "crawl")
    known = files.written(links.where(F.col("score") >= least).select("site", F.col("page"), "url", F.col("score").cast("int"), "dom_index"), "crawl-links")
    schema, paths = visited.schema, visited.inputFiles()
    for step in range(1, rounds + 1):
        seen = visited.select("site", F.col("url").alias("page"), F.col("step").alias("at"))
        open_ = known.join(seen, ["site", "page"]).join(visited.select("site", "url"), ["site", "url"], "left_anti")
        best = F.struct("score", (-F.col("at")).alias("a"), (-F.col("dom_index")).alias("d"), "url")
        found = open_.groupBy("site").agg(F.max(best).alias("b")).select("site", F.lit(step).alias("step"), "b.url", "b.score")
        paths = [*paths, *files.written(found, "crawl").inputFiles()]
        visited = start.sparkSession.read.schema(schema).parquet(*paths)
    return visited


def ranked_links(links: DataFrame, top: int = 3) -> DataFrame:
    """The best links of each page by score, then by place in the page; no link twice."""
    w = Window.partitionBy("page_id").orderBy(F.desc("score"), "dom_index")
    return links.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def http_priority(statuses: Column) -> Column:
    """429, then 403, then the first 5xx, then the last."""
    servers = F.filter(statuses, lambda s: s.between(500, 599))
    return F.when(F.array_contains(statuses, 429), 429).when(F.array_contains(statuses, 403), 403).when(F.size(servers) > 0, F.get(servers, F.lit(0))).otherwise(F.try_element_at(statuses, F.lit(-1)))


def abort_early(level: Column, confidence: Column, score: Column, matches: Column) -> Column:
    """The level is moderate or more (an unknown one counts as moderate), or confidence is high, or there are two matches."""
    index = F.when(F.lower(level) == "weak", 0).when(F.lower(level) == "mild", 1).when(F.lower(level) == "strict", 3).otherwise(2)
    return (index >= 2) | (F.lower(F.coalesce(confidence, F.lit(""))) == "high") | (F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)) >= 80) | (matches >= 2)


def prohibition_level(score: Column) -> Column:
    return F.when(score >= 0.9, "strict").when(score >= 0.7, "moderate").when(score >= 0.5, "mild").when(score > 0, "weak").otherwise("none")


def consent_score(text: Column, distance: Column) -> Column:
    """0 with a negative word; else the words of consent and privacy, and how near the box is."""
    t = F.lower(text)
    score = (
        F.when(t.rlike("同意|agree|accept|consent"), 2.5).otherwise(0.0)
        + F.least(F.lit(3.0), F.when(t.rlike("プライバシー|privacy"), 1.5).otherwise(0.0) + F.when(t.rlike("規約|terms"), 1.0).otherwise(0.0) + F.when(t.rlike("個人情報|personal"), 1.0).otherwise(0.0))
        + F.greatest(F.lit(0.0), F.lit(2.0) - distance / 100.0)
    )
    return F.when(t.rlike("メルマガ|newsletter|配信"), F.lit(0.0)).otherwise(score)


def judge(prohibition, bot, visible_error, required_or_retry, url_changed, success_path, other_host, success_texts, forms_before, forms_now, elements_before, elements_now, compat: bool = False, headlines=None, buttons=None, siblings=None, disabled=None) -> Column:
    """struct<success, confidence, stage>: the first stage that decides. Texts, forms and elements are those of one snapshot, so that the guard after a new
    address asks what was asked before it. headlines (elements that say success), buttons (visible ones that send), siblings (new elements of success
    beside the form), disabled (elements): counts, left out where they are not known.

    A page with errors that nothing else explains (stage 5) is a failure; with ``compat`` it counts as a success of 0.72, and so does
    what no stage decides, as the surveyed code has it.
    """

    def out(success, confidence, stage):
        return F.struct(F.lit(success).alias("success"), (F.lit(confidence) if not isinstance(confidence, Column) else confidence).cast("double").alias("confidence"), F.lit(stage).alias("stage"))

    shrink = F.when(elements_before > 0, 1 - elements_now / elements_before).otherwise(F.lit(0.0))
    decided = (
        F.when(prohibition, out(False, 1.0, 0)).when(bot, out(False, 0.95, 0)).when(visible_error, out(False, 0.9, 0))
        .when((required_or_retry >= 2) & (success_texts == 0) & ~success_path, out(False, 0.85, 0))
        .when(url_changed, out(True, F.when(success_path, 0.95).when(other_host, 0.85).otherwise(0.90), 1))
        .when(success_texts > 0, out(True, F.least(F.lit(0.95), 0.88 + F.least(0.02 * success_texts, F.lit(0.07))), 2))
    )
    if headlines is not None:
        decided = decided.when(headlines > 0, out(True, 0.85, 2))
    decided = decided.when((forms_before > 0) & (forms_now == 0), out(True, 0.85, 3)).when(shrink > 0.5, out(True, F.least(F.lit(0.83), 0.75 + 0.1 * shrink), 3))
    if buttons is not None:
        decided = decided.when(buttons == 0, out(True, 0.78, 3))
    if siblings is not None:
        decided = decided.when(siblings > 0, out(True, F.least(F.lit(0.80), 0.77 + F.least(0.01 * siblings, F.lit(0.03))), 4))
    if disabled is not None:
        decided = decided.when(disabled > 0, out(True, 0.75, 4))
    if compat:
        return decided.otherwise(out(True, 0.72, 5))
    return decided.when(required_or_retry > 0, out(False, F.least(F.lit(0.75), 0.70 + 0.01 * required_or_retry), 5)).otherwise(out(True, 0.65, 6))


def running_errors(events: DataFrame, key: str, order: list[str], failed: Column, limit: int = 3) -> DataFrame:
    """streak: consecutive failures up to each row; stop: the limit is reached."""
    w = Window.partitionBy(key).orderBy(*order)
    block = F.sum(F.when(failed, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = events.withColumn("__block", block).withColumn("__fail", failed)
    streak = F.sum(F.when(F.col("__fail"), 1).otherwise(0)).over(Window.partitionBy(key, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("streak", streak).withColumn("stop", F.col("streak") >= limit).drop("__block", "__fail")
