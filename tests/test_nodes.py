"""Pages as nodes, trees before and after, crawls, modes of tables, and texts that are no documents."""

import pytest
from pyspark.sql import functions as F

from leadloom.functions import html, nodes, redaction
from leadloom.operators import elements, scoring, snapshots
from leadloom.sources import modes

PAGE = """<html><body><h1>Top <b>title</b></h1><p>one<div>two<ul><li><a href=a>A</a><li>B<ol><li><a href=b>x</a></ol></ul></div></stray>
<form><label for=n>Name</label><input id=n name=n><label>Mail <input name=m></label><table><tr><th>Tel<td><input name=t></table><dl><dt>Zip<dd><textarea name=z></textarea></dl><input name=none></form>
<script>if (a < b) { "</p>" }</script></body></html>"""


@pytest.fixture(scope="module")
def known(spark):
    deep = "<div>" * 300 + "<a href=deep>d</a>" + "</div>" * 300
    rows = [(1, PAGE), (2, deep), (3, None), (4, ""), (5, "no tags")]
    return nodes.node_table(spark.createDataFrame(rows, "page long, html string"), "page").cache()


def test_numbers_hold_what_is_inside(known):
    rows = {r.pre: r for r in known.where("page = 1").collect()}
    assert sorted(rows) == list(range(len(rows)))
    for r in rows.values():
        if r.parent is not None:
            up = rows[r.parent]
            assert up.pre < r.pre <= r.last <= up.last and r.depth == up.depth + 1
    tags = [rows[k].tag for k in sorted(rows)]
    assert tags.count("li") == 3 and "#text" in tags and not any(r.text and "<" in r.text for r in rows.values())
    # a paragraph ends before a block, an item before the next item of its list only
    p, div = (next(r for r in rows.values() if r.tag == t) for t in ("p", "div"))
    assert p.last < div.pre
    first, second, inner = (r for _, r in sorted(rows.items()) if r.tag == "li")
    assert first.last < second.pre < inner.pre <= second.last
    assert known.where("page in (3, 4)").count() == 0 and known.where("page = 5").count() == 1
    assert known.where("page = 2").agg(F.max("depth")).first()[0] == 301


def test_nearest_and_labels(known):
    links = known.where("tag = 'a' and page = 1").select("page", "pre")
    lists = known.where(F.col("tag").isin(*nodes.LISTS)).select("page", "pre", "last", "tag")
    assert [r.tag for r in nodes.nearest_around(links, lists, "page", "tag").orderBy("pre").collect()] == ["ul", "ol"]
    heads = known.where("tag = 'h1'")
    assert [r.said for r in nodes.texts_of(heads, known, "page").collect()] == ["Top title"]
    found = nodes.labels(known.where("page = 1"), "page").orderBy("pre").collect()
    assert [(r.label, r.source) for r in found] == [("Name", "for"), ("Mail", "around"), ("Tel", "row"), ("Zip", "term"), (None, None)]


def test_deep_pages_keep_their_places():
    deep = "<footer>" + "<div>" * 100 + "a notice at the foot" + "</div>" * 100 + "</footer><p>and more text behind it</p>"
    assert html.read(deep)[1] == "a notice at the foot"


def test_trees_differ_by_what_changed(spark):
    was, now = "<div><p>a</p><p>a</p><p>b</p></div>", "<div><p>b</p><p>a</p><i class=x>c</i></div>"
    old, new = (nodes.node_table(spark.createDataFrame([(1, p)], "k long, html string"), "k") for p in (was, now))
    rows = snapshots.difference(old, new, "k").collect()
    # one paragraph with its text went; an element with its text came; what holds them is another one
    assert (sum(r.gone for r in rows), sum(r.added for r in rows)) == (3, 3)
    assert snapshots.difference(old, old, "k").count() == 0


def test_addresses_and_titles_decide_in_three_ways(spark):
    cases = [("https://a/x", "https://a/x", None), ("https://a/x", "https://a/thanks", True), ("https://a/x", "https://a/error", False), ("https://a/x", "https://a/x?success=1", True), ("https://a/x?error=1", "https://a/y?error=2", None), ("https://a/x", "https://a/x?failed", False)]
    df = spark.createDataFrame([c[:2] for c in cases], "b string, a string")
    assert [r[0] for r in df.select(snapshots.address_change(F.col("b"), F.col("a"))).collect()] == [c[2] for c in cases]


def test_the_plan_of_a_crawl_does_not_grow_with_its_rounds(spark):
    start = spark.createDataFrame([(1, "/")], "site long, url string")
    links = spark.createDataFrame([(1, f"/{k}" if k else "/", f"/{k + 1}", 200, 0) for k in range(12)], "site long, page string, url string, score int, dom_index int")
    sizes = []
    for rounds in (2, 8):
        found = scoring.crawl(start, links, rounds=rounds)
        assert found.count() == rounds + 1
        sizes.append(len(found._jdf.queryExecution().analyzed().toString()))
    assert sizes[0] == pytest.approx(sizes[1], rel=0.1)


def test_modes_of_tables():
    assert [modes.mode_of(s) for s in ({}, {"TEST_MODE": "True"}, {"COMPANY_TABLE": "companies_extra"}, {"TABLE_MODE": "extra", "TEST_MODE": "true"})] == ["primary", "test", "extra", "extra"]
    with pytest.raises(ValueError, match="unknown"):
        modes.mode_of({"TABLE_MODE": "odd"})


def test_texts_that_are_no_documents_are_redacted(spark):
    df = spark.createDataFrame([("not json a@b.example",), ('{"name": "x"}',), (None,), ("[" * 5000,)], "t string")
    got = [r[0] for r in df.select(redaction.redacted_json(F.col("t"))).collect()]
    assert got == ["not json ***EMAIL_REDACTED***", '{"name":"***REDACTED***"}', None, "[" * 5000]


def test_grids_of_boxes(spark):
    boxes = [(1, 1, "text", 0, 50, 0, 20), (1, 2, "text", 60, 90, 5, 25), (1, 3, "tel", 100, 150, 22, 30), (1, 4, "text", 0, 40, 40, 60), (2, 1, "select", 0, 9, 0, 9)]
    df = spark.createDataFrame(boxes, "form long, pos int, type string, x0 int, x1 int, y0 int, y1 int")
    got = {(r.form, r.pos): (r.line, r.col, r.in_line, r.advice) for r in elements.line_advice(elements.grid(df, "form")).collect()}
    assert got == {(1, 1): (1, 1, 3, "combine"), (1, 2): (1, 2, 3, "combine"), (1, 3): (1, 3, 3, "combine"), (1, 4): (2, 1, 1, "alone"), (2, 1): (1, 1, 1, "alone")}
