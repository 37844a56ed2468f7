"""Small cases of what a reviewer found on larger tables."""


import duckdb
import pytest
from compare import same
from conftest import DATA
from pyspark.sql import functions as F

from leadloom.functions import documents, html, markup, nodes, text
from leadloom.operators import prohibition, scores, snapshots
from leadloom.plans import catalogue, fields, persisted
from leadloom.sources import derived


@pytest.fixture
def against_sql(spark, tmp_path):
    """Holds a query against its SQL on rows of one table."""

    def run(name, table, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
        con = duckdb.connect()
        con.execute(f"create view {table} as select * from read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
        return same(catalogue.QUERIES[name](spark, str(tmp_path)), con.execute(catalogue.ORACLES[name]))

    return run


LINES = (
    "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string"
)


def _line(order, number, part):
    return (order, part, 1, number, 5.0, 100.0, 0.05, 0.02, "R")


def test_half_percents_of_large_forms(against_sql):
    # scores of 90 are those of parts 29 to 58: k of 16, 32 and 80 fields
    rows = [_line(100 * n + k, i, 40 if i <= k else 1) for n in (16, 32, 80) for k in (1, 3, 5, 7) for i in range(1, n + 1)]
    assert against_sql("form_summary", "lineitem", rows, LINES)


def test_cut_references_stay(against_sql):
    pages = [
        (1, "https://a.example/", "<html><head><title>so and&amp</title></head><body><h1>so &amp;amp and&amp</h1><nav>one &quo</nav><ul><li>x &ampx; y &amp; more text</ul><p>p &copy; &quot</p></body></html>"),
        (2, "https://a.example/", "<footer>a &amp b &&amp;& c and more of it</footer><p>&nosuch; &</p>"),
    ]
    assert against_sql("html_text", "pages", pages, "page_id long, url string, html string")


def test_cut_references_in_telling_places(against_sql):
    pages = [(1, "https://a.example/", "<body><footer>at the foot &amp b</footer><nav>places &quo</nav><h1>a long title and&amp</h1><ul><li>x &ampx; y &amp; more text</li></ul></body>")]
    assert against_sql("telling_places", "pages", pages, "page_id long, url string, html string")


def test_separators_of_unicode_are_characters(against_sql):
    odd = "\u3000 \u2003 \u2028 \x85 \x0b \x1c"
    pages = [(1, "https://a.example/", f"<body><h1>\xa0a long{odd} title\t\n</h1><nav>\u3000places to go\u3000</nav><ul><li>x\xa0 \xa0y and more text</li><li>\u3000</li></ul></body>"), (2, "https://a.example/", None)]
    assert against_sql("telling_places", "pages", pages, "page_id long, url string, html string")


def test_spam_is_a_word(against_sql):
    docs = [(k, t) for k, t in enumerate(["ouqueé lespamentelle de la", "le despamenttion de re", "xéspamé, le reste de ceci", None] * 2)]
    assert against_sql("prohibition_scan", "documents", docs, "doc_id long, text string")


def test_spam_still_forbids(spark):
    said = ["spamメールは全て削除します", "we report all spammers at once", "SPAM will be reported 1", "a lespamentelle de la 1"]
    df = spark.createDataFrame([(t,) for t in said], "t string")
    assert [r[0] for r in df.select(prohibition.prohibited(F.col("t"))).collect()] == [True, True, True, False]


def test_a_page_keeps_its_labels_without_an_exchange(spark):
    page = (
        "<label for=a></label><label for=a>A</label><label>outer<label>inner <input id=a></label></label><input id=a><label> <table><tr><th></th><th>head</th><td><input></table></label>"
        "<dl><dd><input></dd><dt>term<dd><input><dd><input></dl><fieldset><legend>x *</legend><legend>y</legend><input></fieldset><dl><dt></dt><dd><textarea></textarea></dl>"
    )
    df = nodes.labels(nodes.node_table(spark.createDataFrame([(1, page), (2, None)], "k long, html string"), "k"), "k")
    got = [(r.label, r.source) for r in df.orderBy("pre").collect()]
    assert got == [("A", "for"), ("A", "for"), ("head", "around"), (None, None), ("term", "term"), ("term", "term"), (None, None), (None, None)]
    plan = nodes.labels(nodes.node_table(spark.createDataFrame([(1, page)], "k long, html string"), "k"), "k")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


@pytest.mark.parametrize("name", ["field_labels", "field_groups"])
def test_forms_are_dealt_once_and_their_inputs_once(spark, name):
    plan = catalogue.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 3


def test_regular_markup_reads_as_the_standard_parser_does():
    class Seen(markup.Markup):
        def __init__(self):
            super().__init__()
            self.seen = []

        def handle_starttag(self, tag, attrs):
            self.seen.append((tag, attrs))

        def handle_endtag(self, tag):
            self.seen.append(tag)

        def handle_data(self, data):
            self.seen.append(("#", data))

    bits = ["<p>", "</P>", "<a href=x/>", "<a b='1' c=\"&amp;y\" D>", "t &lt; u", "&am", "<br/>", "<script>", "a", "</script>", "<title>", "</title>", "<!-- c -->", "<!doctype html>", "<", "< b", "<textarea q>", "</textarea>", "</a x=1>", "<x-y>", "<p a=1\"b\">"]
    for k in range(3000):
        page = "".join(bits[(k * p + q) % len(bits)] for p, q in ((1, 0), (5, 3), (11, 7), (17, 2), (29, 1)))
        slow = Seen()
        slow.feed(markup.whole_references(page))
        slow.close()
        assert Seen.read(page).seen == slow.seen, page


def test_forms_alone_are_those_of_the_whole_record(spark):
    pages = [
        "<form action=x METHOD=Post>a <input name=n required><button>go <b>on</b></button> b<input type=submit value=S><select id=s></select></form><input name=out><form><button type>x</form> y</button>z",
        "<form><script>x</script><noscript>n</noscript>t<label>l<textarea placeholder=p></textarea></label><form><input type=image></form>", "", None,
    ]
    df = spark.createDataFrame([(p,) for p in pages], "p string").select(html.forms(F.col("p")).alias("a"), html.page(F.col("p"))["forms"].alias("b"))
    rows = df.collect()
    assert [r.a for r in rows] == [r.b for r in rows] and len(rows[0].a) == 2
    assert "ArrowEvalPython" in df.select("a")._jdf.queryExecution().executedPlan().toString()


def test_texts_and_links_are_not_held_as_strings(spark):
    df = spark.createDataFrame([("<a href=x>A <b>b</b></a><a>n</a>", "ＡＢc"), (None, None)], "h string, t string").select(html.links(F.col("h")).alias("l"), documents.nfkc_lower(F.col("t")).alias("f"))
    assert [([tuple(x) for x in r.l], r.f) for r in df.collect()] == [([("x", "A b"), (None, "n")], "abc"), ([], None)]


def _analyzed(df) -> str:
    return df._jdf.queryExecution().analyzed().toString()


def test_patterns_and_phrases_are_matched_once_a_row(spark):
    df = spark.createDataFrame([("営業電話はお断りします", [("営業電話はお断り", "p"), (None, "p")])], "s string, t array<struct<text:string,element:string>>")
    assert _analyzed(df.select(prohibition.prohibited(F.col("s")).alias("x"))).count("regexp_extract(") == 1
    levels = df.select(prohibition.phrase_level(prohibition.phrase_matches(F.col("t"))).alias("l"))
    assert _analyzed(levels).count("aggregate(") == 1 and tuple(levels.first().l) == (1, 1, 0.91, "strict")


def test_words_by_heads_are_the_same_words(spark):
    words = [w for w in prohibition.KEYWORDS.split("|") if w.isalpha()]
    df = spark.createDataFrame([(w, k) for w in words for k in (f"x{w}y", w[:-1], w[1:])], "w string, k string")
    assert df.where(F.col("k").rlike(prohibition.by_heads(prohibition.KEYWORDS)) != F.col("k").rlike(prohibition.KEYWORDS)).isEmpty()


def test_a_word_of_a_number_is_one_lookup(spark):
    words = ("a", None, "", "フリガナ")
    df = spark.range(-5, 9).selectExpr("nullif(id, 3) as n")
    rows = df.selectExpr(f"{derived.choose('n', words)} as a", f"{derived.picked('n', words)} as b").collect()
    assert all(r.a == r.b for r in rows)


def test_groups_of_fields_are_told_as_a_page_is_read(spark):
    page = (
        "<input><legend>free *</legend><fieldset><legend>a <b>b</b></legend><legend></legend><p><legend>in p *</legend></p><input><fieldset><legend>c<script>*</script></legend>"
        "<ul><li><select></select><li><input></ul><p><textarea>x</textarea><div></p></div></fieldset><input></fieldset></fieldset><table><tr><td><fieldset><td><input></table><fieldset><legend>open 必須<input>"
    )
    df = spark.createDataFrame([(1, page), (2, None), (3, page)], "k long, html string")
    got = [(r.k, r.pos, r.size, r.legends) for r in nodes.groups(df, "k").orderBy("k", "pos").collect()]
    # as the table of nodes has it
    held = [r for r in nodes.node_table(df, "k").orderBy("k", "pre").collect()]
    inputs = [r for r in held if r.tag in nodes.INPUTS and r.box is not None]
    assert got == [
        (r.k, sum(i.k == r.k and i.pre <= r.pre for i in inputs), sum((i.k, i.box) == (r.k, r.box) for i in inputs), "\n".join(h.legend for h in held if h.legend and (h.k, h.parent) == (r.k, r.box)) or None) for r in inputs
    ]
    assert len(got) == 12 and {r[3] for r in got} >= {"a b", "c"}
    assert "Exchange" not in nodes.groups(df, "k")._jdf.queryExecution().executedPlan().toString()


def test_groups_travel_only_as_fields(spark):
    plan = catalogue.QUERIES["field_groups"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 1


def test_forms_before_and_after_are_judged_without_joins(spark):
    page = lambda title, said, form: f"<title>{title}</title><body>{said}{form}</body>"
    field, go = "<input name=a value=v>", "<button type=submit id=b>Go</button>"
    form, url = f"<form>{field}{go}</form>", "https://a.example/f"
    pairs = [
        (1, page("t", "", form), page("t", "", form)), (2, page("t", "", form), page("t", "<h1>Thank you</h1>", form)), (3, page("t", "", form), page("t", "", "")),
        (4, page("t", "", form), page("t", "", f"<form>{field}<button type=submit id=b disabled>Go</button></form>")), (5, page("t", "", form), page("t", "<div class=form><p class=success>ok</p><p class=success>ok</p></div>", form)),
        (6, page("t", "", form), page("t", "", form.replace("Go", "Go</button><button hidden>x").replace("id=b", 'id=b style="display: none"'))), (7, None, page("t", "", form)), (8, page("t", "", form), None), (9, None, None),
        (10, page("t", "", f"<form>{field}<input name=a value=w></form>{go}"), page("送信完了", "", f"<form><input name=a value><input name=a value=w></form>{go}")),
    ]
    df = spark.createDataFrame([(k, url, url, *p) for k, *p in pairs], "k long, url_before string, url_after string, before string, after string")
    found = snapshots.judged(df, "k")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r.k: (r.success, r.confidence, r.stage, r.state) for r in found.collect()}
    # as the joins of node tables before gave them
    assert got == {
        1: (True, 0.65, 6, None), 2: (True, 0.9, 2, None), 3: (True, 0.85, 3, True), 4: (True, 0.75, 4, True), 5: (True, 0.79, 4, True), 6: (True, 0.78, 3, True), 7: (True, 0.65, 6, True),
        8: (True, 0.85, 3, True), 9: (True, 0.78, 3, None), 10: (True, 0.65, 6, True),
    }


def test_changes_of_the_queue_are_computed_once(spark, monkeypatch):
    seen, merge = [], persisted.VersionedTable.merge

    def noted(self, changes, *a, **k):
        seen.append(changes._jdf.queryExecution().executedPlan().toString())
        return merge(self, changes, *a, **k)

    monkeypatch.setattr(persisted.VersionedTable, "merge", noted)
    catalogue.QUERIES["queue_commit"](spark, DATA)
    assert len(seen) == 3 and not any("Exchange" in plan or "Join" in plan for plan in seen)


def test_parts_of_fields_follow_the_size_of_their_table(spark, monkeypatch):
    monkeypatch.setattr(derived, "PART_BYTES", 10_000)
    plan = derived.fields(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(l_orderkey#" in plan and plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan


def test_an_element_is_scored_once_and_only_offers_go_on_to_its_form(spark):
    df = catalogue.QUERIES["form_assignment"](spark, DATA)
    assert _analyzed(df).count("position:absolute") == 1
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "collect_list(offer" in plan and plan.count("Exchange") == 1


def test_forms_of_rows_are_those_of_arrays(spark, against_sql):
    kind = "tag string, type string, name string, id string, classes string, placeholder string, label string, style string, visible boolean, enabled boolean, required boolean"
    el = lambda **k: tuple(k.get(c.split()[0]) for c in kind.split(", "))
    mail, body, corp = el(tag="input", type="email", name="Mail"), el(tag="textarea", type="textarea", name="body", label="本文"), el(tag="input", type="text", name="corp", required=True)
    forms = [
        [corp, mail, body], [mail, mail], [body, corp, corp, mail, mail], [el(), el(name="CONFIRM-mail", type="email")], [el(tag="div", type="x", classes="corp", required=True)], [el(tag="div", type="x", classes="corp")],
        [el(type="email", name="mail", classes="a reCONFIRMed")], [el(type="email", name="mail", id="ﾌﾘｶﾞﾅ")], [el(type="email", name="mail", placeholder="よみ")], [el(type="textarea", tag="textarea", name="message", label="ホテル")],
        [el(type="email", name="mail", visible=False), el(type="EMAIL", style="opacity: 0; ", name="mail", label="メール", required=True)],
    ]
    rows = spark.createDataFrame([(k, i, e) for k, f in enumerate(forms) for i, e in enumerate(f, 1)], f"form long, pos int, e struct<{kind.replace(' ', ':').replace(',:', ',')}>")
    whole = spark.createDataFrame(list(enumerate(forms)), f"form long, es array<struct<{kind.replace(' ', ':').replace(',:', ',')}>>")
    rules = [fields.RULES[k] for k in (0, 1, 3)]
    got = sorted(map(tuple, scores.assigned_rows(rows, rules).select("form", "a.*").collect()))
    assert got == sorted(map(tuple, whole.select("form", F.explode(scores.assigned(F.col("es"), rules)).alias("a")).select("form", "a.*").collect())) and len(got) == 8
    lines = [(n % 40, n * 7 % 1009, n * 11 % 97, n // 40, float(n % 50 + 1), 100.0, n % 11 / 100, n % 9 / 100, "R" if n % 3 else "N") for n in range(800)]
    assert against_sql("form_assignment", "lineitem", lines, LINES)


def test_plain_words_are_found_as_a_pattern_finds_them(spark):
    df = spark.createDataFrame([(t,) for t in ("", None, "kata", "xkanay", "ｶﾀｶﾅ", "a.b", "Mail", "e-mail", "pq")], "t string")
    for words in ("kana|katakana|hiragana", "mail", "e-?mail|x", "a.b|z", "ｶﾅ|ｶﾀｶﾅ", "p-q|pq"):
        assert df.where(~text.says(F.col("t"), words).eqNullSafe(F.col("t").rlike(words))).isEmpty()
    assert "RLIKE" not in _analyzed(df.select(text.says(F.col("t"), scores.KANA)))
