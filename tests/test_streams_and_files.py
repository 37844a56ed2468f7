import json
from collections import defaultdict

from conftest import DATA
from pyspark.sql import functions as F

from leadloom.functions import html
from leadloom.operators import forms, queue_state
from leadloom.plans import streams
from leadloom.sources import files
from leadloom.streaming import leases


def test_leases_equal_a_replay(spark):
    rows = spark.read.parquet(f"{DATA}/events.parquet").selectExpr("user_id", "cast(cast(ts as timestamp) as double) at", "event_id", "event_type").collect()
    by = defaultdict(list)
    for r in rows:
        by[r.user_id].append((r["at"], r.event_id, r.event_type))
    got = {r.owner: (r.claims, r.done, r.failed, r.expired, r.refused) for r in streams.stream_lease_counts(spark, DATA).collect()}
    clock = max(r["at"] for r in rows) - 600  # the watermark
    assert got == {k: leases.replay(v, until=clock)[1:] for k, v in by.items()}


def test_a_lease_expires_and_is_not_ended_twice():
    rows = [(0.0, 1, "view"), (10.0, 2, "view"), (20.0, 3, "purchase"), (30.0, 4, "purchase"), (40.0, 5, "view"), (40.0 + leases.LEASE_S + 1, 6, "error")]
    assert leases.replay(rows) == (-1.0, 2, 1, 0, 1, 3 - 1 + 0 + 1)


def test_sheets_and_lines(spark, tmp_path):
    (tmp_path / "s.csv").write_text("id,name\n1,a\n")
    assert files.read_sheet(spark, f"file://{tmp_path}/s.csv", ["id"]).count() == 1
    try:
        files.read_sheet(spark, f"file://{tmp_path}/s.csv", ["id", "gone"])
        raise AssertionError
    except ValueError as e:
        assert "gone" in str(e)
    lines = [json.dumps({"custom_id": "company_7", "status": 200, "body": b}) for b in (None, "{}", "{\"a\":1}", "{bad")] + ["not json", "", json.dumps({"custom_id": "company_8", "status": 500})]
    (tmp_path / "r.jsonl").write_text("\n".join(lines))
    rows, bad = files.read_lines(spark, f"file://{tmp_path}/r.jsonl")
    assert rows.count() == 5 and [r[0] for r in bad.collect()] == ["not json"]
    assert sorted(r.kind for r in files.result_status(rows).collect()) == ["empty_form_elements", "invalid_json", "no_choices", "success"]
    assert files.newest_file(spark, f"file://{tmp_path}/*").endswith((".csv", ".jsonl"))


def test_requests_leave_incomplete_prompts_out(spark, tmp_path):
    df = spark.createDataFrame([(1, "s", "u"), (2, None, "u"), (3, "s", " ")], "company_id long, system string, user string")
    assert {r[0] for r in files.write_requests(df, f"file://{tmp_path}/out", "m").collect()} == {2, 3}
    line = json.loads(spark.read.text(f"file://{tmp_path}/out").first()[0])
    assert line["custom_id"] == "company_1" and line["body"]["messages"][1]["content"] == "u"


def test_facts_lie_by_japan_day(spark, tmp_path):
    df = spark.sql("select timestamp_ntz'2024-01-01 14:59:59' submitted_at union all select timestamp_ntz'2024-01-01 15:00:00'")
    files.append_facts(df, f"file://{tmp_path}/facts")
    files.append_facts(df, f"file://{tmp_path}/facts")
    assert sorted(str(r.jst_date) for r in spark.read.parquet(f"file://{tmp_path}/facts").collect()) == ["2024-01-01"] * 2 + ["2024-01-02"] * 2


def test_forms_of_a_page(spark):
    page = "<body><script>x()</script><form action=/s><label>Name<input name=your-name required></label><input type=email name=mail><textarea name=message></textarea><button>Send it</button></form><a href='/c'>Contact <b>us</b></a></body>"
    df = spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")
    row = df.select(html.page_text(F.col("html")).alias("t"), html.forms(F.col("html")).alias("f"), html.links(F.col("html")).alias("l")).collect()
    assert row[0].t == "Name Send it Contact us" and row[0].l[0].href == "/c" and row[0].l[0].text == "Contact us"
    assert [i.name for i in row[0].f[0].inputs] == ["your-name", "mail", "message"] and row[0].f[0].inputs[0].required and row[1].f == []
    best = forms.best_forms(df, html.forms(F.col("html")))
    assert {(r.field, r.element) for r in forms.assign_fields(forms.element_scores(best)).collect()} == {("full_name", 0), ("email", 1), ("message", 2)}


def test_split_values(spark):
    one = spark.createDataFrame([("090-1234-5678", "03-1234-5678", "123-4567")], "m string, t string, p string")
    row = one.select(forms.split_value(F.col("m"), 3), forms.split_value(F.col("t"), 3), forms.split_value(F.col("p"), 2)).first()
    assert [list(x) for x in row] == [["090", "1234", "5678"], ["03", "1234", "5678"], ["123", "4567"]]


def test_lock_key_is_a_signed_number(spark):
    import hashlib

    day = spark.sql("select 7L id, date'2024-01-02' d").select(queue_state.lock_key(F.col("id"), F.col("d"))).first()[0]
    assert day == int.from_bytes(hashlib.md5(b"7:20240102").digest()[:8], "big", signed=True)


def test_a_queue_that_holds_rows_fills_up_to_the_limit(spark):
    from leadloom.operators import targeting
    from leadloom.sources.views import companies, submissions

    c, s, day = companies(spark, DATA), submissions(spark, DATA), "2024-03-15"
    whole = targeting.build_queue(c, s, 1, day, limit=40)
    rows = [(r.company_id, r.priority) for r in whole.orderBy("priority").collect()]
    assert [p for _, p in rows] == list(range(1, len(rows) + 1)) and len(rows) <= 40
    held = whole.where("priority <= 5")
    more = targeting.build_queue(c, s, 1, day, limit=40, queue=held)
    ids = {r.company_id for r in more.collect()}
    assert not ids & {i for i, p in rows if p <= 5} and len(ids) + 5 <= 40
