"""Semantics that are easy to get wrong, one test each; those not here are in test_rules.py and test_streams_and_files.py."""

from pyspark.sql import functions as F

from leadloom.functions import dates, numbers, redaction, text, urls
from leadloom.operators import errors, forms, mapping, scoring, stats, targeting
from leadloom.sources.views import companies, submissions

DATA = "/root/testdata/sf0.001"
COMPANY = "id long, company_name string, form_url string, black boolean, prohibition_detected boolean, duplication boolean"


def test_outcomes_that_are_all_null_are_kept_by_the_queue_and_dropped_by_the_history(spark):
    """2: bool_or of nulls is null."""
    h = spark.createDataFrame([(1, 1, None), (1, 2, False), (1, 3, True)], "targeting_id long, company_id long, success boolean").withColumn("submitted_at", F.lit("2023-01-01").cast("timestamp_ntz"))
    won = h.groupBy("company_id").agg(F.bool_or("success").alias("won"))
    assert {r.company_id for r in won.where("won = false").collect()} == {2}
    c = spark.createDataFrame([(k, f"n{k}", "u", None, None, None) for k in (1, 2, 3)], COMPANY)
    assert {r.id for r in targeting.retry_candidates(c, h, 1, "2024-01-01").collect()} == {1, 2}


def test_flags_have_three_states(spark):
    """3: false is not null, but for prohibition."""
    rows = [(1, "a", "u", None, None, None), (2, "a", "u", False, None, None), (3, "a", "u", None, False, None), (4, "a", "u", None, None, False), (5, "a", "u", None, True, None), (6, None, "u", None, None, None)]
    c = spark.createDataFrame(rows, COMPANY)
    assert {r.id for r in c.where(targeting.eligible() & targeting.name_allowed()).collect()} == {1, 3}


def test_failures_count_for_all_targetings_and_null_is_a_failure(spark):
    """5 and 6: the window is a parameter."""
    c = spark.createDataFrame([(k, "n", "u", None, None, None) for k in (1, 2, 3)], COMPANY)
    h = spark.createDataFrame([(9, 1, None, "2024-01-20"), (9, 2, True, "2024-01-20"), (9, 3, False, "2024-01-02")], "targeting_id long, company_id long, success boolean, day string")
    h = h.withColumn("submitted_at", F.col("day").cast("timestamp_ntz"))
    assert {r.id for r in targeting.fresh_candidates(c, h, 1, "2024-01-21").collect()} == {2}
    assert {r.id for r in targeting.fresh_candidates(c, h, 1, "2024-01-21", failure_days=7).collect()} == {2, 3}


def test_the_last_days_are_japan_days_without_today(spark):
    """7: [day - 14, day) as instants."""
    times = ["2024-01-14 14:59:59", "2024-01-14 15:00:00", "2023-12-31 15:00:00", "2023-12-31 14:59:59"]
    df = spark.createDataFrame([(t,) for t in times], "t string").select(F.col("t").cast("timestamp_ntz").alias("t"))
    assert [r[0] for r in df.select(dates.between_days(F.col("t"), "2024-01-15", -14, 0)).collect()] == [True, False, True, False]


def test_the_cap_is_in_the_code(spark):
    """8: 10,000 rows, whatever a daily limit says."""
    import inspect

    assert targeting.LIMIT == 10_000 and "max_daily" not in inspect.signature(targeting.build_queue).parameters
    assert targeting.build_queue(companies(spark, DATA), submissions(spark, DATA), 1, "2024-03-15").count() > 0


def test_rules_of_the_unreadable_file_are_off(spark):
    """11."""
    row = spark.createDataFrame([("request throttled",)], "m string").select(errors.network_class(F.col("m"), F.lit("")), errors.network_class(F.col("m"), F.lit(""), more_rules=True)).first()
    assert list(row) == [None, "RATE_LIMIT"]


def test_three_ways_to_round(spark):
    """12: halves to even, up, and away from zero."""
    row = spark.createDataFrame([("0.025億円", 2, 16)], "t string, a long, b long").select(numbers.capital_millions(F.col("t")), stats.half_up(F.lit(-2.5)), stats.rate(F.col("a"), F.col("b"), 1)).first()
    assert list(row) == [2, -2, 12.5]


def test_the_last_choice_and_the_first_rule_win(spark):
    """14."""
    df = spark.createDataFrame([(["その他", "x", "その他"], "submit button not found, validation error")], "t array<string>, m string")
    assert list(df.select(mapping.pick(F.col("t"), ["その他"]), errors.message_rule(F.col("m"))).first()) == [2, "SUBMIT_BUTTON"]
    kept = spark.createDataFrame([(["abcde", "vwxyz", "abcd"],)], "t array<string>").select(text.distinct_longest(F.col("t"))).first()[0]
    assert kept == ["abcde", "vwxyz"]


def test_capitals_never_match_a_lowered_text(spark):
    """15."""
    df = spark.createDataFrame([("Acme Corp works",), ("acme.com works",)], "t string")
    assert [r[0] for r in df.select(redaction.suspicious(F.col("t"))).collect()] == [False, True]


def test_a_field_has_one_rule():
    """16."""
    names = [f for f, *_ in forms.FIELDS]
    assert len(names) == len({*names}) and len(mapping.PRIORITY) == 24


def test_any_other_address_is_a_change_unless_asked_strictly(spark):
    """17."""
    df = spark.createDataFrame([("https://a.example/x", "https://a.example/x#sent"), ("https://a.example/x", "https://a.example/y")], "a string, b string")
    assert [list(r) for r in df.select(urls.changed(F.col("a"), F.col("b")), urls.changed(F.col("a"), F.col("b"), strict=True)).collect()] == [[True, False], [True, True]]


def test_found_errors_fail_but_for_compatibility(spark):
    """18."""
    no, one, zero = F.lit(False), F.lit(1), F.lit(0)
    judged = [scoring.judge(no, no, no, one, no, no, no, zero, one, one, F.lit(10), F.lit(10), compat=c) for c in (False, True)]
    row = spark.range(1).select(judged[0].alias("a"), judged[1].alias("b")).first()
    assert (row.a.success, round(row.a.confidence, 2), row.a.stage) == (False, 0.71, 5) and (row.b.success, row.b.confidence, row.b.stage) == (True, 0.72, 5)
