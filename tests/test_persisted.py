"""Versions of tables, bucketed history and bitmaps of tried companies."""

import pytest
from pyspark.sql import functions as F

from leadloom.operators import targeting
from leadloom.sources import files, history, views
from leadloom.sources.versioned import CommitConflict, VersionedTable

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def held(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t", "id", file_rows=100)
    t.create(spark.range(1000).select("id", F.concat(F.lit("n"), "id").alias("name"), F.lit(0).alias("n")))
    return t


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_a_merge_writes_only_the_files_that_hold_a_key(spark, held):
    before = {r.file for r in held.manifest().collect()}
    assert len(before) >= 10 and held.latest() == 1
    changes = spark.createDataFrame([(5, "five"), (7, None), (2000, "new")], "id long, name string")
    assert held.merge(changes) == 2
    after = {r.file for r in held.manifest().collect()}
    touched = before - after
    assert len(touched) == 1 and {r.file for r in held.touched(changes, 1).collect()} == touched
    now = dict((r[0], r[1:]) for r in rows(held.read()))
    assert len(now) == 1001 and now[5] == ("five", 0) and now[7] == ("n7", 0) and now[2000] == ("new", None)
    assert rows(held.read(1))[5] == (5, "n5", 0) and held.read(1).count() == 1000


def test_updates_only_and_other_rules(spark, held):
    changes = spark.createDataFrame([(1, ""), (2, None), (3000, "x")], "id long, name string")
    held.merge(changes, blank_keeps=True, insert=False)
    assert rows(held.read()) == rows(held.read(1))
    held.merge(changes, insert=False, keep=lambda c, was, new: new)
    now = dict((r[0], r[1]) for r in held.read().collect())
    assert (now[1], now[2], now[3], len(now)) == ("", None, "n3", 1000)
    assert held.missing(changes, "name").collect() == [(3000, "x", None)]
    held.merge(changes.where("false"))
    assert held.latest() == 4 and held.read().count() == 1000


def test_one_of_two_writers_goes_again(spark, held, monkeypatch):
    changes = [spark.createDataFrame([(1, f"by {k}"), (900 + k, f"by {k}")], "id long, name string") for k in (0, 1)]
    merge, raced = VersionedTable._merge, []

    def late(self, *a):
        if not raced:
            raced.append(True)
            merge(VersionedTable(spark, held.path, "id"), changes[1], *a[1:])  # the other writer commits meanwhile
        return merge(self, *a)

    monkeypatch.setattr(VersionedTable, "_merge", late)
    assert held.merge(changes[0]) == 3
    now = dict((r[0], r[1]) for r in held.read().collect())
    assert (now[1], now[900], now[901]) == ("by 0", "by 0", "by 1")
    with pytest.raises(CommitConflict):
        held._commit(3, {})


def test_keys_are_checked_and_empty_tables_are_tables(spark, held, tmp_path):
    for bad in ([(None, "x")], [(1, "x"), (1, "y")]):
        with pytest.raises(ValueError, match="not unique"):
            held.merge(spark.createDataFrame(bad, "id long, name string"))
    with pytest.raises(ValueError, match="not columns"):
        held.merge(spark.createDataFrame([(1, 2)], "id long, other int"))
    none = VersionedTable(spark, f"file://{tmp_path}/e", "k")
    assert none.latest() == 0
    none.create(spark.createDataFrame([], "k string, v int"))
    assert none.read().count() == 0
    none.merge(spark.createDataFrame([("b", 1), ("a", None)], "k string, v int"))
    assert rows(none.read().fillna(-1)) == [("a", -1), ("b", 1)]


def test_history_meets_companies_without_an_exchange(spark):
    known, facts = history.bucketed(views.companies(spark, DATA), "id"), history.bucketed(views.submissions(spark, DATA), "company_id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fresh = targeting.fresh_candidates(known, facts, 1, "2024-03-15")
        retry = targeting.retry_candidates(known, facts, 1, "2024-03-15")
        for df in (fresh, retry):
            df.collect()
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan.split("Initial Plan")[0] and "SortMergeJoin" in plan, plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert rows(fresh) == rows(targeting.fresh_candidates(views.companies(spark, DATA), views.submissions(spark, DATA), 1, "2024-03-15"))


def test_buckets_take_more_facts(spark):
    first = history.bucketed(spark.range(100), "id", 4, "facts_that_grow")
    assert first.count() == 100
    assert history.bucketed(spark.range(100, 150), "id", 4, "facts_that_grow").count() == 150


def test_bitmaps_of_tried_companies(spark):
    ids = [0, 1, 7, 8, 9, 32767, 32768, 32769, 65536, 10**12, None, -5]
    companies = spark.createDataFrame([(i, "c") for i in [*ids, 2, 33000, 10**12 + 1]], "id long, bits string")
    facts = spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids)], "company_id long, day int")
    bits = history.merged(history.tried_bitmaps(facts, "day"))
    left = sorted((r.id for r in history.untried(companies.withColumnRenamed("bits", "name"), bits).collect()), key=str)
    assert left == sorted([2, 33000, 10**12 + 1, None, -5], key=str)
    assert history.tried_bitmaps(facts).count() == len({i // 32768 if i == 0 else 1 + (i - 1) // 32768 for i in ids if i is not None and i >= 0})


def test_newest_and_missing_columns(spark, tmp_path):
    spark.createDataFrame([(1, "x")], "a int, b string").write.option("header", True).csv(f"file://{tmp_path}/s")
    with pytest.raises(ValueError, match="missing columns: c"):
        files.read_sheet(spark, f"file://{tmp_path}/s", ["a", "c"])
