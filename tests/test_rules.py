import pytest
from pyspark.sql import functions as F

from leadloom.functions import numbers, text, urls
from leadloom.operators import errors, links, prohibition, targeting


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values))
    return row.select(column).first()[0]


@pytest.mark.parametrize("said", ["a = 1; drop table x", "id in (select 1)", "1 = 1 -- x", "x union all y", "WITH a", "/* c */ true"])
def test_predicates_that_are_refused(said):
    with pytest.raises(targeting.PredicateError):
        targeting.check_predicate(said)


def test_predicates_that_pass():
    assert targeting.check_predicate(" WHERE capital > 1 ") == "capital > 1"
    assert targeting.check_predicate(None) is None and targeting.check_predicate("created > 1") == "created > 1"


@pytest.mark.parametrize(
    ("said", "code"),
    [("HTTP 429 Too Many Requests", "RATE_LIMIT"), ("net::ERR_NAME_NOT_RESOLVED while navigating", "DNS_ERROR"), ("必須項目を入力してください", "MAPPING"), ("メールアドレスの形式が正しくありません", "VALIDATION_FORMAT"), (None, "SYSTEM")],
)
def test_error_classes(spark, said, code):
    df = spark.createDataFrame([(said,)], "m string")
    assert df.select(errors.submission_error(F.col("m"), F.lit(""), F.lit("#send"))).first()[0] == code


@pytest.mark.parametrize(
    ("said", "millions"),
    [("1,200百万円", 1200), ("1.5億円", 150), ("500千円", 0), ("２，５００千円", 2), ("12,345", 12345), ("非公開", None), ("0.025億円", 2)],
)
def test_capital(spark, said, millions):
    assert one(spark, numbers.capital_millions(F.col("t")), t=said) == millions


@pytest.mark.parametrize(("said", "date"), [("2006年01月", (2006, 1)), ("2006年", (2006, None)), ("2006/13", (None, None)), ("13月", (None, None)), ("２００６年１２月", (2006, 12))])
def test_established(spark, said, date):
    year, month = numbers.established(F.col("t"), 2025)
    row = spark.createDataFrame([(said,)], "t string").select(year, month).first()
    assert tuple(row) == date


@pytest.mark.parametrize(("said", "token", "held"), [("マンション名", "名", False), ("姓名", "姓", True), ("your-name", "name", True), ("username", "name", False)])
def test_token_borders(spark, said, token, held):
    assert one(spark, text.contains_token(F.col("t"), token), t=said) is held


@pytest.mark.parametrize(("said", "hit"), [("営業目的のお問い合わせはお断りします。", True), ("営業時間は9時からです。", False), ("No solicitation please", True), ("Hello", False)])
def test_prohibition(spark, said, hit):
    assert one(spark, prohibition.prohibited(F.col("t")), t=said) is hit


@pytest.mark.parametrize(("href", "out"), [("/document-request", False), ("/post#comment-5", True), ("/recruit", True), ("/contact?recruit=1", False)])
def test_link_exclusion(spark, href, out):
    link = F.struct(F.lit("x").alias("text"), F.col("h").alias("href"), *[F.lit("").alias(k) for k in ("title", "aria", "alt")])
    assert one(spark, links.excluded(link), h=href) is out


@pytest.mark.parametrize(("url", "ok"), [("https://a.example/x", True), ("ftp://a.example", False), ("http://127.0.0.1/", False), ("http://8.8.8.8/", True), ("http://a.example:22/", False), ("http://localhost/", False), ("http://a b.example", False)])
def test_valid_urls(spark, url, ok):
    assert one(spark, urls.valid(F.col("u")), u=url) is ok


def test_normalised_urls_keep_a_slash_before_the_query(spark):
    assert one(spark, urls.normalised(F.col("u")), u="HTTP://A.example/a/?x") == "http://a.example/a/"
    assert one(spark, urls.normalised(F.col("u")), u="http://a.example/a/") == "http://a.example/a"


def test_null_names_are_dropped(spark):
    df = spark.createDataFrame([(1, None), (2, "a"), (3, "山田病院")], "id long, company_name string")
    assert [r[0] for r in df.where(targeting.name_allowed()).collect()] == [2]
    assert [r[0] for r in df.where(targeting.not_denied("a, b")).collect()] == [3]


def test_fuzzy_dedup_is_ordered(spark):
    df = spark.createDataFrame([(["abc", "abcd", "zz", "dcba"],)], "t array<string>")
    assert df.select(text.distinct_longest(F.col("t"))).first()[0] == ["abcd", "zz"]
