"""Writes as snapshots: the next table from the present one and the changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def coalesce_update(target: DataFrame, changes: DataFrame, key: str, columns: list[str], blank_keeps: bool = False) -> DataFrame:
    """Non-null new values replace old ones; with blank_keeps, empty strings keep the old value too."""
    new = changes.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in columns])

    def value(c):
        x = F.col(f"__{c}")
        return F.coalesce(F.when(x.cast("string") != "", x) if blank_keeps else x, F.col(c))

    joined = target.join(new, F.col(key) == F.col("__key"), "left")
    return joined.withColumns({c: value(c) for c in columns}).select(*target.columns)


def upsert(target: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of changes replace or join those of target."""
    return target.join(changes.select(key), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def update_report(target: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """One row: processed, missing, success_rate (70 % is enough for success)."""
    found = changes.join(target.select(key, F.lit(True).alias("here")), key, "left")
    report = found.agg(F.count_if("here").alias("processed"), F.count_if(F.col("here").isNull()).alias("missing"))
    total = F.col("processed") + F.col("missing")
    rate = F.when(total > 0, F.round(F.col("processed") * 100.0 / total, 2)).otherwise(F.lit(0.0))
    return report.withColumns({"success_rate": rate.cast("double"), "success": (rate >= 70)})


def differences(target: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """Rows whose value is not what was written: key, expected, actual."""
    both = changes.select(key, F.col(column).alias("expected")).join(target.select(key, F.col(column).alias("actual")), key, "left")
    return both.where(~F.col("expected").eqNullSafe(F.col("actual")))


def valid_form_url(url):
    """http or https, at most 2048 characters after trimming, and not an about: page."""
    u = F.trim(url)
    return u.isNotNull() & (u != "") & (F.length(u) <= 2048) & (u.startswith("http://") | u.startswith("https://")) & ~u.contains("about:")


def apply_form_urls(companies: DataFrame, found: DataFrame) -> DataFrame:
    """id, form_found, form_url, form_finder_queued after a search that covered the ids of found (id, url)."""
    ok = F.coalesce(valid_form_url(F.col("url")), F.lit(False))
    joined = companies.select("id", F.col("form_url").alias("old")).join(found, "id")
    return joined.select("id", F.when(ok, True).otherwise(False).alias("form_found"), F.when(ok, F.col("url")).otherwise(F.col("old")).alias("form_url"), F.lit(None).cast("boolean").alias("form_finder_queued"))


def json_changes(rows: DataFrame, key: str, changes: str) -> DataFrame:
    """key, name, value: a row for each member of a JSON object of changes, to be joined to what it changes."""
    members = F.from_json(F.col(changes), "map<string,string>")
    return rows.select(F.col(key), F.explode(members).alias("name", "value")).where(F.col("value").isNotNull())
