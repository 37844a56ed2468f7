"""Facts and companies bucketed by company: histories meet companies without an exchange. Tried companies as bitmaps.

``bucketed`` writes a table with one sort order a bucket; anti, semi and outer joins on the company and groupings by it then read bucket against bucket,
however large the history has grown, and a day's new facts are appended to the same buckets.

``tried_bitmaps`` keeps who was tried by whom as exact bitmaps of ids (32,768 ids in 4 KiB): a test of one bit replaces the join with the facts, and
the bitmaps of the days can be joined by "or".
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.sources.files import shared_folder

BUCKETS = 16


def bucketed(rows: DataFrame, key: str, buckets: int = BUCKETS, name: str | None = None) -> DataFrame:
    """rows as a table in the shared folder, hashed into buckets by the key and sorted by it. Another call with the name appends."""
    spark = rows.sparkSession
    name = name or f"bucketed_{uuid.uuid4().hex[:12]}"
    # the rows go to their buckets first: a file for each bucket, not for each bucket and task
    writer = rows.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).format("parquet").mode("append")
    if not spark.catalog.tableExists(name):
        writer = writer.option("path", f"{shared_folder(spark)}/{name}")
    writer.saveAsTable(name)
    return spark.table(name)


def tried_bitmaps(submissions: DataFrame, *by: str, company: str = "company_id") -> DataFrame:
    """by, part, bits: the ids (0 or more) of companies in submissions, a row for each group and 32,768 ids."""
    part, place = F.bitmap_bucket_number(F.col(company)), F.bitmap_bit_position(F.col(company))
    return submissions.where(F.col(company) >= 0).groupBy(*by, part.alias("part")).agg(F.bitmap_construct_agg(place).alias("bits"))


def merged(bitmaps: DataFrame, *by: str) -> DataFrame:
    """One bitmap for each group and part: the union of several days or tables."""
    return bitmaps.groupBy(*by, "part").agg(F.bitmap_or_agg("bits").alias("bits"))


def has_bit(bits: Column, position: Column) -> Column:
    """Whether the bit at a position is set; false for a null bitmap."""
    byte = F.conv(F.hex(F.substring(bits, (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (position % 8).cast("int")) == 1, F.lit(False))


def untried(companies: DataFrame, bitmaps: DataFrame, key: str = "id") -> DataFrame:
    """Companies whose bit is not set in bitmaps (part, bits). A null or negative id was never tried."""
    tested = companies.join(bitmaps.select("part", "bits"), F.bitmap_bucket_number(F.col(key)) == F.col("part"), "left")
    position = F.bitmap_bit_position(F.col(key))
    return tested.where(~F.coalesce(has_bit(F.col("bits"), position) & (F.col(key) >= 0), F.lit(False))).select(*companies.columns)
