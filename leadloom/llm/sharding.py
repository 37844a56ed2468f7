"""Sharding by a two-pass external shuffle.

Pass one scatters the records into buckets that fit in memory, by seeded hashes; pass two loads one bucket at a time,
shuffles it (Fisher-Yates) and writes it. A shard is a run of buckets; its slots are gapless.

The law is ``key``: doc_id and the number of shards decide a record's shard, by the greatest of one seeded hash a shard.
One more shard therefore takes records into itself and moves none between the others. Within a shard, a seeded hash of
doc_id, text and the record's number in the input chooses the bucket, so records scatter uniformly even if all are repeats
of one. Each shard has as many buckets as its bytes need. The order of a bucket depends on its records and the seed; the
numbers of records, and so the buckets, are those of the input's files and splits, which a task that runs again finds anew.

Defined cases: a null doc_id is one key, its records go to one shard and scatter over its buckets; null text has size 1 and
the CRC of the empty text; repeated records each get a slot; an empty table gives no shards; other columns are written
along with the records, whatever their names: the shard's own columns give way with underscores (``shard_columns``).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadloom.llm.common import fresh, new_path

SEED, BUCKET_BYTES = 7, 8 << 20
#: Tasks of the second pass: one a bucket, up to this number; beyond it a task shuffles several buckets one by one.
TASKS = 1 << 14


def record_size():
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1


def shard_of(shards: int, seed: int = SEED):
    """The shard whose hash of doc_id is greatest (rendezvous hashing)."""
    weights = [F.struct(F.xxhash64(F.lit(seed), F.lit(k), "doc_id").alias("w"), F.lit(k).alias("k")) for k in range(shards)]
    return F.array_max(F.array(*weights))["k"]


def shard_columns(docs: DataFrame) -> tuple[str, str, str]:
    """The names of the columns for shard, bucket and place in the bucket."""
    return fresh(docs, "__shard", "__bucket", "__place")


def shard_schema(docs: DataFrame):
    """The schema of the shard files."""
    shard, bucket, place = shard_columns(docs)
    return docs.withColumns({shard: F.lit(0), bucket: F.lit(0), place: F.lit(0).cast("long")}).schema


def write_shards(docs: DataFrame, shards: int = 8, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> str:
    """Write all records with shard, bucket and place (in the bucket), a folder a shard; the path."""
    shard, bucket, place = shard_columns(docs)
    tie, number = fresh(docs, "__tie", "__number")
    sized = docs.select(shard_of(shards, seed).alias("s"), record_size().alias("b")).groupBy("s").agg(F.sum("b")).collect()  # a row a shard
    buckets = {s: max(1, math.ceil(b / bucket_bytes)) for s, b in sized}
    per_shard = F.array(*[F.lit(buckets.get(k, 1)) for k in range(shards)])
    scatter = F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "text", number), F.element_at(per_shard, F.col(shard) + 1)).cast("int")
    placed = docs.withColumns({shard: shard_of(shards, seed), number: F.monotonically_increasing_id(), tie: F.xxhash64("text")})
    placed = placed.withColumn(bucket, scatter).drop(number).repartition(min(TASKS, max(1, sum(buckets.values()))), shard, bucket)
    schema = shard_schema(docs)

    def shuffle(rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows.select(["doc_id", tie]), [("doc_id", "ascending"), (tie, "ascending")]))
        key = (seed, rows.column(shard)[0].as_py(), rows.column(bucket)[0].as_py())
        rows = rows.take(fisher_yates(rows.num_rows, key)).append_column(place, pa.array(np.arange(rows.num_rows)))
        return rows.select(schema.names)

    path = new_path(docs.sparkSession, "shards")
    shuffled = placed.groupBy(shard, bucket).applyInArrow(shuffle, schema)
    shuffled.sortWithinPartitions(shard, bucket, place).write.partitionBy(shard).parquet(path)
    return path


def fisher_yates(n: int, key: tuple) -> np.ndarray:
    """A seeded permutation: each place from the last swaps with a random one up to itself."""
    order = np.arange(n)
    swaps = (np.random.default_rng(key).random(n) * np.arange(1, n + 1)).astype(np.int64)
    for i in range(n - 1, 0, -1):
        j = swaps[i]
        order[i], order[j] = order[j], order[i]
    return order


def read_shards(spark, path: str, schema) -> DataFrame:
    """Records with shard, bucket and place; the schema is that of ``shard_schema``."""
    return spark.read.schema(schema).parquet(path)


def with_slots(rows: DataFrame, shard: str = "__shard", bucket: str = "__bucket", place: str = "__place", slot: str = "__slot") -> DataFrame:
    """Bucket and place as a gapless slot. Rows may be a projection of the records: what is not needed should not travel to the join."""
    counts = rows.groupBy(shard, bucket).agg(F.count("*").alias("n"))
    # one row a bucket, which is one for each bucket_bytes of records
    run = Window.partitionBy(shard).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    (before,) = fresh(rows, "before")
    counts = counts.select(shard, bucket, F.coalesce(F.sum("n").over(run), F.lit(0)).alias(before))
    return rows.join(counts, [shard, bucket]).withColumn(slot, F.col(before) + F.col(place)).drop(before, bucket, place)


def digest(docs: DataFrame, shards: int = 8, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: from the shard files."""
    docs = docs.select("doc_id", "text")
    records = read_shards(docs.sparkSession, write_shards(docs, shards, seed, bucket_bytes), shard_schema(docs))
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    rows = with_slots(records.select("doc_id", record_size().alias("size"), crc.alias("text_crc32"), "__shard", "__bucket", "__place"))
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("__shard").alias("shard"), F.col("__slot").alias("slot"),
        shard_of(shards + 1, seed).alias("grown_shard"),
    )
