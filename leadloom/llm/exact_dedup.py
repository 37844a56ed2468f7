"""Exact dedup by an extendible-hash index on shared files. DataFrame operations only.

Keys are 64-bit hashes of the text with A-Z lower-cased (null counts as empty).

1. One pass over the texts writes id, key and digest of each row; keys are counted from that. A directory maps hash prefixes to
   buckets: it starts at a depth that fits the number of keys and doubles, one bit at a time, for the buckets that hold more than
   ``capacity`` keys, until none does. Each key is placed in its bucket.
2. A second pass brings the texts of keys that several rows have, and only those, to the owners of their buckets: a task owns a range of
   buckets. The owner chains the rows of a key: those whose texts are the same bytes are one entry, and entries that only share
   the key stand behind each other in its chain. Keys that hold more than one part in ``HOT`` of all rows (so at most HOT keys, which
   bounds what is broadcast) are combined before they travel, so that no owner gets a large group, whatever its size. A key of one row
   is an entry without its text.
3. Owners write their entries in bucket order, so that a file holds a range of buckets, and a bucket lies in one file.
   ``lookup`` finds texts in their buckets; rows find their group by key and digest.

Defined cases: null text equals empty text; a null doc_id never stays while the group has another; all rows of an
all-null group stay; repeated rows (same doc_id and text) share one decision in ``exact_dedup`` and ``drop_copies``
keeps one of them; an empty table gives an empty result; columns besides doc_id and text are ignored, and ``drop_copies``
passes them through, whatever their names.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.llm.common import ascii_lower, fresh, materialise, new_path

KEY_BITS, HOT, CAPACITY = 64, 4096, 4096


def _prefix(depth: int) -> Column:
    """The first ``depth`` bits of the key. A shift by 64 would be one by 0."""
    return F.shiftrightunsigned("key", KEY_BITS - depth) if depth else F.lit(0).cast("long")


def text_key(norm: Column, key_bits: int = KEY_BITS) -> Column:
    """The first ``key_bits`` bits of the hash of the text; fewer than 64 make texts collide, for tests."""
    return F.xxhash64(norm).bitwiseAND(F.lit(-1 << (KEY_BITS - key_bits)))


def normalised(docs: DataFrame, key_bits: int = KEY_BITS) -> DataFrame:
    """doc_id, text as compared, key."""
    norm = docs.select("doc_id", ascii_lower(F.coalesce("text", F.lit(""))).alias("norm"))
    return norm.withColumn("key", text_key(F.col("norm"), key_bits))


def directory(keys: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Leaves (depth, prefix, n_keys) of the directory over distinct keys; one round for each doubling."""
    total = keys.count()
    depth, open_keys, leaves = max(0, math.ceil(math.log2(max(1, total) / capacity))), keys, []
    while True:
        counts = materialise(open_keys.groupBy(_prefix(depth).alias("prefix")).agg(F.count("*").alias("n_keys")), "dir")
        over = counts.where(F.col("n_keys") > capacity)
        leaf = counts.select(F.lit(depth).alias("depth"), "prefix", "n_keys")
        if depth == KEY_BITS or over.isEmpty():
            return reduce(DataFrame.unionByName, [*leaves, leaf])
        leaves.append(leaf.where(F.col("n_keys") <= capacity))
        open_keys = open_keys.withColumn("prefix", _prefix(depth)).join(over.select("prefix"), "prefix", "left_semi").select("key")
        depth += 1


def narrow_rows(docs: DataFrame, key_bits: int = KEY_BITS) -> DataFrame:
    """Written: doc_id, key, text_sha256 of every row."""
    return materialise(normalised(docs, key_bits).select("doc_id", "key", F.sha2("norm", 256).alias("text_sha256")), "narrow")


def placed(keys: DataFrame, leaves: DataFrame) -> DataFrame:
    """keys with the bucket that the directory has for them: bucket_depth, bucket (its least key, by the bits of the prefix)."""
    depths = sorted(r[0] for r in leaves.select("depth").distinct().collect()) or [0]  # at most 65 values
    prefixes = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), _prefix(d).alias("prefix")) for d in depths])).alias("at")
    found = keys.select("*", prefixes).select("*", "at.depth", "at.prefix").join(leaves.select("depth", "prefix"), ["depth", "prefix"])
    start = F.when(F.col("depth") == 0, F.lit(0).cast("long")).otherwise(F.expr("shiftleft(prefix, 64 - depth)"))
    return found.select(*keys.columns, F.col("depth").alias("bucket_depth"), start.alias("bucket"))


BUCKET = ("bucket_depth", "bucket")


def chain_entries(docs: DataFrame, narrow: DataFrame, keys: DataFrame, key_bits: int = KEY_BITS) -> DataFrame:
    """One entry for each different text: bucket, key, chain (0, 1, ...), text_sha256, keep_id, group_size. keys: key, n_rows and bucket."""
    rows, total = normalised(docs, key_bits), keys.agg(F.sum("n_rows")).first()[0] or 0
    several = keys.where("n_rows > 1")
    is_hot = F.col("n_rows") * HOT > total
    hot = F.broadcast(several.where(is_hot).select("key", *BUCKET))  # at most HOT keys
    frequent = rows.join(hot, "key").groupBy(*BUCKET, "key", "norm").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))
    others = rows.join(several.where(~is_hot).select("key", *BUCKET), "key").select(*BUCKET, "key", "norm", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("n"))
    owned = frequent.unionByName(others).repartitionByRange("bucket")
    # both steps keep to the ranges: no row leaves its owner
    texts = owned.groupBy(*BUCKET, "key", "norm").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    texts = texts.select(*BUCKET, "key", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size")
    order = Window.partitionBy(*BUCKET, "key").orderBy("text_sha256")
    chained = texts.withColumn("chain", (F.row_number().over(order) - 1).cast("int"))
    single = narrow.join(keys.where("n_rows = 1").select("key", *BUCKET), "key").select(
        *BUCKET, "key", "text_sha256", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(0).alias("chain")
    )
    return chained.unionByName(single).select(*BUCKET, "key", "chain", "text_sha256", "keep_id", "group_size")


def _index(docs: DataFrame, narrow: DataFrame, capacity: int, key_bits: int) -> DataFrame:
    keys = materialise(narrow.groupBy("key").agg(F.count("*").alias("n_rows")), "keys")
    keys = materialise(placed(keys, directory(keys.select("key"), capacity)), "placed")
    owned = chain_entries(docs, narrow, keys, key_bits).repartitionByRange("bucket").sortWithinPartitions("bucket", "key", "chain")
    path = new_path(docs.sparkSession, "index")
    owned.write.parquet(path)
    return docs.sparkSession.read.schema(owned.schema).parquet(path)


def build_index(docs: DataFrame, capacity: int = CAPACITY, key_bits: int = KEY_BITS) -> DataFrame:
    """The index, written to shared files in bucket order and read back: bucket_depth, bucket, key, chain, text_sha256, keep_id, group_size."""
    return _index(docs, narrow_rows(docs, key_bits), capacity, key_bits)


def lookup(index: DataFrame, texts: DataFrame, key_bits: int = KEY_BITS) -> DataFrame:
    """texts with keep_id and group_size of the entry that has the same bytes; null where there is none. A text meets the entries of its bucket."""
    leaves = index.select(F.col("bucket_depth").alias("depth"), "bucket").distinct()
    leaves = leaves.select("depth", F.when(F.col("depth") == 0, F.lit(0).cast("long")).otherwise(F.expr("shiftrightunsigned(bucket, 64 - depth)")).alias("prefix"))
    own = ("key", "text_sha256", *BUCKET, "keep_id", "group_size")
    key, sha, depth, bucket, keep, size = fresh(texts, *(f"index_{c}" for c in own))
    norm = ascii_lower(F.coalesce(texts["text"], F.lit("")))
    asked = texts.select("*", text_key(norm, key_bits).alias(key), F.sha2(norm, 256).alias(sha))
    at = placed(asked.select(F.col(key).alias("key")).distinct(), leaves).toDF(key, depth, bucket)
    entries = index.select(*own).toDF(key, sha, depth, bucket, keep, size)
    found = asked.join(at, key, "left").join(entries, [depth, bucket, key, sha], "left")
    return found.select(*texts.columns, F.col(keep).alias("keep_id"), F.col(size).alias("group_size"))


def _looked_up(docs: DataFrame, capacity: int, key_bits: int) -> DataFrame:
    """doc_id, key, text_sha256 of each row, with g_id and group_size if the index has several rows for its text."""
    rows = narrow_rows(docs, key_bits)
    groups = _index(docs, rows, capacity, key_bits).where("group_size > 1").select("key", "text_sha256", F.col("keep_id").alias("g_id"), "group_size")
    return rows.join(groups, ["key", "text_sha256"], "left")


def exact_dedup(docs: DataFrame, capacity: int = CAPACITY, key_bits: int = KEY_BITS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of docs."""
    found = _looked_up(docs, capacity, key_bits)
    keep = F.when(F.isnull("group_size"), F.col("doc_id")).otherwise(F.col("g_id"))
    return found.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256",
    )


def drop_copies(docs: DataFrame, capacity: int = CAPACITY, key_bits: int = KEY_BITS) -> DataFrame:
    """docs without the rows that are dropped; columns and their order stay. Of repeated rows one stays.

    What is joined to the documents is narrow: id and digest of the rows that go, and of kept rows that are repeated.
    """
    gone_id, gone_sha, again_flag = fresh(docs, "gone_id", "gone_sha", "again")
    copies = _looked_up(docs, capacity, key_bits).where("group_size is not null").groupBy("doc_id", "text_sha256").agg(
        F.count("*").alias("n"), F.first("g_id").alias("g_id")
    )
    stays = F.col("doc_id").eqNullSafe(F.col("g_id"))
    marks = copies.where(~stays | (F.col("n") > 1)).select(F.col("doc_id").alias(gone_id), F.col("text_sha256").alias(gone_sha), stays.alias(again_flag))
    marks = materialise(marks, "marks")
    digest = F.sha2(ascii_lower(F.coalesce(docs["text"], F.lit(""))), 256)
    same = (digest == F.col(gone_sha)) & docs["doc_id"].eqNullSafe(F.col(gone_id))
    kept = docs.join(marks.where(~F.col(again_flag)), same, "left_anti")
    again = marks.where(again_flag)
    if again.isEmpty():
        return kept
    once = kept.join(again, same, "left_semi").withColumn(gone_sha, digest).dropDuplicates(["doc_id", gone_sha])
    return kept.join(again, same, "left_anti").unionByName(once.select(*docs.columns))
