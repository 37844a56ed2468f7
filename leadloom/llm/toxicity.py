"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the presence of words, word pairs and pairs with one or two words between, hashed to 2**bits indices. A
word also counts as its stems, its first 4 to 8 characters, since insults that are inflected never repeat as whole words. The
model is fitted on a bounded sample of labelled documents, at most ``per_class`` of each label, whose features meet in one
task: a document has at most 2**bits distinct ones, however long it is; per-coordinate rates and L1 leave a few hundred non-zero
weights, which are broadcast. Every whole text is scored,
in narrow stages. Labels, lang, source and doc_id are never inputs of a score.

Defined cases: null and empty texts get the score of the bias alone; a document with several labels counts as toxic if one
says so; of repeated training ids the least text is used; without labels all scores are 0, and with labels of one kind only all
scores are that label; an empty table gives an empty result; other columns are ignored, and ``drop_toxic`` passes them through,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import WORDS, fresh
from leadloom.llm.pieces import PieceTable

BITS, PER_CLASS, THRESHOLD = 20, 3000, 0.7
U = np.uint64
#: Words whose features are made at once.
CHUNK = 1 << 17
#: Lengths of stems in characters.
STEMS = (4, 5, 6, 7, 8)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORDS).split()


def word_key(w: bytes) -> int:
    return xxhash.xxh3_64_intdigest(w)


def word_indices(w: bytes, bits: int = BITS, stems: tuple[int, ...] = STEMS) -> list[int]:
    """Of the word and of its stems: its first characters, where it has as many."""
    s = w if w.isascii() else w.decode("utf-8", "replace")
    stems = [xxhash.xxh3_64_intdigest(s[:k], k) >> 64 - bits for k in stems if len(s) >= k]
    return [word_key(w) >> 64 - bits, *stems]


def pair_indices(h: np.ndarray, doc: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(index, document) of each bigram and skip-gram. h, doc: the key and the document of each word; no pair crosses documents."""
    idx, of = [np.empty(0, U)], [np.empty(0, np.int64)]
    for gap in (1, 2, 3):
        same = doc[:-gap] == doc[gap:]
        idx.append(((h[:-gap] * U(0xC2B2AE3D27D4EB4F) ^ h[gap:] * U(0x165667B19E3779F9)) * U(2 * gap + 0xD6E8FEB86659FD93))[same])
        of.append(doc[gap:][same])
    return (np.concatenate(idx) >> U(64 - bits)).astype(np.int64), np.concatenate(of)


def all_indices(words: list[bytes], bits: int = BITS) -> np.ndarray:
    """The distinct feature indices of a document."""
    own = [i for w in {*words} for i in word_indices(w, bits)]
    h = np.array([word_key(w) for w in words], U)
    return np.unique(np.concatenate([np.array(own, np.int64), pair_indices(h, np.zeros(len(h), np.int64), bits)[0]]))


def ftrl(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, alpha=1.0, beta=1.0, l1=5.0, l2=0.05, epochs=10) -> tuple[np.ndarray, float]:
    """Weights and bias. rows: the distinct feature indices of each document. The bias is the coordinate after the last, without L1."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    bias = 1 << bits

    def weight(i):
        zi, lasso = z[i], np.where(i == bias, 0.0, l1)
        return np.where(np.abs(zi) <= lasso, 0.0, -(zi - np.sign(zi) * lasso) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for idx, y in zip(rows, labels, strict=True):
            i = np.append(idx, bias)
            w = weight(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    w = weight(np.arange(bias + 1))
    return w[:-1], float(w[-1])


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, held_out=None) -> DataFrame:
    """doc_id, toxic, text of at most 2 * per_class documents, chosen by a hash of the id."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if held_out is not None:
        known = known.where(~held_out)
    ids = None
    for y in (0, 1):
        part = known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        ids = part if ids is None else ids.unionByName(part)
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")  # at most 2 * per_class ids
    return found.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def train(rows: DataFrame, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, float]:
    """(indices, weights, bias) of the non-zero weights. rows: a bounded sample with doc_id, toxic, text."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [all_indices(words_of(t.as_py()), bits).astype(np.int32) for t in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(made, pa.list_(pa.int32()))], names=["doc_id", "toxic", "idx"])

    def fit(group: pa.Table) -> pa.Table:
        group = group.sort_by("doc_id")
        y = group.column("toxic").to_numpy()
        order = np.random.default_rng(7).permutation(len(y))
        idx = group.column("idx").combine_chunks()
        flat, at = idx.flatten().to_numpy(), idx.offsets.to_numpy()
        at = at - at[0]
        if len({*y.tolist()}) < 2:
            w, bias = np.zeros(1 << bits), 35.0 if y.any() else -35.0
        else:
            w, bias = ftrl([flat[at[k] : at[k + 1]] for k in order], y[order], bits)
        where = np.flatnonzero(w)
        return pa.table({"idx": pa.array([where], pa.list_(pa.int64())), "w": pa.array([w[where]], pa.list_(pa.float64())), "bias": [bias]})

    schema = "doc_id long, toxic int, idx array<int>"
    features = rows.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"), "text").mapInArrow(extract, schema)
    model = features.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(fit, "idx array<long>, w array<double>, bias double").first()
    if model is None:
        return np.empty(0, np.int64), np.empty(0), -35.0
    return np.array(model[0], np.int64), np.array(model[1]), model[2]


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], name: str = "score", bits: int = BITS) -> DataFrame:
    """docs with a score, double, 0 to 1."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, values, bias = sent.value
        w = np.zeros(1 << bits)
        w[where] = values
        # of a word and its stems, only what has a weight
        table = PieceTable(lambda new: [[i for i in word_indices(x, bits) if w[i]] for x in new], key=word_key)

        def sums(texts: list[list[bytes]]) -> np.ndarray:
            slots = table.slots([x for words in texts for x in words])
            doc = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
            idx, of = pair_indices(table.keys[slots], doc, bits)
            hit = w[idx] != 0
            own, n = table.at(slots)
            pairs = np.unique(np.concatenate([of[hit] << bits | idx[hit], np.repeat(doc, n) << bits | own]))
            return np.bincount(pairs >> bits, w[pairs & (1 << bits) - 1], len(texts))

        for batch in batches:
            out, held, used = [], [], 0
            for text in batch.column("text").cast(pa.binary()):
                held.append(words_of(text.as_py()))
                used += len(held[-1])
                if used > CHUNK:
                    out.append(sums(held))
                    held, used = [], 0
            if held:
                out.append(sums(held))
            p = 1 / (1 + np.exp(-np.clip(np.concatenate(out) + bias, -35, 35))) if out else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, docs.select("*", F.lit(0.0).alias(name)).schema)


def held_out_id():
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted. Learns from rows that are not held out."""
    model = train(training_rows(docs, labels, held_out=held_out_id()))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out_id().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs that the model does not reject."""
    model = train(training_rows(docs, labels, held_out=held_out_id()))
    (name,) = fresh(docs, "score")
    return score(docs, model, name).where(F.col(name) < THRESHOLD).select(*docs.columns)
