"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of ``window`` consecutive words of a benchmark item, or all words of a shorter item. Patterns of
one length share a search: a shift table over blocks of two words tells how far the search may jump, since a block that
no pattern holds skips a whole window; where the shift is 0, the suffix block leads to a bucket of patterns, and words are
compared one by one. The benchmark is a stated query set: it is cut into blocks of at most ``BLOCK_BYTES`` of text (or one item), which pass
through the driver one at a time. Each block is broadcast and searched in a narrow stage, without a shuffle; between two blocks
the documents and what they hit so far are written to the shared folder, so that a worker holds the tables of one block only
(about 50 to 100 bytes for each byte of its text), builds them once, and keeps them for its later tasks.

Defined cases: a null or empty text has no words and is clean; a null or wordless item has no window; an item whose id is
null marks words as hit but is not listed; repeated items count once; repeated document rows each get a row; an empty
benchmark leaves all documents clean; other columns are ignored, and ``drop_contaminated`` passes them through, whatever their
names: the operator's own columns give way with underscores (``mark_columns``).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import WORDS, fresh, materialise

WINDOW, BLOCK_BYTES = 10, 2 << 20


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORDS).split()


class WuManber:
    """Patterns of one length, as tuples of words, each with the ordinals of the items that hold it."""

    def __init__(self, length: int, patterns: dict[tuple, list[int]]):
        self.length, self.size = length, min(2, length)
        self.far = length - self.size + 1
        self.shift: dict = {}
        self.buckets: dict = {}
        for words, items in patterns.items():
            for end in range(self.size, length + 1):
                block = words[end - self.size : end]
                self.shift[block] = min(self.shift.get(block, self.far), length - end)
            self.buckets.setdefault(words[length - self.size :], []).append((words, items))

    def find(self, words: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """(start, items) of each occurrence."""
        n, size, far = len(words), self.size, self.far
        shift, at = self.shift.get, self.length
        while at <= n:
            jump = shift(tuple(words[at - size : at]), far)
            if jump:
                at += jump
                continue
            start = at - self.length
            for pattern, items in self.buckets[tuple(words[at - size : at])]:
                if tuple(words[start:at]) == pattern:
                    yield start, items
            at += 1


def searchers(items: Iterable[bytes | None], window: int = WINDOW) -> list[WuManber]:
    by_length: dict[int, dict[tuple, list[int]]] = {}
    for k, text in enumerate(items):
        words = words_of(text)
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            held = by_length.setdefault(size, {}).setdefault(tuple(words[i : i + size]), [])
            if not held or held[-1] != k:
                held.append(k)
    return [WuManber(size, patterns) for size, patterns in sorted(by_length.items())]


def scan(words: list[bytes], finders: list[WuManber]) -> tuple[np.ndarray, set[int]]:
    """Positions that are hit, and the ordinals of the items that occur."""
    hit, found = np.zeros(len(words), dtype=bool), set()
    for finder in finders:
        for start, items in finder.find(words):
            hit[start : start + finder.length] = True
            found.update(items)
    return np.flatnonzero(hit), found


def _blocks(bench: DataFrame, block_bytes: int) -> Iterator[list[tuple]]:
    """The benchmark, some rows at a time: at most block_bytes of text, or one item. A stated query set streams through the driver."""
    block, used = [], 0
    for row in bench.select("item_id", F.col("text").cast("binary")).toLocalIterator():
        size = len(row[1] or b"")
        if block and used + size > block_bytes:
            yield block
            block, used = [], 0
        block.append((row[0], bytes(row[1] or b"")))
        used += size
    if block:
        yield block


_tables: dict[str, tuple[list[str | None], list[WuManber]]] = {}


def tables_of(name: str, block: list[tuple], window: int) -> tuple[list[str | None], list[WuManber]]:
    """Item ids and searchers of a block, which a worker keeps until it gets another."""
    if name not in _tables:
        _tables.clear()
        _tables[name] = [None if i is None else str(i) for i, _ in block], searchers((t for _, t in block), window)
    return _tables[name]


def mark_columns(docs: DataFrame) -> tuple[str, str, str]:
    """The names of the columns for the number of words, the positions that are hit and the items."""
    return fresh(docs, "n_words", "hit", "items")


def mark(docs: DataFrame, bench: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with (see ``mark_columns``) the number of words, array<int> of hit word positions, array<string> of item ids, ascending."""
    n_words, hit, items = mark_columns(docs)
    out = docs.withColumns({n_words: F.lit(None).cast("long"), hit: F.array().cast("array<int>"), items: F.array().cast("array<string>")})
    blocks = _blocks(bench, block_bytes)
    block, more = next(blocks, []), True
    while more:
        out = _search(out, block, window, (n_words, hit, items))
        block = next(blocks, None)
        more = block is not None
        if more:
            out = materialise(out, "marked")
    return out


def _search(docs: DataFrame, block: list[tuple], window: int, columns: tuple[str, str, str]) -> DataFrame:
    name, sent, (n_words, hit, items) = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(block), columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, finders = tables_of(name, sent.value, window)
        for batch in batches:
            texts, before_hit, before_items = batch.column("text").cast(pa.binary()), batch.column(hit), batch.column(items)
            made = {n_words: [], hit: [], items: []}
            for k, text in enumerate(texts):
                words = words_of(text.as_py())
                at, found = scan(words, finders)
                old = before_hit[k].as_py()
                made[n_words].append(len(words))
                made[hit].append(np.union1d(at, old).astype(np.int32) if old else at.astype(np.int32))
                made[items].append(sorted({*before_items[k].as_py(), *(ids[x] for x in found if ids[x] is not None)}))
            new = {n_words: pa.array(made[n_words], pa.int64()), hit: pa.array(made[hit], pa.list_(pa.int32())), items: pa.array(made[items], pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(c) for c in batch.schema.names], names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def decontaminate(docs: DataFrame, bench: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    marked = mark(docs.select("doc_id", "text"), bench, window, block_bytes)
    return marked.select(
        "doc_id", "n_words", F.size("hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hit") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without contaminated rows."""
    return mark(docs, bench, window).where(F.size(mark_columns(docs)[1]) == 0).select(*docs.columns)
