"""Words that differ by one character, by rolling hashes of their deletions.

Occurrences. A run of letters (ASCII and U+00C0 to U+00FF, A-Z lower-cased) is taken as it is, but where the CRC of
``<doc_id>:<run>`` is divisible by ``EVERY`` it loses one code point, at CRC mod length. Words are the distinct results of at
least ``MIN_LENGTH`` code points that occur at least ``MIN_COUNT`` times in all documents.

Near words (one code point inserted, deleted or replaced). Every word w gives the key of itself and a key for each w without its
i-th character: prefix and suffix sums of a polynomial hash modulo 2**64 give all of them at once in NumPy, in time linear in
the letters. Equal keys then name one string s:

- two words with s at the same i differ by a replacement there;
- the word s itself and a word with s at some i differ by a deletion (of equal neighbours only the last is asked).

Keys are dealt by radix (their first bits), sorted, and read in order; a run with one word is dropped there. The others fetch their
strings, and the strings without their i-th character are compared, so that colliding hashes link nothing. A run holds at most one word a
letter and place, however many words there are. No pairs leave it: each member gets the number of its near words and the
best of them, and a word adds up what it gets from its keys.

Forms. The form of a word is the most frequent of its near words (the least in code-point order of equals), if it occurs ``TIMES`` times as
often or more. Counts grow by that factor along forms, so that the greatest count bounds the rounds of pointer doubling that find roots.

Defined cases: null text has no runs; a null doc_id is written as the empty string; repeated rows count again; a word of
any length has as many keys as letters; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import LOWER, materialise

MIN_LENGTH, MIN_COUNT, EVERY, TIMES = 7, 2, 31, 10
#: Different words that a task counts before it hands them on, and letters whose keys are made at once.
HELD, LETTERS = 400_000, 1 << 16
#: The first bits of a key that choose its part.
RADIX = 12
U = np.uint64
#: An odd multiplier has an inverse modulo 2**64, so that no letter of a long word is lost.
BASE = 0x9E3779B97F4A7C15


def runs_of(text: str, length: int = MIN_LENGTH) -> list[str]:
    """Maximal runs of at least ``length`` letters, as they are."""
    return re.findall(f"[A-Za-zÀ-ÿ]{{{length},}}", text)


def word_of(run: bytes, length: int, prefix: int, every: int = EVERY) -> bytes:
    """The word that a lower-cased run of UTF-8 with ``length`` code points gives; prefix: the CRC of what stands before it."""
    h = zlib.crc32(run, prefix)
    if h % every:
        return run
    text = run.decode()
    return (text[: h % length] + text[h % length + 1 :]).encode()


def count_words(docs: DataFrame, min_length: int = MIN_LENGTH, held: int = HELD) -> DataFrame:
    """word, n: partial counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            words = list(total)
            for lo in range(0, len(words), 1 << 16):
                some = words[lo : lo + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary()).cast(pa.string()), pa.array([total[w] for w in some], pa.int64())], names=["word", "n"])
            total.clear()

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                # short runs cannot give a word, with or without a deletion
                found = Counter(runs_of(text.as_py() or "", min_length))
                prefix = zlib.crc32(b"%b:" % (doc_id or "").encode())
                for word, n in found.items():
                    total[word_of(word.encode().translate(LOWER), len(word), prefix)] += n
                if len(total) > held:
                    yield from flush()
        yield from flush()

    return docs.select(F.col("doc_id").cast("string"), "text").mapInArrow(run, "word string, n long")


def words(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """Written: id, word, n."""
    counted = count_words(docs, min_length).groupBy("word").agg(F.sum("n").alias("n"))
    kept = counted.where((F.col("n") >= min_count) & (F.char_length("word") >= min_length))
    return materialise(kept.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")


def powers(n: int) -> np.ndarray:
    """BASE ** (0 ... n - 1) modulo 2**64."""
    return np.multiply.accumulate(np.concatenate([np.ones(1, U), np.full(max(0, n - 1), BASE, U)]))[:n]


def deletion_keys(points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of words, laid end to end as code points, with their starts (and the end): whole (the key of each word), and for each letter the key of its
    word without it, its place, and whether a deletion there is asked (the next letter is another).

    With c the points and B the base, a string has the sum of (c[j] + 1) * B**j; without letter i, that is the sum of the prefix up to i
    and the sum of the suffix behind i, one power lower."""
    size = np.diff(starts)
    place = np.arange(len(points)) - np.repeat(starts[:-1], size)
    power = powers(int(size.max(initial=0)) + 1)
    value = points.astype(U) + U(1)
    # sums run through all words; what stands before a word is taken off again
    high = np.concatenate([np.zeros(1, U), np.cumsum(value * power[place])])
    low = np.concatenate([np.zeros(1, U), np.cumsum(value * power[np.maximum(place - 1, 0)])])
    first, end = np.repeat(starts[:-1], size), np.repeat(starts[1:], size)
    at = np.arange(len(points))
    without = (high[at] - high[first]) + (low[end] - low[at + 1])
    whole = high[starts[1:]] - high[starts[:-1]]
    last = np.ones(len(points), bool)
    last[:-1] = (points[1:] != points[:-1]) | (at[1:] == first[1:])
    return mixed(whole, size), mixed(without, np.repeat(size - 1, size)), place, last


def mixed(key: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The key with the length in it, and its high bits as good as its low ones."""
    key = (key ^ length.astype(U)) * U(0xBF58476D1CE4E5B9)
    return key ^ (key >> U(32))


KEYS = "key long, place int, id long, asked boolean"


def keyed(words: DataFrame) -> DataFrame:
    """key, place (-1: the word itself), id, asked: a row a word and letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            lo, used = 0, 0
            for hi, text in enumerate(texts, 1):
                used += len(text)
                if used < LETTERS and hi < len(texts):
                    continue
                some = texts[lo:hi]
                starts = np.cumsum([0, *map(len, some)])
                points = np.frombuffer("".join(some).encode("utf-32-le"), np.uint32)
                whole, without, place, last = deletion_keys(points, starts)
                own = ids[lo:hi]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([whole, without]).view(np.int64)), pa.array(np.concatenate([np.full(len(own), -1), place]).astype(np.int32)),
                    pa.array(np.concatenate([own, np.repeat(own, np.diff(starts))])), pa.array(np.concatenate([np.ones(len(own), bool), last])),
                ], names=["key", "place", "id", "asked"])
                lo, used = hi, 0

    return words.select("id", "word").mapInArrow(run, KEYS)


def shared_keys(keys: DataFrame, radix: int = RADIX) -> DataFrame:
    """The rows of keys that several words have: parts by radix, sorted, and read in order with the open run carried along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def several(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            key, id_ = rows.column("key").to_numpy(), rows.column("id").to_numpy()
            if not len(key):
                return
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            more = np.minimum.reduceat(id_, start) < np.maximum.reduceat(id_, start)
            if more.any():
                yield from rows.filter(pa.array(np.repeat(more, np.diff([*start, len(key)])))).to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([held, rows]) if held is not None else rows
            key = rows.column("key").to_numpy()
            if key[0] == key[-1]:
                held = rows
                continue
            open_ = int(np.flatnonzero(key != key[-1])[-1]) + 1
            yield from several(rows.slice(0, open_))
            held = rows.slice(open_).combine_chunks()
        if held is not None:
            yield from several(held)

    part = F.shiftrightunsigned("key", 64 - radix)
    return keys.repartition(part).sortWithinPartitions("key").mapInArrow(run, KEYS)


GIVEN = "id long, n_near long, best_n long, best string"


def _members(rows: list[dict]) -> Iterator[tuple]:
    """(id, n_near, best_n, best) that the rows of one key give: words whose strings without their letter are the same are held against each other."""
    by_string: dict[str, list[dict]] = {}
    for r in rows:
        s = r["word"] if r["place"] < 0 else r["word"][: r["place"]] + r["word"][r["place"] + 1 :]
        by_string.setdefault(s, []).append(r)
    for same in by_string.values():
        if len(same) < 2:
            continue
        places: dict[int, list[dict]] = {}
        for r in same:
            places.setdefault(r["place"], []).append(r)
        own = places.pop(-1, None)
        groups = [(g, g) for g in places.values() if len(g) > 1]
        if own and (longer := [r for r in same if r["place"] >= 0 and r["asked"]]):
            groups += [(own, longer), (longer, own)]
        for members, others in groups:
            # the best two serve all members: the best of the others is one of them
            ranked = sorted(others, key=lambda r: (-r["n"], r["word"]))[:2]
            inside = members is others
            for r in members:
                best = ranked[1] if inside and ranked[0] is r else ranked[0]
                yield r["id"], len(others) - inside, best["n"], best["word"]


def near_words(words: DataFrame, radix: int = RADIX) -> DataFrame:
    """id, n_near, best_n, best: for the words that have near words, how many and which is the most frequent."""
    shared = materialise(shared_keys(keyed(words), radix), "shared-keys")
    # a key has at most one word a letter and place: its run is bounded by the alphabet and the length of its words
    runs = shared.join(words, "id").groupBy("key").agg(F.collect_list(F.struct("place", "asked", "id", "word", "n")).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for rows in batch.column(0) for x in _members(rows.as_py())]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["id", "n_near", "best_n", "best"])

    given = runs.select("rows").mapInArrow(run, GIVEN)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("top")
    return given.groupBy("id").agg(F.sum("n_near").alias("n_near"), best).select("id", "n_near", (-F.col("top.less")).alias("best_n"), "top.best")


def roots(forms: DataFrame, rounds: int) -> DataFrame:
    """word, root of forms (word, form): each round doubles the steps that are taken."""
    at = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(rounds):
        on = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        at = materialise(at.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
    return at


def spelling_variants(docs: DataFrame, times: int = TIMES, radix: int = RADIX) -> DataFrame:
    """word, n, n_near, form, form_n, root: a row a word."""
    known = words(docs)
    near = known.join(near_words(known, radix), "id", "left")
    takes = F.col("best_n") >= times * F.col("n")
    judged = near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, F.col("best")).alias("form"), F.when(takes, F.col("best_n")).alias("form_n"))
    judged = materialise(judged, "judged")
    forms = judged.where("form is not null")
    most, least = forms.agg(F.max("form_n"), F.min("n")).first()
    steps = 1  # the most that a chain of forms can have
    while most is not None and least * times ** (steps + 1) <= most:
        steps += 1
    found = roots(forms, math.ceil(math.log2(steps)))
    return judged.join(found, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
