"""Token ids in directly addressable codes.

Ids are split into chunks of eight bits. Level 0 holds the lowest chunk of every id and a bitmap that says which ids go
on; level 1 holds the next chunk of those, and so forth. A rank directory gives the number of set bits before each block
of 512, so that any id is found without decoding others: at each level, read a chunk, test a bit, rank it.

The store is a Parquet table in the shared folder, one row a segment: part and segment give the order, doc_ids and
lengths what it holds, n its ids, first the ids of its part before it, payload the codes. Documents lie in ascending doc_id order
over range partitions; totals of the parts, one row a partition, give global positions, and ``token_at`` reads the one
segment that holds a position.

Texts are cut at white space and each chunk is encoded once, if the tokenizer's file has the normaliser and the
pre-tokenizer for which this is the same (``CUTS_AT_SPACE``). With any other file, whole texts go through the library.

Defined cases: null and empty texts hold the end id only; a null doc_id comes first; repeated rows are stored each, in the
order of a hash of the text; an empty table gives an empty store; other columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import new_path
from leadloom.llm.pieces import PieceTable

MAGIC, BLOCK, END_ID = b"DAC1", 512, 2
#: Ids after which a segment is closed, and bytes of text that are tokenised at once.
SEGMENT, STRIDE = 1 << 18, 1 << 20
#: Chunks and words whose ids a worker remembers, some 100 MB each; both tables are emptied beyond that.
CHUNKS_KEPT, WORDS_KEPT = 700_000, 400_000


def encode(ids: np.ndarray) -> bytes:
    """All levels: count, chunks, bitmap, rank directory."""
    levels, v = [], np.asarray(ids, np.uint32)
    while True:
        more = v > 0xFF
        bitmap = np.packbits(more, bitorder="little").tobytes()
        blocks = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.uint32) if len(more) else np.zeros(0, np.uint32)
        ranks = np.cumsum(blocks, dtype=np.uint32) - blocks
        levels.append(struct.pack("<Q", len(v)) + (v & 0xFF).astype(np.uint8).tobytes() + bitmap + ranks.astype("<u4").tobytes())
        if not more.any():
            return MAGIC + struct.pack("<I", len(levels)) + b"".join(levels)
        v = v[more] >> 8


def _levels(payload: memoryview) -> Iterator[tuple[int, int, int, int]]:
    """(count, offset of chunks, of bitmap, of ranks)."""
    if payload[:4] != MAGIC:
        raise ValueError("not a DAC payload")
    at = 8
    for _ in range(struct.unpack_from("<I", payload, 4)[0]):
        n = struct.unpack_from("<Q", payload, at)[0]
        chunks, bitmap = at + 8, at + 8 + n
        ranks = bitmap + (n + 7) // 8
        yield n, chunks, bitmap, ranks
        at = ranks + 4 * ((n + BLOCK - 1) // BLOCK)


def get(payload: bytes, i: int) -> int:
    """The id at position i, by one chunk, bit and rank a level."""
    payload, value, shift = memoryview(payload), 0, 0
    for n, chunks, bitmap, ranks in _levels(payload):
        if not 0 <= i < n:
            raise IndexError(i)
        value |= payload[chunks + i] << shift
        if not payload[bitmap + i // 8] >> i % 8 & 1:
            break
        block = i // BLOCK
        bits = int.from_bytes(payload[bitmap + block * BLOCK // 8 : bitmap + i // 8 + 1], "little")
        i = struct.unpack_from("<I", payload, ranks + 4 * block)[0] + (bits & (1 << i - block * BLOCK) - 1).bit_count()
        shift += 8
    return value


def decode(payload: bytes) -> np.ndarray:
    """All ids."""
    payload, out, where, shift = memoryview(payload), None, None, 0
    for n, chunks, bitmap, _ in _levels(payload):
        part = np.frombuffer(payload, np.uint8, n, chunks).astype(np.uint32) << shift
        if out is None:
            out, where = part, np.arange(n)
        else:
            out[where] |= part
        more = np.unpackbits(np.frombuffer(payload, np.uint8, (n + 7) // 8, bitmap), count=n, bitorder="little").astype(bool)
        where, shift = where[more], shift + 8
    return out


ENDS = ".,!?;:"
# fixed values: the settings of a tokenizer that lower-cases and drops white space, so that chunks between spaces stand alone
CUTS_AT_SPACE = {
    "truncation": None, "padding": None, "post_processor": None,
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
}


def byte_letters() -> dict[int, str]:
    """How byte-level vocabularies spell bytes: printable ones as themselves, the others as characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class ChunkEncoder:
    """Encodes chunks with the tokenizers library.

    A chunk of Latin letters is a single word of the vocabulary's pattern, and what ends it, of ENDS, is another, so these
    go to the library's BPE model directly, each word once; all other chunks take the whole library pipeline.
    """

    def __init__(self, path: str, limit: int = WORDS_KEPT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model, self.limit, self.words, self.ends, self.letters = self.tok.model, limit, {}, {"": []}, byte_letters()

    def word(self, lower: str) -> list[int]:
        found = self.words.get(lower)
        if found is None:
            if len(self.words) > self.limit:
                self.words.clear()
            spelt = lower if lower.isascii() else lower.encode().decode("latin-1").translate(self.letters)
            found = self.words[lower] = [t.id for t in self.model.tokenize(spelt)]
        return found

    def end(self, text: str) -> list[int]:
        if len(text) > 8:
            return self.tok.encode(text, add_special_tokens=False).ids
        if text not in self.ends:
            self.ends[text] = self.tok.encode(text, add_special_tokens=False).ids
        return self.ends[text]

    def __call__(self, chunks: list[bytes]) -> list[list[int]]:
        out, others = [], []
        for k, c in enumerate(chunks):
            s = c.decode()
            stem = s.rstrip(ENDS)
            lower = stem.lower()
            if stem.isalpha() and (stem.isascii() or (lower.isalpha() and max(stem) < "\u0250")):
                out.append(self.word(lower) + self.end(s[len(stem) :]))
            else:
                out.append(None)
                others.append((k, s))
        for (k, _), e in zip(others, self.tok.encode_batch_fast([s for _, s in others], add_special_tokens=False), strict=True):
            out[k] = e.ids
        return out


def cuts_at_space(path: str) -> bool:
    """Whether the file's settings are those for which chunks between spaces stand alone, and no special token holds a space."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    plain = all(found.get(k) == v for k, v in CUTS_AT_SPACE.items()) and found["model"].get("type") == "BPE" and not found["model"].get("dropout")
    return plain and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"]) for t in found["added_tokens"])


class WholeEncoder:
    """Encodes whole texts with the tokenizers library, whatever its file prescribes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()

    def __call__(self, texts: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]


@functools.lru_cache(maxsize=2)
def tokeniser(path: str) -> PieceTable | WholeEncoder:
    """Where the vocabulary drops white space, texts are cut there and each chunk is encoded once. Lives as long as the worker."""
    return PieceTable(ChunkEncoder(path), CHUNKS_KEPT) if cuts_at_space(path) else WholeEncoder(path)


def token_ids(texts: list[bytes], table: PieceTable | WholeEncoder) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, each followed by the end id, and how many each has."""
    if isinstance(table, WholeEncoder):
        lists = table(texts)
        return np.array([i for x in lists for i in (*x, END_ID)], np.int32), np.fromiter((len(x) + 1 for x in lists), np.int64, len(lists))
    chunks, n_chunks = [], []
    for t in texts:
        words = t.split()
        chunks += words
        n_chunks.append(len(words))
    flat, per = table.ids(chunks)
    ends = np.cumsum([0, *n_chunks])
    upto = np.concatenate([[0], np.cumsum(per)])[ends]  # ids before each text
    out = np.insert(flat, upto[1:], END_ID)
    return out, np.diff(upto) + 1


STORE = "part int, segment int, first long, n long, doc_ids array<long>, lengths array<long>, payload binary"


def write_store(docs: DataFrame, tokenizer_path: str) -> str:
    """Write all documents; the path of the store."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, part = tokeniser(tokenizer_path), TaskContext.get().partitionId()
        segment, first, held = 0, 0, []

        def close():
            nonlocal segment, first, held
            ids = np.concatenate([x for _, x, _ in held])
            row = [part, segment, first, len(ids), sum((d for d, _, _ in held), []), np.concatenate([n for _, _, n in held]), encode(ids)]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            segment, first, held = segment + 1, first + len(ids), []
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=["part", "segment", "first", "n", "doc_ids", "lengths", "payload"])

        def strides():
            names, texts, used = [], [], 0
            for batch in batches:
                for doc_id, text in zip(batch.column("doc_id"), batch.column("text").cast(pa.binary()), strict=True):
                    names.append(doc_id.as_py())
                    texts.append(text.as_py() or b"")
                    used += len(texts[-1])
                    if used >= STRIDE or len(texts) >= 20_000:
                        yield names, texts
                        names, texts, used = [], [], 0
            if names:
                yield names, texts

        for names, texts in strides():
            ids, n = token_ids(texts, table)
            held.append((names, ids, n))
            if sum(len(x) for _, x, _ in held) >= SEGMENT:
                yield close()
        if held:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("tie"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    path = new_path(docs.sparkSession, "tokens")
    ordered.mapInArrow(run, STORE).write.parquet(path)
    return path


def read_store(spark, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids array<int>, from the store."""
    return _read(spark, path, "ids array<int>", lambda ids: pa.array(ids, pa.list_(pa.int32())), lambda x: x.astype(np.int32))


def summarise_store(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, from the store."""
    return _read(spark, path, "ids_crc32 long", lambda crcs: pa.array(crcs, pa.int64()), lambda x: zlib.crc32(x.astype("<u4").tobytes()))


def _offsets(store: DataFrame) -> tuple[dict[int, int], int]:
    """The ids before each part, one entry a partition, and all ids."""
    before, total = {}, 0
    for part, n in store.groupBy("part").agg(F.sum("n")).orderBy("part").collect():
        before[part], total = total, total + n
    return before, total


def token_at(spark, path: str, position: int) -> int:
    """The id at a position of the whole store, from the one segment that holds it."""
    store = spark.read.schema(STORE).parquet(path)
    before, total = _offsets(store)
    if not 0 <= position < total:
        raise IndexError(position)
    parts = list(before)
    part = parts[bisect.bisect_right(list(before.values()), position) - 1]
    local = position - before[part]
    own = store.where(F.col("part") == part)
    first = own.where(F.col("first") <= local).agg(F.max("first")).first()[0]  # reads no payload
    return get(own.where(F.col("first") == first).select("payload").first()[0], local - first)


def _read(spark, path: str, column: str, array, value) -> DataFrame:
    store = spark.read.schema(STORE).parquet(path)
    before, _ = _offsets(store)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, first, doc_ids, lengths, payload = (batch.column(c)[row] for c in ("part", "first", "doc_ids", "lengths", "payload"))
                ids, lengths = decode(payload.as_py()), lengths.values.to_numpy()
                ends = np.cumsum(lengths)
                starts = ends - lengths
                made = [value(ids[a:b]) for a, b in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.values, pa.array(starts + before[part.as_py()] + first.as_py(), pa.int64()), pa.array(lengths, pa.int64()), array(made)],
                    names=["doc_id", "start", "n_tokens", column.split()[0]],
                )

    return store.drop("segment", "n").mapInArrow(run, f"doc_id long, start long, n_tokens long, {column}")
