"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

The pieces and scores are those of a SentencePiece BPE model. An agenda holds the candidate merges; the best score comes
first, then the leftmost. When a candidate's turn comes, a hash keyed by seed, document, place of the chunk in it and the
candidate's three boundaries decides whether it is skipped, so that the same candidate of an occurrence is always skipped or
never. Merges never cross the border between a non-space and a space, or a line break, so texts are cut there. Many chunks
are merged in step with numpy; long chunks take the heap.

Only what no draw decides is remembered: for a chunk and the candidates skipped so far, the merges that follow if nothing
else is skipped, and the symbols at their end. Every occurrence tests its own hashes along these merges; at the first that
it skips it goes on to the merges that follow that skip. A chunk that is seen for the first time is merged with its draws at
once; it is remembered from the second time on. Both ways give the same result.

With a rate of 0 the result is the library's own. Characters outside the vocabulary, and a literal U+2581, become their
UTF-8 bytes, so decoding gives back every text exactly.

Defined cases: null and empty texts have no ids and decode to the empty text; repeated rows get equal ids; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import heapq
import re
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import release

RATE, SEED = 0.1, 20240601
SPACE = "▁"
CUT = re.compile(r" *[^ \n]+| +|\n")
#: Chunks longer than LONG take the heap; merges of those up to SHORT are remembered. Bytes of text that are encoded at once.
LONG, SHORT, STRIDE = 48, 24, 1 << 20
#: Lengths of chunks that are padded to one width: over the first, up to the second number.
BANDS = ((0, 4), (4, 6), (6, 8), (8, 10), (10, 12), (12, 16), (16, SHORT))
NEW, LARGE = -1, -2
#: A symbol that nothing merges with, after the end of a chunk.
PAD = 1 << 40
NONE = np.int32(2**31 - 1)
U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def candidate(start, mid, end):
    """The number of the candidate that joins [start, mid) and [mid, end) of a chunk."""
    start, mid, end = (np.atleast_1d(np.asarray(x, U)) for x in (start, mid, end))
    return start * U(0x9E3779B97F4A7C15) ^ mid * U(0xC2B2AE3D27D4EB4F) ^ end * U(0x165667B19E3779F9)


def drop_hash(key, start, mid, end):
    """The hash that decides on a candidate."""
    return _mix(_mix(np.atleast_1d(np.asarray(key, U))) + candidate(start, mid, end))


class Model:
    """Pieces of a model: ids by text, ranks of merges, bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = size = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(size)]
        normal = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        ids = {pieces[i]: i for i in normal}
        if any("\n" in p for p in ids):
            raise ValueError("pieces with line breaks are not supported")
        order = {s: r for r, s in enumerate(sorted({sp.get_score(i) for i in normal}, reverse=True))}
        self.rank = np.full(size, NONE, np.int32)
        for i in normal:
            self.rank[i] = order[sp.get_score(i)]
        self.byte_id = np.zeros(256, np.int32)
        of = {i: pieces[i].replace(SPACE, " ").encode() for i in normal}
        for i in range(size):
            if sp.is_byte(i):
                value = int(pieces[i][3:5], 16)
                self.byte_id[value], of[i] = i, bytes([value])
        self.bytes_of = [of.get(i, b"") for i in range(size)]
        #: Symbol of each code point: a piece, or the size plus the code point.
        self.symbol = np.arange(size, size + 0x110000, dtype=np.int64)
        for p, i in ids.items():
            if len(p) == 1 and p != SPACE:
                self.symbol[ord(p)] = i
        if SPACE in ids:
            self.symbol[ord(" ")] = ids[SPACE]
        pairs = {}
        for p, i in ids.items():
            for k in range(1, len(p)):
                left, right = ids.get(p[:k]), ids.get(p[k:])
                if left is not None and right is not None:
                    pairs[left * size + right] = i
        self.pairs = pairs
        #: Pairs by hash, each in the first free place from its own on; at most an eighth of the places are taken.
        self.bits = max(4, (8 * len(pairs)).bit_length())
        self.pair_keys, self.pair_ids = np.full((1 << self.bits) + 64, -2, np.int64), np.full((1 << self.bits) + 64, -1, np.int64)
        keys = np.fromiter(pairs, np.int64, len(pairs))
        for k, at in zip(keys.tolist(), self.place(keys).tolist(), strict=True):
            while self.pair_keys[at] != -2:
                at += 1
            self.pair_keys[at], self.pair_ids[at] = k, pairs[k]

    def place(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(U) * U(0x9E3779B97F4A7C15)) >> U(64 - self.bits)).view(np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair of symbols makes, or -1."""
        key = np.where((left < self.size) & (right < self.size), left * self.size + right, -1)
        at = self.place(key)
        there = self.pair_keys[at]
        out = np.where(there == key, self.pair_ids[at], -1)
        more = np.nonzero((there != key) & (there != -2) & (key >= 0))
        step = 0
        while more[0].size:  # taken by another pair
            step += 1
            there = self.pair_keys[at[more] + step]
            same = there == key[more]
            found = tuple(m[same] for m in more)
            out[found] = self.pair_ids[at[found] + step]
            go_on = ~same & (there != -2)
            more = tuple(m[go_on] for m in more)
        return out

    def heap(self, symbols: list[int], key: int, limit: int) -> list[int]:
        """One chunk, by a heap. limit: candidates whose hash is below are skipped."""
        sym, n = list(symbols), len(symbols)
        nxt, prv, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        agenda: list = []

        def offer(i):
            j = nxt[i]
            if j < n and sym[i] < self.size and sym[j] < self.size and (m := self.pairs.get(sym[i] * self.size + sym[j])) is not None:
                heapq.heappush(agenda, (int(self.rank[m]), i, end[i], end[j], m))

        for i in range(n - 1):
            offer(i)
        while agenda:
            _, i, mid, stop, m = heapq.heappop(agenda)
            j = nxt[i] if i < n else n
            if sym[i] < 0 or end[i] != mid or j >= n or end[j] != stop:
                continue
            if limit and int(drop_hash(key, i, mid, stop)[0]) < limit:
                continue
            sym[i], sym[j], end[i], nxt[i] = m, -1, stop, nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            offer(i)
            if prv[i] >= 0:
                offer(prv[i])
        return [s for s in sym if s >= 0]

    def in_step(self, symbols: np.ndarray, keys: np.ndarray, limit: int, skips: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Chunks of one length, a row each: yields (rows, symbols, merged candidates) as they end. skips: the candidates of each row that are skipped, in place of a hash; only with it are the merged ones noted."""
        n, width = symbols.shape
        done, path = 0, np.zeros((n, max(width - 1, 0) if skips is not None else 0), U)
        rows, sym, at = np.arange(n), symbols, np.tile(np.arange(width + 1), (n, 1))

        def rank(left, right, k, skip, a, b, c):
            m = self.merged(left, right)
            r = np.where(m >= 0, self.rank[m], NONE)
            if skip is not None:
                if skip.shape[-1]:
                    r[(candidate(a, b, c)[..., None] == skip).any(-1)] = NONE
            elif limit:
                r = np.where((m >= 0) & (drop_hash(k, a, b, c) < U(limit)), NONE, r)
            return r

        ranks = rank(sym[:, :-1], sym[:, 1:], keys[:, None], None if skips is None else skips[:, None], at[:, :-2], at[:, 1:-1], at[:, 2:])
        while True:
            best = ranks.argmin(1) if width > 1 else np.zeros(len(rows), np.int64)
            live = ranks[np.arange(len(rows)), best] != NONE if width > 1 else np.zeros(len(rows), bool)
            if not live.all():
                yield rows[~live], sym[~live], path[~live, :done]
                rows, sym, at, ranks, keys, best, path = (x[live] for x in (rows, sym, at, ranks, keys, best, path))
                skips = skips if skips is None else skips[live]
                if not len(rows):
                    return
            k = np.arange(len(rows))
            if skips is not None:
                path[:, done] = candidate(at[k, best], at[k, best + 1], at[k, best + 2])
                done += 1
            sym[k, best] = self.merged(sym[k, best], sym[k, best + 1])
            keep = np.ones(sym.shape, bool)
            keep[k, best + 1] = False
            sym = sym[keep].reshape(len(rows), width - 1)
            keep = np.ones(at.shape, bool)
            keep[k, best + 1] = False
            at = at[keep].reshape(len(rows), width)
            keep = np.ones(ranks.shape, bool)
            keep[k, best] = False
            ranks = ranks[keep].reshape(len(rows), width - 2)
            width -= 1
            for side in (best - 1, best):  # the pairs left and right of the new symbol
                ok = np.flatnonzero((side >= 0) & (side < width - 1))
                s = side[ok]
                ranks[ok, s] = rank(sym[ok, s], sym[ok, s + 1], keys[ok], None if skips is None else skips[ok], at[ok, s], at[ok, s + 1], at[ok, s + 2])

    def encode(self, chunks: list[str], keys: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks, one after the other, and how many each has."""
        points = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        starts = np.cumsum(lengths) - lengths
        symbols = self.symbol[points]
        counts, done = np.zeros(len(chunks), np.int64), []
        for width in np.unique(lengths).tolist():
            which = np.flatnonzero(lengths == width)
            if width > LONG:
                for k in which.tolist():
                    got = np.array(self.heap(symbols[starts[k] : starts[k] + width].tolist(), int(keys[k]), limit))[None]
                    counts[k] = got.shape[1]
                    done.append((np.array([k]), got))
                continue
            for rows, got, _ in self.in_step(symbols[starts[which][:, None] + np.arange(width)], keys[which], limit):
                counts[which[rows]] = got.shape[1]
                done.append((which[rows], got))
        first = np.cumsum(counts) - counts
        flat = np.empty(int(counts.sum()), np.int64)
        for rows, got in done:
            flat[first[rows][:, None] + np.arange(got.shape[1])] = got
        return self.spelt(flat, counts)

    def drawn(self, chunks: list[str], keys: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """``encode`` for chunks of at most SHORT characters, which are padded to a few widths."""
        points = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        starts = np.cumsum(lengths) - lengths
        symbols = np.concatenate([self.symbol[points], [PAD]])
        counts, done = np.zeros(len(chunks), np.int64), []
        for low, width in BANDS:
            which = np.flatnonzero((lengths > low) & (lengths <= width))
            if which.size:
                place = np.arange(width)
                padded = symbols[np.where(place < lengths[which][:, None], starts[which][:, None] + place, len(points))]
                for rows, got, _ in self.in_step(padded, keys[which], limit):
                    counts[which[rows]] = (got != PAD).sum(1)
                    done.append((which[rows], got))
        flat, first = np.empty(int(counts.sum()), np.int64), np.cumsum(counts) - counts
        for of, got in done:
            row, col = np.nonzero(got != PAD)
            flat[first[of][row] + col] = got[row, col]
        return self.spelt(flat, counts)

    def walks(self, chunks: list[str], skips: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For chunks of at most SHORT characters and the candidates that each skips (0: none): ids and how many each has, merged candidates and how many each has."""
        points = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        starts = np.cumsum(lengths) - lengths
        symbols = np.concatenate([self.symbol[points], [PAD]])
        counts, steps, done = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64), []
        none = np.zeros(len(chunks), U)
        for low, width in BANDS:
            which = np.flatnonzero((lengths > low) & (lengths <= width))
            if not which.size:
                continue
            place = np.arange(width)
            padded = symbols[np.where(place < lengths[which][:, None], starts[which][:, None] + place, len(points))]
            for rows, got, path in self.in_step(padded, none[which], 0, skips[which]):
                of = which[rows]
                counts[of], steps[of] = (got != PAD).sum(1), path.shape[1]
                done.append((of, got, path))
        flat, paths = np.empty(int(counts.sum()), np.int64), np.empty(int(steps.sum()), U)
        first, begin = np.cumsum(counts) - counts, np.cumsum(steps) - steps
        for of, got, path in done:
            row, col = np.nonzero(got != PAD)
            flat[first[of][row] + col] = got[row, col]
            paths[begin[of][:, None] + np.arange(path.shape[1])] = path
        return *self.spelt(flat, counts), paths, steps

    def spelt(self, flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols, and how many each chunk has, with those outside the vocabulary as bytes."""
        first = np.cumsum(counts) - counts
        odd = np.flatnonzero(flat >= self.size)
        if odd.size:  # bytes
            spelt = [self.byte_id[list(chr(c - self.size).encode("utf-8", "surrogatepass"))] for c in flat[odd].tolist()]
            more = np.fromiter((len(x) - 1 for x in spelt), np.int64, len(spelt))
            np.add.at(counts, np.searchsorted(first, odd, "right") - 1, more)
            reps = np.ones(len(flat), np.int64)
            reps[odd] += more
            where = np.repeat(reps > 1, reps)
            single = np.zeros(len(flat), bool)
            single[odd[more == 0]] = True
            where |= np.repeat(single, reps)
            flat = np.repeat(flat, reps)
            flat[where] = np.concatenate(spelt)
        return flat.astype(np.int32), counts

    def decode(self, ids) -> bytes:
        """The text of the ids, in UTF-8."""
        return b"".join(map(self.bytes_of.__getitem__, ids))[1:]


@functools.lru_cache(maxsize=2)
def load(path: str) -> Model:
    return Model(path)


class Segmenter:
    """Encodes texts; remembers what follows a chunk and its skips, as nodes. Emptied when it holds more than ``limit`` nodes.

    once: chunks that were seen once, which are not remembered yet.
    """

    def __init__(self, model: Model, rate: float = RATE, seed: int = SEED, limit: int = 100_000):
        self.model, self.seed, self.limit = model, seed, limit
        self.below = min(int(rate * 2**64), 2**64 - 1)
        self.clear()

    def clear(self) -> None:
        self.slot, self.names, self.nodes, self.once = {}, [], 0, set()
        #: By chunk: its first node. By node: chunk, node before, candidate skipped there, skips so far, ids, merged candidates.
        self.root = np.full(1024, -1, np.int64)
        self.chunk, self.before, self.depth, self.starts, self.counts, self.first, self.steps = (np.zeros(1024, np.int64) for _ in range(7))
        self.skip = np.zeros(1024, U)
        self.flat, self.used = np.zeros(4096, np.int32), 0
        #: Merged candidates of all nodes, and the node that follows if one is skipped.
        self.paths, self.child, self.walked = np.zeros(4096, U), np.full(4096, -1, np.int64), 0

    def room(self, fields: tuple, size: int) -> None:
        for f in fields:
            old = getattr(self, f)
            if len(old) < size:
                new = np.full(max(size, 2 * len(old)), -1 if f in ("root", "child") else 0, old.dtype)
                new[: len(old)] = old
                setattr(self, f, new)

    def add(self, chunk: np.ndarray, before: np.ndarray, skip: np.ndarray) -> np.ndarray:
        """New nodes: a chunk after one more skip than the node before (-1: none)."""
        n = len(chunk)
        new = np.arange(self.nodes, self.nodes + n)
        self.nodes += n
        self.room(("chunk", "before", "skip", "depth", "starts", "counts", "first", "steps"), self.nodes)
        self.chunk[new], self.before[new], self.skip[new] = chunk, before, skip
        self.depth[new] = depth = np.where(before >= 0, self.depth[before] + 1, 0)
        skips, at = np.zeros((n, int(depth.max(initial=0))), U), new
        for k in range(skips.shape[1]):
            skips[:, k] = np.where(self.depth[at] > 0, self.skip[at], U(0))
            at = np.where(self.depth[at] > 0, self.before[at], at)
        flat, counts, paths, steps = self.model.walks([self.names[k] for k in chunk.tolist()], skips)
        self.room(("flat",), self.used + len(flat))
        self.room(("paths", "child"), self.walked + len(paths))
        self.starts[new], self.counts[new] = self.used + np.cumsum(counts) - counts, counts
        self.first[new], self.steps[new] = self.walked + np.cumsum(steps) - steps, steps
        self.flat[self.used : self.used + len(flat)] = flat
        self.paths[self.walked : self.walked + len(paths)] = paths
        self.child[self.walked : self.walked + len(paths)] = -1
        self.used, self.walked = self.used + len(flat), self.walked + len(paths)
        return new

    def leaves(self, slots: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The node at which each occurrence ends."""
        self.room(("root",), len(self.names))
        if (miss := np.unique(slots[self.root[slots] < 0])).size:
            self.root[miss] = self.add(miss, np.full(len(miss), -1), np.zeros(len(miss), U))
        node = self.root[slots]
        if not self.below:
            return node
        keys, rows, done = _mix(keys), np.arange(len(node)), np.zeros(len(node), np.int64)
        while len(rows):
            # the merges before the last skip are the same and have passed
            begin = self.first[node[rows]] + done[rows]
            n = self.steps[node[rows]] - done[rows]
            ends = np.cumsum(n)
            at = np.repeat(begin - (ends - n), n) + np.arange(int(n.sum()))
            hit = np.flatnonzero(_mix(np.repeat(keys[rows], n) + self.paths[at]) < U(self.below))
            of = np.searchsorted(ends, hit, "right")
            one = np.flatnonzero(np.diff(of, prepend=-1))
            hit, rows = at[hit[one]], rows[of[one]]
            done[rows] = hit - self.first[node[rows]]
            if (miss := np.flatnonzero(self.child[hit] < 0)).size:
                place, which = np.unique(hit[miss], return_index=True)
                before = node[rows[miss[which]]]
                new = self.add(self.chunk[before], before, self.paths[place])
                self.child[place] = new
            node[rows] = self.child[hit]
        return node

    def slots(self, chunks: list[str], lengths: np.ndarray) -> np.ndarray:
        """The number of each chunk, NEW for those that are seen for the first time, and LARGE for those over SHORT characters."""
        get, once, out = self.slot.get, self.once, np.fromiter(map(self.slot.get, chunks, repeat(NEW)), np.int64, len(chunks))
        out[lengths > SHORT] = LARGE
        if len(once) > self.limit:
            once.clear()
        for k in np.flatnonzero(out == NEW).tolist():
            c = chunks[k]
            if c in once:  # the second time
                once.remove(c)
                out[k] = self.slot[c] = len(self.names)
                self.names.append(c)
            else:
                out[k] = at = get(c, NEW)
                if at == NEW:
                    once.add(c)
        return out

    def ids(self, texts: list[str], doc_keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has."""
        if self.nodes > self.limit:
            self.clear()
        cut, n_chunks = [], []
        for t in texts:
            found = CUT.findall(" " + t) if t else []
            cut += found
            n_chunks.append(len(found))
        n_chunks = np.array(n_chunks, np.int64)
        place = np.arange(len(cut)) - np.repeat(np.cumsum(n_chunks) - n_chunks, n_chunks)
        keys = np.repeat(np.array(doc_keys, U), n_chunks) + place.astype(U) * U(0x9E3779B97F4A7C15) + U(self.seed)
        lengths = np.fromiter(map(len, cut), np.int64, len(cut))
        slots = self.slots(cut, lengths)
        known, new, long = np.flatnonzero(slots >= 0), np.flatnonzero(slots == NEW), np.flatnonzero(slots == LARGE)
        starts, n = np.empty(len(cut), np.int64), np.empty(len(cut), np.int64)
        node, kept = self.leaves(slots[known], keys[known]), self.used
        starts[known], n[known] = self.starts[node], self.counts[node]
        for which, encode in ((new, self.model.drawn), (long, self.model.encode)):
            if which.size:  # every occurrence by itself; its ids are not kept
                flat, n[which] = encode([cut[k] for k in which.tolist()], keys[which], self.below)
                self.room(("flat",), self.used + len(flat))
                self.flat[self.used : self.used + len(flat)] = flat
                starts[which] = self.used + np.cumsum(n[which]) - n[which]
                self.used += len(flat)
        self.used = kept
        ends = np.cumsum(n)
        out = self.flat[np.repeat(starts - (ends - n), n) + np.arange(int(n.sum()))]
        upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n_chunks)])]
        return out, np.diff(upto)


def encode(docs: DataFrame, model_path: str, rate: float = RATE, seed: int = SEED) -> DataFrame:
    """doc_id, n_pieces, ids array<int>, decoded_crc32 (of the text that the ids decode to), lossless."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        segmenter = Segmenter(model, rate, seed)  # its memory goes with the task

        def flush(names, texts):
            ids, n = segmenter.ids([t.decode() for t in texts], [xxhash.xxh3_64_intdigest(str(x)) for x in names])
            offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            array = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))
            back = [model.decode(ids[a:b].tolist()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            same = [x == y for x, y in zip(back, texts, strict=True)]
            crc = [zlib.crc32(x) for x in back]
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(n, pa.int64()), array, pa.array(crc, pa.int64()), pa.array(same)], names=["doc_id", "n_pieces", "ids", "decoded_crc32", "lossless"])

        for batch in batches:
            names, texts, used = [], [], 0
            for doc_id, text in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
                names.append(doc_id.as_py())
                texts.append(text.as_py() or b"")
                used += len(texts[-1])
                if used >= STRIDE:
                    yield flush(names, texts)
                    names, texts, used = [], [], 0
            if names:
                yield flush(names, texts)
        segmenter.clear()
        release()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_pieces long, ids array<int>, decoded_crc32 long, lossless boolean")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """encoded with its ids turned into text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        for batch in batches:
            texts = [model.decode(x.as_py() or []).decode() for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
