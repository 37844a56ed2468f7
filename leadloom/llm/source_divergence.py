"""Divergence between the sources of a language by a heavy-light split of its terms.

A term is a run of ASCII letters and non-ASCII characters with A-Z lower-cased; a language keeps the terms that at least
``MIN_DOCS`` of its rows hold. With V kept terms, count c and total N of a group, a term has the smoothed share
p = 1 + floor(SCALE * (c + 2) / (N + 2 * V)), and two shares differ by f = floor((p - q)^2 / (p + q)). All numbers are integers.

The sum of f over all kept terms, for all pairs of sources of a language, is made of two exact parts:

1. With z the share of a count of 0, a term that neither source has adds f(z, z'), which is the same for all such terms: V * f(z, z')
   is the base, and every other term adds what it differs from that.
2. Heavy terms, which more than ``LIGHT`` sources have, are cut into slices and the sources into blocks: a task fills a numpy tile of
   shares (terms of the slice by sources of two blocks) and adds f - f(z, z') for all its pairs.
3. Light terms are sparse. What a term of a source adds if the other lacks it depends on its count only, so that a histogram of
   counts stands for all light terms of a source. Where both have the term, its posting list (at most ``LIGHT`` long) gives
   pair corrections: f(p, q) - f(p, z') - f(z, q) + f(z, z').

Texts are counted in tasks, up to ``HELD`` different terms at a time, so that no (language, source), however large, lies in one task.

Defined cases: null text, lang and source count as ''; a source whose rows hold no kept term is compared like the others; with no
kept term all values are 0; repeated rows count again; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.llm.common import materialise

SCALE, MIN_DOCS, TOP = 1_000_000_000, 10, 10
#: A term of more sources than this is heavy.
LIGHT = 8
#: Heavy terms of a slice, sources of a block.
SLICE, BLOCK = 2048, 128
#: Different terms that a task counts before it hands them on.
HELD = 400_000

#: Lower-case A-Z, keep letters and bytes of non-ASCII characters, turn the rest into spaces.
TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TERMS).split()


def share_column(count: Column, total: Column, kept: Column, scale: int = SCALE) -> Column:
    """1 + floor(scale * (count + 2) / (total + 2 * kept)) of long columns, null without kept terms; decimals hold the product."""
    product = (count + 2).cast("decimal(19,0)") * F.lit(scale).cast("decimal(10,0)")
    whole = F.call_function("div", product, (total + 2 * kept).cast("decimal(29,0)"))
    return F.when(total + 2 * kept > 0, whole + 1).cast("long")


def difference(p, q):
    """floor((p - q)^2 / (p + q)) of integers or arrays; shares are at most SCALE + 1, so that squares stay below 2**63."""
    d = p - q
    return d * d // (p + q)


def _difference(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def count_terms(docs: DataFrame, held: int = HELD) -> DataFrame:
    """lang, source, term, n (occurrences), docs (rows that hold it): partial counts; term '' stands for the group itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, tuple[Counter, Counter]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, rows) in total.items():
                keys = list(n)
                for lo in range(0, len(keys), 1 << 16):
                    some = keys[lo : lo + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([lang] * len(some), pa.string()), pa.array([source] * len(some), pa.string()), pa.array(some, pa.binary()).cast(pa.string()),
                        pa.array([n[k] for k in some], pa.int64()), pa.array([rows[k] for k in some], pa.int64()),
                    ], names=["lang", "source", "term", "n", "docs"])
            total.clear()

        for batch in batches:
            langs, sources, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())
            for lang, source, text in zip(langs, sources, texts, strict=True):
                words = terms_of(text.as_py())
                got = total.get((lang, source))
                if got is None:
                    got = total[lang, source] = Counter({b"": 0}), Counter()
                before = len(got[0])
                got[0].update(words)
                got[1].update(set(words))
                size += len(got[0]) - before
                if size > held:
                    yield from flush()
                    size = 0
        yield from flush()

    some = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), "text")
    return some.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def kept_counts(docs: DataFrame, min_docs: int = MIN_DOCS, light: int = LIGHT) -> DataFrame:
    """Written: lang, source, term, n of kept terms and of '' (every group), lang_n (of the language), heavy, first (one row a lang and term)."""
    # one exchange by (lang, term) serves the sums by source and the sums by language
    by_source = count_terms(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    seen = by_source.select(
        "lang", "source", "term", "n", F.sum("docs").over(term).alias("df"), F.sum("n").over(term).alias("lang_n"),
        (F.count("*").over(term) > light).alias("heavy"), (F.row_number().over(term.orderBy("source")) == 1).alias("first"),
    )
    return materialise(seen.where((F.col("term") == "") | (F.col("df") >= min_docs)).drop("df"), "kept")


def group_table(kept: DataFrame, slice_terms: int = SLICE, block: int = BLOCK) -> DataFrame:
    """Written, a row a group: lang, source, at (its number in the language), v, total, lang_total, zero (the share of a count of 0), slices, blocks."""
    word = F.col("term") != ""
    sums = kept.groupBy("lang", "source").agg(
        F.sum("n").alias("total"), F.count_if(word & F.col("first")).alias("firsts"), F.count_if(word & F.col("first") & F.col("heavy")).alias("heavies")
    )
    lang = Window.partitionBy("lang")
    sums = sums.select(
        "lang", "source", (F.row_number().over(lang.orderBy("source")) - 1).cast("long").alias("at"), F.sum("firsts").over(lang).alias("v"), "total",
        F.sum("total").over(lang).alias("lang_total"), F.sum("heavies").over(lang).alias("heavies"), F.count("*").over(lang).alias("groups"),
    )
    zero = share_column(F.lit(0).cast("long"), F.col("total"), F.col("v"))
    sized = sums.withColumns({
        "zero": F.coalesce(zero, F.lit(1).cast("long")), "slices": F.ceil(F.col("heavies") / slice_terms).cast("int"), "blocks": F.ceil(F.col("groups") / block).cast("int"),
    })
    return materialise(sized.drop("heavies", "groups"), "groups")


TILE = "lang string, a long, b long, part long"


def tile(rows: pa.Table) -> pa.Table:
    """The part of one slice of terms for all pairs of sources in one pair of blocks.

    Rows of kind 0 are the sources (p: share of 0; weight: V in slice 0, else 0), of kind 1 the histogram of the light counts of a
    source (p, weight: how many terms), of kind 2 the counts of heavy terms (p, term)."""
    kind = rows.column("kind").to_numpy()
    at, p, weight = (rows.column(c).to_numpy() for c in ("at", "p", "weight"))
    left, right = rows.column("left")[0].as_py(), rows.column("right")[0].as_py()
    block = rows.column("block").to_numpy()
    base = kind == 0
    order = np.argsort(at[base])
    who, zero, where = at[base][order], p[base][order], block[base][order]
    kept = int(weight[base][0])
    rank = np.searchsorted(who, at)
    light, heavy = kind == 1, kind == 2
    _, term = np.unique(rows.column("term").to_numpy(zero_copy_only=False)[heavy].astype(object), return_inverse=True) if heavy.any() else (None, np.empty(0, np.int64))
    shares = np.repeat(zero[:, None], int(term.max()) + 1 if len(term) else 0, 1)
    shares[rank[heavy], term] = p[heavy]
    out_a, out_b, parts = [], [], []
    by_light = [(p[light & (rank == i)], weight[light & (rank == i)]) for i in range(len(who))]

    def lacking(i: int, j: int, none: int) -> int:
        """The light terms of source i as if j had none of them."""
        counts, times = by_light[i]
        return ((difference(counts, zero[j]) - none) * times).sum()

    for i in np.flatnonzero(where == left):
        others = np.flatnonzero((where == right) & (who > who[i]))
        if not len(others):
            continue
        none = difference(zero[i], zero[others])
        part = kept * none + (difference(shares[i], shares[others]) - none[:, None]).sum(1)
        part += np.array([lacking(i, j, z) + lacking(j, i, z) for j, z in zip(others, none, strict=True)], np.int64)
        out_a.append(np.full(len(others), who[i]))
        out_b.append(who[others])
        parts.append(part)
    n = sum(map(len, parts))
    made = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (out_a, out_b, parts)]
    return pa.table([pa.array([rows.column("lang")[0].as_py()] * n, pa.string()), *map(pa.array, made)], names=["lang", "a", "b", "part"])


def tiles(kept: DataFrame, groups: DataFrame, block: int = BLOCK) -> DataFrame:
    """lang, a, b, part: the base, the light terms that one of both lacks, and the heavy terms, a row a pair and slice."""
    own = groups.select("lang", "source", "at", "v", "total", "slices", "blocks", "zero")
    counted = kept.where("term <> ''").join(own, ["lang", "source"])
    p = share_column(F.col("n"), F.col("total"), F.col("v"))
    heavy = counted.where("heavy").select(
        "lang", "at", "blocks", (F.pmod(F.xxhash64("term"), F.col("slices")) + 1).cast("int").alias("slice"), F.lit(2).alias("kind"), p.alias("p"), F.lit(0).cast("long").alias("weight"), "term"
    )
    light = counted.where("not heavy").groupBy("lang", "at", "blocks", "n", "total", "v").agg(F.count("*").alias("weight"))
    light = light.select("lang", "at", "blocks", F.lit(0).alias("slice"), F.lit(1).alias("kind"), p.alias("p"), "weight", F.lit("").alias("term"))
    base = own.select("lang", "at", "blocks", "v", "zero", F.explode(F.sequence(F.lit(0), "slices")).alias("slice"))
    base = base.select("lang", "at", "blocks", "slice", F.lit(0).alias("kind"), F.col("zero").alias("p"), F.when(F.col("slice") == 0, F.col("v")).otherwise(0).alias("weight"), F.lit("").alias("term"))
    rows = base.unionByName(light).unionByName(heavy).withColumn("block", (F.col("at") / block).cast("int"))
    # a source takes part in the pairs of its block with each block
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = rows.select("*", other).select("*", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right")).drop("other", "blocks")
    return rows.groupBy("lang", "slice", "left", "right").applyInArrow(tile, TILE)


def pair_corrections(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, a, b, part: what light terms that both sources have add beyond the histograms."""
    own = groups.select("lang", "source", "at", "v", "total", "zero")
    posting = F.struct("at", share_column(F.col("n"), F.col("total"), F.col("v")).alias("p"), "zero")
    lists = kept.where("term <> '' and not heavy").join(own, ["lang", "source"]).groupBy("lang", "term").agg(F.sort_array(F.collect_list(posting)).alias("postings"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            names, lang = langs.dictionary, langs.indices.to_numpy().astype(np.int64)
            lists = batch.column(1)
            start = lists.offsets.to_numpy().astype(np.int64)
            size = np.diff(start)
            at, p, zero = (lists.values.field(k).to_numpy() for k in range(3))
            keys, parts = [], []
            # all lists of one length at once, place by place
            for length in np.unique(size[size > 1]):
                rows = np.flatnonzero(size == length)
                first = start[rows]
                for i, j in combinations(range(length), 2):
                    x, y = first + i, first + j
                    both = difference(p[x], p[y]) - difference(p[x], zero[y]) - difference(zero[x], p[y]) + difference(zero[x], zero[y])
                    keys.append(np.stack([lang[rows], at[x], at[y]]))
                    parts.append(both)
            if not keys:
                continue
            pairs, which = np.unique(np.concatenate(keys, 1), axis=1, return_inverse=True)
            sums = np.zeros(pairs.shape[1], np.int64)
            np.add.at(sums, which.ravel(), np.concatenate(parts))
            yield pa.RecordBatch.from_arrays([names.take(pa.array(pairs[0])), pa.array(pairs[1]), pa.array(pairs[2]), pa.array(sums)], names=["lang", "a", "b", "part"])

    return lists.where(F.size("postings") > 1).select("lang", "postings").mapInArrow(run, TILE)


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, light: int = LIGHT, slice_terms: int = SLICE, block: int = BLOCK) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank.

    ``pair``: every other source of the language with the sum over all kept terms. ``term``: the ``top`` terms that the source uses more
    than its language does."""
    kept = kept_counts(docs, min_docs, light)
    groups = group_table(kept, slice_terms, block)
    sums = tiles(kept, groups, block).union(pair_corrections(kept, groups)).groupBy("lang", "a", "b").agg(F.sum("part").alias("value"))
    names = groups.select("lang", "at", "source")
    both = sums.join(names.toDF("lang", "a", "x"), ["lang", "a"]).join(names.toDF("lang", "b", "y"), ["lang", "b"])
    ends = F.explode(F.array(F.struct(F.col("x").alias("source"), F.col("y").alias("item")), F.struct(F.col("y").alias("source"), F.col("x").alias("item"))))
    pairs = both.select("lang", ends.alias("e"), "value").select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value")

    counted = kept.where("term <> '' and n > 0").join(groups.select("lang", "source", "v", "total", "lang_total"), ["lang", "source"])
    own, whole = share_column(F.col("n"), F.col("total"), F.col("v")), share_column(F.col("lang_n"), F.col("lang_total"), F.col("v"))
    shares = counted.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), own.alias("p"), whole.alias("q")).where("p > q")
    terms = shares.select("lang", "source", "part", "item", _difference("p", "q").alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(ranked)
