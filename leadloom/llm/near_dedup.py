"""Near-duplicate detection by min-max hashing, banding, exact confirmation and connected components.

A document's set: its distinct 5-word shingles (words split on ASCII white space after lower-casing A-Z), as 64-bit
hashes. Under each permutation both the least and the greatest value are kept, so that 64 permutations give a signature
of 128 values. They are banded four by four: at a similarity of 0.75, a pair misses all 32 bands with a probability of
5e-6. Then:

1. Documents with equal sets become one class (combined on the map side, so a group of copies is one row a task).
2. In each band bucket, every class is compared with two pivots only, the least and the greatest class id. Class ids follow
   a hash of the set, in one order for all bands, so the buckets of a group mostly have the same pivots.
3. Confirmed links are contracted to a forest, about one edge a member, before they give components. In buckets that hold
   several components still, members that share less than three quarters of their set with any other drop out, and the
   others are compared with the most typical member of their bucket.
4. Pairs in different components then either share shingles inside that member only, and the lesser intersection with it
   bounds theirs, or share one outside it, and an inverted index over the rarest of those finds them. Only pairs that sizes
   and these bounds allow are compared, so that no link between components is lost and groups of near copies, or documents
   with a common passage, never become all pairs.

Defined cases: null, empty or wordless text has an empty set and is linked with nothing; fewer than five words form one
shingle; repeated rows share a decision; component_id is null only if all ids of the component are; an empty table gives
an empty result; other columns are ignored, and ``drop_near_copies`` passes them through, whatever their names. Of rows with one
doc_id and different texts, each goes or stays by its own text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import LOWER, fresh, materialise

SHINGLE, PERMUTATIONS, ROWS, PERCENT = 5, 64, 4, 75
U = np.uint64
#: Words that are hashed at once.
CHUNK = 1 << 17


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, in place."""
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(LOWER).split()


def shingle_set(words: list[bytes], cache: dict[bytes, int], size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes. cache: hashes of words, emptied when it is large."""
    if not words:
        return np.empty(0, U)
    if len(cache) > 200_000:
        cache.clear()
    get, h = cache.get, []
    for w in words:
        x = get(w)
        if x is None:
            x = cache[w] = xxhash.xxh3_64_intdigest(w)
        h.append(x)
    v = np.array(h, U)
    k = min(size, len(v))
    out = np.full(len(v) - k + 1, k, U)
    for i in range(k):
        out = mix(out * U(0x9E3779B97F4A7C15) + v[i : len(v) - k + 1 + i])
    return np.unique(out)


def _coefficients(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U) * U(0xD1342543DE82EF95)) | U(1)


def band_keys(sets: list[np.ndarray], permutations: int = PERMUTATIONS, rows: int = ROWS) -> np.ndarray:
    """A row of band hashes for each non-empty set."""
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    flat = np.concatenate(sets)
    signature = np.empty((2 * permutations, len(sets)), U)
    for k, (a, b) in enumerate(_coefficients(2 * permutations).reshape(-1, 2)):
        x = flat * a
        x += b
        x ^= x >> U(32)
        signature[2 * k] = np.minimum.reduceat(x, starts)
        signature[2 * k + 1] = np.maximum.reduceat(x, starts)
    bands = 2 * permutations // rows
    keys = np.repeat(np.arange(1, bands + 1, dtype=U)[:, None], len(sets), 1)
    for r in range(rows):
        keys = mix(keys * U(0x9E3779B97F4A7C15) + signature[r : bands * rows : rows])
    return keys.T.view(np.int64)


SIGNED = "doc_id bigint, text_key bigint, n_shingles bigint, c0 bigint, c1 bigint, bands array<bigint>"


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (a hash of the text as it is), n_shingles, c0 and c1 (128 bits that name the set), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, int] = {}

        def flush(ids, keyed, sets):
            full = [s for s in sets if len(s)]
            keys = iter(band_keys(full)) if full else iter(())
            names = [np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64) for s in sets]
            return pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array(keyed, pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([x[0] for x in names], pa.int64()), pa.array([x[1] for x in names], pa.int64()), pa.array([next(keys) if len(s) else [] for s in sets], pa.list_(pa.int64())),
            ], names=["doc_id", "text_key", "n_shingles", "c0", "c1", "bands"])

        for batch in batches:
            ids, keyed, sets, used = [], [], [], 0
            for doc_id, text, key in zip(batch.column(0), batch.column(1).cast(pa.binary()), batch.column(2), strict=True):
                s = shingle_set(words_of(text.as_py()), cache)
                ids.append(doc_id.as_py())
                keyed.append(key.as_py())
                sets.append(s)
                used += len(s)
                if used > CHUNK:
                    yield flush(ids, keyed, sets)
                    ids, keyed, sets, used = [], [], [], 0
            if ids:
                yield flush(ids, keyed, sets)

    return docs.select(F.col("doc_id").cast("long"), "text", _text_key()).mapInArrow(run, SIGNED)


def _text_key():
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key")


def _sets(texts: DataFrame) -> DataFrame:
    """cid, shingles (the sorted set as bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, int] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                made = [shingle_set(words_of(t.as_py()), cache).tobytes() for t in part.column(1).cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.binary())], names=["cid", "shingles"])

    return texts.mapInArrow(run, "cid long, shingles binary")


def _fits(a: str, b: str):
    """Sizes allow a similarity of 0.75."""
    return 100 * F.least(F.col(a), F.col(b)) >= PERCENT * F.greatest(F.col(a), F.col(b))


def common_counts(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, na, nb, common: the sizes of the sets and of their intersection, from the full sets."""
    one = sets.select(F.col("cid").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("cid").alias("b"), F.col("shingles").alias("sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("sa"), batch.column("sb")
            common = [
                len(np.intersect1d(np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U), assume_unique=True))
                for x, y in zip(left, right, strict=True)
            ]
            kept = [batch.column(c) for c in ("a", "b", "na", "nb")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(common, pa.int64())], names=["a", "b", "na", "nb", "common"])

    joined = pairs.select("a", "b", "na", "nb").join(one, "a").join(two, "b").select("a", "b", "na", "nb", "sa", "sb")
    return joined.mapInArrow(run, "a long, b long, na long, nb long, common long")


def star_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (v, w) that connect what the edges (a, b) do: each end but the least of its component, with that least."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            rest = label != np.arange(len(nodes))
            return nodes[rest], nodes[label[rest]]
        label = new


def forest(edges: DataFrame) -> DataFrame:
    """v, w (w < v): edges that connect the same, contracted batch by batch where the edges of a member lie together.

    A member is left with one edge, and the pivots it was linked to with edges among themselves, of which there are few.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v, w = star_forest(batch.column(0).to_numpy(), batch.column(1).to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(w)], names=["v", "w"])

    ends = edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("w"))
    return ends.repartition("v").sortWithinPartitions("v").mapInArrow(run, "v long, w long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """v, comp (the least v of its component) for all ends of the edges (a, b).

    Ends of one edge only are leaves of the forest and take the label of the other end; among the rest, labels fall along
    edges and jump to labels of labels.
    """
    tree = materialise(forest(edges), "forest")
    inner = tree.select(F.explode(F.array("v", "w")).alias("v")).groupBy("v").agg(F.count("*").alias("m")).where("m > 1").select("v", F.lit(True).alias("inner"))
    tagged = materialise(tree.join(inner, "v", "left"), "tagged")
    leaves, core = tagged.where("inner is null").select("v", "w"), tagged.where("inner").select("v", "w")
    if core.isEmpty():  # stars only
        return leaves.toDF("v", "comp").union(leaves.select("w", "w").distinct())
    both = materialise(core.union(core.select("w", "v")).toDF("v", "w"), "edges")
    labels = materialise(both.groupBy("v").agg(F.least(F.min("w"), F.col("v")).alias("comp")), "labels")
    moved = True
    while moved:
        near = both.join(labels.toDF("w", "x"), "w").groupBy("v").agg(F.min("x").alias("x"))
        low = labels.join(near, "v").select("v", "comp", F.least("comp", "x").alias("low"))
        jump = labels.select(F.col("v").alias("low"), F.col("comp").alias("further"))
        new = materialise(low.join(jump, "low").select("v", "comp", F.least("low", "further").alias("new")), "labels")
        moved = not new.where("new < comp").isEmpty()
        labels = new.select("v", F.col("new").alias("comp"))
    tops = leaves.select(F.col("w").alias("v")).distinct().join(labels, "v", "left").select("v", F.coalesce("comp", "v").alias("comp"))
    tops = materialise(tops, "tops")
    hung = leaves.join(tops.toDF("w", "comp"), "w").select("v", "comp")
    return materialise(labels.union(hung).union(tops.join(labels, "v", "left_anti")), "components")


def classes_of(signed: DataFrame) -> DataFrame:
    """One row per different non-empty set: c0, c1, n, id (least doc_id), one (a document that has it), copies, bands."""
    return (
        signed.where("n_shingles > 0").groupBy("c0", "c1")
        .agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.max(F.struct("doc_id", "text_key")).alias("one"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of docs."""
    return judged(docs).drop("text_key")


def judged(docs: DataFrame) -> DataFrame:
    """``near_duplicates`` with text_key, which tells rows with one doc_id and different texts apart."""
    signed = materialise(signatures(docs), "signed")
    classes = materialise(classes_of(signed).withColumn("cid", F.monotonically_increasing_id()), "classes")
    exploded = classes.select("cid", "n", F.posexplode("bands").alias("pos", "band"))
    # written before the join, so that the join can split a bucket that holds a large part of all rows
    buckets = materialise(exploded.groupBy("band").agg(F.min("cid").alias("low"), F.max("cid").alias("high")).where("low < high"), "buckets")
    members = materialise(exploded.join(buckets, "band"), "members")

    # each member against the two pivots of its bucket
    sets = _sets_of(docs, classes, members)
    pivots = members.select("cid", "n", F.explode(F.array("low", "high")).alias("p")).where("cid <> p")
    pairs = pivots.select(F.least("cid", "p").alias("a"), F.greatest("cid", "p").alias("b")).distinct()
    pairs = materialise(_with_sizes(pairs, classes.select("cid", "n")).where(_fits("na", "nb")), "pairs")
    checked = materialise(common_counts(pairs, sets), "checked")
    comp = components(checked.where(_linked()).select("a", "b"))

    # members of buckets that hold several components still
    known = checked.select("a", "b")
    left = _open(members.select("cid", "n", "pos", "band"), comp)
    if not left.isEmpty():
        left, more, seen, outside = _against_central(left, sets)
        known, comp = known.union(seen), components(comp.toDF("a", "b").union(more))
        rest = materialise(_remaining(left.join(classes.select("cid", "bands"), "cid"), comp, outside).join(known, ["a", "b"], "left_anti"), "rest")
        if not rest.isEmpty():
            found = common_counts(rest, sets).where(_linked()).select("a", "b")
            comp = components(comp.toDF("a", "b").union(found))

    # the least doc_id of each component, for classes that hold more than one document or are linked
    of_class = classes.join(comp.toDF("cid", "comp"), "cid", "left").where("copies > 1 or comp is not null")
    of_class = of_class.select("c0", "c1", "id", F.coalesce("comp", "cid").alias("comp"))
    least = of_class.groupBy("comp").agg(F.min("id").alias("component_id"))
    of_class = of_class.join(least, "comp").select("c0", "c1", "component_id", F.lit(True).alias("grouped"))
    found = signed.select("doc_id", "text_key", "n_shingles", "c0", "c1").join(of_class, ["c0", "c1"], "left")
    component = F.when(F.col("grouped"), F.col("component_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(component)
    return found.select("doc_id", "text_key", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _linked():
    return 100 * F.col("common") >= PERCENT * (F.col("na") + F.col("nb") - F.col("common"))


def _with_sizes(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    return pairs.join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b").select("a", "b", "na", "nb")


def _open(members: DataFrame, comp: DataFrame) -> DataFrame:
    """Members of buckets that hold more than one component."""
    labelled = members.join(comp.toDF("cid", "comp"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    labelled = materialise(labelled, "labelled")
    mixed = materialise(labelled.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("band"), "mixed")
    return materialise(labelled.join(mixed, "band", "left_semi"), "open")


def _shared(sets: DataFrame) -> DataFrame:
    """cid, k, weight, shared: of each set, the shingles that another set has, too (the rarest first), how many, and in how many sets they are in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cid, value in zip(*batch.columns, strict=True):
                s = np.frombuffer(value.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), cid.as_py())), pa.array(s)], names=["cid", "s"])

    one = sets.mapInArrow(run, "cid long, s long")
    often = one.groupBy("s").agg(F.count("*").alias("f")).where("f > 1")
    rarest = F.sort_array(F.collect_list(F.struct("f", "s")))["s"]
    return one.join(often, "s").groupBy("cid").agg(F.count("*").alias("k"), F.sum("f").alias("weight"), rarest.alias("shared"))


def _against_central(left: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Compare the open members with the most typical member of their bucket.

    A link needs three quarters of either set, so a member of which fewer shingles are in any other open set has none and
    goes. Returns the members that stay, each with common (with the pivot) and extra (shingles that it shares with some
    set, but not with the pivot); the links (a, b); the pairs (a, b) that were compared; the extra shingles (cid, pivot, s).
    A link of a member needs at least three quarters of its set, of which ``common`` can be in the pivot. Of the others that
    many less one may be left out at the end of the list, if both ends list them in one order: the rest meets still. Members
    too large or small to be linked to the pivot are counted like the others, as their links to each other are found by it.
    """
    open_sets = sets.join(left.select("cid").distinct(), "cid")
    shared = materialise(_shared(open_sets), "shared")
    left = left.join(shared.select("cid", "k", "weight"), "cid").where(100 * F.col("k") >= PERCENT * F.col("n"))
    left = materialise(left, "shared-enough")
    best = materialise(left.groupBy("band").agg(F.max(F.struct((F.col("weight") / F.col("n")).alias("w"), "cid")).alias("best")), "best")
    left = left.join(best.select("band", F.col("best.cid").alias("pivot")), "band")
    left = materialise(left.select("cid", "n", "pos", "band", "k", "pivot"), "viable")
    sizes = left.select(F.col("cid").alias("pivot"), F.col("n").alias("np")).distinct()
    pairs = left.where("cid <> pivot").select("cid", "n", "pivot").distinct().join(sizes, "pivot")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common, extra, first = [], [], []
            for n, own, central, list_ in zip(*(batch.column(x) for x in ("n", "own", "central", "shared")), strict=True):
                c = np.frombuffer(central.as_buffer(), U)
                others = list_.values.to_numpy().view(U)
                others = others[~np.isin(others, c, assume_unique=True)]
                common.append(len(np.intersect1d(np.frombuffer(own.as_buffer(), U), c, assume_unique=True)))
                extra.append(len(others))
                needed = max(1, -(-PERCENT * n.as_py() // 100) - common[-1])
                first.append(others[: max(0, len(others) - needed + 1)].view(np.int64))
            new = [pa.array(common, pa.int64()), pa.array(extra, pa.int64()), pa.array(first, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("cid", "n", "pivot", "np")), *new], names=["cid", "n", "pivot", "np", "common", "extra", "first"])

    full = (
        pairs.join(open_sets.toDF("pivot", "central"), "pivot").join(open_sets.toDF("cid", "own"), "cid")
        .join(shared.select("cid", "shared"), "cid").select("cid", "n", "pivot", "np", "own", "central", "shared")
    )
    checked = materialise(full.mapInArrow(run, "cid long, n long, pivot long, np long, common long, extra long, first array<long>"), "central")
    ends = [F.least("cid", "pivot").alias("a"), F.greatest("cid", "pivot").alias("b")]
    links = checked.select(*ends, F.col("n").alias("na"), F.col("np").alias("nb"), "common").where(_linked()).select("a", "b")
    left = left.join(checked.select("cid", "pivot", "common", "extra"), ["cid", "pivot"], "left")
    own = F.col("cid") == F.col("pivot")
    left = left.withColumns({"common": F.when(own, F.col("n")).otherwise(F.col("common")), "extra": F.when(own, F.lit(0)).otherwise(F.col("extra"))})
    return left, links, checked.select(*ends), checked.select("cid", "pivot", F.explode("first").alias("s"))


def _remaining(left: DataFrame, comp: DataFrame, outside: DataFrame) -> DataFrame:
    """Pairs (a, b) with na, nb, of two components and one pivot, whose greatest possible intersection allows a link.

    Of x and y, the intersection inside the pivot is at most the lesser intersection with it; outside it is at most the
    lesser number of shingles that are shared with any set but not with the pivot, and none unless ``outside`` has one of
    both. Pairs without one come from the first band that they share; the members of a bucket's largest component are only
    held against the others.
    """
    left = _open(left, comp)
    held = ("cid", "n", "comp", "k", "common", "extra")

    def side(rows: DataFrame, s: str, *more: str) -> DataFrame:
        return rows.select(*more, *[F.col(c).alias(f"{c}_{s}") for c in held])

    def allowed(most):
        return _fits("n_x", "n_y") & ((100 + PERCENT) * most >= PERCENT * (F.col("n_x") + F.col("n_y")))

    inside = left.where(100 * F.col("common") >= PERCENT * F.col("n"))
    largest = inside.groupBy("band", "comp").agg(F.count("*").alias("m")).groupBy("band").agg(F.max(F.struct("m", "comp"))["comp"].alias("largest"))
    inside = materialise(inside.join(materialise(largest, "largest"), "band"), "inside")
    x = side(inside.where("comp <> largest"), "x", "pos", "band", F.col("bands").alias("bands_x"))
    y = side(inside, "y", "pos", "band", "largest", F.col("bands").alias("bands_y"))
    before = F.zip_with(F.slice("bands_x", F.lit(1), F.col("pos")), F.slice("bands_y", F.lit(1), F.col("pos")), lambda p, q: p == q)
    in_pivot = (
        x.join(y, ["pos", "band"])
        .where("comp_x <> comp_y and (comp_y = largest or cid_x < cid_y)")
        .where(allowed(F.least("common_x", "common_y")))
        .where(~F.exists(before, lambda same: same))
    )
    ends = left.select(*held, "pivot").distinct().join(outside, ["cid", "pivot"])
    most = F.least("k_x", "k_y", F.least("common_x", "common_y") + F.least("extra_x", "extra_y"))
    beside = side(ends, "x", "pivot", "s").join(side(ends, "y", "pivot", "s"), ["pivot", "s"]).where("cid_x < cid_y and comp_x <> comp_y").where(allowed(most))
    pairs = [
        z.select(F.least("cid_x", "cid_y").alias("a"), F.greatest("cid_x", "cid_y").alias("b"), F.when(F.col("cid_x") < F.col("cid_y"), F.col("n_x")).otherwise(F.col("n_y")).alias("na"),
                 F.when(F.col("cid_x") < F.col("cid_y"), F.col("n_y")).otherwise(F.col("n_x")).alias("nb"))
        for z in (in_pivot, beside)
    ]
    return pairs[0].union(pairs[1]).distinct()


def _sets_of(docs: DataFrame, classes: DataFrame, members: DataFrame) -> DataFrame:
    """cid, shingles of the classes that share a bucket, from the text of one document of each."""
    need = members.select("cid").distinct()
    one = classes.select("cid", F.col("one.doc_id").alias("id"), "one.text_key").join(need, "cid")
    texts = docs.select(F.col("doc_id").cast("long"), "text", _text_key())
    texts = texts.join(one, (texts.text_key == one.text_key) & texts.doc_id.eqNullSafe(one.id)).select("cid", "text")
    return materialise(_sets(texts).dropDuplicates(["cid"]), "sets")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is not the least of their component; rows are told apart by doc_id and text."""
    gone_id, gone_key = fresh(docs, "gone_id", "gone_key")
    gone = judged(docs).where(~F.col("kept")).select(F.col("doc_id").alias(gone_id), F.col("text_key").alias(gone_key)).distinct()
    gone = materialise(gone, "gone")
    same = docs["doc_id"].cast("long").eqNullSafe(F.col(gone_id)) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col(gone_key))
    return docs.join(gone, same, "left_anti")
