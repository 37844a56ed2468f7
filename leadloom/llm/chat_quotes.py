"""Quotation linking for conversations.

Each line of a message has a quote level: the number of leading ``>``, spaces between them allowed. Attribution lines ("... wrote:")
before a quote are taken out, runs of lines of one level over 0 are quoted passages, and what is left at level 0 is the
message's own text. Passages and own texts are normalised (letters and digits, lower case, single spaces) and hashed: of all runs of
``WINDOW`` words, those with the least hash of ``NEAR`` neighbours stand for the text (winnowing), so that a passage finds the message
that it was taken from whether it quotes all of it, some of its lines, re-wrapped, or a sentence: any passage of
``WINDOW + NEAR - 1`` words or more is found. Shorter passages are found as whole lines, sentences or paragraphs.

Each hash of a passage points to the latest earlier message of the conversation whose own text has it. The message that most of them
point to, the latest of several, is the original, if at least half of the hashes are found. The parent of a message is the one that
its level-1 passages quote, the latest of several; without one it is the message before it. A run is a message and those
that follow it without going back; replies sort by the path of runs from the root, which grows by pointer doubling, so that
chains of any length take a few rounds and paths are as long as a message is nested, not as long as the conversation.
Windows over turns work on blocks of a conversation and then on one row a block: no task needs a whole conversation.

Defined cases: null text is empty and quotes nothing; a null conv_id or turn is kept, unlinked, as its own root; repeated
(conv_id, turn) rows are each returned, with the links of the turn, which has the passages and own texts of all of them; equal
passages of a message count once for each level; a passage that nothing contains stays unlinked and is still removed; an empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadloom.llm.common import materialise

QUOTE = re.compile(r"((?:[ \t]?>)*)[ \t]?(.*)", re.S)
ATTRIBUTION = re.compile(r"(wrote|writes|said|schrieb|escribió|a écrit)\s*:\s*$", re.I)
OTHER = re.compile(r"[\W_]+")
SENTENCE = re.compile(r"(?<=[.!?])\s+|[。！？]")
WINDOW, NEAR = 5, 4
U = np.uint64
PARSED = "clean string, own array<long>, quotes array<struct<level:int,name:long,units:array<long>>>"


def words_of(text: str) -> list[str]:
    return OTHER.sub(" ", text.lower()).split()


def _hashes(words: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) for w in words], U)


def whole(words: list[str]) -> int:
    """One hash for all words."""
    return xxhash.xxh3_64_intdigest(" ".join(words)) - (1 << 63)


def winnowed(words: list[str]) -> np.ndarray:
    """The hashes of the runs of WINDOW words that are least among NEAR neighbours; none for a text too short for one neighbourhood."""
    n = len(words) - WINDOW + 1
    if n < NEAR:
        return np.empty(0, np.int64)
    h, x = _hashes(words), np.full(n, WINDOW, U)
    for k in range(WINDOW):
        x = (x ^ h[k : k + n]) * U(0x9E3779B97F4A7C15)
        x ^= x >> U(29)
    near = np.lib.stride_tricks.sliding_window_view(x, NEAR)
    at = np.arange(len(near)) + NEAR - 1 - near[:, ::-1].argmin(axis=1)
    return np.unique(x[at]).view(np.int64)


def parse(text: str | None) -> tuple[str, list[int], list[tuple[int, int, list[int]]]]:
    """The message without quotes and attribution lines, the hashes of that text, and (level, hash of all, hashes) of its passages."""
    lines = []
    for line in (text or "").replace("\r\n", "\n").split("\n"):
        marks, body = QUOTE.fullmatch(line).groups()
        lines.append((marks.count(">"), body))
    after = [(0, "")] * len(lines)  # the next line that is not blank
    for i in range(len(lines) - 2, -1, -1):
        after[i] = lines[i + 1] if lines[i + 1][1].strip() else after[i + 1]
    lines = [x for x, y in zip(lines, after, strict=True) if not (y[0] > x[0] and ATTRIBUTION.search(x[1]))]

    runs: list[tuple[int, list[str]]] = []
    joins = False
    for level, body in lines:
        if not body.strip():
            joins = False
        elif joins and runs[-1][0] == level:
            runs[-1][1].append(body)
        else:
            runs.append((level, [body]))
            joins = True
    own, all_words, quotes = set(), [], {}
    for level, bodies in runs:
        passage = "\n".join(bodies)
        words = words_of(passage)
        if level:
            if words:
                units = winnowed(words).tolist() or [whole(words)]
                quotes[level, whole(words)] = units
            continue
        all_words += words
        for part in (passage, *bodies, *SENTENCE.split(passage)):
            short = words_of(part)
            if 0 < len(short) < WINDOW + NEAR - 1:
                own.add(whole(short))
    own.update(winnowed(all_words).tolist())
    clean = "\n".join(body for level, body in lines if not level).strip()
    return re.sub(r"\n{3,}", "\n\n", clean), sorted(own), [(level, name, units) for (level, name), units in quotes.items()]


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, clean, own, quotes."""
    rows = messages.select("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passage = pa.struct([("level", pa.int32()), ("name", pa.int64()), ("units", pa.list_(pa.int64()))])
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                made = [parse(t.as_py()) for t in part.column("text")]
                quotes = [[{"level": a, "name": b, "units": c} for a, b, c in q] for _, _, q in made]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("conv_id", "turn", "role")), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.list_(pa.int64())), pa.array(quotes, pa.list_(passage))],
                    names=["conv_id", "turn", "role", "clean", "own", "quotes"],
                )

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:3])
    return rows.mapInArrow(run, f"{kinds}, {PARSED}")


#: Turns of a block.
BLOCK = 1000


def _last_before(turns: DataFrame, value: str, name: str, own: bool, keys: tuple = ("conv_id",)) -> DataFrame:
    """turns with the last non-null value among earlier turns of the same keys (and the turn itself, if own)."""
    turns = turns.withColumn("block", F.floor(F.col("turn") / BLOCK))
    within = Window.partitionBy(*keys, "block").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    blocks = turns.groupBy(*keys, "block").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("turn"))).alias("v"))
    earlier = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*keys, "block", F.last("v", ignorenulls=True).over(earlier).alias("carried"))
    found = turns.withColumn("here", F.last(value, ignorenulls=True).over(within)).join(blocks, [*keys, "block"])
    return found.withColumn(name, F.coalesce("here", "carried")).drop("block", "here", "carried")


def link_quotes(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (without quotes), n_quotes, n_linked, parent_turn, path: one row a message.

    path: by run, (1, minus the turn that it replies to, its first turn), and last (0, turn, 0) for the message itself.
    """
    rows = materialise(parsed(messages), "parsed")
    passages = rows.select("conv_id", "turn", F.explode("quotes").alias("p")).select("conv_id", "turn", "p.*").dropDuplicates(["conv_id", "turn", "level", "name"])
    passages = materialise(passages.where("conv_id is not null and turn is not null"), "passages")
    quoted = passages.select("conv_id", "turn", "level", "name", F.size("units").alias("n_units"), F.explode("units").alias("unit"))
    # only conversations with quotes, and of their own texts only what some passage has
    own = rows.where("turn is not null").join(passages.select("conv_id").distinct(), "conv_id", "left_semi").select("conv_id", "turn", F.explode("own").alias("unit"))
    own = own.join(quoted.select("conv_id", "unit").distinct(), ["conv_id", "unit"], "left_semi").withColumn("own", F.col("turn"))
    asked = own.unionByName(quoted.select("conv_id", "turn", "unit", F.lit(None).cast(own.schema["turn"].dataType).alias("own")))
    asked = materialise(asked.groupBy("conv_id", "unit", "turn").agg(F.max("own").alias("own")), "asked")
    votes = quoted.join(_last_before(asked, "own", "origin", False, ("conv_id", "unit")).select("conv_id", "unit", "turn", "origin"), ["conv_id", "unit", "turn"])
    one = ("conv_id", "turn", "level", "name")
    votes = votes.where("origin is not null").groupBy(*one, "n_units", "origin").agg(F.count("*").alias("n"))
    found = votes.groupBy(*one, "n_units").agg(F.sum("n").alias("n"), F.max(F.struct("n", "origin"))["origin"].alias("origin")).where("2 * n >= n_units")
    links = found.groupBy("conv_id", "turn").agg(F.count("*").alias("n_linked"), F.max(F.when(F.col("level") == 1, F.col("origin"))).alias("quoted_turn"))
    counts = passages.groupBy("conv_id", "turn").agg(F.count("*").alias("n_quotes"))

    turns = rows.where("conv_id is not null and turn is not null").select("conv_id", "turn").distinct()
    before = _last_before(turns, "turn", "prior", own=False)
    parents = before.join(links, ["conv_id", "turn"], "left").join(counts, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", F.coalesce("quoted_turn", "prior").alias("parent"),
        F.when(F.isnull("prior") | (F.col("quoted_turn") < F.col("prior")), F.col("turn")).alias("starts"),
        F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
    )
    parents = materialise(_last_before(parents, "starts", "run", own=True), "parents")

    heads = parents.where("starts is not null").select("conv_id", F.col("turn").alias("run"), "parent")
    above = parents.select("conv_id", F.col("turn").alias("parent"), F.col("run").alias("up"))
    link = F.struct(F.lit(1).alias("branch"), (-F.coalesce(F.col("parent").cast("long"), F.lit(0))).cast("long").alias("at"), F.col("run").cast("long").alias("first"))
    tree = materialise(heads.join(above, ["conv_id", "parent"], "left").select("conv_id", "run", "up", F.array(link).alias("path")), "paths")
    while not tree.where("up is not null").isEmpty():  # each round doubles the length of the paths
        top = tree.select("conv_id", F.col("run").alias("up"), F.col("up").alias("further"), F.col("path").alias("head"))
        tree = tree.join(top, ["conv_id", "up"], "left").select(
            "conv_id", "run", F.col("further").alias("up"), F.when(F.isnull("head"), F.col("path")).otherwise(F.concat("head", "path")).alias("path")
        )
        tree = materialise(tree, "paths")
    placed = parents.join(tree.select("conv_id", "run", "path"), ["conv_id", "run"])
    own = F.array(F.struct(F.lit(0).alias("branch"), F.col("turn").cast("long").alias("at"), F.lit(0).cast("long").alias("first")))
    out = rows.select("conv_id", "turn", "role", F.col("clean").alias("text")).join(placed, ["conv_id", "turn"], "left")
    return out.select(
        "conv_id", "turn", "role", "text", F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), F.col("parent").alias("parent_turn"),
        F.when(F.isnull("path"), own).otherwise(F.concat("path", own)).alias("path"),
    )


def conversations(linked: DataFrame) -> DataFrame:
    """Messages in reply order: a message follows its parent, siblings follow by turn."""
    return linked.repartitionByRange("conv_id", "path").sortWithinPartitions("conv_id", "path")
