"""Pages as tables of nodes: a row an element or text, numbered in page order, with the number of the last node inside it.

``a`` holds ``b`` if a.pre < b.pre <= a.last, so that containers, ancestors and the text of an element are joins on ranges. Such a join meets in blocks
of ``BLOCK`` nodes: a container is there once for each block that it reaches into, and a node only meets the containers of its own block. ``whole`` is a hash of an element with all that is in it, so that trees are compared by counting.
"""

from __future__ import annotations

import functools
import hashlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.functions.html import SKIPPED, VOID
from leadloom.functions.markup import Markup

BLOCK, TEXT = 64, "#text"
#: Nodes that leave a task at once.
ROWS = 20_000
#: Small pages, by their characters, and how many of them a task keeps as read: many forms are sent from one page.
SMALL, SMALL_KEPT = 4096, 512
# fixed values: elements that hold a paragraph in, and what ends an element of the same family when it starts, up to which element around it
AROUND_P = ("button", "td", "th", "li", "div", "section", "article")
ENDS = {
    "li": (("li",), ("ul", "ol")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
# fixed values: blocks before which a paragraph ends
BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
HEADINGS, LISTS = ("h1", "h2", "h3", "h4", "h5", "h6"), ("ul", "ol", "dl")
REGIONS = ("nav", "header", "footer", "main", "article", "section", "aside", "form")


# fixed values: elements that take input, and elements whose innermost open one is known when a node starts
INPUTS, KEPT_OPEN = ("input", "textarea", "select"), frozenset(("label", "tr", "dd", "fieldset"))


class _Open(Markup):
    """The elements that are open while a page is read; ``_leave`` is called for each that ends."""

    def __init__(self):
        super().__init__()
        self.open: list[int] = []
        self.kinds: list[str] = []
        self.skip = 0
        self.count: dict[str, int] = defaultdict(int)

    def _leave(self, n: int, tag: str):
        """What a reader notes of the end of an element."""

    def _enter(self, n: int, tag: str):
        self.open.append(n)
        self.kinds.append(tag)
        self.count[tag] += 1
        if tag in SKIPPED:
            self.skip += 1

    def _pop(self):
        n, tag = self.open.pop(), self.kinds.pop()
        self.count[tag] -= 1
        if tag in SKIPPED:
            self.skip -= 1
        self._leave(n, tag)
        return tag

    def _end(self, tags, around):
        """End the nearest of some open elements, if no element of ``around`` stands between."""
        for t in tags:
            if self.count[t]:
                break
        else:
            return
        for kind in reversed(self.kinds):
            if kind in around:
                return
            if kind in tags:
                while self._pop() not in tags:
                    pass
                return

    def _before(self, tag: str):
        """End what ends when an element of this kind starts."""
        if tag in ENDS:
            self._end(*ENDS[tag])
        if tag in BLOCKS and self.count["p"]:
            self._end(("p",), AROUND_P)

    def handle_endtag(self, tag):
        if self.count[tag]:  # others are stray
            while self._pop() != tag:
                pass

    def close(self):
        super().close()
        while self.open:
            self._pop()


class _Groups(_Open):
    """Of the inputs of a page the innermost fieldset around them, and of elements the legends in them."""

    attributed = False

    def __init__(self):
        super().__init__()
        self.read_nodes, self.around, self.boxes = 0, [], []
        self.legends: dict[int, list[str]] = {}
        self.said: list[tuple[int, list[str]]] = []

    def handle_starttag(self, tag, attrs):
        self._before(tag)
        n = self.read_nodes
        self.read_nodes += 1
        if tag in INPUTS and self.around:
            self.boxes.append(self.around[-1])
        if tag not in VOID:
            if tag == "legend":
                self.said.append((self.open[-1] if self.open else -1, []))
            elif tag == "fieldset":
                self.around.append(n)
            self._enter(n, tag)

    def _leave(self, n, tag):
        if tag == "legend":
            held, words = self.said.pop()
            if words:
                self.legends.setdefault(held, []).append(" ".join(words))
        elif tag == "fieldset":
            self.around.pop()

    def handle_data(self, data):
        if self.said and not self.skip and (words := data.split()):
            for _, held in self.said:
                held.append(" ".join(words))

    def rows(self) -> Iterator[tuple]:
        sizes = Counter(self.boxes)
        said = {n: "\n".join(texts) for n, texts in self.legends.items()}
        return ((k, sizes[n], said.get(n)) for k, n in enumerate(self.boxes, 1))


class _Tree(_Open):
    def __init__(self):
        super().__init__()
        self.tag, self.last, self.parent, self.depth, self.attrs, self.text = [], [], [], [], [], []
        self.inner: dict[str, list[int]] = {t: [] for t in KEPT_OPEN}
        # of inputs the innermost elements around them, of rows their header cells, of descriptions the term before them
        self.around: dict[int, dict[str, int]] = {}
        self.heads: dict[int, list[int]] = {}
        self.terms: dict[int, int | None] = {}
        self.term: int | None = None
        self.found: dict[int, tuple[str, str]] | None = None

    def _add(self, tag, attrs, text):
        n = len(self.tag)
        self.tag.append(tag)
        self.last.append(n)
        self.parent.append(self.open[-1] if self.open else None)
        self.depth.append(len(self.open))
        self.attrs.append(attrs)
        self.text.append(text)
        return n

    def _leave(self, n, tag):
        self.last[n] = len(self.tag) - 1
        if tag in KEPT_OPEN:
            self.inner[tag].pop()

    def handle_starttag(self, tag, attrs):
        self._before(tag)
        n = self._add(tag, {k: v or "" for k, v in attrs} if attrs else {}, None)
        if tag in INPUTS:
            self.around[n] = {t: held[-1] for t, held in self.inner.items() if held}
        elif tag == "th" and self.parent[n] is not None:
            self.heads.setdefault(self.parent[n], []).append(n)
        elif tag == "dt":
            self.term = n
        elif tag == "dd":
            self.terms[n] = self.term
        if tag not in VOID:
            self._enter(n, tag)
            if tag in KEPT_OPEN:
                self.inner[tag].append(n)

    def handle_data(self, data):
        words = data.split()
        if words and not self.skip:
            self._add(TEXT, {}, " ".join(words))

    def said(self, n: int | None) -> str | None:
        """The texts inside an element, joined by spaces; null if there is none."""
        return None if n is None else " ".join(t for t in self.text[n + 1 : self.last[n] + 1] if t is not None) or None

    def labels(self) -> dict[int, tuple[str, str]]:
        """The label of inputs and its source, as ``labels`` says."""
        if self.found is not None:
            return self.found
        stated: dict[str, str] = {}
        for n, tag in enumerate(self.tag):
            if tag == "label" and (ident := self.attrs[n].get("for")) and ident not in stated and (said := self.said(n)):
                stated[ident] = said
        told: dict[int | None, str | None] = {}  # an element that many inputs share is read once

        def read(n):
            if n not in told:
                told[n] = self.said(n)
            return told[n]

        heads: dict[int, str | None] = {}
        found = {}
        for n, held in self.around.items():
            row = held.get("tr")
            if row is not None and row not in heads:
                heads[row] = next((said for th in self.heads.get(row, ()) if (said := read(th))), None)
            for source, said in (("for", lambda n=n: stated.get(self.attrs[n].get("id"))), ("around", lambda h=held: read(h.get("label"))), ("row", lambda r=row: heads.get(r)), ("term", lambda h=held: read(self.terms.get(h.get("dd"))))):
                if (text := said()) is not None:
                    found[n] = (text, source)
                    break
        self.found = found
        return found

    def hashes(self) -> list[int]:
        """children come after their parents: from the last node back, each hash is whole before its parent takes it up"""
        whole, inside = [0] * len(self.tag), [[] for _ in self.tag]
        for n in range(len(self.tag) - 1, -1, -1):
            own = repr((self.tag[n], sorted(self.attrs[n].items()), self.text[n], inside[n][::-1])).encode()
            whole[n] = int.from_bytes(hashlib.blake2b(own, digest_size=8).digest(), "little", signed=True)
            if self.parent[n] is not None:
                inside[self.parent[n]].append(whole[n])
            inside[n] = ()
        return whole

    def column(self, name: str, which: list[int]) -> list:
        """A column of ``NODES`` for some nodes."""
        if name in ("label", "source"):
            found, k = self.labels(), ("label", "source").index(name)
            return [found[n][k] if n in found else None for n in which]
        if name == "whole":
            whole = self.hashes()
            return [whole[n] for n in which]
        if name == "attrs":
            return [list(self.attrs[n].items()) for n in which]
        if name == "legend":
            return [self.said(n) if self.tag[n] == "legend" else None for n in which]
        if name == "box":
            return [self.around[n].get("fieldset") if n in self.around else None for n in which]
        return which if name == "pre" else [getattr(self, name)[n] for n in which]


#: label and source: of inputs, see ``labels``; box: of inputs, the innermost fieldset around them; legend: of legends, the text inside.
NODES = "pre int, last int, parent int, depth int, tag string, attrs map<string,string>, text string, whole long, label string, source string, box int, legend string"
_ARROW = {"int": pa.int32(), "string": pa.string(), "long": pa.int64(), "map<string,string>": pa.map_(pa.string(), pa.string())}


def node_table(pages: DataFrame, key: str, html: str = "html", columns: tuple[str, ...] = (), tags: tuple[str, ...] = ()) -> DataFrame:
    """key and ``NODES``: a row a node of each page. A null page has none. Names of attributes are lower-case, those without a value are empty.

    columns and tags: only these columns of ``NODES``, and only nodes of these kinds; all if empty."""
    kinds = dict(c.split() for c in NODES.split(", "))
    names = list(columns or kinds)

    def rows(page: str | None) -> list[list]:
        tree = _Tree.read(page)
        which = [n for n, t in enumerate(tree.tag) if t in tags] if tags else list(range(len(tree.tag)))
        return [tree.column(name, which) for name in names]

    return _read(pages.select(key, html), {c: kinds[c] for c in names}, rows)


def _read(pages: DataFrame, kinds: dict[str, str], rows: Callable[[str | None], list[list]]) -> DataFrame:
    """key and columns of some kinds from pages (key, html): a page gives the values of each column, and is read once."""
    (key, kind), _ = pages.dtypes
    names, types = [key, *kinds], [_ARROW[t] for t in kinds.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys: list = []
            made: list[list] = [[] for _ in types]

            def flush(kind=batch.column(0).type):
                out = pa.RecordBatch.from_arrays([pa.array(keys, kind), *[pa.array(c, t) for c, t in zip(made, types, strict=True)]], names=names)
                keys.clear()
                for c in made:
                    c.clear()
                return out

            for k, page in zip(batch.column(0), batch.column(1), strict=True):
                found = rows(page.as_py())
                keys.extend([k.as_py()] * len(found[0]))
                for c, values in zip(made, found, strict=True):
                    c.extend(values)
                if len(keys) >= ROWS:
                    yield flush()
            if keys:
                yield flush()

    return pages.mapInArrow(run, f"{key} {kind}, " + ", ".join(f"{c} {t}" for c, t in kinds.items()))


def groups(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key, pos, size, legends of the inputs of each page that stand in a fieldset, in page order: how many inputs the innermost one has, and the texts of the
    legends right in it, a line each (null: none). A page is read once and tells all of it, so that no row of it travels."""

    def rows(page: str | None) -> list[list]:
        return [list(c) for c in zip(*_Groups.read(page).rows(), strict=True)] or [[], [], []]

    return _read(pages.select(key, html), {"pos": "int", "size": "long", "legends": "string"}, rows)


#: A node of ``node_pairs``; added: how many more nodes of its hash the second page has.
PAIRED = "array<struct<pre:int,last:int,parent:int,tag:string,attrs:map<string,string>,text:string,whole:long,added:int>>"
#: Inputs and buttons that both pages have by kind and name (or id), the first of each: their values, and whether they are disabled.
SHARED = "array<struct<tag:string,v_was:string,v_is:string,off_was:boolean,off_is:boolean>>"
_NODE = [("pre", pa.int32()), ("last", pa.int32()), ("parent", pa.int32()), ("tag", pa.string()), ("attrs", _ARROW["map<string,string>"]), ("text", pa.string()), ("whole", pa.int64()), ("added", pa.int32())]
_SHARED = [("tag", pa.string()), ("v_was", pa.string()), ("v_is", pa.string()), ("off_was", pa.bool_()), ("off_is", pa.bool_())]


class _Lists:
    """An array of structs, column by column."""

    def __init__(self, kinds: list[tuple[str, pa.DataType]]):
        self.kinds, self.ends, self.made = kinds, [0], [[] for _ in kinds]

    def add(self, columns):
        for held, values in zip(self.made, columns, strict=True):
            held.extend(values)
        self.ends.append(len(self.made[0]))

    def array(self) -> pa.Array:
        flat = pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(self.made, self.kinds, strict=True)], names=[n for n, _ in self.kinds])
        return pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), flat)


def _named(tree: _Tree) -> dict[tuple[str, str], dict[str, str]]:
    found: dict = {}
    for tag, attrs in zip(tree.tag, tree.attrs, strict=True):
        if tag in ("input", "textarea", "select", "button") and (name := attrs.get("name", attrs.get("id"))) is not None:
            found.setdefault((tag, name), attrs)
    return found


def _hashed(page: str | None) -> tuple[_Tree, list[int]]:
    tree = _Tree.read(page)
    return tree, tree.hashes()


@functools.lru_cache(SMALL_KEPT)
def _hashed_again(page: str | None) -> tuple[_Tree, list[int]]:
    return _hashed(page)


def node_pairs(pairs: DataFrame, before: str, after: str) -> DataFrame:
    """The other columns, was and is (``PAIRED``, empty for a null page), changes and fields (``SHARED``) of pairs of pages; changes: how many hashes one page has more often."""
    others = [c for c in pairs.columns if c not in (before, after)]
    kinds = dict(pairs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = 0
            was, is_, shared, changes = _Lists(_NODE), _Lists(_NODE), _Lists(_SHARED), []
            for k, (old, new) in enumerate(zip(batch.column(before), batch.column(after), strict=True), 1):
                pages = (old.as_py(), new.as_py())
                trees, wholes = zip(*((_hashed_again if len(p or "") <= SMALL else _hashed)(p) for p in pages), strict=True)
                counts = [Counter(w) for w in wholes]
                more, less = counts[1] - counts[0], counts[0] - counts[1]
                for lists, tree, whole in zip((was, is_), trees, wholes, strict=True):
                    lists.add((range(len(whole)), tree.last, tree.parent, tree.tag, [list(a.items()) for a in tree.attrs], tree.text, whole, [more[w] for w in whole]))
                changes.append(more.total() + less.total())
                a, b = map(_named, trees)
                both = [(tag, x, b[tag, name]) for (tag, name), x in a.items() if (tag, name) in b]
                shared.add(([f[0] for f in both], [f[1].get("value", "") for f in both], [f[2].get("value", "") for f in both], ["disabled" in f[1] for f in both], ["disabled" in f[2] for f in both]))
                if was.ends[-1] + is_.ends[-1] >= ROWS or k == batch.num_rows:
                    kept = [batch.column(c).slice(start, k - start) for c in others]
                    yield pa.RecordBatch.from_arrays([*kept, was.array(), is_.array(), pa.array(changes, pa.int64()), shared.array()], names=[*others, "was", "is", "changes", "fields"])
                    start, was, is_, shared, changes = k, _Lists(_NODE), _Lists(_NODE), _Lists(_SHARED), []

    return pairs.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in others) + f", was {PAIRED}, is {PAIRED}, changes long, fields {SHARED}")


def holding(inner: DataFrame, outer: DataFrame, key: str, block: int = BLOCK) -> DataFrame:
    """Pairs of a node of ``inner`` (key, pre, ...) and an element of ``outer`` (key, pre, last, ...) around it; outer's columns have o_ before their names."""
    named = outer.select(key, *[F.col(c).alias(f"o_{c}") for c in outer.columns if c != key])
    reach = F.explode(F.sequence((F.col("o_pre") / block).cast("int"), (F.col("o_last") / block).cast("int"))).alias("__block")
    both = inner.withColumn("__block", (F.col("pre") / block).cast("int")).join(named.select("*", reach), [key, "__block"])
    return both.where("o_pre < pre and pre <= o_last").drop("__block")


def nearest_around(inner: DataFrame, outer: DataFrame, key: str, *columns: str) -> DataFrame:
    """key, pre, columns of the innermost element of ``outer`` around each node of ``inner`` that has one."""
    pairs = holding(inner.select(key, "pre"), outer, key)
    best = pairs.groupBy(key, "pre").agg(F.max_by(F.struct(*[F.col(f"o_{c}").alias(c) for c in columns]), "o_pre").alias("best"))
    return best.select(key, "pre", "best.*")


def texts_of(elements: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """key, pre, said: the texts inside elements (key, pre, last), joined by spaces; elements without text are missing."""
    words = nodes.where(F.col("tag") == TEXT).select(key, "pre", "text")
    pairs = holding(words, elements.select(key, "pre", "last"), key)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pre", "text"))), lambda x: x["text"]), " ")
    return pairs.groupBy(key, F.col("o_pre").alias("e")).agg(joined.alias("said")).withColumnRenamed("e", "pre")


def last_before(nodes: DataFrame, key: str, value: Column) -> Column:
    """The last value, not null, of the nodes before each one in page order."""
    order = Window.partitionBy(key).orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    return F.last(value, ignorenulls=True).over(order)


def attribute(name: str) -> Column:
    return F.try_element_at("attrs", F.lit(name))


def labels(nodes: DataFrame, key: str) -> DataFrame:
    """key, pre, label, source of inputs: the text of label[for] with their id, of a label around them, of the header of their table row, of the term before
    their description: the first that there is. A page is read once and holds all of it, so that no row of it travels."""
    return nodes.where(F.col("tag").isin(*INPUTS)).select(key, "pre", "label", "source")
