"""Each operator: nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, against plain versions."""

import hashlib
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from leadloom.llm import chat_quotes, common, decontamination, exact_dedup, html_extraction, license_scan, merge_dropout, near_dedup, sharding, token_store, toxicity

SCHEMA = "doc_id long, text string, key string, n long, lang string"
BASE = " ".join(f"w{i}" for i in range(60))
TEXTS = [
    (1, None), (2, ""), (3, "Hello World"), (4, "hello world"), (5, "HELLO WORLD"), (6, "É a"), (7, "é a"), (8, BASE), (9, BASE + " tail"), (10, BASE.replace("w30", "x")),
    (11, "a b c"), (12, "A B C"), (12, "A B C"), (None, "no id"), (13, "\t \n"), (14, "long " * 20_000), (15, "▁ raw <s> \x00 日本🎉"), (16, BASE.replace("w10", "y").replace("w40", "z")),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "k", 1, "en") for i, t in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def lower(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


# ---- 1
def test_sharding(spark, docs, empty):
    rows = sharding.digest(docs).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in TEXTS)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = {(r.doc_id, r.size, r.text_crc32) for r in rows}
    assert sizes == {(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in TEXTS}
    assert sharding.digest(empty).count() == 0


def plain_shard(doc_id, shards, seed=sharding.SEED):
    """The shard by a plain loop over the hashes of seed, shard and id."""

    def weight(k):
        h = xxhash.xxh64_intdigest(k.to_bytes(4, "little"), xxhash.xxh64_intdigest(seed.to_bytes(4, "little"), 42))
        h = h if doc_id is None else xxhash.xxh64_intdigest(doc_id.to_bytes(8, "little", signed=True), h)
        return (h - (1 << 64) if h >> 63 else h), k

    return max(range(shards), key=weight)


def test_shards_equal_a_plain_version(spark, docs):
    for r in sharding.digest(docs, shards=5).collect():
        assert (r.shard, r.grown_shard, r.law) == (plain_shard(r.doc_id, 5), plain_shard(r.doc_id, 6), "key")


def test_buckets_do_not_change_shards_and_the_seed_decides(spark, docs):
    clash = docs.withColumns({"__shard": F.lit("mine"), "__bucket": F.lit(3.5)})
    runs = {}
    for seed, size in ((5, 20_000), (5, 20_000), (5, 1 << 20), (6, 20_000)):
        path = sharding.write_shards(clash, 3, seed, bucket_bytes=size)
        shard, bucket, place = sharding.shard_columns(clash)
        got = sharding.with_slots(sharding.read_shards(spark, path, sharding.shard_schema(clash)), shard, bucket, place)
        assert set(clash.columns) < set(got.columns) and {r["__shard"] for r in got.collect()} == {"mine"}
        found = sorted((r[shard], r["__slot"], str(r.doc_id), r.text or "") for r in got.collect())
        assert runs.setdefault((seed, size), found) == found
    where = {k: sorted((s, d, t) for s, _, d, t in v) for k, v in runs.items()}
    assert where[5, 20_000] == where[5, 1 << 20] != where[6, 20_000] and runs[5, 20_000] != runs[5, 1 << 20]


def test_buckets_stay_small_for_repeats_of_one_record(spark):
    repeats = spark.range(0, 6000, 1, 3).select(F.lit(None).cast("long").alias("doc_id"), F.lit("x" * 99).alias("text"))
    path = sharding.write_shards(repeats, 4, bucket_bytes=20_000)
    sizes = [r["count"] for r in sharding.read_shards(spark, path, sharding.shard_schema(repeats)).groupBy("__shard", "__bucket").count().collect()]
    assert sum(sizes) == 6000 and len(sizes) == 30 and max(sizes) < 300


def test_fisher_yates_is_a_permutation():
    assert sorted(sharding.fisher_yates(100, (1, 2, 3))) == list(range(100))
    counts = Counter(tuple(sharding.fisher_yates(3, (k, 0, 0))) for k in range(3000))
    assert len(counts) == 6 and min(counts.values()) > 380


# ---- 2
PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><ul><li><a href=x>Menu</a></ul></nav><div id="cookie-notice">We use cookies.</div>
<article><h1>Head &amp; co</h1><p><b>One<br><p>Two &eacute;, with <i>more</i>  words.<p class="ad">x</p><ul><li>Item.</ul></article><div class="comments"><p>Great post, so good.</p></div><form>Mail <input></form><footer>&copy; me</footer>"""


@pytest.mark.parametrize(
    ("page", "text"),
    [(None, ""), ("", ""), (PAGE, "Head & co\nOne\nTwo é, with more words.\nx\nItem."), (PAGE[: PAGE.index("words")], "Head & co\nOne\nTwo é, with more"), ("<p>a<script>if (a<b) '</p>'", "a"), ("plain &lt;b&gt;", "plain <b>"), ("<nav>a</nav>", "")],
)
def test_main_text(page, text):
    assert html_extraction.main_text(page) == text


LONG = "A long paragraph, with many words; and signs. " * 30


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<div class=intro><h1>Head</h1><p>Lead</p></div><div class=body><p>{LONG}</p><p>{LONG}</p></div>", ["Head", "Lead", LONG, LONG]),
        (f"<div class=s1><h2>One</h2><p>Short.</p></div><div class=s2><p>{LONG * 9}</p></div>", ["One", "Short.", LONG * 9]),
        (f"<article><div class=post-header><h1>Head</h1></div><h2 id=search-methods>Methods</h2><section id=social-impact><p>{LONG}</p></section><blockquote class=reply>Quoted</blockquote></article>", ["Head", "Methods", LONG, "Quoted"]),
        (f"<main><p>{LONG}</p><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be.</p></main>", [LONG, "Let x=1 be."]),
        (f"<div id=site-header>Site</div><div class='share-buttons'><p>Share</p></div><div><p>{LONG}</p></div><div class=related-posts><p>More</p></div>", [LONG]),
    ],
)
def test_main_text_is_whole(page, text):
    assert html_extraction.main_text(page) == "\n".join(t.strip() for t in text)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><p>One.</p><p title=it's>Two.</p><p class=\"x\"\">Three.</p><p a='>'>Four.</p></article>", "One.\nTwo.\nThree.\nFour."),
        (f"<div class=with-sidebar><div class=nav-open><div class=post-header><h1>Head</h1></div><p>{LONG}</p></div></div>", f"Head\n{LONG.strip()}"),
        (f"<div class=content><div class=sidebar><p>{LONG}</p></div></div>", LONG.strip()),
        ("<p>a<!--> b</p><p>c<!-- x --!>d</p></3>e", "a b\ncd\ne"),
    ],
)
def test_main_text_reads_tags_as_browsers_do(page, text):
    assert html_extraction.main_text(page) == text


def test_deep_and_long_pages_take_linear_time():
    import time

    began = time.perf_counter()
    deep = "<div>".join(f"word {k}. " for k in range(100_000))
    assert html_extraction.main_text(f"<x-a>{deep}</li></nothing>").count("\n") == 99_999
    assert len(html_extraction.main_text("<article><p>" + "long text, " * 500_000)) > 5_000_000
    assert time.perf_counter() - began < 60


def plain_ratios(blocks):
    """Text and punctuation ratios by full path strings, plain loops."""

    def path(e):
        return path(e.parent) + (e.path,) if e else ()

    def smoothed(x):
        out = []
        for i in range(len(x)):
            near = [(j, np.exp(-((j - i) ** 2) / (2 * html_extraction.SIGMA**2))) for j in range(max(0, i - 2), min(len(x), i + 3))]
            out.append(sum(x[j] * w for j, w in near) / sum(w for _, w in near))
        return out

    of = defaultdict(list)
    for e, t, _ in blocks:
        of[path(e)].append(t)
    chars = [sum(map(len, of[path(e)])) / len(of[path(e)]) for e, _, _ in blocks]
    marks = [(sum(len(re.findall("[.,;:!?]", t)) for t in of[path(e)]) + 0.5) / len(of[path(e)]) for e, _, _ in blocks]
    return [a * b for a, b in zip(smoothed(chars), smoothed(marks), strict=True)]


def test_ratios_decide_without_names(spark):
    """The ratios equal a plain version; pages keep their text without class names, and mostly without any kind of element."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    nameless = [re.sub(r' class="?[^">]*"?', "", x) for x in pages]
    bare = [re.sub(r"<(/?)(nav|article|footer|header)>", r"<\1div>", x) for x in nameless]
    texts = [html_extraction.main_text(x) for x in pages]
    assert [html_extraction.main_text(x) for x in nameless] == texts
    assert sum(html_extraction.main_text(x) == t for x, t in zip(bare, texts, strict=True)) >= 0.7 * len(texts)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(html_extraction, "path_ratios", lambda blocks: np.ones(len(blocks)))
        assert sum(html_extraction.main_text(x) == t for x, t in zip(bare, texts, strict=True)) < 0.1 * len(texts)
    for x in [*pages[:10], PAGE]:
        blocks = html_extraction.blocks_of(x)[1]
        assert html_extraction.path_ratios(blocks) == pytest.approx(plain_ratios(blocks))


def test_extract_keeps_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None)], "page_id long, url string, html string, text string")
    rows = html_extraction.extract(pages).collect()
    assert [r.n_chars for r in rows].count(0) == 1 and len(rows) == 3
    assert html_extraction.extract(pages.where("false")).count() == 0


# ---- 3
def test_toxicity_learns_without_held_out_labels(spark):
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        bad = i % 3 == 0
        ws = list(rng.choice(words, 40)) + ([f"nasty{rng.integers(9)}x"] if bad else [])
        rng.shuffle(ws)
        rows.append((i, " ".join(ws), "k", 1, "en"))
        labels.append((i, int(bad)))
    rows += [(9000, None, None, None, None), (9001, "", None, None, None), (9001, "", None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    label = spark.createDataFrame([*labels, (5, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, label).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    truth = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    other = label.withColumn("toxic", F.when(toxicity.held_out_id(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted((r.doc_id, r.score) for r in toxicity.toxicity(docs, other).collect()) == sorted((r.doc_id, r.score) for r in got)
    kept = toxicity.drop_toxic(docs, label)
    assert kept.columns == docs.columns and kept.count() == sum(1 - r.predicted for r in got)
    assert {r.score for r in toxicity.toxicity(docs, label.where("false")).collect()} == {1 / (1 + np.exp(35.0))}
    assert toxicity.toxicity(docs.where("false"), label).count() == 0


# ---- 4
def test_license_scan(spark):
    apache = "Licensed under the Apache License, Version 2.0."
    files = [
        (1, "/a/LICENSE", apache), (2, "/a/b/x.py", "code here"), (3, "/a/b/y.py", f"some words of code\n{apache}\nand many more lines that go on for long"), (4, "/c/z.py", None), (5, "/a/b/c/LICENSE", "Released under the MIT License."),
        (6, "/a/b/c/d/e.py", ""), (7, "/a/b/c/d/f.py", "we met under the bridge, the license plate was old and nobody knew"), (8, None, "x"), (8, None, "x"),
    ]
    df = spark.createDataFrame(files, "doc_id long, path string, text string")
    got = {(r.doc_id, r.license, r.origin, r.license_dir) for r in license_scan.scan(df).collect()}
    assert got == {
        (1, "Apache-2.0", "own", "/a"), (2, "Apache-2.0", "inherited", "/a"), (3, "Apache-2.0", "own", "/a/b"), (4, None, "none", None), (5, "MIT", "own", "/a/b/c"),
        (6, "MIT", "inherited", "/a/b/c"), (7, "MIT", "inherited", "/a/b/c"), (8, None, "none", None),
    }
    assert license_scan.scan(df).count() == len(files) and license_scan.scan(df.where("false")).count() == 0


WRAPPED = "\n".join(f" * {x}" for x in (
    "This program is free software: you can redistribute it and/or modify", "it under the terms of the GNU General Public License as published by", "the Free Software Foundation, either version 3 of the License, or", "(at your option) any later version.",
))


def wrap(text, width=78):
    return "\n".join(textwrap.wrap(text, width))


def test_licence_files_are_wrapped_and_hand_down(spark):
    texts = dict(license_scan.TEXTS)
    files = [
        (1, "/mit/LICENSE", "MIT License\n\nCopyright (c) 2020 Some Body\n\n" + wrap(texts["MIT"][12:])), (2, "/mit/src/a.py", "code"), (3, "/bsd/COPYING.txt", wrap(texts["BSD-3-Clause"])), (4, "/bsd/a.py", "x"),
        (5, "/gpl/a.c", f"/*\n{WRAPPED}\n */\nint main() {{ return 0; }}\n" + "y = f(x);\n" * 200), (6, "/gpl/b.c", "int x;"), (7, "/mit/two.c", "x"), (7, "/mit/two.c", "Released under the ISC License"),
        (None, "/n/a.c", f"{WRAPPED}\nint x;\n" + "y = f(x);\n" * 50), (8, "/any/text.bin", wrap(texts["MIT"], 30)), (9, "/any/b", ""), (10, "/long/a", "word " * 300_000),
    ]
    df = spark.createDataFrame([(*f, "clash", 1.5) for f in files], "doc_id long, path string, text string, license string, score double")
    got = {(r.doc_id, r.path, r.license, r.origin, r.license_dir) for r in license_scan.scan(df).collect()}
    assert got == {
        (1, "/mit/LICENSE", "MIT", "own", "/mit"), (2, "/mit/src/a.py", "MIT", "inherited", "/mit"), (3, "/bsd/COPYING.txt", "BSD-3-Clause", "own", "/bsd"), (4, "/bsd/a.py", "BSD-3-Clause", "inherited", "/bsd"),
        (5, "/gpl/a.c", "GPL-3.0", "own", "/gpl"), (6, "/gpl/b.c", None, "none", None), (7, "/mit/two.c", "MIT", "inherited", "/mit"), (7, "/mit/two.c", "ISC", "own", "/mit"),
        (None, "/n/a.c", "GPL-3.0", "own", "/n"), (8, "/any/text.bin", "MIT", "own", "/any"), (9, "/any/b", "MIT", "inherited", "/any"), (10, "/long/a", None, "none", None),
    }


def plain_licences(files):
    """(doc_id, path, license, score, origin, license_dir) by plain loops over runs, templates and ancestors."""
    freq = Counter(t for _, _, x in files for t in set(license_scan.terms(x or "")))
    idf = license_scan.weights(len(files), freq)
    mean = sum(idf.values()) / len(idf)
    vectors = license_scan.template_vectors(idf)

    def cosine(words, u):
        v = {t: c * idf.get(t, mean) for t, c in Counter(words).items()}
        return round(sum(v.get(t, 0) * w for t, w in u.items()) / sum(w * w for w in v.values()) ** 0.5, 9)

    own, gives = [], defaultdict(list)
    for _, path, text in files:
        text, found = text or "", []
        lines = [(i, license_scan.terms(x)) for i, x in enumerate(text.split("\n")) if license_scan.terms(x)]
        if lines:
            found += [(cosine(license_scan.terms(text), u), -k, 0, 0, name, 1.0) for k, name, u in vectors[: len(license_scan.TEXTS)]]
            found = [f for f in found if f[0] >= license_scan.TEXT_THRESHOLD]
        total = len(re.findall(license_scan.TERM + r"|[^\x00-\x7f]+", text.lower()))
        for p in range(len(lines)):
            for k in range(1, min(license_scan.LINES, len(lines) - p) + 1):
                words = [w for _, ws in lines[p : p + k] for w in ws]
                if k > 1 and max(len(ws) for _, ws in lines[p : p + k]) > license_scan.WRAPPED:
                    continue
                if re.search(license_scan.NEGATED, " ".join(words)):
                    continue
                new = [(cosine(words, u), -t, -lines[p][0], -k, name, None) for t, name, u in vectors[len(license_scan.TEXTS) :]]
                new = [f for f in new if f[0] >= license_scan.THRESHOLD]
                found += [(*f[:5], len(words)) for f in new]
        best = max(found, default=None)
        own.append(best)
        named = bool(any(f[3] == 0 for f in found) or re.search(license_scan.FILE_NAMES, path or "/"))
        if best and (named or best[5] >= license_scan.FILE_SHARE * total):
            gives[(path or "/").rpartition("/")[0]].append((named, best[0], path or "/", best[4]))
    out = []
    for (i, path, _), best in zip(files, own, strict=True):
        path = path or "/"
        d = path.rpartition("/")[0]
        up = d
        while up and up not in gives:
            up = up.rpartition("/")[0]
        up = up if up in gives else None
        name = best[4] if best else max(gives[up])[3] if up is not None else None
        out.append((i, path, name, best and best[0], "own" if best else "inherited" if up is not None else "none", d if best else up))
    return out


def test_license_scan_equals_a_plain_version(spark):
    rng = np.random.default_rng(4)
    lines = [x for _, x in license_scan.NOTICES] + ["", "some code here", "the version of it", "* * *", "public license of words", "released 2.0 under 4.0", "gnu general public license " + "long line of terms " * 7]
    files = []
    for i in range(60):
        text = "\n".join(lines[k] for k in rng.integers(0, len(lines), rng.integers(0, 6)))
        words = text.split(" ")
        if len(words) > 4 and i % 3 == 0:
            words[len(words) // 2] += "\n"
        depth = int(rng.integers(0, 4))
        files.append((i % 50, "/".join(["", *(str(x) for x in rng.integers(0, 2, depth)), ["LICENSE", "a.py"][int(rng.integers(0, 2))]]), " ".join(words) if i % 7 else None))
    df = spark.createDataFrame(files, "doc_id long, path string, text string")
    key = lambda r: tuple(str(x) for x in r)
    got = sorted((tuple(r) for r in license_scan.scan(df).collect()), key=key)
    assert got == sorted(plain_licences(files), key=key)


# ---- 5
def test_exact_dedup(docs, empty):
    groups = defaultdict(list)
    for i, t in TEXTS:
        groups[lower(t)].append(i)
    exp = Counter()
    for i, t in TEXTS:
        g = groups[lower(t)]
        keep = max((x for x in g if x is not None), default=None)
        exp[(i, keep, len(g), i == keep, hashlib.sha256(lower(t).encode()).hexdigest())] += 1
    assert Counter(map(tuple, exact_dedup.exact_dedup(docs, capacity=2).collect())) == exp
    kept = exact_dedup.drop_copies(docs, capacity=2)
    assert kept.columns == docs.columns and Counter(lower(r.text) for r in kept.collect()) == Counter(groups.keys())
    assert exact_dedup.exact_dedup(empty).count() == 0 and exact_dedup.drop_copies(empty).count() == 0


def test_texts_that_share_a_key_are_chained_and_told_apart(spark, docs):
    """One bit of key for all texts: chains hold many texts, and the bytes decide."""
    rows = docs.unionByName(docs.where("doc_id in (3, 6)")).withColumns({"gone_id": F.lit(1), "again": F.lit("x")})
    index = exact_dedup.build_index(rows, capacity=2, key_bits=1).collect()
    by_key = defaultdict(list)
    for r in index:
        by_key[r.key].append(r.chain)
    assert len(by_key) <= 2 and all(sorted(c) == list(range(len(c))) for c in by_key.values()) and max(map(len, by_key.values())) > 2
    assert {r.text_sha256 for r in index} == {hashlib.sha256(lower(t).encode()).hexdigest() for _, t in TEXTS}
    assert Counter(exact_dedup.exact_dedup(rows, key_bits=1).collect()) == Counter(exact_dedup.exact_dedup(rows).collect())
    kept = exact_dedup.drop_copies(rows, key_bits=1)
    assert kept.columns == rows.columns and Counter(lower(r.text) for r in kept.collect()) == Counter({lower(t) for _, t in TEXTS})


def test_directory_splits_overfull_buckets(spark):
    keys = spark.range(500).select(F.xxhash64("id").alias("key"))
    leaves = exact_dedup.directory(keys, 16).collect()
    assert max(r.n_keys for r in leaves) <= 16 and sum(r.n_keys for r in leaves) == 500 and len({r.depth for r in leaves}) > 1


# ---- 6
def plain_decontamination(texts, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = []
    for k, t in items:
        w = word.findall(lower(t))
        n = min(10, len(w))
        windows += [(k, tuple(w[i : i + n])) for i in range(len(w) - n + 1)] if n else []
    for i, t in texts:
        w, hit, found = word.findall(lower(t)), set(), set()
        for k, p in windows:
            for s in range(len(w) - len(p) + 1):
                if tuple(w[s : s + len(p)]) == p:
                    hit.update(range(s, s + len(p)))
                    found.add(k)
        ids = sorted(x for x in found if x is not None)
        yield i, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block", [16 << 20, 40])
def test_decontamination(spark, docs, empty, block):
    items = [("b", "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15 w16"), ("a", "Hello, WORLD!"), ("c", None), ("d", "..."), (None, "raw"), ("e", "B c"), ("e", "B c"), ("f", "long long long")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    texts = [(i, t) for i, t in TEXTS if i != 14] + [(14, "long " * 300)]
    small = docs.where("doc_id <> 14 or doc_id is null").unionByName(spark.createDataFrame([(14, "long " * 300, "k", 1, "en")], SCHEMA))
    small = small.withColumns({"hit": F.lit("mine"), "n_words": F.array(F.lit(1))})
    marked = decontamination.mark(small, bench, block_bytes=block)
    got = Counter(
        (r.doc_id, r["_n_words"], len(r["_hit"]), len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), bool(r["_hit"])) for r in marked.collect()
    )
    assert got == Counter(plain_decontamination(texts, items)) and {r["hit"] for r in marked.collect()} == {"mine"}
    assert Counter(map(tuple, decontamination.decontaminate(small, bench, block_bytes=block).collect())) == got
    kept = decontamination.drop_contaminated(small, bench)
    assert kept.columns == small.columns and kept.count() == sum(n for k, n in got.items() if not k[-1])
    assert decontamination.decontaminate(empty, bench).count() == 0
    assert decontamination.decontaminate(docs, bench.where("false")).where("contaminated").count() == 0


# ---- 7
def test_quote_linking(spark):
    rows = [
        (1, 0, "u", "Hello there.\n\nHow do I sort?"), (1, 1, "a", "> How do I SORT\n\nUse sorted."), (1, 2, "u", "Thanks\nA wrote:\n>> how do i sort?\n> Use sorted.\nok\n> unknown"),
        (1, 3, "u", "> Hello there.\nHi"), (1, 4, "a", "after"), (2, 0, "u", "How do I sort?"), (None, None, None, None), (3, 5, "u", "x"), (3, 5, "u", "x"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    linked = chat_quotes.link_quotes(df)
    got = {(r.conv_id, r.turn): r for r in linked.collect()}
    assert linked.count() == len(rows)
    assert [got[1, t].parent_turn for t in range(5)] == [None, 0, 1, 0, 3]
    assert got[1, 2].text == "Thanks\nok" and (got[1, 2].n_quotes, got[1, 2].n_linked) == (3, 2)
    assert got[1, 1].text == "Use sorted." and got[None, None].text == ""
    order = [r.turn for r in chat_quotes.conversations(linked).collect() if r.conv_id == 1]
    assert order == [0, 1, 2, 3, 4]
    assert chat_quotes.link_quotes(df.where("false")).count() == 0


def test_reply_order_goes_back_to_branches(spark):
    rows = [(1, 0, "u", "root line"), (1, 1, "a", "first answer"), (1, 2, "u", "> root line\nsecond thread"), (1, 3, "a", "> first answer\nmore on the first")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert [r.turn for r in chat_quotes.conversations(chat_quotes.link_quotes(df)).collect()] == [0, 1, 3, 2]


def quoting_conversations(seed, n=40):
    """(rows, expected parent): replies that quote whole paragraphs, wrapped lines, re-wrapped text, sentences, and quotes of quotes."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdefghij"), int(rng.integers(2, 8))))
    sentence = lambda lo=8, hi=14: " ".join(word() for _ in range(int(rng.integers(lo, hi)))).capitalize() + "."
    rows, parents = [], {}
    for c in range(n):
        own = []
        for t in range(12):
            text, parent = "\n\n".join(textwrap.fill(" ".join(sentence() for _ in range(int(rng.integers(2, 5)))), 50) for _ in range(2)), t - 1 if t else None
            body = text
            if t and rng.random() < 0.8:
                parent = int(rng.integers(0, t))
                paragraph = own[parent].split("\n\n")[int(rng.integers(2))]
                kind = int(rng.integers(5))
                if kind == 0:
                    quote = paragraph
                elif kind == 1:
                    lines = paragraph.split("\n")
                    quote = "\n".join(lines[: max(2, len(lines) // 2)])
                elif kind == 2:
                    quote = textwrap.fill(paragraph.replace("\n", " "), 70).upper()
                elif kind == 3:
                    quote = re.split(r"(?<=[.])\s", paragraph)[-1]
                else:
                    quote = paragraph + "\n> nested from far away and long ago it was"
                body = "They wrote:\n" + "\n".join(f"> {x}" for x in quote.split("\n")) + "\n\n" + text
            own.append(text)
            rows.append((c, t, "u", body))
            parents[c, t] = parent
    return rows, parents


def plain_quotes(rows):
    """Parent by plain search: the latest earlier message whose own text contains the words of a level-1 passage."""
    own, out = {}, {}
    for c, t, _, body in rows:
        clean, _, _ = chat_quotes.parse(body)
        quoted, passage = [], []
        for line in [*body.split("\n"), ""]:
            m = re.fullmatch(r">(?! ?>) ?(.+)", line)
            if m:
                passage.append(m[1])
            elif passage:
                quoted.append(" ".join(chat_quotes.words_of("\n".join(passage))))
                passage = []
        found = [e for q in quoted for e in range(t) if f" {q} " in own[c, e]]
        out[c, t] = max(found, default=t - 1 if t else None)
        own[c, t] = f" {' '.join(chat_quotes.words_of(clean))} "
    return out


def test_parts_of_messages_are_linked(spark):
    rows, parents = quoting_conversations(1)
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "conv_id long, turn long, role string, text string, own int, units string")
    got = {(r.conv_id, r.turn): r.parent_turn for r in chat_quotes.link_quotes(df.repartition(3)).collect()}
    plain = plain_quotes(rows)
    assert sum(got[k] == plain[k] for k in got) >= 0.99 * len(got)
    assert sum(got[k] == v for k, v in parents.items()) >= 0.95 * len(parents)


def test_long_and_repeated_messages(spark):
    import time

    text = "\n".join(f"> quoted line {i} with some words" if i % 3 else f"own line {i} with some words" for i in range(100_000))
    began = time.perf_counter()
    chat_quotes.parse(text)
    assert time.perf_counter() - began < 30
    p, q = "the first of two texts that one turn has here", "the second of two texts that one turn has here"
    rows = [(1, 0, "u", p), (1, 0, "u", q), (1, 1, "u", "between"), (1, 2, "u", f"> {p}\nyes"), (1, 2, "u", f"> {q}\n\n> {q}\nno"), (1, 3, "u", f"Ann said:\n\n> {p}\n>> {p}")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = [(r.turn, r.text, r.n_quotes, r.n_linked, r.parent_turn) for r in chat_quotes.link_quotes(df).collect()]
    assert Counter(got) == Counter([(0, p, 0, 0, None), (0, q, 0, 0, None), (1, "between", 0, 0, 0), (2, "yes", 2, 2, 0), (2, "no", 2, 2, 0), (3, "", 2, 2, 0)])


# ---- 8
def plain_components(texts):
    sets = []
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets.append((i, {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and 100 * len(x & y) >= 75 * len(x | y):
                root[find(a)] = find(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(sets):
        least[find(k)].append(i)
    for k, (i, s) in enumerate(sets):
        c = min((x for x in least[find(k)] if x is not None), default=None)
        yield i, len(s), c, i == c


def test_near_duplicates(docs, empty):
    assert Counter(map(tuple, near_dedup.near_duplicates(docs).collect())) == Counter(plain_components(TEXTS))
    assert near_dedup.near_duplicates(empty).count() == 0
    kept = near_dedup.drop_near_copies(docs)
    assert kept.columns == docs.columns and 8 in {r.doc_id for r in kept.collect()} and 9 not in {r.doc_id for r in kept.collect()}


def test_near_duplicates_of_a_drifting_group(spark):
    """A chain of edits, a common passage and many random edits: every component equals the plain one."""
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(80)]
    rows, ws = [], list(base)
    for i in range(40):
        rows.append((i, " ".join(ws)))
        ws[int(rng.integers(80))] = f"e{i}"
    for i in range(40, 100):
        edited = list(base)
        for k in rng.choice(80, int(rng.integers(0, 6)), replace=False):
            edited[k] = f"r{i}_{k}"
        rows.append((i, " ".join(edited)))
    for i in range(100, 140):
        rows.append((i, " ".join([f"u{i}_{k}" for k in range(40)] + base[:30])))
    rows = [rows[k] for k in rng.permutation(len(rows))]
    df = spark.createDataFrame([(i, t, "k", 1, "en") for i, t in rows], SCHEMA)
    assert Counter(map(tuple, near_dedup.near_duplicates(df).collect())) == Counter(plain_components(rows))


def test_edges_stay_in_proportion_to_a_group(spark):
    """Near copies of one text, groups of 200 and 800: two edges a member at most, however large the group."""
    rng = np.random.default_rng(11)
    for size in (200, 800):
        base = [f"b{i}" for i in range(150)]
        rows = []
        for i in range(size):
            edited = list(base)
            for k in rng.choice(150, 4, replace=False):
                edited[k] = f"r{i}_{k}"
            rows.append((i, " ".join(edited)))
        df = spark.createDataFrame([(i, t, "k", 1, "en") for i, t in rows], SCHEMA)
        made = []

        def forest(edges, plain=near_dedup.forest, made=made):
            made.append(plain(edges))
            return made[-1]

        with pytest.MonkeyPatch.context() as m:
            m.setattr(near_dedup, "forest", forest)
            near_dedup.near_duplicates(df).count()
        assert all(x.count() <= 2 * size for x in made) and made


def test_star_forest_connects_what_the_edges_do():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 60, 50), rng.integers(0, 60, 50)
    v, w = near_dedup.star_forest(a, b)
    group = {int(x): int(x) for x in np.concatenate([a, b])}
    for _ in range(60):
        for x, y in zip(a, b, strict=True):
            group[x] = group[y] = min(group[x], group[y])
    assert {x: group[x] for x in group if group[x] != x} == dict(zip(v.tolist(), w.tolist(), strict=True))


def test_pairs_too_large_for_the_pivot_are_found(spark):
    """A bucket of one passage: x is too large for the pivot, y is not inside it, and both are alike outside it."""
    rng = np.random.default_rng(5)
    passage, both, own = np.split(rng.integers(1, 2**62, 4000), [80, 93])
    sets = {i: [*passage, *own[2 * i : 2 * i + 2]] for i in range(10)}
    sets[20], sets[21] = [*passage, *both, *own[100:117]], [*passage, *both, *own[200:214]]
    made = spark.createDataFrame([(i, bytearray(np.sort(np.array(s, np.int64)).tobytes())) for i, s in sets.items()], "cid long, shingles binary")
    left = spark.createDataFrame([(i, len(s), 0, 7) for i, s in sets.items()], "cid long, n long, pos int, band long")
    comp = spark.createDataFrame([(i, 0) for i in range(10)], "cid long, comp long")
    left, _, seen, outside = near_dedup._against_central(left, made)
    rest = near_dedup._remaining(left.withColumn("bands", F.array(F.lit(7))), comp, outside)
    assert (20, 21) in {(r.a, r.b) for r in rest.collect()}


def test_min_max_signatures_estimate_similarity():
    a, b = (np.sort(near_dedup.mix(np.arange(lo, lo + 1000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))) for lo in (0, 250))
    x, y = near_dedup.band_keys([a, b], permutations=512, rows=1)
    assert abs(np.mean(x == y) - 750 / 1250) < 0.06


# ---- 9
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_encoding_without_dropout_is_the_library_s():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = ["  x", "a  b", "a    b", "\n\n a\tb", "日本語🎉 x", "<s> a </s>", "x" * 300 + "  ", " ", "", *(t for _, t in TEXTS if t and "▁" not in t)]
    model = merge_dropout.load(MODEL)
    ids, n = merge_dropout.Segmenter(model, rate=0.0).ids(texts, list(range(len(texts))))
    for t, part in zip(texts, np.split(ids, np.cumsum(n)[:-1]), strict=True):
        assert part.tolist() == sp.encode(t)


def test_dropout_is_seeded_varied_and_lossless(spark, docs, empty):
    texts = {(i, t or "") for i, t in TEXTS}
    enc = merge_dropout.encode(docs, MODEL, rate=0.3)
    rows = enc.collect()
    assert len(rows) == len(TEXTS) and all(r.lossless for r in rows)
    assert {(r.doc_id, r.text) for r in merge_dropout.decode(enc, MODEL).collect()} == texts
    again = {(r.doc_id, tuple(r.ids)) for r in merge_dropout.encode(docs.repartition(3), MODEL, rate=0.3).collect()}
    assert again == {(r.doc_id, tuple(r.ids)) for r in rows}
    assert again != {(r.doc_id, tuple(r.ids)) for r in merge_dropout.encode(docs, MODEL, rate=0.3, seed=1).collect()}
    long = next(r for r in rows if r.doc_id == 14)
    assert len({tuple(long.ids[k : k + 2]) for k in range(0, 400)}) > 3
    assert merge_dropout.encode(empty, MODEL).count() == 0


def test_every_occurrence_draws_by_itself():
    """Each chunk equals the plain agenda under the key of its document and place, and a lone merge is skipped at the rate."""
    model = merge_dropout.load(MODEL)
    texts = ["internationalisation " * 400, " ".join("a" * 20_000), "日本🎉é the quick " * 20 + "x" * 30 + " " + "y" * 60]
    keys = [11, 12, 13]
    segmenter = merge_dropout.Segmenter(model)
    ids, n = segmenter.ids(texts, keys)
    parts = np.split(ids, np.cumsum(n)[:-1])
    for t, k, part in zip(texts, keys, parts, strict=True):
        plain = []
        for place, chunk in enumerate(merge_dropout.CUT.findall(" " + t)):
            key = (k + place * 0x9E3779B97F4A7C15 + merge_dropout.SEED) % 2**64
            for i in model.heap(model.symbol[[ord(x) for x in chunk]].tolist(), key, segmenter.below):
                plain += [i] if i < model.size else model.byte_id[list(chr(i - model.size).encode())].tolist()
        assert part.tolist() == plain
    words = model.decode(parts[0].tolist()).split()
    assert len(words) == 400
    segmentations, now = set(), []
    for i in parts[0].tolist():
        if model.bytes_of[i].startswith(b" "):
            segmentations.add(tuple(now))
            now = []
        now.append(i)
    assert len(segmentations) > 20
    assert 0.08 < (len(parts[1]) - 20_000) / 20_000 < 0.12


def test_heap_and_step_agree():
    model = merge_dropout.load(MODEL)
    chunks = [f" {a}{b}" for a in ("internation", "wörter", "the", "xq🎉") for b in ("al", "s.", "", "tion,")]
    keys = np.arange(len(chunks), dtype=np.uint64)
    limit = int(0.3 * 2**64)
    step = model.encode(chunks, keys, limit)
    flat = [i for c, k in zip(chunks, keys, strict=True) for i in model.heap(model.symbol[[ord(x) for x in c]].tolist(), int(k), limit)]
    spelt = [j for i in flat for j in ([i] if i < model.size else model.byte_id[list(chr(i - model.size).encode())].tolist())]
    assert step[0].tolist() == spelt


# ---- 10
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def test_codes_give_random_access():
    rng = np.random.default_rng(1)
    for n in (0, 1, 511, 512, 513, 5000):
        ids = (rng.integers(0, 2**32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        payload = token_store.encode(ids)
        assert token_store.decode(payload).tolist() == ids.tolist()
        assert all(token_store.get(payload, i) == ids[i] for i in range(0, n, 7))


def test_token_store(spark, docs, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(VOCABULARY)
    path = token_store.write_store(docs.repartition(3), VOCABULARY)
    got = token_store.read_store(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, *sorted(i for i, _ in TEXTS if i is not None)]
    texts = {i: t or "" for i, t in TEXTS}
    start = 0
    for r in got:
        ids = [*tok.encode(texts[r.doc_id], add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids) == (start, len(ids), ids)
        start += len(ids)
    sums = {(r.start, r.ids_crc32) for r in token_store.summarise_store(spark, path).collect()}
    assert sums == {(r.start, zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in got}
    assert token_store.read_store(spark, token_store.write_store(empty, VOCABULARY)).count() == 0


def test_tokens_are_found_by_global_position(spark, docs):
    path = token_store.write_store(docs.repartition(3), VOCABULARY)
    rows = sorted(token_store.read_store(spark, path).collect(), key=lambda r: r.start)
    ids = [i for r in rows for i in r.ids]
    for at in (0, 1, len(ids) // 2, rows[-1].start, len(ids) - 1):
        assert token_store.token_at(spark, path, at) == ids[at]
    with pytest.raises(IndexError):
        token_store.token_at(spark, path, len(ids))


def test_other_tokenizers_go_through_the_library(spark, docs):
    """A file that keeps white space: ids are the library's, not those of chunks."""
    from tokenizers import Tokenizer

    other = public_tokenizers.path("byte_bpe_50k.json")
    assert token_store.cuts_at_space(VOCABULARY) and not token_store.cuts_at_space(other)
    tok = Tokenizer.from_file(other)
    got = {(r.doc_id, tuple(r.ids)) for r in token_store.read_store(spark, token_store.write_store(docs, other)).collect()}
    assert got == {(i, (*tok.encode(t or "", add_special_tokens=False).ids, 2)) for i, t in TEXTS}


def test_chunks_equal_the_library():
    import random

    from tokenizers import Tokenizer

    tok, table, rng = Tokenizer.from_file(VOCABULARY), token_store.PieceTable(token_store.ChunkEncoder(VOCABULARY)), random.Random(3)
    letters = "aAbßéÉİıŉſΣσςáë'’s.,!?;:…«»\x1c\xa0　\x85 \n\t\r\x0b123٣日本🎉<|startoftext|>HḴÅǅ≠&-_\x00"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + ["don't I'LL they've", ""]
    ids, n = token_store.token_ids([t.encode() for t in texts], table)
    for part, e in zip(np.split(ids, np.cumsum(n)[:-1]), tok.encode_batch(texts, add_special_tokens=False), strict=True):
        assert part.tolist() == [*e.ids, 2]


# ---- shared
def test_shared_folder_is_asked_of_the_session(spark):
    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir", common.shared_dir(spark))
