"""Source divergence, WARC archives and spelling variants against plain versions, on random rows and on the odd cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadloom.llm import exact_dedup, html_extraction, license_scan, near_dedup, source_divergence, spelling_variants, warc


def lower(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


# ---- 11
DOCS = "doc_id long, text string, lang string, source string, term string, n long"


def plain_divergence(docs, min_docs):
    rows = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))) for text, lang, source in docs]
    df = Counter((lang, t) for lang, _, terms in rows for t in {*terms})
    kept = defaultdict(set)
    for (lang, t), k in df.items():
        if k >= min_docs:
            kept[lang].add(t)
    count = defaultdict(Counter)
    for lang, source, terms in rows:
        for key in ((lang, source), lang):
            count[key].update(t for t in terms if t in kept[lang])
    groups = sorted({(lang, source) for lang, source, _ in rows})

    def share(key, lang):
        below = sum(count[key].values()) + 2 * len(kept[lang])
        return {t: 1 + 10**9 * (count[key][t] + 2) // below for t in kept[lang]}

    def f(p, q):
        return (p - q) ** 2 // (p + q)

    out = []
    for lang, source in groups:
        p, q = share((lang, source), lang), share(lang, lang)
        pairs = []
        for other_lang, other in groups:
            if other_lang == lang and other != source:
                o = share((lang, other), lang)
                pairs.append((-sum(f(p[t], o[t]) for t in kept[lang]), other))
        terms = [(-f(p[t], q[t]), t.encode()) for t in kept[lang] if count[lang, source][t] and p[t] > q[t]]
        out += [(lang, source, "pair", item, -v, k) for k, (v, item) in enumerate(sorted(pairs, key=lambda x: (x[0], x[1].encode())), 1)]
        out += [(lang, source, "term", item.decode(), -v, k) for k, (v, item) in enumerate(sorted(terms)[:10], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def corpus():
    random.seed(3)
    words = [f"{a}{b}" for a in ("ka", "Lo", "é", "日", "x_y", "O'") for b in ("", "ri", "TÄ", " p")]
    rows = [(" ".join(random.choices(words, k=random.randint(0, 30))), random.choice(["en", "de", None]), random.choice(["a", "b", "é", None, "c", "B", "日", "d", "e", "f"])) for _ in range(300)]
    rows += [(None, "en", "empty"), ("", "fr", "alone"), ("only once", "it", "x"), ("", "it", "y"), ("\x00 5 \x7f", None, None)]
    rows += [("word " * 30_000 + "z" * 100_000, "en", "a")] + [("ka Lori " * 5, "en", "copy")] * 9
    return rows


@pytest.mark.parametrize("settings", [{}, {"light": 0, "slice_terms": 3, "block": 2}, {"light": 3, "slice_terms": 2, "block": 3}, {"light": 99}])
def test_divergence(spark, corpus, settings):
    df = spark.createDataFrame([(k, t, lang, s, "mine", 5) for k, (t, lang, s) in enumerate(corpus)], DOCS)
    for least in (10, 3):
        got = source_divergence.divergence(df, min_docs=least, **settings)
        assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
        assert sorted(tuple(r) for r in got.collect()) == plain_divergence(corpus, least)


def test_divergence_counts_in_parts_and_takes_empty_tables(spark, corpus):
    df = spark.createDataFrame([(k, t, lang, s, "mine", 5) for k, (t, lang, s) in enumerate(corpus)], DOCS)
    whole, parts = (source_divergence.count_terms(df, held) for held in (1 << 20, 4))
    assert parts.count() > whole.count()
    sums = [sorted(map(tuple, x.groupBy("lang", "source", "term").agg(F.sum("n"), F.sum("docs")).collect())) for x in (whole, parts)]
    assert sums[0] == sums[1]
    assert source_divergence.divergence(df.where("false")).count() == 0


def test_shares_are_exact_in_large_counts(spark):
    cases = [(0, 0, 1), (10**15, 3 * 10**15, 10**7), (7, 9 * 10**15, 10**9), (9 * 10**15, 9 * 10**15, 1), (123456789012345, 987654321098765, 4321)]
    df = spark.createDataFrame(cases, "c long, t long, v long").withColumn("p", source_divergence.share_column(F.col("c"), F.col("t"), F.col("v")))
    assert [r.p for r in df.collect()] == [1 + 10**9 * (c + 2) // (t + 2 * v) for c, t, v in cases]


# ---- 12
PAGES = "page_id long, url string, html string, id string, number int"
BIG = "é日🎉\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" * 4000
HTML = [
    (1, "http://a/", "<p>x</p>"), (2, "http://b/", None), (3, None, ""), (4, "http://c/", BIG), (5, "http://d/\r\nWARC-Type: request", "y" * 1000), (6, "u", "y" * 1000), (7, "u", "y" * 999),
    (8, "u", "y" * 999), (9, "u", BIG), (9, "u", BIG), (10, "u", "\n\n\r\r\n"), (None, "u", "q" * 2000), (11, "u", "q" * 2000), (12, "u", "r" * 1500), (12, "u", "r" * 1500), (None, "u", None), (None, "u", "s" * 3000), (None, "v", "s" * 3000),
]


def plain_archive(pages):
    keep = {}
    for page_id, _, html in pages:
        data = (html or "").encode()
        if len(data) >= 1000:
            keep[data] = max(keep.get(data, -1), -1 if page_id is None else page_id)
    out = []
    for page_id, _, html in pages:
        data = (html or "").encode()
        again = data in keep and keep[data] != (-1 if page_id is None else page_id)
        out.append((page_id, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", keep[data] if again else None))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "mine", 1) for p in HTML], PAGES)


@pytest.mark.parametrize("segment", [warc.SEGMENT, 301])
def test_archive_round_trip(spark, pages, segment):
    assert sorted(map(tuple, warc.round_trip(pages, segment).collect()), key=str) == plain_archive(HTML)
    assert warc.round_trip(pages.where("false")).count() == 0


def test_payloads_and_urls_come_back(spark, pages):
    path = warc.write_archive(pages, segment=1000)
    got = warc.read_archive(spark, path, payloads=True).collect()
    assert all(r.error is None for r in got)
    urls = [(i, None if u is None else u.replace("\r\n", " "), (h or "").encode()) for i, u, h in HTML]
    assert sorted(((r.page_id, r.url, bytes(r.payload)) for r in got), key=str) == sorted(urls, key=str)
    records = warc.read_records(spark, path)
    ids = [r.id for r in records.collect()]
    assert len(ids) == len({*ids})
    # a revisit names a record that is there and has its payload
    named = records.where("refers_to is not null").select(F.col("refers_to").alias("id"), F.col("digest").alias("d")).join(records.where("type = 'response'").select("id", "digest"), "id", "left")
    assert named.count() == 2 and all(r.d == r.digest for r in named.collect())


def test_files_hold_nothing_but_records(spark, pages):
    """The files as other readers see them: headers, a block of the stated length, two line ends."""
    import glob
    import gzip

    path = warc.write_archive(pages, segment=4000).removeprefix("file://")
    kinds = Counter()
    for name in glob.glob(f"{path}/*.gz"):
        data = gzip.open(name).read()
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            first, *lines = head.split(b"\r\n")
            fields = dict(line.split(b": ", 1) for line in lines)
            n = int(fields[b"Content-Length"])
            assert first == b"WARC/1.1" and rest[n : n + 4] == b"\r\n\r\n" and fields[b"WARC-Record-ID"].startswith(b"<urn:uuid:")
            kinds[fields[b"WARC-Type"]] += 1
            data = rest[n + 4 :]
    assert kinds[b"response"] + kinds[b"revisit"] == len(HTML) and kinds[b"continuation"] > 50


def test_segments_in_any_order_and_damage(spark, pages):
    path = warc.write_archive(pages, segment=5000)
    records = warc.read_records(spark, path).cache()
    whole = {r.id: r for r in warc.reassemble(records.orderBy(F.rand(1)).repartition(7), True).collect()}
    assert len(whole) >= 2 and all(r.error is None and bytes(r.payload) == BIG.encode() for r in whole.values())
    cut = F.col("type") == "continuation"
    for damage, error in (
        (records.where(~cut | (F.col("number") != 3)), "segment numbers"),
        (records.union(records.where(cut & (F.col("number") == 2))), "segment numbers"),
        (records.where(F.isnull("total")), "total length"),
        (records.where(F.col("type") != "response"), "segment numbers"),
        (records.withColumn("block", F.when(F.col("number") == 2, F.expr("substring(block, 2)")).otherwise(F.col("block"))), "total length"),
    ):
        assert {r.error for r in warc.reassemble(damage).collect()} == {error}


def test_chunks_and_lines():
    for n in (0, 1, 8191, 8192, 8193, 50_000):
        data = bytes(np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8))
        assert warc.unframe(warc.frame(data)) == data
        framed = warc.frame(data, 1000)
        record = warc.record({"WARC-Type": "x"}, framed) + warc.END
        lines = re.findall(rb"[^\n]*\n", record * 2)
        parser = warc.Parser()
        found = [x for line in lines for x in parser.feed(line)]
        assert [b for _, b in found] == [framed] * 2
    assert warc.unframe(b"3;a=b\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    assert warc.payload_of(b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\nabcd") == b"abc"
    for bad in (b"", b"3\r\nabc\r\n", b"4\r\nabc\r\n0\r\n\r\n", b"zz\r\n"):
        with pytest.raises(ValueError):
            warc.unframe(bad)


def test_a_record_that_is_cut_short_is_said(spark, tmp_path):
    import gzip

    good = warc.record({"WARC-Type": "response", "WARC-Record-ID": "<a>", "WARC-Page": 1}, warc.HTTP + warc.frame(b"abc")) + warc.END
    (tmp_path / "a.gz").write_bytes(gzip.compress(good + good[:-20]))
    (tmp_path / "b.gz").write_bytes(gzip.compress(good.replace(b"abc", b"abd").replace(b"WARC-Page: 1", b"WARC-Page: 2")))
    got = warc.read_archive(spark, str(tmp_path), payloads=True).collect()
    assert sorted((r.page_id, r.payload and bytes(r.payload), r.error) for r in got if not r.error) == [(1, b"abc", None), (2, b"abd", None)]
    assert [r.error for r in got if r.error] == ["record cut short"]


# ---- 13
def plain_variants(docs, times=10):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    words = {w: c for w, c in n.items() if c >= 2 and len(w) >= 7}
    near = {}
    for w in words:
        cut = {w[:i] + w[i + 1 :] for i in range(len(w))}
        near[w] = [
            v for v in words
            if v != w and (v in cut or (len(v) == len(w) + 1 and any(v[:i] + v[i + 1 :] == w for i in range(len(v)))) or (len(v) == len(w) and sum(a != b for a, b in zip(v, w, strict=True)) == 1))
        ]
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= times * words[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, words[w], len(near[w]), form[w], words.get(form[w]), root(w)) for w in words)


@pytest.fixture(scope="module")
def spelled():
    random.seed(5)
    rows, chain = [], ["aaaaaaa", "aaaaaaab", "aaaaaabb", "aaaaabbb", "aaaabbbb"]
    for k, w in enumerate(chain):
        rows += [(k, f"{w} " * (2 * 11**k if k < 4 else 30_000))]
    for k in range(150):
        base = [random.choice(["colours", "Éclaire", "colores", "colour×s", "aabbaabb", "ÿÿÿÿÿÿÿ"]) for _ in range(40)]
        for j, w in enumerate(base):
            i = random.randrange(len(w))
            base[j] = random.choice([w, w, w[:i] + w[i + 1 :], w[:i] + random.choice("abÀß") + w[i:], w[:i] + random.choice("xyé") + w[i + 1 :]])
        rows.append((random.choice([k, k, None]), random.choice([" ", "-", "1"]).join(base)))
    long = "".join(random.choices("ab", k=20_000))
    rows += [(900, long), (901, long), (902, long[:777] + "z" + long[778:]), (903, long[:777] + "z" + long[778:]), (904, long[:-1] + " " + long[:-1]), (905, "日本colours日本 ſcolours İcolours"), (906, None), (907, "")]
    rows += [(908, "repeated repeater")] * 3
    return rows


def test_spelling_variants(spark, spelled):
    df = spark.createDataFrame([(i, t, "k", 1, "w") for i, t in spelled], "doc_id long, text string, key string, n long, word string")
    want = plain_variants(spelled)
    for radix in (12, 1):
        got = spelling_variants.spelling_variants(df, radix=radix)
        assert sorted(tuple(r) for r in got.select("word", "n", "n_near", "form", "form_n", "root").collect()) == want
    assert sum(r[3] is not None and r[5] != r[3] for r in want) > 0
    assert spelling_variants.spelling_variants(df.where("false")).count() == 0


def test_colliding_keys_link_nothing(spark, spelled, monkeypatch):
    """All strings of a length share a handful of keys: only the strings decide."""
    small = [r for r in spelled if len(r[1] or "") < 2000]
    df = spark.createDataFrame(small, "doc_id long, text string")
    known = spelling_variants.words(df)
    rows = spelling_variants.keyed(known).withColumn("key", F.pmod("key", F.lit(3)).cast("long"))
    monkeypatch.setattr(spelling_variants, "keyed", lambda words: rows)
    want = {w: (n_near, form) for w, _, n_near, form, _, _ in plain_variants(small)}
    got = {r.word: r.n_near for r in known.join(spelling_variants.near_words(known), "id").select("word", "n_near").collect()}
    assert got == {w: n for w, (n, _) in want.items() if n}


def test_deletion_keys_equal_the_keys_of_the_strings():
    words = ["abcdefg", "aaaaaaa", "ÿa", "x", "", "abcdefh" * 50]
    starts = np.cumsum([0, *map(len, words)])
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    whole, without, place, _ = spelling_variants.deletion_keys(points, starts)

    def key(s):
        return spelling_variants.deletion_keys(np.frombuffer(s.encode("utf-32-le"), np.uint32), np.array([0, len(s)]))[0][0]

    assert [key(w) for w in words] == list(whole)
    assert [key(w[:i] + w[i + 1 :]) for w in words for i in range(len(w))] == list(without)
    assert list(place) == [i for w in words for i in range(len(w))]


# ---- 8
def test_near_copies_go_by_row(spark):
    base = [f"w{i}" for i in range(80)]
    near = [*base[:40], "other", *base[41:]]
    rows = [(1, " ".join(base)), (5, " ".join(near)), (5, "a text of its own"), (6, " ".join(near)), (7, None), (7, "x y"), (None, " ".join(base)), (None, "z")]
    df = spark.createDataFrame([(i, t, "a", "b", 3, "c") for i, t in rows], "doc_id long, text string, __gone string, gone_id string, gone_key long, text_key string")
    kept = sorted(((r.doc_id, r.text) for r in near_dedup.drop_near_copies(df).collect()), key=str)
    assert kept == sorted(((i, t) for i, t in rows if (i, t) not in ((5, rows[1][1]), (6, rows[3][1]), (None, rows[6][1]))), key=str)
    assert near_dedup.drop_near_copies(df).columns == df.columns


# ---- 2
TEN = [f"This is sentence {k} of the article, and it says a little." for k in range(10)]
THREAD = [f"Comment {k}: I do not agree with this at all, for reasons that I will now explain at length." for k in range(60)]


def _p(lines):
    return "".join(f"<p>{x}</p>" for x in lines)


@pytest.mark.parametrize("form", ["<article>{0}</article>{1}", "<article>{0}{1}</article>", "<div>{0}</div>{1}", "<div class=wrap><div class=post>{0}</div>{1}</div>", "<main>{0}</main>{1}"])
def test_comments_go_however_many_there_are(form):
    for n in (3, 22, 60):
        page = "<html><body>" + form.format(_p(TEN), f'<div class="comments">{_p(THREAD[:n])}</div>') + "</body></html>"
        assert html_extraction.main_text(page) == "\n".join(TEN)


def test_a_page_all_of_whose_text_is_named_is_its_article():
    assert html_extraction.main_text(f'<body><div class="widget">{_p(TEN)}</div></body>') == "\n".join(TEN)


def test_linked_items_and_cells_of_an_article_stay():
    page = f'<nav><ul><li><a href=/>Home</a></ul></nav><article>{_p(TEN)}<ul><li><a href=a>First source of the article</a><li><a href=b>Second</a></ul><table><tr><td><a href=c>Cell</a><td>x</table></article>'
    assert html_extraction.main_text(page) == "\n".join([*TEN, "First source of the article", "Second", "Cell", "x"])


def test_the_longer_part_is_the_article_whatever_main_says():
    page = f"<main><p>One short line, no more.</p></main><div>{_p(TEN)}</div>"
    assert set(TEN) <= set(html_extraction.main_text(page).split("\n"))


# ---- 4
def test_versions_tags_and_denials(spark):
    said = {
        "GNU LESSER GENERAL PUBLIC LICENSE\n   Version 2.1, February 1999\n\nThe licenses for most software are designed to take away your freedom.\nThe GNU General Public License is another one.": "LGPL-2.1",
        "GNU LESSER GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007\nThis version incorporates the terms of version 3": "LGPL-3.0",
        "GNU AFFERO GENERAL PUBLIC LICENSE\n Version 3, 19 November 2007": "AGPL-3.0", "GNU GENERAL PUBLIC LICENSE\n Version 2, June 1991": "GPL-2.0", "GNU GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007": "GPL-3.0",
        "# SPDX-License-Identifier: Apache-2.0\nimport x": "Apache-2.0", "// SPDX-License-Identifier: MIT": "MIT", "/* SPDX-License-Identifier: LGPL-2.1-or-later */": "LGPL-2.1", "SPDX-License-Identifier: BSD-3-Clause": "BSD-3-Clause",
        "Eclipse Public License - v 2.0\n\nTHE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS LICENSE": "EPL-2.0", "Boost Software License - Version 1.0 - August 17th, 2003": "BSL-1.0",
        "Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/": "Apache-2.0", "Mozilla Public License Version 2.0\n====": "MPL-2.0",
        "This project is not licensed under the MIT License": None, "The code is no longer released under the MIT License.": None, "Licensed under the MIT License": "MIT",
    }
    files = [(k, f"/p{k}/LICENSE" if k % 2 else f"/p{k}/a.py", t) for k, t in enumerate(said)] + [(1000 + k, f"/q{k}/x", f"some prose of file {k}, this and that\nand more words") for k in range(400)]
    files += [(2000, "/p1/src/a.c", "int main")]
    found = {r.doc_id: r.license for r in license_scan.scan(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    assert {k: found[k] for k in range(len(said))} == dict(enumerate(said.values()))
    assert found[2000] == "LGPL-3.0" and found[1000] is None


# ---- 5
def test_a_leaf_lies_in_one_file_with_all_its_keys_and_lookups_read_it(spark):
    texts = [(k, f"text {k % 700}") for k in range(1000)] + [(2000, None), (2001, "TEXT 5")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else small data is one file
    try:
        index = exact_dedup.build_index(docs, capacity=16)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    held = index.select(F.input_file_name().alias("file"), "bucket_depth", "bucket", "key").collect()
    files, keys = defaultdict(set), defaultdict(set)
    for r in held:
        files[r.bucket_depth, r.bucket].add(r.file)
        keys[r.bucket_depth, r.bucket].add(r.key)
    assert len(files) > 40 and all(len(f) == 1 for f in files.values()) and max(map(len, keys.values())) <= 16 and len({*map(str, files.values())}) > 1
    mask = (1 << 64) - 1
    for (depth, start), found in keys.items():
        assert all((k & mask) >> (64 - depth) == (start & mask) >> (64 - depth) for k in found)
    assert sum(map(len, keys.values())) == 701
    asked = spark.createDataFrame([("text 5", "mine"), ("Text 699", "x"), ("no such text", "y"), (None, None)], "text string, bucket string")
    got = exact_dedup.lookup(index, asked)
    assert got.columns == ["text", "bucket", "keep_id", "group_size"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("text 5", "mine", 2001, 3), ("Text 699", "x", 699, 1), ("no such text", "y", None, None), (None, None, 2000, 1)], key=str)


def test_texts_of_single_rows_are_not_moved(spark):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(50)] + [(50, "text 1")], "doc_id long, text string")
    narrow = exact_dedup.narrow_rows(docs)
    keys = narrow.groupBy("key").agg(F.count("*").alias("n_rows"))
    keys = exact_dedup.placed(keys, exact_dedup.directory(keys.select("key"), 4))
    rows = exact_dedup.chain_entries(docs, narrow, keys).collect()
    assert len(rows) == 50 and sorted(r.group_size for r in rows)[-2:] == [1, 2] and {r.chain for r in rows} == {0}
