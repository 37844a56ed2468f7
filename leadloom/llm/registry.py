"""The queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers

from leadloom.llm import (
    chat_quotes, common, decontamination, exact_dedup, html_extraction, license_scan, merge_dropout, near_dedup, sharding, source_divergence, spelling_variants,
    token_store, toxicity, warc,
)

LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op5_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(common.table(spark, sf_dir, "documents"))


OP5_SQL = f"""
with n as (select doc_id, {LOWER_SQL} as norm from documents),
g as (select norm, max(doc_id) as keep_id, count(*) as group_size from n group by norm)
select n.doc_id, g.keep_id, g.group_size, n.doc_id is not distinct from g.keep_id as kept, sha256(n.norm) as text_sha256
from n join g on n.norm = g.norm
"""


def op6_decontamination(spark, sf_dir):
    return decontamination.decontaminate(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


_WORDS_SQL = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".format(LOWER_SQL)
OP6_SQL = rf"""
with d as (select doc_id, {_WORDS_SQL} as w from documents),
b as (select cast(item_id as varchar) as item_id, {_WORDS_SQL} as w from benchmark),
p as (
  select distinct item_id, least(10, len(w)) as k, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') as pat
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0)
),
ks as (select distinct k from p),
pos as (select doc_id, w, unnest(range(1, len(w) + 1)) as i from d),
win as (select doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') as pat from pos, ks where i + k - 1 <= len(w)),
m as (select win.doc_id, win.i, win.k, p.item_id from win join p on win.k = p.k and win.pat = p.pat),
hit as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + k)) as j from (select distinct doc_id, i, k from m)) group by 1),
it as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id, ',' order by item_id) as s from m group by 1)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (doc_id) left join it using (doc_id)
"""


def op8_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(common.table(spark, sf_dir, "documents"))


OP8_SQL = rf"""
with recursive d as (select doc_id, regexp_extract_all({LOWER_SQL}, '[^\x20\x09-\x0D]+') as w from documents),
s as (
  select distinct doc_id, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') as shingle
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from d where len(w) > 0)
),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id group by 1, 2),
l as (select x, y from p join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * c >= 75 * (nx.n + ny.n - c)),
e as (select x, y from l union all select y, x from l),
reach as (select x, y from e union select reach.x, e.y from reach join e on reach.y = e.x),
c as (select x as doc_id, min(y) as least_id from reach group by 1)
select d.doc_id, coalesce(n.n, 0) as n_shingles, least(d.doc_id, coalesce(c.least_id, d.doc_id)) as component_id,
  d.doc_id <= coalesce(c.least_id, d.doc_id) as kept
from d left join n on n.doc_id = d.doc_id left join c on c.doc_id = d.doc_id
"""


def op1_sharding(spark, sf_dir):
    return sharding.digest(common.table(spark, sf_dir, "documents"))


def op7_chat_quotes(spark, sf_dir):
    return chat_quotes.link_quotes(common.table(spark, sf_dir, "conversations"))


def op2_html_extraction(spark, sf_dir):
    return html_extraction.extract(common.table(spark, sf_dir, "pages"))


def op4_license_scan(spark, sf_dir):
    return license_scan.scan(license_scan.document_files(common.table(spark, sf_dir, "documents")))


def op3_toxicity(spark, sf_dir):
    return toxicity.toxicity(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op9_sentencepiece(spark, sf_dir):
    return merge_dropout.encode(common.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_token_store(spark, sf_dir):
    path = token_store.write_store(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return token_store.summarise_store(spark, path)


def op11_source_divergence(spark, sf_dir):
    return source_divergence.divergence(common.table(spark, sf_dir, "documents"))


OP11_SQL = rf"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
  regexp_extract_all({LOWER_SQL}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
t as (select r, lang, source, unnest(w) as term from d),
k as (select lang, term, count(*) as m from t group by 1, 2 having count(distinct r) >= 10),
v as (select lang, count(*) as v from k group by 1),
g as (select distinct lang, source from d),
c as (select lang, source, term, count(*) as n from t semi join k using (lang, term) group by 1, 2, 3),
s as (select g.lang, g.source, coalesce(v.v, 0) as v, coalesce(sum(c.n), 0) as total from g left join v using (lang) left join c using (lang, source) group by 1, 2, 3),
p as (select s.lang, s.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 2)) // (s.total + 2 * s.v) as p
  from s join k using (lang) left join c using (lang, source, term)),
l as (select lang, sum(total) as total from s group by 1),
q as (select k.lang, k.term, 1 + (1000000000::hugeint * (k.m + 2)) // (l.total + 2 * v.v) as q from k join l using (lang) join v using (lang)),
f as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
e as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(f.value, 0) as value
  from g a join g b on a.lang = b.lang and a.source <> b.source left join f on f.lang = a.lang and f.source = a.source and f.item = b.source),
h as (select p.lang, p.source, 'term' as part, p.term as item, ((p.p - q.q) * (p.p - q.q)) // (p.p + q.q) as value from p join q using (lang, term) where p.n > 0 and p.p > q.q)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as integer) as rank from (
  select *, row_number() over (partition by lang, source, part order by value desc, encode(item)) as rank from (select * from e union all select * from h)
) where part = 'pair' or rank <= 10
"""


def op12_warc(spark, sf_dir):
    return warc.round_trip(common.table(spark, sf_dir, "pages"))


OP12_SQL = """
with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
k as (select payload, max(page_id) as keep_id from p where octet_length(payload) >= 1000 group by 1)
select p.page_id, octet_length(p.payload) as payload_bytes, sha1(p.payload) as payload_digest,
  case when k.keep_id is not null and p.page_id <> k.keep_id then 'revisit' else 'response' end as record_type,
  case when p.page_id <> k.keep_id then k.keep_id end as refers_to
from p left join k on p.payload = k.payload
"""


def op13_spelling_variants(spark, sf_dir):
    return spelling_variants.spelling_variants(common.table(spark, sf_dir, "documents"))


# The CRC runs over the bytes of a run's letters, which are one byte or 0xC3 and one more.
OP13_SQL = rf"""
with recursive tbl as (
  select list_transform(range(256), lambda i: list_reduce(range(8), lambda a, k: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end, i)) as tbl
),
r as (select doc_id, unnest(regexp_extract_all({LOWER_SQL}, '[A-Za-zÀ-ÿ]+')) as run from documents),
o as (select doc_id, run, count(*) as n from r where length(run) >= 7 group by 1, 2),
b as (
  select run, n, flatten(list_transform(string_split(concat(coalesce(cast(doc_id as varchar), ''), ':', run), ''),
    lambda c: case when unicode(c) < 128 then [unicode(c)::bigint] else [195::bigint, unicode(c)::bigint - 64] end)) as bytes from o
),
h as (select run, n, xor(list_reduce(bytes, lambda a, x: xor(a >> 8, tbl[xor(a & 255, x) + 1]), 4294967295::bigint), 4294967295) as h from b, tbl),
w as (
  select word, sum(n)::bigint as n
  from (select case when h % 31 = 0 then concat(left(run, (h % length(run))::int), substr(run, (h % length(run))::int + 2)) else run end as word, n from h)
  where length(word) >= 7 group by 1 having sum(n) >= 2
),
x as (select word, n, i, concat(left(word, i::int), substr(word, i::int + 2)) as cut from (select word, n, unnest(range(length(word))) as i from w)),
e as (
  select a.word, b.word as other, b.n as m from x a join x b on a.cut = b.cut and a.i = b.i and a.word <> b.word
  union select w.word, x.word, x.n from w join x on x.cut = w.word
  union select x.word, w.word, w.n from w join x on x.cut = w.word
),
f as (select word, count(*) as n_near, arg_min(struct_pack(word := other, n := m), struct_pack(m := -m, w := encode(other))) as best from e group by 1),
j as (
  select w.word, w.n, coalesce(n_near, 0) as n_near, case when best.n >= 10 * w.n then best.word end as form, case when best.n >= 10 * w.n then best.n end as form_n
  from w left join f on f.word = w.word
),
c as (select word, form as at from j where form is not null union all select c.word, j.form from c join j on j.word = c.at where j.form is not null),
z as (select c.word, c.at as root from c join j on j.word = c.at where j.form is null)
select j.word, j.n, j.n_near, j.form, j.form_n, coalesce(z.root, j.word) as root from j left join z on z.word = j.word
"""


_ALL = (
    op1_sharding, op2_html_extraction, op3_toxicity, op4_license_scan, op5_exact_dedup, op6_decontamination,
    op7_chat_quotes, op8_near_dedup, op9_sentencepiece, op10_token_store,
    op11_source_divergence, op12_warc, op13_spelling_variants,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {
    "op5_exact_dedup": OP5_SQL, "op6_decontamination": OP6_SQL, "op8_near_dedup": OP8_SQL,
    "op11_source_divergence": OP11_SQL, "op12_warc": OP12_SQL, "op13_spelling_variants": OP13_SQL,
}
