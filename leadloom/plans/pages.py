"""Queries that need a parsed page."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadloom.functions import html
from leadloom.sources.views import table

def html_text(spark, d):
    return table(spark, d, "pages").select("page_id", html.page_text(F.col("html")).alias("t")).select("page_id", F.length("t").alias("n"), F.md5("t").alias("digest"))


QUERIES = {f.__name__: f for f in (html_text,)}
_TEXT_SQL = "regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<(script|style)[^>]*>.*?</(script|style)>', chr(1), 'gs')"
_TEXT_SQL = f"regexp_replace({_TEXT_SQL}, '<[^>]*>', chr(1), 'g')"
for _name, _char in (("copy", "©"), ("middot", "·"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("nbsp", "\u00a0"), ("amp", "&")):
    _TEXT_SQL = f"replace({_TEXT_SQL}, '&{_name};', '{_char}')"
_TEXT_SQL = f"array_to_string(list_filter(list_transform(string_split({_TEXT_SQL}, chr(1)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> ''), ' ')"
ORACLES = {
    "html_text": f"select page_id, length(t) as n, md5(t) as digest from (select page_id, {_TEXT_SQL} as t from pages)",
}
