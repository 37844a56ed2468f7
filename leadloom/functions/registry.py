"""Functions by name, for queries that are written in SQL alone: table functions over pages, and scalar functions."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from leadloom.functions import documents, html, nodes

# fixed values: scalar functions as SQL
SCALARS = {
    "url_host(u string)": ("string", "regexp_extract(lower(u), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)"),
    "mask_edges(t string)": ("string", "case when length(t) <= 2 then repeat('*', length(t)) else concat(left(t, 1), repeat('*', length(t) - 2), right(t, 1)) end"),
    "jst_day(t timestamp_ntz)": ("date", "cast(t + interval 9 hours as date)"),
}


@F.udtf(returnType="dom_index int, href string, text string, title string, parent string")
class PageLinks:
    """The anchors of a page in page order."""

    def eval(self, page: str) -> Iterator[tuple]:
        for k, a in enumerate(html._read(page).anchors):
            yield k, a[0], " ".join(a[1]), a[2], a[7]


@F.udtf(returnType="pre int, last int, parent int, depth int, tag string, id string, classes string, text string")
class PageNodes:
    """The elements and texts of a page, numbered in page order."""

    def eval(self, page: str) -> Iterator[tuple]:
        tree = nodes._Tree.read(page)
        for n, tag in enumerate(tree.tag):
            yield n, tree.last[n], tree.parent[n], tree.depth[n], tag, tree.attrs[n].get("id"), tree.attrs[n].get("class"), tree.text[n]


def register(spark: SparkSession) -> None:
    """page_links, page_nodes (table functions), nfkc_lower, and ``SCALARS``."""
    spark.udtf.register("page_links", PageLinks)
    spark.udtf.register("page_nodes", PageNodes)
    spark.udf.register("nfkc_lower", F.pandas_udf(documents.fold_all, "string"))
    for name, (kind, body) in SCALARS.items():
        spark.sql(f"create or replace temporary function {name} returns {kind} return {body}")
