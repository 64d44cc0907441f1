"""Boilerplate lines of a site: the share of a host's pages that hold a line decides whether it goes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _common as c

RATIO = 0.3  # lines on more than this share of a host's pages are boilerplate
MIN_PAGES = 3  # and on at least so many pages

_HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"
#: Left out. What isn't closed goes on to the end of the page, as in a browser, a head at most to the body.
_UNSEEN = [
    r"(?s)<!--(?:.*?-->|.*)", r"(?is)<head\b.*?(?:</head\s*>|(?=<body\b)|\z)", r"(?is)<script\b(?:.*?</script\s*>|.*)", r"(?is)<style\b(?:.*?</style\s*>|.*)",
]
_BLOCK = (
    r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|figure|footer|form|h[1-6]|header|hr|html|li|main|nav|ol|p|pre"
    r"|section|table|td|th|tr|ul)\b[^>]*(?:>|\z)"
)
_TAG = r"<[^>]*(?:>|\z)"
_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&nbsp;": " ", "&amp;": "&"}  # in this order


def host_of(url: Column) -> Column:
    """Lower-case host of a URL; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _HOST, 1))


def html_text(html: Column) -> Column:
    """Visible text: block elements on lines of their own, other tags left out, basic entities read."""
    out = F.coalesce(html, F.lit(""))
    for p in _UNSEEN:
        out = F.regexp_replace(out, p, "\n")
    out = F.regexp_replace(F.regexp_replace(out, _BLOCK, "\n"), _TAG, "")
    for k, v in _ENTITIES.items():
        out = F.replace(out, F.lit(k), F.lit(v))
    return out


def lines_of(text: Column) -> Column:
    """Lines with a word, runs of white space in them as one space."""
    one = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09\x0B-\x0D]+", " "), r"\x20?\n\x20?", "\n")
    return F.filter(F.split(F.trim(one), "\n"), lambda x: x != "")


def boilerplate(rows: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``host, bad``: the boilerplate lines of each host that has some. ``rows`` has host and lines.

    A host has at most (distinct lines of its mean page) / ratio of them, so the list is bounded by the pages.
    """
    pages = rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    seen = rows.select("host", F.explode(F.array_distinct("lines")).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    seen = c.lookup(seen.where(F.col("n") >= min_pages), pages, ["host"], ["line"])
    return seen.where(F.col("n") > F.lit(ratio) * F.col("pages")).groupBy("host").agg(F.sort_array(F.collect_list("line")).alias("bad"))


def line_dedup(
    docs: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES, id_col: str = "page_id", host: Column | None = None, text: Column | None = None,
) -> DataFrame:
    """One row per row of ``docs``: id, host, text without boilerplate lines, n_lines, n_dropped.

    A line counts once per page, however often it stands there; all its places go when it is boilerplate.
    Hosts of fewer than ``min_pages`` pages lose nothing. Null url: the host is empty, and these pages are one
    site. Null or blank text: no lines, empty text. Repeated rows are pages of their own. A line on exactly ``ratio`` of the
    pages stays. Time follows the length of a page, also where comments, scripts or styles have no end. An empty table gives no rows.
    """
    host = host_of(F.col("url")) if host is None else host
    text = html_text(F.col("html")) if text is None else text
    # Pages are parsed once; their lines are read twice.
    rows = c.save(docs.select(F.col(id_col).alias("id"), host.alias("host"), lines_of(text).alias("lines")), "lines")
    bad = c.save(boilerplate(rows, ratio, min_pages), "boilerplate")
    width = F.aggregate("bad", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x) + 16)
    out = c.lookup(rows, bad, ["host"], ["id"], width)
    # Only the page's own boilerplate lines are searched for each of its lines.
    out = out.withColumn("bad", F.array_intersect("lines", F.coalesce("bad", F.array().cast("array<string>"))))
    kept = F.filter("lines", lambda x: ~F.array_contains("bad", x))
    out = out.select("id", "host", F.size("lines").alias("n_lines"), kept.alias("kept"))
    return out.select("id", "host", F.array_join("kept", "\n").alias("text"), "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"))
