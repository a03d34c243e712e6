"""Boilerplate lines by their frequency within a site. DataFrame functions only.

A line's ratio is the number of the site's pages that hold it over the number of the site's pages. Pages of
equal text count once, so a page copied many times does not turn into boilerplate. Lines above the ratio are
dropped from all pages of the site, however small the site and whatever the share of the page they make up. Only
a line that a single page holds is never boilerplate, or every line of a site of one page would be.

Scale: per page only 16-byte digests of its distinct lines are shuffled, and counts combine before the
shuffle. A site has at most (mean lines of a page / ratio) such lines, which bounds each site's list; texts are
not shuffled as long as the lists of all sites are small enough for Spark to broadcast, and otherwise meet
them in a join whose hot sites Spark splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from datamill.llm.common import SPACE, null_key, packed, text_of, unpacked, written

RATIO = 0.1
MIN_PAGES = 2
WHOLE = 1.0


def _digest(line: Column) -> Column:
    return F.unhex(F.md5(F.btrim(line, F.lit(SPACE))))


def _blank(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACE)) == ""


def host(url: Column) -> Column:
    """The lower-case host of a URL, without user and port; null if there is none."""
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(found != "", found)


def _site(docs: DataFrame, site: str | Column) -> Column:
    return null_key(docs[site] if isinstance(site, str) else site)


def boilerplate_lines(docs: DataFrame, site: str | Column = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(site_key, lines): the digests of each site's boilerplate lines; sites without any are left out.

    A line is boilerplate if at least ``min_pages`` distinct pages of the site and more than ``ratio`` of them
    hold it, surrounding white space aside. Blank lines never count. A null site is a site of its own. ``site`` is a
    column or its name; for tables of pages, ``host(pages.url)``.
    """
    lines = F.filter(F.split(text_of(docs[text]), "\n"), lambda x: ~_blank(x))
    pages = docs.select(
        _site(docs, site).alias("site_key"), F.unhex(F.md5(text_of(docs[text]))).alias("page"),
        F.array_distinct(F.transform(lines, _digest)).alias("lines"),
    ).distinct()
    # The empty digest stands for the page itself: its count is the site's number of pages.
    held = pages.select("site_key", F.explode(F.concat(F.array(F.lit(b"")), F.col("lines"))).alias("line"))
    counts = written(held.groupBy("site_key", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages), "lines")
    totals = counts.where(F.col("line") == F.lit(b"")).select("site_key", F.col("n").alias("pages"))
    often = counts.where(F.col("line") != F.lit(b"")).join(totals, "site_key").where(F.col("n") > F.col("pages") * ratio)
    return often.groupBy("site_key").agg(F.collect_list("line").alias("lines"))


def drop_boilerplate(docs: DataFrame, site: str | Column = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, whole: float = WHOLE) -> DataFrame:
    """All rows and columns with ``text`` cleaned, plus the ints n_lines and n_dropped (in place of columns of these names).

    A page that is all boilerplate is left without text. A ``whole`` below 1 leaves a page as it is if boilerplate
    lines make up more than that share of its characters, as a matter for the near-duplicate operator.
    A null text stays null with no lines; an empty text has one blank line; repeated rows are cleaned alike.
    """
    found = written(boilerplate_lines(docs, site, text, ratio, min_pages).select(F.col("site_key").alias("_site"), F.col("lines").alias("_often")), "boilerplate")
    rows = packed(docs, site=_site(docs, site), lines=F.split(docs[text], "\n")).join(found, F.col("site") == found["_site"], "left")
    marked = F.transform("lines", lambda x: F.struct(x.alias("line"), F.array_contains(F.col("_often"), _digest(x)).alias("often")))
    rows = rows.withColumn("marked", F.when(F.col("_often").isNotNull(), marked))
    size = lambda lines: F.aggregate(lines, F.lit(0), lambda n, x: n + F.length(x["line"]))
    often, other = F.filter("marked", lambda x: x["often"]), F.filter("marked", lambda x: ~x["often"])
    drop = F.coalesce((F.size(often) > 0) & (size(often) <= size(F.col("marked")) * F.lit(whole)), F.lit(False))
    rows = rows.withColumn("dropping", drop)
    cleaned = F.array_join(F.transform(other, lambda x: x["line"]), "\n")
    return unpacked(
        rows, docs.columns,
        **{text: F.when(F.col("dropping"), cleaned).otherwise(F.col("row").getField(text))},
        n_lines=F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")), n_dropped=F.when(F.col("dropping"), F.size(often)).otherwise(0),
    )
