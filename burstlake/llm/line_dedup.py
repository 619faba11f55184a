"""Line deduplication by site-relative frequency (operator 3), in DataFrame operations only.

A line is boilerplate on a host if the host's pages that hold it, divided by all the host's pages, exceed a
ratio. Copies of one page on one host count as one page: else the lines of a page that is copied often would
look like the site's furniture and vanish with all its copies. Lines are counted by two 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared as S

#: A line goes if its pages exceed this share of the host's pages, and are this many at least.
RATIO, LEAST_PAGES = 0.1, 3


def line_hash(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("p"), F.xxhash64(F.lit("line"), line).alias("q"))


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least: int = LEAST_PAGES, copies: bool = False) -> DataFrame:
    """host, lines: the hashes of the boilerplate lines of each host that has any, and pages, the host's distinct pages (with ``copies`` all pages).

    A host has fewer such lines than the lines of its average page divided by ``ratio``.
    """
    lines = F.array_distinct(F.transform(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), line_hash))
    pages = docs.select(F.col(host).alias("host"), F.xxhash64(text).alias("page"), F.xxhash64(F.lit("page"), F.col(text)).alias("page2"), lines.alias("lines"))
    pages = pages if copies else pages.groupBy("host", "page", "page2").agg(F.first("lines").alias("lines"))
    totals = pages.groupBy("host").agg(F.count("*").alias("pages"))
    found = pages.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count("*").alias("held")).where(F.col("held") >= least)
    same = found["host"].eqNullSafe(totals["host"])
    over = found.join(totals, same).where(F.col("held") > ratio * F.col("pages")).select(found["host"], "line", "pages")
    return over.groupBy("host").agg(F.collect_list("line").alias("lines"), F.first("pages").alias("pages"))


def without_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least: int = LEAST_PAGES, copies: bool = False) -> DataFrame:
    """``docs`` with boilerplate lines dropped from ``text``, and lines_dropped (long).

    Lines end at \\n. Blank lines stay and are never boilerplate. Null text stays null; an empty text stays
    empty. Rows whose host is null form one host. Repeated rows count as one page, and all are cleaned. Columns of
    any other name are kept, but one named lines_dropped is replaced. ``copies`` counts copies of a page as pages of their own. A very
    long text is a page like any other. An empty table gives an empty result.
    """
    # a stored table has a real size: Spark broadcasts it only if it is under its limit, and else joins with a shuffle
    on, lines = S.fresh(docs, "host"), S.fresh(docs, "lines")
    found = S.stored(boilerplate(docs, host, text, ratio, least, copies).select(F.col("host").alias(on), F.col("lines").alias(lines)), "boilerplate")
    joined = docs.drop("lines_dropped").join(found, docs[host].eqNullSafe(F.col(on)), "left")
    parts = F.split(F.col(text), "\n")
    kept = F.filter(parts, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col(lines), line_hash(x)))
    same = F.col(lines).isNull() | F.col(text).isNull()
    dropped = F.when(same, F.lit(0)).otherwise(F.size(parts) - F.size(kept)).cast("long")
    clean = F.when(same, F.col(text)).otherwise(F.array_join(kept, "\n"))
    return joined.withColumns({"lines_dropped": dropped, text: clean}).drop(on, lines)
