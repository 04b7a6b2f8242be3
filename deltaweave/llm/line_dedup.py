"""Boilerplate line removal by site-relative frequency.

For every host, the pages that contain a line are divided by the host's pages;
a line on more than ``ratio`` of them, and on ``min_pages`` at least, is
boilerplate there and goes from all its pages.  The ratio lies in the gap that
was measured between lines that sites repeat (2 to 13 percent of a host's pages)
and those that recur by chance or copying (below 2 percent).  A line of fewer
than ``SHORT_CHARS`` characters recurs more easily and must be on more than
``SHORT_RATIO`` of the pages.  Lines count by their trimmed
content; blank lines are neither counted nor removed, so a page keeps its shape.

Pages send 17-byte digests of their distinct lines to a count that is combined
before the shuffle, so neither a hot host nor a hot line gathers rows.  A host
has at most (mean lines of a page) / ratio boilerplate lines.  Where their
whole table is small by count it is broadcast; otherwise pages and a salted
copy of it meet by an equality join.  Page texts are not shuffled by the first
way and once by the second.

Defined cases: a null or empty text stays as it is and counts as a page of its
host; a page with a null host is no part of a site and stays as it is; repeated
rows count as pages of their own and stay; an empty table gives an empty
result; other columns stay, also those named like something used inside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import fresh, keep

RATIO, MIN_PAGES = 0.02, 5
SHORT_CHARS, SHORT_RATIO = 10, 0.1
#: Boilerplate lines of all hosts together that are broadcast (17 bytes each).
BROADCAST_LINES = 500_000
SALTS = 64


def _digest(line: Column) -> Column:
    """A digest of the trimmed line, with a last byte that tells a short one; null
    for a blank one."""
    short = F.when(F.char_length(F.trim(line)) < SHORT_CHARS, F.lit("01")).otherwise(F.lit("00"))
    return F.when(F.trim(line) != "", F.unhex(F.concat(F.md5(F.trim(line)), short)))


def boilerplate_lines(pages: DataFrame, host: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, line, pages, total) of each boilerplate line; line is its digest."""
    sites = pages.select(host.alias("host"), F.array_distinct(F.transform(F.split("text", "\n"), _digest)).alias("lines")).where("host is not null")
    totals = sites.groupBy("host").agg(F.count(F.lit(1)).alias("total"))
    lines = sites.select("host", F.explode("lines").alias("line")).where("line is not null")
    counts = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= min_pages)
    short = F.substring("line", 17, 1) == F.lit(b"\x01")
    least = F.when(short, F.lit(max(ratio, SHORT_RATIO))).otherwise(F.lit(ratio))
    return counts.join(totals, "host").where(F.col("pages") > least * F.col("total"))


def drop_boilerplate(pages: DataFrame, host: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``pages`` with their texts less the boilerplate lines of their hosts.

    The columns are those of ``pages`` and, last, ``dropped_lines`` (replaced if
    there is one already).
    """
    site, bad, salt = (fresh(pages, x) for x in ("site", "site_lines", "salt"))
    found = keep(boilerplate_lines(pages, host, ratio, min_pages), "boilerplate")
    small = found.count() <= BROADCAST_LINES
    lists = found.groupBy(F.col("host").alias(site)).agg(F.collect_set("line").alias(bad))
    marked = pages.withColumn(site, host)
    if small:
        joined = marked.join(F.broadcast(lists), site, "left")
    else:
        lists = lists.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        marked = marked.withColumn(salt, F.pmod(F.xxhash64("text"), F.lit(SALTS)).cast("int"))
        joined = marked.join(lists, [site, salt], "left").drop(salt)
    kept = F.filter(F.split("text", "\n"), lambda x: F.coalesce(~F.array_contains(F.col(bad), _digest(x)), F.lit(True)))
    left = fresh(pages, "left_lines")
    text = F.when(F.col(left).isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    lost = F.coalesce(F.size(F.split("text", "\n")) - F.size(left), F.lit(0)).cast("long")
    names = [c for c in pages.columns if c.lower() != "dropped_lines"]
    out = joined.withColumn(left, F.when(F.col(bad).isNotNull(), kept))
    return out.select(*(text.alias(c) if c == "text" else F.col(c) for c in names), lost.alias("dropped_lines"))
