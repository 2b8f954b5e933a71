"""Site-relative line dedup: lines that more than a given share of a host's pages hold are boilerplate.

Pages are grouped by host; a line's pages are divided by the host's pages. Distinct (host, line) pairs of a page are
counted with map-side sums on 96-bit line hashes, so a third of all pages on one host, or one line on all of them, is
a sum of partial counts. Only lines above the ratio come back, as a list of hashes per host: by broadcast up to a
checked size, else by a join over salted hosts.

A null host is a host of its own; null and empty texts have no lines and stay as they are; a host with fewer than
``least_pages`` pages keeps all its lines; blank lines are never dropped; rows that repeat an id count as pages each;
extra columns stay. With ``copies_once`` the rows of a host that hold the same lines (by a 128-bit hash) count as one
page, in a line's pages and in the host's, so that the lines of a document with many exact copies are not boilerplate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ._spark import cut

RATIO_PERCENT = 20
LEAST_PAGES = 5
#: Most boilerplate lines (12 bytes each) that are broadcast; more are joined by shuffle, hosts dealt over SALTS.
BROADCAST_LINES = 200_000
SALTS = 32


def _hashed(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.hash(line).alias("b"))


def boilerplate(pages: DataFrame, host: str, lines: str, percent: int = RATIO_PERCENT, least_pages: int = LEAST_PAGES, copies_once: bool = False) -> DataFrame:
    """(host, line hash a, b) of lines on more than ``percent`` of 100 of a host's pages; ``lines`` is an array column."""
    host_key = F.coalesce(F.xxhash64(host), F.lit(0)).alias("host")
    distinct = F.array_distinct(F.transform(F.filter(lines, lambda x: ~x.rlike(r"^[ \t\r]*\z")), _hashed)).alias("hs")
    if copies_once:  # map-side, so a host's copies meet as one row a task
        whole = [F.xxhash64(lines).alias("wa"), F.xxhash64(F.lit(1), lines).alias("wb")]
        pages = cut(pages.select(host_key, *whole, distinct).dropDuplicates(["host", "wa", "wb"]).select("host", "hs"))
    else:
        pages = pages.select(host_key, distinct)
    total = pages.groupBy("host").agg(F.count("*").alias("pages"))
    seen = pages.select("host", F.explode("hs").alias("h")).groupBy("host", "h.a", "h.b").agg(F.count("*").alias("n"))
    return (
        seen.where("n > 1").join(total.where(F.col("pages") >= least_pages), "host")
        .where(F.col("n") * 100 > F.col("pages") * percent)
        .select("host", "a", "b")
    )


def dedup(pages: DataFrame, host: str, lines: str | Column, percent: int = RATIO_PERCENT, least_pages: int = LEAST_PAGES, into: str = "kept", copies_once: bool = False) -> DataFrame:
    """``pages`` and an array column ``into`` (replaced if there) of the lines that are not boilerplate, in order."""
    array = F.col(lines) if isinstance(lines, str) else lines
    page = pages.select(
        F.struct(*(pages[c] for c in pages.columns if c != into)).alias("page"), F.col(host).alias("host_name"), array.alias("lines")
    )
    bad = cut(boilerplate(page, "host_name", "lines", percent, least_pages, copies_once))
    # a line on so large a share of a host's pages has few others like it: 100 / percent times a page's lines in all
    per_host = bad.groupBy("host").agg(F.collect_list(F.struct("a", "b")).alias("bad"))
    none = F.array().cast("array<struct<a:bigint,b:int>>")
    page = page.withColumn("host", F.coalesce(F.xxhash64("host_name"), F.lit(0)))
    if bad.count() <= BROADCAST_LINES:
        joined = page.join(F.broadcast(per_host), "host", "left")
    else:
        salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
        page = page.withColumn("salt", F.pmod(F.xxhash64("lines"), F.lit(SALTS)))
        joined = page.join(per_host.select("host", "bad", salts.alias("salt")), ["host", "salt"], "left")
    kept = F.filter("lines", lambda x: ~F.array_contains(F.coalesce("bad", none), _hashed(x)))
    return joined.select("page", kept.alias("kept")).select("page.*", F.col("kept").alias(into))
