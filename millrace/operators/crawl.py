"""Breadth-first crawling over stored pages: levels of joins, a visited set as an anti-join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import urls
from millrace.plans.session import materialise


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """src, dst (canonical, repeated ones too) and the position of the link on its page."""
    return pages.select(urls.canonical(F.col(url)).alias("src"), F.posexplode(urls.links(F.col(html), F.col(url))).alias("link_pos", "__dst")).select("src", urls.canonical(F.col("__dst")).alias("dst"), "link_pos")


def allowed(links: DataFrame, column: str, disallowed: Sequence[str] = (), origin: str | None = None) -> DataFrame:
    """Without targets whose path begins with a disallowed one, and, given an origin, without other origins."""
    out = links
    path = F.regexp_replace(F.col(column), "^[a-z][a-z0-9+.-]*://[^/?#]*", "")
    for d in disallowed:
        out = out.where(~path.startswith(d))
    return out.where(urls.origin(F.col(column)) == origin) if origin else out


def in_order(rows: DataFrame, *by: str, after: int = 0, name: str = "rank", tag: str = "ranked") -> DataFrame:
    """rows, written as a table, with their number in an order, from after + 1: ranges are sorted apart and numbered by the sizes of those before them."""
    at = "__at"
    spread = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(at, F.monotonically_increasing_id())
    held = materialise(spread, tag)  # the numbers within a range stay as they were written
    sizes = held.groupBy(F.shiftright(at, 33).cast("int").alias("__range")).agg(F.count(F.lit(1)).alias("__n")).collect()  # one row a range
    before, upto = {}, after
    for r in sorted(sizes):
        before[r["__range"]] = upto
        upto += r["__n"]
    if not before:
        return held.select(*rows.columns, F.lit(0).cast("long").alias(name))
    offsets = F.create_map(*[F.lit(x).cast("long") for pair in before.items() for x in pair])
    return held.select(*rows.columns, (offsets[F.shiftright(at, 33)] + F.col(at).bitwiseAND((1 << 33) - 1) + 1).alias(name))


def crawl(roots: DataFrame, links: DataFrame, max_depth: int = 3, max_pages: int | None = None) -> DataFrame:
    """roots: url. url, depth, rank: every page reached, in the order of a first-in-first-out queue.

    Each level joins the frontier with the links, drops what was seen and numbers the rest range by range. max_pages cuts the order, so levels stop once it is reached."""
    visited = in_order(roots.select("url").distinct(), "url", tag="crawl-level").select("url", F.lit(0).alias("depth"), "rank")
    frontier = visited
    for depth in range(1, max_depth + 1):
        n = visited.count()
        if max_pages is not None and n >= max_pages:
            break
        found = frontier.join(links, frontier["url"] == links["src"]).groupBy("dst").agg(F.min(F.struct("rank", "link_pos")).alias("via"))
        fresh = found.join(visited.select(F.col("url").alias("dst")), "dst", "left_anti")
        named = fresh.select(F.col("dst").alias("url"), F.lit(depth).alias("depth"), "via")
        frontier = in_order(named, "via", "url", after=n, tag="crawl-level").drop("via")
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited.where(F.col("rank") <= max_pages) if max_pages is not None else visited
