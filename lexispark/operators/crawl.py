"""Crawls over stored pages: which addresses a crawl with limits reaches, and how far they are from its start."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.functions.urls import host, references, resolve, without_fragment
from lexispark.scratch import cut


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """The links of pages as distinct rows (source, target), resolved against the page's address, without fragments.

    Only http and https addresses are links. Pages without an address or a text have none.
    """
    found = pages.select(without_fragment(F.col(url)).alias("source"), F.explode(references(F.col(html))).alias("r"))
    return found.select("source", resolve(F.col("source"), F.col("r")).alias("target")).where(
        "source IS NOT NULL AND target RLIKE '(?i)^https?://[^/]'"
    ).distinct()


def crawl(
    starts: DataFrame, links: DataFrame, max_depth: int = 3, max_pages: int = 100, excluded: Column | None = None,
    rows_a_part: int = 100_000
) -> DataFrame:
    """The addresses that a crawl of each start's site visits: (site, url, depth).

    ``starts`` has the column url, ``links`` source and target. A site is a host; a crawl follows links on its own site,
    breadth first, to addresses not visited before, for at most ``max_depth`` hops, and visits at most ``max_pages``
    addresses of a site, of one depth those that come first by address. ``excluded`` is a condition on the column url;
    such addresses are neither visited nor followed, starts included. Null addresses are left out.

    Each level is a join of the frontier with the links and an anti-join with what was visited, and is written before
    the next, so there are as many rounds as hops however many pages there are.
    """
    wanted = F.lit(True) if excluded is None else ~F.coalesce(excluded, F.lit(False))
    edges = links.select(F.col("source"), F.col("target").alias("url")).where(
        "source != url"
    ).withColumn("site", host(F.col("url"))).where((F.col("site") == host(F.col("source"))) & wanted).distinct()
    edges = cut(edges)

    def within(rows: DataFrame, had: DataFrame | None) -> DataFrame:
        """New addresses while their site has room."""
        n = F.row_number().over(Window.partitionBy("site").orderBy("url"))
        if had is None:
            return rows.withColumn("n", n).where(F.col("n") <= max_pages).drop("n")
        sizes = had.groupBy("site").agg(F.count("*").alias("m"))
        numbered = rows.withColumn("n", n).where(F.col("n") <= max_pages).join(sizes, "site", "left")
        return numbered.where(F.col("n") + F.coalesce("m", F.lit(0)) <= max_pages).drop("n", "m")

    first = starts.select(without_fragment(F.col("url")).alias("url")).where("url IS NOT NULL").where(wanted).distinct()
    first = first.withColumn("site", host(F.col("url"))).select("site", "url", F.lit(0).alias("depth"))
    visited = frontier = cut(within(first, None))
    for depth in range(1, max_depth + 1):
        reached = frontier.select(F.col("url").alias("source")).join(edges, "source").select("site", "url").distinct()
        new = reached.join(visited.select("url"), "url", "left_anti").select("site", "url", F.lit(depth).alias("depth"))
        frontier = cut(within(new, visited))
        n = frontier.count()
        if not n:
            break
        visited = cut(visited.unionByName(frontier).coalesce(max(1, (visited.count() + n) // rows_a_part + 1)))
    return visited
