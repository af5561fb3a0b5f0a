"""Bounded-depth crawl of the captured link graph.

A URL is visited when it is admitted (scope, media and exclude rules) and within the depth limit; its links are
followed from the least depth at which it can be reached. Links found in script files start again at depth 0.

Two bucketed tables carry the crawl. Edges are extracted once and lie in buckets by the page that holds them; visited
URLs lie in buckets by their key and grow by one partition a round. So a round moves only what the last one found: the
frontier goes to the edges' buckets (or to all of them, while it is small), what is reached goes to the visited URLs'
buckets, and neither table is shuffled. Every round's finds are written: plans stay short, a lost executor does not start
the crawl again, and the size of the frontier is known when the next join is planned.

A page with very many links would be one large bucket. Its edges are dealt over several parts of the key, and the frontier
row of such a page goes to each part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions.urls import resolve_url
from webloom.operators.dedup import union_all
from webloom.operators.extract import link_file_exts, script_link_is_file
from webloom.operators.filters import admitted
from webloom.plans.checkpoints import BucketedTable, written
from webloom.plans.discoveries import LINK, SCRIPT, SCRIPT_LINK

KEY = ["input", "url", "link_file"]
#: A page with more links than this has them dealt over several buckets.
HOT_PAGE = 200_000


def link_edges(finds: DataFrame, exts: Sequence[str] = ("js",)) -> DataFrame:
    """Edges of the link graph, from :func:`page_finds` rows: ``from_url, to_url, kind, raw, link_file``.

    ``kind`` is ``href`` or ``script`` for what a page links to, ``script_link`` for a link in a script file and
    ``sibling`` for the plain twin of a minified file. A script link keeps its text in ``raw``: it is also followed on
    the root of whichever site is crawled.
    """
    step, own = F.col("step"), F.col("own")
    links = finds.filter(step.isin(LINK, SCRIPT, SCRIPT_LINK))
    kind = F.when(step == LINK, "href").when(step == SCRIPT, "script").otherwise("script_link")
    own_file = script_link_is_file(own, F.lit(False), link_file_exts(exts))
    edge = F.struct(own.alias("to_url"), kind.alias("kind"), F.when(step == SCRIPT_LINK, F.col("raw")).alias("raw"),
                    ((step == SCRIPT) | ((step == SCRIPT_LINK) & own_file)).alias("link_file"))
    minified = (step == SCRIPT_LINK) & own_file & own.contains(".min.js")
    twin = F.struct(F.when(minified, F.replace(own, F.lit(".min.js"), F.lit(".js"))).alias("to_url"),
                    F.lit("sibling").alias("kind"), F.lit(None).cast("string").alias("raw"),
                    F.lit(True).alias("link_file"))
    return links.select(F.col("url").alias("from_url"), F.inline(F.array(edge, twin))).filter("to_url IS NOT NULL")


RESTART = ["script_link", "sibling"]


def _targets(hop: DataFrame, exts: Sequence[str]) -> DataFrame:
    """Where the edges of a round lead: ``url, link_file`` in place of ``to_url, raw``.

    A script link leads to its URL on the script's own address and, where different, to that on the crawled site. Only
    script links are resolved: for all others the base is null, and nothing is computed from it.
    """
    kept = [c for c in hop.columns if c not in ("to_url", "raw", "link_file", "page_link_file")]
    based = hop.withColumn("_site", F.when(F.col("kind") == "script_link", F.col("input")))
    both = resolve_url(based, "_site", "raw", "_alt")
    other = F.when(F.col("_alt") != F.col("to_url"), F.col("_alt"))
    options = F.array(
        F.struct(F.col("to_url").alias("url"), F.col("page_link_file").alias("link_file")),
        F.struct(other.alias("url"), script_link_is_file(F.col("_alt"), F.lit(True), exts).alias("link_file")),
    )
    return both.select(*kept, F.inline(options)).filter("url != ''")


def _complete(edges: DataFrame) -> DataFrame:
    """Edges with all columns; plain pairs count as page links."""
    defaults = {"kind": F.lit("href"), "raw": F.lit(None).cast("string"), "link_file": F.lit(False)}
    edges = edges.withColumns({n: c for n, c in defaults.items() if n not in edges.columns})
    return edges.select("from_url", "to_url", "kind", "raw", F.col("link_file").alias("page_link_file"))


class LinkGraph:
    """The edges in buckets by ``from_url``; with pages of very many links, by ``from_url`` and ``part``."""

    def __init__(self, edges: DataFrame, buckets: int, hot_page: int):
        spark = edges.sparkSession
        unique = _complete(edges).distinct()  # combines before it is shuffled: captures of a page repeat its links
        self.table = BucketedTable(spark, "edges", ["from_url"], buckets)
        self.table.append(unique)
        degrees = self.table.rows().groupBy("from_url").agg(F.count(F.lit(1)).alias("links"))
        hot = written(degrees.filter(F.col("links") > hot_page).select(
            "from_url", F.ceil(F.col("links") / hot_page).cast("int").alias("parts")), "hot-pages")
        self.hot = None if hot.isEmpty() else hot
        if self.hot is not None:
            dealt = BucketedTable(spark, "edges", ["from_url", "part"], buckets)
            place = F.pmod(F.xxhash64("to_url", "kind", "raw", "page_link_file"), F.coalesce("parts", F.lit(1)))
            dealt.append(self.table.rows().join(hot, "from_url", "left").withColumn("part", place.cast("int")).drop("parts"))
            self.table.forget()
            self.table = dealt

    def hop(self, frontier: DataFrame) -> DataFrame:
        """The edges that leave a frontier; its ``url`` becomes ``from_url``."""
        asked = frontier.withColumnRenamed("url", "from_url")
        if self.hot is None:
            return asked.join(self.table.rows(), "from_url", "inner")
        parts = F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)
        asked = asked.join(self.hot, "from_url", "left").withColumn("part", F.explode(parts)).drop("parts")
        return asked.join(self.table.rows(), ["from_url", "part"], "inner").drop("part")


class Crawl:
    """A crawl in progress: :meth:`start`, then :meth:`round` until it finds nothing."""

    def __init__(
        self, edges: DataFrame, max_depth: int, include: str | None, exclude: str | None, exts: Sequence[str],
        buckets: int | None = None, hot_page: int = HOT_PAGE,
    ):
        spark = edges.sparkSession
        # As many buckets as a shuffle has partitions, so that a shuffle by the same key meets them as they lie.
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.has_script_links = "raw" in edges.columns
        self.max_depth, self.include, self.exclude, self.exts = max_depth, include, exclude, exts
        self.graph = LinkGraph(edges, buckets, hot_page)
        self.visited = BucketedTable(spark, "visited", KEY, buckets, partition="level")
        self.level = 0

    def _admitted(self, urls: DataFrame) -> DataFrame:
        return urls.filter(admitted(F.col("url"), F.col("host"), self.include, self.exclude))

    def _nearest(self, urls: DataFrame) -> DataFrame:
        """One row per key; the host belongs to the site, so any row has it."""
        return self._admitted(urls).groupBy(*KEY).agg(F.min("host").alias("host"), F.min("depth").alias("depth"))

    def _keep(self, rows: DataFrame) -> int:
        return self.visited.append(rows.select(*KEY, "host", "depth", F.lit(self.level).alias("level")))

    def start(self, roots: DataFrame) -> int:
        if "link_file" not in roots.columns:
            roots = roots.withColumn("link_file", F.lit(False))
        return self._keep(self._nearest(roots.select(*KEY, "host").withColumn("depth", F.lit(0))))

    def reached(self) -> DataFrame:
        """URLs that the last round's finds lead to, each at its least depth, whether known or not."""
        frontier = self.visited.rows().filter(F.col("level") == self.level).drop("level")
        hop = self.graph.hop(frontier)
        restart = F.col("kind").isin(RESTART)
        within = F.col("depth") < self.max_depth if self.max_depth > 0 else F.lit(True)
        followed = hop.filter(restart | (~F.col("link_file") & within))
        if self.has_script_links:
            targets = _targets(followed, self.exts)
        else:
            targets = followed.drop("link_file").withColumnsRenamed({"to_url": "url", "page_link_file": "link_file"})
        depth = F.when(restart, F.lit(0)).otherwise(F.col("depth") + 1)
        return self._nearest(targets.select(*KEY, "host", depth.alias("depth")))

    def better(self) -> DataFrame:
        """Of these, the ones that are new, or nearer than they were known to be."""
        nearest, known = self.reached(), self.visited.rows().select(*KEY, F.col("depth").alias("known_depth"))
        not_nearer = [nearest[k] == known[k] for k in KEY] + [known["known_depth"] <= nearest["depth"]]
        return nearest.join(known, not_nearer, "left_anti")

    def round(self) -> int:
        found = self.better()
        self.level += 1
        return self._keep(found)

    def result(self) -> DataFrame:
        best = F.min(F.struct("depth", "level"))
        return self.visited.rows().groupBy(*KEY).agg(F.min("host").alias("host"), best.alias("b")).select(
            *KEY, "host", F.col("b.depth").alias("depth"), F.col("b.level").alias("level"))

    def forget(self) -> None:
        """Take the tables out of the catalog."""
        self.graph.table.forget()
        self.visited.forget()


def crawl(
    edges: DataFrame, roots: DataFrame, max_depth: int = 1, include: str | None = None, exclude: str | None = None,
    exts: Sequence[str] = ("js",), buckets: int | None = None, hot_page: int = HOT_PAGE,
) -> DataFrame:
    """Visited URLs ``input, url, link_file, host, depth, level`` from ``roots(input, host, url[, link_file])``.

    ``edges`` has at least ``from_url, to_url``; see :func:`link_edges` for the rest. ``max_depth`` 0 means no limit.
    ``level`` is the round in which the least depth was found. A URL reached both as a page and as a link file has a
    row for each. ``buckets`` is the number of buckets of both tables (default: the shuffle partitions), ``hot_page``
    the number of links from which a page's edges are dealt over several buckets.
    """
    walk = Crawl(edges, max_depth, include, exclude, exts, buckets, hot_page)
    try:
        found = walk.start(roots)
        while found > 0:
            found = walk.round()
        return written(walk.result(), "crawl")
    finally:
        walk.forget()


def crawl_depth(edges: DataFrame, roots: DataFrame, max_depth: int = 1, **scope) -> DataFrame:
    """Least depth per site and URL."""
    seen = crawl(edges, roots, max_depth, **scope)
    return seen.groupBy("input", "url").agg(F.min("depth").alias("depth"))


def crawl_roots(seeds: DataFrame, *lists: DataFrame) -> DataFrame:
    """Depth-0 roots: the seed sites and the URLs that sitemaps, robots files and archives list for them.

    Each list has ``input`` and ``url``.
    """
    start = seeds.select(F.col("site").alias("input"), F.col("host"), F.col("site").alias("url"))
    frames = [start]
    for urls in lists:
        hosts = seeds.select(F.col("site").alias("input"), "host").distinct()
        frames.append(urls.select("input", "url").join(hosts, "input", "inner").select("input", "host", "url"))
    return union_all(*frames).distinct()
