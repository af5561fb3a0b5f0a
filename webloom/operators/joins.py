"""Joins: the lookups that turn captured responses into crawl results.

No join here names a broadcast side: sizes are not known beforehand, so the choice is left to the optimiser, which
checks them against its threshold and splits skewed partitions at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.urls import url_key
from webloom.operators.dedup import first_wins
from webloom.operators.filters import checkable


def join_frontier_pages(
    frontier: DataFrame, captures: DataFrame, by: str = "url", at: str | None = None, time: str = "captured_at",
    capture_id: str = "page_id",
) -> DataFrame:
    """The fetch: each URL to visit with one captured response; error statuses are no captures.

    It is the latest capture, or with ``at`` the latest at or before that time; captures without a time come before all
    others. Among equal times the greatest ``capture_id`` wins, then the greatest status. Both columns may be missing.
    A URL is fetched once for each row of the frontier.

    The choice is made on these narrow columns, for frontier URLs only; a body moves once, to the URL it was chosen for.
    Captures that agree in all of them are copies of each other: only these are compared by their bodies, and the least
    one stays.
    """
    status = F.coalesce("status", F.lit(200))
    usable = captures.withColumn("status", status).filter((F.col("status") >= 100) & (F.col("status") < 400))
    order = [c for c in (time, capture_id) if c in captures.columns] + ["status"]
    if at is not None:
        if time not in captures.columns:
            raise ValueError(f"captures have no column {time}")
        usable = usable.filter(F.col(time).isNull() | (F.col(time) <= F.lit(at)))
    asked = frontier.select(by).distinct()
    places = usable.select(by, F.struct(*order).alias("_place")).join(asked, by, "left_semi")
    counted = places.groupBy(by, "_place").agg(F.count(F.lit(1)).alias("_copies"))
    chosen = counted.groupBy(by).agg(F.max(F.struct("_place", "_copies")).alias("_best")).select(
        F.col(by).alias("_by"), "_best._place", "_best._copies")
    same = [F.col(by) == F.col("_by")] + [F.col(c).eqNullSafe(F.col(f"_place.{c}")) for c in order]
    found = usable.join(chosen, same, "inner").drop("_by", "_place")
    single = found.filter("_copies = 1").drop("_copies")
    rest = [c for c in usable.columns if c != by]
    copies = found.filter("_copies > 1").groupBy(by).agg(F.min(F.struct(*rest)).alias("_least")).select(by, "_least.*")
    return frontier.join(single.unionByName(copies), by, "inner")


def join_unvisited(frontier: DataFrame, visited: DataFrame, by: str = "url") -> DataFrame:
    return frontier.join(visited.select(by), by, "left_anti")


def join_status_check(records: DataFrame, status_log: DataFrame, time: str = "observed_at") -> DataFrame:
    """Fill a missing status from observations ``url, method, status[, observed_at]``: the latest by HEAD, else the latest
    by GET. Only for types that are checked.

    Observations without a time come before all others; among equal times the greatest status counts. An observation
    without a status says nothing.
    """
    when = F.col(time) if time in status_log.columns else F.lit(None).cast("string")
    seen = status_log.filter("status IS NOT NULL").groupBy(F.col("url").alias("_u")).agg(*[
        F.max(F.when(F.col("method") == method, F.struct(when.alias("time"), F.col("status").alias("status")))).alias(name)
        for method, name in (("HEAD", "_head"), ("GET", "_get"))
    ])
    joined = records.join(seen, records["url"] == seen["_u"], "left")
    looked_up = F.when(checkable(F.col("type")), F.coalesce("_head.status", "_get.status"))
    return joined.withColumn("status", F.coalesce("status", looked_up)).drop("_u", "_head", "_get")


def join_source_attribution(urls: DataFrame, sources: DataFrame) -> DataFrame:
    """Source that first produced each URL; ``body`` when unknown, ``linkfinder`` when that came by a link file."""
    first = first_wins(
        sources.select(url_key(F.col("url")).alias("_k"), F.col("source").alias("_source"), "rank"),
        [F.col("_k")], ["rank"],
    ).select("_k", "_source")
    joined = urls.join(first, url_key(urls["url"]) == first["_k"], "left").drop("_k")
    found = F.coalesce("_source", F.lit("body"))
    by_file = (found == "body") & F.col("link_file")
    return joined.withColumn("source", F.when(by_file, "linkfinder").otherwise(found)).drop("_source")


def join_sitemap_children(index_children: DataFrame, captures: DataFrame) -> DataFrame:
    """Captured sitemaps that some index lists."""
    listed = index_children.select(F.col("child").alias("url"))
    return captures.join(listed, "url", "left_semi")


#: How much of a host's first label (its end) and of its last label (its start) is part of its key, at most.
LABEL_END, LABEL_START = 4, 2
#: How much of a host without a dot is its key, at most.
PLAIN_START = 4


def _host_key(host: Column) -> Column:
    """From the end of the first label to the start of the last: ``www.example.com`` has ``www.example.co``. A host
    without a dot has its start."""
    first, last = F.instr(host, "."), F.length(host) - F.instr(F.reverse(host), ".") + 1
    head = F.least(first - 1, F.lit(LABEL_END))
    tail = F.least(F.length(host) - last, F.lit(LABEL_START))
    dotted = F.substr(host, first - head, last - first + 1 + head + tail)
    return F.when(first > 0, dotted).otherwise(F.substr(host, F.lit(1), F.lit(PLAIN_START)))


def _offered_keys(url: Column, plain: Column) -> Column:
    """Every key that a host within ``url`` may have, each once.

    For each pair of dots in a run without ``/ ? # @`` between them, the text from up to some characters before the first
    to some behind the second; for one dot, with itself. So there are at most as many as the square of the dots, times a
    constant. Starts of hosts without a dot are offered at every place, if ``plain`` says that there are such hosts.
    """
    def of_run(run: Column) -> Column:
        labels = F.split(run, r"\.", -1)
        # place of each dot: the lengths of the labels before it and of the dots themselves
        sizes = F.transform(labels, F.length)
        dots = F.slice(F.transform(labels, lambda x, i: F.aggregate(
            F.slice(sizes, 1, i + 1), F.lit(0), lambda total, n: total + n + 1)), 1, F.greatest(F.size(labels) - 1, F.lit(0)))

        def pair(first: Column, last: Column) -> Column:
            return F.flatten(F.array(*[F.array(*[
                F.when((first > k) & (last + m <= F.length(run)), F.substr(run, first - k, last - first + 1 + k + m))
                for m in range(LABEL_START + 1)]) for k in range(LABEL_END + 1)]))

        pairs = F.flatten(F.transform(dots, lambda a, i: F.transform(F.slice(dots, i + 1, F.size(dots)), lambda b: pair(a, b))))
        return F.flatten(pairs)

    dotted = F.flatten(F.transform(F.filter(F.split(url, "[/?#@]"), lambda r: r.contains(".")), of_run))
    everywhere = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.length(url), F.lit(1))), lambda i: F.array(*[
        F.when(i + n - 1 <= F.length(url), F.substr(url, i, F.lit(n))) for n in range(1, PLAIN_START + 1)])))
    nothing = F.array().cast("array<string>")
    return F.array_distinct(F.array_compact(F.concat(dotted, F.when(plain, everywhere).otherwise(nothing))))


def join_scope_sites(urls: DataFrame, seeds: DataFrame, col: str = "url", host: str = "host") -> DataFrame:
    """Every pair of URL and seed whose host occurs anywhere in the URL, in one pass over the URLs.

    "Contains" is turned into an equi-join on what lies between the first and the last dot of a host and a little around
    it, and verified. A host has one key; what a URL offers does not grow with the number of hosts. All that is known of
    the seeds beforehand is whether any has no dot. Blank hosts are in no URL.
    """
    named = f"_{host}_key"
    sites = seeds.filter(F.col(host) != "").withColumn(named, _host_key(F.col(host)))
    plain = sites.agg(F.coalesce(F.max(~F.col(host).contains(".")), F.lit(False)).alias("plain")).scalar()
    kept = urls.columns
    spread = urls.select(*kept, F.explode(_offered_keys(F.col(col), plain)).alias("_offer"))
    matches = (spread["_offer"] == sites[named]) & F.contains(spread[col], sites[host])
    return spread.join(sites, matches, "inner").drop("_offer", named)
