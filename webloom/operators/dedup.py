"""First-wins de-duplication, caps and unions.

First-wins is ``min`` over a struct that starts with the order columns, so it combines on the map side: a key that
holds a third of all rows is down to one row per input partition before anything is shuffled. No window collects a
whole key in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.fixed_values import PROVIDERS
from webloom.functions.urls import pin, strip_query, url_key
from webloom.plans.checkpoints import written

RECORD_ORDER = ["level", "step", "origin", "pos"]


def first_wins(rows: DataFrame, key: Sequence[Column], order: Sequence[str]) -> DataFrame:
    """First row of each key in the given order; remaining columns break ties, so the result is fixed."""
    columns = rows.columns
    lead = [c for c in order if c in columns]
    packed = F.struct(*lead, *[c for c in columns if c not in lead])
    keys = [k.alias(f"_key{i}") for i, k in enumerate(key)]
    best = rows.groupBy(*keys).agg(F.min(packed).alias("_first"))
    return best.select(*[F.col(f"_first.{c}").alias(c) for c in columns])


def first_wins_global(records: DataFrame) -> DataFrame:
    """One record per site and URL key, whatever its type."""
    return first_wins(records, [F.col("input"), url_key(F.col("url"))], RECORD_ORDER)


def first_wins_by_set(records: DataFrame) -> DataFrame:
    """One record per site, seen-set and URL: page, subdomain, bucket, script, link and form URLs apart."""
    return first_wins(records, [F.col("input"), F.col("seen_set"), F.lower(F.col("url"))], RECORD_ORDER)


def first_wins_printed(records: DataFrame) -> DataFrame:
    """One record per site and URL: a URL that is a page, a link and an archive entry counts once. Forms are a set of
    their own, since a form's target is usually a page too."""
    own = F.when(F.col("seen_set") == "form", "form").otherwise("url")
    return first_wins(records, [F.col("input"), own, F.lower(F.col("url"))], RECORD_ORDER)


def provider_rank(provider: Column) -> Column:
    return F.array_position(F.array(*[F.lit(p) for p in PROVIDERS]), provider)


def first_wins_provider(urls: DataFrame, scope: Sequence[str] = ("domain",)) -> DataFrame:
    """The first provider, in declared order, keeps a URL that several list."""
    ranked = urls.withColumn("rank", provider_rank(F.col("provider")))
    key = [F.col(c) for c in scope] + [F.lower(F.col("url"))]
    return first_wins(ranked, key, ["rank", "page_no", "part", "pos"]).drop("rank")


def dedup_after_strip(urls: DataFrame, scope: Sequence[str] = ("domain",)) -> DataFrame:
    """Drop query strings, then keep the first of what has become equal."""
    stripped = pin(urls.withColumn("url", strip_query(F.col("url"))), "url")
    return first_wins_provider(stripped, scope)


def ordered_unique(rows: DataFrame, col: str) -> DataFrame:
    """Keep the first of equal elements of an array column, in place."""
    return rows.withColumn(col, F.array_distinct(F.col(col)))


#: Rows of a sample that lie below a threshold, about. Caps up to this need no threshold.
SAMPLED_BELOW = 1_000


def _first_ranked(rows: DataFrame, group: Sequence[str], order: Sequence[str], cap: int) -> DataFrame:
    """By ranking alone: each task cuts its share of a group before the shuffle, what is left meets in one task."""
    within = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(within)).filter(F.col("_n") <= cap).drop("_n")


def group_thresholds(
    rows: DataFrame, group: Sequence[str], order: Sequence[str], cap: int, sampled: int = SAMPLED_BELOW, seed: int = 7,
) -> DataFrame:
    """For each group with many rows, a place in its order with at least ``cap`` rows up to it, and hardly more.

    A sample holds about ``sampled`` of a group's first ``cap`` rows; the sampled row some way behind that is the
    place. All rows up to it are counted, and a place with fewer than ``cap`` is left out, so that a cut there is exact.
    """
    share = min(1.0, sampled / cap)
    wanted = round(share * cap + 6 * (share * cap) ** 0.5) + 1
    drawn = rows.select(*group, F.struct(*order).alias("_place")).filter(F.rand(seed) < share)
    nth = Window.partitionBy(*group).orderBy("_place")
    places = drawn.withColumn("_n", F.row_number().over(nth)).filter(F.col("_n") <= wanted).groupBy(*group).agg(
        F.max("_place").alias("_last"), F.max("_n").alias("_n")).filter(F.col("_n") == wanted).drop("_n")
    # A group's rows are dealt over slices, so that a large group is counted and cut by all tasks.
    below = with_thresholds(rows, places, group, order).filter(F.col("_place") <= F.col("_last"))
    enough = below.groupBy(*group).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") >= cap).drop("_rows")
    return places.join(enough, list(group), "left_semi")


def with_thresholds(rows: DataFrame, places: DataFrame, group: Sequence[str], order: Sequence[str], slices: int = 64
                    ) -> DataFrame:
    """Rows with their place in the order and their group's threshold, if it has one. Both sides are dealt over slices of a
    group, whatever its size."""
    dealt = rows.withColumns({"_place": F.struct(*order), "_slice": F.pmod(F.xxhash64(*order), F.lit(slices)).cast("int")})
    spread = places.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    return dealt.join(spread, [*group, "_slice"], "left").drop("_slice")


def limit_per_group(rows: DataFrame, group: Sequence[str], order: Sequence[str], cap: int, sampled: int = SAMPLED_BELOW
                    ) -> DataFrame:
    """The first ``cap`` rows of every group, exactly. Equal rows in the order are cut anywhere among them.

    With a cap of up to ``sampled``, ranking is enough: every task passes on at most ``cap`` rows of a group. With a larger one, the
    rows of many tasks would still be too many for the one that ranks them; so a threshold is found first, all rows beyond
    it go where they lie, and little more than ``cap`` rows of a group are ranked. The rows are written for that, since
    they are read three times.
    """
    if cap <= sampled:
        return _first_ranked(rows, group, order, cap)
    rows = written(rows, "capped")
    places = written(group_thresholds(rows, group, order, cap, sampled), "thresholds")
    kept = with_thresholds(rows, places, group, order).filter(F.col("_last").isNull() | (F.col("_place") <= F.col("_last")))
    return _first_ranked(kept.drop("_place", "_last"), group, order, cap)


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def new_urls(urls: DataFrame, seen: DataFrame, col: str = "url") -> DataFrame:
    """URLs whose key was not seen before."""
    marked = pin(urls.withColumn("_k", url_key(F.col(col))), "_k")
    known = seen.select(url_key(F.col(col)).alias("_k"))
    return marked.join(known, "_k", "left_anti").drop("_k")
