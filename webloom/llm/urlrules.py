"""URL filters by expression lists, in DataFrame expressions only.

A rule has a host and a path prefix. A URL is expanded into expressions: suffixes of its host, each with prefixes of its
path. Expressions and rules meet in an equi-join on a short prefix of their digest; the full digest confirms a match, and
the longest rule wins. Only different (host, path head) pairs are expanded and judged, so a frequent host costs one row,
and the verdicts are joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import free_name

#: Hexadecimal digits of a digest that the join uses.
SHORT = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case. Path: what follows
    the host up to ``?``, ``#`` or the end. Both are empty for null and for URLs without ``://``."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(url, parts, 1), UPPER, LOWER), F.regexp_extract(url, parts, 2)


def _digest(host: Column, path: Column) -> Column:
    # No host holds a slash and no path is without one at its start, so their concatenation tells them apart.
    return F.sha2(F.concat(host, path), 256)


def judge_urls(df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", keep: list[str] | None = None
               ) -> DataFrame:
    """Append ``host``, ``path``, ``rule`` (host and path of the winning rule, null if none fits) and ``verdict``.

    ``rules`` has ``host``, ``path`` and ``verdict`` (allow or block). A rule fits its host and all subdomains if the
    URL's path starts with the rule's. The longest rule wins, then the longer host, then block. Rules with a null in any
    column are ignored, repeated rules count once. A URL that no rule fits gets ``default``, and so do null URLs and
    those without a host unless a rule with an empty host fits. With no rules every URL gets ``default``. Columns of
    these names are replaced; all others stay. How often a URL or host occurs does not matter.
    """
    added = ["host", "path", "rule", "verdict"]
    columns = [c for c in (keep or df.columns) if c not in added]
    host, path = host_and_path(F.col(url))
    df = df.withColumns({(h := free_name(df, "url_host")): host, (p := free_name(df, "url_path")): path})
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path"),
                         F.col("verdict").alias("rule_verdict")).where(
        "rule_host is not null and rule_path is not null and rule_verdict is not null").distinct()
    # A rule with k dots in its host can fit only the suffix with k dots, and a path of n characters only a prefix of n:
    # so few expressions are enough, however many dots and slashes a URL has.
    dots = F.length("rule_host") - F.length(F.replace(F.col("rule_host"), F.lit("."), F.lit("")))
    forms = rules.select(dots.alias("dots"), F.length("rule_path").alias("length"))
    dots_used = sorted(r[0] for r in forms.select("dots").distinct().collect())
    lengths_used = sorted(r[0] for r in forms.select("length").distinct().collect())
    if not dots_used:
        return df.select(*columns, F.col(h).alias("host"), F.col(p).alias("path"),
                         F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    head = free_name(df, "url_head")
    df = df.withColumn(head, F.left(F.col(p), F.lit(max(lengths_used))))
    keys = df.select(F.col(h).alias("h"), F.col(head).alias("t")).distinct()
    own_dots = F.length("h") - F.length(F.replace(F.col("h"), F.lit("."), F.lit("")))
    suffixes = F.transform(
        F.filter(F.array(*[F.lit(k) for k in dots_used]), lambda k: k <= own_dots),
        lambda k: F.element_at(F.array(*[F.substring_index("h", ".", -(n + 1)) for n in range(max(dots_used) + 1)]),
                               k + 1))
    prefixes = F.transform(F.filter(F.array(*[F.lit(n) for n in lengths_used]), lambda n: n <= F.length("t")),
                           lambda n: F.left(F.col("t"), n))
    pairs = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda x: _digest(s, x))))
    expressions = keys.withColumn("digest", F.explode(pairs)).withColumn("short", F.left("digest", F.lit(SHORT)))
    listed = rules.withColumn("rule_digest", _digest(F.col("rule_host"), F.col("rule_path"))) \
        .withColumn("short", F.left("rule_digest", F.lit(SHORT)))
    fits = expressions.join(listed, "short").where("digest = rule_digest")
    order = F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("long"), F.length("rule_host").alias("host_long"),
        (F.col("rule_verdict") == "block").alias("block"), F.concat("rule_host", "rule_path").alias("rule"),
        F.col("rule_verdict").alias("verdict"))
    verdicts = fits.groupBy(F.col("h").alias(h), F.col("t").alias(head)).agg(F.max(order).alias(best := free_name(df, "best")))
    out = df.join(verdicts, [h, head], "left")
    return out.select(*columns, F.col(h).alias("host"), F.col(p).alias("path"), F.col(f"{best}.rule").alias("rule"),
                      F.coalesce(F.col(f"{best}.verdict"), F.lit(default)).alias("verdict"))


def rule_table(spark, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")
