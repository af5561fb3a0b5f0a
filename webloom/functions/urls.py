"""URL scalars.

Single-column helpers return a ``Column``. The two many-step ones, :func:`resolve_url` and :func:`normalize_url`, take
a DataFrame and add a column by way of small successive projections, so that each intermediate is computed once inside
generated code; :func:`pin` then keeps the optimiser from copying those steps into every later filter.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache, wraps

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.fixed_values import BLANKS, C0_AND_BLANK, WEB_SCHEMES

SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):"
DOT_SEGMENT = r"(^|/)\.\.?(/|$)"


def strip(c: Column) -> Column:
    """Trim every kind of blank, not the space character only."""
    return F.btrim(c, F.lit(BLANKS))


def url_key(c: Column) -> Column:
    """De-duplication key: lower case, trimmed."""
    return strip(F.lower(c))


def ensure_scheme(c: Column) -> Column:
    return F.when(c.startswith("http://") | c.startswith("https://"), c).otherwise(F.concat(F.lit("https://"), c))


def host_of_url(c: Column) -> Column:
    """Text between the scheme and the first ``/`` or ``?``; a port stays."""
    bare = F.replace(F.replace(c, F.lit("http://"), F.lit("")), F.lit("https://"), F.lit(""))
    return strip(F.substring_index(F.substring_index(bare, "/", 1), "?", 1))


def squeezed(path: Column) -> Column:
    """Runs of slashes made single."""
    return F.when(path.contains("//"), F.regexp_replace(path, "/{2,}", "/")).otherwise(path)


def strip_query(c: Column) -> Column:
    return F.regexp_replace(c, r"\?[^#]*", "")


def tidy(c: Column) -> Column:
    """What a URL parser ignores: leading control characters and blanks, tabs and line breaks anywhere."""
    return F.translate(F.ltrim(c, F.lit(C0_AND_BLANK)), "\t\r\n", "")


def rest_from(c: Column, position: Column) -> Column:
    return F.substr(c, position)


def netloc_of(c: Column) -> Column:
    return F.regexp_extract(c, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)


def path_of(c: Column) -> Column:
    """Path without ``;parameters``."""
    full = F.regexp_extract(c, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    return F.regexp_replace(full, r";[^/]*$", "")


def hostname_of(c: Column) -> Column:
    """Lower-case host: no user, no port; square brackets removed. Empty when the URL names none."""
    hostport = F.substring_index(netloc_of(c), "@", -1)
    return F.lower(F.when(hostport.contains("["), F.regexp_extract(hostport, r"\[([^\]]*)\]", 1))
                   .otherwise(F.substring_index(hostport, ":", 1)))


def registered_domain(c: Column) -> Column:
    """Last two labels of the host (the whole host when it has one); empty when there is none."""
    return F.substring_index(hostname_of(c), ".", -2)


def url_ext(c: Column) -> Column:
    """Extension of the path, with its dot and in its own case; empty when there is none."""
    return F.regexp_extract(F.substring_index(path_of(c), "/", -1), r"^\.*[^.].*?(\.[^.]*)$", 1)


def bare_ext(c: Column) -> Column:
    """Lower-case extension without the dot."""
    return F.lower(F.ltrim(url_ext(c), F.lit(".")))


def percent_decode(c: Column) -> Column:
    """Decode ``%xx``; a plus sign stays a plus sign and a stray percent sign stays as it is."""
    kept = F.replace(c, F.lit("+"), F.lit("%2B"))
    return F.url_decode(F.regexp_replace(kept, r"%(?![0-9A-Fa-f]{2})", "%25"))


def form_encode(c: Column) -> Column:
    """Encode a query value: blank to ``+``, ``~`` kept, ``*`` escaped."""
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def sort_query_params(c: Column) -> Column:
    """Query string with its pairs decoded, ordered by key then value, and encoded again."""
    def decoded(x: Column) -> Column:
        return percent_decode(F.replace(x, F.lit("+"), F.lit(" ")))

    pairs = F.transform(
        F.filter(F.split(c, "&"), lambda p: p != ""),
        lambda p: F.struct(
            decoded(F.substring_index(p, "=", 1)).alias("k"),
            decoded(F.when(p.contains("="), F.substr(p, F.instr(p, "=") + 1)).otherwise("")).alias("v"),
        ),
    )
    return F.array_join(
        F.transform(F.array_sort(pairs), lambda p: F.concat(form_encode(p["k"]), F.lit("="), form_encode(p["v"]))), "&"
    )


def remove_dot_segments(path: Column) -> Column:
    """Walk the segments: ``.`` is skipped, ``..`` takes back one; a trailing one of them leaves a slash."""
    segments = F.split(path, "/")
    walked = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda seen, s: F.when(s == "..", F.slice(seen, F.lit(1), F.greatest(F.size(seen) - 1, F.lit(0))))
        .when(s == ".", seen)
        .otherwise(F.concat(seen, F.array(s))),
    )
    closed = F.when(path.rlike(r"(^|/)\.\.?$"), F.concat(walked, F.array(F.lit("")))).otherwise(walked)
    joined = F.array_join(closed, "/")
    return F.when(joined == "", F.lit("/")).otherwise(joined)


def pin(df: DataFrame, *names: str) -> DataFrame:
    """Compute ``names`` here and once.

    Catalyst moves a filter below the projection it reads from by copying the projected expression into the filter.
    With the multi-step URL columns that copy would be large and evaluated a second time. A filter does not move
    below the generator that produces its input, so passing the values through a one-element ``explode`` stops it.
    """
    kept = [c for c in df.columns if c not in names]
    return df.select(*kept, F.inline(F.array(F.struct(*names))))


def _with_steps(df: DataFrame, steps: dict[str, Column], names: list[str]) -> DataFrame:
    """Add the pinned columns ``names``, the ends of ``steps``. A step may use those before it by name."""
    columns = [c for c in df.columns if c not in names]
    staged = df.select(*columns, *[c.alias(n) for n, c in steps.items()])
    return staged.select(*columns, F.inline(F.array(F.struct(*names))))


def _built_once(steps: Callable[..., dict[str, Column]]) -> Callable[..., dict[str, Column]]:
    """Keep the column trees made for the same names: building one takes hundreds of calls into the JVM."""
    kept = lru_cache(maxsize=128)(lambda context, *names: steps(*names))
    return wraps(steps)(lambda *names: kept(SparkContext._active_spark_context, *names))


def _parts(text: str, p: str) -> dict[str, Column]:
    """Steps that take the tidied URL in column ``text`` apart; their names start with ``p``."""
    def n(name: str) -> Column:
        return F.col(p + name)

    steps = {
        "scheme_raw": F.regexp_extract(text, SCHEME, 1),
        "rest": F.when(n("scheme_raw") != "", rest_from(F.col(text), F.length(n("scheme_raw")) + 2)).otherwise(
            F.col(text)),
        "main": F.substring_index(n("rest"), "#", 1),
        "head": F.substring_index(n("main"), "?", 1),
        "netloc": F.when(n("head").startswith("//"), F.substring_index(rest_from(n("head"), F.lit(3)), "/", 1)).otherwise(
            ""),
        "full": F.when(n("head").startswith("//"), rest_from(n("head"), F.length(n("netloc")) + 3)).otherwise(n("head")),
        "params": F.when(n("full").contains(";"), F.regexp_extract(n("full"), r";([^/]*)$", 1)).otherwise(""),
        "scheme": F.lower(n("scheme_raw")),
        "path": F.when(n("full").contains(";"), F.regexp_replace(n("full"), r";[^/]*$", "")).otherwise(n("full")),
        "query": rest_from(n("main"), F.length(n("head")) + 2),
        "fragment": rest_from(n("rest"), F.length(n("main")) + 2),
    }
    return {p + name: c for name, c in steps.items()}


def url_parts(df: DataFrame, col: str) -> DataFrame:
    """Add scheme, netloc, path, params, query, fragment and hostname of the URL in ``col``."""
    names = ["scheme", "netloc", "path", "params", "query", "fragment"]
    steps = {"_u": tidy(F.col(col)), **_parts("_u", "_p_"), **{n: F.col("_p_" + n) for n in names},
             "hostname": hostname_of(F.col(col))}
    return _with_steps(df, steps, [*names, "hostname"])


def _reassemble(scheme, netloc, path, params, query, fragment) -> Column:
    tail = F.concat(path, F.when(params != "", F.concat(F.lit(";"), params)).otherwise(""))
    rooted = F.when((tail != "") & ~tail.startswith("/"), F.concat(F.lit("/"), tail)).otherwise(tail)
    return F.concat(
        scheme, F.lit("://"), netloc, rooted,
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
        F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(""),
    )


@_built_once
def _resolve_steps(base: str, raw: str, out: str) -> dict[str, Column]:
    c = F.col
    foreign = ((c("_r_scheme") != "") & (c("_r_scheme") != c("_b_scheme"))) | ~c("_b_scheme").isin(WEB_SCHEMES)
    own_place = c("_r_netloc") != ""
    same_page = (c("_r_path") == "") & (c("_r_params") == "")
    broken = c("_r_netloc").contains("[") != c("_r_netloc").contains("]")
    inherits = same_page & ~own_place
    return {
        "_b": tidy(c(base)),
        "_r": tidy(c(raw)),
        **_parts("_b", "_b_"),
        **_parts("_r", "_r_"),
        "_dir": F.when(
            c("_b_path").contains("/"),
            F.left("_b_path", F.length("_b_path") - F.length(F.substring_index("_b_path", "/", -1))),
        ).otherwise("/"),
        "_merged": F.when(c("_r_path").startswith("/"), c("_r_path")).otherwise(squeezed(F.concat("_dir", "_r_path"))),
        "_clean": F.when(
            c("_merged").contains("/.") & c("_merged").rlike(DOT_SEGMENT), remove_dot_segments(c("_merged"))
        ).otherwise(c("_merged")),
        "_path": F.when(own_place, c("_r_path")).when(same_page, c("_b_path")).otherwise(c("_clean")),
        "_whole": _reassemble(
            c("_b_scheme"),
            F.when(own_place, c("_r_netloc")).otherwise(c("_b_netloc")),
            c("_path"),
            F.when(inherits, c("_b_params")).otherwise(c("_r_params")),
            F.when(inherits & (c("_r_query") == ""), c("_b_query")).otherwise(c("_r_query")),
            c("_r_fragment"),
        ),
        out: F.when(c(raw) == "", c(base)).when(c(base) == "", c(raw)).when(broken, F.lit("")).when(foreign, c(raw))
        .otherwise(c("_whole")),
    }


def resolve_url(df: DataFrame, base: str, raw: str, out: str = "url") -> DataFrame:
    """Add ``out``: the link text ``raw`` made absolute on the http(s) URL ``base``.

    Links of another scheme come back as they are; a malformed bracketed host gives the empty string.
    """
    return _with_steps(df, _resolve_steps(base, raw, out), [out])


@_built_once
def _normalize_steps(col: str, out: str) -> dict[str, Column]:
    c = F.col
    default_port = c("_n_netloc").endswith(c("_port")) & (
        F.instr("_n_netloc", ":") + F.length("_port") - 1 == F.length("_n_netloc"))
    return {
        "_u": tidy(c(col)),
        **_parts("_u", "_n_"),
        "_port": F.when(c("_n_scheme") == "https", ":443").when(c("_n_scheme") == "http", ":80"),
        "_host": F.when(default_port, F.substring_index("_n_netloc", ":", 1)).otherwise(c("_n_netloc")),
        "_path": F.when(c("_n_path") == "", "/").otherwise(squeezed(c("_n_path"))),
        "_query": F.when(c("_n_query") != "", sort_query_params(c("_n_query"))).otherwise(""),
        out: F.when(
            (c("_n_netloc") != "") & (c("_n_scheme") != ""),
            _reassemble(c("_n_scheme"), F.lower("_host"), c("_path"), c("_n_params"), c("_query"), F.lit("")),
        ).otherwise(c(col)),
    }


def normalize_url(df: DataFrame, col: str, out: str = "canonical") -> DataFrame:
    """Add ``out``: the canonical form of the absolute URL in ``col``; anything without a host passes through."""
    return _with_steps(df, _normalize_steps(col, out), [out])
