"""SQL building blocks for the comparison queries: plain SQL for another engine, written apart from the Spark code."""

from __future__ import annotations

from webloom.fixed_values import (
    BLACKLISTED_EXTENSIONS, BUCKET_FORMS, CLEAN_TAGS, DNS_LABEL, PROVIDER_LABELS, SCRIPT_LINK, SHOWN_TYPES,
    SOURCE_LABELS, URL_TYPES,
)


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(items) -> str:
    return "(" + ", ".join(quote(x) for x in items) + ")"


def mapped(table: dict[str, str], key: str, default: str) -> str:
    arms = " ".join(f"when {quote(k)} then {quote(v)}" for k, v in table.items())
    return f"(case {key} {arms} else {default} end)"


def with_(*parts: str) -> str:
    return "with recursive " + ",\n".join(parts) + "\n"


SCHEME = "'^([A-Za-z][A-Za-z0-9+.-]*):'"


def host(u: str) -> str:
    return f"lower(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:@]*)', 1))"


def domain(u: str) -> str:
    return f"regexp_extract({host(u)}, '([^.]*[.])?[^.]*$')"


def path(u: str) -> str:
    whole = f"regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"
    return f"regexp_replace({whole}, ';[^/]*$', '')"


def ext(u: str) -> str:
    last = f"regexp_extract({path(u)}, '[^/]*$')"
    return f"regexp_extract({last}, '^[.]*[^.].*?([.][^.]*)$', 1)"


def bare_ext(u: str) -> str:
    return f"lower(ltrim({ext(u)}, '.'))"


def resolved(name: str, source: str, base: str, raw: str, out: str) -> str:
    """A named table: ``source`` with ``raw`` made absolute on ``base``."""
    parts = "(?s)^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(//[^/?#]*)?([^?#]*?)(;[^/?#]*)?([?][^#]*)?(#.*)?$"
    names = "['n', 'p', 'm', 'q', 'f']"
    return f"""{name} as (
      select * exclude (b_, r_, bs_, rs_, bp_, rp_, rel_, segs_, walk_, path_) from (
        select *,
          regexp_replace({base}, '[\\t\\r\\n]', '', 'g') as b_, regexp_replace({raw}, '[\\t\\r\\n]', '', 'g') as r_,
          lower(regexp_extract(b_, {SCHEME}, 1)) as bs_, lower(regexp_extract(r_, {SCHEME}, 1)) as rs_,
          regexp_extract(b_, '{parts}', {names}) as bp_, regexp_extract(r_, '{parts}', {names}) as rp_,
          case when struct_extract(rp_, 'p')[1:1] = '/' then struct_extract(rp_, 'p') else regexp_replace(case when contains(struct_extract(bp_, 'p'), '/')
            then regexp_replace(struct_extract(bp_, 'p'), '[^/]*$', '') else '/' end || struct_extract(rp_, 'p'), '/+', '/', 'g') end as rel_,
          str_split(rel_, '/') as segs_,
          list_reduce(list_transform(segs_, lambda s: [s]), lambda a, s: case when s[1] = '..' then a[1:len(a) - 1]
            when s[1] = '.' then a else a || s end, cast([] as varchar[])) as walk_,
          array_to_string(case when segs_[-1] in ('.', '..') then walk_ || [''] else walk_ end, '/') as path_,
          case when {raw} = '' then {base}
            when rs_ <> '' and rs_ <> bs_ then {raw}
            when length(struct_extract(rp_, 'n')) > 2 then bs_ || ':' || struct_extract(rp_, 'n') || struct_extract(rp_, 'p') || struct_extract(rp_, 'm') || struct_extract(rp_, 'q') || struct_extract(rp_, 'f')
            when struct_extract(rp_, 'p') = '' and struct_extract(rp_, 'm') = '' then bs_ || ':' || struct_extract(bp_, 'n') || struct_extract(bp_, 'p') || struct_extract(bp_, 'm')
              || case when length(struct_extract(rp_, 'q')) > 1 then struct_extract(rp_, 'q') else struct_extract(bp_, 'q') end || struct_extract(rp_, 'f')
            else bs_ || ':' || struct_extract(bp_, 'n') || case when path_[1:1] = '/' then '' else '/' end || path_ || struct_extract(rp_, 'm') || struct_extract(rp_, 'q')
              || struct_extract(rp_, 'f') end as {out}
        from {source}))"""


def sorted_query(q: str) -> str:
    dec = "url_decode(replace({}, '+', ' '))"
    enc = "replace(replace(replace(url_encode({}), '%20', '+'), '*', '%2A'), '%7E', '~')"
    pairs = (f"list_transform(list_filter(str_split({q}, '&'), lambda p: p <> ''), lambda p: "
             f"{{'k': {dec.format('regexp_extract(p, $$^[^=]*$$)')}, "
             f"'v': {dec.format('regexp_extract(p, $$=(.*)$$, 1)')}}})")
    return (f"array_to_string(list_transform(list_sort({pairs}), lambda p: {enc.format('p.k')} || '=' || "
            f"{enc.format('p.v')}), '&')")


def normalized(name: str, source: str, raw: str, out: str) -> str:
    """A named table: ``source`` with the canonical form of ``raw``."""
    parts = "(?s)^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)([?][^#]*)?"
    return f"""{name} as (
      select * exclude (n_, s_, h_, qs_) from (
        select *, regexp_extract({raw}, '{parts}', ['s', 'h', 'p', 'q']) as n_, lower(struct_extract(n_, 's')) as s_,
          regexp_replace(lower(struct_extract(n_, 'h')), case s_ when 'https' then '^([^:]*):443$' else '^([^:]*):80$' end, '\\1') as h_,
          {sorted_query("substr(struct_extract(n_, 'q'), 2)")} as qs_,
          case when struct_extract(n_, 'h') = '' then {raw} else s_ || '://' || h_ || regexp_replace(case struct_extract(n_, 'p') when '' then '/'
            else struct_extract(n_, 'p') end, '/+', '/', 'g') || case when qs_ = '' then '' else '?' || qs_ end end as {out}
        from {source}))"""


def strip_query(u: str) -> str:
    return f"regexp_replace({u}, '[?][^#]*', '', 'g')"


def decoded(t: str) -> str:
    return f"replace(replace(url_decode({t}), '\\u002f', '/'), '\\u0026', '&')"


def clean_name(t: str) -> str:
    return (f"regexp_replace(trim(regexp_replace({t}, '(?i)^(20|25|2b|2f|3d|3a|40)+', ''), '-'), "
            "'^[.](.)', '\\1')")


def clean_subdomain(t: str) -> str:
    return clean_name(f"ltrim(lower(trim({t})), '*.')")


def subdomains(text: str, dom: str) -> str:
    """List of cleaned host names below a domain; the three test domains have patterns of their own."""
    arms = " ".join(
        f"when {quote(d)} then regexp_extract_all({text}, {quote('(?i)(?:' + DNS_LABEL + '[.])+' + d.replace('.', '[.]'))})"
        for d in ("example.com", "example.net", "example.org")
    )
    return first_only(f"list_filter(list_transform(case {dom} {arms} end, lambda s: {clean_subdomain('s')}), "
                      f"lambda s: s <> '' and s <> {dom})")


def first_only(items: str) -> str:
    """A list without repeats, first places kept."""
    return f"list_filter({items}, lambda x, i: list_position({items}, x) = i)"


def buckets(text: str) -> str:
    found = f"regexp_extract_all({text}, {quote('(?i)' + '|'.join(BUCKET_FORMS))})"
    return first_only(f"list_transform({found}, lambda s: {decoded('s')})")


def script_links(text: str) -> str:
    found = f"regexp_extract_all({decoded(text)}, {quote(SCRIPT_LINK)}, 1)"
    return first_only(f"list_filter(list_transform({found}, lambda s: regexp_replace(trim(s), '[\\t\\r\\n]+', ' ', 'g')"
                      "), lambda s: s <> '')")


def tags(html: str) -> str:
    """List of open tags of interest, comments and script and style bodies removed first."""
    bare = (f"regexp_replace({html}, '(?is)<!--.*?-->|(<(?:script|style)\\b[^>]*>).*?</(?:script|style)\\s*>', "
            "'\\1', 'g')")
    return (f"regexp_extract_all({bare}, '(?is)<(?:a|form|input|script|link)(?:\\s(?:[^>\"'']|\"[^\"]*\"|''[^'']*'')*)"
            "?>')")


def attr(tag: str, name: str) -> str:
    def one(rest: str) -> str:
        return f"regexp_extract({tag}, '(?is)\\s{name}\\s*=\\s*{rest}', 1)"

    # an unquoted value cannot start with a quote, so at most one of the three is filled
    return (f"replace(concat({one('\"([^\"]*)\"')}, {one(chr(39) * 2 + '([^' + chr(39) * 2 + ']*)' + chr(39) * 2)}, "
            f"{one('([^\\s\"' + chr(39) * 2 + '>]+)')}), '&amp;', '&')")


def media(u: str) -> str:
    return f"regexp_matches({u}, '(?i)[.](?:{'|'.join(BLACKLISTED_EXTENSIONS)})(?:[?]|#|$)')"


def exploded(name: str, source: str, items: str, item: str, at: str, keep: str = "*") -> str:
    """A named table with one row per list element and its 0-based place."""
    return f"""{name} as (
      select * exclude (l_), unnest(l_) as {item}, cast(generate_subscripts(l_, 1) - 1 as int) as {at}
      from (select {keep}, {items} as l_ from {source}))"""


def is_url_type(t: str) -> str:
    return f"({t} in {values(URL_TYPES)} or starts_with({t}, 'passive-'))"


def host_of_url(u: str) -> str:
    return f"trim(split_part(split_part(replace(replace({u}, 'http://', ''), 'https://', ''), '/', 1), '?', 1))"


def aws_class(u: str) -> str:
    return (f"(case when contains(lower({u}), 's3.amazonaws.com') then 'aws_s3' "
            f"when contains(lower({u}), '.cloudfront.net') then 'aws_cloudfront' end)")


def clean_tag(t: str, u: str) -> str:
    return f"""(case when contains(lower({u}), 's3.amazonaws.com') or contains(lower({u}), 's3-website')
        or (contains(lower({u}), 's3-') and contains(lower({u}), '.amazonaws.com')) then 'AWS S3'
      when contains(lower({u}), '.cloudfront.net') then 'AWS CloudFront'
      when {t} = 'javascript' then case {bare_ext(u)} when 'css' then 'CSS' when 'txt' then 'TEXT' when 'text' then 'TEXT'
        when 'html' then 'HTML' when 'htm' then 'HTML' else 'JAVASCRIPT' end
      else {mapped(CLEAN_TAGS, t, "'URL'")} end)"""


def source_label(s: str, t: str) -> str:
    shown = f"(case when starts_with({t}, 'passive-') then substr({t}, 9) else {s} end)"
    return mapped(SOURCE_LABELS, shown, f"upper({shown})")


def provider_label(p: str) -> str:
    return mapped(PROVIDER_LABELS, p, f"upper({p}[1:1]) || lower({p}[2:])")


def type_label(t: str) -> str:
    return f"(case when {t} in {values(SHOWN_TYPES)} then upper(replace({t}, '-', '_')) end)"


def discoveries(name: str, source: str) -> str:
    """Named tables that end in ``name``: all records of captured pages.

    ``source`` has ``page_id, input, dom, url, html, source, level``; every page is in the scope of its own site.
    """
    n = name
    common = "page_id, input, source, level, url as origin, length(html) as len"
    return ",\n".join([
        f"{n}_base as (select *, {bare_ext('url')} = 'js' as is_js from {source})",
        exploded(f"{n}_sub", f"(select {common}, html as h_, dom from {n}_base)",
                 subdomains("h_", "dom"), "sub", "place", "* exclude (h_)"),
        exploded(f"{n}_aws", f"(select {common}, html as h_ from {n}_base)", buckets("h_"), "bucket", "place",
                 "* exclude (h_)"),
        exploded(f"{n}_lnk", f"(select {common}, html as h_ from {n}_base where is_js)", script_links("h_"), "link",
                 "place", "* exclude (h_)"),
        resolved(f"{n}_own", f"{n}_lnk", "origin", "link", "own"),
        resolved(f"{n}_alt", f"{n}_own", "input", "link", "alt"),
        exploded(f"{n}_tag", f"(select {common}, html as h_ from {n}_base where not is_js)", tags("h_"), "tag", "place",
                 "* exclude (h_)"),
        f"{n}_ref as (select *, {attr('tag', 'href')} as ref from {n}_tag where regexp_matches(tag, '(?i)^<a\\b') "
        f"and {attr('tag', 'href')} <> '')",
        resolved(f"{n}_href", f"{n}_ref", "origin", "ref", "target"),
        f"{n}_sref as (select *, {attr('tag', 'src')} as ref from {n}_tag where regexp_matches(tag, "
        f"'(?i)^<(script|link)\\b') and {attr('tag', 'src')} <> '')",
        resolved(f"{n}_src", f"{n}_sref", "origin", "ref", "target"),
        f"""{n} as (
      select page_id, input, source, 'url' as type, url, 200 as status, length(html) as length, 'page' as seen_set,
        level, 0 as step, url as origin, 0 as pos from {n}_base
      union all select page_id, input, source, 'subdomains', p || sub, null, null, 'sub', level, 1, origin, place * 2 + k
        from {n}_sub, (values ('http://', 0), ('https://', 1)) v(p, k)
      union all select page_id, input, 'body', 'aws-s3', bucket, null, null, 'aws', level, 2, origin, place * 2
        from {n}_aws
      union all select page_id, input, case when {bare_ext('own')} = 'js' then 'javascript' else origin end,
        case when {bare_ext('own')} = 'js' then 'javascript' else 'linkfinder' end, own, null, null,
        case when {bare_ext('own')} = 'js' then 'js' else 'url' end, level, 3, origin, place * 2 from {n}_own
      union all select page_id, input, origin, 'linkfinder', alt, null, null,
        case when {ext('alt')} in ('.js', '.xml', '.json', '.map') then 'js' else 'url' end, level, 3, origin,
        place * 2 + 1 from {n}_alt where alt <> own
      union all select page_id, input, 'body', 'href', target, null, null, 'url', level, 4, origin, place * 2
        from {n}_href where target <> ''
      union all select page_id, input, 'body', 'form', origin, null, null, 'form', level, 5, origin, 0
        from (select distinct page_id, input, level, origin from {n}_tag where regexp_matches(tag, '(?i)^<form\\b')
          and regexp_matches(tag, '(?i)\\saction[\\s=>]'))
      union all select page_id, input, 'body', 'upload-form', origin, null, null, 'form', level, 6, origin, 0
        from (select distinct page_id, input, level, origin from {n}_tag where regexp_matches(tag, '(?i)^<input\\b')
          and {attr('tag', 'type')} = 'file')
      union all select page_id, input, 'body', 'javascript', target, null, null, 'js', level, 7, origin, place * 2
        from {n}_src where {bare_ext('target')} = 'js')""",
    ])
