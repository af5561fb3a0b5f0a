"""Text clean-up: script text, host names, HTML character references."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.fixed_values import NAME_RESIDUES
from webloom.functions.urls import percent_decode, strip


def decode_chars(c: Column) -> Column:
    """Percent-decode, then turn the JSON spellings of ``/`` and ``&`` back into the characters."""
    slashed = F.replace(percent_decode(c), F.lit("\\u002f"), F.lit("/"))
    return F.replace(slashed, F.lit("\\u0026"), F.lit("&"))


def collapse_newlines(c: Column) -> Column:
    return F.regexp_replace(strip(c), r"[\t\r\n]+", " ")


def clean_name(c: Column) -> Column:
    """Drop percent-code residues in front, hyphens at both ends, and one leading dot of a longer name."""
    bare = F.btrim(F.regexp_replace(c, "(?i)^(?:" + "|".join(NAME_RESIDUES) + ")++", ""), F.lit("-"))
    return F.regexp_replace(bare, r"^\.(?=.)", "")


def clean_subdomain(c: Column) -> Column:
    return clean_name(F.ltrim(F.lower(strip(c)), F.lit("*.")))


def regex_quote(c: Column) -> Column:
    """Escape a text for use inside a pattern."""
    return F.regexp_replace(c, r"([^A-Za-z0-9_])", r"\\$1")


def _windows_points() -> dict[int, int]:
    """What the numeric references 128 to 159 stand for: the Windows code page, where it has a character."""
    out = {}
    for n in range(128, 160):
        try:
            out[n] = ord(bytes([n]).decode("cp1252"))
        except UnicodeDecodeError:
            pass
    return out


#: Names with their semicolon, and the older ones that may stand without it.
CLOSED_NAMES = {n[:-1]: t for n, t in html5.items() if n.endswith(";")}
OPEN_NAMES = {n: t for n, t in html5.items() if not n.endswith(";")}
MARKUP = {"amp": "&", "lt": "<", "gt": ">", "quot": '"'}


def _table(entries: dict, value: str = "string") -> Column:
    """A fixed table as a map; one literal, whatever its size."""
    return F.from_json(F.lit(json.dumps(entries)), f"map<string,{value}>")


def unescape_html(c: Column) -> Column:
    """Decode the character references of an HTML attribute value in one pass, as a browser does.

    Numeric ones need no semicolon; 128 to 159 mean the Windows code page, and what is no character becomes U+FFFD. Names
    with a semicolon are looked up among all of HTML's. The older ones may do without, unless a letter, digit or ``=``
    follows. Everything else stays as it is.
    """
    closed, opened = _table(CLOSED_NAMES), _table(OPEN_NAMES)
    windows, markup = _table(_windows_points(), "bigint"), _table(MARKUP)
    reference = r"^(#[xX][0-9a-fA-F]+;?|#[0-9]+;?|[A-Za-z][A-Za-z0-9]*+;|[A-Za-z][A-Za-z0-9]*+(?!=))"

    def glyph_of(ref: Column) -> Column:
        name = F.rtrim(ref, F.lit(";"))
        hexed = F.lower(name).startswith("#x")
        digits = F.when(hexed, F.substr(name, F.lit(3))).otherwise(F.substr(name, F.lit(2)))
        # No code point has more than seven digits; longer references are not converted at all.
        short = F.ltrim(digits, F.lit("0"))
        short = F.when(F.length(short).between(1, 7), short).otherwise("0")
        number = F.when(hexed, F.conv(short, 16, 10)).otherwise(F.conv(short, 10, 10)).cast("long")
        point = F.coalesce(F.element_at(windows, number.cast("string")), number)
        valid = point.between(1, 0xD7FF) | point.between(0xE000, 0x10FFFF)
        packed = F.unhex(F.lpad(F.hex(point), 8, "0"))
        numeric = F.when(valid, F.decode(packed, "UTF-32")).otherwise("\ufffd")
        # the four of markup are nearly all there are, and the other tables are long
        rest = F.when(ref.endswith(";"), F.element_at(closed, name)).otherwise(F.element_at(opened, name))
        named = F.coalesce(F.element_at(markup, name), rest)
        return F.when(ref.startswith("#"), numeric).when(ref != "", named)

    def decoded(piece: Column) -> Column:
        found = F.array(F.regexp_extract(piece, reference, 1))  # one element, so that the reference is looked for once
        return F.element_at(F.transform(found, lambda ref: F.coalesce(
            F.concat(glyph_of(ref), F.substr(piece, F.length(ref) + 1)), F.concat(F.lit("&"), piece))), 1)

    pieces = F.split(c, "&")
    done = F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(decoded(p)))
    return F.when(c.contains("&"), F.array_join(done, "")).otherwise(c)
