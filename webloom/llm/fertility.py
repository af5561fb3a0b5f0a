"""Quality rules: how well public vocabularies fit a text, besides counts of words, symbols and repetition.

Fertility is measured with two public vocabularies: a byte-level BPE gives characters per token and the entropy of a
text's tokens, a piece BPE with byte fallback gives the share of a text's bytes that it can only write as byte tokens.
Bands per language, or per script where a language has too few texts, reject texts that a vocabulary fits unusually badly
or well.

Every text is measured whole and by itself, in one narrow pass that leaves a small row. The bands are quantiles over all
these rows: what is usual in a language is its median, how far texts lie from it is a high quantile of their distances, and
a text is rejected at several times that. Copies count once there, so that no group of them makes itself the rule. Fixed
outer bands hold besides, and alone where a script has too few texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.bpe import load_bpe
from webloom.llm.common import free_name, map_texts, stored

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
#: Entropy grows with the number of tokens; it is compared as a share of the most that so many tokens can have, and
#: only in texts of so many tokens.
ENTROPY_TOKENS = 64


#: Different texts that a language or script needs for bands of its own.
LEAST_TEXTS = 200
#: A text is rejected at so many times the usual distance, which is this quantile of all distances, as a share of what the
#: quantile is in a normal distribution. Distances of less than ``NEAR`` are never too far: a share of the median for
#: characters per token, absolute for the two shares.
TIMES, QUANTILE, OF_NORMAL = 4.5, 0.9, 1.645
NEAR = 0.05


@dataclass(frozen=True)
class Band:
    """What a text may measure: characters per token, entropy as a share of its most, share of bytes written as byte tokens."""

    chars_low: float
    chars_high: float
    entropy_low: float = 0.40
    entropy_high: float = 1.0
    bytes_high: float = 0.10


#: Outer bands by language, then by script, with room on both sides; the limits of a table's own texts lie within.
LANGUAGE_BANDS = {
    "en": Band(2.1, 7.0, 0.42),
    "de": Band(1.8, 6.0, 0.42),
    "fr": Band(1.8, 6.0, 0.42),
    "es": Band(1.75, 6.0, 0.42),
}
SCRIPT_BANDS = {
    "latin": Band(1.5, 7.0),
    "greek": Band(0.5, 4.0, bytes_high=0.3),
    "cyrillic": Band(0.5, 4.0, bytes_high=0.3),
    "arabic": Band(0.4, 4.0, bytes_high=0.5),
    "hebrew": Band(0.4, 4.0, bytes_high=0.5),
    "devanagari": Band(0.25, 3.0, bytes_high=0.9),
    "cjk": Band(0.3, 3.0, bytes_high=0.9),
    "other": Band(0.2, 8.0, bytes_high=1.0),
}
# Code point ranges of the scripts above, as regular expression classes.
SCRIPT_RANGES = {
    "latin": "A-Za-zÀ-ɏḀ-ỿ",
    "greek": "Ͱ-Ͽἀ-῿",
    "cyrillic": "Ѐ-ԯ",
    "arabic": "؀-ۿݐ-ݿ",
    "hebrew": "֐-׿",
    "devanagari": "ऀ-ॿ",
    "cjk": "぀-ヿ㐀-䶿一-鿿가-힯",
}
_LATIN = re.compile(f"[{SCRIPT_RANGES['latin']}]")
_OTHERS = {k: re.compile(f"[{v}]") for k, v in SCRIPT_RANGES.items() if k != "latin"}
_BEYOND_LATIN = re.compile("[Ͱ-\U0010ffff]+")


def script_of(text: str) -> str:
    """The script of most letters; ties go to the one listed first; ``other`` without any known letter."""
    beyond = "".join(_BEYOND_LATIN.findall(text))
    counts = {"latin": 0} | {k: len(p.findall(beyond)) for k, p in _OTHERS.items()} if beyond else {"latin": 0}
    top = max(counts.values())
    if not top:
        return "latin" if _LATIN.search(text) else "other"
    counts["latin"] = len(_LATIN.findall(text))
    return max(counts, key=counts.get)


def repeated_words(words: list[bytes]) -> int:
    """How many words lie in windows of eight words that occur twice or more, the first ones included.

    Windows get exact numbers by doubling: equal pairs of numbers for 1, 2 and 4 words get equal numbers for 2, 4 and 8.
    """
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    place = dict(zip(words, range(len(words))))
    number = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
    for step in (1, 2, 4):
        kinds, number = np.unique(number[:-step] << 32 | number[step:], return_inverse=True)
        if len(kinds) == len(number):
            return 0
    twice = np.bincount(number)[number] > 1
    edges = np.zeros(len(words) + 1, np.int64)
    edges[:n] += twice
    edges[WINDOW:] -= twice
    return int((np.cumsum(edges[:-1]) > 0).sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """Words, characters in words, symbols, repeated lines, words in repeated windows."""
    words = text.encode().split()  # bytes are split at exactly these six kinds of white space
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    return (len(words), len(text) - sum(map(text.count, WHITE)), sum(map(text.count, SYMBOLS)),
            len(lines) - len(set(lines)), repeated_words(words))


class Fertility:
    def __init__(self, byte_vocabulary: str, piece_vocabulary: str):
        from sentencepiece import SentencePieceProcessor

        self.bpe = load_bpe(byte_vocabulary)
        self.pieces = SentencePieceProcessor(model_file=piece_vocabulary)
        # A piece model writes a character as bytes exactly when the character is no piece of its own.
        pieces = map(self.pieces.id_to_piece, range(self.pieces.get_piece_size()))
        known = {p for p in pieces if len(p) == 1} | set(WHITE)
        self.in_bytes = re.compile(f"[^{''.join(map(re.escape, sorted(known)))}]+")

    def measure(self, texts: list[str]) -> list[tuple]:
        out = []
        for text, ids in zip(texts, self.bpe.encode_texts(texts)):
            in_bytes = sum(len(x.encode()) for x in self.in_bytes.findall(text))
            tokens = np.frombuffer(ids, "<u4")
            n = len(tokens)
            entropy = 0.0
            if n > 1:
                ordered = np.sort(tokens)
                counts = np.diff(np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1], True]))
                entropy = float(np.log2(n) - (counts * np.log2(counts)).sum() / n)
            out.append((
                *base_counts(text), n, len(text) / n if n else 0.0, in_bytes / len(text.encode()) if in_bytes else 0.0, entropy,
                script_of(text),
            ))
        return out


@lru_cache(maxsize=1)
def _fertility(byte_vocabulary: str, piece_vocabulary: str) -> Fertility:
    return Fertility(byte_vocabulary, piece_vocabulary)


MEASURES = [
    ("n_words", "bigint"), ("word_chars", "bigint"), ("n_symbols", "bigint"), ("n_dup_lines", "bigint"),
    ("n_repeat_words", "bigint"), ("n_tokens", "bigint"), ("chars_per_token", "double"),
    ("byte_fallback_share", "double"), ("token_entropy", "double"), ("script", "string"),
]


def quality_rules(
    df: DataFrame, byte_vocabulary: str, piece_vocabulary: str, text: str = "text", language: str | None = "lang",
    keep: list[str] | None = None,
) -> DataFrame:
    """Append base counts, fertility measures, ``base_failed`` and ``kept``.

    Null texts count as empty: no words, ``base_failed``. A null or absent language, or one with fewer than
    ``LEAST_TEXTS`` different texts that pass the base rules, takes the bands of the text's script; a script with as few
    has the fixed outer bands only. Texts of fewer than ``ENTROPY_TOKENS`` tokens are not judged by entropy. Columns of the
    table that have the name of a measure are replaced. Equal rows get equal results; an empty table gives an empty table.
    """
    has_language = language is not None and language in df.columns
    tag = free_name(df, "band_language")
    columns = [c for c in (keep or df.columns) if c not in {n for n, _ in MEASURES}]
    df = df.withColumn(tag, F.lower(F.col(language).cast("string")) if has_language else F.lit(None).cast("string"))
    measured = map_texts(df, text, MEASURES, lambda: _fertility(byte_vocabulary, piece_vocabulary).measure,
                         [*columns, tag])
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    measured = stored(measured.withColumn("base_failed", failed), "measures")
    fit = free_name(measured, "usual")
    return judged(measured, tag, fit).withColumn(
        "kept", ~F.col("base_failed") & fits_band(F.col(tag), F.col("script")) & F.col(fit)).drop(tag, fit)


def _entropy_share() -> Column:
    return F.col("token_entropy") / F.log2(F.greatest(F.col("n_tokens"), F.lit(2)))


def _length_class() -> Column:
    """Entropy as a share of its most falls with the length of a text; it is compared among texts of like length."""
    return F.floor(F.log2(F.greatest(F.col("n_tokens"), F.lit(2)))).cast("int")


def _key(kind: str, value: Column) -> Column:
    return F.concat(F.lit(kind + ":"), value)


def band_limits(measured: DataFrame, language: str, least: int = LEAST_TEXTS) -> tuple[DataFrame, DataFrame]:
    """What is usual in each language and script with enough texts that pass the base rules.

    ``key, chars, chars_far, entropy_far, bytes_most`` and ``key, length_class, entropy``: medians, and usual distances from
    them. A text's characters per token spread less the more tokens it has, so its distance is weighed by their square root.
    """
    usable = measured.where(~F.col("base_failed") & (F.col("n_tokens") > 0)).select(
        F.col(language).alias("language"), "script", "n_words", "word_chars", "n_tokens", "chars_per_token",
        "byte_fallback_share", _entropy_share().alias("share"), _length_class().alias("length_class")).distinct()
    keys = F.array_compact(F.array(_key("language", F.col("language")), _key("script", F.col("script"))))
    rows = stored(usable.select(F.explode(keys).alias("key"), "n_tokens", "chars_per_token", "byte_fallback_share", "share",
                                "length_class"), "usable")
    centre = rows.groupBy("key").agg(F.count(F.lit(1)).alias("texts"), F.percentile_approx("chars_per_token", 0.5).alias("chars"))
    centre = stored(centre.where(F.col("texts") >= least).drop("texts"), "centres")  # written, so that joins know the size
    entropy = rows.groupBy("key", "length_class").agg(F.percentile_approx("share", 0.5).alias("entropy")).join(
        centre.select("key"), "key", "left_semi")
    entropy = stored(entropy, "centres")
    far = rows.join(centre, "key").join(entropy, ["key", "length_class"]).groupBy("key", "chars").agg(
        (F.percentile_approx(F.abs(F.col("chars_per_token") - F.col("chars")) * F.sqrt("n_tokens"), QUANTILE) / OF_NORMAL
         ).alias("chars_far"),
        (F.percentile_approx(F.abs(F.col("share") - F.col("entropy")), QUANTILE) / OF_NORMAL).alias("entropy_far"),
        F.percentile_approx("byte_fallback_share", QUANTILE).alias("bytes_most"))
    return far, entropy


def judged(measured: DataFrame, language: str, out: str, least: int = LEAST_TEXTS) -> DataFrame:
    """Append ``out``: whether a text lies within the limits of its language, else of its script, else true."""
    limits, entropy = (stored(x, "limits") for x in band_limits(measured, language, least))
    limits = limits.withColumnRenamed("key", "limit key")
    own = measured.withColumns({"language key": _key("language", F.col(language)), "script key": _key("script", F.col("script")),
                                "length class": _length_class()})

    def named(prefix: str, by: str) -> DataFrame:
        return limits.select(*[F.col(c).alias(f"{prefix} {c}") for c in limits.columns]).withColumnRenamed(
            f"{prefix} limit key", by)

    both = own.join(named("language", "language key"), "language key", "left").join(named("script", "script key"), "script key", "left")
    by_language = F.col("language chars").isNotNull()
    chosen = {c: F.when(by_language, F.col(f"language {c}")).otherwise(F.col(f"script {c}"))
              for c in ("chars", "chars_far", "entropy_far", "bytes_most")}
    key = F.when(by_language, F.col("language key")).when(F.col("script chars").isNotNull(), F.col("script key"))
    centres = entropy.select(F.col("key").alias("chosen key"), F.col("length_class").alias("length class"),
                             F.col("entropy").alias("usual entropy"))
    whole = both.withColumn("chosen key", key).join(centres, ["chosen key", "length class"], "left")
    chars_off = F.abs(F.col("chars_per_token") - chosen["chars"])
    entropy_off = F.abs(_entropy_share() - F.col("usual entropy"))
    odd = (
        ((chars_off > NEAR * chosen["chars"]) & (chars_off * F.sqrt("n_tokens") > TIMES * chosen["chars_far"]))
        | ((F.col("n_tokens") >= ENTROPY_TOKENS) & (entropy_off > F.greatest(F.lit(NEAR), TIMES * chosen["entropy_far"])))
        | (F.col("byte_fallback_share") > F.greatest(F.lit(NEAR), 2 * chosen["bytes_most"]))
    )
    return whole.withColumn(out, ~F.coalesce(odd, F.lit(False))).select(*measured.columns, out)


def fits_band(language: Column, script: Column) -> Column:
    share = _entropy_share()

    def fits(b: Band) -> Column:
        return (
            F.col("chars_per_token").between(b.chars_low, b.chars_high)
            & (F.col("byte_fallback_share") <= b.bytes_high)
            & ((F.col("n_tokens") < ENTROPY_TOKENS) | share.between(b.entropy_low, b.entropy_high + 1e-9))
        )

    chosen = fits(SCRIPT_BANDS["other"])
    for name, band in SCRIPT_BANDS.items():
        chosen = F.when(script == name, fits(band)).otherwise(chosen)
    for name, band in LANGUAGE_BANDS.items():
        chosen = F.when(F.coalesce(language == name, F.lit(False)), fits(band)).otherwise(chosen)
    return chosen
