"""Personal data by weak supervision, in DataFrame expressions only.

Patterns propose spans. Labelers vote on each span: the format's own check, gazetteers, the words before it, and the
characters around it; a labeler may abstain. Expectation-maximisation over the counts of vote patterns estimates how far
each labeler is right for each kind of span. The posteriors train a span classifier on what the span and its surroundings
look like. Spans that pass a base format's check always stay; the classifier decides on the other kinds.

Fitting and marking each read the texts once, without a shuffle of texts. What is shuffled are counts of patterns, whose
number is bounded by the numbers of kinds, votes and feature values.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import free_name, stored, text_of

# The base formats. Repeats are possessive and starts are guarded so that matching is linear; both leave
# the leftmost matches as they are.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = ["email", "ip", "card", "phone"]
# Further kinds that only the classifier can let through.
AT = r"(?:\((?:at|AT)\)|\[(?:at|AT)\])"
DOT = r"(?:\((?:dot|DOT)\)|\[(?:dot|DOT)\]|\.)"
MASKED_EMAIL = rf"[A-Za-z0-9._%+-]{{1,64}}+ ?{AT} ?[A-Za-z0-9-]{{1,63}}+(?: ?{DOT} ?[A-Za-z0-9-]{{1,63}}+){{1,8}}+"
LOCAL_PHONE = (r"(?<!\+[0-9]{1,3}[\x20.-])(?:\([0-9]{3}\)|(?<![0-9+(])[0-9]{3})[\x20.-][0-9]{3}[\x20.-][0-9]{4}"
               r"(?![0-9])")
TITLES = "Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora"
FIRST_NAMES = """James Mary John Patricia Robert Jennifer Michael Linda William Elizabeth David Barbara Thomas Susan
Maria Anna Hans Peter Klaus Ursula Jürgen Sabine Pierre Jean Marie Claire Luc Sophie José Juan Carmen Carlos Lucía
Pedro""".split()
NAME = rf"\b(?:(?:{TITLES})\.?|{'|'.join(FIRST_NAMES)})\x20\p{{Lu}}\p{{Ll}}{{1,30}}+(?:\x20\p{{Lu}}\p{{Ll}}{{1,30}}+)?"
# A run of key characters that holds a digit and is long; it can only start where such a run starts.
KEY = "A-Za-z0-9+/_-"
SECRET = rf"(?<![{KEY}])(?=[A-Za-z+/_-]*+[0-9])[{KEY}]{{20,}}+={{0,2}}+"
TOP_DOMAINS = "com|org|net|edu|gov|mil|int|info|io|de|fr|es|uk|eu|at|ch|it|nl|pl|us|ca|br|mx|ar|jp|cn|in|au"
DIAL_CODES = "1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-9][0-9]|35[0-9]|37[0-9]|38[0-9]|42[0-9]"
CUES = {
    "email": "mail|contact|write|e-mail|schreib|contacter|correo",
    "ip": r"\bip\b|address|server|host|adresse|dirección",
    "card": "card|visa|credit|pay|karte|carte|tarjeta",
    "phone": r"\btel\b|phone|call|mobile|fax|ruf|téléphone|teléfono",
    "masked_email": "mail|contact|write|correo",
    "local_phone": r"\btel\b|phone|call|mobile|fax|ruf|téléphone|teléfono",
    "name": "name|by|from|dear|von|par|por",
    "secret": r"token|key|passw|pwd|secret|credential|bearer|auth",
}
AGAINST = r"version|\bv\b|build|isbn|order|serial|invoice|section|figure"

PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "masked_email": MASKED_EMAIL,
            "local_phone": LOCAL_PHONE, "name": NAME, "secret": SECRET}
#: Cheap tests that hold wherever a pattern matches.
MAY_HOLD = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"),
    "phone": lambda t: t.rlike(r"\+[0-9]"),
    "masked_email": lambda t: t.rlike(r"[(\[](?:at|AT)[)\]]"),
    "local_phone": lambda t: t.rlike(r"[0-9]{3}[\x20.-][0-9]{4}"),
    "name": lambda t: t.rlike(rf"\b(?:{TITLES}|{'|'.join(FIRST_NAMES)})\b"),
    "secret": lambda t: t.rlike(rf"(?<![{KEY}])(?=[A-Za-z+/_-]*+[0-9])[{KEY}]{{20}}"),
}
KINDS = list(PATTERNS)
VOTERS = ["format", "gazetteer", "context", "border"]
FEATURES = ["size", "digits", "before", "after"]
ROUNDS = 12
#: Pseudo-counts of the labelers' accuracies: right four times in five.
RIGHT, WRONG = 8.0, 2.0


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _format_vote(kind: str, s: Column) -> Column:
    """The base formats' own checks. A secret is all hexadecimal, or has small and capital letters and digits; the other
    kinds have no check."""
    if kind == "ip":
        return ~F.exists(F.split(s, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))).cast("int") > 3) & ~F.exists(
            F.split(s, r"\."), lambda p: F.coalesce(F.right(p, F.lit(3)).cast("int"), F.lit(0)) > 255)
    if kind == "card":
        return F.length(_digits(s)).between(12, 19) & F.call_function("luhn_check", _digits(s))
    if kind == "phone":
        return F.length(_digits(s)).between(9, 15)
    if kind == "secret":
        return s.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$") | (s.rlike("[0-9]") & s.rlike("[a-z]") & s.rlike("[A-Z]"))
    return F.lit(True)


def _gazetteer_vote(kind: str, s: Column) -> Column:
    if kind in ("email", "masked_email"):
        return F.lower(s).rlike(rf"[.)\]] ?(?:{TOP_DOMAINS})$")
    if kind == "ip":
        first = F.element_at(F.split(s, r"\."), 1)
        return F.length(first).between(1, 3) & F.coalesce(F.right(first, F.lit(3)).cast("int").between(1, 223),
                                                         F.lit(False))
    if kind == "card":
        return _digits(s).rlike("^(?:3[4-7][0-9]{12,13}|4[0-9]{12,18}|5[0-9]{15}|2[2-7][0-9]{14}|6[0-9]{11,18})$")
    if kind == "phone":
        return _digits(s).rlike(f"^(?:{DIAL_CODES})")
    if kind == "local_phone":
        return _digits(s).rlike("^[2-9]")
    if kind == "secret":  # lengths of digests in hexadecimal, and prefixes that issuers give their keys
        return s.rlike("^(?:[0-9A-Fa-f]{32}|[0-9A-Fa-f]{40}|[0-9A-Fa-f]{56}|[0-9A-Fa-f]{64}|[0-9A-Fa-f]{128})$") | s.rlike(
            "^(?:AKIA|ASIA|AIza|gh[pousr]_|glpat-|sk[-_]|xox[abp]-|eyJ)")
    return s.rlike(rf"^(?:{'|'.join(FIRST_NAMES)})\b|\x20(?:{'|'.join(FIRST_NAMES)})\b")


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Running sums and greatest values go block by block, so that no array grows element by element.
BLOCK = 128


def _running(values: Column, start: int, step) -> Column:
    """For each element what ``step`` makes of all elements before it, from ``start``."""
    def over(x: Column) -> Column:
        return F.aggregate(x, F.lit(start), step)

    def by_blocks(blocks: Column) -> Column:
        def inside(heads: Column) -> Column:
            return F.flatten(F.zip_with(blocks, heads, lambda block, head: F.transform(
                block, lambda x, j: step(head, over(F.slice(block, F.lit(1), j))))))

        return _bound(F.transform(blocks, over), lambda sums: _bound(
            F.transform(sums, lambda x, i: over(F.slice(sums, F.lit(1), i))), inside))

    def of(v: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int"))
        blocks = F.transform(numbers, lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK)))
        return F.when(F.size(v) > 0, _bound(blocks, by_blocks)).otherwise(F.array().cast("array<int>"))

    return _bound(values, of)


def _spans(text: Column, kind: str) -> Column:
    """Spans of one kind: start, end (code points, end exclusive), the matched text and what stands on both sides.

    Matches and the pieces between them alternate, so lengths add up to places.
    """
    matches, gaps = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)), F.split(text, PATTERNS[kind], -1)

    def placed(m: Column, g: Column) -> Column:
        after = F.transform(F.slice(g, F.lit(2), F.size(m)), lambda x: F.left(x, F.lit(1)))
        parts = F.zip_with(F.zip_with(m, F.slice(g, F.lit(1), F.size(m)), lambda x, y: F.struct(x.alias("m"), y.alias("g"))),
                           after, lambda x, y: F.struct(x["m"].alias("m"), x["g"].alias("g"), y.alias("after")))

        def joined(both: Column) -> Column:
            lengths = F.transform(both, lambda x: F.length(x["g"]) + F.length(x["m"]))
            return F.zip_with(both, _running(lengths, 0, lambda x, y: x + y), lambda x, at: F.struct(
                (at + F.length(x["g"])).alias("start"), (at + F.length(x["g"]) + F.length(x["m"])).alias("end"),
                x["m"].alias("found"), F.right(x["g"], F.lit(24)).alias("before"), x["after"].alias("after")))

        return _bound(parts, joined)

    return _bound(matches, lambda m: _bound(gaps, lambda g: placed(m, g)))


def _side(c: Column) -> Column:
    """What kind of character stands beside a span."""
    return (F.when(F.length(c) == 0, 0).when(c.rlike(r"[\p{L}\p{N}_]"), 1).when(c.rlike(r"\s"), 2).otherwise(3))


def _voted(kind: str, span: Column) -> Column:
    s, last, nxt = span["found"], F.right(span["before"], F.lit(1)), span["after"]
    cue = F.lower(span["before"])
    size = F.length(s)
    fields = {
        "start": span["start"], "end": span["end"],
        "format": F.coalesce(_format_vote(kind, s), F.lit(False)).cast("int"),
        "gazetteer": _gazetteer_vote(kind, s).cast("int"),
        "context": F.when(cue.rlike(CUES[kind]), 1).when(cue.rlike(AGAINST), 0).otherwise(-1),
        "border": (~last.rlike(r"[\p{L}\p{N}_]") & ~nxt.rlike(r"[\p{L}\p{N}_]")).cast("int"),
        "size": F.when(size <= 9, 0).when(size <= 13, 1).when(size <= 17, 2).when(size <= 25, 3).otherwise(4),
        "digits": F.floor(F.length(_digits(s)) * 4 / size).cast("int"),
        "before": _side(last), "after": _side(nxt),
    }
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def with_candidates(df: DataFrame, text: str, out: str) -> DataFrame:
    """Append an array of all candidate spans with kind number, votes (1, 0, or -1 for none) and features."""
    whole, parts = free_name(df, "pii_text"), {k: free_name(df, f"pii_{k}") for k in KINDS}
    df = df.withColumn(whole, text_of(text))
    t = F.col(whole)
    df = df.withColumns({parts[k]: F.when(MAY_HOLD[k](t), _spans(t, k)) for k in KINDS})

    def voted(number: int, kind: str):
        return F.transform(F.col(parts[kind]), lambda s: F.struct(
            F.lit(number).alias("kind"), _voted(kind, s).alias("v")))

    kind_type = "array<struct<kind:int,v:struct<start:int,end:int," + ",".join(
        f"{n}:int" for n in VOTERS + FEATURES) + ">>>"
    df = df.withColumn(out, F.concat(*[
        F.coalesce(voted(i, k).cast(kind_type), F.array().cast(kind_type)) for i, k in enumerate(KINDS)]))
    return df.drop(whole, *parts.values())


@dataclass
class PiiModel:
    """Reliabilities of the labelers and weights of the span classifier, by kind number."""

    #: (kind, voter) -> probability that the voter says yes to a true and to a false span.
    reliability: dict[tuple[int, str], tuple[float, float]]
    prior: dict[int, float]
    #: (kind, feature, value) -> log-odds.
    weights: dict[tuple[int, str, int], float]

    def log_odds(self, kind: Column, value_of) -> Column:
        """The classifier's log-odds of a span; ``value_of`` gives the column of a feature."""
        total = _lookup({(k,): _logit(p) for k, p in self.prior.items()}, kind)
        for f in FEATURES:
            own = {(k, v): w for (k, name, v), w in self.weights.items() if name == f}
            total = total + _lookup(own, kind, value_of(f))
        return total


def _logit(p: float) -> float:
    return math.log(p / (1 - p))


def _lookup(table: dict[tuple, float], *keys: Column) -> Column:
    """A literal table looked up by its keys; 0 where it has no entry."""
    if not table:
        return F.lit(0.0)
    key = F.concat_ws("/", *[k.cast("string") for k in keys])
    pairs = [F.lit(x) for k, v in sorted(table.items()) for x in ("/".join(map(str, k)), float(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(0.0))


def fit_pii(df: DataFrame, text: str = "text") -> PiiModel:
    """Count the vote and feature patterns of all candidate spans and estimate the model from these counts.

    A kind without candidates gets no entries, and then nothing of it is ever marked but base spans.
    """
    name = free_name(df, "pii_spans")
    spans = with_candidates(df, text, name).select(F.explode(name).alias("s"))
    patterns = stored(
        spans.select("s.kind", *[f"s.v.{n}" for n in VOTERS + FEATURES])
        .groupBy("kind", *VOTERS, *FEATURES).agg(F.count(F.lit(1)).cast("double").alias("n")), "patterns")
    yes = sum(F.when(F.col(v) == 1, 1.0).otherwise(0.0) for v in VOTERS)
    cast = sum(F.when(F.col(v) >= 0, 1.0).otherwise(0.0) for v in VOTERS)
    posterior = (yes + 0.5) / (cast + 1.0)
    model = PiiModel({}, {}, {})
    for _ in range(ROUNDS):
        t, f = F.col("n") * F.col("p"), F.col("n") * (1 - F.col("p"))
        sums = [F.sum(t).alias("true"), F.sum("n").alias("all")]
        for v in VOTERS:
            said, yes = F.col(v) >= 0, F.col(v) == 1
            sums += [F.sum(F.when(c, x).otherwise(0.0)).alias(f"{v}_{w}") for w, c, x in (
                ("true", said, t), ("true_yes", yes, t), ("false", said, f), ("false_yes", yes, f))]
        for r in patterns.withColumn("p", posterior).groupBy("kind").agg(*sums).collect():  # one row for each kind
            model.prior[r["kind"]] = (r["true"] + RIGHT) / (r["all"] + RIGHT + WRONG)
            for v in VOTERS:
                model.reliability[r["kind"], v] = (
                    (r[f"{v}_true_yes"] + RIGHT) / (r[f"{v}_true"] + RIGHT + WRONG),
                    (r[f"{v}_false_yes"] + WRONG) / (r[f"{v}_false"] + RIGHT + WRONG))
        odds = _lookup({(k,): _logit(p) for k, p in model.prior.items()}, F.col("kind"))
        for v in VOTERS:
            rel = {k: ab for (k, name), ab in model.reliability.items() if name == v}
            odds = odds + F.when(F.col(v) == 1, _lookup({(k,): math.log(a / b) for k, (a, b) in rel.items()},
                                                        F.col("kind"))) \
                .when(F.col(v) == 0, _lookup({(k,): math.log((1 - a) / (1 - b)) for k, (a, b) in rel.items()},
                                             F.col("kind"))).otherwise(0.0)
        posterior = 1 / (1 + F.exp(-odds))
    soft = patterns.withColumn("p", posterior)
    values = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in FEATURES])
    counted = soft.select("kind", "n", "p", F.explode(values).alias("x")).groupBy("kind", "x.feature", "x.value").agg(
        F.sum(F.col("n") * F.col("p")).alias("true"), F.sum(F.col("n") * (1 - F.col("p"))).alias("false"))
    for r in counted.collect():  # one row for each kind, feature and value
        p = model.prior[r["kind"]]
        total = sum(x for x in (r["true"], r["false"]))
        model.weights[r["kind"], r["feature"], r["value"]] = math.log(
            (r["true"] + p) / (r["false"] + 1 - p)) - _logit(p) if total else 0.0
    return model


def mark_pii(df: DataFrame, model: PiiModel, text: str = "text", out: str = "pii") -> DataFrame:
    """Append all accepted spans of each whole text: an array of (start, end, kind, base), by start, then kind.

    Null texts count as empty: no spans. Repeated rows get the same spans.
    """
    name = free_name(df, "pii_spans")
    df = with_candidates(df, text, name)
    names = F.array(*[F.lit(k) for k in KINDS])
    base = lambda s: (s["kind"] < len(BASE)) & (s["v"]["format"] == 1)
    accepted = F.filter(F.col(name), lambda s: base(s) | (
        (s["kind"] >= len(BASE)) & (model.log_odds(s["kind"], lambda f: s["v"][f]) > 0)))
    ordered = F.array_sort(F.transform(accepted, lambda s: F.struct(
        s["v"]["start"].alias("start"), s["kind"].alias("number"), s["v"]["end"].alias("end"))))
    return df.withColumn(out, F.transform(ordered, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), F.element_at(names, s["number"] + 1).alias("kind"),
        (s["number"] < len(BASE)).alias("base")))).drop(name)


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_pii(df: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    return mark_pii(df, fit_pii(df, text), text, out)


def redact_pii(df: DataFrame, text: str = "text") -> DataFrame:
    """Put [KIND] in place of every span. Overlapping spans become one, named after the first. All columns stay; texts
    without spans, null ones included, are left as they are."""
    name, cut = free_name(df, "pii"), free_name(df, "pii_cut")
    marked = find_pii(df, text, name)

    def merged(spans: Column) -> Column:
        ends = F.transform(spans, lambda s: s["end"])

        def opened(reach: Column) -> Column:
            """Spans that start where all before them have ended, each with where these ended."""
            return F.filter(F.zip_with(spans, reach, lambda s, r: F.struct(
                s["start"].alias("start"), s["kind"].alias("kind"), r.alias("before"))), lambda x: x["start"] >= x["before"])

        def closed(heads: Column) -> Column:
            """A span ends where all before the next one have ended."""
            ends_of = F.concat(F.transform(F.slice(heads, F.lit(2), F.size(heads)), lambda x: x["before"]),
                               F.array(F.array_max(ends)))
            return F.zip_with(heads, ends_of, lambda h, e: F.struct(
                h["start"].alias("start"), e.alias("end"), h["kind"].alias("kind")))

        return _bound(_running(ends, 0, lambda x, y: F.greatest(x, y)), lambda reach: _bound(opened(reach), closed))

    marked = marked.withColumn(cut, F.when(F.size(name) > 0, _bound(F.col(name), merged)))
    t = text_of(text)
    # Four bytes a character make every cut as long as the piece, however long the text is. An x in front keeps a piece
    # from being read as a byte order mark.
    mark = F.unhex(F.lit("00000078"))

    def redacted(wide: Column, cuts: Column) -> Column:
        def piece(start: Column, length: Column) -> Column:
            return F.substring(F.decode(F.concat(mark, F.substring(wide, start * 4 + 1, length * 4)), "UTF-32"), F.lit(2), length)

        def put_together(ends: Column) -> Column:
            pieces = F.zip_with(cuts, F.slice(ends, F.lit(1), F.size(cuts)), lambda s, e: F.concat(
                piece(e, s["start"] - e), F.lit("["), F.upper(s["kind"]), F.lit("]")))
            last = F.element_at(ends, -1)
            return F.concat(F.array_join(pieces, ""), piece(last, F.floor(F.octet_length(wide) / 4).cast("int") - last))

        return _bound(F.concat(F.array(F.lit(0)), F.transform(cuts, lambda s: s["end"])), put_together)

    text_out = _bound(F.encode(t, "UTF-32"), lambda wide: _bound(F.col(cut), lambda cuts: redacted(wide, cuts)))
    return marked.withColumn(text, F.when(F.col(cut).isNotNull(), text_out).otherwise(F.col(text))).select(*df.columns)
