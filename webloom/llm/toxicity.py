"""Toxicity by a weighted finite-state grammar over the words of a clause.

Transducers read a clause's words and emit weighted classes: insults (learned words and learned stems with any ending),
threats, targets, negations and reported speech. They are composed into one machine with few states that walks a clause
once and keeps the best path: a matched insult or threat scores its weight, more beside a target, less after a negation
or inside reported speech. A text's score is the logistic of the prior odds and its clauses' scores, so a single word
never counts outside its clause.

Insult weights are learned from labels: the log-odds of a term in toxic against other texts, if it is far beyond chance.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import free_name, map_texts, stored
from webloom.llm.quality import held_out, labelled, logistic

#: The most labelled texts that are learned from.
SAMPLE = 12_000
#: The most terms a lexicon has: the strongest ones.
LEXICON = 20_000
#: Lengths of stems; a stem stands for all longer words that start with it.
STEMS = (4, 5, 6, 7)
#: Terms in fewer toxic texts are not learned.
LEAST_TOXIC = 4
#: A term must be so unlikely to be chance, as a natural logarithm, among all terms.
SURE = 18.0
#: Log-odds below it are no insult.
LEAST_WEIGHT = 3.0

LETTERS = re.compile(r"[^\W\d_]+")
CLAUSES = re.compile(r"[.!?;:,\n]+")

# Word classes of the grammar, in the languages of the documents.
TARGETS = """you your yours yourself u ur he she they them him her their this these those people
du dich dir dein deine ihr euch euer sie ihn ihnen
tu te toi ton ta tes vous votre vos il elle ils elles eux
tú ti tus usted ustedes vosotros él ella ellos ellas""".split()
NEGATIONS = """not never no isn aren wasn weren don doesn didn won cannot hardly
nicht nie niemals kein keine keinen
pas jamais ni aucun aucune
nunca jamás tampoco ningún ninguna""".split()
REPORTS = """said says saying told wrote writes quoted quote quotes called calls alleged allegedly according
sagte sagt schrieb schreibt nannte zitierte
dit écrit cita appelé selon
dijo dice escribió citó llamó según""".split()
THREATS = """kill murder hurt destroy beat shoot stab burn hang
töten umbringen schlagen erschießen
tuer frapper brûler détruire
matar golpear quemar destruir""".split()
THREAT_WEIGHT = 2.0

# Weights that transducers apply to a match.
TARGETED, NEGATED, REPORTED = 1.25, 0.6, 0.6
#: Log-odds by which a text's score rises with the score of its heaviest clause.
STEEP = 1.5
#: Words after a negation or a report that they act on.
SCOPE = 6


@dataclass
class Grammar:
    """What the machine is made of: insult weights by whole word and by stem, the prior log-odds of toxicity, and the
    clause score at which texts are as likely toxic as not."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    prior: float = -2.0
    even: float | None = None

    def __post_init__(self) -> None:
        self._classes = {w: "target" for w in TARGETS} | {w: "report" for w in REPORTS} | {
            w: "not" for w in NEGATIONS}
        self._known: dict[str, tuple[str, float] | None] = {}

    def insult(self, word: str) -> float:
        """Weight of the strongest path of the lexicon transducer that accepts the word."""
        best = self.words.get(word, 0.0)
        for n in STEMS:
            if len(word) >= n:
                best = max(best, self.stems.get(word[:n], 0.0))
        return best

    def read(self, word: str) -> tuple[str, float] | None:
        """The class that a word is transduced to."""
        if w := self.insult(word):
            return "insult", w
        if word in self._classes:
            return self._classes[word], 0.0
        return ("threat", THREAT_WEIGHT) if word in THREATS else None

    def clause(self, words: list[str]) -> float:
        """Best path through the composed machine: the heaviest match, weighed by what stands around it.

        The state is (words left of a negation's reach, words left of a report's reach, target seen).
        """
        negated = reported = 0
        target = False
        best = threat = 0.0
        for word in words:
            known = self._known
            if word not in known:
                if len(known) > 200_000:
                    known.clear()
                known[word] = self.read(word)
            got = known[word]
            if got is None:
                negated, reported = max(0, negated - 1), max(0, reported - 1)
                continue
            kind, w = got
            if kind == "not":
                negated = SCOPE
            elif kind == "report":
                reported = SCOPE
            elif kind == "target":
                target = True
            else:
                w *= (NEGATED if negated else 1.0) * (REPORTED if reported else 1.0)
                if kind == "threat":
                    threat = max(threat, w)
                else:
                    best = max(best, w)
        if threat and target:  # a threat counts only against someone
            best = max(best, threat)
        return best * TARGETED if best and target else best

    def matches(self, text: str) -> list[float]:
        """Scores of the clauses that match."""
        found = (self.clause(words) for c in CLAUSES.split(text.lower()) if (words := LETTERS.findall(c)))
        return [w for w in found if w]

    def score(self, text: str) -> float:
        """Probability of toxicity: how far the heaviest clause is beyond ``even``, and a little for every further
        clause beyond it."""
        matched = self.matches(text)
        even = -self.prior if self.even is None else self.even
        top = max(matched, default=0.0)
        further = sum(w for w in matched if w >= even) - top if top >= even else 0.0
        return logistic(STEEP * (top - even) + 0.1 * min(further, 50.0))


def terms_of(text: str) -> set[str]:
    """Different words of a text, and stems with a star; stems only of words that are longer."""
    words = set(LETTERS.findall(text.lower()))
    return {w for w in words if len(w) <= 40} | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}


def term_counts(rows: DataFrame) -> DataFrame:
    """``term``, ``toxic``, ``clean``: numbers of texts of either label that hold a term. Counts combine in each task
    before they are shuffled."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both: tuple[Counter, Counter] = Counter(), Counter()

        def flushed() -> pd.DataFrame:
            terms = list(both[0].keys() | both[1].keys())
            out = pd.DataFrame({"term": pd.Series(terms, dtype=object),
                                "toxic": np.array([both[1][t] for t in terms], np.int64),
                                "clean": np.array([both[0][t] for t in terms], np.int64)})
            both[0].clear()
            both[1].clear()
            return out

        for p in batches:
            for text, label in zip(p["text"], p["label"]):
                both[label > 0].update(terms_of(text))
                if len(both[0]) + len(both[1]) > 500_000:
                    yield flushed()
        if both[0] or both[1]:  # a split without rows, or with texts without words, gives no frame at all
            yield flushed()

    return rows.mapInPandas(count, "term string, toxic bigint, clean bigint").groupBy("term").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def fit_grammar(df: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, doc_id: str = "doc_id",
                text: str = "text") -> Grammar:
    """Learn the insult transducer from at most ``sample`` labelled texts that are not held out.

    A term is learned if it is in enough toxic texts, its log-odds are high, and the likelihood ratio against "equally
    frequent in both" is far beyond chance. At most ``LEXICON`` terms come to the driver. Without labels of both kinds
    the lexicon is empty.
    """
    rows = stored(labelled(df, labels, label, sample, doc_id, text), "sample").select("text", "label")
    n = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic or not clean:
        return Grammar(prior=-2.0)
    a, c = F.col("toxic").cast("double"), F.col("clean").cast("double")
    p, share = toxic / (toxic + clean), F.col("toxic") / (F.col("toxic") + F.col("clean"))
    # Log-likelihood ratio of "toxic with the term's own share" against "toxic with the share of all texts".
    gain = a * F.log(share / p) + F.when(c > 0, c * F.log((1 - share) / (1 - p))).otherwise(0.0)
    weight = F.log((a + 0.5) / (toxic + 1)) - F.log((c + 0.5) / (clean + 1))
    sure = min(SURE, max(6.0, 0.25 * toxic * -math.log(p)))
    found = (
        term_counts(rows).where(a >= LEAST_TOXIC).withColumns({"gain": gain, "weight": weight})
        .where((F.col("gain") >= sure) & (F.col("weight") >= LEAST_WEIGHT))
        .orderBy(F.desc("gain"), "term").limit(LEXICON).select("term", "weight").collect()
    )
    terms = {r["term"]: r["weight"] for r in found}
    grammar = Grammar(
        words={t: w for t, w in terms.items() if not t.endswith("*")},
        stems={t[:-1]: w for t, w in terms.items() if t.endswith("*")},
        prior=math.log(toxic / clean),
    )
    grammar.even = _even(rows, grammar)
    return grammar


def _even(rows: DataFrame, grammar: Grammar) -> float:
    """The clause score that parts the labels with the fewest errors, in the middle of the widest such gap.

    Terms that are frequent only in copies of a toxic text are weak; here they fall below the line. Scores are counted
    by tenths, so what comes to the driver does not grow with the texts.
    """
    def make():
        return lambda texts: [(max(grammar.matches(t), default=0.0),) for t in texts]

    heaviest = map_texts(rows, "text", [("top", "double")], make, ["label"])
    counts: dict[float, list[int]] = {}
    for r in heaviest.groupBy(F.round("top", 1).alias("top"), "label").agg(F.count(F.lit(1)).alias("n")).collect():
        counts.setdefault(r["top"], [0, 0])[min(r["label"], 1)] += r["n"]
    tops = sorted({0.0, *counts})
    errors = sum(counts.get(tops[0], [0, 0])[1:]) + sum(counts[t][0] for t in tops[1:])
    best = None
    for low, high in zip(tops, [*tops[1:], tops[-1] + 2.0]):
        if best is None or errors < best[0] or errors == best[0] and high - low > best[1]:
            best = (errors, high - low, (low + high) / 2)
        clean, toxic = counts.get(high, [0, 0])
        errors += toxic - clean
    return best[2]


def score_toxicity(df: DataFrame, grammar: Grammar, text: str = "text", score: str = "score",
                   keep: list[str] | None = None) -> DataFrame:
    """Append the probability of toxicity for each whole text. Null texts count as empty; an empty text has only the
    prior odds."""
    sent = df.sparkSession.sparkContext.broadcast(grammar)

    def make():
        machine = sent.value
        return lambda texts: [(machine.score(t),) for t in texts]

    return map_texts(df, text, [(score, "double")], make, keep)


def classify_toxicity(df: DataFrame, labels: DataFrame, threshold: float = 0.5, doc_id: str = "doc_id",
                      text: str = "text", label: str = "toxic", sample: int = SAMPLE, keep: list[str] | None = None
                      ) -> DataFrame:
    """Fit on the labels and append ``held_out``, ``score`` and ``predicted``. Rows without id are held out. Columns of
    these names are replaced; all others stay. Equal texts get equal scores."""
    added = ["held_out", "score", "predicted"]
    columns = [c for c in (keep or df.columns) if c not in added]
    grammar = fit_grammar(df, labels, label, sample, doc_id, text)
    out = score_toxicity(df.withColumn(part := free_name(df, "part"), held_out(F.col(doc_id))), grammar, text, "score",
                         [*columns, part])
    return out.select(*columns, F.col(part).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(df: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows that are not predicted to be toxic, with the columns they came with."""
    own = free_name(df, "toxic_score")
    grammar = fit_grammar(df, labels, **{k: v for k, v in options.items() if k != "threshold"})
    return score_toxicity(df, grammar, options.get("text", "text"), own) \
        .where(F.col(own) < options.get("threshold", 0.5)).select(*df.columns)
