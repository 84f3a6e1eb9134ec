"""Toxicity by a weighted lexicon, matched with Aho-Corasick over folded texts.

Texts are lower-cased, and homoglyphs, digits and signs that stand for letters are
folded. The lexicon holds word beginnings, learned from labelled documents: Spark
counts in how many toxic and clean ones each word occurs, beginnings sum their words,
and those whose log odds surely suffice are taken, each as long as it
stays without losing support. Words shorter than the shortest beginning are taken under
the same bounds, and hit whole words only; so in scripts without spaces they hit where
other signs part them from the text around. Exception phrases (a hit with the word before or after
it) are learned where a beginning also occurs in clean documents; a hit inside one does
not count. The sum of weights, normalised by the text's length, gives the score through
a logistic curve fitted on the same documents.

Fitting takes at most ``MAX_LABELLED`` labelled documents, those of least md5(doc_id):
the bound that lets their ids be broadcast. Everything else covers whole texts and all
rows: every term and phrase with the evidence enters the lexicon, and one of more than
``MAX_ENTRIES`` of either, which could not be sent to every task, is an error.

Defined results: null and empty texts have no hits and get the curve's value for none.
Null doc_ids are not held out and never fitted on; null labels are not used; of several
labels for a document the highest counts. Without any usable labels all scores are 0.
Only doc_id and text are read. Repeated rows get a row each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, materialize, pieces, table

#: Labelled documents fitted on at most; terms, and phrases, beyond which fitting fails.
MAX_LABELLED, MAX_ENTRIES = 20_000, 1_000_000
#: Lengths of word beginnings; toxic documents a term must occur in; what the lower
#: bound of its log odds (at so many standard errors) must reach.
BEGINNINGS, MIN_SUPPORT, MIN_WEIGHT, ERRORS = range(4, 13), 5, 2.0, 1.96
#: A longer beginning replaces a shorter one that it covers to this share.
COVER = 0.9
THRESHOLD = 0.7
#: Letters that other scripts' letters, digits and signs stand for.
_LOOKALIKES = {
    "a": "аα@4", "b": "ьβ8", "c": "сϲ", "d": "ԁ", "e": "еεё3", "g": "ɡ9", "h": "һ", "i": "іιı1|", "j": "јϳ", "k": "кκ", "l": "ӏⅼ",
    "m": "мⅿ", "n": "ոη", "o": "оοσ0", "p": "рρ", "q": "ԛ", "r": "гⲅ", "s": "ѕʂ5$", "t": "тτ7", "u": "υս", "v": "ѵν", "w": "ԝω", "x": "хχ", "y": "уγ", "z": "ᴢ2",
}
_FOLD = {ord(x): letter for letter, others in _LOOKALIKES.items() for x in others}
_FOLD |= {0xFF01 + i: chr(0x21 + i) for i in range(94)}  # full-width forms
_FOLD |= {c: None for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}  # invisible
_WORD = re.compile(r"[^\W_]+")


def folded(text: str | None) -> str:
    return text.lower().translate(_FOLD) if text else ""


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    phrases: frozenset = frozenset()
    #: intercept, weight of log(1 + sum of weights), weight of log(words)
    curve: tuple[float, float, float] | None = None

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            found.add_word(term, (len(term), weight))
        if self.weights:
            found.make_automaton()
        return found

    def hits(self, text: str, automaton) -> list[tuple[int, int, float]]:
        """(start, end of the term, weight): the longest term of each word that
        begins with one, or is a short one, but for those inside exception phrases."""
        best: dict[int, tuple[int, float]] = {}
        for last, (n, weight) in automaton.iter(text) if self.weights else ():
            start = last - n + 1
            if start and text[start - 1].isalnum():
                continue
            if n < min(BEGINNINGS) and text[last + 1 : last + 2].isalnum():
                continue
            if start not in best or best[start][0] < last + 1:
                best[start] = (last + 1, weight)
        found = [(s, e, w) for s, (e, w) in best.items()]
        return [h for h in found if not self.phrases or not self.phrases & set(around(text, h[0]))]

    def features(self, text: str, automaton) -> tuple[float, float]:
        total = sum(w for _, _, w in self.hits(text, automaton))
        return float(np.log1p(total)), float(np.log1p(text.count(" ") + text.count("\n")))

    def score(self, text: str, automaton) -> float:
        if self.curve is None:
            return 0.0
        a, b, c = self.curve
        x, n = self.features(text, automaton)
        return float(1 / (1 + np.exp(-np.clip(a + b * x + c * n, -50, 50))))


def around(text: str, start: int) -> list[str]:
    """The word at ``start`` with the word before it, and with the one after it."""
    word = _WORD.match(text, start)
    if not word:
        return []
    after, end = _WORD.search(text, word.end()), start
    while end and not text[end - 1].isalnum():
        end -= 1
    before = end
    while before and text[before - 1].isalnum():
        before -= 1
    found = [f"{text[before:end]} {word[0]}"] if before < end else []
    return [*found, f"{word[0]} {after[0]}"] if after else found


def _gathered(entries: DataFrame, what: str) -> list:
    """The rows of ``entries``, if a lexicon may have as many."""
    rows = entries.limit(MAX_ENTRIES + 1).collect()
    if len(rows) > MAX_ENTRIES:
        raise ValueError(f"a lexicon of more than {MAX_ENTRIES} {what} is not sent to every task")
    return rows


def _counted(labelled: DataFrame) -> DataFrame:
    """(toxic, text) → word, toxic, n: documents with the word, summed by task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in pieces(b, 1)):
            words, marks = [], []
            for text, toxic in zip(batch.column(1), batch.column(0).to_pylist()):
                found = set(_WORD.findall(folded(text.as_py())))
                words += found
                marks += [toxic] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(marks, pa.int32())], names=["word", "toxic"])

    return in_arrow(labelled, run, "word string, toxic int").groupBy("word").agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n"))


def _terms(labelled: DataFrame) -> dict[str, float]:
    totals = labelled.agg(F.sum("toxic"), F.count(F.lit(1))).first()
    toxic, clean = totals[0] or 0, totals[1] - (totals[0] or 0)
    if not toxic or not clean:
        return {}
    begins = [F.when(F.length("word") >= n, F.substring("word", 1, n)) for n in BEGINNINGS]
    words = _counted(labelled).select(F.explode(F.array_distinct(F.array_compact(F.array(*begins, F.col("word"))))).alias("term"), "t", "n")
    terms = words.groupBy("term").agg(F.sum("t").alias("t"), F.sum(F.col("n") - F.col("t")).alias("c"))
    weight = F.log((F.col("t") + 0.5) / (toxic + 1.0)) - F.log((F.col("c") + 0.5) / (clean + 1.0))
    bound = weight - ERRORS * F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    strong = terms.withColumn("weight", weight).where((F.col("t") >= MIN_SUPPORT) & (bound >= MIN_WEIGHT))
    best = sorted(_gathered(strong, "terms"), key=lambda r: r["term"])
    # beginnings of equal reach: only the longest stays, and none that a shorter one implies
    support = {r["term"]: r["t"] for r in best}
    covered = {term[:n] for term in support for n in range(min(BEGINNINGS), len(term)) if support[term] >= COVER * support.get(term[:n], float("inf"))}
    kept = [r for r in best if r["term"] not in covered and not _implied(r["term"], support, covered)]
    return {r["term"]: round(r["weight"], 6) for r in kept}


def _implied(term: str, support: dict[str, int], covered: set[str]) -> bool:
    """Whether a shorter term that stays matches wherever this one does."""
    return any(term[:n] in support and term[:n] not in covered for n in range(min(BEGINNINGS), len(term)))


def _phrases(labelled: DataFrame, lexicon: Lexicon) -> frozenset:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in (part for b in batches for part in pieces(b, 1)):
            found, marks = [], []
            for text, toxic in zip(batch.column(1), batch.column(0).to_pylist()):
                text = folded(text.as_py())
                own = {p for start, _, _ in lexicon.hits(text, automaton) for p in around(text, start)}
                found += own
                marks += [toxic] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(marks, pa.int32())], names=["phrase", "toxic"])

    counts = in_arrow(labelled, run, "phrase string, toxic int").groupBy("phrase").agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n"))
    return frozenset(r["phrase"] for r in _gathered(counts.where("n - t >= 3 and t * 10 <= n"), "phrases"))


def _curve(labelled: DataFrame, lexicon: Lexicon) -> tuple[float, float, float]:
    """Ridge logistic regression of the label on the two features, by Newton steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            xs = [lexicon.features(folded(t.as_py()), automaton) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in xs]), pa.array([n for _, n in xs])], names=["toxic", "x", "n"])

    rows = np.array([tuple(r) for r in in_arrow(labelled, run, "toxic int, x double, n double").collect()])  # MAX_LABELLED rows at most
    rows = rows[np.lexsort(rows.T)]  # one order, whatever the partitions
    y, features = rows[:, 0], np.column_stack([np.ones(len(rows)), rows[:, 1:]])
    beta, ridge = np.zeros(3), np.diag([1e-3, 1e-2, 1e-1]) * len(rows) / 1000
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(features @ beta, -30, 30)))
        step = np.linalg.solve((features.T * (p * (1 - p))) @ features + ridge, features.T @ (y - p) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(round(float(b), 6) for b in beta)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Lexicon:
    """A lexicon from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic), without
    the documents that are held out."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    marks = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = F.broadcast(marks.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(max_labelled))
    labelled = docs.select("doc_id", "text").join(sample, "doc_id")
    # copies of a text are one witness, not many
    labelled = materialize(labelled.groupBy("text").agg(F.max("toxic").alias("toxic")).select("toxic", "text"), "labelled")
    lexicon = Lexicon(_terms(labelled))
    if not lexicon.weights:
        return lexicon
    lexicon.phrases = _phrases(labelled, lexicon)
    lexicon.curve = _curve(labelled, lexicon)
    return lexicon


def scored(docs: DataFrame, lexicon: Lexicon, keep: list[str]) -> DataFrame:
    """``docs`` (``keep``..., text) → the kept columns and a last column, toxicity."""
    given = docs.select([F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)] + [F.col("text").alias("of")])
    names = [f"c{i}" for i in range(len(keep))]
    held = docs.sparkSession.sparkContext.broadcast(lexicon)  # MAX_ENTRIES terms and phrases at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = held.value.automaton()
        for batch in (part for b in batches for part in pieces(b, len(names))):
            scores = [held.value.score(folded(t.as_py()), automaton) for t in batch.column(len(names))]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(names))], pa.array(scores, pa.float64())], names=[*names, "toxicity"])

    return in_arrow(given, run, given.select(*names).schema.add("toxicity", "double"))


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = fit(docs, table(spark, sf_dir, "labels"))
    return scored(docs, lexicon, ["doc_id"]).select(
        F.col("c0").alias("doc_id"), held_out(F.col("c0")).alias("held_out"), F.col("toxicity").alias("score"),
        (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"),
    )


def without_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` scored below ``threshold``, with their own columns."""
    kept = scored(docs, lexicon, docs.columns).where(F.col("toxicity") < threshold)
    return kept.drop("toxicity").toDF(*docs.columns)
