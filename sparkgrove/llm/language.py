"""Languages of documents by inference in a mixture of n-gram models.

A document is taken as a mixture: each of its letters, with both neighbours, was drawn from
one of the languages' distributions of such trigrams. Expectation-maximisation finds the
proportions of the languages; then languages are taken out one by one, each time the one
that is missed least, and of all these sets the one of the best likelihood, less a penalty
for each language after the first, is the document's. Its largest proportion is the
prediction.

A single language needs no iteration where it provably wins: the likelihood is concave in
the proportions, so its slope at one language towards all others bounds what any mixture can
add, and a bound under the penalty leaves that language alone.

The models are counts over all training documents: trigrams of lower-cased letters, any
other sign being a word's edge, hashed to ``2**BITS`` cells. Tasks sum them by language
before they are shuffled. A model has at most ``MAX_LANGUAGES`` times 2**BITS counts, lies
in the shared folder, and more languages are an error, since every task holds the model.

Defined results: null texts, and those without a letter, are ``und`` with score 0 and no
languages; so are all where nothing was learned. Null doc_ids are not held out and never
learned from. An empty language name is a name. Of equal likelihoods or proportions the
language first by code point wins. The score is the share of the predicted language, drawn
towards an equal share by one letter for each language. Long texts are counted whole, in
parts. Repeated rows get a row each; columns besides those named are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, in_arrow, pieces, table
from .storage import located

#: Cells of a model, as a power of two; languages at most; characters taken at a time.
BITS, MAX_LANGUAGES, PART = 16, 256, 1 << 20
#: Share of a model that is the same for every cell, seen or not.
FLOOR = 0.01
#: What a further language must add to the logarithm of the likelihood, for each trigram
#: width and the logarithm of the letters: neighbouring trigrams share letters.
WIDTH, PENALTY = 3, 3.0
#: Iterations at most; change of a proportion below which they end.
ITERATIONS, ENOUGH = 60, 1e-3
UNKNOWN = "und"
_CELLS = 1 << BITS
#: What one letter can add to the logarithm of the likelihood at most.
MOST_GAIN = math.log(_CELLS / FLOOR)
_MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """By code point: the lower-cased letter, 0 for what is none."""
    return np.array([ord(x.lower()[0]) if (x := chr(i)).isalpha() else 0 for i in range(0x110000)], np.uint32)


def _cells(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places of the letters of a text and the cells of their trigrams. Any other sign, the
    ends included, is an edge."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.zeros(len(points) + 2, np.uint64)
    code[1:-1] = _letters()[points]
    at = np.flatnonzero(code[1:-1])
    a, b, c, d = _MULTIPLIERS
    mixed = (code[at] * a ^ code[at + 1] * b) + code[at + 2] * c
    return at, ((mixed ^ mixed >> np.uint64(29)) * d >> np.uint64(64 - BITS)).astype(np.int64)


def _long(text: str) -> np.ndarray:
    """Counts by cell of one text, a part at a time."""
    counts = np.zeros(_CELLS, np.int64)
    for start in range(0, len(text), PART):
        head = int(start > 0)
        at, cells = _cells(text[start - head : start + PART + 1])
        counts += np.bincount(cells[(at >= head) & (at < head + PART)], minlength=_CELLS)
    return counts


def counted(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of texts, cells and counts of their trigrams, in order."""
    values = pc.fill_null(texts, "").to_pylist()
    if len(values) == 1 and len(values[0]) > PART:
        counts = _long(values[0])
        cells = np.flatnonzero(counts)
        return np.zeros(len(cells), np.int64), cells, counts[cells]
    at, cells = _cells("\0".join(values))
    ends = np.cumsum([len(v) + 1 for v in values])
    pairs, counts = np.unique(np.searchsorted(ends, at, side="right") * _CELLS + cells, return_counts=True)
    return pairs >> BITS, pairs & (_CELLS - 1), counts


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, text → lang, cell, n, summed over the task for as many languages as a model has."""
    sums: dict[str, np.ndarray] = {}

    def flushed() -> Iterator[pa.RecordBatch]:
        for lang, n in sums.items():
            cells = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * max(1, len(cells))), pa.array(cells if len(cells) else [0]), pa.array(n[cells] if len(cells) else [0])], names=["lang", "cell", "n"])
        sums.clear()

    for batch in batches:
        for part in pieces(batch, 1, PART):
            names, (text, cell, n) = part.column(0).to_pylist(), counted(part.column(1))
            coded = {name: i for i, name in enumerate(dict.fromkeys(names))}
            pairs = np.array([coded[x] for x in names])[text] * _CELLS + cell
            order = np.argsort(pairs, kind="stable")
            pairs, n = pairs[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])) if len(pairs) else np.zeros(0, np.int64)
            total = np.add.reduceat(n, first) if len(first) else n
            bounds = np.searchsorted(pairs[first] >> BITS, np.arange(len(coded) + 1))
            for name, a, b in zip(coded, bounds[:-1], bounds[1:]):
                sums.setdefault(name, np.zeros(_CELLS, np.int64))[pairs[first[a:b]] & (_CELLS - 1)] += total[a:b]
            if len(sums) > MAX_LANGUAGES // 4:
                yield from flushed()
    yield from flushed()


def fit(docs: DataFrame) -> str:
    """Learns from ``docs`` (text, lang), without those whose language is null; returns the
    model's folder."""
    known = docs.where(F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("lang"), "text")
    path = fresh_path(docs.sparkSession, "languages")
    in_arrow(known, _learn, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).write.parquet(path)
    n = docs.sparkSession.read.parquet(path).agg(F.count_distinct("lang")).first()[0]
    if n > MAX_LANGUAGES:
        raise ValueError(f"{n} languages: a model of more than {MAX_LANGUAGES} is not sent to every task")
    return path


class Model(NamedTuple):
    """Names of the languages by code point, and their probabilities by cell."""

    names: list[str]
    p: np.ndarray


@lru_cache(maxsize=2)
def load(path: str) -> Model:
    from pyarrow import dataset

    store, at = located(path)
    found = dataset.dataset(at, filesystem=store, format="parquet").to_table()
    coded = found.column("lang").combine_chunks().dictionary_encode() if found.num_rows else pa.array([], pa.string()).dictionary_encode()
    names = sorted(coded.dictionary.to_pylist())
    place = np.array([names.index(x) for x in coded.dictionary.to_pylist()], np.int64)
    n = np.zeros((len(names), _CELLS))
    np.add.at(n, (place[coded.indices.to_numpy(zero_copy_only=False)], found.column("cell").to_numpy()), found.column("n").to_numpy())
    total = n.sum(axis=1, keepdims=True)
    return Model(names, (np.where(total > 0, (1 - FLOOR) * n / np.maximum(total, 1), (1 - FLOOR) / _CELLS) + FLOOR / _CELLS).astype(np.float32).T.copy())


def penalty(n: np.ndarray) -> np.ndarray:
    return WIDTH * PENALTY * np.log1p(n)


class Pairs(NamedTuple):
    """(document, cell) pairs of some documents, by document: where each starts, the
    document of each, counts, probabilities by language."""

    first: np.ndarray
    doc: np.ndarray
    n: np.ndarray
    p: np.ndarray

    def summed(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.first, axis=0)

    def of(self, docs: np.ndarray) -> Pairs:
        """Those of the documents at ``docs`` alone."""
        at = np.isin(self.doc, docs)
        doc = np.searchsorted(docs, self.doc[at])
        return Pairs(np.searchsorted(doc, np.arange(len(docs))), doc, self.n[at], self.p[at])


def mixed(pairs: Pairs, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation from ``share`` on; shares of zero stay. Returns shares and
    logarithms of the likelihood."""
    share, total = share.copy(), pairs.summed(pairs.n)
    ll, open_, left = np.zeros(len(share)), np.arange(len(share)), pairs
    for i in range(ITERATIONS):
        part = left.p * share[open_].astype(np.float32)[left.doc]
        mass = part.sum(axis=1)
        new = left.summed(part * (left.n / mass)[:, None]) / total[open_][:, None]
        change = np.abs(new - share[open_]).max(axis=1)
        ll[open_] = left.summed(left.n * np.log(mass))
        share[open_] = new
        going = np.flatnonzero(change >= ENOUGH)
        if not len(going):
            break
        if len(going) < 0.8 * len(open_):
            left, open_ = left.of(going), open_[going]
    return share, ll


def proportions(pairs: Pairs) -> np.ndarray:
    """By document, the proportions of its languages under the best penalised likelihood."""
    n_langs, total = pairs.p.shape[1], pairs.summed(pairs.n)
    single = pairs.summed(pairs.n[:, None] * np.log(pairs.p))
    best = single.argmax(axis=1)
    chosen, cost = np.eye(n_langs)[best], penalty(total)
    slope = pairs.summed(pairs.p * (pairs.n / pairs.p[np.arange(len(pairs.doc)), best[pairs.doc]])[:, None]) - total[:, None]
    unsure = np.flatnonzero(slope.max(axis=1) > cost)
    if not len(unsure) or n_langs == 1:
        return chosen
    left, value = pairs.of(unsure), single[unsure, best[unsure]]
    share, ll = mixed(left, np.full((len(unsure), n_langs), 1 / n_langs))
    # too few letters cannot bring the penalty, whatever they are
    fit = share * total[unsure, None] >= cost[unsure, None] / MOST_GAIN
    docs = np.flatnonzero(fit.sum(axis=1) > 1)
    if not len(docs):
        return chosen
    share = np.where(fit, share, 0.0)[docs]
    share, ll = mixed(left.of(docs), share / share.sum(axis=1, keepdims=True))
    while len(docs):
        at, size = unsure[docs], (share > 0).sum(axis=1)
        ll -= (size - 1) * cost[at]
        better = ll > value[docs]
        value[docs[better]], chosen[at[better]] = ll[better], share[better]
        # of each set, without the language that is missed least; one alone is known already
        docs, share = docs[size > 2], share[size > 2]
        part, most, without = left.of(docs), np.full(len(docs), -np.inf), share.copy()
        order = np.argsort(-share, axis=1, kind="stable")
        for k in range(int((share > 0).sum(axis=1).max(initial=0))):
            some = np.flatnonzero((share > 0).sum(axis=1) > k)
            kept = share[some].copy()
            kept[np.arange(len(some)), order[some, k]] = 0
            again, one = mixed(part.of(some), kept / kept.sum(axis=1, keepdims=True))
            win = one > most[some]
            most[some[win]] = one[win]
            without[some[win]] = again[win]
        share, ll = without, most
    return chosen


def _classify(model_path: str, n_kept: int, names: list[str]):
    languages = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        n_bytes = max(1 << 14, (4 << 20) // max(1, len(model.names)))
        for batch in batches:
            for part in pieces(batch, n_kept, n_bytes):
                predicted, score, sets = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows), [[] for _ in range(part.num_rows)]
                text, cell, n = counted(part.column(n_kept))
                rows, first = np.unique(text, return_index=True)
                if len(rows) and model.names:
                    pairs = Pairs(first, np.searchsorted(rows, text), n.astype(np.float64), model.p[cell])
                    share = proportions(pairs)
                    total = pairs.summed(pairs.n)
                    top = share.argmax(axis=1)
                    score[rows] = (total * share[np.arange(len(rows)), top] + 1) / (total + len(model.names))
                    for row, i, x in zip(rows.tolist(), top.tolist(), share):
                        predicted[row] = model.names[i]
                        sets[row] = [{"lang": model.names[j], "share": float(x[j])} for j in sorted(np.flatnonzero(x > 0), key=lambda j: (-x[j], j))]
                columns = [part.column(i) for i in range(n_kept)] + [pa.array(predicted, pa.string()), pa.array(score), pa.array(sets, languages)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def languages(docs: DataFrame, model: str, keep: list[str]) -> DataFrame:
    """``docs`` (``keep``..., text) → the kept columns, lang_pred, score and languages, the
    set of a document's languages with their shares, largest first."""
    given = docs.select([F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)] + [F.col("text")])
    kinds = ", ".join(f"c{i} {kind}" for i, (_, kind) in enumerate(given.drop("text").dtypes))
    made = ["lang_pred", "score", "languages"]
    schema = f"{kinds}, lang_pred string, score double, languages array<struct<lang: string, share: double>>"
    return in_arrow(given, _classify(model, len(keep), [*[f"c{i}" for i in range(len(keep))], *made]), schema).toDF(*keep, *made)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def op12_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))))
    found = languages(docs, model, ["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "languages")
