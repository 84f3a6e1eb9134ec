"""Ranked lexical search over documents, as exact inner products of sparse impact vectors.

A document's vector holds, for each term that any query asks for, the term's weight times
its saturated frequency, in integers; a query's vector holds how often it asks for each
term. Vectors are range-sorted by length (Euclidean), longest first, and searched in norm
buckets, each an Arrow batch of rows of about the same length:

* A bucket is skipped for a query if the product of both lengths stays under the query's
  threshold (Cauchy-Schwarz). Where that holds for all queries, Parquet's statistics skip
  the rows before they are read.
* Inside a bucket the largest value of each coordinate bounds what it can add. The fewest
  coordinates are taken into focus without which no document could reach the threshold; a
  document is a candidate if its sum over them, plus the smaller bound of the others (their
  largest values, or the lengths that are left to both vectors), does.
* Candidates are scored in 64-bit integers over all terms, and the best ``k`` are kept.

A query's threshold is the score of its k-th best document so far. The bucket of the
longest vectors is searched first, over all partitions; its k-th bests are the thresholds
that all tasks start from, and rise as a task finds better ones. Only bounds are computed
in doubles, with room for their errors, so the result is exact.

Queries are taken in blocks of ``BLOCK_BYTES`` of text, prepared once each as a file in the
shared folder. A block's terms are all the terms its tasks know, and bound what they hold.

Defined results: null texts have no terms; documents and queries without terms find
nothing. Each row of the queries is a query of its own, also where it repeats an id, and
each row of the documents a document. Null query ids stay null; of equal scores, null
doc_ids come last. Long texts are taken in whole. Columns besides ids and texts are not
read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, fresh_path, in_arrow, materialize, remove, table
from .storage import located, read_bytes, written
from .words import shards, words_of

#: Results a query gets; UTF-8 bytes of queries in a block, and of documents in a shard.
TOP, BLOCK_BYTES, SHARD_BYTES = 10, 8 << 20, 4 << 20
#: Rows that the first bucket holds at least; buckets of lengths to a doubling, in its search.
FIRST_ROWS, STEPS = 4096, 16
#: Fixed values of the score: scale of weights and of a term's share, saturation, share of
#: a document's length that counts, in hundredths.
WEIGHT_SCALE, SHARE_SCALE, SATURATION, LENGTH_SHARE = 1000, 1_000_000_000, 8, 75
#: Room for the errors of bounds in doubles.
SLACK = 1 + 1e-9
_NONE = 2**63 - 1
_FOUND = "query long, score long, doc_key long, unnamed boolean"


class Queries(NamedTuple):
    """A block: numbers and lengths of its queries, all terms, and each query's terms (from
    ``bounds[i]`` to ``bounds[i + 1]``) with their counts."""

    numbers: np.ndarray
    norms: np.ndarray
    vocabulary: pa.Array
    bounds: np.ndarray
    terms: np.ndarray
    times: np.ndarray


def _counted(texts: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text; for its known terms, in order: bounds by text, terms, counts."""
    flat, counts = words_of(texts)
    codes = pc.fill_null(pc.index_in(flat, value_set=vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    text = np.repeat(np.arange(len(counts)), counts)
    pairs, times = np.unique((text * len(vocabulary) + codes)[codes >= 0], return_counts=True)
    text, terms = np.divmod(pairs, max(1, len(vocabulary)))
    return counts, np.searchsorted(text, np.arange(len(counts) + 1)), terms, times.astype(np.int64)


def _prepared(path: str):
    """Group function: the queries of a block to a file; number and length of each."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        from pyspark import TaskContext

        texts = rows.column("text").combine_chunks()
        vocabulary = pc.unique(words_of(texts)[0])
        _, bounds, terms, times = _counted(texts, vocabulary)
        norms = np.array([float(np.sqrt(np.sum(times[a:b].astype(float) ** 2))) for a, b in zip(bounds[:-1], bounds[1:])])
        numbers = rows.column("query").to_numpy()
        with written(f"{path}/{key[0].as_py()}.block", str(TaskContext.get().taskAttemptId())) as out:
            out.write(pickle.dumps(Queries(numbers, norms, vocabulary, bounds, terms, times), protocol=5))
        return pa.table({"query": numbers, "norm": norms, "block": pa.array([key[0].as_py()] * len(numbers), pa.int64())})

    return run


def _vectors(block_path: str):
    """Task function: doc_key, unnamed, text → doc_key, unnamed, n, terms, times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pickle.loads(read_bytes(block_path)).vocabulary
        for part in shards(batches, 2, SHARD_BYTES):
            n, bounds, terms, times = _counted(part.column(2), vocabulary)
            lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x, pa.int32())) for x in (terms, times)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n.astype(np.int64)), *lists], names=["doc_key", "unnamed", "n", "terms", "times"])

    return run


class Weights(NamedTuple):
    """What makes impacts of counts: each term's weight, documents, and all their words."""

    of: np.ndarray
    n_docs: int
    n_words: int


def _weights(path: str, n_docs: int, n_words: int) -> Weights:
    """From the table of (term, df) at ``path``; terms in no document weigh nothing here."""
    from pyarrow import dataset

    store, at = located(path)
    found = dataset.dataset(at, filesystem=store, format="parquet").to_table()
    terms, df = found.column("term").to_numpy(), found.column("df").to_numpy()
    of = np.zeros(int(terms.max(initial=-1)) + 1, np.int64)
    of[terms] = np.floor(WEIGHT_SCALE * np.log((2 * n_docs + 2) / (2 * df + 1)))
    return Weights(of, n_docs, n_words)


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    bounds = lists.offsets.to_numpy()
    return bounds - bounds[0], lists.flatten().to_numpy().astype(np.int64)


def _impacts(weights: Weights, n: np.ndarray, row: np.ndarray, terms: np.ndarray, times: np.ndarray) -> np.ndarray:
    relative = 100 - LENGTH_SHARE + (LENGTH_SHARE * n * weights.n_docs) // weights.n_words
    return weights.of[terms] * ((SHARE_SCALE * times) // (1000 * times + SATURATION * relative[row]))


def _lengths(df_path: str, n_docs: int, n_words: int):
    """Task function: the vectors with their lengths in front, without those of length zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = _weights(df_path, n_docs, n_words)
        for batch in batches:
            (bounds, terms), (_, times) = _flat(batch.column("terms")), _flat(batch.column("times"))
            row = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            impact = _impacts(weights, batch.column("n").to_numpy(), row, terms, times).astype(float)
            norm = np.sqrt(np.bincount(row, impact * impact, minlength=batch.num_rows))
            made = pa.RecordBatch.from_arrays([pa.array(norm), *batch.columns], names=["norm", *batch.schema.names])
            yield made.filter(pa.array(norm > 0))

    return run


class Bucket:
    """Vectors of about the same length, by coordinate."""

    def __init__(self, batch: pa.RecordBatch, weights: Weights):
        (bounds, terms), (_, times) = _flat(batch.column("terms")), _flat(batch.column("times"))
        self.norms, self.n = batch.column("norm").to_numpy(), batch.num_rows
        row = np.repeat(np.arange(self.n), np.diff(bounds))
        impact = _impacts(weights, batch.column("n").to_numpy(), row, terms, times)
        order = np.argsort(terms, kind="stable")
        self.row, self.impact, self.length = row[order], impact[order], float(self.norms.max(initial=0))
        present = np.flatnonzero(np.bincount(terms, minlength=1))
        counts = np.bincount(terms, minlength=1)[present]
        self.first = np.zeros(len(weights.of) + 1, np.int64)
        self.first[present + 1] = counts
        self.first = np.cumsum(self.first)
        self.largest = np.zeros(len(weights.of), np.int64)
        if len(present):
            self.largest[present] = np.maximum.reduceat(self.impact, self.first[present])

    def places(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries of some coordinates, and for each the number of its term."""
        first, count = self.first[terms], self.first[terms + 1] - self.first[terms]
        which = np.repeat(np.arange(len(terms)), count)
        return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[which], which

    def scored(self, terms: np.ndarray, times: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows that can reach ``threshold`` and their exact scores, above zero."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        known = terms < len(self.largest)
        terms, times = terms[known], times[known]
        most = times * self.largest[terms]
        order = np.argsort(-most, kind="stable")
        terms, times, most = terms[order], times[order], most[order].astype(float)
        terms, times, most = terms[most > 0], times[most > 0], most[most > 0]
        left = np.concatenate([np.cumsum(most[::-1])[::-1], [0.0]])  # what terms from here on can add
        if not len(terms) or left[0] * SLACK < threshold:
            return none
        n_focus = int(np.argmax(left * SLACK < threshold)) if threshold > 0 else len(terms)
        at, which = self.places(terms[:n_focus])
        row, value = self.row[at], self.impact[at].astype(float)
        partial = np.bincount(row, times[which] * value, minlength=self.n)
        rest = self.norms**2 * SLACK - np.bincount(row, value * value, minlength=self.n)
        others = float(np.sqrt(np.sum(times[n_focus:].astype(float) ** 2))) * np.sqrt(np.maximum(rest, 0))
        fit = (partial > 0) & ((partial + np.minimum(left[n_focus], others)) * SLACK >= threshold)
        if not fit.any():
            return none
        at, which = self.places(terms)
        in_ = fit[self.row[at]]
        scores = np.zeros(self.n, np.int64)
        np.add.at(scores, self.row[at[in_]], times[which[in_]] * self.impact[at[in_]])
        rows = np.flatnonzero((scores > 0) & (scores >= threshold))
        return rows, scores[rows]


def _search(block_path: str, df_path: str, n_docs: int, n_words: int, k: int, thresholds_path: str | None):
    """Task function: the best ``k`` of the task's vectors for each query of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import dataset

        weights, q = _weights(df_path, n_docs, n_words), pickle.loads(read_bytes(block_path))
        threshold = np.zeros(len(q.numbers), np.int64)
        if thresholds_path:
            store, at = located(thresholds_path)
            known = dataset.dataset(at, filesystem=store, format="parquet").to_table(columns=["query", "score"])
            order = np.argsort(q.numbers)
            threshold[order[np.searchsorted(q.numbers, known.column(0).to_numpy(), sorter=order)]] = known.column(1).to_numpy()
        best: dict[int, np.ndarray] = {}  # score, doc_key, unnamed by query
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket = Bucket(batch, weights)
            keys, unnamed = batch.column("doc_key").to_numpy(), batch.column("unnamed").to_numpy(zero_copy_only=False).astype(np.int64)
            for i in np.flatnonzero((q.norms > 0) & (q.norms * bucket.length * SLACK >= threshold)):
                rows, scores = bucket.scored(q.terms[q.bounds[i] : q.bounds[i + 1]], q.times[q.bounds[i] : q.bounds[i + 1]], threshold[i])
                if len(rows):
                    new = np.stack([scores, keys[rows], unnamed[rows]])
                    new = np.concatenate([best[i], new], axis=1) if i in best else new
                    best[i] = new[:, np.lexsort((new[2], new[1], -new[0]))[:k]]
                    if best[i].shape[1] == k:
                        threshold[i] = max(threshold[i], best[i][0, -1])
        for i, (score, key, flag) in best.items():
            numbers = np.full(len(score), q.numbers[i])
            yield pa.RecordBatch.from_arrays([*map(pa.array, (numbers, score, key)), pa.array(flag > 0)], names=["query", "score", "doc_key", "unnamed"])

    return run


def _merged(parts: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each query with their rank; lists meet in groups of tasks first."""
    order = F.col("score").desc(), F.col("doc_key"), F.col("unnamed")
    parts = parts.withColumn("node", F.pmod(F.spark_partition_id(), F.lit(32)))
    parts = parts.withColumn("rank", F.row_number().over(Window.partitionBy("query", "node").orderBy(*order))).where(F.col("rank") <= k)
    return parts.drop("node").withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)


def _cut(ordered: DataFrame) -> float:
    """The length from which on the first bucket's vectors are: a step of the lengths'
    logarithm with ``FIRST_ROWS`` vectors above it, of some hundred steps that there are."""
    step = F.floor(F.log2("norm") * STEPS).alias("step")
    n = 0
    for row in sorted(ordered.groupBy(step).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):
        n += row.n
        if n >= FIRST_ROWS:
            return 2.0 ** (row.step / STEPS) / SLACK
    return 0.0


def _block_results(given: DataFrame, queries: DataFrame, block_path: str, k: int, scratch: Scratch) -> list[DataFrame]:
    """Partial lists of one block; ``queries``: query and norm, of those with terms."""
    vectors = in_arrow(given, _vectors(block_path), "doc_key long, unnamed boolean, n long, terms array<int>, times array<int>").where("n > 0")
    vectors = scratch.table(vectors, "term-vectors")
    n_docs, n_words = vectors.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not n_docs:
        return []
    scratch.table(vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")), "term-counts")
    stats = scratch.paths[-1], n_docs, n_words
    known = in_arrow(vectors, _lengths(*stats), "norm double, doc_key long, unnamed boolean, n long, terms array<int>, times array<int>")
    # vectors of equal length are dealt to several ranges
    marked = known.withColumn("__mark", F.xxhash64("doc_key", F.monotonically_increasing_id()))
    order = F.col("norm").desc(), F.col("__mark")
    ordered = scratch.table(marked.repartitionByRange(*order).sortWithinPartitions(*order).drop("__mark"), "by-length")
    cut = _cut(ordered)
    found = lambda rows, thresholds: in_arrow(rows, _search(block_path, *stats, k, thresholds), _FOUND)
    first = scratch.table(_merged(found(ordered.where(F.col("norm") >= cut), None), k), "first-bucket")
    scratch.table(first.where(F.col("rank") == k).select("query", "score"), "thresholds")
    at = scratch.paths[-1]
    reached = queries.join(first.where(F.col("rank") == k), "query", "left")
    least = reached.agg(F.min(F.coalesce("score", F.lit(0)) / F.col("norm"))).first()[0] or 0.0
    rest = ordered.where((F.col("norm") < cut) & (F.col("norm") >= least / SLACK))
    return [first.drop("rank"), scratch.table(found(rest, at), "other-buckets")]


def ranked(items: DataFrame, docs: DataFrame, k: int = TOP) -> DataFrame:
    """``items`` (item_id, text) against ``docs`` (doc_id, text) → item_id, rank, doc_id,
    score: of each item the ``k`` documents of highest score."""
    spark = docs.sparkSession
    blocks = fresh_path(spark, "query-blocks")
    with Scratch(spark) as scratch:
        numbered = scratch.table(items.select("item_id", "text", F.monotonically_increasing_id().alias("query")), "queries")
        size = numbered.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
        n_blocks = 1 + size // BLOCK_BYTES
        block = F.pmod(F.xxhash64("query"), F.lit(n_blocks)).alias("block")
        prepared = numbered.select(F.coalesce("text", F.lit("")).alias("text"), "query", block).groupBy("block").applyInArrow(_prepared(blocks), "query long, norm double, block long")
        prepared = scratch.table(prepared, "query-norms").where("norm > 0")
        given = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE)).alias("doc_key"), F.col("doc_id").isNull().alias("unnamed"), "text")
        parts: list[DataFrame] = []
        for b in sorted(r.block for r in prepared.select("block").distinct().collect()):
            parts += _block_results(given, prepared.where(F.col("block") == b), f"{blocks}/{b}.block", k, scratch)
        if not parts:
            parts = [spark.createDataFrame([], _FOUND)]
        best = parts[0]
        for part in parts[1:]:
            best = best.unionByName(part)
        named = _merged(best, k).join(numbered.select("query", "item_id"), "query")
        out = materialize(named.select("item_id", F.col("rank").cast("int").alias("rank"), F.when(~F.col("unnamed"), F.col("doc_key")).alias("doc_id"), "score"), "ranked")
    remove(spark, blocks)
    return out


def op11_lexical_search(spark, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents").select("doc_id", "text"))


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}') AS words FROM documents),
b AS (SELECT row_number() OVER () AS query, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}') AS words FROM benchmark),
s AS (SELECT count(*) AS n_docs, sum(len(words))::BIGINT AS n_words FROM d WHERE len(words) > 0),
q AS (SELECT query, item_id, unnest(words) AS term FROM b),
t AS (SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, len(words) AS n, unnest(words) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor({WEIGHT_SCALE} * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM t, s GROUP BY term),
i AS (
  SELECT row, doc_id, term, w * (({SHARE_SCALE} * tf) // (1000 * tf + {SATURATION} * ({100 - LENGTH_SHARE} + ({LENGTH_SHARE} * n * n_docs) // n_words))) AS impact FROM t JOIN w USING (term), s),
r AS (
  SELECT query, any_value(item_id) AS item_id, row, any_value(doc_id) AS doc_id, sum(impact)::BIGINT AS score FROM q JOIN i USING (term) GROUP BY query, row HAVING sum(impact) > 0)
SELECT item_id, rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM r) WHERE rank <= {TOP}
"""
