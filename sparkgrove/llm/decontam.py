"""Benchmark decontamination with suffix arrays over the training text.

Documents are taken in shards of bounded size, one shard at a time in each task. The
suffixes of a shard and of the test items are ranked together by their first 1, 2, 4, ...
words, doubling the depth up to the longest test item, so repetitive texts cost no more
passes than others. The shard's suffix array of a window's depth is bisected by the test
suffixes, which gives the places of each window of ``window`` words, and each place is then
extended to its longest verbatim match by bisecting the sorted test suffixes; the ranks of
all depths tell how many words two suffixes have in common. Blocks of test items of bounded size
(a longer item is a block of its own) are prepared once, as a job, and lie in the shared
folder, where each task loads them one after another, so a benchmark of any size passes
through bounded memory and nothing is broadcast.

Only positions that begin a run of at least one window's length of words the block
knows enter the suffix array: no other suffix can match.

Defined results: A-Z are lower-cased; words are runs of ASCII letters, digits and any
non-ASCII characters. An item of fewer words than a window, but not none, is one
window. Null texts have no words. Repeated ids count as one item; so do null ids, as an item
that is counted but not listed. A location names one item of its longest match, though others
may hold it, too. Without items nothing is hit; without documents the result is empty.
Repeated rows give a row each. Columns besides those asked for and the texts are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import fresh_path, in_arrow, pieces, table
from .storage import located, read_bytes, written
from .words import shards, words_of

WINDOW = 10
#: UTF-8 bytes of a shard (a longer document is a shard of its own); test items of a block,
#: and bytes of them.
SHARD_BYTES, BLOCK_ITEMS, BLOCK_BYTES = 2 << 20, 20_000, 8 << 20
_RESULT = [
    ("n_words", "long"), ("n_hit", "long"), ("longest_match", "long"), ("n_items", "long"), ("item_ids", "array<string>"),
    ("locations", "array<struct<start: long, n_words: long, item_id: string, item_start: long>>"),
]
_LOCATIONS = pa.list_(pa.struct([("start", pa.int64()), ("n_words", pa.int64()), ("item_id", pa.string()), ("item_start", pa.int64())]))


class Block:
    """Test items of one block: their vocabulary, words and windows."""

    def __init__(self, ids: list, texts: pa.Array, window: int):
        flat, counts = words_of(texts)
        coded = flat.dictionary_encode()
        self.vocabulary = coded.dictionary
        # word ids from 1; 0 stands for any other word and for the space between texts
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
        self.longest = int(counts.max(initial=0))
        parts, starts, lengths, owner, firsts, at = [], [], [], [], [], 0
        first = np.concatenate([[0], np.cumsum(counts)])
        for i, n in enumerate(counts):
            firsts.append(at)
            if n:
                starts.append(at + np.arange(max(1, n - window + 1)))
                lengths.append(np.full(len(starts[-1]), min(n, window)))
                owner.append(np.full(len(starts[-1]), i))
                parts += [codes[first[i] : first[i] + n], [0]]
                at += n + 1
        self.words = np.concatenate(parts).astype(np.int64) if parts else np.zeros(1, np.int64)
        self.firsts = np.array(firsts, np.int64)
        starts, lengths, owner = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, lengths, owner))
        self.ids = [None if x is None else str(x) for x in ids]
        self.shortest = int(lengths.min(initial=window))
        # one representative of equal windows; the items of each window
        seen: dict[bytes, int] = {}
        window_of = np.array([seen.setdefault(self.words[s : s + n].tobytes(), len(seen)) for s, n in zip(starts, lengths)], np.int64)
        _, keep = np.unique(window_of, return_index=True)
        self.query, self.query_length = starts[keep], lengths[keep]
        order = np.argsort(window_of, kind="stable")
        self.items = owner[order]
        self.item_bounds = np.searchsorted(window_of[order], np.arange(len(keep) + 1))


class Ranks:
    """Order of the suffixes of ``words`` by their first 1, 2, 4, ... words, up to ``depth``
    of them; each suffix ends with the first 0, before any other word."""

    def __init__(self, words: np.ndarray, depth: int):
        zeros = np.flatnonzero(words == 0)
        self.left = zeros[np.searchsorted(zeros, np.arange(len(words)))] - np.arange(len(words))
        self.levels, n = [words.astype(np.int32)], 1
        while n < min(depth, int(self.left.max(initial=0))):
            self.levels.append(np.unique(self.of(2 * n), return_inverse=True)[1].astype(np.int32))
            n *= 2

    def of(self, n: int) -> np.ndarray:
        """Numbers in the order of the first ``n`` words of each suffix, which has no level of
        its own: by two levels that overlap, or meet."""
        k = min(len(self.levels), (n - 1).bit_length()) - 1 if n > 1 else 0
        rank, step = self.levels[k].astype(np.int64), n - (1 << k)
        if n == 1:
            return rank
        second = np.zeros(len(rank), np.int64)
        longer = np.flatnonzero(self.left >= step)
        second[longer] = rank[longer + step]
        return rank * (int(rank.max(initial=0)) + 1) + second

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that the suffixes at ``a`` and ``b`` have in common."""
        most = np.minimum(self.left[a], self.left[b])
        n = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            for _ in range(2 if k == len(self.levels) - 1 else 1):
                more = np.flatnonzero(n < most)
                n[more] += (self.levels[k][a[more] + n[more]] == self.levels[k][b[more] + n[more]]).astype(np.int64) << k
        return np.minimum(n, most)


def _repeat(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each range its number, and all positions in it."""
    n = last - first
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[which]


class Found(NamedTuple):
    """By document: words, words hit, the longest match, item ids, locations."""

    words: np.ndarray
    hit: np.ndarray
    longest: np.ndarray
    items: list[set]
    locations: list[list[tuple]]


def _shard(texts: pa.Array, blocks: Iterator[Block]) -> Found:
    flat, counts = words_of(texts)
    # a zero after each document, so that nothing matches across two of them
    at = np.arange(len(flat)) + np.repeat(np.arange(len(counts)), counts)
    doc_of = np.repeat(np.arange(len(counts)), counts + 1)
    size = len(flat) + len(counts)
    hit, longest, items = np.zeros(size, bool), np.zeros(len(counts), np.int64), [set() for _ in counts]
    matches: list[tuple] = []
    for block in blocks:
        if not len(block.query) or not len(flat):
            continue
        words = np.zeros(size, np.int64)
        words[at] = pc.fill_null(pc.index_in(flat, value_set=block.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        # runs of known words that can hold a window, a zero after each; no other suffix can match
        unknown = np.concatenate([[-1], np.flatnonzero(words == 0)])
        run = np.diff(unknown) - 1
        _, kept = _repeat(unknown[:-1][run >= block.shortest] + 1, unknown[1:][run >= block.shortest] + 1)
        n_kept = len(kept)
        ranks = Ranks(np.concatenate([words[kept], block.words]), block.longest)
        which, places = [], []
        for n in np.unique(block.query_length).tolist():
            number = ranks.of(n)
            shard = np.flatnonzero(ranks.left[:n_kept] >= n)
            shard = shard[np.argsort(number[shard], kind="stable")]  # the suffix array of this depth
            queries = np.flatnonzero(block.query_length == n)
            wanted = number[n_kept + block.query[queries]]
            found, place = _repeat(*(np.searchsorted(number[shard], wanted, side=side) for side in ("left", "right")))
            which.append(queries[found])
            places.append(shard[place])
        which, places = np.concatenate(which), np.concatenate(places)
        if not len(which):
            continue
        length = block.query_length[which]
        # longest match of each place: with its neighbours among the sorted test suffixes
        spots = np.unique(places)
        last = ranks.of(block.longest)
        tests = n_kept + np.flatnonzero(block.words)
        tests = tests[np.argsort(last[tests], kind="stable")]
        near = np.searchsorted(last[tests], last[spots])
        best, best_at = np.zeros(len(spots), np.int64), np.zeros(len(spots), np.int64)
        for side in (near, near - 1):
            other = tests[np.clip(side, 0, len(tests) - 1)]
            common = np.where((side >= 0) & (side < len(tests)), ranks.common(spots, other), 0)
            best_at = np.where(common > best, other - n_kept, best_at)
            best = np.maximum(best, common)
        places, spots = kept[places], kept[spots]
        np.maximum.at(longest, doc_of[spots], best)
        owner = np.searchsorted(block.firsts, best_at, side="right") - 1
        matches += zip(spots.tolist(), best.tolist(), [block.ids[i] for i in owner.tolist()], (best_at - block.firsts[owner]).tolist())
        edge = np.zeros(size + block.longest + 1, np.int64)
        np.add.at(edge, places, 1)
        np.add.at(edge, places + length, -1)
        hit |= np.cumsum(edge)[:size] > 0
        pairs = np.unique(np.stack([doc_of[places], which], axis=1), axis=0)
        owner, spot = _repeat(block.item_bounds[pairs[:, 1]], block.item_bounds[pairs[:, 1] + 1])
        for doc, item in np.unique(np.stack([pairs[owner, 0], block.items[spot]], axis=1), axis=0).tolist():
            items[doc].add(block.ids[item])
    first, locations, end = np.cumsum(counts + 1) - counts - 1, [[] for _ in counts], 0
    # of all blocks' matches those that no other one holds
    for spot, n, item, item_start in sorted(matches, key=lambda m: (m[0], -m[1], m[2] is None, m[2] or "", m[3])):
        if spot + n > end:
            end, doc = spot + n, doc_of[spot]
            locations[doc].append((int(spot - first[doc]), n, item, item_start))
    return Found(counts, np.bincount(doc_of[hit], minlength=len(counts)), longest, items, locations)


def _prepare(path: str, window: int):
    """Task function: blocks of the task's items, written to ``path``; a row for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context, n = TaskContext.get(), 0
        for batch in batches:
            for rows in (batch.slice(at, BLOCK_ITEMS) for at in range(0, batch.num_rows, BLOCK_ITEMS)):
                for part in pieces(rows, 1, BLOCK_BYTES):
                    name = f"{context.partitionId():06d}-{n:06d}.block"
                    with written(f"{path}/{name}", str(context.taskAttemptId())) as out:
                        out.write(pickle.dumps(Block(part.column(0).to_pylist(), part.column(1), window), protocol=5))
                    n += 1
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([part.num_rows], pa.int64())], names=["name", "n"])

    return run


def prepared(items: DataFrame, window: int = WINDOW) -> str:
    """Prepares ``items`` (item_id, text) as blocks in the shared folder; returns their
    folder, which lists them in ``names``."""
    spark = items.sparkSession
    path = fresh_path(spark, "test-items")
    items.select("item_id", "text").write.parquet(f"{path}/items")
    given = spark.read.parquet(f"{path}/items")  # small files are read together
    in_arrow(given, _prepare(f"{path}/blocks", window), "name string, n long").write.parquet(f"{path}/names")
    return path


def _blocks(path: str) -> Iterator[Block]:
    from pyarrow import dataset

    store, at = located(f"{path}/names")
    for name in sorted(dataset.dataset(at, filesystem=store, format="parquet").to_table(columns=["name"]).column(0).to_pylist()):
        yield pickle.loads(read_bytes(f"{path}/blocks/{name}"))


def _scan(path: str, n_kept: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only: list[Block] = []  # a benchmark of one block is loaded once for the task

        def blocks() -> Iterator[Block]:
            if only:
                yield from only
                return
            n = 0
            for block in _blocks(path):
                n += 1
                last = block
                yield block
            if n == 1:
                only.append(last)

        for part in shards(batches, n_kept, SHARD_BYTES):
            found = _shard(part.column(n_kept), blocks())
            numbers = [found.words, found.hit, found.longest, np.array([len(x) for x in found.items], np.int64)]
            ids = pa.array([sorted(x - {None}) for x in found.items], pa.list_(pa.string()))
            places = pa.array([[dict(zip(("start", "n_words", "item_id", "item_start"), m)) for m in x] for x in found.locations], _LOCATIONS)
            columns = [part.column(i) for i in range(n_kept)] + [pa.array(x.astype(np.int64)) for x in numbers] + [ids, places]
            yield pa.RecordBatch.from_arrays(columns, names=names)
        pa.default_memory_pool().release_unused()  # the worker goes on to other tasks

    return run


def contamination(docs: DataFrame, items: DataFrame, keep: list[str], window: int = WINDOW, prefix: str = "") -> DataFrame:
    """``docs`` (``keep``..., text) against ``items`` (item_id, text) → the kept columns,
    n_words, n_hit, longest_match, n_items, item_ids and locations, each with ``prefix``.
    Locations are the maximal verbatim matches of a window and more: the document's word
    they start at and their length, an item and its word they start at."""
    path = prepared(items, window)
    names = [f"c{i}" for i in range(len(keep))] + [n for n, _ in _RESULT]
    given = docs.select([F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)] + [F.col("text")])
    schema = docs.sparkSession.createDataFrame([], ", ".join(f"{n} {kind}" for n, kind in _RESULT)).schema
    schema = StructType([*given.drop("text").schema, *schema])
    return in_arrow(given, _scan(path, len(keep), names), schema).toDF(*keep, *[prefix + n for n, _ in _RESULT])


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that hold no window of any item, with their own columns."""
    marked = contamination(docs, items, docs.columns, window, prefix="__decontam_")
    return marked.where("__decontam_n_hit = 0").select([F.col(f"`{c}`") for c in docs.columns])


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit", "longest_match", "n_items",
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "locations",
    )
