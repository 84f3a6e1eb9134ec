"""Nearest training rows of query rows, by products of blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import fresh_path

#: Bytes of training vectors that a task holds while it reads the queries once.
BLOCK_BYTES = 32 << 20
#: Training rows of one product.
SLICE = 2048
#: Groups of blocks whose lists meet before all of a query do.
NODES = 64
#: Nearness of query rows to training rows, as a matrix; NaN or minus infinity is none.
Nearness = Callable[[np.ndarray, np.ndarray], np.ndarray]


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def cosine(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosine, rounded to 9 places."""
    return np.round(unit(q) @ unit(x).T, 9)


def over_shared(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Minus the mean squared difference over the elements that both rows have (the others
    are NaN), rounded to 9 places; none where they share no element."""
    known = ~np.isnan(x)
    n = known.sum(axis=0)
    centre = np.where(n > 0, np.where(known, x, 0).sum(axis=0) / np.maximum(n, 1), 0)  # for small numbers to square
    (a, in_a), (b, in_b) = ((np.nan_to_num(v - centre), (~np.isnan(v)).astype(float)) for v in (q, x))
    shared = in_a @ in_b.T
    total = (a * a) @ in_b.T + in_a @ (b * b).T - 2 * a @ b.T
    return np.where(shared > 0, -np.round(np.maximum(total, 0) / np.maximum(shared, 1), 9), -np.inf)


def _best(k: int, near: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k nearest in each row, ties to the lower id."""
    near = np.nan_to_num(near, nan=-np.inf, neginf=-np.inf)
    least = np.partition(near, -min(k, near.shape[1]), axis=1)[:, -min(k, near.shape[1]), None]
    row, at = np.nonzero((near >= least) & (near > -np.inf))  # with all ties of the last one
    order = np.lexsort((ids[at], -near[row, at], row))
    row, at = row[order], at[order]
    best = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[best], at[best]


def _of_slices(k: int, nearness: Nearness, ids: np.ndarray, q: np.ndarray, train_ids: np.ndarray, x: np.ndarray, others: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``q``, rows of ``x`` and nearness of the k nearest of each query: the best of
    each slice of ``x``, then of all slices, so that no matrix is wider than a slice."""
    rows, ats, nears = [], [], []
    for start in range(0, len(x), SLICE):
        part = slice(start, start + SLICE)
        near = nearness(q, x[part])
        if others:
            near[ids[:, None] == train_ids[part]] = -np.inf
        row, at = _best(k, near, train_ids[part])
        rows.append(row)
        ats.append(at + start)
        nears.append(near[row, at])
    row, at, near = (np.concatenate(v) for v in (rows, ats, nears))
    order = np.lexsort((train_ids[at], -near, row))
    row, at, near = row[order], at[order], near[order]
    best = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[best], at[best], near[best]


def _partial(tiles: str, k: int, nearness: Nearness, others: bool, carry: list[str], tile_rows: int, product: int):
    """Task function: for each block of the task's training rows, the k nearest to every query."""

    def found(block: int, parts: list[pd.DataFrame], vectors: list[np.ndarray]) -> Iterator[pd.DataFrame]:
        from pyarrow import dataset

        held, x = pd.concat(parts), np.concatenate(vectors)
        vectors.clear()
        train_ids, kept = held["entity_id"].to_numpy(), [held[c].to_numpy() for c in carry]
        for tile in dataset.dataset(tiles, format="parquet").to_batches(batch_size=tile_rows, batch_readahead=1, fragment_readahead=1):
            step = max(1, product // min(len(x), SLICE))
            for part in (tile.slice(at, step) for at in range(0, tile.num_rows, step)):
                ids = part.column("entity_id").to_numpy()
                q = part.column("features").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
                row, at, near = _of_slices(k, nearness, ids, q, train_ids, x, others)
                named = {c: v[at] for c, v in zip(carry, kept)}
                yield pd.DataFrame({"entity_id": ids[row], "near": near, "train_id": train_ids[at], **named, "block": block})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        block, parts, vectors, size = TaskContext.get().partitionId(), [], [], 0
        for pdf in batches:
            if len(pdf):
                # vectors as one array, not as an object for each row
                vectors.append(np.stack(pdf["features"].to_numpy()).astype(float, copy=False))
                parts.append(pdf.drop(columns="features"))
                size += vectors[-1].nbytes
            if size >= BLOCK_BYTES:
                yield from found(block, parts, vectors)
                block, parts, vectors, size = block + 1, [], [], 0
        if parts:
            yield from found(block, parts, vectors)

    return run


def nearest(
    queries: DataFrame, train: DataFrame, k: int, nearness: Nearness, carry: list[str] = (), others: bool = False, tile_rows: int = 20_000, product: int = 1_000_000
) -> DataFrame:
    """The k nearest rows of ``train`` for each of ``queries``: entity_id, near, train_id,
    the columns ``carry`` of the training row, i (from 1). Ties go to the lower id; with
    ``others`` a query does not meet the row of its own id.

    Queries lie in the shared folder, and each task reads them once for every
    ``BLOCK_BYTES`` of its training rows. A block gives k rows for each query; lists of
    several blocks meet in groups, then all of a query, and each step keeps k."""
    carry = list(carry)
    tiles = fresh_path(queries.sparkSession, "query-tiles")
    queries.select("entity_id", "features").write.option("maxRecordsPerFile", 64 * tile_rows).parquet(tiles)
    kinds = dict(train.dtypes)
    schema = ", ".join(["entity_id long", "near double", "train_id long", *[f"{c} {kinds[c]}" for c in carry], "block long"])
    parts = train.select("entity_id", "features", *carry).mapInPandas(_partial(tiles, k, nearness, others, carry, tile_rows, product), schema)
    order = F.col("near").desc(), "train_id"
    parts = parts.withColumn("node", F.col("block") % NODES)
    parts = parts.withColumn("i", F.row_number().over(Window.partitionBy("entity_id", "node").orderBy(*order))).where(F.col("i") <= k)
    parts = parts.withColumn("i", F.row_number().over(Window.partitionBy("entity_id").orderBy(*order))).where(F.col("i") <= k)
    return parts.drop("node", "block")
