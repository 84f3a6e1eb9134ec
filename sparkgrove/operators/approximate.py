"""Approximate nearest neighbours by cosine: hash tables of random projections, probed more than once.

A row's code in a table says on which side of ``bits`` random planes it lies. Training rows
go to the bucket of their code in each table; a query goes to its own bucket and to those of
the codes that differ in any of its ``unsure`` bits of least margin, ``2 ** unsure`` buckets a
table. Rows of a bucket are packed into blocks of bounded bytes, a crowded bucket into many,
and its blocks are spread over ``SPREAD`` join keys, so no task holds a whole bucket. Each two
blocks of queries and training rows that meet are one product of matrices, which keeps the k
nearest of every query; pairs found in several tables count once. Queries that meet fewer than
k training rows are answered exactly, so every query has k neighbours if there are k rows.

The planes follow from md5, so codes are the same in every session and on every partition.
Tables cost a copy of the training rows each, and probes a copy of the queries each, in one
shuffle. How much is found depends on the rows: near copies meet in nearly every table, rows
without near ones (all angles near 90 degrees) seldom. ``recall`` measures it against exact
neighbours.

Defined results: ids are unique and features complete (as ``read_features`` checks). A row of
zeros lies on the upper side of all planes and has the cosine 0 to all. Ties go to the lower
id. Empty queries or training rows give none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import width_of
from ..shared import kept
from .neighbours import _best, cosine, nearest

TABLES, BITS, UNSURE = 6, 8, 3
#: Bytes of the vectors of a block; join keys that the blocks of a crowded bucket have.
BLOCK_BYTES, SPREAD = 1 << 20, 32
#: Numbers of all planes at most, and buckets of all tables; they, and the buckets' sizes, go
#: to every task.
MAX_PLANES, MAX_BUCKETS = 5_000_000, 2_000_000
#: Pairs that a task gathers before it keeps the best of each query, and then holds at most.
GATHERED = 1_000_000


def planes(tables: int, bits: int, width: int) -> np.ndarray:
    """By table, bit and position 1 or -1: the first hex digit of md5(table:bit:position) is below 8 or not."""
    if tables * bits * width > MAX_PLANES:
        raise ValueError(f"planes of more than {MAX_PLANES} numbers are not sent to every task")
    low = lambda *at: hashlib.md5(":".join(map(str, at)).encode()).hexdigest()[0] < "8"
    signs = [1.0 if low(t, b, i) else -1.0 for t in range(tables) for b in range(bits) for i in range(width)]
    return np.array(signs).reshape(tables * bits, width)


def codes(margins: np.ndarray, unsure: int) -> np.ndarray:
    """Codes by row (own first): those that any of the ``unsure`` bits of least margin may turn to."""
    weights = 1 << np.arange(margins.shape[1])
    own = (margins >= 0) @ weights
    flips = weights[np.argsort(np.abs(margins), axis=1, kind="stable")[:, :unsure]]
    chosen = (np.arange(1 << flips.shape[1])[:, None] >> np.arange(flips.shape[1])) & 1
    return own[:, None] ^ (flips @ chosen.T)


def hashed(feat: DataFrame, tables: int, bits: int, unsure: int, width: int) -> DataFrame:
    """entity_id, features, bucket: a row for each table and code."""
    if not 0 <= unsure <= bits or tables << bits > MAX_BUCKETS:
        raise ValueError(f"unsure bits are some of the bits, and all tables have {MAX_BUCKETS} buckets at most")
    sides = planes(tables, bits, width)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                margins = np.stack(pdf["features"].to_numpy()).astype(float) @ sides.T
                found = [codes(margins[:, t * bits : (t + 1) * bits], unsure) + (t << bits) for t in range(tables)]
                yield pdf.assign(buckets=list(np.concatenate(found, axis=1)))

    rows = feat.select("entity_id", "features").mapInPandas(run, "entity_id long, features array<double>, buckets array<long>")
    return rows.select("entity_id", "features", F.explode("buckets").alias("bucket"))


def _blocks(rows: DataFrame, n_rows: int) -> DataFrame:
    """bucket, block, n_blocks, ids, x: the rows of each bucket in blocks of ``n_rows`` or so."""
    sizes = rows.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / n_rows).alias("n_blocks"))
    # with the sizes at hand, rows are dealt by bucket and block at once, never by bucket alone
    dealt = rows.join(F.broadcast(sizes), "bucket").withColumn("block", F.pmod(F.xxhash64("entity_id"), "n_blocks"))
    held = dealt.groupBy("bucket", "block").agg(F.first("n_blocks").alias("n_blocks"), F.collect_list(F.struct("entity_id", "features")).alias("rows"))
    return held.select("bucket", "block", "n_blocks", F.col("rows.entity_id").alias("ids"), F.flatten("rows.features").alias("x"))


def _kept_best(k: int, parts: list[pd.DataFrame]) -> pd.DataFrame:
    """Of all pairs the k nearest of each query, each pair once, ties to the lower id."""
    pairs = pd.concat(parts).drop_duplicates(["entity_id", "train_id"])
    pairs = pairs.sort_values(["entity_id", "near", "train_id"], ascending=[True, False, True])
    return pairs[pairs.groupby("entity_id").cumcount() < k]


def _products(k: int, width: int):
    """Task function: the k nearest of each query in the task's pairs of blocks, sent on once,
    or in parts where they are too many to hold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, size = [], 0
        for pdf in batches:
            for query_ids, q, ids, x in pdf.itertuples(index=False):
                near = cosine(q.reshape(-1, width), x.reshape(-1, width))
                row, at = _best(k, near, ids)
                parts.append(pd.DataFrame({"entity_id": query_ids[row], "near": near[row, at], "train_id": ids[at]}))
                size += len(row)
                if size >= GATHERED:
                    parts = [_kept_best(k, parts)]
                    size = len(parts[0])
                    if 2 * size >= GATHERED:
                        yield parts.pop()
                        size = 0
        if parts:
            yield _kept_best(k, parts)

    return run


def approximate(queries: DataFrame, train: DataFrame, k: int = 5, tables: int = TABLES, bits: int = BITS, unsure: int = UNSURE) -> DataFrame:
    """The k nearest rows of ``train`` that each of ``queries`` meets in a bucket: entity_id,
    near (cosine, rounded to 9 places), train_id, i (from 1)."""
    width = width_of(train) or width_of(queries)
    n_rows = max(16, BLOCK_BYTES // (8 * max(width, 1)))
    blocks = _blocks(hashed(train, tables, bits, 0, width), n_rows).withColumn("key", F.col("block") % SPREAD)
    blocks = kept(blocks, "buckets")  # their keys and the blocks themselves
    keys = blocks.groupBy("bucket").agg(F.least(F.first("n_blocks"), F.lit(SPREAD)).alias("n_keys"))
    asked = _blocks(hashed(queries, tables, bits, unsure, width), n_rows).select("bucket", F.col("ids").alias("query_ids"), F.col("x").alias("q"))
    asked = asked.join(F.broadcast(keys), "bucket").select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_keys") - 1)).alias("key"), "query_ids", "q")
    met = asked.join(blocks.select("bucket", "key", "ids", "x"), ["bucket", "key"]).select("query_ids", "q", "ids", "x")
    pairs = met.mapInPandas(_products(k, width), "entity_id long, near double, train_id long")
    # a pair may be found in several tables
    once = pairs.groupBy("entity_id", "train_id").agg(F.max("near").alias("near"))
    place = F.row_number().over(Window.partitionBy("entity_id").orderBy(F.col("near").desc(), "train_id"))
    found = kept(once.withColumn("i", place).where(F.col("i") <= k).select("entity_id", "near", "train_id", "i"), "met-neighbours")
    full = found.where(F.col("i") == k).select("entity_id")
    short = kept(queries.select("entity_id", "features").join(full, "entity_id", "left_anti"), "short-queries")
    if short.isEmpty():
        return found
    exact = nearest(short, train, k, cosine).select("entity_id", "near", "train_id", "i")
    return found.join(full, "entity_id", "left_semi").unionByName(exact)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """n, recall: exact neighbours (entity_id, train_id), and the share of them that was found."""
    marked = exact.select("entity_id", "train_id").join(found.select("entity_id", "train_id", F.lit(1.0).alias("hit")), ["entity_id", "train_id"], "left")
    return marked.agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall"))
