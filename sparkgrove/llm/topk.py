"""Exact top-k search by tiled matrix products.

The query set is stated by the caller and packed into tiles of bounded size, written
to the shared folder. Every task gathers its vectors in blocks of ``BLOCK_BYTES``, streams
the query tiles once for each block, multiplies each with the block shard by shard, and
keeps the best of the block per query. The partial lists are merged as a tree, so that no
task sees more than a fixed number of lists per query.

Scores are integer inner products, computed exactly: in doubles for all rows whose
components are small enough that n * max|q| * max|v| stays under 2**53, in longs for those
where it stays under 2**62, with Python integers for the others alone (beyond a long, scores
are clipped to its range). Scaled components beyond the largest double become that.

Defined results: vectors that are null, or hold null or non-finite components, take no
part, as queries or candidates. A vector meets only vectors of its own length; empty
vectors take no part either. Rows with a null id take no part. A query is a row of the
vectors and does not meet itself, but it meets other rows, those that repeat its id or all
of it as well. Ties go to the smaller vec_id. With fewer than k candidates all are
returned; empty tables give none. Columns besides id and vector are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, table

#: Rows of a query tile and of a shard: a tile of their products has 32 MB of doubles.
QUERY_TILE, SHARD = 1024, 4096
#: Bytes of vectors for which a task reads the query tiles once.
BLOCK_BYTES = 64 << 20
#: Lists that one node of the merge tree takes per query.
FAN_IN = 16
_LONG = 2**63 - 1


def quantized(df: DataFrame, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id, v: floor(scale * x) as doubles that are whole numbers; unfit rows go."""
    x = F.transform(F.col(vec_col), lambda c: c.cast("double") * float(scale))
    fit = F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & F.forall(
        F.col(vec_col), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf"))
    )
    return df.where(F.col(id_col).isNotNull() & F.coalesce(fit, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), x.alias("v"))


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and whole-number matrices of a batch, one for each vector length."""
    ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
    lengths = np.diff(lists.offsets.to_numpy())
    flat, first = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)[:-1]])
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        yield ids[rows], np.nan_to_num(np.floor(flat[first[rows][:, None] + np.arange(n)]))


def _scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """All inner products: in doubles for rows of small components, in longs for those of
    larger ones, in Python integers for the rest alone."""
    out = np.empty((len(q), len(v)), np.int64)
    limits = [(bound / q.shape[1]) ** 0.5 for bound in (2**53, 2**62)]
    size_q, size_v = (np.searchsorted(limits, np.abs(x).max(axis=1), side="right") for x in (q, v))
    ways = (lambda a, b: a @ b.T, lambda a, b: a.astype(np.int64) @ b.T.astype(np.int64), _exact)
    for i in range(3):
        for j in range(3):
            rows, cols = size_q == i, size_v == j
            if rows.any() and cols.any():
                out[np.ix_(rows, cols)] = ways[max(i, j)](q[rows], v[cols])
    return out


def _exact(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    whole = [[[int(x) for x in row] for row in rows] for rows in (q, v)]
    return np.array([[max(-_LONG - 1, min(_LONG, sum(a * b for a, b in zip(x, y)))) for y in whole[1]] for x in whole[0]], np.int64).reshape(len(q), len(v))


def _best(k: int, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Indices of the k best rows of each query: by score, ties to the smaller id."""
    order = np.lexsort((ids, ~score, query))
    ranked = query[order]
    place = np.arange(len(order)) - np.searchsorted(ranked, ranked, side="left")
    return order[place < k]


def _partial(k: int, ids: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, ids and scores of the k best of each row of ``scores``, more where they tie."""
    at = scores.shape[1] - k
    if at <= 0:
        rows, cols = np.indices(scores.shape).reshape(2, -1)
    else:
        rows, cols = np.nonzero(scores >= np.partition(scores, at, axis=1)[:, at, None])
    found = rows, ids[cols], scores[rows, cols]
    best = _best(k, *found)
    return found[0][best], found[1][best], found[2][best]


_PARTS = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("own", pa.int64()), ("shard", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _tiles(path: str, n_rows: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Query rows, their ids and their vectors, by vector length."""
    from pyarrow import dataset

    for tile in dataset.dataset(path, format="parquet").to_batches(columns=["query_row", "v", "id"], batch_size=n_rows):
        if tile.num_rows:
            rows, ids = tile.column(0).to_numpy(), tile.column(2).to_numpy()
            numbered = pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows))), tile.column(1)], ["id", "v"])
            for at, q in _matrices(numbered):
                yield rows[at], ids[at], q


def _search(tiles_path: str, k: int):
    def found(shard: int, held: dict[int, list]) -> Iterator[pa.RecordBatch]:
        for rows, ids, q in _tiles(tiles_path, QUERY_TILE) if held else ():
            parts = [_partial(k, part_ids, _scores(q, v)) for part_ids, v in held.get(q.shape[1], ())]
            if parts:
                at, vec_ids, score = (np.concatenate(x) for x in zip(*parts))
                best = _best(k, at, vec_ids, score)
                at = at[best]
                own = np.array([_scores(x, x)[0, 0] for x in q[:, None]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (rows[at], ids[at], own[at], np.full(len(at), shard), vec_ids[best], score[best])], schema=_PARTS
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, held, size = TaskContext.get().partitionId() * 1_000_003, defaultdict(list), 0
        for batch in batches:
            for at in range(0, batch.num_rows, SHARD):
                for ids, v in _matrices(batch.slice(at, SHARD)):
                    held[v.shape[1]].append((ids, v))
                    size += v.nbytes
                if size >= BLOCK_BYTES:
                    yield from found(shard, held)
                    shard, held, size = shard + 1, defaultdict(list), 0
        yield from found(shard, held)

    return run


def _merged(parts: DataFrame, k: int, by: list[str]) -> DataFrame:
    best = F.slice(F.sort_array(F.collect_list(F.struct(F.bitwise_not("score").alias("down"), "vec_id"))), 1, k)
    return parts.groupBy(*by).agg(best.alias("best"))


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 5) -> DataFrame:
    """``queries``, rows of ``vectors``, against ``vectors``: (id, v) from ``quantized`` →
    query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    tiles = fresh_path(spark, "query-tiles")
    queries.withColumn("query_row", F.monotonically_increasing_id()).write.option("maxRecordsPerFile", 64 * QUERY_TILE).parquet(tiles)
    # one more than asked for, since the query itself is among the vectors
    parts = vectors.mapInArrow(_search(tiles, k + 1), "query_row long, query_id long, own long, shard long, vec_id long, score long")
    # tree: lists of a group of blocks first, then the groups' lists; each node takes FAN_IN lists or so
    row = ["query_row", "query_id", "own"]
    width = vectors.agg(F.sum(8 * F.size("v"))).first()[0] or 0
    width = width // BLOCK_BYTES + vectors.rdd.getNumPartitions()
    while width > FAN_IN:
        width = -(-width // FAN_IN)
        node = F.pmod(F.xxhash64("shard"), F.lit(width)).alias("node")
        merged = _merged(parts.select(*row, node, "vec_id", "score"), k + 1, [*row, "node"])
        parts = merged.select(*row, F.col("node").alias("shard"), F.explode("best").alias("b")).select(
            *row, "shard", "b.vec_id", F.bitwise_not(F.col("b.down")).alias("score")
        )
    last = _merged(parts, k + 1, row)
    # where the query itself is on its list, any row with its id and score stands for it
    self_ = F.array_position("best", F.struct(F.bitwise_not("own").alias("down"), F.col("query_id").alias("vec_id"))).cast("int")
    others = F.filter("best", lambda b, i: i + 1 != self_)
    return last.select("query_id", F.posexplode(F.slice(others, 1, k)).alias("pos", "b")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), "b.vec_id", F.bitwise_not(F.col("b.down")).alias("score")
    )


def op3_exact_topk(spark, sf_dir: str) -> DataFrame:
    vectors = quantized(table(spark, sf_dir, "embeddings"))
    return top_k(vectors.where(F.col("id") % 50 == 0), vectors, 5)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS place, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.place, a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.place <> b.place AND len(a.q) = len(b.q))
SELECT * EXCLUDE (place) FROM (SELECT place, query_id, row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
WHERE rank <= 5
"""
