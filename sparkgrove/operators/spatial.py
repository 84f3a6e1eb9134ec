"""Neighbourhoods in the plane: how many points of each kind lie within a radius.

Points are (entity_id, x, y, kind). Points of equal place and kind are counted first. The
plane is cut into square cells of twice the radius; a place is looked up in its own cell
only, and copied, as a neighbour, to the cells that its disc touches, one to four. Places of
a cell are split into parts of ``PART``, its neighbours into parts of ``NEAR``, and each two
parts meet in one task. There the places are cut into boxes of some ``BOX`` places: a box of
neighbours that lies within the radius of a whole box of places is added as a count, one
that lies beyond is left out, and only the boxes between are compared place by place, in
matrices. So a pair is never a row. Tasks are as many as the pairs ask for, whatever the
bytes: few bytes may be much work.

Defined results: points with a null id, or a null, NaN or infinite coordinate, take no part.
A null kind is a kind. A point is not its own neighbour, but those at the same place are;
the radius is included. Repeated ids are points of their own. An empty table gives nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import kept

#: Places of a cell that one task looks up, and neighbours that it looks among.
PART, NEAR = 8192, 65_536
#: Places of a box, roughly; numbers of a matrix of neighbours and kinds, or of places and
#: neighbours, at most.
BOX, MATRIX = 32, 2_000_000
#: Pairs of places and neighbours for each task, roughly; tasks at most.
TASK_PAIRS, MAX_TASKS = 20_000_000, 10_000


def _cells(x: Column, side: float) -> Column:
    return F.floor(x / side)


def _usable(points: DataFrame) -> DataFrame:
    x, y = (F.col(c).cast("double") for c in ("x", "y"))
    fit = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return points.where(F.col("entity_id").isNotNull() & fit(x) & fit(y)).select("entity_id", (x + 0.0).alias("x"), (y + 0.0).alias("y"), "kind")


def _around(places: DataFrame, radius: float) -> DataFrame:
    """``places`` (x, y, kind, n) → x, y, kind, n: of each place that holds a point, the points
    of each kind within the radius, those at the place itself included."""
    side, far = 2 * radius, radius * (1 + 1e-9)  # a little further, for rounding
    cell = ["cx", "cy"]
    left = places.select("x", "y").distinct().withColumns({"cx": _cells(F.col("x"), side), "cy": _cells(F.col("y"), side)})
    right = places.select(F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("kind").alias("of"), F.col("n").alias("m")).withColumn("cx", _spread("ox", side, far)).withColumn("cy", _spread("oy", side, far))
    n = F.count(F.lit(1))
    sizes = left.groupBy(cell).agg(n.alias("n_left")).join(right.groupBy(cell).agg(n.alias("n_right")), cell)
    parts = (F.lit(1) + F.col("n_left") / PART).cast("long").alias("parts"), (F.lit(1) + F.col("n_right") / NEAR).cast("long").alias("near_parts")
    sizes = kept(sizes.select(*cell, *parts, (F.col("n_left") * F.col("n_right").cast("double")).alias("pairs")), "cell-sizes")
    pairs = sizes.agg(F.sum("pairs")).first()[0] or 0.0
    tasks = max(int(places.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(int(pairs / TASK_PAIRS), MAX_TASKS))
    own, every = lambda n, *place: F.pmod(F.xxhash64(*place), F.col(n)), lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    keys = [*cell, "part", "near"]
    left = left.join(sizes, cell).withColumn("part", own("parts", "x", "y")).withColumn("near", every("near_parts")).select(*keys, "x", "y")
    right = right.join(sizes, cell).withColumn("near", own("near_parts", "ox", "oy")).withColumn("part", every("parts")).select(*keys, "ox", "oy", "of", "m")
    # a number of tasks that is asked for is not lowered for want of bytes
    left, right = (side.repartition(tasks, *keys).groupBy(keys) for side in (left, right))
    kind = dict(places.dtypes)["kind"]
    met = left.cogroup(right).applyInArrow(_counted(radius), f"x double, y double, kind {kind}, n long")
    return met.groupBy("x", "y", "kind").agg(F.sum("n").alias("n"))


def _boxes(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the places that puts those of a box together, and the boxes' starts."""
    strips = max(1, round((len(x) / BOX) ** 0.5))
    order = np.argsort(x, kind="stable")
    for part in np.array_split(np.arange(len(x)), strips):
        order[part] = order[part][np.argsort(y[order[part]], kind="stable")]
    starts = [s for part in np.array_split(np.arange(len(x)), strips) if len(part) for s in range(part[0], part[-1] + 1, BOX)]
    return order, np.array(starts, dtype=int)


def _spans(v: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.minimum.reduceat(v, starts), np.maximum.reduceat(v, starts)


def _within(lx: np.ndarray, ly: np.ndarray, rx: np.ndarray, ry: np.ndarray, counts: np.ndarray, radius: float) -> Iterator[tuple]:
    """By box of places: their numbers, and the sums of ``counts`` (neighbours by kinds) within
    the radius of each. Rounding keeps order, so the boxes' bounds, computed as the distances
    are, never contradict them."""
    order, starts = _boxes(lx, ly)
    near_order, near_starts = _boxes(rx, ry)
    rx, ry, counts = rx[near_order], ry[near_order], counts[near_order]
    (rx0, rx1), (ry0, ry1), held = _spans(rx, near_starts), _spans(ry, near_starts), np.add.reduceat(counts, near_starts, axis=0)
    lengths, most = np.diff([*near_starts, len(rx)]), radius * radius
    for at in np.split(order, starts[1:]):
        x, y = lx[at], ly[at]
        x0, x1, y0, y1 = x.min(), x.max(), y.min(), y.max()
        gx, gy = (np.maximum(np.maximum(lo - b, a - hi), 0.0) for lo, hi, a, b in ((rx0, rx1, x0, x1), (ry0, ry1, y0, y1)))
        wx, wy = (np.maximum(np.abs(hi - a), np.abs(b - lo)) for lo, hi, a, b in ((rx0, rx1, x0, x1), (ry0, ry1, y0, y1)))
        whole = wx * wx + wy * wy <= most
        some = ~whole & (gx * gx + gy * gy <= most)
        made = np.repeat(held[whole].sum(axis=0)[None], len(at), axis=0)
        rows = np.flatnonzero(np.repeat(some, lengths))
        for part in np.array_split(rows, 1 + len(rows) * len(at) // MATRIX):
            dx, dy = x[:, None] - rx[part], y[:, None] - ry[part]
            made += (dx * dx + dy * dy <= most).astype(float) @ counts[part]
        yield at, made


def _counted(radius: float):
    """Group function: the places of a part and the neighbours of a part → x, y, kind, n."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = right.column("of").combine_chunks().dictionary_encode(null_encoding="encode")
        lx, ly, rx, ry, n = (t.column(c).to_numpy() for t, c in ((left, "x"), (left, "y"), (right, "ox"), (right, "oy"), (right, "m")))
        codes = kinds.indices.to_numpy(zero_copy_only=False)
        found: list[list[np.ndarray]] = [[], [], [], []]
        # as many kinds at a time as a matrix has room for
        by_kind = np.argsort(codes, kind="stable")
        step = max(1, MATRIX // max(1, len(n)))
        for first in range(0, len(kinds.dictionary) if len(lx) else 0, step):
            rows = by_kind[slice(*np.searchsorted(codes[by_kind], [first, first + step]))]
            xy, at = np.unique(np.stack([rx[rows], ry[rows]]), axis=1, return_inverse=True)
            counts = np.zeros((xy.shape[1], min(step, len(kinds.dictionary) - first)))
            np.add.at(counts, (at.ravel(), codes[rows] - first), n[rows])
            for places, made in _within(lx, ly, *xy, counts, radius):
                row, kind = np.nonzero(made)
                for held, v in zip(found, (lx[places[row]], ly[places[row]], kind + first, made[row, kind])):
                    held.append(v)
        x, y, kind, n = (np.concatenate(v) if v else np.zeros(0) for v in found)
        of = kinds.dictionary.take(pa.array(kind.astype(np.int64)))
        return pa.table({"x": pa.array(x), "y": pa.array(y), "kind": of, "n": pa.array(np.rint(n).astype(np.int64))})

    return run


def _spread(c: str, side: float, far: float) -> Column:
    """The cells along one axis that a disc around the place touches."""
    return F.explode(F.array_distinct(F.array(*[_cells(F.col(c) + d, side) for d in (-far, 0.0, far)])))


def neighbour_kinds(points: DataFrame, radius: float) -> DataFrame:
    """entity_id, kind, n: the other points of each kind within ``radius`` of each point;
    kinds without any have no row."""
    if not radius > 0:
        raise ValueError("the radius must be positive")
    points = kept(_usable(points), "points")
    places = points.groupBy("x", "y", "kind").agg(F.count(F.lit(1)).alias("n"))
    around = _around(kept(places, "places"), radius).withColumnRenamed("kind", "of")
    own = points.join(around, ["x", "y"])
    others = F.col("n") - F.when(F.col("kind").eqNullSafe(F.col("of")), 1).otherwise(0)
    return own.select("entity_id", F.col("of").alias("kind"), others.alias("n")).where("n > 0")


def neighbourhoods(points: DataFrame, radius: float) -> DataFrame:
    """A row for each point: entity_id, n_neighbours, n_same (of its own kind) and entropy of
    the neighbours' kinds, in nats, null without neighbours."""
    if not radius > 0:
        raise ValueError("the radius must be positive")
    points = kept(_usable(points), "points")
    places = points.groupBy("x", "y", "kind").agg(F.count(F.lit(1)).alias("n"))
    around = kept(_around(kept(places, "places"), radius), "around")
    # from each place's kinds, for a point of each kind that lies there
    here = points.select("x", "y", F.col("kind").alias("own")).distinct()
    others = F.col("n") - F.when(F.col("kind").eqNullSafe(F.col("own")), 1).otherwise(0)
    met = here.join(around, ["x", "y"]).withColumn("m", others)
    total, m = F.sum("m"), F.col("m")
    found = met.groupBy("x", "y", "own").agg(
        total.alias("n_neighbours"), F.sum(F.when(F.col("kind").eqNullSafe(F.col("own")), m).otherwise(0)).alias("n_same"),
        F.when(total > 0, F.log(F.nullif(total, F.lit(0))) - F.sum(F.when(m > 0, m * F.log(F.greatest(m, F.lit(1)))).otherwise(0.0)) / F.nullif(total, F.lit(0))).alias("entropy"),
    )
    same = (points["x"] == found["x"]) & (points["y"] == found["y"]) & points["kind"].eqNullSafe(found["own"])
    return points.join(found, same).select("entity_id", "n_neighbours", "n_same", "entropy")
