"""Repeatable class-balanced folds, of single entities or of whole groups of them."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import kept

#: Rows of one key in a bucket, on average.
ROWS_PER_BUCKET = 100_000
#: Kinds of groups that are shared out by their classes, on the driver, at most.
MAX_KINDS = 100_000
#: Weight of the largest class, in the cost of a fold.
_UNIT = 10**6


def _numbered(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``rows`` with i: their number from 1 within ``keys``, by the hexadecimal ``mark`` and
    ``order``. Numbers are counted per bucket of the mark first, so that no task has to
    sort all rows of a key."""
    n_buckets = 1 + rows.count() // ROWS_PER_BUCKET
    bucket = F.shiftright(F.conv(F.substring("mark", 1, 8), 16, 10).cast("long") * n_buckets, 32).cast("int")
    rows = rows.withColumn("bucket", bucket)
    before = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select(*keys, "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy(*keys, "bucket").orderBy("mark", *order)
    met = rows.withColumn("at", F.row_number().over(inside)).join(offsets, [*keys, "bucket"])
    return met.withColumn("i", F.col("at") + F.col("offset")).drop("bucket", "at", "offset")


def stratified_folds(feat: DataFrame, k: int) -> DataFrame:
    """entity_id, label, fold: entities of a class are numbered by md5 of their id and
    dealt round."""
    rows = feat.select("entity_id", "label", F.md5(F.col("entity_id").cast("string")).alias("mark"))
    return _numbered(rows, ["label"], ["entity_id"]).select("entity_id", "label", ((F.col("i") - 1) % k).cast("int").alias("fold"))


def with_folds(feat: DataFrame, k: int) -> DataFrame:
    return feat.join(stratified_folds(feat, k).select("entity_id", "fold"), "entity_id")


def shares(kinds: Iterable[tuple[dict[int, int], int]], totals: dict[int, int], k: int) -> list[list[int]]:
    """How many groups of each kind every fold gets. A kind is the entities of a group by
    class, and the number of groups that are like it.

    Groups go one by one to the fold that holds least of their classes, each class weighed
    by the inverse square of its size (the largest by ``_UNIT``); of equal ones to that of fewest entities, then to the
    first. A further group of a kind raises a fold's cost by always the same, so all but the
    last few of a kind are dealt at once, up to a common level. All in integers."""
    weight = {c: _UNIT * max(totals.values()) ** 2 // (n * n) for c, n in totals.items()}
    held, sizes, out = [dict.fromkeys(totals, 0) for _ in range(k)], [0] * k, []
    for counts, n in kinds:
        size, step = sum(counts.values()), sum(x * x * weight[c] for c, x in counts.items())
        cost = [sum(x * h[c] * weight[c] for c, x in counts.items()) for h in held]
        below = lambda level: [max(0, -((c - level) // step)) for c in cost]  # noqa: B023, E731
        low, high = min(cost), max(cost) + step * (n + 1)
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if sum(below(mid)) <= n else (low, mid)
        given = below(low)
        for _ in range(n - sum(given)):
            given[min(range(k), key=lambda f: (cost[f] + given[f] * step, sizes[f] + given[f] * size, f))] += 1  # noqa: B023
        for f in range(k):
            sizes[f] += given[f] * size
            for c, x in counts.items():
                held[f][c] += given[f] * x
        out.append(given)
    return out


def grouped_folds(feat: DataFrame, groups: DataFrame, k: int) -> DataFrame:
    """entity_id, label, group, fold: all entities of a group are in one fold, and the folds
    hold about as many of each class. ``groups``: entity_id, group.

    Groups with the same number of entities of every class are of one kind. Kinds, the
    largest groups first, are shared out to the folds by ``shares`` over a summary of one
    row for each; the groups of a kind go to its folds by md5 of the group. The summary has
    ``MAX_KINDS`` rows at most; groups of further kinds, which are the smallest, are dealt
    round by md5.

    Entities of a null group, or of none in ``groups``, are each a group of their own, with
    a null group in the result. Of several groups for an entity the least counts.
    """
    key = F.coalesce(F.concat(F.lit("g"), F.col("group").cast("string")), F.concat(F.lit("e"), F.col("entity_id").cast("string")))
    known = groups.groupBy("entity_id").agg(F.min("group").alias("group"))
    rows = feat.select("entity_id", "label").join(known, "entity_id", "left").withColumn("key", key)
    per = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    kinds = per.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("label", "n"))).alias("kind"), F.sum("n").alias("size"))
    kinds = kept(kinds.withColumn("mark", F.md5("key")), "groups")
    summary = kinds.groupBy("kind", "size").agg(F.count(F.lit(1)).alias("n"), F.min("mark").alias("mark"))
    largest = summary.orderBy(F.col("size").desc(), "mark").limit(MAX_KINDS).collect()
    totals: Counter = Counter()
    for r in summary.select(F.explode("kind").alias("x"), "n").groupBy("x.label").agg(F.sum(F.col("x.n") * F.col("n")).alias("n")).collect():
        totals[r.label] = r.n
    given = shares((({x.label: x.n for x in r.kind}, r.n) for r in largest), totals, k)
    bounds = [(r.mark, list(accumulate(x))) for r, x in zip(largest, given)]
    bounds = feat.sparkSession.createDataFrame(bounds, "first string, bounds array<long>")  # of a bounded summary
    first = summary.select("kind", F.col("mark").alias("first")).join(F.broadcast(bounds), "first", "left")
    met = _numbered(kinds, ["kind"], ["key"]).join(first, "kind")
    by_share = F.size(F.filter("bounds", lambda x: x < F.col("i")))
    by_number = F.pmod(F.col("i") + F.xxhash64("kind"), F.lit(k))
    folds = met.select("key", F.when(F.col("bounds").isNull(), by_number).otherwise(by_share).cast("int").alias("fold"))
    return rows.join(folds, "key").select("entity_id", "label", "group", "fold")


def with_grouped_folds(feat: DataFrame, groups: DataFrame, k: int) -> DataFrame:
    return feat.join(grouped_folds(feat, groups, k).select("entity_id", "fold"), "entity_id")
