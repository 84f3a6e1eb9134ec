"""Features of entities from finer observations: the cells of a tumour, say.

Cells are (entity_id, kind, value). Counts, shares and entropy come from one aggregate by
entity and kind. Quantiles are exact, by bucketed counting: the values of an entity are
counted in equal buckets between its least and its largest one, the bucket that holds the
wanted rank is counted again in finer buckets, and what few values are left are sorted. Every
step is an aggregate with partial sums, so one entity may hold most of the table and is
still counted by all tasks; entities of few cells are sorted at once.

Cells without an entity take no part. Cells without a kind count as cells and have no share;
null, NaN and infinite values have no quantile and no mean. Entities without any such value
have null ones. An empty table gives no entities.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import kept

#: Values that are sorted in one place at most, and buckets of a count.
LEAF, BUCKETS = 4096, 1024
#: Kinds at most; each has columns of its own.
MAX_KINDS = 1000
QUARTILES = (0.25, 0.5, 0.75)


def _values(cells: DataFrame) -> DataFrame:
    v = F.col("value").cast("double")
    return cells.where(F.col("entity_id").isNotNull() & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))).select("entity_id", (v + 0.0).alias("v"))


def _wanted(n: Column, probs: Sequence[float]) -> Column:
    """For each probability its two neighbouring ranks, from 0, and the way between them."""
    each = []
    for i, p in enumerate(probs):
        place = (n - 1) * F.lit(float(p))
        low = F.floor(place)
        each.append(F.struct(F.lit(i).alias("i"), low.alias("rank"), F.least(low + 1, n - 1).alias("above"), (place - low).alias("way")))
    return F.array(*each)


def _between(low: Column, high: Column, way: Column) -> Column:
    # halves where the difference of two doubles is none
    rest = F.when(high - low == float("inf"), (high / 2 - low / 2) * way * 2).otherwise((high - low) * way)
    return F.when(way == 0, low).otherwise(low + rest)


def order_statistics(values: DataFrame, wanted: DataFrame) -> DataFrame:
    """``values`` (entity_id, v), ``wanted`` (entity_id, rank from 0, n, low, high: the count
    and extremes of the entity's values) → entity_id, rank, v: the values of these ranks.
    The wanted ones are looked for in intervals that shrink until they hold ``LEAF`` values
    or a single one."""
    open_ = wanted.select("entity_id", "rank", F.col("rank").alias("inside"), "n", "low", "high")
    found = None
    while True:
        open_ = kept(open_, "wanted-ranks")
        done = open_.where(F.col("low") == F.col("high")).select("entity_id", "rank", F.col("low").alias("v"))
        few = open_.where((F.col("low") < F.col("high")) & (F.col("n") <= LEAF))
        held = _held(values, few).groupBy("entity_id", "low", "high").agg(F.sort_array(F.collect_list("v")).alias("vs"))
        picked = few.join(held, ["entity_id", "low", "high"]).select("entity_id", "rank", F.get("vs", F.col("inside").cast("int")).alias("v"))
        part = done.unionByName(picked)
        found = part if found is None else found.unionByName(part)
        many = open_.where((F.col("low") < F.col("high")) & (F.col("n") > LEAF))
        if many.isEmpty():
            return found
        v, low, high = F.col("v"), F.col("low"), F.col("high")
        at = F.when(high - low == float("inf"), (v / 2 - low / 2) / (high / 2 - low / 2)).otherwise((v - low) / (high - low))
        bucket = F.least(F.floor(at * BUCKETS), F.lit(BUCKETS - 1)).alias("bucket")
        counts = _held(values, many).groupBy("entity_id", "low", "high", bucket).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("least"), F.max("v").alias("most"))
        before = Window.partitionBy("entity_id", "low", "high").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # BUCKETS rows
        counts = counts.withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0)))
        hit = (F.col("inside") >= F.col("before")) & (F.col("inside") < F.col("before") + F.col("c"))
        open_ = many.join(counts, ["entity_id", "low", "high"]).where(hit).select(
            "entity_id", "rank", (F.col("inside") - F.col("before")).alias("inside"), F.col("c").alias("n"), F.col("least").alias("low"), F.col("most").alias("high")
        )


def _held(values: DataFrame, wanted: DataFrame) -> DataFrame:
    """The values within the wanted intervals of their entity, once for each interval."""
    spans = wanted.select("entity_id", "low", "high").distinct()
    return values.join(spans, "entity_id").where((F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high")))


def quantiles(cells: DataFrame, probs: Sequence[float] = QUARTILES) -> DataFrame:
    """entity_id, quantiles: an array by probability, interpolated between neighbouring values."""
    values = _values(cells)
    sizes = kept(values.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")), "sizes")
    # few cells: sorted as they are
    small = values.join(sizes.where(F.col("n") <= LEAF).select("entity_id"), "entity_id").groupBy("entity_id").agg(F.sort_array(F.collect_list("v")).alias("vs"))
    at = lambda x: F.get("vs", x.cast("int"))
    small = small.select("entity_id", F.transform(_wanted(F.size("vs"), probs), lambda w: _between(at(w["rank"]), at(w["above"]), w["way"])).alias("quantiles"))
    large = sizes.where(F.col("n") > LEAF).select("*", F.explode(_wanted(F.col("n"), probs)).alias("w"))
    ranks = large.select("entity_id", F.explode(F.array("w.rank", "w.above")).alias("rank"), "n", "low", "high").distinct()
    found = order_statistics(values, ranks)
    both = large.select("entity_id", "w.*").join(found, ["entity_id", "rank"])
    both = both.join(found.select("entity_id", F.col("rank").alias("above"), F.col("v").alias("next")), ["entity_id", "above"])
    made = both.select("entity_id", "i", _between(F.col("v"), F.col("next"), F.col("way")).alias("q"))
    packed = F.transform(F.array_sort(F.collect_list(F.struct("i", "q"))), lambda x: x["q"])  # one for each probability
    return small.unionByName(made.groupBy("entity_id").agg(packed.alias("quantiles")))


def cell_features(cells: DataFrame, probs: Sequence[float] = QUARTILES) -> DataFrame:
    """A row for each entity: entity_id, n_cells, n_kinds, entropy (of the kinds' shares, in
    nats), n_<kind>, share_<kind> and mean_<kind> for each kind, and q_<percent> for each
    probability, percents with p for a point."""
    v = F.col("value").cast("double")
    usable = F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)
    known = cells.where(F.col("entity_id").isNotNull()).select("entity_id", F.col("kind").cast("string").alias("kind"), usable.alias("v"))
    per = kept(known.groupBy("entity_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("m")), "kinds")
    kinds = sorted(r.kind for r in per.where("kind IS NOT NULL").select("kind").distinct().limit(MAX_KINDS + 1).collect())
    if len(kinds) > MAX_KINDS:
        raise ValueError(f"more than {MAX_KINDS} kinds of cells")
    n_known = F.sum(F.when(F.col("kind").isNotNull(), F.col("n")))
    # of counts: ln(N) - sum(n ln n) / N
    spread = F.sum(F.when(F.col("kind").isNotNull(), F.col("n") * F.log("n")))
    columns = [F.sum("n").alias("n_cells"), F.count("kind").alias("n_kinds"), (F.log(n_known) - spread / n_known).alias("entropy")]
    for kind in kinds:
        own = F.col("kind") == kind
        count = F.coalesce(F.sum(F.when(own, F.col("n"))), F.lit(0))
        columns += [count.alias(f"n_{kind}"), (count / n_known).alias(f"share_{kind}"), F.max(F.when(own, F.col("m"))).alias(f"mean_{kind}")]
    named = [F.get("quantiles", F.lit(i)).alias("q_" + f"{100 * p:g}".replace(".", "p")) for i, p in enumerate(probs)]
    return per.groupBy("entity_id").agg(*columns).join(quantiles(cells, probs), "entity_id", "left").select("*", *named).drop("quantiles")


def as_features(wide: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Columns of ``cell_features`` (by default all but the id) as a feature table, entity_id
    and features, which may have missing elements."""
    columns = [c for c in wide.columns if c != "entity_id"] if columns is None else columns
    return wide.select("entity_id", F.array(*[F.col(f"`{c}`").cast("double") for c in columns]).alias("features"))
