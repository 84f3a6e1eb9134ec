"""Mixing sources to target weights by weighted fair queueing.

Each source is a flow whose documents wait in a shuffled order, pass after pass. Long
documents are served in packets of at most ``PACKET`` words. A packet's virtual finish
time is the number of its source's words served when it ends, over the source's target.
All packets of all sources are range-sorted by virtual finish time into one stream, a
running sum numbers its words, and the stream is truncated where the total budget ends:
the packet being served there is cut. ``taken`` is what the stream holds of a packet
before that end, and comes from nothing else. A source may so miss its target by about a
packet; the taken words of all sources are the budget, to the word.

The running sum is made in ticks of virtual time, which hold about as many words each:
sums by tick, a running sum over the ticks, and one inside each tick. Range partitioning by
tick puts them in the stream's order. Packets past the end are not made: at virtual time 1
every source has its target, less one packet at most, so what is left of the budget then is
a packet a source, and ``reach`` bounds the words of a source that this can still buy. Later
ticks are as wide as the virtual time is long, so that there are at most some
2 * ``MAX_TICKS`` + 4,096, whatever the input.

Targets: sources by code point, null last, weigh 1, 2, 3, repeating, and share the
budget (all words); no target exceeds ``max_epochs`` times its source's size, and the
excess goes to the others by weight.

Defined results: null and empty texts have size 0 and take 0, outside the stream. Null
sources form one source. Identical (doc_id, source, size) rows are laid one after another, each with
its own place, and sorted so that reruns agree. Packets of equal finish time go by
source. An empty table gives an empty mix. Columns besides doc_id, text and source are
not read by the schedule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, n_words, table

#: Words of a packet at most.
PACKET = 256
#: Documents in one bucket of the shuffled order, on average over all sources.
ROWS_PER_BUCKET = 500
#: Packets of a tick of virtual time on average, and ticks until virtual time 1 at most.
PACKETS_PER_TICK, MAX_TICKS = 1_000, 1 << 16
#: Copies of a row that are laid at a time.
COPIES = 1 << 12


def targets(sizes: DataFrame, weights=(1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """``sizes`` (source, source_size) → source, source_size, weight, target, budget, reach.
    No packet that starts after ``reach`` words of its source is in the stream.

    The level at which the uncapped sources share what the capped ones leave is found
    by one ordered pass over the sources (one row each), not by repeated resharing.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    table = F.array(*[F.lit(float(w)) for w in weights])
    weighed = sizes.withColumn("weight", F.element_at(table, ((F.row_number().over(ordered) - 1) % len(weights) + 1).cast("int")))
    by_ratio = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    budget = F.sum("source_size").over(whole)
    level = (budget - max_epochs * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    # sources are capped from the smallest ratio on, until the level fits under the cap
    leveled = weighed.withColumns({"place": F.row_number().over(by_ratio), "level": level}).withColumn("fits", F.col("level") * F.col("weight") <= max_epochs * F.col("source_size"))
    final = F.min(F.when(F.col("fits"), F.struct("place", "level"))).over(whole)["level"]
    target = F.least(max_epochs * F.col("source_size").cast("double"), F.coalesce(final, F.lit(0.0)) * F.col("weight"))
    # what the budget still buys after time 1; sources with words until time 2 share it by target
    left = PACKET * F.count(F.lit(1)).over(whole)
    roomy = F.sum(F.when(2 * F.col("target") <= max_epochs * F.col("source_size"), F.col("target"))).over(whole)
    until = 1 + 2 * left / F.nullif(roomy, F.lit(0.0))
    reach = F.least(F.col("target") + left, F.when(until <= 2, until * F.col("target")))
    leveled = leveled.withColumns({"target": target, "budget": budget})
    return leveled.select("source", "source_size", "weight", "target", "budget", reach.alias("reach"))


def _n_packets() -> Column:
    return F.greatest(F.lit(1).cast("long"), F.ceil(F.col("size") / PACKET))


def schedule(docs: DataFrame, weights=(1, 2, 3), max_epochs: int = 3, seed: str = "mix", beyond: bool = True) -> DataFrame:
    """``docs`` (doc_id, source, size, ...) → one row per row, pass and packet: the same
    columns, source_size, target, budget, epoch, copy, packet, words, start, finish and
    tick (virtual time, fine and coarse; below 0 for what the stream cannot reach). Without
    ``beyond`` of what is out of reach only a row's first packet is made, where it is. Further
    columns tell rows apart."""
    keys, more = docs.columns, [c for c in docs.columns if c not in ("doc_id", "source", "size")]
    mark = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string")))
    same = materialize(docs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), "sizes").withColumn("mark", mark)
    n_rows, n_packets = same.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("n") * _n_packets()), F.lit(0))).first()
    n_buckets, n_ticks = 1 + n_rows // ROWS_PER_BUCKET, min(MAX_TICKS, 1 + n_packets // PACKETS_PER_TICK)
    # buckets follow the order of the marks, so their number does not change the order
    bucket = F.shiftright(F.conv(F.substring(F.col("mark"), 1, 8), 16, 10).cast("long") * n_buckets, 32).cast("int")
    same = same.withColumn("bucket", bucket)
    # running words: sums per bucket first, so that no window holds a whole source
    sums = same.groupBy("source", "bucket").agg(F.sum(F.col("size") * F.col("n")).alias("words"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("offset", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
    shares = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_epochs)
    # one row for each source and bucket
    plan = offsets.alias("o").join(shares.alias("s"), F.col("o.source").eqNullSafe(F.col("s.source"))).select(
        F.col("o.source").alias("of_source"), F.col("bucket").alias("of_bucket"), "offset", "source_size", "target", "budget", "reach"
    )
    inside = Window.partitionBy("source", "bucket").orderBy("mark", F.col("doc_id").asc_nulls_last(), "size", *more)
    placed = (
        same.withColumn("inner", F.coalesce(F.sum(F.col("size") * F.col("n")).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .join(plan, F.col("source").eqNullSafe(F.col("of_source")) & (F.col("bucket") == F.col("of_bucket")))
        .withColumn("laid", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {COPIES}"))))
        .withColumn("copy", F.explode(F.sequence(F.col("laid") * COPIES, F.least("n", (F.col("laid") + 1) * COPIES) - 1)))
        .withColumn("epoch", F.explode(F.array(*[F.lit(e) for e in range(max_epochs)])))
        .withColumn("first", F.col("epoch") * F.col("source_size") + F.col("offset") + F.col("inner") + F.col("copy") * F.col("size"))
    )
    # packets of a copy that start within reach
    within = F.when(F.col("size") > 0, F.least(_n_packets(), F.ceil((F.col("reach") - F.col("first")) / PACKET))).otherwise(0)
    placed, n_made = placed.withColumn("within", F.greatest(within, F.lit(0).cast("long"))), _n_packets()
    if not beyond:
        placed, n_made = placed.where((F.col("within") > 0) | (F.col("epoch") == 0)), F.greatest("within", F.lit(1).cast("long"))
    placed = placed.withColumn("packet", F.explode(F.sequence(F.lit(0).cast("long"), n_made - 1)))
    start = F.col("first") + F.col("packet") * PACKET
    packets = placed.withColumns({"start": start, "words": F.least(F.lit(PACKET).cast("long"), F.col("size") - F.col("packet") * PACKET)})
    finish = F.col("finish")
    ticks = F.when(finish < 2, F.floor(finish * n_ticks)).otherwise(2 * n_ticks + F.floor(F.log2(finish) * 64))
    apart = -1 - F.pmod(F.xxhash64("doc_id", "source", "copy", "start"), F.lit(MAX_TICKS))
    packets = packets.withColumn("finish", (F.col("start") + F.col("words")) / F.when(F.col("target") > 0, F.col("target")))
    packets = packets.withColumn("tick", F.when(F.col("packet") < F.col("within"), ticks).otherwise(apart))
    return packets.select(*keys, "source_size", "target", "budget", "epoch", "copy", "packet", "words", "start", "finish", "tick")


def served(packets: DataFrame) -> DataFrame:
    """The stream: ``packets`` range-sorted by virtual finish time, with ``taken``, the
    words of each that come before the total budget ends. Those out of reach lie apart."""
    ticks = packets.where("tick >= 0").groupBy("tick", "budget").agg(F.sum("words").alias("tick_words"))
    earlier = Window.orderBy("tick").rowsBetween(Window.unboundedPreceding, -1)
    reached = ticks.withColumn("before", F.coalesce(F.sum("tick_words").over(earlier), F.lit(0))).where("before < budget")
    reached = F.broadcast(reached.select(F.col("tick").alias("of_tick"), "before"))  # a bounded number of ticks
    stream = Window.partitionBy("tick").orderBy("finish", F.col("source").asc_nulls_last(), "start")
    so_far = F.coalesce(F.sum("words").over(stream.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ordered = packets.repartitionByRange("tick").withColumn("so_far", so_far).join(reached, F.col("tick") == F.col("of_tick"), "left")
    none = F.lit(0).cast("long")
    taken = F.greatest(none, F.least("words", F.col("budget") - F.col("before") - F.col("so_far")))
    return ordered.withColumn("taken", F.when(F.col("before").isNotNull(), taken).otherwise(none)).drop("so_far", "of_tick", "before")


def mix(docs: DataFrame, weights=(1, 2, 3), max_epochs: int = 3, seed: str = "mix") -> DataFrame:
    """The stream up to the end of the budget, in its order."""
    taken = served(schedule(docs, weights, max_epochs, seed, beyond=False)).where("taken > 0")
    return taken.sort("finish", F.col("source").asc_nulls_last(), "start")


def mixed_rows(docs: DataFrame, weights=(1, 2, 3), max_epochs: int = 3, seed: str = "mix") -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, in the order in which their
    last packets finish, with their own columns. A copy that the budget's end divides is
    taken if more than half of it is served; rows of equal (doc_id, source, text) are
    taken alike."""
    given = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("hash"))
    copies = served(schedule(given, weights, max_epochs, seed, beyond=False)).groupBy("doc_id", "source", "size", "hash", "epoch", "copy")
    # a copy finishes with its last packet, in reach or not
    end = (F.col("start") - F.col("packet") * PACKET + F.col("size")) / F.when(F.col("target") > 0, F.col("target"))
    copies = copies.agg(F.sum("taken").alias("taken"), F.max(end).alias("finish"))
    passes = []
    for e in range(max_epochs):
        own = F.col("epoch") == e
        # every copy has a row of the first pass
        kept = 2 * F.sum(F.when(own & (2 * F.col("taken") > F.col("size")), 1)) >= F.sum((F.col("epoch") == 0).cast("int"))
        passes.append(F.when(kept, F.min(F.when(own, F.col("finish")))))
    taken = copies.groupBy("doc_id", "source", "hash").agg(F.array_compact(F.array(*passes)).alias("finishes")).where(F.size("finishes") > 0)
    taken = taken.toDF("__id", "__source", "__hash", "__finishes")
    same = docs["doc_id"].eqNullSafe(taken["__id"]) & docs["source"].eqNullSafe(taken["__source"]) & (F.xxhash64(docs["text"]) == taken["__hash"])
    rows = docs.join(taken, same).withColumn("__finish", F.explode("__finishes"))
    return rows.sort("__finish", F.col("__source").asc_nulls_last(), F.col("__id").asc_nulls_last()).drop("__id", "__source", "__hash", "__finishes", "__finish")


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    packets = served(schedule(sized(table(spark, sf_dir, "documents")), beyond=False))
    return packets.groupBy("doc_id", "source", "copy", "size", "source_size", "target").agg(F.sum("taken").alias("taken")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER b, 0))::DOUBLE
            / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS lvl, count(*) OVER b AS place
  FROM w WINDOW b AS (ORDER BY source_size / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(lvl, place) AS lvl FROM l WHERE lvl * weight <= 3 * source_size),
t AS (SELECT source, source_size, least(3 * source_size::DOUBLE, coalesce((SELECT lvl FROM f), 0) * weight) AS target FROM l),
r AS (
  SELECT *, row_number() OVER () AS of,
         coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5(concat('mix:', coalesce(doc_id::VARCHAR, ''), ':', size)), doc_id NULLS LAST, size
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first FROM d),
p AS (
  SELECT *, unnest([0, 1, 2]) AS epoch
  FROM (SELECT r.*, source_size, target, unnest(range(0, greatest(size, 1), {PACKET})) AS part FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source)),
q AS (SELECT *, epoch * source_size + first + part AS start, least({PACKET}, size - part)::BIGINT AS words FROM p),
b AS (
  SELECT *, coalesce(sum(words) OVER (ORDER BY (start + words) / nullif(target, 0), source NULLS LAST, start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM q)
SELECT doc_id, size, source_size, target, sum(greatest(0, least(words, (SELECT sum(size) FROM d) - before)))::BIGINT AS taken
FROM b GROUP BY of, doc_id, size, source_size, target
"""
