"""SimHash near-duplicates, linked through pigeonring filtering.

A 64-bit fingerprint is cut into a ring of five segments. If two fingerprints differ
in at most 4 bits, there is a segment from which every chain of l consecutive segments
differs in at most floor(4 l / 5) bits: the first is equal, the first two differ in at
most one bit, three in two, four in three (the strong form of the pigeonhole principle
on a ring; Qin and Xiao, 2018). The chain of two makes the join key: it is indexed with
each bit of its second segment masked, 64 keys a fingerprint, so candidates agree in 25
or 26 bits. The longer chains prune candidates before the full Hamming distance.

Copies are collapsed first: the join is over distinct fingerprints. A key with two of
them gives its pair from a plain aggregate. Keys with more are cut into blocks of
bounded size; each pair of blocks is walked breadth first and emits a spanning forest,
never all pairs. Components are found by distributed star contraction.

Defined results: null and empty texts have fingerprint zero, which is linked like any
other. Fewer than four words form one shingle. Repeated rows give a row each. Null
doc_ids take part; a component without any doc_id has component_id null. Empty tables
give empty results. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, in_arrow, materialize, pieces, table
from .components import components
from .sieve import bits_for, flagged, sieve, sifted

#: Widths of the ring's segments, from the lowest bit.
SEGMENTS = (13, 13, 13, 13, 12)
MAX_BITS = 4
SHINGLE = 4
SEED = 42
#: Fingerprints in one block of a large key.
BLOCK = 2048
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Shingles unpacked to bits at a time.
_STEP = 1 << 16


def fingerprint(text: bytes) -> int:
    """Of a UTF-8 text, as an unsigned 64-bit integer."""
    from xxhash import xxh64_intdigest

    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    if n <= SHINGLE:
        h = np.array([xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    else:
        lengths = np.fromiter(map(len, words), np.int64, n)
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: n - SHINGLE + 1].tolist()
        h = np.fromiter(
            (xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts, ends[SHINGLE - 1 :].tolist())), np.uint64, n - SHINGLE + 1
        )
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), _STEP):
        part = h[at : at + _STEP].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(h), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", as_col: str = "fp") -> DataFrame:
    """Adds a long with the bits of each row's fingerprint; other columns stay."""
    names = [c for c in docs.columns if c != text_col]
    schema = docs.select(*names).schema.add(as_col, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in pieces(b, len(names))):
            texts = batch.column(len(names)).cast(pa.binary())
            fps = np.fromiter((fingerprint(x.as_py() or b"") for x in texts), np.uint64, batch.num_rows)
            columns = [batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(fps.view(np.int64))], names=[*names, as_col])

    return in_arrow(docs.select(*names, text_col), run, schema)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _segment_masks(widths=SEGMENTS) -> list[int]:
    masks, at = [], 0
    for w in widths:
        masks.append(((1 << w) - 1) << at)
        at += w
    return masks


def _chain(start: int, length: int) -> int:
    masks, found = _segment_masks(), 0
    for i in range(length):
        found |= masks[(start + i) % len(masks)]
    return found


def _keyed(nodes: DataFrame) -> DataFrame:
    """(fp) → (fp, key): the chain of two that ends in a bit's segment, with the bit
    masked, hashed; the key's lowest six bits name the bit. Each row makes 64."""
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tags = []
    for j, mask in enumerate(_segment_masks()):
        for bit in (b for b in range(64) if mask >> b & 1):
            tags.append(F.struct(F.lit(bit).alias("bit"), F.lit(_signed(_chain(j - 1, 2) & ~(1 << bit))).cast("long").alias("mask")))
    # dealt by another hash than the aggregate below it, or Spark keeps that one's few partitions
    spread = nodes.repartition(n, F.xxhash64("fp")).select("fp", F.explode(F.array(*tags)).alias("t"))
    hashed = F.xxhash64("t.bit", F.col("fp").bitwiseAND(F.col("t.mask")))
    return spread.select("fp", hashed.bitwiseAND(F.lit(-64).cast("long")).bitwiseOR(F.col("t.bit").cast("long")).alias("key"))


def _bit_of(key):
    return key.bitwiseAND(F.lit(63).cast("long")).cast("int")


def _start_of(bit: int) -> int:
    return next(j for j, mask in enumerate(_segment_masks()) if mask >> bit & 1) - 1


def _viable(x: np.ndarray, bit: int) -> np.ndarray:
    """Whether differences pass every longer chain from the key's start, and the whole."""
    start, m = _start_of(bit) % len(SEGMENTS), len(SEGMENTS)
    ok = np.ones(len(x), bool)
    for length in range(1, m + 1):
        at = np.flatnonzero(ok)
        ok[at] = np.bitwise_count(x[at] & np.uint64(_chain(start, length))) <= MAX_BITS * length // m
    return ok


def _forest(fps: np.ndarray, bit: int) -> list[tuple[int, int]]:
    """A spanning forest of one block pair's links: each member is reached once."""
    left, edges = fps, []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = _viable(left ^ at, bit)
            found, left = left[near], left[~near]
            edges += [(int(at), int(x)) for x in found]
            queue += list(found)
    return edges


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, bit, b1, b2); a group may span batches, not partitions."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    held: list[np.ndarray] = []

    def emitted(groups: np.ndarray) -> pa.RecordBatch:
        cut = np.flatnonzero(np.any(groups[1:, :4] != groups[:-1, :4], axis=1)) + 1
        edges = []
        for part in np.split(groups, cut):
            edges += _forest(part[:, 4].astype(np.int64).view(np.uint64), int(part[0, 1]))
        ends = np.array(edges, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], schema=schema)

    for batch in batches:
        rows = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(5)], axis=1)
        if not len(rows):
            continue
        whole = np.concatenate([*held, rows])
        last = np.flatnonzero(np.any(whole[:, :4] != whole[-1, :4], axis=1))
        end = last[-1] + 1 if len(last) else 0
        held = [whole[end:]]
        if end:
            yield emitted(whole[:end])
    if held:
        yield emitted(held[0])


def links(nodes: DataFrame, written=materialize) -> DataFrame:
    """Distinct fingerprints (fp) → edges (a, b) that span the graph of all links;
    ``written`` writes a table and reads it again."""
    keyed = _keyed(nodes)
    keys = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
    keys = written(keys, "simhash-keys").withColumn("bit", _bit_of(F.col("key")))
    x = F.col("a").bitwiseXOR(F.col("b"))
    chain_ok = F.lit(True)
    for j, mask in enumerate(_segment_masks()):
        start = (j - 1) % len(SEGMENTS)
        here = F.lit(True)
        for length in range(2, len(SEGMENTS) + 1):
            here = here & (F.bit_count(x.bitwiseAND(F.lit(_signed(_chain(start, length))).cast("long"))) <= MAX_BITS * length // len(SEGMENTS))
        low, high = (mask & -mask).bit_length() - 1, mask.bit_length() - 1
        chain_ok = F.when(F.col("bit").between(low, high), here).otherwise(chain_ok)
    pairs = keys.where("n = 2").where(chain_ok).select("a", "b")
    large = written(keys.where("n > 2").select("key", "bit", "n"), "simhash-crowded-keys")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(7)), blocks).cast("int")
    members = sifted(keyed, ["key"], large).join(large, "key").withColumns({"own": own, "other": F.explode(F.sequence(F.lit(0), blocks - 1))})
    grouped = members.select("key", "bit", F.least("own", "other").alias("b1"), F.greatest("own", "other").alias("b2"), "fp")
    walked = in_arrow(grouped.repartition("key", "b1", "b2").sortWithinPartitions("key", "b1", "b2"), _walk, "a long, b long")
    return pairs.unionByName(walked).distinct()


def _rooted(nodes: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp, first, an orderable struct) → fp, root: the least first
    that links reach. Components are found over the structs, so that their root is it."""
    with Scratch(nodes.sparkSession) as scratch:
        edges = scratch.table(links(nodes.select("fp"), scratch.table), "links")
        met = scratch.table(sifted(nodes, ["fp"], edges.select(F.explode(F.array("a", "b")).alias("fp")).distinct()), "linked")
        named = met.select("fp", F.struct("first", "fp").alias("node"))
        for end in ("a", "b"):
            ends = named.select(F.col("fp").alias(end), F.col("node").alias(f"{end}_node"))
            edges = scratch.table(edges.join(ends, end), f"links-{end}")
        found = components(edges, "a_node", "b_node").select("node.fp", F.col("root.first").alias("root"))
    return found


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` (id, text) → doc_id, fp, component_id, one row per row."""
    fps = materialize(fingerprints(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))), "fingerprints")
    with Scratch(docs.sparkSession) as scratch:
        nodes = scratch.table(fps.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("first")), "nodes")
        named = nodes.join(_rooted(nodes), "fp", "left").select("fp", F.coalesce("root", "first")["doc_id"].alias("component_id"))
        named = materialize(named, "simhash-components")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component: that of the least doc_id (nulls last),
    then of the least text hash; of rows with equal doc_id and text any one stays.
    Columns stay as they are, whatever their names."""
    marked = docs.select(F.col("doc_id"), F.col("text"), F.xxhash64("text").alias("text_hash"))
    fps = materialize(fingerprints(marked), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    with Scratch(docs.sparkSession) as scratch:
        nodes = scratch.table(fps.groupBy("fp").agg(first), "nodes")
        roots = nodes.join(_rooted(nodes), "fp", "left").select(F.coalesce("root", "first").alias("first")).distinct()
        roots = roots.select(F.col("first.doc_id").alias("id"), F.col("first.text_hash").alias("hash"), F.lit(True).alias("kept"))
        rows = fps.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
        found = rows.join(scratch.table(roots, "roots"), rows["doc_id"].eqNullSafe(F.col("id")) & (rows["text_hash"] == F.col("hash")), "left")
        found = found.where("kept is null or n > 1").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__of"), F.col("kept").alias("__kept"))
        touched = materialize(found, "simhash-touched")
    # documents that stay as they are, most of them, are not moved
    bits = bits_for(touched.count())
    marked = flagged(docs.withColumn("__hash", F.xxhash64("text")), ["doc_id", "__hash"], sieve(touched, ["__id", "__of"], bits), bits, "__met")
    met = marked.where("__met").join(touched, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__of")), "left")
    own = [F.col(f"`{c}`") for c in docs.columns]
    repeated = met.where("__kept").select(own).dropDuplicates(["doc_id", "text"])
    return marked.where("not __met").select(own).unionByName(met.where("__of is null").select(own)).unionByName(repeated)
