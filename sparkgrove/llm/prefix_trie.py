"""Prefix trie of conversations, by collapsing whole sequences.

Identical rebuilt conversations are grouped into one weighted sequence with the list of
conversations that end there. A sequence that is a proper prefix of another one is dropped
from the leaves by an anti-join. What is left is an aggregate: every distinct sequence
brings a row for each of its prefixes, with its weight, and the rows of a prefix are summed.

A prefix is known by two 64-bit lanes, each the exclusive or of a hash of depth and turn
(the turn by its SHA-256), which adds up along a conversation in any grouping. So nothing
needs a conversation in one piece: turns are numbered by their place in range-sorted files,
lanes run within chunks of ``CHUNK`` turns, to which the sum of the chunks before is added,
and one conversation may hold most of the table.

Subtree sums need no walk of the trie either. The sequences below a node are its members; a
sequence *owns* those of its nodes whose smallest member it is, from depth ``top`` to its
end, and every node has one owner. So what a node's subtree holds is a sum over its members
of what each owns from that depth on.

Defined results: rows with a null conversation id take no part; null roles and texts are
empty. Turns go by turn, null first, and equal turns by the SHA-256 of role and text, so
repeated rows are turns of their own. A conversation whose turns all lie before its start,
with no base to take others from, is a turnless member of the root. An empty table has no
nodes. Texts may be of any length: only their hashes and sizes move. Columns besides the
four named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, materialize, table

#: Conversations whose id is rounded down to a multiple of GROUP share a base; the first
#: crc32(id) % START of its turns open them.
GROUP, START = 5, 9
#: Turns of a conversation that one task takes in a row; bits of ids in a piece of an end list.
CHUNK, PIECE_BITS = 1024, 12
NO_ENDS = hashlib.sha256(b"").hexdigest()
_KEY = ["depth", "ka", "kb"]


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, digest, n_bytes: what the trie needs of each turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    known = conversations.where(F.col("conv_id").isNotNull())
    return known.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))


def placed(rows: DataFrame, order: list[Column], scratch: Scratch) -> DataFrame:
    """``rows`` with their place in the global order, from 0, without a window over them:
    range-sorted files, a row's number in its file, and the rows of the files before."""
    # repeated rows are told apart, so that any number of them can lie in several ranges
    order = [*order, F.col("__row")]
    ranged = rows.withColumn("__row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("__row")
    file = F.col("_metadata.file_name")
    written = scratch.table(ranged, "placed").select("*", file.alias("__file"), F.col("_metadata.row_index").alias("__at"))
    before = Window.orderBy(F.regexp_extract("__file", "^part-([0-9]+)", 1).cast("long"), "__file").rowsBetween(Window.unboundedPreceding, -1)
    files = written.groupBy("__file").agg(F.count(F.lit(1)).alias("n")).select("__file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    # a row for each file
    return written.join(F.broadcast(files), "__file").withColumn("place", F.col("__before") + F.col("__at")).drop("__file", "__at", "__before")


def rebuilt(conversations: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The rebuilt turns, conv_id, depth (from 1), a, b (lanes of the turn), n_bytes; and
    the ids of the conversations that have none."""
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest")]
    at = placed(turns(conversations), order, scratch)
    convs = scratch.table(at.groupBy("conv_id").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")), "convs")
    base = (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base")
    start = (F.crc32(F.col("conv_id").cast("string")) % START).alias("start")
    bases = convs.where(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = convs.select("*", base, start).join(bases, "base", "left").withColumn("n_shared", F.least("start", F.coalesce("n_base", F.lit(0))))
    numbered = at.join(convs, "conv_id").withColumn("pos", F.col("place") - F.col("first") + 1)
    numbered = scratch.table(numbered.select("conv_id", "pos", "start", "n_shared", "digest", "n_bytes"), "numbered")
    own = numbered.where("pos > start").select("conv_id", (F.col("n_shared") + F.col("pos") - F.col("start")).alias("depth"), "digest", "n_bytes")
    heads = numbered.where((F.col("conv_id") % GROUP == 0) & (F.col("pos") < START)).select(F.col("conv_id").alias("base"), F.col("pos").alias("depth"), "digest", "n_bytes")
    opened = heads.join(convs.select("conv_id", "base", "start"), "base").where("depth <= start").select("conv_id", "depth", "digest", "n_bytes")
    lanes = F.xxhash64("depth", "digest").alias("a"), F.xxhash64(F.reverse("digest"), "depth").alias("b")
    turnless = convs.where((F.col("n") <= F.col("start")) & (F.col("n_shared") == 0)).select("conv_id")
    return own.unionByName(opened).select("conv_id", "depth", *lanes, "n_bytes"), turnless


def prefixes(turned: DataFrame) -> DataFrame:
    """Each rebuilt turn as a prefix: conv_id, depth, ka, kb, n_bytes (of the last text),
    before (bytes of the texts before it)."""
    chunk = F.expr(f"(depth - 1) div {CHUNK}")
    rows = turned.withColumn("chunk", chunk)
    sums = [F.bit_xor("a").alias("xa"), F.bit_xor("b").alias("xb"), F.sum("n_bytes").alias("xn")]
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("conv_id", "chunk").agg(*sums)
    totals = totals.select("conv_id", "chunk", F.bit_xor("xa").over(earlier).alias("xa"), F.bit_xor("xb").over(earlier).alias("xb"), F.sum("xn").over(earlier).alias("xn"))
    inside = Window.partitionBy("conv_id", "chunk").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = rows.select("conv_id", "chunk", "depth", "n_bytes", *[f.over(inside).alias(c) for c, f in (("ya", F.bit_xor("a")), ("yb", F.bit_xor("b")), ("yn", F.sum("n_bytes")))])
    # only chunks after a conversation's first have others before them
    met = run.join(totals.where("chunk > 0"), ["conv_id", "chunk"], "left")
    ka, kb = (F.col(f"y{c}").bitwiseXOR(F.coalesce(f"x{c}", F.lit(0))).alias(f"k{c}") for c in "ab")
    before = (F.col("yn") - F.col("n_bytes") + F.coalesce("xn", F.lit(0))).alias("before")
    return met.select("conv_id", "depth", ka, kb, "n_bytes", before)


def whole(turned: DataFrame, turnless: DataFrame) -> DataFrame:
    """Every rebuilt conversation in one row: conv_id, depth, ka, kb, total (bytes)."""
    ends = turned.groupBy("conv_id").agg(F.count(F.lit(1)).alias("depth"), F.bit_xor("a").alias("ka"), F.bit_xor("b").alias("kb"), F.sum("n_bytes").alias("total"))
    return ends.unionByName(turnless.select("conv_id", *[F.lit(0).cast("long").alias(c) for c in ("depth", "ka", "kb", "total")]))


def end_lists(ends: DataFrame) -> DataFrame:
    """The conversations that end at each sequence, as pieces of a list in ascending order:
    depth, ka, kb, piece, conv_ids. A piece holds at most 2**PIECE_BITS ids."""
    piece = F.shiftright("conv_id", PIECE_BITS).alias("piece")
    return ends.select(*_KEY, piece, "conv_id").groupBy(*_KEY, "piece").agg(F.sort_array(F.collect_list("conv_id")).alias("conv_ids"))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each sequence's list, from its pieces in order, one in memory at a time."""
    key = hasher = None
    out: list[tuple] = []
    for batch in batches:
        for *at, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if at != key:
                if key:
                    out.append((*key, hasher.hexdigest()))
                key, hasher = at, hashlib.sha256(ids.encode())
            else:
                hasher.update(f",{ids}".encode())
        if len(out) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=[*_KEY, "ends_sha256"])
            out = []
    if key:
        out.append((*key, hasher.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=[*_KEY, "ends_sha256"])


def ends_hashed(lists: DataFrame) -> DataFrame:
    """depth, ka, kb, ends_sha256: of the ids of ``end_lists``, joined by commas. A hash is
    sequential by nature; its task streams the pieces of a list and holds none."""
    texts = lists.select(*_KEY, "piece", F.array_join(F.col("conv_ids").cast("array<string>"), ",").alias("ids"))
    sorted_ = texts.repartition(*_KEY).sortWithinPartitions(*_KEY, "piece").select(*_KEY, "ids")
    return sorted_.mapInArrow(_hashed, "depth long, ka long, kb long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """Nodes of the trie of rebuilt conversations: conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    with Scratch(spark) as scratch:
        turned, turnless = rebuilt(conversations, scratch)
        turned = scratch.table(turned, "rebuilt")
        ends = scratch.table(whole(turned, turnless), "whole")
        sequences = scratch.table(
            ends.groupBy(*_KEY).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("weight"), F.first("total").alias("total"))
            .select("conv_id", F.col("depth").alias("length"), "ka", "kb", "weight", "total"), "sequences",
        )
        # one conversation stands for each sequence
        rows = scratch.table(prefixes(turned).join(sequences.drop("ka", "kb"), "conv_id"), "prefixes")
        nodes = scratch.table(rows.groupBy(*_KEY).agg(F.min("conv_id").alias("owner"), (F.max("length") > F.col("depth")).alias("extended")), "owners")
        proper = nodes.where("extended").select(F.col("depth").alias("length"), "ka", "kb")
        proper = proper.union(sequences.where("length > 0").limit(1).select(*[F.lit(0).cast("long").alias(c) for c in ("length", "ka", "kb")]))
        leaves = sequences.join(proper, ["length", "ka", "kb"], "left_anti").select("conv_id", F.lit(1).alias("leaf"))
        owned = F.col("owner") == F.col("conv_id")
        marks = rows.join(nodes.drop("extended"), _KEY).groupBy("conv_id").agg(
            F.min(F.when(owned, F.col("depth"))).alias("top"), F.min(F.when(owned, F.col("before"))).alias("skipped"),
            F.max(F.when(~owned, F.struct("depth", "owner")))["owner"].alias("above"),
        )
        # a sequence that owns no node ends at one of a smaller member
        marks = sequences.join(marks, "conv_id", "left").join(leaves, "conv_id", "left").select(
            "conv_id", "length", "weight", "total", "above", F.coalesce("top", F.col("length") + 1).alias("top"),
            F.coalesce("skipped", "total").alias("skipped"), F.coalesce("leaf", F.lit(0)).alias("leaf"),
        )
        marks = scratch.table(marks, "marks")
        first = ends.agg(F.min("conv_id")).scalar()
        given = rows.join(marks.select("conv_id", "above", "top", "skipped", "leaf"), "conv_id")
        depth, top, total = F.col("depth"), F.col("top"), F.col("total")
        kept = F.when(depth >= top, total - F.col("before")).otherwise(total - F.col("skipped"))
        parent = F.when(depth > top, F.col("conv_id")).when(depth == top, F.coalesce("above", first))
        found = given.groupBy(*_KEY).agg(
            F.min("conv_id").alias("conv_id"), F.max(parent).alias("parent_conv_id"), F.sum("weight").alias("n_convs"),
            F.sum(((F.col("length") > depth) & (top <= depth + 1)).cast("long")).alias("n_children"), F.sum("leaf").cast("long").alias("n_leaves"),
            F.sum(F.col("weight") * (total - F.col("before")) - kept).alias("saved_tokens"),
        )
        root = marks.agg(
            F.min("conv_id").alias("conv_id"), F.lit(None).cast("long").alias("parent_conv_id"), F.sum("weight").alias("n_convs"),
            F.sum(((F.col("length") > 0) & (top == 1)).cast("long")).alias("n_children"), F.sum("leaf").cast("long").alias("n_leaves"),
            F.sum(F.col("weight") * total - total + F.col("skipped")).alias("saved_tokens"),
        ).where("conv_id IS NOT NULL")
        found = found.unionByName(root.select(*[F.lit(0).cast("long").alias(c) for c in _KEY], "*"))
        found = found.join(ends_hashed(end_lists(ends)), _KEY, "left")
        return materialize(
            found.select(
                "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
            ), "trie",
        )


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


#: crc32 of the id, a bit at a time: the polynomial of the function in both engines.
_CRC = """xor(list_reduce(list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
  lambda s, x: list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)), xor(s, x)), 4294967295), 4294967295)"""
ORACLE_SQL = f"""
WITH g AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
t AS (
  SELECT c, digest, n_bytes, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, digest) AS pos
  FROM (SELECT c, turn, sha256(length(role) || ':' || role || text) AS digest, strlen(text) AS n_bytes FROM g)),
c AS (SELECT c, {_CRC} % {START} AS h FROM (SELECT DISTINCT c FROM g)),
r AS (
  SELECT c.c, 0 AS part, pos, digest, n_bytes FROM c JOIN t ON t.c = c.c - c.c % {GROUP} AND pos <= h
  UNION ALL SELECT c.c, 1, pos, digest, n_bytes FROM c JOIN t ON t.c = c.c AND pos > h),
q AS (SELECT c, list(digest ORDER BY part, pos) AS seq, list(n_bytes ORDER BY part, pos) AS bytes FROM r GROUP BY c),
s AS (SELECT c.c, coalesce(seq, []) AS seq, coalesce(bytes, []) AS bytes FROM c LEFT JOIN q ON q.c = c.c),
p AS (
  SELECT c, d, sha256(array_to_string(list_slice(seq, 1, d), ',')) AS k, sha256(array_to_string(list_slice(seq, 1, d - 1), ',')) AS up,
    CASE WHEN d > 0 THEN bytes[d] ELSE 0 END AS n_bytes, d = len(seq) AS last
  FROM (SELECT *, unnest(range(len(seq) + 1)) AS d FROM s)),
n AS (
  SELECT d, k, min(c) AS m, any_value(up) AS up, count(*) AS n, any_value(n_bytes) AS n_bytes,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (last), '')) AS ends FROM p GROUP BY d, k),
ch AS (SELECT d - 1 AS d, up AS k, count(*) AS n FROM n WHERE d > 0 GROUP BY ALL),
x AS (SELECT n.*, coalesce(ch.n, 0) AS n_children FROM n LEFT JOIN ch ON ch.d = n.d AND ch.k = n.k),
b AS (
  SELECT p.d, p.k, sum((x.n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum((x.n - 1) * x.n_bytes)::BIGINT AS saved
  FROM x JOIN p ON p.c = x.m AND p.d <= x.d GROUP BY p.d, p.k)
SELECT x.m AS conv_id, x.d AS depth, y.m AS parent_conv_id, x.n AS n_convs, x.n_children, b.n_leaves, b.saved AS saved_tokens, x.ends AS ends_sha256
FROM x JOIN b ON b.d = x.d AND b.k = x.k LEFT JOIN n y ON y.d = x.d - 1 AND y.k = x.up AND x.d > 0
"""
