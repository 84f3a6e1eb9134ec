"""Line dedup by a deletion-neighbourhood join, in DataFrame operations only.

Lines are compared as lower-cased word sequences. A line goes if an earlier line of the
corpus (by doc_id, nulls last, then line number) has the same words, or, for lines of at
least ``MIN_WORDS`` words, words within one edit: one word inserted, deleted or replaced.
The earlier line need not stay itself: of a chain of lines, each one edit from the one
before, only the first stays. Blank lines stay.

1. Every line is hashed; equal lines meet in an aggregate that keeps the earliest.
2. Two lines within one word edit share their first or their last half. Distinct lines
   that share no half with another have no partner and emit nothing further.
3. The others emit their deletion neighbourhood as hashed keys: the line itself, and the
   line without its i-th word, for each i. Word hashes depend on the position and are
   combined by exclusive or, so that one running pass gives all keys of a line.
4. Equal keys meet in aggregates that keep the earliest line, so a key shared by many
   lines costs one row for each, not one for each pair: lines that lack the same word
   position and agree otherwise are all within one replacement; a whole line equal to
   another's variant is within one deletion.
5. Each line's earliest partners are verified on the words themselves.

What a join does not need stays where it is: halves, variants, lines and documents pass
sieves (see ``sieve``) of bounded size before they are shuffled, at every size of input,
and documents without a line that goes are not shuffled at all.

Hashes of 128 bits stand for equal lines in step 1, of 64 bits in steps 2 to 4; only the
words decide in step 5.

Defined results: null texts have no lines and stay null; an empty text is one blank line.
Rows with equal doc_id are ordered by the hash of their text; wholly equal rows count as
one document and get equal results. Null doc_ids come last. Empty tables give empty
results. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, materialize, table
from .sieve import bits_for, flagged, sieve, sifted

#: Shorter lines must be equal to be duplicates.
MIN_WORDS = 8
_SPACE = r"[\x20\x09-\x0D]+"


def normalized(line: Column) -> Column:
    """Lower case, words separated by one space; most lines only need the first."""
    low = F.lower(line)
    odd = low.startswith(" ") | low.endswith(" ") | low.contains("  ")
    for c in "\t\x0b\x0c\r":
        odd = odd | low.contains(c)
    return F.when(odd, F.array_join(F.array_remove(F.split(low, _SPACE), ""), " ")).otherwise(low)


def _lines(docs: DataFrame) -> DataFrame:
    """One row per line that is not blank: none, id, hash, line_no (its place), words."""
    split = docs.select(
        F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"), F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    )
    return split.select("none", "id", "hash", "line_no", normalized(F.col("line")).alias("words")).where("words != ''")


def _place() -> Column:
    return F.struct("none", "id", "hash", "line_no").alias("place")


def _h() -> list[Column]:
    return [F.xxhash64("words").alias("h"), F.xxhash64(F.lit(1), "words").alias("h2")]


def _halves() -> Column:
    """Hashes of the first and last half of a line's words, in the lengths that lines of
    as many words, of one more and of one less use alike; null for short lines."""
    words, n = F.col("words"), F.col("n")
    k = F.floor(n / 2).cast("int")
    rest = n - k

    def first(m: Column) -> Column:
        return F.xxhash64(F.lit(0), F.call_function("substring_index", words, F.lit(" "), m))

    def last(m: Column) -> Column:
        return F.xxhash64(F.lit(1), F.call_function("substring_index", words, F.lit(" "), -m))

    other = F.when(rest > k, first(k + 1)).otherwise(last(rest + 1))
    return F.when(n >= MIN_WORDS, F.array(first(k), last(rest), other))


def hashed_lines(docs: DataFrame) -> DataFrame:
    """One row per line that is not blank: its place, h, h2, halves."""
    spaces = F.octet_length("words") - F.octet_length(F.replace(F.col("words"), F.lit(" "), F.lit("")))
    lines = _lines(docs).withColumn("n", (spaces + 1).cast("int"))
    return lines.select("none", "id", "hash", "line_no", *_h(), _halves().alias("halves"))


def firsts(lines: DataFrame) -> DataFrame:
    """Distinct lines: h, h2, place of the earliest, copies, halves."""
    return lines.groupBy("h", "h2").agg(F.min(_place()).alias("place"), F.count(F.lit(1)).alias("copies"), F.first("halves").alias("halves"))


def _candidates(known: DataFrame, scratch: Scratch) -> DataFrame:
    """Distinct lines that share a half with another: h, h2, place, ord. The longs of ord
    follow the places, and name the lines from here on."""
    halves = known.where("halves is not null").select("h", "h2", "place", F.explode("halves").alias("half"))
    shared = scratch.table(halves.groupBy("half").agg(F.count(F.lit(1)).alias("lines")).where("lines > 1").select("half"), "shared-halves")
    found = sifted(halves, ["half"], shared).join(shared, "half", "left_semi").dropDuplicates(["h", "h2"]).select("h", "h2", "place")
    return scratch.table(found.sort("place").withColumn("ord", F.monotonically_increasing_id()), "line-candidates")


def _with_words(docs: DataFrame, wanted: DataFrame, scratch: Scratch) -> DataFrame:
    """``wanted`` (place, ord) → ord, words, from the documents at those places."""
    of = F.collect_list(F.struct("place.line_no", "ord")).alias("of")
    by_doc = scratch.table(wanted.groupBy(F.col("place.id").alias("doc_id"), F.col("place.hash").alias("hash")).agg(of), "line-documents")
    given = sifted(docs.withColumn("hash", F.xxhash64("text")), ["doc_id", "hash"], by_doc)
    texts = given.join(by_doc, given["doc_id"].eqNullSafe(by_doc["doc_id"]) & (given["hash"] == by_doc["hash"]))
    texts = texts.select("of", F.split("text", "\n").alias("lines"))
    got = F.transform("of", lambda x: F.struct(x["ord"].alias("ord"), F.get(F.col("lines"), x["line_no"]).alias("line")))
    lines = texts.select(F.explode(got).alias("x")).select("x.ord", normalized(F.col("x.line")).alias("words"))
    return lines.groupBy("ord").agg(F.first("words").alias("words"))  # wholly equal rows give it more than once


def variants(lines: DataFrame) -> DataFrame:
    """Deletion neighbourhood of ``lines`` (ord, words): key, pos (-1: the whole line), ord."""
    each = lines.select("ord", F.posexplode(F.split("words", " ")).alias("pos", "word"))
    each = each.select("ord", "pos", F.xxhash64("word", "pos").alias("own"), F.xxhash64("word", F.col("pos") - 1).alias("moved"))
    line = Window.partitionBy("ord")
    before = line.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    run = F.coalesce(F.bit_xor(F.col("own").bitwiseXOR(F.col("moved"))).over(before), F.lit(0).cast("long"))
    each = each.select("ord", "pos", "moved", run.alias("run"), F.bit_xor("own").over(line).alias("whole"), F.bit_xor("moved").over(line).alias("all_moved"))
    without = F.struct(F.col("all_moved").bitwiseXOR(F.col("run")).bitwiseXOR(F.col("moved")).alias("key"), "pos")
    whole = F.struct(F.col("whole").alias("key"), F.lit(-1).alias("pos"))
    keys = F.when(F.col("pos") == 0, F.array(without, whole)).otherwise(F.array(without))
    return each.select("ord", F.explode(keys).alias("k")).select("k.key", "k.pos", "ord")


def _partners(keyed: DataFrame, scratch: Scratch) -> DataFrame:
    """Each line with an earlier partner under one of its keys: ord, first (the
    partner), by (replaced, deleted, inserted), pos of the word that the longer line has
    more, or that both replace."""
    wholes = scratch.table(keyed.where("pos < 0").select("key", F.col("ord").alias("first")), "whole-lines")
    less = keyed.where("pos >= 0")
    groups = less.groupBy("key", "pos").agg(F.min("ord").alias("first"), F.count(F.lit(1)).alias("lines")).where("lines > 1").drop("lines")
    groups = scratch.table(groups, "variant-groups")
    replaced = sifted(less, ["key", "pos"], groups).join(groups, ["key", "pos"]).where("first < ord").select("ord", "first", "pos", F.lit("replaced").alias("by"))
    met = scratch.table(sifted(less, ["key"], wholes).join(wholes, "key").select("ord", "first", "pos"), "variant-lines")
    deleted = met.where("first < ord").select("ord", "first", "pos", F.lit("deleted").alias("by"))
    later = met.where("first > ord").groupBy("first").agg(F.min(F.struct("ord", "pos")).alias("one"))
    inserted = later.select(F.col("first").alias("ord"), F.col("one.ord").alias("first"), "one.pos", F.lit("inserted").alias("by"))
    return replaced.unionByName(deleted).unionByName(inserted).distinct()


def _verified(partners: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines (ord) whose words are within one edit of a partner's."""
    own = lines.select("ord", F.split("words", " ").alias("a"))
    theirs = lines.select(F.col("ord").alias("first"), F.split("words", " ").alias("b"))

    def without(words: Column) -> Column:
        return F.concat(F.slice(words, 1, F.col("pos")), F.slice(words, F.col("pos") + 2, F.greatest(F.size(words) - F.col("pos") - 1, F.lit(0))))

    a, b = F.col("a"), F.col("b")
    a_less = F.when(F.col("by") == "inserted", a).otherwise(without(a))
    b_less = F.when(F.col("by") == "deleted", b).otherwise(without(b))
    return partners.join(own, "ord").join(theirs, "first").where(a_less == b_less).select("ord").distinct()


def near_lines(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct lines (h, h2, place) with an earlier line within one word edit."""
    with Scratch(docs.sparkSession) as scratch:
        candidates = _candidates(known, scratch)
        lines = scratch.table(_with_words(docs, candidates, scratch), "line-words")
        keyed = scratch.table(variants(lines), "line-variants")
        return materialize(candidates.join(_verified(_partners(keyed, scratch), lines), "ord").select("h", "h2", "place"), "near-lines")


def gone_lines(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) → a row for each document that loses lines: doc_id, hash (of
    the text), gone and near_lines (numbers of all these lines, and of the near ones)."""
    with Scratch(docs.sparkSession) as scratch:
        lines = scratch.table(hashed_lines(docs), "lines")
        known = scratch.table(firsts(lines), "distinct-lines")
        near = near_lines(docs, known).withColumn("near", F.lit(True))
        going = known.where("copies > 1").select("h", "h2", "place", F.lit(False).alias("near")).unionByName(near)
        going = scratch.table(going.groupBy("h", "h2").agg(F.min("place").alias("first"), F.max("near").alias("near")), "going-lines")
        gone = sifted(lines.drop("halves"), ["h", "h2"], going).join(going, ["h", "h2"]).where(F.col("near") | (F.col("first") != _place()))
        by_doc = gone.groupBy(F.col("id").alias("doc_id"), "hash").agg(
            F.collect_set("line_no").alias("gone"), F.collect_set(F.when(F.col("near"), F.col("line_no"))).alias("near_lines")
        )
        return materialize(by_doc, "gone-lines")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) → doc_id, text without the lines that go, n_lines,
    n_same and n_near: lines gone as equal or as within one edit."""
    docs = docs.select("doc_id", "text")
    by_doc = gone_lines(docs)
    bits = bits_for(by_doc.count())
    marked = flagged(docs.withColumn("hash", F.xxhash64("text")), ["doc_id", "hash"], sieve(by_doc, ["doc_id", "hash"], bits), bits, "loses")
    losing, whole = marked.where("loses"), marked.where("not loses")
    joined = losing.join(by_doc, losing["doc_id"].eqNullSafe(by_doc["doc_id"]) & (losing["hash"] == by_doc["hash"]), "left")
    joined = joined.select(losing["doc_id"], "text", F.split("text", "\n").alias("lines"), "gone", "near_lines")
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(F.col("lines"), i)), "\n"))
    n_gone, n_near = F.coalesce(F.size("gone"), F.lit(0)), F.coalesce(F.size("near_lines"), F.lit(0))
    counts = [F.greatest(n_gone - n_near, F.lit(0)).cast("long").alias("n_same"), F.greatest(n_near, F.lit(0)).cast("long").alias("n_near")]
    none = F.lit(0).cast("long")
    n_lines = F.coalesce(F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long").alias("n_lines")
    return joined.select("doc_id", kept.alias("text"), n_lines, *counts).unionByName(
        whole.select("doc_id", "text", n_lines, none.alias("n_same"), none.alias("n_near"))
    )


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"))


ORACLE_SQL = rf"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(lower(line), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM l),
f AS (
  SELECT words, min(struct_pack(d := doc_id, n := line_no)) AS place FROM w WHERE len(words) > 0 GROUP BY words),
c AS (SELECT words, place FROM f WHERE len(words) >= {MIN_WORDS}),
v AS (
  SELECT words, place, i, list_concat(words[:i - 1], words[i + 1:]) AS rest
  FROM (SELECT *, unnest(range(1, len(words) + 1)) AS i FROM c)),
m AS (SELECT rest, i, min(place) AS place FROM v GROUP BY ALL),
r AS (SELECT rest, min(place) AS place FROM v GROUP BY ALL),
near AS (
  SELECT v.words FROM v JOIN m ON v.rest = m.rest AND v.i = m.i WHERE m.place < v.place
  UNION SELECT v.words FROM v JOIN c ON v.rest = c.words WHERE c.place < v.place
  UNION SELECT c.words FROM c JOIN r ON r.rest = c.words WHERE r.place < c.place),
g AS (
  SELECT w.*, near.words IS NOT NULL AS near,
         len(w.words) > 0 AND (near.words IS NOT NULL OR f.place <> struct_pack(d := doc_id, n := line_no)) AS gone
  FROM w LEFT JOIN f ON w.words = f.words LEFT JOIN near ON w.words = near.words)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT gone), '') AS text, count(*)::BIGINT AS n_lines,
       (count(*) FILTER (WHERE gone AND NOT near))::BIGINT AS n_same, (count(*) FILTER (WHERE gone AND near))::BIGINT AS n_near
FROM g GROUP BY doc_id
"""
