"""Prefix tries of small tables against a dictionary of all prefixes."""

from __future__ import annotations

import random

import brute
import pytest
from pyspark.sql import functions as F

from sparkgrove.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def nodes(df) -> list[tuple]:
    return sorted(map(tuple, prefix_trie.prefix_trie(df).collect()), key=repr)


def made(seed: int, n: int) -> list[tuple]:
    """Conversations of few different turns, some alike, some of them others' beginnings."""
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(-20, 120), n):
        for turn in range(rng.choice((1, 2, 3, 6, 12))):
            rows.append((c, turn if rng.random() < 0.9 else None, rng.choice(("user", "assistant", None)), rng.choice(("a", "bß", "", None))))
    return rows + rng.sample(rows, n // 4) + [(None, 1, "user", "no id"), (2**60 + 3, 5, "user", "far away")]


@pytest.mark.parametrize("seed, chunk, bits", [(1, 1024, 12), (2, 2, 1), (3, 1, 0)])
def test_is_the_trie_of_all_prefixes(spark, monkeypatch, seed, chunk, bits):
    monkeypatch.setattr(prefix_trie, "CHUNK", chunk)
    monkeypatch.setattr(prefix_trie, "PIECE_BITS", bits)
    rows = made(seed, 60)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(f"own {c}") for c in ("place", "depth", "base", "digest", "n_bytes", "ka", "first")})
    assert nodes(df.repartition(5, "text")) == brute.trie_rows(rows)


def test_one_conversation_holds_most_rows(spark):
    long = [(10, i if i % 3 else None, "user", f"turn {i % 7}") for i in range(3000)]
    rows = [*long, *((11, *x[1:]) for x in long), (12, 0, "user", "short"), (3, 0, "user", "x")]
    assert nodes(spark.createDataFrame(rows, SCHEMA)) == brute.trie_rows(rows)


def test_of_many_copies_one_list(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(0, 9000, 3) for t in range(12)]
    got = nodes(spark.createDataFrame(rows, SCHEMA))
    assert got == brute.trie_rows(rows) and max(x[3] for x in got) == 3000


def test_turnless_and_empty(spark):
    absent = next(c for c in range(1, 1000) if c % 5 and brute.zlib.crc32(str(c).encode()) % 9 > 1)
    rows = [(absent, 0, "user", "dropped")]
    assert nodes(spark.createDataFrame(rows, SCHEMA)) == brute.trie_rows(rows) == [(absent, 0, None, 1, 0, 1, 0, brute.hashlib.sha256(str(absent).encode()).hexdigest())]
    assert nodes(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)) == []
    assert nodes(spark.createDataFrame([], SCHEMA)) == []


def test_test_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    assert nodes(df) == brute.trie_rows([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_end_lists_hold_the_conversations(spark):
    ends = spark.createDataFrame([(c, 2, 7, 9) for c in range(10)] + [(50, 1, 7, 9)], "conv_id long, depth long, ka long, kb long")
    got = sorted((r.depth, r.piece, r.conv_ids) for r in prefix_trie.end_lists(ends).collect())
    assert got == [(1, 0, [50]), (2, 0, list(range(10)))]
