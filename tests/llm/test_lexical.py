"""Ranked lexical search against scoring every document for every item."""

from __future__ import annotations

import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkgrove.llm import lexical

DOCS, ITEMS = "doc_id long, text string", "item_id string, text string"


def found(spark, items, docs, **more) -> list[tuple]:
    own = {c: F.lit(f"own {c}") for c in ("norm", "query", "rank", "score", "row", "n", "terms")}
    items, docs = spark.createDataFrame(items, ITEMS).withColumns(own), spark.createDataFrame(docs, DOCS).withColumns(own)
    return sorted(map(tuple, lexical.ranked(items, docs.repartition(3), **more).collect()), key=repr)


def made(seed: int, n: int) -> list[tuple]:
    """Texts over a vocabulary of skewed frequencies, with copies and repeated ids."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(200)] + ["été", "ÉTÉ", "x9", "日本"]
    text = lambda: " ".join(rng.choice(words[: rng.choice((5, 40, len(words)))]) + rng.choice(("", ".", ", ")) for _ in range(rng.choice((1, 8, 30, 300))))
    docs = [(i, text()) for i in range(n)]
    return docs + [(i + n, docs[7][1]) for i in range(n // 3)] + [(3, docs[5][1]), (3, docs[3][1]), (None, docs[7][1]), (None, "w1 w2"), (8000, None), (8001, ""), (8002, "-- !!")]


@pytest.mark.parametrize("seed, first_rows, block_bytes", [(1, 4096, 8 << 20), (2, 20, 8 << 20), (3, 5, 400)])
def test_is_the_ranking_of_all(spark, monkeypatch, seed, first_rows, block_bytes):
    monkeypatch.setattr(lexical, "FIRST_ROWS", first_rows)
    monkeypatch.setattr(lexical, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(lexical, "SHARD_BYTES", 2000)
    docs = made(seed, 150)
    items = [(f"i{j}", docs[j * 7][1][:200]) for j in range(15)] + [("i1", "w1 w1 w1 W2"), (None, "w3 w199"), ("none", None), ("empty", " . "), ("unknown", "nowhere"), ("été", "été 日本 日本")]
    assert found(spark, items, docs) == brute.ranked_rows(items, docs)


def test_few_documents_and_empty_tables(spark):
    docs, items = [(1, "a b"), (2, "b c " * 5000)], [("q", "a b b z")]
    assert found(spark, items, docs, k=1) == brute.ranked_rows(items, docs, 1)
    assert found(spark, items, docs) == brute.ranked_rows(items, docs)
    assert found(spark, items, []) == found(spark, [], docs) == found(spark, items, [(1, None)]) == found(spark, [("q", None)], docs) == []


def test_a_word_of_every_document_has_no_weight(spark):
    docs = [(i, "every" if i else "every rare") for i in range(3000)]  # floor(1000 * ln(6002 / 6001)) is 0
    assert found(spark, [("q", "every rare")], docs) == brute.ranked_rows([("q", "every rare")], docs)
    assert found(spark, [("q", "every")], docs) == []


def bucket(rows: list[dict[int, int]], weights: lexical.Weights) -> lexical.Bucket:
    n = pa.array([sum(r.values()) for r in rows])
    lists = [pa.array([list(x) for x in part], pa.list_(pa.int32())) for part in ([sorted(r) for r in rows], [[r[t] for t in sorted(r)] for r in rows])]
    batch = pa.RecordBatch.from_arrays([pa.array([0] * len(rows)), pa.array([False] * len(rows)), n, *lists], names=["doc_key", "unnamed", "n", "terms", "times"])
    (bounds, terms), (_, times) = lexical._flat(lists[0]), lexical._flat(lists[1])
    row = np.repeat(np.arange(len(rows)), np.diff(bounds))
    impact = lexical._impacts(weights, n.to_numpy(), row, terms, times).astype(float)
    norm = np.sqrt(np.bincount(row, impact * impact, minlength=len(rows)))
    return lexical.Bucket(pa.RecordBatch.from_arrays([pa.array(norm), *batch.columns], names=["norm", *batch.schema.names]), weights)


def test_bounds_never_lose_a_row(monkeypatch):
    """Of random buckets, for every threshold, exactly the rows that reach it."""
    rng = random.Random(5)
    weights = lexical.Weights(np.array([rng.choice((0, 3, 500, 6000)) for _ in range(30)]), 100, 4000)
    for _ in range(40):
        b = bucket([{t: rng.randint(1, 9) for t in rng.sample(range(30), rng.randint(1, 12))} for _ in range(50)], weights)
        terms = np.array(sorted(rng.sample(range(34), 8)))
        times = np.array([rng.randint(1, 3) for _ in terms])
        all_rows, all_scores = b.scored(terms, times, 0)
        for threshold in (1, int(np.median(all_scores)), int(all_scores.max()), int(all_scores.max()) + 1):
            rows, scores = b.scored(terms, times, threshold)
            want = all_scores >= threshold
            assert rows.tolist() == all_rows[want].tolist() and scores.tolist() == all_scores[want].tolist()


def test_test_table(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(lexical, "FIRST_ROWS", 20)
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    got = sorted(map(tuple, lexical.ranked(items, docs).collect()), key=repr)
    ids = lambda df, c: [tuple(r) for r in df.select(c, "text").collect()]
    assert got == brute.ranked_rows(ids(items, "item_id"), ids(docs, "doc_id"))
