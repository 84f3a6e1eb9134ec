"""Folds of whole groups: no group in two folds, classes balanced, nothing leaks."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkgrove.operators import classify, evaluate, folds

SCHEMA = "entity_id long, label int, features array<double>"


@pytest.fixture(scope="module")
def members():
    """(entity, label, group): three large groups, many of one or two entities, some of none."""
    rng, rows = random.Random(4), []
    for g, n in [(0, 90), (1, 60), (2, 45)] + [(g, rng.choice((1, 1, 2, 7))) for g in range(3, 120)]:
        rows += [(len(rows) + i, rng.choice((0, 0, 1)), g if g % 11 else None) for i in range(n)]
    return rows


@pytest.fixture(scope="module")
def tables(spark, members):
    feat = spark.createDataFrame([(e, c, [0.0]) for e, c, _ in members], SCHEMA)
    groups = spark.createDataFrame([(e, g) for e, _, g in members if g != 50] + [(10**6, 3)], "entity_id long, group long")
    return feat, groups


@pytest.mark.parametrize("k, bucket", [(2, 100_000), (4, 3), (7, 100_000)])
def test_groups_stay_together_and_classes_are_balanced(tables, members, monkeypatch, k, bucket):
    monkeypatch.setattr(folds, "ROWS_PER_BUCKET", bucket)
    rows = folds.grouped_folds(*tables, k).collect()
    assert sorted((r.entity_id, r.label) for r in rows) == sorted(x[:2] for x in members)
    of = {}
    for r in rows:
        if r.group is not None:
            of.setdefault(r.group, set()).add(r.fold)
    assert all(len(x) == 1 for x in of.values()) and set().union(*of.values()) == set(range(k))
    sizes = Counter((r.label, r.fold) for r in rows)
    for label in (0, 1):
        found = [sizes[label, f] for f in range(k)]
        assert max(found) - min(found) <= max(4, 0.1 * sum(found) / k)


def test_same_folds_for_any_partitioning_and_few_kinds(tables, monkeypatch):
    feat, groups = tables
    one = sorted(map(tuple, folds.grouped_folds(feat, groups, 5).select("entity_id", "fold").collect()))
    assert one == sorted(map(tuple, folds.grouped_folds(feat.repartition(9, "label"), groups.repartition(7), 5).select("entity_id", "fold").collect()))
    monkeypatch.setattr(folds, "MAX_KINDS", 4)  # the rest is dealt round
    rows = folds.grouped_folds(feat, groups, 5).collect()
    assert len(rows) == len(one) and {r.fold for r in rows} == set(range(5))
    by_group = {}
    for r in rows:
        if r.group is not None:
            by_group.setdefault(r.group, set()).add(r.fold)
    assert all(len(x) == 1 for x in by_group.values())


def test_alike_groups_are_dealt_evenly(spark):
    feat = spark.range(3000).select(F.col("id").alias("entity_id"), (F.col("id") % 3).cast("int").alias("label"), F.array(F.lit(0.0)).alias("features"))
    groups = feat.select("entity_id", F.expr("entity_id div 3").alias("group"))
    sizes = folds.grouped_folds(feat, groups, 4).groupBy("fold", "label").count().collect()
    assert len(sizes) == 12 and {r["count"] for r in sizes} == {250}


def one_by_one(kinds, totals, k):
    """``shares`` as its wording has it, a group at a time."""
    held, out = [dict.fromkeys(totals, 0) for _ in range(k)], []
    for counts, n in kinds:
        out.append([0] * k)
        for _ in range(n):
            cost = lambda f: (sum(x * held[f][c] * (10**6 * max(totals.values()) ** 2 // totals[c] ** 2) for c, x in counts.items()), sum(held[f].values()), f)  # noqa: B023, E731
            fold = min(range(k), key=cost)
            out[-1][fold] += 1
            for c, x in counts.items():
                held[fold][c] += x
    return out


def test_shares_are_those_of_one_group_at_a_time():
    assert folds.shares([({0: 5}, 1), ({0: 3, 1: 1}, 1), ({1: 4}, 1), ({0: 2}, 1)], {0: 10, 1: 5}, 2) == [[1, 0], [0, 1], [1, 0], [0, 1]]
    rng = random.Random(7)
    for _ in range(50):
        kinds = [({c: rng.randint(1, 9) for c in rng.sample(range(4), rng.randint(1, 3))}, rng.choice((1, 2, 30))) for _ in range(8)]
        totals = Counter()
        for counts, n in kinds:
            totals.update({c: x * n for c, x in counts.items()})
        k = rng.randint(1, 6)
        assert folds.shares(kinds, totals, k) == one_by_one(kinds, totals, k)
    assert folds.shares([], {}, 3) == [] and folds.shares([({0: 1}, 10**12)], {0: 10**12}, 4) == [[25 * 10**10] * 4]


def test_members_of_a_group_leak_unless_they_are_kept_together(spark):
    """Groups that are recognised by their features, with labels by chance: neighbours of the
    same group give the label away, and grouped folds do not let them."""
    rng = random.Random(9)
    rows = []
    for g in range(60):
        centre, label = [rng.gauss(0, 5) for _ in range(4)], rng.randrange(2)
        rows += [(5 * g + i, label, [x + rng.gauss(0, 0.1) for x in centre]) for i in range(5)]
    feat = spark.createDataFrame(rows, SCHEMA).persist()
    groups = feat.select("entity_id", F.expr("entity_id div 5").alias("group"))
    knn = lambda train, test: classify.knn_classify(train, test, 3)
    assert evaluate.summary(evaluate.cross_validate(feat, 3, knn)).first().mean_accuracy > 0.9
    assert evaluate.summary(evaluate.cross_validate(feat, 3, knn, groups=groups)).first().mean_accuracy < 0.75


def test_one_aggregate_gives_the_models_of_all_folds(spark, tables):
    rng = random.Random(2)
    feat = spark.createDataFrame([(i, i % 4, [rng.gauss(i % 4, 2), rng.gauss(0, 1) + 1e6, 3.0]) for i in range(200)], SCHEMA)
    for classifier in classify.CLOSED_FORMS:
        at_once = sorted(map(tuple, evaluate.cross_validate(feat, 5, classifier).collect()))
        one_by_one = sorted(map(tuple, evaluate.cross_validate(feat, 5, classifier, lambda train, test: (train, test)).collect()))
        assert at_once == one_by_one and len(at_once) == 5
    # a class that lies in one fold is unknown to the model of the others; a fold may be empty
    few = spark.createDataFrame([(1, 0, [0.0]), (2, 0, [1.0]), (3, 1, [9.0])], SCHEMA)
    groups = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "entity_id long, group long")
    scores = {r.fold: r.accuracy for r in evaluate.cross_validate(few, 4, classify.nearest_centroid, groups=groups).collect()}
    assert len(scores) == 4 and sorted(scores.values(), key=repr) == [0.0, 1.0, 1.0, None]


def test_empty_table(spark, tables):
    feat, groups = tables
    assert folds.grouped_folds(feat.limit(0), groups, 3).count() == 0
    assert {r.group for r in folds.grouped_folds(feat.limit(5), groups.limit(0), 3).collect()} == {None}
