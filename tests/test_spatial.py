"""Neighbourhoods in the plane against all pairs."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from sparkgrove.operators import spatial

SCHEMA = "entity_id long, x double, y double, kind string"


def made(seed: int, n: int) -> list[tuple]:
    """A dense clump, places that repeat, points exactly a radius apart, far ones, odd ones."""
    rng = random.Random(seed)
    rows = [(i, rng.gauss(0, 0.4), rng.gauss(0, 0.4), rng.choice("abc")) for i in range(n)]
    rows += [(1000 + i, 2.0 * (i % 4), -1.0 * (i % 5), rng.choice(("a", None))) for i in range(n)]
    rows += [(3000, 1e15, -1e15, "a"), (3001, 1e15, -1e15, "b"), (3002, -0.0, 0.0, "a"), (3002, 0.0, -0.0, "a")]
    return rows + [(None, 0.0, 0.0, "a"), (4000, None, 1.0, "a"), (4001, float("nan"), 1.0, "a"), (4002, 1.0, float("inf"), "a")]


def brute(rows: list[tuple], radius: float) -> list[tuple]:
    rows = [r for r in rows if r[0] is not None and r[1] is not None and math.isfinite(r[1]) and math.isfinite(r[2])]
    return [
        (a[0], a[3], Counter(b[3] for j, b in enumerate(rows) if j != i and (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= radius * radius)) for i, a in enumerate(rows)
    ]


@pytest.mark.parametrize("radius, part", [(0.3, 2048), (1.0, 7), (2.0, 1)])
def test_counts_are_those_of_all_pairs(spark, monkeypatch, radius, part):
    monkeypatch.setattr(spatial, "PART", part)
    rows = made(int(radius * 10), 80)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = brute(rows, radius)
    got = sorted(((r.entity_id, r.kind, r.n) for r in spatial.neighbour_kinds(df, radius).collect()), key=repr)
    assert got == sorted(((i, k, n) for i, _, c in want for k, n in c.items()), key=repr)
    per = sorted((r.entity_id, r.n_neighbours, r.n_same, r.entropy) for r in spatial.neighbourhoods(df, radius).collect())
    wanted = sorted((i, sum(c.values()), c[k], -sum(n / sum(c.values()) * math.log(n / sum(c.values())) for n in c.values()) if c else None) for i, k, c in want)
    assert [x[:3] for x in per] == [x[:3] for x in wanted]
    assert all(a[3] == b[3] if b[3] is None else a[3] == pytest.approx(b[3], abs=1e-12) for a, b in zip(per, wanted))


def test_parts_boxes_and_matrices_of_any_size(spark, monkeypatch):
    """Few bytes are dealt to as many tasks as their pairs ask for; small parts change nothing."""
    rows = made(4, 60)
    df = spark.createDataFrame(rows, SCHEMA)
    places = spatial._usable(df).groupBy("x", "y", "kind").count().withColumnRenamed("count", "n")
    want = sorted(((i, k, n) for i, _, c in brute(rows, 1.0) for k, n in c.items()), key=repr)
    for name, value in (("PART", 7), ("NEAR", 5), ("BOX", 3), ("MATRIX", 20), ("TASK_PAIRS", 500)):
        monkeypatch.setattr(spatial, name, value)
    plan = spatial._around(places, 1.0)._jdf.queryExecution().executedPlan().toString()
    dealt = [int(n) for n in re.findall(r"hashpartitioning\(cx.*, (\d+)\), REPARTITION_BY_NUM", plan)]
    assert len(dealt) == 2 and dealt[0] == dealt[1] > 4
    assert sorted(((r.entity_id, r.kind, r.n) for r in spatial.neighbour_kinds(df, 1.0).collect()), key=repr) == want


def test_one_place_holds_most_points(spark):
    """20,000 points at a place are a count, not pairs."""
    df = spark.range(20_000).selectExpr("id AS entity_id", "IF(id < 5, double(id), 0.0D) AS x", "0.0D AS y", "IF(id % 2 = 0, 'a', 'b') AS kind")
    got = {r.entity_id: (r.n_neighbours, r.n_same) for r in spatial.neighbourhoods(df, 1.0).collect()}
    assert got[0] == (19_996, 9_998 - 1) and got[1] == (19_996 + 1, 9_998) and got[4] == (1, 0) and got[10_000] == (19_996, 9_997)


def test_no_cross_join_and_crowded_cells_are_split(spark, monkeypatch):
    monkeypatch.setattr(spatial, "PART", 10)
    rng = random.Random(1)
    places = spark.createDataFrame([(rng.random(), rng.random(), "a", 1) for _ in range(500)], "x double, y double, kind string, n long")
    around = spatial._around(places, 1.0)
    plan = around._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "part" in plan
    assert around.count() == 500


def test_empty_table_and_bad_radius(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert spatial.neighbour_kinds(none, 1.0).count() == spatial.neighbourhoods(none, 1.0).count() == 0
    for radius in (0.0, -1.0, float("nan")):
        with pytest.raises(ValueError, match="radius"):
            spatial.neighbour_kinds(none, radius)
