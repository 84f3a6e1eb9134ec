"""Features from cells: by hand, exact quantiles against sorting, one entity split among tasks."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from sparkgrove.operators import cells, impute
from sparkgrove.sources.features import checked

SCHEMA = "entity_id long, kind string, value double"


def test_by_hand(spark):
    rows = [(1, "a", 1.0), (1, "a", 3.0), (1, "b", 10.0), (1, "b", None), (1, None, 100.0), (2, None, float("nan")), (None, "c", 5.0), (3, "a", float("inf"))]
    got = {r.entity_id: r.asDict() for r in cells.cell_features(spark.createDataFrame(rows, SCHEMA), (0.5, 0.125)).collect()}
    one = got[1]
    assert (one["n_cells"], one["n_kinds"], one["n_a"], one["n_b"]) == (5, 2, 2, 2) and one["entropy"] == pytest.approx(math.log(2))
    assert (one["share_a"], one["mean_a"], one["mean_b"]) == (0.5, 2.0, 10.0) and (one["q_50"], one["q_12p5"]) == (6.5, 1.75)
    assert (got[2]["n_cells"], got[2]["n_kinds"], got[2]["n_a"], got[2]["entropy"], got[2]["share_a"], got[2]["q_50"]) == (1, 0, 0, None, None, None)
    assert got[3]["share_a"] == 1 and got[3]["entropy"] == 0 and got[3]["mean_a"] is None and set(got) == {1, 2, 3}


def odd_values(seed: int, n: int) -> list[float]:
    """Ties, tiny and huge numbers, both signs."""
    rng = random.Random(seed)
    return [rng.choice((0.0, -0.0, 5e-324, -1.7e308, 1.7e308, rng.gauss(0, 1), rng.gauss(0, 1) * 10.0 ** rng.randint(-300, 300), float(rng.randint(0, 3)))) for _ in range(n)]


@pytest.mark.parametrize("leaf, buckets", [(4096, 1024), (16, 8), (1, 2)])
def test_quantiles_are_exact(spark, monkeypatch, leaf, buckets):
    monkeypatch.setattr(cells, "LEAF", leaf)
    monkeypatch.setattr(cells, "BUCKETS", buckets)
    rng = random.Random(6)
    of = {1: [rng.gauss(0, 1) for _ in range(300)], 2: [float(rng.randint(0, 5)) for _ in range(200)], 3: [7.5], 4: [2.0] * 90}
    if leaf > 1:
        of[5] = odd_values(2, 120)
    probs = (0.0, 0.1, 1 / 3, 0.5, 0.99, 1.0)
    rows = [(e, "k", v) for e, vs in of.items() for v in vs]
    rng.shuffle(rows)
    got = {r.entity_id: r.quantiles for r in cells.quantiles(spark.createDataFrame(rows, SCHEMA).repartition(5), probs).collect()}
    assert set(got) == set(of)
    for e, vs in of.items():
        vs = sorted(vs)
        for p, q in zip(probs, got[e]):
            place = (len(vs) - 1) * p
            low = math.floor(place)
            way, high = place - low, vs[min(low + 1, len(vs) - 1)]
            want = vs[low] + ((high / 2 - vs[low] / 2) * way * 2 if math.isinf(high - vs[low]) else (high - vs[low]) * way)
            assert q == want or q == pytest.approx(want, rel=1e-12)


def test_one_entity_holds_nearly_all_cells(spark):
    df = spark.range(200_000).selectExpr("IF(id % 1000 = 0, id, 7) AS entity_id", "IF(id % 3 = 0, 'a', 'b') AS kind", "double(id * 7919 % 200000) AS value").repartition(8)
    got = {r.entity_id: r for r in cells.cell_features(df).collect()}
    values = sorted(i * 7919 % 200_000 for i in range(200_000) if i % 1000)
    assert len(got) == 201 and [got[7].q_25, got[7].q_50, got[7].q_75] == np.quantile(np.array(values, float), (0.25, 0.5, 0.75)).tolist()
    assert got[7].n_cells == len(values) and got[7].n_a + got[7].n_b == len(values)
    # counting is by partial sums in every task, not by gathering the entity
    big = cells._held(cells._values(df), df.selectExpr("7L AS entity_id", "0.0D AS low", "2e5D AS high").limit(1))
    counted = big.groupBy("entity_id").count()._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in counted


def test_cells_become_a_feature_table(spark):
    rng = random.Random(3)
    rows = [(e, rng.choice("ab"), rng.gauss(e % 2, 1)) for e in range(20) for _ in range(30)] + [(99, None, None)]
    wide = cells.cell_features(spark.createDataFrame(rows, SCHEMA))
    feat = cells.as_features(wide)
    filled = impute.mean_fill(feat)
    assert checked(filled, label_col=None).count() == 21 and len(feat.first().features) == len(wide.columns) - 1
    assert [r.features for r in cells.as_features(wide, ["n_cells"]).where("entity_id = 99").collect()] == [[1.0]]


def test_empty_table_and_too_many_kinds(spark, monkeypatch):
    none = spark.createDataFrame([], SCHEMA)
    assert cells.cell_features(none).count() == 0 and cells.quantiles(none).count() == 0
    monkeypatch.setattr(cells, "MAX_KINDS", 2)
    with pytest.raises(ValueError, match="more than 2 kinds"):
        cells.cell_features(spark.createDataFrame([(1, k, 1.0) for k in "abc"], SCHEMA))
