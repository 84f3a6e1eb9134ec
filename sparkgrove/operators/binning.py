"""Features as numbers of bins whose cuts lie in gaps between values.

Cuts at quantiles fall wherever their rank does, also inside a class that a gap sets apart;
a tree that may only cut there mixes the classes at each cut. Here each cut moves, within half
a bin by rank, into the widest gap. All rows are counted: approximate quantiles part each
feature into segments, these into cells of equal width, and the counts, least and greatest
values of the cells, a bounded number for each feature, give ranks and gaps.

Features are complete (as ``read_features`` checks). A gap within a cell is not seen; where
cells leave no choice a feature has fewer bins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import to_long, width_of

#: Cells of a segment; cells of all features in a task at most.
CELLS, MAX_CELLS = 64, 4_000_000


def _counted(edges: list[np.ndarray], cells: int):
    """Task function: pos, cell, n, least, most of the cells that hold values."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sizes = [max(1, len(e) - 1) * cells for e in edges]
        n = [np.zeros(s, np.int64) for s in sizes]
        least, most = [np.full(s, np.inf) for s in sizes], [np.full(s, -np.inf) for s in sizes]
        for pdf in batches:
            for p, v in enumerate(np.stack(pdf["features"].to_numpy()).astype(float).T if len(pdf) else ()):
                e = edges[p]
                segment = np.clip(np.searchsorted(e, v, side="right") - 1, 0, max(0, len(e) - 2))
                low, high = e[segment], e[np.minimum(segment + 1, len(e) - 1)]
                way = (v - low) / np.where(high > low, high - low, 1.0)
                cell = segment * cells + np.clip((way * cells).astype(np.int64), 0, cells - 1)
                n[p] += np.bincount(cell, minlength=sizes[p])
                np.minimum.at(least[p], cell, v)
                np.maximum.at(most[p], cell, v)
        for p in range(len(edges)):
            held = np.flatnonzero(n[p])
            if len(held):
                yield pd.DataFrame({"pos": p, "cell": held, "n": n[p][held], "least": least[p][held], "most": most[p][held]})

    return run


def _chosen(n: np.ndarray, least: np.ndarray, most: np.ndarray, bins: int) -> np.ndarray:
    """Cuts of one feature, from its cells in order: of the gaps nearest to each wanted rank
    the widest, ties to the lower."""
    up_to, width = np.cumsum(n)[:-1], least[1:] - most[:-1]
    wanted = np.clip(np.rint(up_to * bins / n.sum()), 1, bins - 1)
    cuts = []
    for w in np.unique(wanted):
        i = np.flatnonzero(wanted == w)
        i = i[width[i].argmax()]
        middle = most[i] + width[i] / 2
        cuts.append(middle if middle < least[i + 1] else most[i])
    return np.array(cuts)


def gap_cuts(train: DataFrame, bins: int) -> list[np.ndarray]:
    """By feature: at most ``bins`` - 1 cuts, ascending. A value equal to a cut lies below it."""
    width = width_of(train)
    marks = F.percentile_approx("v", [i / bins for i in range(1, bins)], 10_000)
    found = to_long(train).groupBy("pos").agg(F.min("v").alias("low"), F.max("v").alias("high"), marks.alias("marks")).collect()
    edges = [np.unique([r.low, *r.marks, r.high]) for r in sorted(found, key=lambda r: r.pos)]
    cells = int(min(CELLS, max(1, MAX_CELLS // (bins * max(1, width)))))
    counted = train.select("features").mapInPandas(_counted(edges, cells), "pos int, cell long, n long, least double, most double")
    merged = counted.groupBy("pos", "cell").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:  # the cells of one feature
        pdf = pdf.sort_values("least")
        return pd.DataFrame({"pos": [pdf["pos"].iloc[0]], "cuts": [_chosen(*(pdf[c].to_numpy() for c in ("n", "least", "most")), bins)]})

    made = {r.pos: np.array(r.cuts) for r in merged.groupBy("pos").applyInPandas(run, "pos int, cuts array<double>").collect()}
    return [made.get(p, np.zeros(0)) for p in range(len(edges))]


def binned(feat: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """entity_id, label, features: of each element, how many of its cuts lie below."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["features"].to_numpy()).astype(float)
                codes = np.column_stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)]).astype(float)
                yield pdf.assign(features=list(codes))

    return feat.select("entity_id", "label", "features").mapInPandas(run, "entity_id long, label int, features array<double>")
