"""Ratios of what a stratified sample of labels says about a population, with intervals by draws from Beta posteriors."""

from __future__ import annotations

import zlib
from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Draws, and what is added to positives and to others (Jeffreys).
DRAWS, PRIOR = 10_000, 0.5


def ratio(cells: pd.DataFrame, top: np.ndarray, bottom: np.ndarray | float, seed: int, draws: int = DRAWS, confidence: float = 0.95) -> tuple[float | None, float | None, float | None]:
    """value, low, high of sum(top * Y) / sum(bottom * Y), or over a constant; Y are a cell's positives in its population.

    cells: stratum, population, labelled, positive. A cell's unlabelled rows are positive at its own rate, one without labels
    at its stratum's. All are null where a cell that counts has no label in its whole stratum, or where the denominator is none.
    """
    n, r, size = (cells[c].to_numpy(float) for c in ("labelled", "positive", "population"))
    _, of = np.unique(cells["stratum"].to_numpy().astype(str), return_inverse=True)
    all_n, all_r = np.bincount(of, n), np.bincount(of, r)
    ratio_of = not np.isscalar(bottom)
    counts = (top != 0) | ((bottom != 0) if ratio_of else False)
    if (counts & (all_n[of] == 0) & (size > 0)).any():
        return None, None, None
    own_n, own_r = np.where(n > 0, n, all_n[of]), np.where(n > 0, r, all_r[of])

    def value(rates: np.ndarray) -> np.ndarray:
        y = r + (size - n) * rates
        low = y @ bottom if ratio_of else np.full(y.shape[:-1], float(bottom))
        return np.divide(y @ top, low, out=np.full(np.shape(low), np.nan), where=low != 0)

    point = float(value(np.divide(own_r, own_n, out=np.zeros(len(n)), where=own_n > 0)[None, :])[0])
    if np.isnan(point):
        return None, None, None
    rng = np.random.default_rng(seed)
    shared = np.where(all_n > 0, rng.beta(PRIOR + all_r, PRIOR + all_n - all_r, (draws, len(all_n))), 0.0)
    rates = np.where(n > 0, rng.beta(PRIOR + r, PRIOR + n - r, (draws, len(n))), shared[:, of])
    drawn = np.sort(value(rates))
    drawn = drawn[~np.isnan(drawn)]
    if not len(drawn):
        return point, None, None
    tail = (1 - confidence) / 2
    at = lambda q: float(drawn[min(len(drawn) - 1, int(q * len(drawn)))])
    return point, at(tail), at(1 - tail)


def label_ratios(cells: pd.DataFrame, seed: int, draws: int = DRAWS) -> list[tuple[str, float | None, float | None, float | None]]:
    """Precision and recall of both policies and their differences, from cells with kept_now and kept_then."""
    if not (cells["labelled"] > 0).any():
        return []
    now, then = (cells[c].to_numpy(float) for c in ("kept_now", "kept_then"))
    size, every = cells["population"].to_numpy(float), np.ones(len(cells))
    kept_now, kept_then = float(size @ now), float(size @ then)
    asked: Mapping[str, tuple[np.ndarray, np.ndarray | float]] = {"recall_now": (now, every), "recall_then": (then, every), "recall_change": (then - now, every)}
    asked |= {"precision_now": (now, kept_now)} if kept_now else {}
    asked |= {"precision_then": (then, kept_then)} if kept_then else {}
    asked |= {"precision_change": (then / kept_then - now / kept_now, 1.0)} if kept_now and kept_then else {}
    return [(name, *ratio(cells, a, b, seed, draws)) for name, (a, b) in asked.items()]


def estimates(cells: DataFrame, by: str, seed: int = 0, draws: int = DRAWS) -> DataFrame:
    """by, name, value, low, high of every group's ratios; a task draws for one group's cells at a time.

    cells: by, stratum, kept_now, kept_then, population, labelled, positive, summed before (see replay.cells), so that a group
    has a few rows for each stratum. Draws are seeded by `seed` and the group, and don't depend on the order of rows.
    """
    rows = cells.groupBy(by, "stratum", "kept_now", "kept_then").agg(*[F.sum(c).cast("long").alias(c) for c in ("population", "labelled", "positive")])
    kind = dict(cells.dtypes)[by]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.assign(stratum=group["stratum"].astype(str)).sort_values(["stratum", "kept_now", "kept_then"])
        found = label_ratios(group, zlib.crc32(f"{seed}:{group[by].iloc[0]}".encode()), draws)
        return pd.DataFrame([(group[by].iloc[0], *f) for f in found], columns=[by, "name", "value", "low", "high"])

    return rows.groupBy(by).applyInPandas(run, f"{by} {kind}, name string, value double, low double, high double")
