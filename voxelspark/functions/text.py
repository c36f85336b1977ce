"""Edit distances with costs of one's own, vectorised over the pairs of an Arrow batch."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class EditCosts:
    """Costs of an insertion, a deletion and a replacement; of a change of an ASCII letter's case, if it has its own; and of single pairs (from, to)."""

    insertion: float = 1.0
    deletion: float = 1.0
    replacement: float = 1.0
    case: float | None = None
    pairs: tuple[tuple[str, str, float], ...] = ()


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, filled up with -1, and their lengths."""
    length = np.array([len(t) for t in texts], int)
    out = np.full((len(texts), int(length.max(initial=0))), -1, np.int64)
    for i, t in enumerate(texts):
        out[i, : len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4")
    return out, length


def _replacing(a: np.ndarray, b: np.ndarray, costs: EditCosts) -> np.ndarray:
    out = np.where(a == b, 0.0, costs.replacement)
    if costs.case is not None:
        letter = ((a | 32) >= ord("a")) & ((a | 32) <= ord("z")) & (a >= 0) & (b >= 0)
        out = np.where(letter & (a != b) & ((a | 32) == (b | 32)), costs.case, out)
    for x, y, cost in costs.pairs:
        out = np.where((a == ord(x)) & (b == ord(y)), cost, out)
    return out


def edit_distances(left: list[str], right: list[str], costs: EditCosts) -> np.ndarray:
    """Least cost of turning each left text into its right one. One row of each pair's table is held at a time; pairs of like length are done together."""
    out = np.zeros(len(left))
    order = np.argsort([len(t) for t in left], kind="stable")
    for lo in range(0, len(order), 512):
        some = order[lo : lo + 512]
        (a, n), (b, m) = _codes([left[i] for i in some]), _codes([right[i] for i in some])
        row = np.broadcast_to(np.arange(b.shape[1] + 1) * float(costs.insertion), (len(some), b.shape[1] + 1)).copy()
        own = np.arange(len(some))
        done = np.where(n == 0, row[own, m], 0.0)
        for i in range(a.shape[1]):
            new = np.empty_like(row)
            new[:, 0] = row[:, 0] + costs.deletion
            change = _replacing(a[:, [i]], b, costs)
            for j in range(b.shape[1]):
                new[:, j + 1] = np.minimum(np.minimum(row[:, j] + change[:, j], row[:, j + 1] + costs.deletion), new[:, j] + costs.insertion)
            row = new
            at = n == i + 1
            done[at] = row[own[at], m[at]]
        out[some] = done
    return out


def weighted_edit_distance(left: Column, right: Column, costs: EditCosts = EditCosts()) -> Column:
    """Least cost of turning left into right; null where either is null. With unit costs Spark's own levenshtein does it without Python."""
    if costs == EditCosts():
        return F.levenshtein(left, right).cast("double")

    @F.pandas_udf("double")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        whole = a.notna() & b.notna()
        out = pd.Series(np.nan, index=a.index, dtype="Float64")
        out[:] = pd.NA
        out[whole] = edit_distances(a[whole].tolist(), b[whole].tolist(), costs)
        return out

    return distance(left, right)
