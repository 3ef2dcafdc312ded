"""Distances between feature vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names and their synonyms.
NAMES = {"euclidean": "euclidean", "cityblock": "cityblock", "manhattan": "cityblock", "cosine": "cosine", "chebyshev": "chebyshev"}


def parse(name: str) -> str:
    if name not in NAMES:
        raise ValueError(f"unknown distance {name!r}")
    return NAMES[name]


def show(name: str) -> str:
    """The distance's own name, whatever synonym is given; another name as it is."""
    return NAMES.get(name, name)


def to_rows(metric: str, points: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of each row of points to y. The cosine distance to a zero vector is NaN."""
    metric = parse(metric)
    if metric == "cosine":
        with np.errstate(invalid="ignore", divide="ignore"):
            return 1 - points @ y / (np.linalg.norm(points, axis=1) * np.linalg.norm(y))
    d = np.abs(points - y)
    return {"euclidean": lambda: np.sqrt((d * d).sum(1)), "cityblock": lambda: d.sum(1), "chebyshev": lambda: d.max(1, initial=0.0)}[metric]()


def pairwise(metric: str, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.stack([to_rows(metric, x, v) for v in y], axis=1) if len(y) else np.zeros((len(x), 0))


def column(metric: str, x: Column, y: Column) -> Column:
    """The distance between two array columns of one length, without Python."""
    metric = parse(metric)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    zip_ = lambda f: F.zip_with(x, y, f)
    if metric == "euclidean":
        return F.sqrt(total(zip_(lambda a, b: (a - b) * (a - b))))
    if metric == "cityblock":
        return total(zip_(lambda a, b: F.abs(a - b)))
    if metric == "chebyshev":
        return F.array_max(zip_(lambda a, b: F.abs(a - b)))
    norm = lambda a: F.sqrt(total(F.transform(a, lambda v: v * v)))
    both = norm(x) * norm(y)
    return F.when(both == 0, F.lit(float("nan"))).otherwise(1 - F.try_divide(total(zip_(lambda a, b: a * b)), both))
