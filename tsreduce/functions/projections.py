"""Projections onto the simplex and the orthant, for vectors and for long tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tsreduce.sources.scratch import Scratch


def onto_simplex(v: np.ndarray) -> np.ndarray:
    """The nearest vector of non-negative weights that sum to one; of a single component, one."""
    if len(v) == 1:
        return np.ones(1)
    u = np.sort(v)[::-1]
    over = np.cumsum(u) - 1
    rank = np.arange(1, len(v) + 1)
    k = np.flatnonzero(u * rank > over)[-1]
    return np.maximum(v - over[k] / (k + 1), 0.0)


def onto_orthant(v: np.ndarray) -> np.ndarray:
    return np.maximum(v, 0.0)


#: A vector of more values than this is projected by rounds over all tasks, a shorter one by a window in one.
LONG = 1 << 20


def project_rows(rows: DataFrame, by: str, index: str, value: str, *, scratch: Scratch | None = None, max_rounds: int = 200, long: int = LONG) -> DataFrame:
    """Each vector of a long table (by, index, value) onto the simplex: (by, index, weight).

    Values are moved once: a window over a vector, largest value first, has the threshold (sum - 1) / k of each k values, and
    the last that its value exceeds is the vector's. Only vectors of more than `long` values, which may be larger than any
    task, go through rounds. A vector of one value gets weight one; nulls count for nothing and get none, nor do rows
    without `by`.
    """
    values = rows.select(by, index, F.col(value).cast("double").alias("__v")).where(F.col("__v").isNotNull() & F.col(by).isNotNull())
    own = Scratch(rows.sparkSession)
    lengths = values.groupBy(by).agg(F.count(F.lit(1)).alias("__n"))
    found = own.store(lengths.where(F.col("__n") > long).select(by))
    if found.isEmpty():
        own.close()
        return _by_window(values, by, index)
    by_rounds = _by_rounds(values.join(found, by, "left_semi"), by, index, own, max_rounds)
    if scratch is not None:
        scratch.adopt(own)
    return _by_window(values.join(found, by, "left_anti"), by, index).unionByName(by_rounds)


def _by_window(values: DataFrame, by: str, index: str) -> DataFrame:
    """(by, index, weight) of values (by, index, __v); sums are those of differences from a vector's largest value."""
    whole = Window.partitionBy(by)
    falling = whole.orderBy(F.desc("__v"))
    below = values.withColumn("__d", F.col("__v") - F.max("__v").over(whole))
    tau = (F.sum("__d").over(falling.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1) / F.row_number().over(falling)
    met = below.withColumn("__tau", tau).withColumn("__tau", F.max(F.when(F.col("__d") > F.col("__tau"), F.col("__tau"))).over(whole))
    return met.where("__tau IS NOT NULL").select(by, index, F.greatest(F.col("__d") - F.col("__tau"), F.lit(0.0)).alias("weight"))


def _by_rounds(values: DataFrame, by: str, index: str, own: Scratch, max_rounds: int) -> DataFrame:
    """As _by_window, for vectors of any length.

    The threshold of a vector is (sum - 1) / n of the values above the threshold before, until none falls below it. Each
    round is one filter and one aggregate; sums are pre-aggregated. Rounds end as each leaves out a value of every vector
    that goes on, and in practice after a few; the thresholds between rounds are a table.
    """

    def threshold(kept: DataFrame) -> DataFrame:
        return kept.groupBy(by).agg(((F.sum("__v") - 1) / F.count(F.lit(1))).alias("__tau"), F.count(F.lit(1)).alias("__n"))

    now = own.store(threshold(values))
    for _ in range(max_rounds):
        above = threshold(values.join(now.select(by, "__tau"), by).where("__v > __tau").drop("__tau"))
        before = now.select(by, F.col("__tau").alias("__was"), F.col("__n").alias("__before"))
        # a threshold never falls, so rounding can't bring a value back
        after = above.join(before, by).select(by, F.greatest("__tau", "__was").alias("__tau"), "__n", (F.col("__n") < F.col("__before")).alias("__on"))
        after = own.store(after)
        own.drop(now)
        now = after
        if now.where("__on").isEmpty():
            break
    else:
        raise RuntimeError(f"thresholds have not settled in {max_rounds} rounds")
    return values.join(now.select(by, "__tau"), by).select(by, index, F.greatest(F.col("__v") - F.col("__tau"), F.lit(0.0)).alias("weight"))


def orthant_rows(rows: DataFrame, value: str) -> DataFrame:
    """rows with weight: the value, or 0 where that is negative; null and NaN stay."""
    v = F.col(value)
    return rows.withColumn("weight", F.when(v < 0, F.lit(0.0)).otherwise(v))


def descend(x: np.ndarray, subgradient: Callable, projection: Callable, *, niters: int = 1000, tol: float = 1e-5, learning_rate: float = 1e-3, adaptive: bool = False) -> np.ndarray:
    """Projected subgradient descent (W3). It ends once no component grows by more than tol / niters, without that last step."""
    x = projection(np.asarray(x, float))
    seen = np.zeros(len(x))
    for _ in range(niters):
        g = subgradient(x)
        rate = learning_rate
        if adaptive:
            seen += g * g
            rate = learning_rate / (1e-6 + np.sqrt(seen))
        after = projection(x - rate * g)
        if (after - x).max() <= tol / niters:
            break
        x = after
    return x


def onto_simplex_rows(v: np.ndarray) -> np.ndarray:
    """onto_simplex of each row."""
    if v.shape[1] == 1:
        return np.ones_like(v)
    u = -np.sort(-v, axis=1)
    over = np.cumsum(u, axis=1) - 1
    rank = np.arange(1, v.shape[1] + 1)
    k = v.shape[1] - 1 - np.argmax((u * rank > over)[:, ::-1], axis=1)
    return np.maximum(v - (np.take_along_axis(over, k[:, None], 1) / (k[:, None] + 1)), 0.0)


def descend_rows(x: np.ndarray, gram: np.ndarray, products: np.ndarray, projection: Callable, *, niters: int = 1000, tol: float = 1e-5, learning_rate: float = 1e-3, adaptive: bool = False) -> np.ndarray:
    """descend for every row of x at once: weights of points whose products with one another are gram, and with each row's target products.

    A row that has ended stays as it is while the others go on.
    """
    x = projection(np.asarray(x, float))
    seen = np.zeros_like(x)
    on = np.arange(len(x))
    for _ in range(niters):
        if not len(on):
            break
        g = x[on] @ gram - products[on]
        rate = learning_rate
        if adaptive:
            seen[on] += g * g
            rate = learning_rate / (1e-6 + np.sqrt(seen[on]))
        after = projection(x[on] - rate * g)
        going = (after - x[on]).max(1) > tol / niters
        on = on[going]
        x[on] = after[going]
    return x
