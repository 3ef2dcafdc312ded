"""Blended weights of representatives."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsreduce.functions.projections import descend_rows, onto_orthant, onto_simplex_rows
from tsreduce.operators import tiles
from tsreduce.operators.clustering import WEIGHTS, ClusteringResult
from tsreduce.operators.tiles import Tiles
from tsreduce.sources.scratch import Scratch

#: A type of weights, the projection that keeps to it, and whether a zero vector joins in.
TYPES = {"convex": (onto_simplex_rows, False), "conical": (onto_orthant, False), "conical_bounded": (onto_simplex_rows, True)}


def _dense(t: Tiles, weights: DataFrame, n_rp: int) -> DataFrame:
    """(period, w): the weights of each period as an array over representatives."""
    cells = weights.where(F.col("rep_period") <= n_rp).groupBy("period").agg(F.map_from_entries(F.collect_list(F.struct("rep_period", "weight"))).alias("m"))
    index = F.sequence(F.lit(1).cast("long"), F.lit(n_rp).cast("long"))
    return t.periods.join(cells, "period", "left").select("period", F.transform(index, lambda r: F.coalesce(F.col("m")[r], F.lit(0.0))).alias("w"))


def _rows(b: pa.RecordBatch, name: str) -> np.ndarray:
    return tiles.matrix(pa.chunked_array([b.column(name)]))


def fit_weights(result: ClusteringResult, weight_type: str, *, tol: float = 1e-2, niters: int = 1000, learning_rate: float = 1e-3, adaptive: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """(period, rep_period, weight) as fitted; a weight of 0 has no row.

    All periods start from the given weights or from least squares, whichever leaves the smaller error in total. A
    period that starts within tol keeps its given weights. A period's descent needs only its products with the
    representatives, which tiles sum up; a batch of periods descends at once. What the result reads is kept by scratch,
    or the result's own.
    """
    if weight_type == "dirac":
        return result.weights
    if weight_type not in TYPES:
        raise ValueError(f"unknown weight type {weight_type!r}")
    projection, with_null = TYPES[weight_type]
    t, reps, scratch = result.features, result.representatives, scratch or result.scratch
    gram = tiles.gram(t, reps)
    n_rp = len(gram)
    if with_null:
        gram = np.pad(gram, ((1, 0), (1, 0)))
    inverse = np.linalg.pinv(gram, hermitian=True)
    joined = tiles.measures(t, reps, "dot").select("period", F.col("d").alias("b")).join(_dense(t, result.weights, n_rp), "period")

    def starts(it):
        for b in it:
            if b.num_rows:
                products, given = (np.pad(_rows(b, c), ((0, 0), (int(with_null), 0))) for c in ("b", "w"))
                yield pa.RecordBatch.from_arrays([b.column("period"), tiles.lists(products), b.column("w"), tiles.lists(projection(given)), tiles.lists(projection(products @ inverse))], ["period", "b", "w", "first", "second"])

    begun = scratch.store(joined.select("period", "b", "w").mapInArrow(starts, "period long, b array<double>, w array<double>, first array<double>, second array<double>"))
    # the zero vector adds nothing to a blend
    plain = lambda c: F.slice(c, 2, n_rp) if with_null else F.col(c)
    left = tiles.residuals(t, reps, begun.select("period", F.concat(plain("first"), plain("second")).alias("w"))).withColumnRenamed("d", "errors")
    errors = scratch.store(left)
    a, b = errors.agg(F.sum(F.col("errors")[0] * F.col("errors")[0]), F.sum(F.col("errors")[1] * F.col("errors")[1])).first()
    which = 0 if (a or 0.0) <= (b or 0.0) else 1
    start = begun.join(errors, "period").select("period", "b", "w", F.col("second" if which else "first").alias("start"), F.col("errors")[which].alias("before"))

    def descended(it):
        for r in it:
            if r.num_rows:
                x = descend_rows(_rows(r, "start"), gram, _rows(r, "b"), projection, tol=tol * 0.01, niters=niters, learning_rate=learning_rate, adaptive=adaptive)
                yield pa.RecordBatch.from_arrays([*(r.column(c) for c in ("period", "w", "start", "before")), tiles.lists(x)], ["period", "w", "start", "before", "x"])

    moved = scratch.store(start.mapInArrow(descended, "period long, w array<double>, start array<double>, before double, x array<double>"))
    after = tiles.residuals(t, reps, moved.select("period", plain("x").alias("w"))).select("period", F.col("d")[0].alias("after"))

    def fitted(it):
        for r in it:
            if not r.num_rows:
                continue
            given, x, start, before, after = _rows(r, "w"), _rows(r, "x"), _rows(r, "start"), r.column("before").to_numpy(), r.column("after").to_numpy()
            x = np.where((after > before)[:, None], start, x)
            x = np.where(x < tol, 0.0, x)
            total = x.sum(1, keepdims=True)
            if weight_type == "convex" or with_null:
                with np.errstate(invalid="ignore", divide="ignore"):
                    x = np.where((total > 1) | (weight_type == "convex"), x / total, x)
            x = np.where((before <= tol)[:, None], given, x[:, 1:] if with_null else x)
            at, rep = np.nonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array(r.column("period").to_numpy()[at]), pa.array(rep + 1), pa.array(x[at, rep])], ["period", "rep_period", "weight"])

    out = scratch.store(moved.join(after, "period").mapInArrow(fitted, WEIGHTS))
    scratch.drop(begun, errors, moved)
    # an incomplete last period is its own representative, beyond those that are fitted
    return out.unionByName(result.weights.where(F.col("rep_period") > n_rp))


def projection_error(t: Tiles, weights: DataFrame, representatives: DataFrame) -> float:
    """The Frobenius norm of what the weighted representatives leave of the complete periods."""
    n_rp = representatives.agg(F.max("rep_period")).first()[0]
    d = F.col("d")[0]
    return math.sqrt(tiles.residuals(t, representatives, _dense(t, weights, n_rp)).agg(F.sum(d * d)).first()[0] or 0.0)


def rp_weight(weights: DataFrame, operations_weight: float) -> DataFrame:
    return weights.groupBy("rep_period").agg((F.sum("weight") * operations_weight).alias("weight"))
