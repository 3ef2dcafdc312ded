"""Representative periods.

Periods are tiles of cells (see tiles.py), representatives are rows (rep_period, block, x). The driver gets one row a
round, or as many numbers as the number of representatives bounds; what a round leaves for the next is a table.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsreduce.functions import metrics
from tsreduce.functions.projections import descend_rows, onto_simplex_rows
from tsreduce.operators import tiles
from tsreduce.operators.reshape import append_period, key_columns
from tsreduce.operators.tiles import Tiles
from tsreduce.sources.scratch import Scratch

#: Periods that matrix() gathers for a look at them.
MOST_PERIODS = 20_000
WEIGHTS = "period long, rep_period long, weight double"


@dataclass(frozen=True)
class Auxiliary:
    key_columns: list[str]
    period_duration: int
    last_period_duration: int
    n_periods: int


@dataclass
class ClusteringResult:
    """profiles (rep_period, keys, value), weights (period, rep_period, weight), the tiles of the periods, and representatives (rep_period, block, x).

    What they are read from is kept until release().
    """

    profiles: DataFrame
    weights: DataFrame
    features: Tiles | None = None
    representatives: DataFrame | None = None
    scratch: Scratch | None = None

    @cached_property
    def rp_matrix(self) -> np.ndarray:
        """A row for each representative, for a look at them."""
        return gathered(self.representatives)

    def release(self) -> None:
        if self.scratch is not None:
            self.scratch.close()


def auxiliary(df: DataFrame) -> Auxiliary:
    row = df.agg(F.max("period").alias("n"), F.max("timestep").alias("d"), F.max_by("timestep", F.struct("period", "timestep")).alias("last")).first()
    return Auxiliary(key_columns(df), row["d"], row["last"], row["n"])


def period_weights(period_duration: int, last_duration: int, n_periods: int, drop_incomplete: bool) -> tuple[float, float | None]:
    """(weight of a complete period, weight of an incomplete last one or None)."""
    if last_duration == period_duration:
        return 1.0, None
    if not drop_incomplete:
        return 1.0, 1.0
    whole = period_duration * (n_periods - 1)
    return (whole + last_duration) / whole, None


def method_for(clustering_type: str, weight_type: str) -> str:
    if clustering_type != "hull":
        return clustering_type
    return {"conical": "conical_hull", "conical_bounded": "convex_hull_with_null"}.get(weight_type, "convex_hull")


def gathered(representatives: DataFrame) -> np.ndarray:
    rows = representatives.groupBy("rep_period").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", "x"))), lambda c: c["x"])).alias("x")).orderBy("rep_period").collect()
    return np.array([r["x"] for r in rows], float)


def matrix(t: Tiles) -> tuple[np.ndarray, np.ndarray]:
    """(periods, a row of features for each), in order of period, of a few periods."""
    if t.n_periods > MOST_PERIODS:
        raise ValueError(f"more than {MOST_PERIODS} periods")
    return np.array(sorted(r["period"] for r in t.periods.collect()), np.int64), gathered(t.cells.withColumnRenamed("period", "rep_period"))


def periods_as_reps(t: Tiles, periods: list[int]) -> DataFrame:
    """These periods as representatives, in this order."""
    chosen = t.cells.sparkSession.createDataFrame([(k + 1, int(p)) for k, p in enumerate(periods)], "rep_period long, period long")
    return t.cells.join(chosen, "period").select("rep_period", "block", "x")


def _nearest_of(d: Column) -> Column:
    """The place of the smallest distance, from 1; NaN is smaller than all, and of equals the first counts."""
    low = F.transform(d, lambda x: F.when(F.isnan(x), F.lit(float("-inf"))).otherwise(x))
    return F.array_position(low, F.array_min(low)).cast("long")


def nearest(t: Tiles, representatives: DataFrame, metric: str) -> DataFrame:
    """(period, rep_period): the nearest of the representatives, of equals the first."""
    return tiles.measures(t, representatives, metric).select("period", _nearest_of(F.col("d")).alias("rep_period"))


def _smallest(costs: DataFrame, k: int) -> list[int]:
    return [r["period"] for r in costs.orderBy("v", "period").limit(k).collect()]


def k_means_seeds(t: Tiles, k: int, scratch: Scratch) -> list[int]:
    """The k periods of the smallest sum over i of d(i, j) / S(i), S(i) the sum over l of d(i, l), for squared Euclidean distances d.

    With sums over all periods alone: d(i, j) = q(i) + q(j) - 2 x(i) x(j), q the square of a period, so S(i) = n q(i) + Q - 2 x(i) s
    with the sums Q and s of squares and of vectors, and the cost of j is A + q(j) B - 2 x(j) C with A, B and C the sums
    of q / S, 1 / S and x / S. If no two periods differ, all cost nothing.
    """
    ones = t.periods.select("period", F.lit(1).alias("rep_period"), F.lit(1.0).alias("weight"))
    told = scratch.store(tiles.measures(t, tiles.sums(t, ones), "dot", "square").select("period", F.col("d")[0].alias("xs"), F.col("d")[1].alias("q")))
    square = told.agg(F.sum("q")).first()[0] or 0.0
    share = F.col("q") * t.n_periods + F.lit(square) - 2 * F.col("xs")
    # what rounding leaves of nothing counts as nothing
    shares = told.select("period", "q", F.when(share > 1e-12 * square, 1 / share).otherwise(0.0).alias("weight"))
    a, b = shares.agg(F.sum(F.col("q") * F.col("weight")), F.sum("weight")).first()
    c = tiles.sums(t, shares.select("period", F.lit(1).alias("rep_period"), "weight"))
    costs = tiles.measures(t, c, "dot").join(shares, "period").select("period", F.round(F.lit(a) + F.col("q") * b - 2 * F.col("d")[0], 12).alias("v"))
    seeds = _smallest(costs, k)
    scratch.drop(told)
    return seeds


def centre_seeds(t: Tiles, k: int, metric: str, scratch: Scratch, *, height: int = tiles.HEIGHT) -> list[int]:
    """The k periods of the smallest sum over i of d(i, j) / sum over l of d(i, l); of equals the first."""
    rows = scratch.store(tiles.pair_sums(t, metric, height=height))
    shares = rows.select("period", F.lit(1).alias("rep_period"), F.when(F.col("s") > 0, 1 / F.col("s")).otherwise(0.0).alias("weight"))
    costs = tiles.pair_sums(t, metric, shares, height=height).select("period", F.round("s", 12).alias("v"))
    seeds = _smallest(costs, k)
    scratch.drop(rows)
    return seeds


def k_means(t: Tiles, k: int, metric: str, scratch: Scratch, *, max_rounds: int = 100) -> DataFrame:
    """Centres (rep_period, block, x) of Lloyd's rounds from the centre-based seeds; a centre without periods stays where it is.

    A round sums the periods of each centre in every tile, and the tiles' sums; only centres go from round to round.
    """
    centres = scratch.store(periods_as_reps(t, k_means_seeds(t, k, scratch)))
    for _ in range(max_rounds):
        own = nearest(t, centres, metric).withColumn("weight", F.lit(1.0))
        moved = tiles.sums(t, own).select("rep_period", "block", F.transform("x", lambda v: v / F.col("n")).alias("new"))
        after = centres.join(moved, ["rep_period", "block"], "left").select("rep_period", "block", F.coalesce("new", "x").alias("x"), (F.coalesce("new", "x") != F.col("x")).alias("moved"))
        after = scratch.store(after)
        scratch.drop(centres)
        centres, still = after, after.where("moved").isEmpty()
        if still:
            break
    return centres.drop("moved")


def k_medoids(t: Tiles, k: int, metric: str, scratch: Scratch, *, max_rounds: int = 200, height: int = tiles.HEIGHT) -> list[int]:
    """The periods found by turns of assignment and of each cluster's cheapest member, from the centre-based seeds. What a member costs is summed over pairs of parts."""
    medoids = centre_seeds(t, k, metric, scratch, height=height)
    for _ in range(max_rounds):
        own = scratch.store(nearest(t, periods_as_reps(t, medoids), metric))
        costs = tiles.pair_sums(t, metric, own.withColumn("weight", F.lit(1.0)), height=height).join(own, "period")
        best = {r["rep_period"]: r["p"] for r in costs.groupBy("rep_period").agg(F.min_by("period", F.struct(F.round("s", 12), "period")).alias("p")).collect()}
        moved = [best.get(j + 1, m) for j, m in enumerate(medoids)]
        scratch.drop(own)
        if moved == medoids:
            break
        medoids = moved
    return medoids


def mean(t: Tiles) -> DataFrame:
    ones = t.periods.select("period", F.lit(1).alias("rep_period"), F.lit(1.0).alias("weight"))
    return tiles.sums(t, ones).select("rep_period", "block", F.transform("x", lambda v: v / t.n_periods).alias("x"))


def _farthest(state: DataFrame):
    """The row of the largest distance, of equals the first period; NaN doesn't count."""
    return state.where("NOT isnan(d)").agg(F.min_by(F.struct("period", "b", "q"), F.struct(-F.col("d"), "period")).alias("row")).first()["row"]


def greedy_hull(t: Tiles, n_points: int, metric: str, scratch: Scratch, *, null: bool = False, centre: DataFrame | None = None) -> list[int]:
    """The periods of the hull: the first is farthest from the centre (the mean of all), each next one farthest from the hull so far.

    null: the hull starts with zero, which is not returned. A period's distance is kept from an earlier round if the point
    added last is not nearer. Between rounds there is a table (period, d, products with the hull's points, square); the
    driver gets the next point's row. The nearest place of the hull is found for a batch of periods at once.
    """
    hull: list[int] = []
    middle = tiles.zero(t) if null else mean(t) if centre is None else centre
    begun = tiles.measures(t, middle, metric, "square").select("period", F.col("d")[0].alias("d"), F.array().cast("array<double>").alias("b"), F.col("d")[1].alias("q"))
    state = scratch.store(begun)
    gram = np.zeros((1, 1)) if null else np.zeros((0, 0))
    if not null:
        first = _farthest(state)
        hull, gram = [first["period"]], np.array([[first["q"]]])
    state_d, last = F.lit(float("inf")), tiles.zero(t) if null else periods_as_reps(t, hull)
    while len(hull) < n_points:
        told = tiles.measures(t, last, metric, "dot").select("period", F.col("d")[0].alias("to_last"), F.array(F.col("d")[1]).alias("product"))
        joined = state.withColumn("d", state_d).join(told, "period")
        joined = joined.where(~F.col("period").isin(hull)) if hull else joined
        inverse = np.linalg.pinv(gram, hermitian=True)

        def blends(it, gram=gram, inverse=inverse):
            for b in it:
                if b.num_rows:
                    products = np.concatenate([tiles.matrix(pa.chunked_array([b.column(c)])).reshape(b.num_rows, -1) for c in ("b", "product")], axis=1)
                    w = np.zeros_like(products)
                    to_last, d = b.column("to_last").to_numpy(), b.column("d").to_numpy()
                    nearer = ~(to_last >= d)
                    w[nearer] = descend_rows(onto_simplex_rows(products[nearer] @ inverse), gram, products[nearer], onto_simplex_rows)
                    yield pa.RecordBatch.from_arrays([b.column("period"), b.column("d"), tiles.lists(products), b.column("q"), pa.array(nearer), tiles.lists(w)], ["period", "d", "b", "q", "nearer", "w"])

        blended = scratch.store(joined.select("period", "d", "b", "q", "to_last", "product").mapInArrow(blends, "period long, d double, b array<double>, q double, nearer boolean, w array<double>"))
        points = periods_as_reps(t, hull)
        if null:
            points = points.withColumn("rep_period", F.col("rep_period") + 1).unionByName(tiles.zero(t))
        new = tiles.residuals(t, points, blended.where("nearer").select("period", "w"), metric).select("period", F.col("d")[0].alias("new"))
        after = scratch.store(blended.join(new, "period", "left").select("period", F.when(F.col("nearer"), F.col("new")).otherwise(F.col("d")).alias("d"), "b", "q"))
        scratch.drop(state, blended)
        state, state_d = after, F.col("d")
        best = _farthest(state)
        if best is None:
            raise ValueError("Point not found")
        hull.append(best["period"])
        gram = np.pad(gram, ((0, 1), (0, 1)))
        gram[-1, :] = gram[:, -1] = [*best["b"], best["q"]]
        last = periods_as_reps(t, hull[-1:])
    scratch.drop(state)
    return hull


def hull_periods(t: Tiles, n: int, method: str, metric: str, scratch: Scratch) -> list[int]:
    if method == "convex_hull_with_null":
        # no distance to zero is defined for the cosine
        return greedy_hull(t, n, metric, scratch, null=metrics.parse(metric) != "cosine")
    if method != "conical_hull":
        return greedy_hull(t, n, metric, scratch)
    middle = mean(t)
    norm = float(np.sqrt(middle.select(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v).alias("q")).agg(F.sum("q")).first()[0]))
    normal = scratch.store(middle.select("rep_period", "block", F.transform("x", lambda v: F.try_divide(v, F.lit(norm))).alias("x")))
    along = tiles.measures(t, normal, "dot").select("period", F.col("d")[0].alias("along"))
    cells = t.cells.join(along, "period").repartition("block", "part").select("block", "part", "period", F.transform("x", lambda v: v / F.when(F.col("along") != 0, F.col("along")).otherwise(F.lit(float("nan")))).alias("x"))
    scaled = Tiles(scratch.keep(cells), t.places, t.width, t.parts, t.n_periods, t.n_places)
    found = greedy_hull(scaled, n, "euclidean", scratch, centre=normal)
    scratch.drop(scaled.cells, normal)
    return found


def find_representative_periods(df: DataFrame, n_rp: int, *, drop_incomplete_last_period: bool = False, method: str = "k_means", distance: str = "euclidean", width: int = tiles.WIDTH, height: int = tiles.HEIGHT, known: Tiles | None = None) -> ClusteringResult:
    """Representatives of (period, timestep, keys, value), and the weights that give each period its nearest one.

    An incomplete last period is left out of the search, as the last representative of its own unless it is dropped.
    known: the tiles of the complete periods, where another search of the same periods has made them.
    """
    aux = auxiliary(df)
    incomplete = aux.last_period_duration != aux.period_duration
    own_last = incomplete and not drop_incomplete_last_period
    weight, last_weight = period_weights(aux.period_duration, aux.last_period_duration, aux.n_periods, drop_incomplete_last_period)
    spark, scratch = df.sparkSession, Scratch(df.sparkSession)
    try:
        whole = df.where(F.col("period") < aux.n_periods) if incomplete else df
        t = known or tiles.tile(whole, aux.key_columns, scratch=scratch, width=width, height=height)
        searched = n_rp - own_last
        if method == "k_means":
            reps = k_means(t, searched, distance, scratch)
        elif method == "k_medoids":
            reps = periods_as_reps(t, k_medoids(t, searched, distance, scratch, height=height))
        elif method in ("convex_hull", "convex_hull_with_null", "conical_hull"):
            reps = periods_as_reps(t, hull_periods(t, searched, method, distance, scratch))
        else:
            raise ValueError(f"unknown method {method!r}")
        reps = scratch.store(reps)
        weights = scratch.store(nearest(t, reps, distance).select("period", "rep_period", F.lit(weight).alias("weight")))
    except BaseException:
        scratch.close()
        raise
    profiles = tiles.to_long(reps, t)
    if own_last:
        profiles = append_period(profiles, df, aux.n_periods, n_rp)
        weights = weights.unionByName(spark.createDataFrame([(aux.n_periods, n_rp, last_weight)], WEIGHTS))
    return ClusteringResult(profiles, weights, t, reps, scratch)
