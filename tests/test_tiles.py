"""Searches and weights over many blocks and parts give what one tile gives, and what plain loops give."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import assert_same
from tests.test_reference import plain_representatives
from tsreduce import queries as Q
from tsreduce.functions import metrics, projections
from tsreduce.operators import clustering, tiles, views, weights
from tsreduce.operators.numbering import numbered
from tsreduce.plans import lp
from tsreduce.sources.scratch import Scratch

N, HOURS = 17, 5


@pytest.fixture(scope="module")
def profile(spark):
    rng = np.random.default_rng(8)
    rows = [(p, t, k, float(v)) for p in range(1, N + 1) for t in range(1, HOURS + 1) for k, v in (("a", rng.random()), ("b", rng.random() * 2))]
    rows += [(p, 1, "c", 1.0) for p in range(2, N + 1)]  # a key that a period lacks
    return spark.createDataFrame(rows, "period long, timestep long, id string, value double").cache()


@pytest.fixture(scope="module")
def many(profile, spark):
    """Tiles of 3 places by 4 periods or so."""
    with Scratch(spark) as scratch:
        t = tiles.tile(profile, scratch=scratch, width=3, height=4)
        yield t, clustering.matrix(t)[1], scratch


def test_layout(many, profile):
    t, x, _ = many
    assert (t.n_periods, t.n_places, t.blocks, t.parts) == (N, 2 * HOURS, 4, 5) and x.shape == (N, 2 * HOURS)
    back = tiles.to_long(t.cells.withColumnRenamed("period", "rep_period"), t)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(back.select("rep_period", "timestep", "id", "value")) == key(profile.where("id <> 'c'"))


@pytest.mark.parametrize("metric", ["euclidean", "cityblock", "cosine", "chebyshev"])
def test_measures(many, spark, metric):
    t, x, _ = many
    want = metrics.pairwise(metric, x, x)
    found = tiles.pairwise(t, metric, height=4).collect()
    assert len(found) == N * N
    assert all(r["d"] == pytest.approx(want[r["p"] - 1, r["q"] - 1], abs=1e-12) for r in found)
    reps = clustering.periods_as_reps(t, [9, 2, 5])
    for r in tiles.measures(t, reps, metric, "dot", "square").collect():
        i = r["period"] - 1
        assert np.allclose(r["d"], [*want[i, [8, 1, 4]], *(x[[8, 1, 4]] @ x[i]), *[x[i] @ x[i]] * 3])
    sums = {r["period"]: r["s"] for r in tiles.pair_sums(t, metric, height=4).collect()}
    assert np.allclose([sums[p] for p in range(1, N + 1)], want.sum(1))
    w = np.random.default_rng(1).random((N, 2, 3))
    given = spark.createDataFrame([(i + 1, w[i].ravel().tolist()) for i in range(N)], "period long, w array<double>")
    for r in tiles.residuals(t, reps, given, metric).collect():
        i = r["period"] - 1
        assert np.allclose(r["d"], metrics.to_rows(metric, w[i] @ x[[8, 1, 4]], x[i]))


def test_sums(many, spark, monkeypatch):
    t, x, _ = many
    monkeypatch.setattr(tiles, "FOLD", 2)  # several rounds of partial sums
    w = spark.createDataFrame([(p, 1 + p % 3, 0.5 * p) for p in range(1, N + 1) if p != 4], "period long, rep_period long, weight double")
    got = clustering.gathered(tiles.sums(t, w))
    want = [sum(0.5 * p * x[p - 1] for p in range(1, N + 1) if p != 4 and p % 3 == k) for k in range(3)]
    assert np.allclose(got, want)
    n = {r["rep_period"]: r["n"] for r in tiles.sums(t, w).collect()}
    assert n == {1 + k: sum(0.5 * p for p in range(1, N + 1) if p != 4 and p % 3 == k) for k in range(3)}


@pytest.mark.parametrize(("method", "distance"), [("k_means", "cityblock"), ("k_medoids", "chebyshev"), ("convex_hull", "cityblock"), ("convex_hull_with_null", "euclidean"), ("conical_hull", "cosine")])
def test_searches(many, method, distance):
    t, x, scratch = many
    if method == "k_means":
        got = clustering.gathered(clustering.k_means(t, 4, distance, scratch))
    elif method == "k_medoids":
        got = x[np.array(clustering.k_medoids(t, 4, distance, scratch, height=4)) - 1]
    else:
        got = x[np.array(clustering.hull_periods(t, 4, method, distance, scratch)) - 1]
    assert np.allclose(got, plain_any(x, 4, method, distance))


def plain_any(x, k, method, metric):
    """plain_representatives knows two metrics; others stand in for its Euclidean one."""
    if metric in ("euclidean", "cosine"):
        return plain_representatives(x, k, method, metric)
    apart = {"cityblock": lambda a, b: np.abs(a - b).sum(), "chebyshev": lambda a, b: np.abs(a - b).max()}[metric]
    n = len(x)
    if method == "convex_hull":
        chosen, far = [max(range(n), key=lambda i: (apart(x[i], x.mean(0)), -i))], [np.inf] * n
        while len(chosen) < k:
            hull = x[chosen]
            for i in range(n):
                if i not in chosen and apart(hull[-1], x[i]) < far[i]:
                    w = projections.descend(np.linalg.pinv(hull.T) @ x[i], lambda w, i=i, hull=hull: hull @ (hull.T @ w - x[i]), projections.onto_simplex)
                    far[i] = apart(hull.T @ w, x[i])
            chosen.append(max((i for i in range(n) if i not in chosen), key=lambda i: (far[i], -i)))
        return x[chosen]
    cost = np.array([[((a - b) ** 2).sum() if method == "k_means" else apart(a, b) for b in x] for a in x])
    centres = [x[j] for j in sorted(range(n), key=lambda j: (sum(cost[i, j] / cost[i].sum() for i in range(n)), j))[:k]]
    for _ in range(100):
        own = [min(range(k), key=lambda c: (apart(a, centres[c]), c)) for a in x]
        members = [[i for i in range(n) if own[i] == c] for c in range(k)]
        if method == "k_means":
            centres = [x[m].mean(0) if m else c for m, c in zip(members, centres)]
        else:
            centres = [x[min(m, key=lambda j: (sum(apart(x[i], x[j]) for i in m), j))] if m else c for m, c in zip(members, centres)]
    return np.array(centres)


@pytest.mark.parametrize("kind", ["convex", "conical", "conical_bounded"])
def test_weights(many, profile, kind):
    """Over many tiles and over one, the same weights of the same representatives."""
    t, _, scratch = many
    found = clustering.find_representative_periods(profile, 3, method=clustering.method_for("hull", kind), known=t)
    alone = clustering.find_representative_periods(profile, 3, method=clustering.method_for("hull", kind))
    key = lambda df: {(r["period"], r["rep_period"]): r["weight"] for r in df.collect()}
    a, b = key(weights.fit_weights(found, kind)), key(weights.fit_weights(alone, kind))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)
    assert weights.projection_error(t, found.weights, found.representatives) == pytest.approx(weights.projection_error(alone.features, alone.weights, alone.representatives))
    found.release()
    alone.release()


def test_one_long_period(spark):
    """A single period of a year's hours lies in many tiles, and is its own representative."""
    df = spark.range(1, 8761).selectExpr("1L AS period", "id AS timestep", "'x' AS id", "CAST(id % 24 AS DOUBLE) AS value")
    found = clustering.find_representative_periods(df, 1, width=500)
    assert found.features.cells.count() == 18
    assert sorted(map(tuple, found.profiles.select("timestep", "value").collect())) == [(t, float(t % 24)) for t in range(1, 8761)]
    assert [tuple(r) for r in found.weights.collect()] == [(1, 1, 1.0)]
    found.release()


def test_equal_periods_and_release(spark):
    df = spark.createDataFrame([(p, t, "a", 2.0) for p in range(1, 6) for t in (1, 2)], "period long, timestep long, id string, value double")
    held = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    for method in ("k_means", "k_medoids"):
        found = clustering.find_representative_periods(df, 2, method=method)
        assert {(r["period"], r["rep_period"]) for r in found.weights.collect()} == {(p, 1) for p in range(1, 6)}
        found.release()
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == held


def test_numbers(spark):
    df = spark.range(1000).selectExpr("concat('k', id) AS k", "id % 7 AS j")
    first = {r["k"]: r["index"] for r in numbered(df, ["k"], ranges=16).collect()}
    again = {r["k"]: r["index"] for r in numbered(df.repartition(13), ["k"], ranges=16).collect()}
    assert sorted(first.values()) == list(range(1000)) and first == again
    assert numbered(df.limit(0), ["k"]).count() == 0


def test_simplex_of_long_vectors(spark):
    """A vector far larger than the others, ties, single values and nulls."""
    rng = np.random.default_rng(4)
    vectors = {1: rng.normal(size=20_000), 2: np.array([5.0]), 3: np.array([0.25] * 4), 4: np.array([-3.0, -3.0, 9.0]), 5: np.array([1e9, 1e9 - 0.5])}
    rows = [(k, i, float(v)) for k, x in vectors.items() for i, v in enumerate(x)]
    df = spark.createDataFrame([*rows, (2, 9, None), (6, 0, None)], "g long, i long, v double")
    out = projections.project_rows(df, "g", "i", "v")
    got = {(r["g"], r["i"]): r["weight"] for r in out.select("g", "i", "weight").where(F.col("weight") > 0).collect()}
    for k, x in vectors.items():
        want = projections.onto_simplex(x)
        assert all(got.get((k, i), 0.0) == pytest.approx(w, abs=1e-6) for i, w in enumerate(want))
    assert out.count() == len(rows)


@pytest.mark.parametrize("long", [1000, 1 << 20])
def test_simplex_moves_values_once(spark, long):
    """By a window where vectors are short, by rounds where one is long; the plan of the former has one exchange."""
    rng = np.random.default_rng(5)
    vectors = {1: rng.normal(size=5000), 2: rng.normal(size=7), 3: np.array([1e17]), 4: np.array([0.1] * 6)}
    rows = [(k, i, float(v)) for k, x in vectors.items() for i, v in enumerate(x)]
    df = spark.createDataFrame([*rows, (None, 0, 1.0), (2, 8, None)], "g long, i long, v double")
    out = projections.project_rows(df, "g", "i", "v", long=long)
    got = {(r["g"], r["i"]): r["weight"] for r in out.collect()}
    assert got.keys() == {r[:2] for r in rows}
    for k, x in vectors.items():
        want = projections.onto_simplex(x - x.max())
        assert all(got[k, i] == pytest.approx(w, abs=1e-9) for i, w in enumerate(want))
    if long > 5000:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        plan = out.select("*")._jdf.queryExecution().executedPlan().toString()
        spark.conf.unset("spark.sql.adaptive.enabled")
        assert plan.count("Exchange") == 1


def test_numbers_compute_a_frame_once(spark):
    """With a scratch, counts and numbers are read from what was placed."""
    met = spark.sparkContext.accumulator(0)

    def rows(it):
        for b in it:
            met.add(b.num_rows)
            yield b

    df = spark.range(100).mapInArrow(rows, "id long")
    with Scratch(spark) as scratch:
        out = numbered(df, ["id"], scratch=scratch)
        assert sorted(r["index"] for r in out.collect()) == list(range(100)) and out.count() == 100
    assert met.value == 100


def test_assets_in_parts(spark, sf, monkeypatch):
    """Of more assets more tasks make and sum the terms, which stay the same."""
    monkeypatch.setattr(views, "PART", 3)
    n = Q.tables(spark, sf)["assets"].count()
    w = Q.nearest_rep(spark, sf).withColumn("weight", F.lit(1.0))
    p = lp.build(Q.catalog(spark, sf), w)
    assert p.terms.rdd.getNumPartitions() == 8 * -(-n // 3) > 8
    p.release()
    assert_same(spark, sf, Q.lp_blended_terms, Q.oracle_sql()["lp_blended_terms"])
