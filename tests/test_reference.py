import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.compare import assert_same
from tsreduce import queries as Q
from tsreduce.functions import metrics
from tsreduce.functions.projections import descend, onto_orthant, onto_simplex
from tsreduce.operators import clustering, reshape, weights
from tsreduce.operators.views import Catalog
from tsreduce.plans import experiment, lp
from tsreduce.plans.experiment import Experiment, run_experiment, run_grid
from tsreduce.plans.solver import Matrix, solve, solve_arrays
from tsreduce.sources import tables as T
from tsreduce.sources.scratch import Scratch


def got(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_oracle(spark, sf, name):
    assert_same(spark, sf, Q.queries()[name], Q.oracle_sql()[name])


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_combine_and_split(spark):
    f1 = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (2, 1, 3)], "period long, timestep long, value long")
    assert got(reshape.combine_periods(f1), "timestep") == [(1, 1), (2, 2), (3, 3)]
    f2 = spark.createDataFrame([(1, 5), (2, 6), (3, 7), (4, 8)], "timestep long, value long")
    assert got(reshape.split_into_periods(f2, 2), "period", "timestep") == [(1, 1, 5), (1, 2, 6), (2, 1, 7), (2, 2, 8)]
    assert got(reshape.split_into_periods(f1, 1), "period") == [(1, 1, 1), (2, 1, 2), (3, 1, 3)]
    assert got(reshape.split_into_periods(f1), "timestep") == [(1, 1, 1), (1, 2, 2), (1, 3, 3)]
    with pytest.raises(ValueError):
        reshape.combine_periods(f1.drop("timestep"))
    with pytest.raises(ValueError):
        reshape.key_columns(f1.select("value"))


def test_matrix_round_trip(spark):
    df = spark.createDataFrame([(1, 1, "a", 1.0), (1, 2, "a", 2.0), (2, 1, "a", 3.0), (2, 2, "a", 4.0)], "period long, timestep long, a string, value double")
    assert reshape.key_columns(df) == ["timestep", "a"]
    x, places = reshape.to_features(df)
    assert got(x, "period") == [(1, [1.0, 2.0]), (2, [3.0, 4.0])]
    assert got(places, "place") == [(0, 1, "a"), (1, 2, "a")]
    back = reshape.to_long(x.withColumnRenamed("period", "rep_period"), places)
    assert got(back, "rep_period", "timestep") == [(1, 1, "a", 1.0), (1, 2, "a", 2.0), (2, 1, "a", 3.0), (2, 2, "a", 4.0)]
    source = spark.createDataFrame([(2, 1, "b", 7.0), (2, 2, "b", 8.0)], df.schema)
    assert got(reshape.append_period(back, source, 2, 3), "rep_period", "timestep")[-2:] == [(3, 1, "b", 7.0), (3, 2, "b", 8.0)]
    # a cell that a period lacks drops the key everywhere
    holed = df.where("NOT (period = 2 AND timestep = 2)")
    assert got(reshape.to_features(holed)[0], "period") == [(1, [1.0]), (2, [3.0])]


def test_unpivot_drops_nulls(spark):
    wide = spark.createDataFrame([(1, 1.0, None), (2, None, 2.0)], "timestep long, a double, b double")
    assert got(reshape.unpivot_wide(wide), "timestep") == [(1, "a", 1.0), (2, "b", 2.0)]


def test_period_weights_and_methods():
    assert clustering.period_weights(24, 24, 10, True) == (1.0, None)
    assert clustering.period_weights(24, 12, 3, True) == (1.25, None)
    assert clustering.period_weights(24, 12, 3, False) == (1.0, 1.0)
    assert [clustering.method_for("hull", w) for w in ("conical", "conical_bounded", "convex", "dirac")] == ["conical_hull", "convex_hull_with_null", "convex_hull", "convex_hull"]
    assert clustering.method_for("k_means", "conical") == "k_means"
    with pytest.raises(ValueError):
        metrics.parse("other")
    assert [metrics.show(n) for n in ("manhattan", "cityblock", "cosine", "other")] == ["cityblock", "cityblock", "cosine", "other"]


def test_projections_known():
    assert onto_simplex(np.array([0.5, 0.5])).tolist() == [0.5, 0.5]
    assert onto_simplex(np.array([2.0, 0.0])).tolist() == [1.0, 0.0]
    assert onto_simplex(np.array([7.0])).tolist() == [1.0]
    assert onto_orthant(np.array([-1.0, 0, 2])).tolist() == [0, 0, 2]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.floats(-100, 100), min_size=2, max_size=12))
def test_simplex_properties(v):
    w = onto_simplex(np.array(v))
    assert (w >= 0).all() and abs(w.sum() - 1) < 1e-9
    assert np.allclose(onto_simplex(w), w)


def test_descent_stops_without_the_last_step():
    x = descend(np.array([1.0, 1.0]), lambda x: np.ones(2), onto_orthant, learning_rate=0.1)
    assert x.tolist() == [1.0, 1.0]  # every component would fall


@pytest.mark.parametrize("metric", ["euclidean", "cityblock", "cosine", "chebyshev"])
def test_metric_column(spark, metric):
    x, y = [1.0, 2.0, -3.0], [0.5, 0.0, 4.0]
    df = spark.createDataFrame([(x, y)], "x array<double>, y array<double>")
    want = metrics.to_rows(metric, np.array([x]), np.array(y))[0]
    assert df.select(metrics.column(metric, F.col("x"), F.col("y"))).first()[0] == pytest.approx(want)


@pytest.fixture(scope="module")
def profile(spark):
    rng = np.random.default_rng(3)
    rows = [(p, t, k, float(v)) for p in range(1, 13) for t in range(1, 5) for k, v in (("a", rng.random()), ("b", rng.random() * 2))]
    return spark.createDataFrame(rows, "period long, timestep long, id string, value double").cache()


@pytest.mark.parametrize("method", ["k_means", "k_medoids", "convex_hull", "convex_hull_with_null", "conical_hull"])
@pytest.mark.parametrize("distance", ["euclidean", "cosine"])
def test_representatives(profile, method, distance):
    found = clustering.find_representative_periods(profile, 3, method=method, distance=distance)
    assert found.weights.count() == 12 and found.profiles.count() == 3 * 8
    _, x = clustering.matrix(found.features)
    if method != "k_means":
        assert all((x == r).all(1).any() for r in found.rp_matrix)
        assert len({tuple(r) for r in found.rp_matrix}) == 3


def plain_representatives(x, k, method, metric):
    """The rows that are found, by plain loops over all of them."""
    apart = {"euclidean": lambda a, b: np.sqrt(((a - b) ** 2).sum()), "cosine": lambda a, b: 1 - a @ b / np.sqrt((a @ a) * (b @ b))}[metric]
    n = len(x)
    if method in ("k_means", "k_medoids"):
        d = np.array([[((a - b) ** 2).sum() if method == "k_means" else apart(a, b) for b in x] for a in x])
        seeds = sorted(range(n), key=lambda j: (sum(d[i, j] / d[i].sum() for i in range(n)), j))[:k]
        centres = [x[j].copy() for j in seeds]
        for _ in range(200):
            own = [min(range(k), key=lambda c: (apart(a, centres[c]), c)) for a in x]
            after = []
            for c in range(k):
                members = [i for i in range(n) if own[i] == c]
                if method == "k_means":
                    after.append(x[members].mean(0) if members else centres[c])
                else:
                    after.append(x[min(members, key=lambda j: (sum(d[i, j] for i in members), j))] if members else centres[c])
            if all(np.allclose(a, b) for a, b in zip(after, centres)):
                break
            centres = after
        return np.array(centres)
    mean = x.mean(0)
    points, known = x, [np.zeros(x.shape[1])] if method == "convex_hull_with_null" and metric != "cosine" else []
    if method == "conical_hull":
        mean = mean / np.sqrt(mean @ mean)
        points, metric, apart = np.array([a / (a @ mean) for a in x]), "euclidean", lambda a, b: np.sqrt(((a - b) ** 2).sum())
    chosen = []
    if not known:
        chosen.append(max(range(n), key=lambda i: (apart(points[i], mean), -i)))
    far = [np.inf] * n
    while len(chosen) < k:
        hull = np.array(known + [points[i] for i in chosen])
        for i in range(n):
            # a period's distance is measured anew only if the last point is nearer than it
            if i not in chosen and apart(hull[-1], points[i]) < far[i]:
                w = onto_simplex(np.linalg.pinv(hull.T) @ points[i])
                for _ in range(1000):
                    after = onto_simplex(w - 1e-3 * (hull @ (hull.T @ w - points[i])))
                    if (after - w).max() <= 1e-5 / 1000:
                        break
                    w = after
                far[i] = apart(hull.T @ w, points[i])
        chosen.append(max((i for i in range(n) if i not in chosen), key=lambda i: (far[i], -i)))
    return x[chosen]


@pytest.mark.parametrize("method", ["k_means", "k_medoids", "convex_hull", "convex_hull_with_null", "conical_hull"])
@pytest.mark.parametrize("distance", ["euclidean", "cosine"])
def test_representatives_against_plain_loops(profile, method, distance):
    found = clustering.find_representative_periods(profile, 4, method=method, distance=distance)
    _, x = clustering.matrix(found.features)
    assert np.allclose(found.rp_matrix, plain_representatives(x, 4, method, distance))


@pytest.mark.parametrize("kind", ["convex", "conical", "conical_bounded"])
def test_fitted_weights_against_plain_loops(profile, kind):
    found = clustering.find_representative_periods(profile, 3, method=clustering.method_for("hull", kind))
    periods, x = clustering.matrix(found.features)
    reps, project = found.rp_matrix, onto_orthant if kind == "conical" else onto_simplex
    points = np.vstack([np.zeros(reps.shape[1]), reps]) if kind == "conical_bounded" else reps
    given_ = {p: np.zeros(3) for p in periods}
    for r in found.weights.collect():
        given_[r["period"]][r["rep_period"] - 1] = r["weight"]
    starts = []
    for p, t in zip(periods, x):
        g = np.concatenate([[0.0], given_[p]]) if kind == "conical_bounded" else given_[p]
        starts.append((project(g), project(np.linalg.pinv(points.T) @ t)))
    totals = [sum(((points.T @ s[k] - t) ** 2).sum() for s, t in zip(starts, x)) for k in (0, 1)]
    want = {}
    for p, t, s in zip(periods, x, starts):
        start = s[0] if totals[0] <= totals[1] else s[1]
        before = np.linalg.norm(points.T @ project(start) - t)
        if before <= 1e-2:
            w = given_[p]
        else:
            w = project(start)
            for _ in range(1000):
                after = project(w - 1e-3 * (points @ (points.T @ w - t)))
                if (after - w).max() <= 1e-4 / 1000:
                    break
                w = after
            w = start if np.linalg.norm(points.T @ w - t) > before else w
            w = np.where(w < 1e-2, 0, w)
            w = w / w.sum() if kind == "convex" or kind == "conical_bounded" and w.sum() > 1 else w
            w = w[1:] if kind == "conical_bounded" else w
        want |= {(p, k + 1): v for k, v in enumerate(w) if v}
    got_ = {(r["period"], r["rep_period"]): r["weight"] for r in weights.fit_weights(found, kind).collect()}
    assert got_.keys() == want.keys() and all(got_[k] == pytest.approx(v, abs=1e-9) for k, v in want.items())


def test_incomplete_last_period(profile):
    cut = profile.where("period < 12 OR timestep <= 2")
    kept = clustering.find_representative_periods(cut, 3)
    assert kept.profiles.where("rep_period = 3").count() == 4
    assert got(kept.weights.where("period = 12"), "period") == [(12, 3, 1.0)]
    dropped = clustering.find_representative_periods(cut, 3, drop_incomplete_last_period=True)
    assert dropped.weights.count() == 11
    with pytest.raises(ValueError, match="Point not found"):
        clustering.find_representative_periods(profile, 13, method="convex_hull")


@pytest.mark.parametrize("kind", ["convex", "conical", "conical_bounded", "dirac"])
def test_fitted_weights(profile, kind):
    found = clustering.find_representative_periods(profile, 3, method=clustering.method_for("hull", kind))
    before = weights.projection_error(found.features, found.weights, found.representatives)
    fitted = weights.fit_weights(found, kind)
    assert weights.projection_error(found.features, fitted, found.representatives) <= before + 0.05
    sums = [r[0] for r in fitted.groupBy("period").agg(F.sum("weight")).select("sum(weight)").collect()]
    if kind in ("convex", "dirac"):
        assert np.allclose(sums, 1)
    if kind == "conical_bounded":
        assert max(sums) <= 1 + 1e-9
    with pytest.raises(ValueError):
        weights.fit_weights(found, "other")


def test_solver_dispatch():
    # two plants of costs 1 and 3 and at most 4 each meet a demand of 6
    m = Matrix(np.array([0, 0]), np.array([0, 1]), np.array([1.0, 1.0]), (1, 2))
    x, gap, status, _ = solve_arrays(m, np.array([True]), np.array([6.0]), np.array([1.0, 3.0]), np.zeros(2), np.full(2, 4.0), tol=1e-6)
    assert status == "OPTIMAL" and np.allclose(x, [4, 2], atol=1e-3)
    # more than both can give; a row that isn't part of it gets no multiplier
    m = Matrix(np.array([0, 0, 1]), np.array([0, 1, 0]), np.array([1.0, 1.0, 1.0]), (2, 2))
    _, _, status, y = solve_arrays(m, np.array([True, False]), np.array([9.0, 4.0]), np.array([1.0, 3.0]), np.zeros(2), np.full(2, 4.0))
    assert status == "INFEASIBLE" and abs(y[0]) > 0 and y[1] == 0
    # two rows that contradict each other without bounds
    m = Matrix(np.array([0, 1]), np.array([0, 0]), np.array([1.0, -1.0]), (2, 1))
    assert solve_arrays(m, np.array([False, False]), np.array([1.0, -2.0]), np.zeros(1), np.full(1, -np.inf), np.full(1, np.inf))[2] == "INFEASIBLE"
    # what costs less the more of it there is
    m = Matrix(np.array([0, 0]), np.array([0, 1]), np.array([1.0, -1.0]), (1, 2))
    assert solve_arrays(m, np.array([False]), np.array([1.0]), np.array([-1.0, 0.0]), np.zeros(2), np.full(2, np.inf))[2] == "UNBOUNDED"


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10**6))
def test_solver_finds_no_false_proof(seed):
    rng = np.random.default_rng(seed)
    a = rng.integers(-3, 4, (4, 6)).astype(float)
    row, col = np.nonzero(a)
    inside = rng.random(6) * 4  # meets all rows
    equal = np.array([True, False, False, False])
    rhs = a @ inside + np.where(equal, 0, rng.random(4))
    _, _, status, _ = solve_arrays(Matrix(row, col, a[row, col], (4, 6)), equal, rhs, rng.random(6), np.zeros(6), np.full(6, 5.0))
    assert status == "OPTIMAL"


@pytest.fixture(scope="module")
def small(spark):
    def df(name, rows):
        return spark.createDataFrame(rows, T.SCHEMAS[name].replace("can_charge string", "can_charge boolean"))

    tables = {n: df(n, []) for n in T.SCHEMAS}
    tables |= {
        "assets": df("assets", [("cheap", "N", "Coal", 4.0, 1.0), ("dear", "N", "Gas", 10.0, 0.0), ("lost", "N", "OCGT", 5.0, 1.0)]),
        "technologies": df("technologies", [("Coal", "generation", "el"), ("Gas", "generation", "el")]),
        "technologies_generation": df("technologies_generation", [("Coal", 1.0, 1.0), ("Gas", 3.0, 1.0), ("OCGT", 9.0, 1.0)]),
        "investments": df("investments", [("dear", 0.5)]),
        "demand": df("demand", [("D", "N", "el", 6.0)]),
        "scalars": df("scalars", [("operations_weight", 1.0), ("timestep_duration", 1.0)]),
        "assets_profiles": df("assets_profiles", [("D", "demand", "d")]),
        "profiles_raw": spark.createDataFrame([(t, 1.0 if t % 2 else 0.5) for t in range(1, 9)], "timestep long, d double"),
    }
    return tables


def test_inner_joins_drop_unknown_technologies(small):
    c = Catalog(small)
    assert {r["id"] for r in c.generation_assets.collect()} == {"cheap", "dear"}
    assert {r["id"] for r in c.power_out_expression_view.collect()} == {"cheap", "dear"}
    assert c.index_set("assets") == ["cheap", "dear", "lost"]


@pytest.mark.parametrize("kind", ["none", "investment_regret"])
def test_experiment(spark, small, kind, tmp_path):
    e = Experiment(2, 2, "k_means", "euclidean", "dirac", 100, 1e-3, kind)
    result, solution = run_experiment(small, e, tol=1e-5)
    # each period needs 2 from the dear plant once: 0.2 units at 5 each, and 4 periods of 4 + 3*2 + 3
    assert result.termination_status == "OPTIMAL"
    assert result.objective_value == pytest.approx(0.2 * 5 + 4 * (4 + 6 + 3), rel=1e-3)
    if kind != "none":
        assert result.evaluated_objective_value == pytest.approx(result.objective_value, rel=1e-3)
    for seed in (1, 2):
        T.save_result(result, spark, str(tmp_path / "results.csv"), 0.1)
        T.save_variables(solution, str(tmp_path), result.name, seed)
    lines = (tmp_path / "results.csv").read_text().splitlines()
    assert len(lines) == 3 and lines[0].startswith("name,seed,n_rep_periods") and lines[0].endswith("time_to_read") and lines[1] == lines[2]
    folder = tmp_path / result.name
    assert [x.split(",")[:2] for x in (folder / "invested_units.csv").read_text().splitlines()] == [["seed", "id"], ["1", "dear"], ["2", "dear"]]
    assert sorted(p.name for p in folder.glob("*.csv")) == ["invested_units.csv"]  # there is no storage


def test_no_optimum_is_not_evaluated(spark, small, tmp_path):
    # no plant may be built, and those there are can't meet the demand
    short = small | {"investments": small["investments"].limit(0)}
    result, solution = run_experiment(short, Experiment(2, 2, "k_means", "euclidean", "dirac", 100, 1e-3, "investment_regret"))
    assert result.termination_status == "INFEASIBLE" and solution.objective is None and solution.variables is None
    assert any(r.startswith("balance") for r in solution.conflict) and any(r.startswith("capacity|cheap") for r in solution.conflict)
    assert result.evaluation_termination_status == "NONE" and result.evaluated_objective_value is None
    T.save_variables(solution, str(tmp_path), result.name, 1)
    assert not (tmp_path / result.name).exists()


@pytest.fixture(scope="module")
def whole(spark, small):
    """With lines, conversion, ramps, and storage of both kinds."""
    df = lambda name, rows: spark.createDataFrame(rows, T.SCHEMAS[name].replace("can_charge string", "can_charge boolean"))
    return small | {
        "assets": df("assets", [("coal", "N", "Coal", 5.0, 2.0), ("gas", "S", "Gas", 10.0, 0.0), ("battery", "N", "Battery", 2.0, 1.0), ("lake", "S", "Hydro", 3.0, 1.0), ("river", "S", "River", 2.0, 1.0), ("cell", "N", "Cell", 4.0, 1.0)]),
        "technologies": df("technologies", [("Coal", "generation", "el"), ("Gas", "generation", "el"), ("Battery", "storage", "el"), ("Hydro", "storage", "el"), ("River", "storage", "el"), ("Cell", "conversion", "h2")]),
        "technologies_generation": df("technologies_generation", [("Coal", 1.0, 0.5), ("Gas", 3.0, 1.0)]),
        "technologies_storage": df("technologies_storage", [("Battery", False, 0.9, 0.9), ("Hydro", True, 0.8, 0.9), ("River", True, 1.0, 0.9)]),
        "technologies_conversion": df("technologies_conversion", [("Cell", "el", 1.0, 0.5)]),
        "assets_storage": df("assets_storage", [("battery", 4.0, 1.0), ("lake", 20.0, 1.0), ("river", 10.0, 1.0)]),
        "assets_storage_seasonal": df("assets_storage_seasonal", [("lake", 6.0, 1.0, 0.1, 50.0, True), ("river", 3.0, 0.5, 0.0, 50.0, False)]),
        "investments": df("investments", [("gas", 0.5)]),
        "demand": df("demand", [("D", "N", "el", 6.0), ("E", "S", "el", 3.0), ("H", "N", "h2", 0.5)]),
        "transmission_lines": df("transmission_lines", [("line", "N", "S", "el", 2.0, 2.0)]),
        "assets_profiles": df("assets_profiles", [("D", "demand", "d"), ("lake", "inflows", "d")]),
    }


@pytest.mark.parametrize("kind", ["storage_regret"])
def test_experiment_with_storage(spark, whole, kind, tmp_path):
    """Each period stands for itself, so the reduced programme can do what the whole one can, and its solution holds there."""
    result, solution = run_experiment(whole, Experiment(4, 2, "k_medoids", "euclidean", "dirac", 100, 1e-3, kind))
    assert result.termination_status == result.evaluation_termination_status == "OPTIMAL"
    assert result.evaluated_objective_value == pytest.approx(result.objective_value, rel=0.02)
    levels = {(r["name"], r["id"], r["r"], r["t"]): r["value"] for r in solution.variables.collect()}
    near = lambda x, y: abs(x - y) < 0.02
    for i in ("lake", "river"):
        first = {"lake": 6.0, "river": 3.0}[i]
        assert near(levels["state_of_charge_inter_0", i, 0, 0], first) and near(levels["state_of_charge_inter", i, 0, 4], first)
    for r in range(1, 5):
        assert near(levels["state_of_charge_intra", "battery", r, 2], levels["state_of_charge_intra_0", "battery", r, 0])
        for t in (1, 2):
            assert near(levels["power_in", "cell", r, t], 2 * levels["power_out", "cell", r, t]) and near(levels["power_out", "cell", r, t], 0.5)
            assert abs(levels["flow", "line", r, t]) <= 2.01
        assert abs(levels["power_out", "coal", r, 2] - levels["power_out", "coal", r, 1]) <= 5.01
    T.save_variables(solution, str(tmp_path), "x", 3)
    assert {p.name: p.read_text().splitlines()[0] for p in (tmp_path / "x").glob("*.csv")} == {
        "invested_units.csv": "seed,id,value", "inter_period_storage_values.csv": "seed,id,period,value", "intra_period_storage_values.csv": "seed,id,rep_period,timestep,value",
    }


def test_grid_of_experiments(spark, small, tmp_path, monkeypatch):
    for name, table in small.items():
        if name in T.SCHEMAS or name == "profiles_raw":
            rows = [table.columns, *table.collect()]
            file = name.removesuffix("_raw").replace("_", "-")
            (tmp_path / "toy").mkdir(exist_ok=True)
            (tmp_path / "toy" / f"{file}.csv").write_text("\n".join(",".join("" if v is None else str(v) for v in r) for r in rows) + "\n")
    (tmp_path / "toy.csv").write_text(",".join(c.split()[0] for c in T.GRID.split(", ")) + "\n2,2,k_means,euclidean,dirac,10,1e-4,none\n2,2,k_means,euclidean,convex,10,1e-4,none\n")
    closed = []
    monkeypatch.setattr(experiment.Shared, "close", lambda self, close=experiment.Shared.close: (closed.append(self.searches), close(self)))
    before = held(spark)
    for seeds, ran in (((7,), 2), ((7, 8), 2), ((7, 8), 0)):
        assert run_grid(spark, str(tmp_path), ["toy"], str(tmp_path / "out"), seeds=seeds) == ran
        assert held(spark) == before  # all that was kept is given back
        # a repeated run adds nothing
        lines = (tmp_path / "out" / "toy.csv").read_text().splitlines()
        assert sorted(x.split(",")[1] for x in lines[1:]) == [str(s) for s in seeds for _ in range(2)]
        units = T.read_runs(spark, str(tmp_path / "out" / "toy" / "invested_units"), T.VARIABLE_SCHEMAS["invested_units"])
        assert got(units.select("name", "seed", "id"), "name", "seed") == [(f"2_2_k_means_euclidean_{k}_10_0.0001", s, "dear") for k in ("convex", "dirac") for s in seeds]
    assert closed == [1, 1]  # two experiments share one search


def held(spark):
    return spark.sparkContext._jsc.sc().getPersistentRDDs().size()


def test_runs_are_added_once_and_whole(spark, tmp_path):
    folder = str(tmp_path / "runs")
    rows = spark.createDataFrame([("a", 1.5), (None, None)], "id string, value double")
    schema = "id string, value double, name string, seed long"
    assert T.append_run(rows, folder, name="x=1/ü %", seed=3) and not T.append_run(rows, folder, name="x=1/ü %", seed=3)
    assert sorted(got(T.read_runs(spark, folder, schema), "id"), key=str) == sorted([("a", 1.5, "x=1/ü %", 3), (None, None, "x=1/ü %", 3)], key=str)

    bad = spark.range(4).selectExpr("CAST(id AS STRING) AS id", "CAST(raise_error('killed') AS DOUBLE) AS value")
    with pytest.raises(Exception, match="killed"):
        T.append_run(bad, folder, name="y", seed=3)
    assert T.read_runs(spark, folder, schema).count() == 2 and not [f for f in (tmp_path / "runs").iterdir() if f.name.startswith("_")]
    assert T.append_run(rows, folder, name="y", seed=3) and T.read_runs(spark, folder, schema).count() == 4


def test_many_files_by_header(spark, tmp_path):
    for k in range(60):
        (tmp_path / f"i{k}.csv").write_text(f"id,cost\nA{k},{k}\n" if k % 2 else f"cost,id\n{k},A{k}\n")
    df = T.read_data(spark, "investments", [str(tmp_path / f"i{k}.csv") for k in range(60)])
    assert sorted(got(df, "cost")) == sorted((f"A{k}", float(k)) for k in range(60))
    # one scan for each header
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan csv") == 2


def test_numbered_programme(spark, whole, tmp_path):
    c = Catalog(whole, 2)
    c = c.with_(rp_profiles=c.profiles.where("period <= 2").withColumnRenamed("period", "rep_period"))
    w = spark.createDataFrame([(1, 1, 1.0), (2, 1, 0.25), (2, 2, 0.75), (3, 2, 1.0), (4, 1, 0.5), (4, 2, 0.5)], clustering.WEIGHTS)
    built = lp.build(c, w)
    scratch = Scratch(spark)
    p = lp.Programme(scratch.store(built.variables), scratch.store(built.rows), scratch.store(built.terms))
    n = lp.numbered_programme(p)
    n.write(str(tmp_path / "coo"))
    columns, rows, entries = (spark.read.parquet(str(tmp_path / "coo" / k)) for k in ("columns", "rows", "entries"))
    for df, i, of in ((rows, "index", p.rows), (columns, "col", p.variables)):
        assert [r[0] for r in df.select(i).orderBy(i).collect()] == list(range(of.count()))
    assert rows.where("row LIKE '%.%'").isEmpty()  # no row is named by a double
    back = entries.join(rows, "index").join(columns, "col").select("row", *lp.VAR, "a")
    assert got(back, "row", *lp.VAR) == got(p.terms.select("row", *lp.VAR, "a"), "row", *lp.VAR)
    # blended weights: what a period's level changes by is shared among its representatives
    inter = {(r["name"], r["r"]): r["a"] for r in p.terms.where("row = 'inter|lake|2'").collect() if r["name"].startswith("state_of_charge_intra")}
    assert inter == {("state_of_charge_intra", 1): -0.25, ("state_of_charge_intra", 2): -0.75, ("state_of_charge_intra_0", 1): 0.25, ("state_of_charge_intra_0", 2): 0.75}
    built.release()
    scratch.close()


def test_duplicate_demand_gives_two_balances(spark, small):
    twice = small | {"demand": small["demand"].union(small["demand"])}
    c = Catalog(twice, 2)
    c = c.with_(rp_profiles=c.profiles.where("period = 1").withColumnRenamed("period", "rep_period"))
    p = lp.build(c, spark.createDataFrame([(1, 1, 1.0)], clustering.WEIGHTS))
    assert p.rows.where("row LIKE 'balance%'").count() == c.balance_constraint_view.count()


def test_read_folder(spark, tmp_path):
    (tmp_path / "assets-storage-seasonal.csv").write_text("id,initial_storage_level,peak_inflow,spillage_cost,borrow_cost,can_charge\r\nA,1,2,0,1,FALSE\r\nB,0,1,680,0,1,FALSE\r\n")
    (tmp_path / "technologies-storage.csv").write_text("id,is_seasonal,efficiency_in,efficiency_out")
    (tmp_path / "profiles.csv").write_text("timestep,x-1,y\n1,0.5,1.00E-04\n2,,2\n")
    t = T.read_data_from_dir(spark, str(tmp_path))
    assert got(t["assets_storage_seasonal"].select("id", "can_charge"), "id") == [("A", False), ("B", True)]
    assert t["technologies_storage"].where("is_seasonal").count() == 0
    assert t["profiles_raw"].dtypes[0] == ("timestep", "bigint")
    assert got(reshape.unpivot_wide(t["profiles_raw"]), "timestep", "id") == [(1, "x-1", 0.5), (1, "y", 1e-4), (2, "y", 2.0)]
    assert t["demand"].isEmpty()
    # columns go by name, and files of one table may have different ones
    (tmp_path / "investments.csv").write_text("cost,id\n5.0,A\n")
    (tmp_path / "more.csv").write_text("id\nB\n")
    both = T.read_data(spark, "investments", [str(tmp_path / "investments.csv"), str(tmp_path / "more.csv")])
    assert got(both, "id") == [("A", 5.0), ("B", None)]
    wide = [tmp_path / "p1.csv", tmp_path / "p2.csv"]
    wide[0].write_text("timestep,a\n1,0.5\n")
    wide[1].write_text("b,timestep\n0.25,2\n")
    assert got(T.read_profile_data(spark, list(map(str, wide))).select("timestep", "a", "b"), "timestep") == [(1, 0.5, None), (2, None, 0.25)]
    (tmp_path / "wrong.csv").write_text("id,price\nA,1\n")
    with pytest.raises(ValueError, match="price"):
        T.read_data(spark, "investments", str(tmp_path / "wrong.csv"))


def test_grid(spark, tmp_path):
    (tmp_path / "g.csv").write_text(",".join(c.split()[0] for c in T.GRID.split(", ")) + "\n5,24,hull,euclidean,convex,1000,1e-4,none\n")
    row = T.read_run_data(spark, str(tmp_path / "g.csv")).first()
    assert Experiment(**row.asDict()).name == "5_24_hull_euclidean_convex_1000_0.0001"
    (tmp_path / "bad.csv").write_text("n_rep_periods\n5\n")
    with pytest.raises(ValueError, match="columns missing"):
        T.read_run_data(spark, str(tmp_path / "bad.csv"))


def test_stream(spark, sf, tmp_path):
    from tsreduce.streaming.periods import hourly_profiles

    events = spark.read.parquet(f"{sf}/events.parquet").select("ts", "event_type", "value")
    events.write.parquet(str(tmp_path / "in"))
    stream = hourly_profiles(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "2024-01-01")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("hours").start()
    q.processAllAvailable()
    q.stop()
    batch = hourly_profiles(events, "2024-01-01")
    key = lambda df: sorted((r.period, r.timestep, r.id, round(r.value, 6)) for r in df.collect())
    assert key(spark.table("hours")) == key(batch)
