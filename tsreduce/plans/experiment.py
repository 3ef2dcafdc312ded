"""Experiments: search, weights, programme, solution, and its evaluation at full length."""

from __future__ import annotations

import time
from collections.abc import Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, replace
from threading import Lock

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsreduce.operators.clustering import WEIGHTS, ClusteringResult, auxiliary, find_representative_periods, method_for
from tsreduce.operators.tiles import Tiles, tile
from tsreduce.operators.views import Catalog
from tsreduce.operators.weights import fit_weights, projection_error
from tsreduce.plans.lp import Programme, build, fix
from tsreduce.plans.solver import Solution, solve
from tsreduce.sources.scratch import Scratch
from tsreduce.sources.tables import ExperimentResult, append_run, append_variables, has_run, read_data_from_dir, read_run_data, save_result


@dataclass(frozen=True)
class Experiment:
    n_rep_periods: int
    period_length: int
    clustering_type: str
    distance: str
    weight_type: str
    niters: int
    learning_rate: float
    evaluation_type: str = "none"

    @property
    def name(self) -> str:
        return "_".join(map(str, (self.n_rep_periods, self.period_length, self.clustering_type, self.distance, self.weight_type, self.niters, self.learning_rate)))


def evaluation(c: Catalog, solution: DataFrame, e: Experiment) -> Programme:
    """The programme of all timesteps as one period, with what e's evaluation fixes."""
    length = c.tables["profiles_raw"].agg(F.max("timestep")).first()[0]
    whole = c.with_(length)
    whole = whole.with_(rp_profiles=whole.profiles.withColumnRenamed("period", "rep_period"))
    p = build(whole, c.spark.createDataFrame([(1, 1, 1.0)], WEIGHTS))
    if e.evaluation_type == "storage_regret":
        levels = solution.where(F.col("name") == "state_of_charge_inter")
        return fix(p, levels.select(F.lit("state_of_charge_intra").alias("name"), "id", F.lit(1).cast("long").alias("r"), (F.col("t") * e.period_length).alias("t"), "value"))
    return fix(p, solution.where(F.col("name") == "invested_units"))


class Shared:
    """What experiments over the same tables share: profiles and tiles of each period length, and searches.

    A search is one for all types of weights and rates of learning that need its kind. Each is made once, when it is first
    asked for, by whichever experiment that is; forget() and close() give back what is kept.
    """

    def __init__(self, tables: dict[str, DataFrame]) -> None:
        self.tables, self.spark = tables, next(iter(tables.values())).sparkSession
        self.searches, self._lock, self._catalogs, self._found, self._scratch = 0, Lock(), {}, {}, {}

    @staticmethod
    def key(e: Experiment) -> tuple:
        return e.period_length, e.n_rep_periods, method_for(e.clustering_type, e.weight_type), e.distance

    def catalog(self, length: int) -> Catalog:
        with self._lock:
            if length not in self._catalogs:
                self._scratch[length] = Scratch(self.spark)
                c = Catalog(self.tables, length)
                self._catalogs[length] = c.holding(profiles=self._scratch[length].keep(c.profiles))
            return self._catalogs[length]

    def _once(self, key: tuple, make):
        with self._lock:
            mine = key not in self._found
            if mine:
                self._found[key] = Future()
            found = self._found[key]
        if mine:
            try:
                found.set_result(make())
            except BaseException as e:
                found.set_exception(e)
        return found.result()

    def tiles(self, length: int) -> Tiles | None:
        """The tiles of the complete periods; those of a shorter last period are left to the search."""

        def make():
            profiles = self.catalog(length).profiles
            aux = auxiliary(profiles)
            if aux.last_period_duration != aux.period_duration:
                return None
            return tile(profiles, aux.key_columns, scratch=self._scratch[length])

        return self._once((length,), make)

    def search(self, e: Experiment) -> ClusteringResult:
        def make():
            with self._lock:
                self.searches += 1
            return find_representative_periods(self.catalog(e.period_length).profiles, e.n_rep_periods, method=self.key(e)[2], distance=e.distance, known=self.tiles(e.period_length))

        return self._once(self.key(e), make)

    def forget(self, key: tuple) -> None:
        """Gives back one search."""
        if (found := self._found.pop(key, None)) is not None and found.exception() is None and found.result() is not None:
            found.result().release()

    def close(self) -> None:
        for key in [k for k in self._found if len(k) > 1]:
            self.forget(key)
        for scratch in self._scratch.values():
            scratch.close()
        self._found, self._catalogs, self._scratch = {}, {}, {}


def run_experiment(tables: dict[str, DataFrame], e: Experiment, seed: int = 0, *, shared: Shared | None = None, **how) -> tuple[ExperimentResult, Solution]:
    """One experiment's result and solution. shared: what it has in common with others; without it, all is given back at the end.

    Times are those of this experiment: a search that another has made takes none.
    """
    clock, times = time.perf_counter(), []

    def lap():
        nonlocal clock
        times.append(time.perf_counter() - clock)
        clock = time.perf_counter()

    own = Shared(tables) if shared is None else shared
    with Scratch(own.spark) as scratch:
        c = own.catalog(e.period_length)
        c.profiles.count()
        lap()
        found = own.search(e)
        lap()
        weights = scratch.keep(fit_weights(found, e.weight_type, niters=e.niters, learning_rate=e.learning_rate, scratch=scratch))
        error = projection_error(found.features, weights, found.representatives)
        lap()
        p = build(c.with_(rp_profiles=found.profiles).holding(profiles=c.profiles), weights)
        lap()
        solution = solve(p, **how)
        p.release()
        lap()
        evaluated, spilled, borrowed = None, 0.0, 0.0
        if e.evaluation_type != "none" and solution.status == "OPTIMAL":
            whole = evaluation(c, solution.variables, e)
            evaluated = solve(whole, **how)
            whole.release()
        if evaluated is not None and evaluated.status == "OPTIMAL":
            sums = {r["name"]: r["s"] for r in evaluated.variables.where(F.col("name").isin("spillage", "borrow")).groupBy("name").agg(F.sum("value").alias("s")).collect()}
            spilled, borrowed = sums.get("spillage", 0.0), sums.get("borrow", 0.0)
    if shared is None:
        own.close()
    result = ExperimentResult(e.name, seed, e.n_rep_periods, e.period_length, e.clustering_type, e.distance, e.weight_type, error, solution.status, solution.objective, evaluated.status if evaluated else "NONE", evaluated.objective if evaluated else None, spilled, borrowed, *times)
    return result, solution


def plan_grid(grid: Sequence[Experiment]) -> list[list[Experiment]]:
    """The experiments by the search that they share, searches of one period length side by side."""
    groups: dict[tuple, list[Experiment]] = {}
    for e in grid:
        groups.setdefault(Shared.key(e), []).append(e)
    return [groups[k] for k in sorted(groups, key=str)]


def run_grid(spark: SparkSession, inputs: str, names: Sequence[str], outputs: str, seeds: Sequence[int] | None = None, *, at_once: int = 2, **how) -> int:
    """Runs each experiment of the grids inputs/name.csv over the tables of inputs/name, once for each seed; how many ran.

    Each gives a row of the partitioned table outputs/name/results and of the file outputs/name.csv, and its variables, if it
    was solved, in the partitioned tables outputs/name/variable, all by the experiment's name and the seed. A run that has
    its result already is left out, so a grid that was killed goes on where it was. Tables are read once, experiments that need the same search share it, and
    at_once of them run side by side. Without seeds, five are drawn from 1 to 1000. Nothing here draws at random, so a seed
    only names its rows: an experiment runs once, and its rows are written for every seed.
    """
    seeds = [int(s) for s in np.random.default_rng(123).integers(1, 1001, 5)] if seeds is None else list(seeds)
    ran = 0
    for name in names:
        grid = [Experiment(**row.asDict()) for row in read_run_data(spark, f"{inputs}/{name}.csv").collect()]
        done = f"{outputs}/{name}/results"
        open_ = {e: [seed for seed in seeds if not has_run(spark, done, name=e.name, seed=seed)] for e in grid}
        grid = [e for e in open_ if open_[e]]
        if not grid:
            continue
        began = time.perf_counter()
        shared = Shared(read_data_from_dir(spark, f"{inputs}/{name}"))
        read = time.perf_counter() - began
        try:
            with ThreadPoolExecutor(at_once) as pool:
                for group in plan_grid(grid):
                    for e, (result, solution) in zip(group, pool.map(lambda e: run_experiment(shared.tables, e, shared=shared, **how), group)):
                        for seed in open_[e]:
                            row = replace(result, seed=seed)
                            # the result comes last: a run that has one is whole
                            append_variables(solution, f"{outputs}/{name}", result.name, seed)
                            if append_run(row.as_frame(spark, read), done, name=row.name, seed=seed):
                                save_result(row, spark, f"{outputs}/{name}.csv", read)
                                ran += 1
                    shared.forget(Shared.key(group[0]))
        finally:
            shared.close()
    return ran
