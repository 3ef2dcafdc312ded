"""The capacity-expansion and dispatch programme as coefficient rows.

A variable is (name, id, r, t): r is a representative period, t a timestep or a period; 0 where there is none. A
constraint row is named by a block and the keys of what it is built for. numbered_programme() gives both gapless numbers.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tsreduce.operators.numbering import numbered
from tsreduce.operators.views import Catalog
from tsreduce.operators.weights import rp_weight
from tsreduce.sources.scratch import Scratch

VAR = ["name", "id", "r", "t"]


@dataclass
class Programme:
    """variables (name, id, r, t, lb, ub, cost), rows (row, sense, rhs), terms (row, name, id, r, t, a)."""

    variables: DataFrame
    rows: DataFrame
    terms: DataFrame
    scratch: Scratch | None = None

    def release(self) -> None:
        """Gives back what the frames are read from."""
        if self.scratch is not None:
            self.scratch.close()


@dataclass
class Coefficients:
    """columns (col, name, id, r, t, lb, ub, cost), rows (index, row, sense, rhs) and entries (index, col, a); numbers are gapless from 0."""

    columns: DataFrame
    rows: DataFrame
    entries: DataFrame

    def write(self, folder: str) -> None:
        """Parquet tables columns, rows and entries; each task writes its part."""
        for name in ("columns", "rows", "entries"):
            getattr(self, name).write.parquet(f"{folder}/{name}")


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _key(block: str, *keys) -> Column:
    return F.concat_ws("|", F.lit(block), *(_col(k).cast("string") for k in keys))


def _terms(df: DataFrame, *each: tuple) -> DataFrame:
    """For every row of df, which is read once, a term of each (row, name, a, r, t); r and t are 0 where left out. Those worth nothing are left out."""

    def term(row, name, a, r=0, t=0):
        return F.struct(row.alias("row"), _col(name).alias("name"), F.col("id").alias("id"), _col(r).cast("long").alias("r"), _col(t).cast("long").alias("t"), _col(a).cast("double").alias("a"))

    return df.select(F.inline(F.array(*(term(*e) for e in each)))).where("a <> 0")


def _rows(df: DataFrame, *each: tuple) -> DataFrame:
    """For every row of df a row of each (row, sense, rhs)."""
    return df.select(F.inline(F.array(*(F.struct(row.alias("row"), F.lit(sense).alias("sense"), _col(rhs).cast("double").alias("rhs")) for row, sense, rhs in each))))


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def build(c: Catalog, weights: DataFrame, timestep_duration: float | None = None) -> Programme:
    """The programme over c's representatives, whose weights by period are given. What views share of the profiles is kept until it is released."""
    scratch = Scratch(c.spark)
    c, weights = c.spread(scratch).kept(scratch), scratch.keep(weights)
    dur = c.scalar("timestep_duration") if timestep_duration is None else timestep_duration
    last = c.rp_profiles.agg(F.max("timestep")).first()[0] or 0
    n_periods = c.periods.agg(F.max("id")).first()[0] or 0
    r, t, i = F.col("rep_period"), F.col("timestep"), F.col("id")
    grid, reps = c.time_grid, c.rp_profiles.select("rep_period").distinct()
    assets, lines = c.tables["assets"], c.tables["transmission_lines"]
    storage, seasonal, short = c.storage_assets.select("id"), c.seasonal_storage_assets, c.short_term_storage_assets
    charging = c.seasonal_storage_assets_can_charge
    charged = short.select("id").unionByName(charging.select("id")).unionByName(c.conversion_assets.select("id")).distinct()
    rows: list[DataFrame] = []
    terms: list[DataFrame] = []

    def variable(df, name, lb, ub=None, r_=None, t_=None):
        return df.select(F.lit(name).alias("name"), i.alias("id"), (F.lit(0) if r_ is None else r_).cast("long").alias("r"), (F.lit(0) if t_ is None else t_).cast("long").alias("t"), _col(lb).cast("double").alias("lb"), _col(ub).cast("double").alias("ub"))

    # variables and their bounds
    level = seasonal.select("id").crossJoin(c.periods.select(F.col("id").alias("period")))
    bounds = c.inter_period_storage_capacity_constraint_view
    level = level.join(bounds, ["id", "period"], "left")
    energy = F.col("capacity_storage_energy")
    variables = _union([
        variable(c.investable_assets, "invested_units", 0.0),
        variable(assets.crossJoin(grid), "power_out", 0.0, None, r, t),
        variable(charged.crossJoin(grid), "power_in", 0.0, None, r, t),
        variable(storage.crossJoin(reps), "state_of_charge_intra_0", 0.0, None, r),
        variable(c.intra_period_storage_capacity_constraint_view, "state_of_charge_intra", 0.0, energy, r, t),
        variable(seasonal, "state_of_charge_inter_0", 0.0),
        variable(level, "state_of_charge_inter", F.coalesce(F.col("min_storage_level") * energy, F.lit(0.0)), F.col("max_storage_level") * energy, None, F.col("period")),
        variable(seasonal.select("id").crossJoin(grid), "spillage", 0.0, None, r, t),
        variable(seasonal.select("id").crossJoin(grid), "borrow", 0.0, None, r, t),
        variable(c.transmission_line_capacity_constraint_view, "flow", -F.col("import_capacity"), F.col("export_capacity"), r, t),
    ])

    # L1: costs
    weight = rp_weight(weights, c.scalar("operations_weight")).select(F.col("rep_period").alias("r"), F.col("weight").alias("w"))
    once = c.investment_cost_objective_view.groupBy("id").agg(F.sum(F.col("cost") * F.col("unit_capacity")).alias("c")).select(F.lit("invested_units").alias("name"), "id", "c")
    each = [v.groupBy("id").agg(F.sum(f"{k}_cost").alias("c")).select(F.lit(n).alias("name"), "id", "c") for v, k, n in ((c.operations_cost_objective_view, "variable", "power_out"), (c.spillage_cost_objective_view, "spillage", "spillage"), (c.borrow_cost_objective_view, "borrow", "borrow"))]
    cost = F.coalesce(F.col("c") * F.when(F.col("name") == "invested_units", 1.0).otherwise(F.coalesce("w", F.lit(0.0))), F.lit(0.0))
    variables = variables.join(_union([once, *each]), ["name", "id"], "left").join(weight, "r", "left").select(*VAR, "lb", "ub", cost.alias("cost"))

    # L2: balance; rows of one place and time are numbered, as two demands make two of them
    at = ["location", "carrier", "rep_period", "timestep"]
    balance = c.balance_constraint_view.withColumn("k", F.row_number().over(Window.partitionBy(*at).orderBy("demand_profile", "peak_demand")))
    key = _key("balance", *map(F.col, at), F.col("k"))
    rows.append(_rows(balance, (key, "=", F.col("demand_profile") * F.col("peak_demand"))))
    moved = _union([
        c.power_out_expression_view.select("location", F.col("carrier_out").alias("carrier"), F.lit("power_out").alias("name"), "id", F.lit(1.0).alias("a")),
        c.power_in_expression_view.select("location", F.col("carrier_in").alias("carrier"), F.lit("power_in").alias("name"), "id", F.lit(-1.0).alias("a")),
        lines.select(F.col("from").alias("location"), "carrier", F.lit("flow").alias("name"), "id", F.lit(-1.0).alias("a")),
        lines.select(F.col("to").alias("location"), "carrier", F.lit("flow").alias("name"), "id", F.lit(1.0).alias("a")),
    ])
    terms.append(balance.withColumn("row", key).join(moved, ["location", "carrier"]).select("row", "name", "id", r.cast("long").alias("r"), t.cast("long").alias("t"), "a"))

    # Charge within a period; what comes in and goes out is worth the duration of a step, inflow is not
    def charge(v, block, seasonal_, charges):
        key, later = _key(block, i, r, t), t > 1
        before = F.when(later, "state_of_charge_intra").otherwise("state_of_charge_intra_0")
        of = [(key, "state_of_charge_intra", 1.0, r, t), (key, before, -1.0, r, F.when(later, t - 1).otherwise(0)), (key, "power_out", F.try_divide(F.lit(dur), F.col("efficiency_out")), r, t)]
        if charges:
            of.append((key, "power_in", -F.col("efficiency_in") * dur, r, t))
        if seasonal_:
            of += [(key, "spillage", 1.0, r, t), (key, "borrow", -1.0, r, t)]
        rows.append(_rows(v, (key, "=", F.col("inflow_profile") * F.col("peak_inflow") if seasonal_ else 0.0)))
        terms.append(_terms(v, *of))

    charge(c.intra_period_short_term_storage_constraint_view, "short", False, True)
    charge(c.intra_period_seasonal_storage_can_charge_constraint_view, "charging", True, True)
    charge(c.intra_period_seasonal_storage_cannot_charge_constraint_view, "inflow", True, False)

    # Between periods
    d, w = F.col("period"), F.col("weight")
    level = seasonal.select("id").crossJoin(c.periods.select(F.col("id").alias("period")))
    key, later = _key("inter", i, d), d > 1
    before = F.when(later, "state_of_charge_inter").otherwise("state_of_charge_inter_0")
    rows.append(_rows(level, (key, "=", 0.0)))
    terms.append(_terms(level, (key, "state_of_charge_inter", 1.0, 0, d), (key, before, -1.0, 0, F.when(later, d - 1).otherwise(0))))
    terms.append(_terms(level.join(weights, "period"), (key, "state_of_charge_intra", -w, r, last), (key, "state_of_charge_intra_0", w, r)))

    # Where a period, or the whole, ends as it began
    cycle, initial, final = (_key(k, i) for k in ("cycle", "initial", "final"))
    rows.append(_rows(seasonal, (cycle, "=", 0.0), (initial, "=", F.col("initial_storage_level")), (final, "=", 0.0)))
    terms.append(_terms(seasonal, (cycle, "state_of_charge_inter", 1.0, 0, n_periods), (cycle, "state_of_charge_inter_0", -1.0), (initial, "state_of_charge_inter_0", 1.0), (final, "state_of_charge_inter", 1.0, 0, n_periods)))
    terms.append(_terms(seasonal.select("id").crossJoin(weights.where(d == n_periods)), (final, "state_of_charge_intra", -w, r, last)))
    within = short.select("id").crossJoin(reps)
    key = _key("cycle", i, r)
    rows.append(_rows(within, (key, "=", 0.0)))
    terms.append(_terms(within, (key, "state_of_charge_intra", 1.0, r, last), (key, "state_of_charge_intra_0", -1.0, r)))

    # conversion
    v = c.conversion_constraint_view
    key = _key("conversion", i, r, t)
    rows.append(_rows(v, (key, "=", 0.0)))
    terms.append(_terms(v, (key, "power_in", F.col("efficiency_in"), r, t), (key, "power_out", -F.try_divide(F.lit(1.0), F.col("efficiency_out")), r, t)))

    # Limits by capacity, which investments extend
    chosen = c.tables["investments"].select("id", F.lit(True).alias("investable")).distinct()
    sized = assets.join(chosen, "id", "left").select("id", "unit_capacity", (F.col("unit_capacity") * F.col("initial_units")).alias("there"), F.coalesce("investable", F.lit(False)).alias("investable"))

    def limit(v, share, *each):
        """Rows and terms of v's limits, each with its key and the moves that it holds down."""
        built = F.when(F.col("investable"), -share * F.col("unit_capacity"))
        rows.append(_rows(v, *((key, "<", share * F.col("there")) for key, _ in each)))
        terms.append(_terms(v, *((key, "invested_units", built) for key, _ in each), *((key, *m) for key, moves in each for m in moves)))

    v = c.capacity_constraint_view.drop("investable", "unit_capacity", "initial_units").join(sized, "id")
    limit(v, F.col("availability_profile"), (_key("capacity", i, r, t), [("power_out", 1.0, r, t)]))
    v = short.select("id").unionByName(charging.select("id")).crossJoin(grid).join(sized, "id")
    limit(v, F.lit(1.0), (_key("charging_capacity", i, r, t), [("power_in", 1.0, r, t)]))
    v = c.intra_period_ramping_constraint_view.join(sized, "id")
    limit(v, F.col("ramping_rate") * dur, *((_key(f"ramp{up:+.0f}", i, r, t), [("power_out", up, r, t), ("power_out", -up, r, t - 1)]) for up in (1.0, -1.0)))
    v = c.inter_period_ramping_constraint_view.join(sized, "id")
    keys = {up: _key(f"inter_ramp{up:+.0f}", i, d) for up in (1.0, -1.0)}
    limit(v, F.col("ramping_rate") * dur, *((key, []) for key in keys.values()))
    steps = weights.select("period", "rep_period", "weight", F.lit(1).alias("at")).unionByName(weights.select((d + 1).alias("period"), "rep_period", (-w).alias("weight"), F.lit(last).alias("at")))
    terms.append(_terms(v.select("id", "period").join(steps, "period"), *((key, "power_out", up * w, r, F.col("at")) for up, key in keys.items())))

    # dealt by row alone, in so many parts that a task sums as many however many assets there are; joins by row need no other shuffle
    summed = _union(terms).repartition(8 * c.parts, "row").groupBy("row", *VAR).agg(F.sum("a").alias("a")).where("a <> 0")
    return Programme(variables, _union(rows), summed, scratch)


def numbered_programme(p: Programme) -> Coefficients:
    """p with gapless numbers for variables and rows, which depend on their names alone, and its terms by these numbers.

    A term of a variable that p lacks, as where an hour has no profile at all, has a null column.
    """
    if p.scratch is None:
        p.scratch = Scratch(p.rows.sparkSession)
    columns, rows = numbered(p.variables, VAR, "col", scratch=p.scratch), numbered(p.rows, ["row"], scratch=p.scratch)
    entries = p.terms.join(rows.select("row", "index"), "row").join(columns.select(*VAR, "col"), VAR, "left").select("index", "col", "a")
    return Coefficients(columns.select("col", *VAR, "lb", "ub", "cost"), rows.select("index", "row", "sense", "rhs"), entries)


def fix(p: Programme, values: DataFrame) -> Programme:
    """p with the variables of values (name, id, r, t, value) fixed."""
    joined = p.variables.join(values.select(*VAR, "value"), VAR, "left")
    held = joined.select(*VAR, F.coalesce("value", "lb").alias("lb"), F.coalesce("value", "ub").alias("ub"), "cost")
    return Programme(held, p.rows, p.terms, p.scratch)
