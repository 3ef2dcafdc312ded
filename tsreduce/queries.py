"""Queries of the engine's own operators on the driver's tables, and their SQL for DuckDB.

Suppliers stand for assets, nations for locations, customers' balances for demand, and events summed by hour for
profiles. These base tables are the same text in both engines; what is compared are the views and operators on them.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tsreduce.functions import projections
from tsreduce.operators import clustering, reshape, tiles, weights
from tsreduce.operators.views import VIEWS, Catalog
from tsreduce.plans import lp
from tsreduce.sources.scratch import Scratch

PERIOD = 24
SERIES = ("click", "error", "purchase", "signup", "view")
#: Hours since 2024 began; years are as long as the longest.
_HOUR = "(year(ts) - 2024) * 8784 + (dayofyear(ts) - 1) * 24 + hour(ts) + 1"
_KIND = "CASE s_suppkey % 5 WHEN 0 THEN 'Wind' WHEN 1 THEN 'Coal' WHEN 2 THEN 'Battery' WHEN 3 THEN 'Hydro' ELSE 'Electrolyzer' END"
_ID = "'S' || CAST(s_suppkey AS STRING)"

#: Base tables; {name} is a table of the driver.
BASE = {
    "assets": f"SELECT {_ID} AS id, n_name AS location, {_KIND} AS technology, CAST(100 + s_suppkey % 7 * 50 AS DOUBLE) AS unit_capacity, CAST(s_suppkey % 3 AS DOUBLE) AS initial_units FROM {{supplier}} JOIN {{nation}} ON s_nationkey = n_nationkey",
    "investments": f"SELECT {_ID} AS id, round(s_acctbal / 100, 2) AS cost FROM {{supplier}} WHERE s_acctbal > 5000",
    "technologies": f"SELECT DISTINCT {_KIND} AS id, CASE WHEN s_suppkey % 5 < 2 THEN 'generation' WHEN s_suppkey % 5 < 4 THEN 'storage' ELSE 'conversion' END AS type, CASE WHEN s_suppkey % 5 = 4 THEN 'hydrogen' ELSE 'electricity' END AS carrier_out FROM {{supplier}}",
    "technologies_conversion": f"SELECT DISTINCT {_KIND} AS id, 'electricity' AS carrier_in, CAST(1 AS DOUBLE) AS efficiency_in, CAST(0.65 AS DOUBLE) AS efficiency_out FROM {{supplier}} WHERE s_suppkey % 5 = 4",
    "technologies_generation": "SELECT id, CAST(a AS DOUBLE) AS variable_cost, CAST(b AS DOUBLE) AS ramping_rate FROM (VALUES ('Wind', 0.0, 1.0), ('Coal', 0.15, 0.4)) AS t(id, a, b)",
    "technologies_storage": "SELECT id, is_seasonal, CAST(a AS DOUBLE) AS efficiency_in, CAST(b AS DOUBLE) AS efficiency_out FROM (VALUES ('Battery', false, 0.95, 0.95), ('Hydro', true, 0.9, 0.8)) AS t(id, is_seasonal, a, b)",
    "assets_storage": f"SELECT {_ID} AS id, CAST(1000 + s_suppkey % 9 * 10 AS DOUBLE) AS capacity_storage_energy, CAST(1 AS DOUBLE) AS initial_storage_units FROM {{supplier}} WHERE s_suppkey % 5 IN (2, 3)",
    "assets_storage_seasonal": f"SELECT {_ID} AS id, CAST(100 + s_suppkey % 11 AS DOUBLE) AS initial_storage_level, CAST(50 + s_suppkey % 4 AS DOUBLE) AS peak_inflow, CAST(0 AS DOUBLE) AS spillage_cost, CAST(1 AS DOUBLE) AS borrow_cost, s_suppkey % 2 = 0 AS can_charge FROM {{supplier}} WHERE s_suppkey % 5 = 3",
    "assets_storage_seasonal_reservoir_levels": f"SELECT {_ID} AS asset, 'min_storage_level' AS profile_type, 'lowest' AS profile_name FROM {{supplier}} WHERE s_suppkey % 5 = 3 UNION ALL SELECT {_ID}, 'max_storage_level', 'highest' FROM {{supplier}} WHERE s_suppkey % 10 = 3",
    "demand": "SELECT 'D' || CAST(n_nationkey AS STRING) AS id, n_name AS location, 'electricity' AS carrier, round(sum(c_acctbal), 2) AS peak_demand FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey WHERE n_nationkey % 6 <> 5 GROUP BY n_nationkey, n_name",
    "transmission_lines": "SELECT 'L' || CAST(a.n_nationkey AS STRING) || '_' || CAST(b.n_nationkey AS STRING) AS id, a.n_name AS `from`, b.n_name AS `to`, 'electricity' AS carrier, CAST(100 + a.n_nationkey AS DOUBLE) AS export_capacity, CAST(200 + b.n_nationkey AS DOUBLE) AS import_capacity FROM {nation} AS a JOIN {nation} AS b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "scalars": "SELECT scalar, CAST(x AS DOUBLE) AS value FROM (VALUES ('operations_weight', 1.0), ('timestep_duration', 1.0)) AS t(scalar, x)",
    "profiles_raw": f"SELECT CAST({_HOUR} AS BIGINT) AS timestep, " + ", ".join(f"round(sum(CASE WHEN event_type = '{s}' THEN value END), 6) AS `{s}`" for s in SERIES) + f" FROM {{events}} GROUP BY {_HOUR}",
    "profiles_reservoir_levels_raw": f"SELECT CAST({_HOUR} AS BIGINT) AS timestep, CAST(0.2 AS DOUBLE) AS lowest, CAST(0.9 AS DOUBLE) AS highest FROM {{events}} GROUP BY {_HOUR}",
    "assets_profiles": f"SELECT 'D' || CAST(n_nationkey AS STRING) AS asset, 'demand' AS profile_type, 'view' AS profile FROM {{nation}} UNION ALL SELECT {_ID}, 'availability', 'click' FROM {{supplier}} WHERE s_suppkey % 5 = 0 UNION ALL SELECT {_ID}, 'inflows', 'signup' FROM {{supplier}} WHERE s_suppkey % 5 = 3",
}
TABLES = ("supplier", "nation", "customer", "events")


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    read = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    return {k: spark.sql(q, **{t: read[t] for t in TABLES if f"{{{t}}}" in q}) for k, q in BASE.items()}


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """Periods of a day; the first three stand for representatives."""
    c = Catalog(tables(spark, sf_dir), PERIOD)
    return c.with_(rp_profiles=c.profiles.where("period <= 3").withColumnRenamed("period", "rep_period"))


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(period, timestep, id, value) of all hours and series; hours without events are 0."""
    wide = catalog(spark, sf_dir).tables["profiles_raw"]
    last = (F.ceil(F.max("timestep") / PERIOD) * PERIOD).cast("long")
    hours = wide.agg(last.alias("last")).select(F.explode(F.sequence(F.lit(1).cast("long"), "last")).alias("timestep"))
    full = hours.join(wide, "timestep", "left").fillna(0.0, list(SERIES))
    return reshape.split_into_periods(reshape.unpivot_wide(full), PERIOD)


def features(spark: SparkSession, sf_dir: str) -> tiles.Tiles:
    """Tiles that are kept as long as the session, as the query's result reads them."""
    scratch = Scratch(spark)
    return tiles.tile(scratch.keep(dense(spark, sf_dir)), scratch=scratch)


#: SQL of each view over the base tables and the views before it.
VIEW_SQL = {
    "locations": "SELECT location AS id FROM assets GROUP BY location",
    "carriers": "SELECT carrier_out AS id FROM technologies UNION SELECT carrier_in FROM technologies_conversion",
    "all_locations_and_carriers": "SELECT l.id AS location, c.id AS carrier FROM locations l CROSS JOIN carriers c",
    "investable_assets": "SELECT a.*, i.cost FROM assets a JOIN investments i USING (id)",
    "non_investable_assets": "SELECT * FROM assets WHERE id NOT IN (SELECT id FROM investments)",
    "conversion_assets": "SELECT a.*, t.type, t.carrier_out, x.carrier_in, x.efficiency_in, x.efficiency_out FROM assets a JOIN technologies t ON t.id = a.technology JOIN technologies_conversion x ON x.id = t.id WHERE t.type = 'conversion'",
    "generation_assets": "SELECT a.*, t.type, t.carrier_out, x.variable_cost, x.ramping_rate FROM assets a JOIN technologies t ON t.id = a.technology JOIN technologies_generation x ON x.id = t.id WHERE t.type = 'generation'",
    "storage_assets": "SELECT a.*, t.type, t.carrier_out, x.is_seasonal, x.efficiency_in, x.efficiency_out, s.capacity_storage_energy, s.initial_storage_units FROM assets a JOIN technologies t ON t.id = a.technology JOIN technologies_storage x ON x.id = t.id JOIN assets_storage s ON s.id = a.id WHERE t.type = 'storage'",
    "seasonal_storage_assets": "SELECT s.*, x.* EXCLUDE (id) FROM storage_assets s JOIN assets_storage_seasonal x ON x.id = s.id WHERE s.is_seasonal",
    "seasonal_storage_assets_can_charge": "SELECT * FROM seasonal_storage_assets WHERE can_charge",
    "seasonal_storage_assets_cannot_charge": "SELECT * FROM seasonal_storage_assets WHERE can_charge = false",
    "short_term_storage_assets": "SELECT * FROM storage_assets WHERE is_seasonal = false",
    "profiles": "SELECT (u.timestep - 1) // 24 + 1 AS period, (u.timestep - 1) % 24 + 1 AS timestep, a.asset AS id, a.profile_type, u.value FROM (FROM profiles_raw UNPIVOT (value FOR name IN (click, error, purchase, signup, view))) u JOIN assets_profiles a ON a.profile = u.name",
    "timesteps": "SELECT timestep AS id FROM profiles GROUP BY timestep",
    "periods": "SELECT period AS id FROM profiles GROUP BY period",
    "profiles_reservoir_levels": "SELECT (timestep - 1) // 24 + 1 AS period, (timestep - 1) % 24 + 1 AS timestep, name AS id, value FROM (FROM profiles_reservoir_levels_raw UNPIVOT (value FOR name IN (lowest, highest)))",
    "avg_profiles": "SELECT l.asset, l.profile_type, p.period, round(avg(p.value), 6) AS avg_value FROM profiles_reservoir_levels p JOIN assets_storage_seasonal_reservoir_levels l ON l.profile_name = p.id GROUP BY ALL",
    "pivoted_profiles": "SELECT asset AS id, period, max(avg_value) FILTER (profile_type = 'min_storage_level') AS min_storage_level, max(avg_value) FILTER (profile_type = 'max_storage_level') AS max_storage_level FROM avg_profiles GROUP BY asset, period",
    "all_asset_periods": "SELECT s.id, p.period, s.capacity_storage_energy FROM seasonal_storage_assets s CROSS JOIN (SELECT period FROM profiles_reservoir_levels GROUP BY period) p",
    "inter_period_storage_capacity_constraint_view": "SELECT a.id, a.period, ifnull(p.min_storage_level, 0.0) AS min_storage_level, ifnull(p.max_storage_level, 1.0) AS max_storage_level, a.capacity_storage_energy FROM all_asset_periods a LEFT JOIN pivoted_profiles p USING (id, period)",
    "investment_cost_objective_view": "SELECT id, unit_capacity, cost FROM investable_assets",
    "operations_cost_objective_view": "SELECT id, variable_cost FROM generation_assets",
    "spillage_cost_objective_view": "SELECT id, spillage_cost FROM seasonal_storage_assets",
    "borrow_cost_objective_view": "SELECT id, borrow_cost FROM seasonal_storage_assets",
    "power_out_expression_view": "SELECT a.id, a.location, t.carrier_out FROM technologies t JOIN assets a ON a.technology = t.id",
    "power_in_expression_view": "SELECT id, location, carrier_out AS carrier_in FROM storage_assets s WHERE NOT is_seasonal OR EXISTS (FROM assets_storage_seasonal x WHERE x.id = s.id AND x.can_charge) UNION ALL SELECT id, location, carrier_in FROM conversion_assets",
    "transmission_line_expression_view": 'SELECT id, "from", "to", carrier FROM transmission_lines',
    "initial_storage_constraint_view": "SELECT id, initial_storage_level FROM seasonal_storage_assets",
    "rp_profiles": "SELECT period AS rep_period, timestep, id, profile_type, value FROM profiles WHERE period <= 3",
    "time_grid": "SELECT rep_period, timestep FROM rp_profiles GROUP BY ALL",
    "balance_constraint_view": "SELECT lc.location, lc.carrier, t.rep_period, t.timestep, ifnull(r.value, 1.0) AS demand_profile, ifnull(d.peak_demand, 0.0) AS peak_demand FROM all_locations_and_carriers lc CROSS JOIN time_grid t LEFT JOIN demand d ON d.location = lc.location AND d.carrier = lc.carrier LEFT JOIN rp_profiles r ON r.id = d.id AND r.rep_period = t.rep_period AND r.timestep = t.timestep AND r.profile_type = 'demand'",
    "intra_period_short_term_storage_constraint_view": "SELECT s.id, t.rep_period, t.timestep, s.efficiency_in, s.efficiency_out FROM short_term_storage_assets s, time_grid t",
    "intra_period_seasonal_storage_can_charge_constraint_view": "SELECT s.id, t.rep_period, t.timestep, s.efficiency_in, s.efficiency_out, ifnull(r.value, 0.0) AS inflow_profile, s.peak_inflow FROM seasonal_storage_assets_can_charge s CROSS JOIN time_grid t LEFT JOIN rp_profiles r ON r.id = s.id AND r.rep_period = t.rep_period AND r.timestep = t.timestep AND r.profile_type = 'inflows'",
    "intra_period_seasonal_storage_cannot_charge_constraint_view": "SELECT s.id, t.rep_period, t.timestep, s.efficiency_out, ifnull(r.value, 0.0) AS inflow_profile, s.peak_inflow FROM seasonal_storage_assets_cannot_charge s CROSS JOIN time_grid t LEFT JOIN rp_profiles r ON r.id = s.id AND r.rep_period = t.rep_period AND r.timestep = t.timestep AND r.profile_type = 'inflows'",
    "conversion_constraint_view": "SELECT s.id, t.rep_period, t.timestep, s.efficiency_in, s.efficiency_out FROM conversion_assets s, time_grid t",
    "capacity_constraint_view": "SELECT a.id, t.rep_period, t.timestep, a.id IN (SELECT id FROM investments) AS investable, ifnull(r.value, 1.0) AS availability_profile, a.unit_capacity, a.initial_units FROM assets a CROSS JOIN time_grid t LEFT JOIN rp_profiles r ON r.id = a.id AND r.rep_period = t.rep_period AND r.timestep = t.timestep AND r.profile_type = 'availability'",
    "intra_period_storage_capacity_constraint_view": "SELECT s.id, t.rep_period, t.timestep, s.capacity_storage_energy FROM storage_assets s, time_grid t",
    "intra_period_ramping_constraint_view": "SELECT g.id, t.rep_period, t.timestep, g.ramping_rate FROM generation_assets g, time_grid t WHERE t.timestep > 1 AND g.ramping_rate < 1",
    "inter_period_ramping_constraint_view": "SELECT g.id, p.id AS period, g.ramping_rate FROM generation_assets g, periods p WHERE p.id > 1 AND g.ramping_rate < 1",
    "transmission_line_capacity_constraint_view": "SELECT l.id, t.rep_period, t.timestep, l.export_capacity, l.import_capacity FROM transmission_lines l, time_grid t",
}
_DENSE_SQL = {
    "charges": "SELECT 'short' AS block, id, rep_period, timestep, efficiency_in, efficiency_out FROM intra_period_short_term_storage_constraint_view UNION ALL SELECT 'charging', id, rep_period, timestep, efficiency_in, efficiency_out FROM intra_period_seasonal_storage_can_charge_constraint_view UNION ALL SELECT 'inflow', id, rep_period, timestep, NULL, efficiency_out FROM intra_period_seasonal_storage_cannot_charge_constraint_view",
    "cells": "SELECT h.h AS hour, s.s AS id, 0.0::DOUBLE AS none FROM (SELECT unnest(range(1, CAST(ceil(max(timestep) / 24) * 24 AS BIGINT) + 1)) AS h FROM profiles_raw) h, (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS s) s",
    "dense": "SELECT (c.hour - 1) // 24 + 1 AS period, (c.hour - 1) % 24 + 1 AS timestep, c.id, coalesce(u.value, c.none) AS value FROM cells c LEFT JOIN (FROM profiles_raw UNPIVOT (value FOR id IN (click, error, purchase, signup, view))) u ON u.timestep = c.hour AND u.id = c.id",
    "apart": "SELECT x.period AS p, y.period AS q, sqrt(sum((x.value - y.value) ** 2)) AS euclidean, sum(abs(x.value - y.value)) AS cityblock, max(abs(x.value - y.value)) AS chebyshev, 1 - sum(x.value * y.value) / sqrt(sum(x.value ** 2) * sum(y.value ** 2)) AS cosine FROM dense x JOIN dense y ON x.timestep = y.timestep AND x.id = y.id GROUP BY 1, 2",
    "chosen": "SELECT * FROM (VALUES (1, 1), (2, 11), (3, 21)) AS t(rep_period, period)",
    "blended": "SELECT period, rep_period::BIGINT AS rep_period, CASE place WHEN 1 THEN 0.75::DOUBLE ELSE 0.25::DOUBLE END AS weight FROM (SELECT a.p AS period, c.rep_period, row_number() OVER (PARTITION BY a.p ORDER BY round(a.euclidean, 9), c.rep_period) AS place FROM apart a JOIN chosen c ON c.period = a.q) WHERE place <= 2",
    "nearest": "SELECT a.p AS period, arg_min(c.rep_period, struct_pack(d := round(a.euclidean, 9), r := c.rep_period)) AS rep_period FROM apart a JOIN chosen c ON c.period = a.q GROUP BY a.p",
}


def _with(sql: str) -> str:
    """sql after those of the tables and views that it needs."""
    known = {k: re.sub(r"\{(\w+)\}", r"\1", q).replace("`", '"') for k, q in BASE.items()} | VIEW_SQL | _DENSE_SQL
    needed, todo = set(), [sql]
    while todo:
        for k in set(re.findall(r"\w+", todo.pop())) & set(known) - needed:
            needed.add(k)
            todo.append(known[k])
    if not needed:
        return sql
    return "WITH " + ",\n".join(f"{k} AS ({q})" for k, q in known.items() if k in needed) + f"\n{sql}"


def _view(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = catalog(spark, sf_dir).view(name)
        rounded = [c for c in df.columns if c in ("avg_value", "min_storage_level", "max_storage_level")]
        return df.withColumns({c: F.round(c, 6) for c in rounded}) if rounded else df

    return query


CHOSEN = (1, 11, 21)


def _reps(t: tiles.Tiles) -> DataFrame:
    return clustering.periods_as_reps(t, list(CHOSEN))


def unpivot_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.unpivot_wide(tables(spark, sf_dir)["profiles_raw"])


def split_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense(spark, sf_dir)


def combine_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.combine_periods(dense(spark, sf_dir)).select("timestep", "id", "value")


def long_matrix_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long to tiles and back."""
    t = features(spark, sf_dir)
    return tiles.to_long(t.cells.withColumnRenamed("period", "rep_period"), t)


def append_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dense(spark, sf_dir)
    rps = d.where("period = 1").withColumnRenamed("period", "rep_period")
    return reshape.append_period(rps, d, 30, 2)


def aux_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = clustering.auxiliary(dense(spark, sf_dir).where("period < 30 OR timestep <= 12"))
    w = clustering.period_weights(a.period_duration, a.last_period_duration, a.n_periods, True)[0]
    return spark.createDataFrame([(a.n_periods, a.period_duration, a.last_period_duration, round(w, 6))], "n_periods long, period_duration long, last_period_duration long, complete_period_weight double")


def _pairwise(metric: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tiles.pairwise(features(spark, sf_dir), metric).select("p", "q", F.abs(F.round("d", 5)).alias("d"))

    return query


def hull_first_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as scratch:
        found = clustering.greedy_hull(tiles.tile(scratch.keep(dense(spark, sf_dir)), scratch=scratch), 1, "euclidean", scratch)
    return spark.createDataFrame([(found[0],)], "period long")


def nearest_rep(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = features(spark, sf_dir)
    return clustering.nearest(t, _reps(t), "euclidean")


def centre_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as scratch:
        seeds = clustering.centre_seeds(tiles.tile(scratch.keep(dense(spark, sf_dir)), scratch=scratch), 5, "euclidean", scratch)
    return spark.createDataFrame([(p,) for p in seeds], "period long")


def simplex_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 10).alias("v"))
    return projections.project_rows(lines, "l_orderkey", "l_linenumber", "v").withColumn("weight", F.round("weight", 6))


def orthant_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    moved = projections.orthant_rows(lines.withColumn("v", F.col("l_tax") - 0.04), "v")
    return moved.select("l_orderkey", "l_linenumber", F.round("weight", 6).alias("weight"))


def descent_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One projected step from equal weights, for every period."""
    t = features(spark, sf_dir)
    reps = _reps(t)
    gram = tiles.gram(t, reps) / 1e4

    def rows(it):
        for b in it:
            if b.num_rows:
                products = tiles.matrix(pa.chunked_array([b.column("d")])) / 1e4
                w = projections.descend_rows(np.full((b.num_rows, 3), 1 / 3), gram, products, projections.onto_orthant, niters=1, tol=-np.inf, learning_rate=1e-3)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column("period").to_numpy(), 3)), pa.array(np.tile([1, 2, 3], len(w))), pa.array(np.round(w.ravel(), 6))], ["period", "rep_period", "weight"])

    return tiles.measures(t, reps, "dot").mapInArrow(rows, clustering.WEIGHTS)


def projection_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as scratch:
        t = tiles.tile(scratch.keep(dense(spark, sf_dir)), scratch=scratch)
        reps = _reps(t)
        w = clustering.nearest(t, reps, "euclidean").withColumn("weight", F.lit(1.0))
        error = weights.projection_error(t, w, reps)
    return spark.createDataFrame([(round(error, 4),)], "error double")


def rp_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights.rp_weight(nearest_rep(spark, sf_dir).withColumn("weight", F.lit(1.0)), 2.0)


def lag_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a ramp or a state of charge is made of: each value less the one before it."""
    return reshape.differences(dense(spark, sf_dir), ["id", "period"]).withColumn("change", F.round("change", 6))


def blended_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two representatives for each period: three quarters of the nearest and one of the next."""
    t = features(spark, sf_dir)
    apart = tiles.measures(t, _reps(t), "euclidean").select("period", F.posexplode("d").alias("r", "d"))
    place = F.row_number().over(Window.partitionBy("period").orderBy(F.round("d", 9), "r"))
    return apart.withColumn("place", place).where("place <= 2").select("period", (F.col("r") + 1).cast("long").alias("rep_period"), F.when(F.col("place") == 1, 0.75).otherwise(0.25).alias("weight"))


def _programme(spark: SparkSession, sf_dir: str, weights_: DataFrame | None = None) -> lp.Programme:
    w = nearest_rep(spark, sf_dir).withColumn("weight", F.lit(1.0)) if weights_ is None else weights_
    return lp.build(catalog(spark, sf_dir), w)


def lp_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = F.split_part(F.col("row"), F.lit("|"), F.lit(1)).alias("block")
    return _programme(spark, sf_dir).rows.groupBy(block, "sense").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("rhs"), 2).alias("rhs"))


def lp_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _programme(spark, sf_dir).variables.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("lb"), 2).alias("lb"), F.round(F.sum("ub"), 2).alias("ub"), F.round(F.sum("cost"), 2).alias("cost"))


def _sums_of_terms(terms: DataFrame) -> DataFrame:
    block = F.split_part(F.col("row"), F.lit("|"), F.lit(1)).alias("block")
    return terms.groupBy(block, "name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("a"), 3).alias("a"), F.round(F.sum(F.col("a") * F.col("a")), 3).alias("squares"), F.round(F.sum(F.col("a") * (F.col("r") * 100 + F.col("t"))), 2).alias("moment"))


def lp_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sums_of_terms(_programme(spark, sf_dir).terms)


def lp_blended_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sums_of_terms(_programme(spark, sf_dir, blended_weights(spark, sf_dir)).terms)


def lp_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms of each block by the numbers of their rows."""
    c = lp.numbered_programme(_programme(spark, sf_dir))
    block = F.split_part(F.col("row"), F.lit("|"), F.lit(1)).alias("block")
    return c.entries.join(c.rows.select("index", "row"), "index").groupBy(block).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("a"), 2).alias("a"), F.round(F.sum(F.col("a") * F.col("a")), 2).alias("squares"))


def lp_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many numbers there are, how many different ones, and the largest."""
    c = lp.numbered_programme(_programme(spark, sf_dir))
    each = [df.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"), F.count_distinct(i).alias("different"), (F.max(i) + 1).alias("last")) for kind, df, i in (("rows", c.rows, "index"), ("columns", c.columns, "col"))]
    return each[0].unionByName(each[1])


def _found(method: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return clustering.find_representative_periods(Scratch(spark).keep(dense(spark, sf_dir)), 4, method=method).weights

    return query


def _fitted(kind: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = Scratch(spark).keep(dense(spark, sf_dir).withColumn("value", F.col("value") / 1000))
        found = clustering.find_representative_periods(d, 4, method=clustering.method_for("hull", kind))
        return weights.fit_weights(found, kind, niters=200)

    return query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plain = (unpivot_wide, split_periods, combine_periods, long_matrix_long, append_period, aux_stats, hull_first_point, nearest_rep, centre_seeds, simplex_projection, orthant_projection, descent_step, projection_error, rp_weight, lag_difference, blended_weights, lp_rows, lp_variables, lp_terms, lp_blended_terms, lp_matrix, lp_numbers)
    found = {f.__name__: f for f in plain} | {f"view_{v}": _view(v) for v in VIEWS}
    found |= {f"pairwise_{m}": _pairwise(m) for m in ("euclidean", "cityblock", "cosine", "chebyshev")}
    found |= {f"find_{m}": _found(m) for m in ("k_means", "k_medoids", "convex_hull", "convex_hull_with_null", "conical_hull")}
    return found | {f"fit_{k}": _fitted(k) for k in ("convex", "conical", "conical_bounded")}


_LIMITED = "SELECT a.id, a.unit_capacity * a.initial_units AS there FROM assets a"

SQL = {
    "unpivot_wide": "SELECT timestep, id, value FROM profiles_raw UNPIVOT (value FOR id IN (click, error, purchase, signup, view))",
    "split_periods": "SELECT period, timestep, id, value FROM dense",
    "combine_periods": "SELECT (period - 1) * 24 + timestep AS timestep, id, value FROM dense",
    "long_matrix_long": "SELECT period AS rep_period, timestep, id, value FROM dense",
    "append_period": "SELECT CASE period WHEN 1 THEN 1 ELSE 2 END::BIGINT AS rep_period, timestep, id, value FROM dense WHERE period IN (1, 30)",
    "aux_stats": "SELECT max(period) AS n_periods, max(timestep) AS period_duration, arg_max(timestep, (period, timestep)) AS last_period_duration, round((29 * 24 + 12) / (29 * 24), 6) AS complete_period_weight FROM dense WHERE period < 30 OR timestep <= 12",
    "hull_first_point": "SELECT arg_max(period, d) AS period FROM (SELECT d.period, sqrt(sum((d.value - m.value) ** 2)) AS d FROM dense d JOIN (SELECT timestep, id, avg(value) AS value FROM dense GROUP BY ALL) m USING (timestep, id) GROUP BY d.period)",
    "nearest_rep": "SELECT period, rep_period::BIGINT AS rep_period FROM nearest",
    "centre_seeds": "SELECT q AS period FROM (SELECT a.q, sum(a.euclidean / t.s) AS v FROM apart a JOIN (SELECT p, sum(euclidean) AS s FROM apart GROUP BY p) t USING (p) GROUP BY a.q) ORDER BY v, q LIMIT 5",
    "simplex_projection": "SELECT l_orderkey, l_linenumber, round(greatest(v - max_by(tau, k) FILTER (v > tau) OVER (PARTITION BY l_orderkey), 0.0), 6) AS weight FROM (SELECT *, (s - 1) / k AS tau FROM (SELECT l_orderkey, l_linenumber, l_discount * 10 AS v, row_number() OVER w AS k, sum(l_discount * 10) OVER (w ROWS UNBOUNDED PRECEDING) AS s FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_discount * 10 DESC, l_linenumber)))",
    "orthant_projection": "SELECT l_orderkey, l_linenumber, round(greatest(l_tax - 0.04::DOUBLE, 0.0::DOUBLE), 6) AS weight FROM lineitem",
    "descent_step": "SELECT period, rep_period::BIGINT AS rep_period, round(greatest(1.0::DOUBLE / 3 - 1e-3 * sum(v * (blend - x)), 0.0), 6) AS weight FROM (SELECT d.period, c.rep_period, d.timestep, d.id, d.value / 100 AS x, r.value / 100 AS v, b.blend FROM dense d CROSS JOIN chosen c JOIN dense r ON r.period = c.period AND r.timestep = d.timestep AND r.id = d.id JOIN (SELECT timestep, id, sum(value / 300) AS blend FROM dense JOIN chosen USING (period) GROUP BY ALL) b ON b.timestep = d.timestep AND b.id = d.id) GROUP BY period, rep_period",
    "projection_error": "SELECT round(sqrt(sum(a.euclidean ** 2)), 4) AS error FROM nearest n JOIN chosen c USING (rep_period) JOIN apart a ON a.p = n.period AND a.q = c.period",
    "rp_weight": "SELECT rep_period::BIGINT AS rep_period, 2.0::DOUBLE * count(*) AS weight FROM nearest GROUP BY rep_period",
    "lag_difference": "SELECT id, period, timestep, round(value - before, 6) AS change FROM (SELECT *, lag(value) OVER (PARTITION BY id, period ORDER BY timestep) AS before FROM dense) WHERE before IS NOT NULL",
    "lp_rows": f"""SELECT block, sense, n, round(rhs, 2) AS rhs FROM (
      SELECT 'balance' AS block, '=' AS sense, count(*) AS n, sum(demand_profile * peak_demand) AS rhs FROM balance_constraint_view
      UNION ALL SELECT 'short', '=', count(*), 0 FROM intra_period_short_term_storage_constraint_view
      UNION ALL SELECT 'charging', '=', count(*), sum(inflow_profile * peak_inflow) FROM intra_period_seasonal_storage_can_charge_constraint_view
      UNION ALL SELECT 'inflow', '=', count(*), sum(inflow_profile * peak_inflow) FROM intra_period_seasonal_storage_cannot_charge_constraint_view
      UNION ALL SELECT 'inter', '=', count(*), 0 FROM seasonal_storage_assets, periods
      UNION ALL SELECT 'cycle', '=', (SELECT count(*) FROM seasonal_storage_assets) + (SELECT count(*) FROM short_term_storage_assets, (SELECT DISTINCT rep_period FROM time_grid)), 0
      UNION ALL SELECT 'initial', '=', count(*), sum(initial_storage_level) FROM initial_storage_constraint_view
      UNION ALL SELECT 'final', '=', count(*), 0 FROM initial_storage_constraint_view
      UNION ALL SELECT 'conversion', '=', count(*), 0 FROM conversion_constraint_view
      UNION ALL SELECT 'capacity', '<', count(*), sum(availability_profile * unit_capacity * initial_units) FROM capacity_constraint_view
      UNION ALL SELECT 'charging_capacity', '<', count(*), sum(there) FROM ({_LIMITED}) JOIN (SELECT id FROM short_term_storage_assets UNION ALL SELECT id FROM seasonal_storage_assets_can_charge) USING (id), time_grid
      UNION ALL SELECT unnest(['ramp+1', 'ramp-1']), '<', n, rhs FROM (SELECT count(*) AS n, sum(ramping_rate * there) AS rhs FROM intra_period_ramping_constraint_view JOIN ({_LIMITED}) USING (id))
      UNION ALL SELECT unnest(['inter_ramp+1', 'inter_ramp-1']), '<', n, rhs FROM (SELECT count(*) AS n, sum(ramping_rate * there) AS rhs FROM inter_period_ramping_constraint_view JOIN ({_LIMITED}) USING (id))) WHERE n > 0""",
    "lp_terms": """SELECT block, name, count(*) AS n, round(sum(a), 3) AS a, round(sum(a * a), 3) AS squares, round(sum(a * (r * 100 + t)), 2) AS moment FROM (
      SELECT 'balance' AS block, 'power_out' AS name, rep_period AS r, timestep AS t, 1.0::DOUBLE AS a FROM balance_constraint_view b JOIN power_out_expression_view p ON p.location = b.location AND p.carrier_out = b.carrier
      UNION ALL SELECT 'balance', 'power_in', rep_period, timestep, -1 FROM balance_constraint_view b JOIN power_in_expression_view p ON p.location = b.location AND p.carrier_in = b.carrier
      UNION ALL SELECT 'balance', 'flow', rep_period, timestep, -1 FROM balance_constraint_view b JOIN transmission_line_expression_view l ON l."from" = b.location AND l.carrier = b.carrier
      UNION ALL SELECT 'balance', 'flow', rep_period, timestep, 1 FROM balance_constraint_view b JOIN transmission_line_expression_view l ON l."to" = b.location AND l.carrier = b.carrier
      UNION ALL SELECT block, 'state_of_charge_intra', rep_period, timestep, 1 FROM charges
      UNION ALL SELECT block, 'state_of_charge_intra', rep_period, timestep - 1, -1 FROM charges WHERE timestep > 1
      UNION ALL SELECT block, 'state_of_charge_intra_0', rep_period, 0, -1 FROM charges WHERE timestep = 1
      UNION ALL SELECT block, 'power_out', rep_period, timestep, 1 / efficiency_out FROM charges
      UNION ALL SELECT block, 'power_in', rep_period, timestep, -efficiency_in FROM charges WHERE block <> 'inflow'
      UNION ALL SELECT block, unnest(['spillage', 'borrow']), rep_period, timestep, unnest([1, -1]) FROM charges WHERE block <> 'short'
      UNION ALL SELECT 'inter', 'state_of_charge_inter', 0, p.id, 1 FROM seasonal_storage_assets, periods p
      UNION ALL SELECT 'inter', 'state_of_charge_inter', 0, p.id - 1, -1 FROM seasonal_storage_assets, periods p WHERE p.id > 1
      UNION ALL SELECT 'inter', 'state_of_charge_inter_0', 0, 0, -1 FROM seasonal_storage_assets, periods p WHERE p.id = 1
      UNION ALL SELECT 'inter', 'state_of_charge_intra', rep_period, 24, -1 FROM seasonal_storage_assets, nearest
      UNION ALL SELECT 'inter', 'state_of_charge_intra_0', rep_period, 0, 1 FROM seasonal_storage_assets, nearest
      UNION ALL SELECT 'cycle', 'state_of_charge_inter', 0, (SELECT max(id) FROM periods), 1 FROM seasonal_storage_assets
      UNION ALL SELECT 'cycle', 'state_of_charge_inter_0', 0, 0, -1 FROM seasonal_storage_assets
      UNION ALL SELECT 'cycle', 'state_of_charge_intra', rep_period, 24, 1 FROM short_term_storage_assets, (SELECT DISTINCT rep_period FROM time_grid)
      UNION ALL SELECT 'cycle', 'state_of_charge_intra_0', rep_period, 0, -1 FROM short_term_storage_assets, (SELECT DISTINCT rep_period FROM time_grid)
      UNION ALL SELECT 'initial', 'state_of_charge_inter_0', 0, 0, 1 FROM initial_storage_constraint_view
      UNION ALL SELECT 'final', 'state_of_charge_inter', 0, (SELECT max(id) FROM periods), 1 FROM initial_storage_constraint_view
      UNION ALL SELECT 'final', 'state_of_charge_intra', rep_period, 24, -1 FROM initial_storage_constraint_view, nearest WHERE period = (SELECT max(id) FROM periods)
      UNION ALL SELECT 'conversion', 'power_in', rep_period, timestep, efficiency_in FROM conversion_constraint_view
      UNION ALL SELECT 'conversion', 'power_out', rep_period, timestep, -1 / efficiency_out FROM conversion_constraint_view
      UNION ALL SELECT 'capacity', 'power_out', rep_period, timestep, 1 FROM capacity_constraint_view
      UNION ALL SELECT 'capacity', 'invested_units', 0, 0, -availability_profile * unit_capacity FROM capacity_constraint_view WHERE investable
      UNION ALL SELECT 'charging_capacity', 'power_in', rep_period, timestep, 1 FROM charges WHERE block <> 'inflow'
      UNION ALL SELECT 'charging_capacity', 'invested_units', 0, 0, -unit_capacity FROM charges JOIN investable_assets USING (id) WHERE block <> 'inflow'
      UNION ALL SELECT 'ramp' || s.k, 'power_out', rep_period, timestep - s.before, s.a FROM intra_period_ramping_constraint_view, (VALUES ('+1', 0, 1), ('+1', 1, -1), ('-1', 0, -1), ('-1', 1, 1)) AS s(k, before, a)
      UNION ALL SELECT 'ramp' || s.k, 'invested_units', 0, 0, -ramping_rate * unit_capacity FROM intra_period_ramping_constraint_view JOIN investable_assets USING (id), (VALUES ('+1'), ('-1')) AS s(k)
      UNION ALL SELECT 'inter_ramp' || s.k, 'invested_units', 0, 0, -ramping_rate * unit_capacity FROM inter_period_ramping_constraint_view JOIN investable_assets USING (id), (VALUES ('+1'), ('-1')) AS s(k)
      UNION ALL SELECT 'inter_ramp' || s.k, 'power_out', n.rep_period, 1, s.a FROM inter_period_ramping_constraint_view v JOIN nearest n ON n.period = v.period, (VALUES ('+1', 1), ('-1', -1)) AS s(k, a)
      UNION ALL SELECT 'inter_ramp' || s.k, 'power_out', n.rep_period, 24, -s.a FROM inter_period_ramping_constraint_view v JOIN nearest n ON n.period = v.period - 1, (VALUES ('+1', 1), ('-1', -1)) AS s(k, a))
      WHERE a <> 0 GROUP BY block, name""",
    "lp_variables": """SELECT name, n, round(lb, 2) AS lb, round(ub, 2) AS ub, round(cost, 2) AS cost FROM (
      SELECT 'invested_units' AS name, count(*) AS n, 0.0::DOUBLE AS lb, NULL::DOUBLE AS ub, sum(cost * unit_capacity) AS cost FROM investable_assets
      UNION ALL SELECT 'power_out', (SELECT count(*) FROM assets, time_grid), 0, NULL, (SELECT sum(variable_cost * w) FROM operations_cost_objective_view, time_grid JOIN (SELECT rep_period, count(*) AS w FROM nearest GROUP BY 1) USING (rep_period))
      UNION ALL SELECT 'power_in', count(*), 0, NULL, 0 FROM power_in_expression_view, time_grid
      UNION ALL SELECT 'state_of_charge_intra_0', count(*), 0, NULL, 0 FROM storage_assets, (SELECT DISTINCT rep_period FROM time_grid)
      UNION ALL SELECT 'state_of_charge_intra', count(*), 0, sum(capacity_storage_energy), 0 FROM intra_period_storage_capacity_constraint_view
      UNION ALL SELECT 'state_of_charge_inter_0', count(*), 0, NULL, 0 FROM seasonal_storage_assets
      UNION ALL SELECT 'state_of_charge_inter', count(*), sum(min_storage_level * capacity_storage_energy), sum(max_storage_level * capacity_storage_energy), 0 FROM inter_period_storage_capacity_constraint_view
      UNION ALL SELECT 'spillage', count(*), 0, NULL, 0 FROM seasonal_storage_assets, time_grid
      UNION ALL SELECT 'borrow', count(*), 0, NULL, (SELECT sum(borrow_cost * w) FROM borrow_cost_objective_view, time_grid JOIN (SELECT rep_period, count(*) AS w FROM nearest GROUP BY 1) USING (rep_period)) FROM seasonal_storage_assets, time_grid
      UNION ALL SELECT 'flow', count(*), -sum(import_capacity), sum(export_capacity), 0 FROM transmission_line_capacity_constraint_view) WHERE n > 0""",
}


def _k_means_sql(k: int, rounds: int) -> str:
    """Seeds, and so many rounds of nearest centres and their means; a centre without periods stays."""
    parts = [
        f"seeds AS MATERIALIZED (SELECT row_number() OVER (ORDER BY v, q) AS rep, q AS period FROM (SELECT a.q, round(sum(a.euclidean ** 2 / t.s), 9) AS v FROM apart a JOIN (SELECT p, sum(euclidean ** 2) AS s FROM apart GROUP BY p) t USING (p) GROUP BY a.q) ORDER BY v, q LIMIT {k})",
        "c0 AS MATERIALIZED (SELECT s.rep, d.timestep, d.id, d.value FROM dense d JOIN seeds s USING (period))",
    ]
    for i in range(rounds):
        parts.append(f"own{i} AS MATERIALIZED (SELECT period, arg_min(rep, struct_pack(d := round(s, 9), r := rep)) AS rep FROM (SELECT d.period, c.rep, sum((d.value - c.value) ** 2) AS s FROM dense d JOIN c{i} c USING (timestep, id) GROUP BY ALL) GROUP BY period)")
        parts.append(f"c{i + 1} AS MATERIALIZED (SELECT o.rep, d.timestep, d.id, avg(d.value) AS value FROM dense d JOIN own{i} o USING (period) GROUP BY ALL UNION ALL SELECT * FROM c{i} WHERE rep NOT IN (SELECT rep FROM own{i}))")
    return f"SELECT * FROM (WITH {', '.join(parts)} SELECT period, rep AS rep_period, 1.0::DOUBLE AS weight FROM own{rounds - 1})"


def _k_medoids_sql(k: int, rounds: int) -> str:
    """Seeds, and so many rounds of nearest medoids and the cheapest of each cluster."""
    parts = [f"m0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY v, q) AS rep, q AS period FROM (SELECT a.q, round(sum(a.euclidean / t.s), 9) AS v FROM apart a JOIN (SELECT p, sum(euclidean) AS s FROM apart GROUP BY p) t USING (p) GROUP BY a.q) ORDER BY v, q LIMIT {k})"]
    for i in range(rounds):
        parts.append(f"own{i} AS MATERIALIZED (SELECT a.p AS period, arg_min(m.rep, struct_pack(d := round(a.euclidean, 9), r := m.rep)) AS rep FROM apart a JOIN m{i} m ON m.period = a.q GROUP BY a.p)")
        parts.append(f"m{i + 1} AS MATERIALIZED (SELECT rep, arg_min(period, struct_pack(s := round(s, 9), p := period)) AS period FROM (SELECT x.rep, x.period, sum(a.euclidean) AS s FROM own{i} x JOIN own{i} y USING (rep) JOIN apart a ON a.p = x.period AND a.q = y.period GROUP BY ALL) GROUP BY rep)")
    return f"SELECT * FROM (WITH {', '.join(parts)} SELECT period, rep AS rep_period, 1.0::DOUBLE AS weight FROM own{rounds - 1})"


def _blended_terms_sql() -> str:
    """lp_terms, with each period's two weights where it has one representative there."""
    sql = SQL["lp_terms"]
    for old, new in (
        ("rep_period, 24, -1 FROM seasonal_storage_assets, nearest", "rep_period, 24, -weight FROM seasonal_storage_assets, blended"),
        ("rep_period, 0, 1 FROM seasonal_storage_assets, nearest", "rep_period, 0, weight FROM seasonal_storage_assets, blended"),
        ("rep_period, 24, -1 FROM initial_storage_constraint_view, nearest", "rep_period, 24, -weight FROM initial_storage_constraint_view, blended"),
        ("n.rep_period, 1, s.a FROM inter_period_ramping_constraint_view v JOIN nearest n", "n.rep_period, 1, s.a * n.weight FROM inter_period_ramping_constraint_view v JOIN blended n"),
        ("n.rep_period, 24, -s.a FROM inter_period_ramping_constraint_view v JOIN nearest n", "n.rep_period, 24, -s.a * n.weight FROM inter_period_ramping_constraint_view v JOIN blended n"),
    ):
        assert old in sql
        sql = sql.replace(old, new)
    return sql


SQL |= {
    "blended_weights": "SELECT period, rep_period, weight FROM blended",
    "lp_blended_terms": _blended_terms_sql(),
    "lp_matrix": "SELECT block, CAST(sum(n) AS BIGINT) AS n, round(sum(a), 2) AS a, round(sum(squares), 2) AS squares FROM (" + SQL["lp_terms"].replace("round(sum(a), 3)", "sum(a)").replace("round(sum(a * a), 3)", "sum(a * a)") + ") GROUP BY block",
    "lp_numbers": f"SELECT 'rows' AS kind, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n) AS BIGINT) AS different, CAST(sum(n) AS BIGINT) AS last FROM ({SQL['lp_rows']}) UNION ALL SELECT 'columns', CAST(sum(n) AS BIGINT), CAST(sum(n) AS BIGINT), CAST(sum(n) AS BIGINT) FROM ({SQL['lp_variables']})",
    "find_k_means": _k_means_sql(4, 14),
    "find_k_medoids": _k_medoids_sql(4, 10),
}


def oracle_sql() -> dict[str, str]:
    found = {f"view_{v}": _with(f"SELECT * FROM {v}") for v in VIEWS}
    found |= {f"pairwise_{m}": _with(f"SELECT p, q, abs(round({m}, 5)) AS d FROM apart") for m in ("euclidean", "cityblock", "cosine", "chebyshev")}
    return found | {k: _with(q) for k, q in SQL.items()}
