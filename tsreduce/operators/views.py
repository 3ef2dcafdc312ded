"""The named views (V1-V38) as lazy frames of a catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsreduce.operators.reshape import period_of, step_of, unpivot_wide
from tsreduce.sources.scratch import Scratch
from tsreduce.sources.tables import LEVELS, RP_PROFILES


def _kept(view) -> property:
    """A property that a catalog which holds the view takes from there."""
    name = view.__name__
    return property(lambda self: self._held[name] if name in self._held else view(self), doc=view.__doc__)


#: Views that others are built of, each after those that it needs.
KEPT = ("profiles", "periods", "time_grid", "conversion_assets", "generation_assets", "storage_assets", "seasonal_storage_assets")


#: Assets of a part, all of whose rows by time one task makes.
PART = 2048


class Catalog:
    """Views over base tables. period_length cuts the profiles; rp_profiles are the representatives' profiles.

    Nothing is replaced: other lengths or representatives are other catalogs over the same tables.
    """

    def __init__(self, tables: dict[str, DataFrame], period_length: int = 8760, rp_profiles: DataFrame | None = None) -> None:
        self.tables, self.period_length, self._rp = tables, period_length, rp_profiles
        self.spark, self._held, self.parts = next(iter(tables.values())).sparkSession, {}, 1

    def with_(self, period_length: int | None = None, rp_profiles: DataFrame | None = None) -> Catalog:
        return Catalog(self.tables, period_length or self.period_length, rp_profiles if rp_profiles is not None else self._rp)

    def spread(self, scratch: Scratch) -> Catalog:
        """This catalog with its assets in parts of about PART, held by scratch: what crosses them with times then makes as much in a task however many there are."""
        c = Catalog(self.tables, self.period_length, self._rp)
        c._held, assets = self._held, self.tables["assets"]
        c.parts = -(-assets.count() // PART) or 1
        if c.parts > 1:
            c.tables = self.tables | {"assets": scratch.keep(assets.repartition(c.parts, "id"))}
        return c

    def kept(self, scratch: Scratch) -> Catalog:
        """This catalog, with what many views are made of held by scratch, so that tables are read once."""
        c = Catalog(self.tables, self.period_length, scratch.keep(self._rp) if self._rp is not None else None)
        c._held |= {k: v for k, v in self._held.items() if k not in KEPT}
        c.parts = self.parts
        for name in KEPT:
            view = self._held[name] if name in self._held else c.view(name)
            if c.parts > 1 and name.endswith("_assets"):
                view = view.repartition(c.parts, "id")
            c._held[name] = view if view is self._held.get(name) else scratch.keep(view)
        return c

    def holding(self, **views: DataFrame) -> Catalog:
        """This catalog with frames that stand for views."""
        c = Catalog(self.tables, self.period_length, self._rp)
        c._held = self._held | views
        return c

    def view(self, name: str) -> DataFrame:
        return getattr(self, name)

    def index_set(self, name: str) -> list:
        """The ids of a dimension, in order."""
        df = self.tables.get(name)
        return [r[0] for r in (self.view(name) if df is None else df).select("id").distinct().orderBy("id").collect()]

    def scalar(self, name: str) -> float:
        return self.tables["scalars"].where(F.col("scalar") == name).first()["value"]

    # dimensions

    @property
    def locations(self) -> DataFrame:
        return self.tables["assets"].select(F.col("location").alias("id")).distinct()

    @property
    def carriers(self) -> DataFrame:
        out = self.tables["technologies"].select(F.col("carrier_out").alias("id"))
        return out.unionByName(self.tables["technologies_conversion"].select(F.col("carrier_in").alias("id"))).distinct()

    @property
    def all_locations_and_carriers(self) -> DataFrame:
        return self.locations.select(F.col("id").alias("location")).crossJoin(self.carriers.select(F.col("id").alias("carrier")))

    # assets

    @property
    def investable_assets(self) -> DataFrame:
        return self.tables["assets"].join(self.tables["investments"], "id")

    @property
    def non_investable_assets(self) -> DataFrame:
        return self.tables["assets"].join(self.tables["investments"], "id", "left_anti")

    def _of_type(self, kind: str) -> DataFrame:
        own = self.tables["technologies"].where(F.col("type") == kind).join(self.tables[f"technologies_{kind}"], "id")
        return self.tables["assets"].join(own.withColumnRenamed("id", "technology"), "technology")

    @_kept
    def conversion_assets(self) -> DataFrame:
        return self._of_type("conversion")

    @_kept
    def generation_assets(self) -> DataFrame:
        return self._of_type("generation")

    @_kept
    def storage_assets(self) -> DataFrame:
        return self._of_type("storage").join(self.tables["assets_storage"], "id")

    @_kept
    def seasonal_storage_assets(self) -> DataFrame:
        return self.storage_assets.where("is_seasonal").join(self.tables["assets_storage_seasonal"], "id")

    @property
    def seasonal_storage_assets_can_charge(self) -> DataFrame:
        return self.seasonal_storage_assets.where("can_charge")

    @property
    def seasonal_storage_assets_cannot_charge(self) -> DataFrame:
        return self.seasonal_storage_assets.where("NOT can_charge")

    @property
    def short_term_storage_assets(self) -> DataFrame:
        return self.storage_assets.where("NOT is_seasonal")

    # profiles

    def _split(self, name: str) -> DataFrame:
        t = F.col("timestep")
        return unpivot_wide(self.tables[name]).select(period_of(t, self.period_length).alias("period"), step_of(t, self.period_length).alias("timestep"), "id", "value")

    @_kept
    def profiles(self) -> DataFrame:
        named = self.tables["assets_profiles"].select(F.col("profile").alias("id"), "asset", "profile_type")
        return self._split("profiles_raw").join(named, "id").select("period", "timestep", F.col("asset").alias("id"), "profile_type", "value")

    @property
    def timesteps(self) -> DataFrame:
        return self.profiles.select(F.col("timestep").alias("id")).distinct()

    @_kept
    def periods(self) -> DataFrame:
        return self.profiles.select(F.col("period").alias("id")).distinct()

    @property
    def profiles_reservoir_levels(self) -> DataFrame:
        if "profiles_reservoir_levels_raw" not in self.tables:
            return self.spark.createDataFrame([], LEVELS)
        return self._split("profiles_reservoir_levels_raw")

    @property
    def avg_profiles(self) -> DataFrame:
        levels = self.profiles_reservoir_levels.withColumnRenamed("id", "profile_name")
        return self.tables["assets_storage_seasonal_reservoir_levels"].join(levels, "profile_name").groupBy("asset", "profile_type", "period").agg(F.avg("value").alias("avg_value"))

    @property
    def pivoted_profiles(self) -> DataFrame:
        kinds = ["min_storage_level", "max_storage_level"]
        return self.avg_profiles.groupBy(F.col("asset").alias("id"), "period").pivot("profile_type", kinds).agg(F.max("avg_value"))

    @property
    def all_asset_periods(self) -> DataFrame:
        return self.seasonal_storage_assets.select("id", "capacity_storage_energy").crossJoin(self.profiles_reservoir_levels.select("period").distinct())

    @property
    def inter_period_storage_capacity_constraint_view(self) -> DataFrame:
        levels = self.all_asset_periods.join(self.pivoted_profiles, ["id", "period"], "left")
        return levels.select("id", "period", F.coalesce("min_storage_level", F.lit(0.0)).alias("min_storage_level"), F.coalesce("max_storage_level", F.lit(1.0)).alias("max_storage_level"), "capacity_storage_energy")

    # terms of the objective and of the balance

    @property
    def investment_cost_objective_view(self) -> DataFrame:
        return self.investable_assets.select("id", "unit_capacity", "cost")

    @property
    def operations_cost_objective_view(self) -> DataFrame:
        return self.generation_assets.select("id", "variable_cost")

    @property
    def spillage_cost_objective_view(self) -> DataFrame:
        return self.seasonal_storage_assets.select("id", "spillage_cost")

    @property
    def borrow_cost_objective_view(self) -> DataFrame:
        return self.seasonal_storage_assets.select("id", "borrow_cost")

    @property
    def power_out_expression_view(self) -> DataFrame:
        out = self.tables["technologies"].select(F.col("id").alias("technology"), "carrier_out")
        return self.tables["assets"].join(out, "technology").select("id", "location", "carrier_out")

    @property
    def power_in_expression_view(self) -> DataFrame:
        charged = [v.select("id", "location", F.col("carrier_out").alias("carrier_in")) for v in (self.seasonal_storage_assets_can_charge, self.short_term_storage_assets)]
        return charged[0].unionByName(charged[1]).unionByName(self.conversion_assets.select("id", "location", "carrier_in"))

    @property
    def transmission_line_expression_view(self) -> DataFrame:
        return self.tables["transmission_lines"].select("id", "from", "to", "carrier")

    @property
    def initial_storage_constraint_view(self) -> DataFrame:
        return self.seasonal_storage_assets.select("id", "initial_storage_level")

    # over representative periods

    @property
    def rp_profiles(self) -> DataFrame:
        return self._rp if self._rp is not None else self.spark.createDataFrame([], RP_PROFILES)

    @_kept
    def time_grid(self) -> DataFrame:
        return self.rp_profiles.select("rep_period", "timestep").distinct()

    def _with_profile(self, rows: DataFrame, kind: str, name: str, default: float) -> DataFrame:
        own = self.rp_profiles.where(F.col("profile_type") == kind).select("rep_period", "timestep", "id", F.col("value").alias("__value"))
        return rows.join(own, ["rep_period", "timestep", "id"], "left").withColumn(name, F.coalesce("__value", F.lit(default))).drop("__value")

    @property
    def balance_constraint_view(self) -> DataFrame:
        places = self.all_locations_and_carriers.join(self.tables["demand"], ["location", "carrier"], "left").withColumn("peak_demand", F.coalesce("peak_demand", F.lit(0.0)))
        return self._with_profile(self.time_grid.crossJoin(places), "demand", "demand_profile", 1.0).select("location", "carrier", "rep_period", "timestep", "demand_profile", "peak_demand")

    @property
    def intra_period_short_term_storage_constraint_view(self) -> DataFrame:
        return self.time_grid.crossJoin(self.short_term_storage_assets).select("id", "rep_period", "timestep", "efficiency_in", "efficiency_out")

    @property
    def intra_period_seasonal_storage_can_charge_constraint_view(self) -> DataFrame:
        rows = self.time_grid.crossJoin(self.seasonal_storage_assets_can_charge)
        return self._with_profile(rows, "inflows", "inflow_profile", 0.0).select("id", "rep_period", "timestep", "efficiency_in", "efficiency_out", "inflow_profile", "peak_inflow")

    @property
    def intra_period_seasonal_storage_cannot_charge_constraint_view(self) -> DataFrame:
        rows = self.time_grid.crossJoin(self.seasonal_storage_assets_cannot_charge)
        return self._with_profile(rows, "inflows", "inflow_profile", 0.0).select("id", "rep_period", "timestep", "efficiency_out", "inflow_profile", "peak_inflow")

    @property
    def conversion_constraint_view(self) -> DataFrame:
        return self.time_grid.crossJoin(self.conversion_assets).select("id", "rep_period", "timestep", "efficiency_in", "efficiency_out")

    @property
    def capacity_constraint_view(self) -> DataFrame:
        chosen = self.tables["investments"].select(F.col("id").alias("i")).distinct()
        assets = self.tables["assets"].join(chosen, F.col("id") == F.col("i"), "left").withColumn("investable", F.col("i").isNotNull())
        return self._with_profile(self.time_grid.crossJoin(assets), "availability", "availability_profile", 1.0).select("id", "rep_period", "timestep", "investable", "availability_profile", "unit_capacity", "initial_units")

    @property
    def intra_period_storage_capacity_constraint_view(self) -> DataFrame:
        return self.time_grid.crossJoin(self.storage_assets).select("id", "rep_period", "timestep", "capacity_storage_energy")

    @property
    def intra_period_ramping_constraint_view(self) -> DataFrame:
        return self.time_grid.where("timestep > 1").crossJoin(self.generation_assets.where("ramping_rate < 1.0")).select("id", "rep_period", "timestep", "ramping_rate")

    @property
    def inter_period_ramping_constraint_view(self) -> DataFrame:
        slow = self.generation_assets.where("ramping_rate < 1.0").select("id", "ramping_rate")
        return slow.crossJoin(self.periods.where("id > 1").select(F.col("id").alias("period"))).select("id", "period", "ramping_rate")

    @property
    def transmission_line_capacity_constraint_view(self) -> DataFrame:
        return self.time_grid.crossJoin(self.tables["transmission_lines"]).select("id", "rep_period", "timestep", "export_capacity", "import_capacity")


#: All of them, in the order of the survey.
VIEWS = tuple(k for k, v in vars(Catalog).items() if isinstance(v, property) and k != "rp_profiles")
