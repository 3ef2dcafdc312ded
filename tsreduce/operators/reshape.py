"""Periods and timesteps, long and wide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def period_of(t: Column, length: int) -> Column:
    return F.floor((t - 1) / F.lit(length)).cast("long") + 1


def step_of(t: Column, length: int) -> Column:
    return ((t - 1) % length + 1).cast("long")


def unpivot_wide(wide: DataFrame) -> DataFrame:
    """(timestep, id, value) of a wide table; empty cells give no row."""
    series = [c for c in wide.columns if c != "timestep"]
    if not series:
        return wide.select("timestep", F.lit(None).cast("string").alias("id"), F.lit(None).cast("double").alias("value")).where(F.lit(False))
    return wide.unpivot(["timestep"], series, "id", "value").where("value IS NOT NULL")


def combine_periods(df: DataFrame) -> DataFrame:
    """One running timestep instead of period and timestep; without a period, df itself."""
    if "timestep" not in df.columns:
        raise ValueError("a column timestep is needed")
    if "period" not in df.columns:
        return df
    longest = F.broadcast(df.agg(F.max("timestep").alias("__longest")))  # one row
    joined = df.crossJoin(longest).withColumn("timestep", ((F.col("period") - 1) * F.col("__longest") + F.col("timestep")).cast("long"))
    return joined.select(*(c for c in df.columns if c != "period"))


def split_into_periods(df: DataFrame, period_duration: int | None = None) -> DataFrame:
    """period and timestep first; without a duration, all is period 1."""
    df = combine_periods(df)
    rest = [c for c in df.columns if c != "timestep"]
    if period_duration is None:
        return df.select(F.lit(1).cast("long").alias("period"), "timestep", *rest)
    t = F.col("timestep")
    return df.select(period_of(t, period_duration).alias("period"), step_of(t, period_duration).alias("timestep"), *rest)


def key_columns(df: DataFrame) -> list[str]:
    """What names a row of the clustering matrix: all columns but period and value."""
    if not {"timestep", "value"} <= set(df.columns):
        raise ValueError("the columns timestep and value are needed")
    if "period" not in df.columns:
        raise ValueError("a column period is needed")
    return [c for c in df.columns if c not in ("period", "value")]


def to_features(df: DataFrame, keys: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """((period, features), (place, *keys)): a vector for each period, over the keys that every period has, in their order."""
    keys = keys or key_columns(df)
    n = df.select("period").distinct().count()
    whole = df.where("value IS NOT NULL").groupBy(*keys).agg(F.count_distinct("period").alias("__n")).where(F.col("__n") == n).drop("__n")
    vectors = df.where("value IS NOT NULL").join(whole, keys).groupBy("period").agg(F.array_sort(F.collect_list(F.struct(*keys, "value"))).alias("cells"))
    features = vectors.select("period", F.transform("cells", lambda c: c["value"]).alias("features"))
    first = vectors.orderBy("period").limit(1)
    places = first.select(F.posexplode("cells").alias("place", "cell")).select("place", *(F.col(f"cell.{k}").alias(k) for k in keys))
    return features, places


def to_long(features: DataFrame, places: DataFrame, period: str = "rep_period") -> DataFrame:
    """(rep_period, *keys, value) of (rep_period, features)."""
    cells = features.select(period, F.posexplode("features").alias("place", "value"))
    return cells.join(places, "place").select(period, *(c for c in places.columns if c != "place"), "value").where("value IS NOT NULL")


def differences(df: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """(by, timestep, change): each value less that of the timestep before, where there is one."""
    w = Window.partitionBy(*by).orderBy("timestep")
    return df.select(*by, "timestep", (F.col(value) - F.lag(value).over(w)).alias("change")).where("change IS NOT NULL")


def append_period(rps: DataFrame, source: DataFrame, period: int, rp: int) -> DataFrame:
    """rps with a period of source as a further representative."""
    added = source.where(F.col("period") == period).withColumn("rep_period", F.lit(rp).cast("long"))
    return rps.unionByName(added.select(*rps.columns))
