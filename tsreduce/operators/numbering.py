"""Gapless numbers for the rows of a frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tsreduce.sources.scratch import Scratch

#: Ranges that rows are dealt to by their hash; one row for each is all that a single task sees.
RANGES = 4096


def numbered(df: DataFrame, by: list[str], name: str = "index", ranges: int = RANGES, scratch: Scratch | None = None) -> DataFrame:
    """df with a number from 0 on for each row, without gaps. The columns `by` name a row, and the numbers depend on them alone.

    Rows are dealt to ranges by their hash; a row's number is that of its range's first row and its place in the range.
    With a scratch, the places are a table there, so that df is computed once, now; else for each use, and twice.
    """
    own = F.pmod(F.xxhash64(*by), F.lit(ranges)).alias("__range")
    rows = df.select("*", own)
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*by)) - 1
    placed = rows.withColumn("__place", place)
    if scratch is not None:
        rows = placed = scratch.store(placed)
    counts = rows.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    first = counts.select("__range", F.coalesce(before, F.lit(0)).alias("__first"))
    return placed.join(F.broadcast(first), "__range").withColumn(name, (F.col("__first") + F.col("__place")).cast("long")).drop("__range", "__place", "__first")
