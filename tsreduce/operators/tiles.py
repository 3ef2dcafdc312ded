"""Feature vectors of periods in tiles (P22, C2, C3): blocks of places by parts of periods, each a bounded matrix.

A row of cells is (block, part, period, x): the values of one period at a block's places. A task works on one tile at a
time, and what tiles give is summed: distances over blocks, sums of periods over parts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsreduce.functions import metrics
from tsreduce.operators.numbering import numbered
from tsreduce.operators.reshape import key_columns
from tsreduce.sources.scratch import Scratch

#: Places of a block, and periods of a part (on average).
WIDTH, HEIGHT = 1024, 1024
#: Parts that are summed by one task.
FOLD = 256
#: Numbers of a tile whose rows are compared with another's.
PAIRED = 1 << 22


@dataclass(frozen=True)
class Tiles:
    """cells (block, part, period, x), places (place, *keys), and how many there are."""

    cells: DataFrame
    places: DataFrame
    width: int
    parts: int
    n_periods: int
    n_places: int

    @property
    def blocks(self) -> int:
        return max(1, -(-self.n_places // self.width))

    @property
    def periods(self) -> DataFrame:
        return self.cells.where("block = 0").select("period")


def _part(period, parts: int) -> Column:
    return F.pmod(F.xxhash64(period), F.lit(parts))


def tile(df: DataFrame, keys: list[str] | None = None, *, scratch: Scratch, width: int = WIDTH, height: int = HEIGHT) -> Tiles:
    """The tiles of (period, *keys, value), over the keys that every period has; a key occurs once in a period. They are kept by scratch."""
    keys = keys or key_columns(df)
    n = df.select("period").distinct().count()
    known = df.where("value IS NOT NULL")
    whole = known.groupBy(*keys).agg(F.count_distinct("period").alias("__n")).where(F.col("__n") == n).drop("__n")
    places = scratch.store(numbered(whole, keys, "place"))
    n_places = places.count()
    parts = max(1, -(-n // height))
    block, at = F.floor(F.col("place") / width).cast("long"), F.col("place") % width
    joined = known.join(places, keys).select(block.alias("block"), _part(F.col("period").cast("long"), parts).alias("part"), F.col("period").cast("long").alias("period"), at.alias("at"), F.col("value").cast("double").alias("value"))
    n_tiles = parts * max(1, -(-n_places // width))
    # a few tiles for each partition, and no more partitions than tiles
    dealt = max(min(n_tiles, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), n_tiles // 16)
    rows = joined.repartition(dealt, "block", "part").groupBy("block", "part", "period").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("c"))
    cells = scratch.keep(rows.select("block", "part", "period", F.col("c")["value"].alias("x")))
    return Tiles(cells, places, width, parts, n, n_places)


def to_long(rows: DataFrame, t: Tiles, name: str = "rep_period") -> DataFrame:
    """(name, *keys, value) of rows (name, block, x)."""
    cells = rows.select(name, "block", F.posexplode("x").alias("at", "value")).withColumn("place", F.col("block") * t.width + F.col("at"))
    return cells.join(t.places, "place").select(name, *(c for c in t.places.columns if c != "place"), "value")


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A list column whose lists are of one length, as rows."""
    column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks else pa.array([], column.type)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def lists(x: np.ndarray) -> pa.Array:
    """Rows as a list column."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).ravel()))


def _numbers(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy()


def _nothing(schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in schema.split(", "))]).empty_table()


def zero(t: Tiles) -> DataFrame:
    """The zero vector as a representative."""
    size = F.least(F.lit(t.width), F.lit(t.n_places) - F.col("id") * t.width).cast("int")
    return t.cells.sparkSession.range(t.blocks).select(F.lit(1).cast("long").alias("rep_period"), F.col("id").alias("block"), F.array_repeat(F.lit(0.0), size).alias("x"))


def _everywhere(df: DataFrame, t: Tiles, over: str) -> DataFrame:
    """A row for each block, or for each part."""
    return df.withColumn(over, F.explode(F.sequence(F.lit(0).cast("long"), F.lit((t.blocks if over == "block" else t.parts) - 1).cast("long"))))


def _of_reps(reps: DataFrame, t: Tiles) -> DataFrame:
    return _everywhere(reps.select("block", F.lit(True).alias("rep"), F.col("rep_period").cast("long").alias("id"), "x"), t, "part").select("block", "part", "rep", "id", "x")


def _of_periods(rows: DataFrame, t: Tiles, x: Column) -> DataFrame:
    made = rows.select(_part(F.col("period"), t.parts).alias("part"), F.lit(False).alias("rep"), F.col("period").alias("id"), x.alias("x"))
    return _everywhere(made, t, "block").select("block", "part", "rep", "id", "x")


def _work(t: Tiles, right: DataFrame, work: Callable, schema: str) -> DataFrame:
    """work(block, part, periods, their rows, representatives' rows, ids and vectors of the periods that right has) for each tile, periods and representatives in order."""

    def met(left: pa.Table, other: pa.Table) -> pa.Table:
        if not left.num_rows or not other.num_rows:
            return empty
        period, order = np.unique(_numbers(left, "period"), return_index=True)
        x = matrix(left.column("x"))[order]
        is_rep = other.column("rep").to_numpy()
        of_reps, of_periods = other.filter(pa.array(is_rep)), other.filter(pa.array(~is_rep))
        reps = matrix(of_reps.column("x"))[np.argsort(_numbers(of_reps, "id"), kind="stable")]
        by = np.argsort(_numbers(of_periods, "id"), kind="stable")
        return pa.table(work(left.column("block")[0].as_py(), left.column("part")[0].as_py(), period, x, reps, _numbers(of_periods, "id")[by], matrix(of_periods.column("x"))[by]))

    empty = _nothing(schema)
    right = right.select(*(F.col(c).alias(c) for c in right.columns))  # columns of its own
    return t.cells.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(met, schema)


def sums(t: Tiles, weights: DataFrame) -> DataFrame:
    """(rep_period, block, n, x): for each representative, the sum of periods times their weights (period, rep_period, weight), and n, the sum of these weights."""

    def work(block, part, period, x, _, ids, given):
        given = given.reshape(-1, 2)
        groups, of = np.unique(given[:, 0], return_inverse=True)
        w = np.zeros((len(groups), len(period)))
        np.add.at(w, (of, np.searchsorted(period, ids)), given[:, 1])
        return {"rep_period": groups.astype(np.int64), "block": np.full(len(groups), block), "part": np.full(len(groups), part), "n": w.sum(1), "x": lists(w @ x)}

    right = _of_periods(weights, t, F.array(F.col("rep_period").cast("double"), F.col("weight").cast("double")))
    schema = "rep_period long, block long, part long, n double, x array<double>"
    out, parts = _work(t, right, work, schema), t.parts

    def fold(rows: pa.Table) -> pa.Table:
        order = np.argsort(_numbers(rows, "part"), kind="stable")
        total = matrix(rows.column("x"))[order].sum(0, keepdims=True)
        return pa.table({"rep_period": rows.column("rep_period")[:1], "block": rows.column("block")[:1], "part": pa.array([_numbers(rows, "part")[0] // FOLD]), "n": pa.array([_numbers(rows, "n")[order].sum()]), "x": lists(total)})

    while parts > 1:
        out, parts = out.groupBy("rep_period", "block", F.floor(F.col("part") / FOLD)).applyInArrow(fold, schema), -(-parts // FOLD)
    return out.drop("part")


#: How many numbers of a block make a measure, if not one.
PARTS = {"cosine": 3}


def _measured(kind: str, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """What one block adds to the measure of each row of x with each row of y: (rows, parts, rows of y)."""
    if kind == "dot":
        return (x @ y.T)[:, None]
    if kind == "square":
        return np.repeat((x * x).sum(1)[:, None, None], len(y), axis=2)
    if kind == "cosine":
        ones = np.ones((len(x), len(y)))
        return np.stack([x @ y.T, (x * x).sum(1)[:, None] * ones, (y * y).sum(1)[None, :] * ones], axis=1)
    out = np.empty((len(x), 1, len(y)))
    for k, v in enumerate(y):
        d = x - v
        out[:, 0, k] = (d * d).sum(1) if kind == "euclidean" else np.abs(d).sum(1) if kind == "cityblock" else np.abs(d).max(1, initial=0.0)
    return out


def _finished(kind: str, parts: np.ndarray) -> np.ndarray:
    """The measure of what blocks have added up to: (rows, parts, rows of y)."""
    if kind == "euclidean":
        return np.sqrt(parts[:, 0])
    if kind == "cosine":
        with np.errstate(invalid="ignore", divide="ignore"):
            return 1 - parts[:, 0] / np.sqrt(parts[:, 1] * parts[:, 2])
    return parts[:, 0]


def _all_finished(kinds: list[str], x: np.ndarray) -> np.ndarray:
    out, at = [], 0
    for k in kinds:
        n = PARTS.get(k, 1)
        out.append(_finished(k, x[:, at : at + n]))
        at += n
    return np.concatenate(out, axis=1)


def _over_blocks(t: Tiles, right: DataFrame, kinds: list[str], parts_of: Callable) -> DataFrame:
    """(period, d): what parts_of (as work of _work, but for periods and their parts, an array (periods, parts, numbers)) finds, summed over blocks or the largest, and finished; d holds the kinds one after the other."""
    alone, schema = t.blocks == 1, "period long, block long, d array<double>"

    def work(block, *rest):
        period, x = parts_of(block, *rest)
        return {"period": period, "block": np.full(len(period), block), "d": lists(_all_finished(kinds, x) if alone else x.reshape(len(x), x.shape[1] * x.shape[2]))}

    rows = _work(t, right, work, schema)
    if alone:
        return rows.select("period", "d")
    n_parts = sum(PARTS.get(k, 1) for k in kinds)
    top = np.repeat([k == "chebyshev" for k in kinds], [PARTS.get(k, 1) for k in kinds])

    def finish(it):
        for b in it:
            if b.num_rows:
                each = np.stack([np.array(v, float) for v in b.column("d").to_pylist()])
                each = each.reshape(*each.shape[:2], n_parts, -1)
                x = np.where(top[None, :, None], each.max(1), each.sum(1))
                yield pa.RecordBatch.from_arrays([b.column("period"), lists(_all_finished(kinds, x))], ["period", "d"])

    # in order of blocks, so that sums are the same each time
    rows = rows.groupBy("period").agg(F.transform(F.array_sort(F.collect_list(F.struct("block", "d"))), lambda c: c["d"]).alias("d"))
    return rows.mapInArrow(finish, "period long, d array<double>")


def measures(t: Tiles, reps: DataFrame, *kinds: str) -> DataFrame:
    """(period, d): the distances of each period to the representatives (rep_period, block, x), in their order; "dot" is the product, "square" that of a period with itself. Several kinds follow one another."""
    kinds = [k if k in ("dot", "square") else metrics.parse(k) for k in kinds]

    def parts_of(_, __, period, x, y, *___):
        return period, np.concatenate([_measured(k, x, y) for k in kinds], axis=1)

    return _over_blocks(t, _of_reps(reps, t), kinds, parts_of)


def residuals(t: Tiles, reps: DataFrame, weights: DataFrame, metric: str = "euclidean") -> DataFrame:
    """(period, d): for weights (period, w), the distance of each period to what its weights make of the representatives; several sets of weights may follow one another in w."""
    metric = metrics.parse(metric)

    def parts_of(_, __, period, x, y, ids, w):
        sets = w.reshape(len(w), -1, len(y)) if len(ids) else np.zeros((0, 1, len(y)))
        x = x[np.searchsorted(period, ids)]
        out = np.empty((len(ids), PARTS.get(metric, 1), sets.shape[1]))
        for s in range(sets.shape[1]):
            blend = sets[:, s] @ y
            if metric == "cosine":
                out[:, :, s] = np.stack([(x * blend).sum(1), (x * x).sum(1), (blend * blend).sum(1)], axis=1)
            else:
                d = x - blend
                out[:, 0, s] = (d * d).sum(1) if metric == "euclidean" else np.abs(d).sum(1) if metric == "cityblock" else np.abs(d).max(1, initial=0.0)
        return ids, out

    return _over_blocks(t, _of_reps(reps, t).unionByName(_of_periods(weights, t, F.col("w"))), [metric], parts_of)


def gram(t: Tiles, reps: DataFrame) -> np.ndarray:
    """The products of the representatives with one another: as many numbers as their number squared."""
    own = replace(t, cells=reps.select("block", F.lit(0).cast("long").alias("part"), F.col("rep_period").cast("long").alias("period"), "x"), parts=1)
    rows = measures(own, reps, "dot").orderBy("period").collect()
    return np.array([r["d"] for r in rows], float)


def _pair_work(t: Tiles, info: DataFrame | None, work: Callable, schema: str, metric: str, height: int) -> DataFrame:
    """work(periods, others, distances, info of both, same part) on all pairs of parts of height periods or fewer."""
    metric = metrics.parse(metric)
    parts = max(1, -(-t.n_periods // max(1, min(height, PAIRED // max(1, t.n_places)))))
    rows = t.cells.select("period", "block", "x")
    if info is not None:
        rows = rows.unionByName(info.select("period", F.lit(-1).cast("long").alias("block"), "x"))
    rows = rows.withColumn("own", _part(F.col("period"), parts))
    first = rows.withColumn("i", F.col("own")).withColumn("j", F.explode(F.sequence("own", F.lit(parts - 1).cast("long"))))
    second = rows.withColumn("j", F.col("own")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), "own")))

    def vectors(rows: pa.Table):
        order = np.lexsort((_numbers(rows, "block"), _numbers(rows, "period")))
        rows = rows.take(pa.array(order))
        block, period = _numbers(rows, "block"), np.unique(_numbers(rows, "period"))
        x = [matrix(rows.filter(pa.array(block == k)).column("x")) for k in np.unique(block)]
        told = x.pop(0) if block[0] < 0 else None
        return period, np.concatenate(x, axis=1), told

    def met(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return empty
        (p, x, a), (q, y, b) = vectors(left), vectors(right)
        return pa.table(work(p, q, metrics.pairwise(metric, x, y), a, b, left.column("i")[0] == left.column("j")[0]))

    empty = _nothing(schema)
    columns = ["i", "j", "period", "block", "x"]
    second = second.select(*(F.col(c).alias(c) for c in columns))  # columns of its own
    return first.select(columns).groupBy("i", "j").cogroup(second.groupBy("i", "j")).applyInArrow(met, schema)


def pairwise(t: Tiles, metric: str, *, height: int = HEIGHT) -> DataFrame:
    """(p, q, d): the distances of all pairs of periods (C3), a pair of parts at a time. A part has one period at least, whose whole vector a task holds."""

    def work(p, q, d, _, __, same):
        pairs = [(np.repeat(p, len(q)), np.tile(q, len(p)), d.ravel())]
        if not same:
            pairs.append((np.repeat(q, len(p)), np.tile(p, len(q)), d.T.ravel()))
        return dict(zip(("p", "q", "d"), (np.concatenate(c) for c in zip(*pairs))))

    return _pair_work(t, None, work, "p long, q long, d double", metric, height)


def pair_sums(t: Tiles, metric: str, weights: DataFrame | None = None, *, height: int = HEIGHT) -> DataFrame:
    """(period, s): the sum of a period's distances to all others of its group, times their weights, without a row for any pair.

    weights (period, rep_period, weight) names groups; without them all are one and weigh 1.
    """

    def work(p, q, d, a, b, same):
        sides = [(p, d, a, b)] if same else [(p, d, a, b), (q, d.T, b, a)]
        out = []
        for own, dist, mine, theirs in sides:
            out.append((own, dist.sum(1) if mine is None else np.where(mine[:, :1] == theirs[None, :, 0], dist, 0.0) @ theirs[:, 1]))
        return dict(zip(("period", "s"), (np.concatenate(c) for c in zip(*out))))

    info = None if weights is None else weights.select("period", F.array(F.col("rep_period").cast("double"), F.col("weight").cast("double")).alias("x"))
    made = _pair_work(t, info, work, "period long, s double", metric, height)
    # in order of size, so that sums are the same each time
    return made.groupBy("period").agg(F.aggregate(F.array_sort(F.collect_list("s")), F.lit(0.0), lambda x, y: x + y).alias("s"))
