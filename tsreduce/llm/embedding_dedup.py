"""Near-duplicate vectors: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs.

Vectors that any bucket brings together are verified and joined to components; within a component all are compared in
blocks, and only counts leave a block. A bucket of few vectors gives its pairs, a larger one pairs with its leader; what
these leave apart in a larger bucket is compared too, so that all vectors of a bucket are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsreduce.llm.components import connected_components
from tsreduce.llm.shared import materialize, release
from tsreduce.llm.shingles import mix

#: Buckets of more vectors than this give pairs with their leader first.
FEW = 16
#: Vectors of a block.
BLOCK = 2048


def hadamard(x: np.ndarray) -> np.ndarray:
    """The normalised Walsh-Hadamard transform of each row; rows have a power of two places."""
    n, size = x.shape
    half = 1
    while half < size:
        y = x.reshape(n, -1, 2, half)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(n, size)
        half *= 2
    return x / math.sqrt(size)


def functions_for(rows: int, size: int) -> int:
    """Hash functions of a table, so that it has 16 buckets for each of so many rows."""
    return max(1, math.ceil(math.log(16 * max(rows, 1)) / math.log(2 * size)))


def buckets(x: np.ndarray, tables: int, probes: int, functions: int, seed: int = 0) -> np.ndarray:
    """For unit rows, a row of tables * (1 + probes) buckets: in each table its own, then those that it probes.

    A function is the nearest signed axis after three rounds of random signs and a transform. A probe takes, for one
    function, one of the next three axes; those that cost least come first, and one that doesn't exist is its own bucket.
    """
    n, width = x.shape
    size = 1 << max(1, (width - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, size - width)))
    others = min(3, size - 1)
    out = np.empty((n, tables, 1 + probes), np.uint64)
    each = np.arange(n)
    for t in range(tables):
        signs = np.random.default_rng([seed, t, size])
        axes, costs = np.empty((n, functions, 1 + others), np.uint64), np.empty((n, functions, others))
        for k in range(functions):
            y = x
            for _ in range(3):
                y = hadamard(y * signs.choice([-1.0, 1.0], size))
            far = np.abs(y)
            near = np.argpartition(-far, others, axis=1)[:, : 1 + others] if size > 1 + others else np.tile(np.arange(size), (n, 1))
            near = np.take_along_axis(near, np.argsort(-np.take_along_axis(far, near, 1), axis=1, kind="stable"), 1)
            high = np.take_along_axis(far, near, 1)
            axes[:, k] = near * 2 + (np.take_along_axis(y, near, 1) < 0)
            costs[:, k] = (high[:, :1] - high[:, 1:]) ** 2

        def named(own, t=t):
            h = np.full(n, t * 4096 + size.bit_length(), np.uint64)
            for k in range(functions):
                h = mix(h, int(k)) ^ own[:, k]
            return mix(h, 99)

        out[:, t, 0] = named(axes[:, :, 0])
        order = np.argsort(costs.reshape(n, -1), axis=1, kind="stable")
        for p in range(probes):
            own = axes[:, :, 0].copy()
            if p < order.shape[1]:
                k, j = np.divmod(order[:, p], others)
                own[each, k] = axes[each, k, j + 1]
            out[:, t, 1 + p] = named(own)
    return out.reshape(n, -1)


def _matrix(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors in doubles) of a list column, for each length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy().astype(float)
    starts = column.offsets.to_numpy()[:-1] - column.offsets[0].as_py()
    for width in np.unique(lengths):
        at = np.flatnonzero(lengths == width)
        yield at, flat[starts[at][:, None] + np.arange(width)]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # so that no square is too large or too small
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _signed(vectors: DataFrame, n: int, tables: int, probes: int) -> DataFrame:
    """(id, key, buckets) of (id, v); key is a digest of the vector."""

    def batches(it):
        for b in it:
            if not b.num_rows:
                continue
            found = [None] * b.num_rows
            for at, x in _matrix(b.column("v")):
                x = x + 0.0  # -0 is 0
                size = 1 << max(1, (x.shape[1] - 1).bit_length())
                h = buckets(_unit(x), tables, probes, functions_for(n, size)).view(np.int64)
                for r, k in enumerate(at.tolist()):
                    found[k] = (xxhash.xxh3_128_digest(x[r].tobytes()), h[r])
            keys, h = zip(*found)
            offsets = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * len(h[0]))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(h)))], ["id", "key", "buckets"])

    return vectors.mapInArrow(batches, "id long, key binary, buckets array<long>")


def _links(pairs: DataFrame, vectors: DataFrame, least: float) -> DataFrame:
    """Those of pairs (a, b) whose cosine is least or more."""

    def batches(it):
        for b in it:
            if not b.num_rows:
                continue
            ok, lengths = np.zeros(b.num_rows, bool), None
            for at, x in _matrix(b.column("x")):
                lengths = np.zeros(b.num_rows, np.int64) if lengths is None else lengths
                lengths[at] = x.shape[1]
                ys = b.column("y").take(pa.array(at))
                for with_, y in _matrix(ys):
                    if y.shape[1] == x.shape[1]:
                        ok[at[with_]] = (_unit(x[with_]) * _unit(y)).sum(1) >= least
            yield b.select(["a", "b"]).filter(pa.array(ok))

    x = vectors.select(F.col("id").alias("a"), F.col("v").alias("x"))
    y = vectors.select(F.col("id").alias("b"), F.col("v").alias("y"))
    return pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y").mapInArrow(batches, "a long, b long")


def _in_blocks(members: DataFrame, vectors: DataFrame, work, schema: str, block: int) -> DataFrame:
    """work(ids, others, weights, vectors, same block) on all pairs of blocks of each group of members (group, n, node, other, weight).

    Each of a group's n members is in one of n / block blocks by its hash, and goes with every other block of its group once.
    """
    blocks = F.ceil(F.col("n") / block)
    own = F.pmod(F.xxhash64("node"), blocks)
    rows = members.withColumn("own", own).join(vectors.withColumnRenamed("id", "node"), "node")
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    rows = rows.select("group", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "own", "node", "other", "weight", "v")
    keys = ["group", "i", "j"]

    def batches(it):
        held: list[pa.RecordBatch] = []

        def met():
            t = pa.Table.from_batches(held).combine_chunks()
            by = {c: t.column(c).to_numpy() for c in ("own", "i", "node", "other", "weight")}
            for at, x in _matrix(t.column("v")):
                first = by["own"][at] == by["i"][at]
                alone = bool(t.column("i")[0].as_py() == t.column("j")[0].as_py())
                yield from work({c: by[c][at] for c in ("node", "other", "weight")}, _unit(x), first, alone)

        last = None
        for b in it:
            if not b.num_rows:
                continue
            k = np.stack([b.column(c).to_numpy() for c in keys])
            edges = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(edges[:-1], edges[1:]):
                now = tuple(k[:, lo].tolist())
                if last is not None and now != last:
                    yield from met()
                    held = []
                held.append(b.slice(lo, hi - lo))
                last = now
        if held:
            yield from met()

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(batches, schema)


def _strips(x: np.ndarray, first: np.ndarray, alone: bool, least: float, strip: int = 512):
    """(rows, columns, which of them are linked) of the two blocks, a strip of rows at a time."""
    rows, columns = (np.arange(len(x)),) * 2 if alone else (np.flatnonzero(first), np.flatnonzero(~first))
    for k in range(0, len(rows), strip):
        r = rows[k : k + strip]
        near = x[r] @ x[columns].T >= least
        if alone:
            near[np.arange(len(r)), r] = False
        yield r, columns, near


def _counted(least: float):
    def work(by, x, first, alone):
        n = np.zeros(len(x), np.int64)
        for r, c, near in _strips(x, first, alone, least):
            n[r] += near @ by["weight"][c]
            if not alone:
                n[c] += by["weight"][r] @ near
        yield pa.RecordBatch.from_arrays([pa.array(by["node"]), pa.array(n)], ["node", "links"])

    return work


def _joining(least: float):
    def work(by, x, first, alone):
        for r, c, near in _strips(x, first, alone, least):
            near &= by["other"][r][:, None] != by["other"][c][None, :]
            hit = near.any(1)
            yield pa.RecordBatch.from_arrays([pa.array(by["node"][r[hit]]), pa.array(by["node"][c[near[hit].argmax(1)]])], ["a", "b"])

    return work


def _with_components(rows: DataFrame, found: DataFrame, node: str, name: str) -> DataFrame:
    """rows with their node's component, or the node itself if it has no link."""
    named = found.select(F.col("node").alias("__node"), F.col("component").alias("__component"))
    return rows.join(named, rows[node] == named["__node"], "left").withColumn(name, F.coalesce("__component", node)).drop("__node", "__component")


def _apart(met: DataFrame, found: DataFrame, few: int) -> DataFrame:
    """Of buckets of more than few vectors, those whose vectors are of several components: (bucket, node, base, other, largest, n, strangers).

    other is the vector's component, largest the one that most of the bucket's n vectors have; strangers counts the others.
    """
    crowd = _with_components(met.where(F.col("n") > few), found, "node", "other").select("bucket", "node", "base", "other")
    parts = crowd.groupBy("bucket", "other").agg(F.count(F.lit(1)).alias("k"))
    tops = parts.groupBy("bucket").agg(F.max_by("other", F.struct("k", "other")).alias("largest"), F.sum("k").alias("n"), (F.sum("k") - F.max("k")).alias("strangers")).where("strangers > 0")
    return crowd.join(tops, "bucket")


def near_vectors(docs: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, least: float = 0.95, tables: int = 8, probes: int = 2, few: int = FEW, block: int = BLOCK) -> DataFrame:
    """One row for each row of docs: id_col, n_links (other ids linked with it), component_id (smallest id that links reach, itself included), kept (the id is its component's).

    Two vectors are linked if a bucket brings them, or a chain of links between them, together and their cosine is least
    or more. Vectors that are null, empty, zero or hold nulls, NaN or infinities link with nothing, nor do vectors of
    different lengths; each is a component of its own. Equal vectors are linked. Rows of one id are one vector: of
    different ones the greatest in Spark's order of arrays. A row without an id links with nothing, has a null component
    and is kept. Other columns don't matter. An empty table gives an empty result.

    A table of hashes has 16 buckets or more for each row, at any number of rows. At a cosine of 0.95 in 64 dimensions
    two vectors meet in one of eight tables of three functions with two probes in 99.6 of 100 cases (measured); with more
    rows a table has more functions and needs more tables for that.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    valid = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(F.forall("v", lambda x: fine(x.cast("double"))) & F.exists("v", lambda x: x != 0))
    again = materialize(valid.groupBy("id").count().where("count > 1").select("id"), "again")
    vectors = valid.join(again, "id", "left_anti").unionByName(valid.join(again, "id", "left_semi").groupBy("id").agg(F.max("v").alias("v")))
    signs = materialize(_signed(vectors, valid.count(), tables, probes), "signs")
    equal = signs.groupBy("key").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("weight"))
    names = materialize(signs.select("id", "key").join(equal, "key").select("id", "node", "weight"), "names")
    nodes = names.where("id = node").select("node", "weight")

    entries = signs.join(nodes.select(F.col("node").alias("id")), "id", "left_semi").select(F.col("id").alias("node"), F.posexplode("buckets").alias("at", "bucket"))
    entries = entries.select("bucket", "node", (F.col("at") % (1 + probes) == 0).alias("base"))
    shared = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("base"), F.col("node"))).alias("leader")).where("n > 1 AND leader IS NOT NULL")
    met = materialize(entries.join(shared, "bucket"), "met")
    release(signs)
    small = met.where(F.col("n") <= few)
    both = small.where("base").select("bucket", F.col("node").alias("x")).join(small.select("bucket", F.col("node").alias("y")), "bucket").where("x <> y")
    led = met.where((F.col("n") > few) & (F.col("node") != F.col("leader"))).select(F.col("leader").alias("x"), F.col("node").alias("y"))
    ordered = lambda df: df.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    pairs = materialize(ordered(both.select("x", "y").unionByName(led)), "pairs")

    # each vector's smallest partner first: most other pairs are of one component then and need no look
    links = materialize(_links(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), vectors, least), "links")
    found = connected_components(links, "a", "b")
    rest = _with_components(_with_components(pairs, found, "a", "ca"), found, "b", "cb").where("ca <> cb").select("a", "b")
    parts = [links, materialize(_links(rest, vectors, least), "links")]
    found = connected_components(parts[0].unionByName(parts[1]), "a", "b")

    # what is left apart in larger buckets: few strangers give pairs, many are compared in blocks until none is linked
    apart = materialize(_apart(met, found, few), "apart")
    told = apart.where(F.col("strangers") <= few)
    strange = told.where("other <> largest").select("bucket", F.col("node").alias("x"), F.col("base").alias("bx"), F.col("other").alias("ox"))
    across = strange.join(told.select("bucket", F.col("node").alias("y"), F.col("base").alias("by"), F.col("other").alias("oy")), "bucket").where("ox <> oy AND (bx OR by)")
    parts.append(materialize(_links(ordered(across.select("x", "y")), vectors, least), "links"))
    while True:
        links = parts[0]
        for p in parts[1:]:
            links = links.unionByName(p)
        found = materialize(connected_components(links, "a", "b"), "found")
        crowd = _apart(met, found, few).where(F.col("strangers") > few)
        crowd = crowd.select(F.col("bucket").alias("group"), "n", "node", "other", F.lit(1).cast("long").alias("weight"))
        new = materialize(_in_blocks(crowd, vectors, _joining(least), "a long, b long", block), "links")
        if new.isEmpty():
            break
        parts.append(new)

    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    members = found.join(sizes, "component").join(nodes, "node").select(F.col("component").alias("group"), "n", "node", F.col("component").alias("other"), "weight")
    counts = _in_blocks(members, vectors, _counted(least), "node long, links long", block).groupBy("node").agg(F.sum("links").alias("links"))
    judged = _with_components(names, found, "node", "component").join(counts, "node", "left")
    judged = judged.select(F.col("id").alias("__id"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n_links"), "component")
    judged = materialize(judged, "judged")
    release(again, met, pairs, apart, new, *parts, names)
    out = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col))
    out = out.join(judged, out[id_col].cast("long") == judged["__id"], "left")
    component = F.coalesce("component", F.col(id_col).cast("long"))
    out = out.select(F.col(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), (F.col(id_col) == component).alias("kept"))
    nameless = docs.where(F.col(id_col).isNull()).select(F.col(id_col), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(nameless)
