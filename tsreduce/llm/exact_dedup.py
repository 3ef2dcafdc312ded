"""Exact deduplication over an extendible-hash index on shared files, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tsreduce.llm.shared import materialize, release


def directory(loads: DataFrame, bucket_rows: int, max_depth: int) -> DataFrame:
    """(slot, bucket, depth) of loads (slot, n), n keys in each slot: the directory once no bucket has to split.

    A slot is the first max_depth bits of a key; a bucket of depth d owns the slots that share their first d bits, its
    prefix. There is one bucket at first. In each round the buckets of over bucket_rows keys split in two, and so the
    directory doubles where the deepest do, until none is overfull or max_depth is reached: a bucket that is overfull
    there goes on in further pages of its file. bucket is the prefix behind a leading 1. At most 2 ** max_depth rows.
    """
    buckets = materialize(loads.select("slot", "n", F.lit(1).cast("long").alias("bucket"), F.lit(0).alias("depth")), "exact-directory")
    for depth in range(max_depth):
        full = buckets.where(F.col("depth") == depth).groupBy("bucket").agg(F.sum("n").alias("held")).where(F.col("held") > bucket_rows).select("bucket", F.lit(True).alias("full"))
        if full.isEmpty():
            break
        # the next bit of a slot says which half it goes to
        bit = F.expr(f"shiftright(slot, {max_depth - depth - 1}) & 1")
        split = buckets.join(full, "bucket", "left")
        split = split.select("slot", "n", F.when(F.col("full"), F.col("bucket") * 2 + bit).otherwise(F.col("bucket")).alias("bucket"), F.when(F.col("full"), depth + 1).otherwise(F.col("depth")).alias("depth"))
        before, buckets = buckets, materialize(split, "exact-directory")
        release(before)
    return buckets.select("slot", "bucket", "depth")


def _keyed(docs: DataFrame, id_col: str, text_col: str, max_depth: int, hash_key) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("id"), text.alias("t"), hash_key(text).alias("key"))
    return keyed.withColumn("slot", F.expr(f"shiftrightunsigned(key, {64 - max_depth})"))


def build_index(docs: DataFrame, id_col: str, text_col: str, *, bucket_rows: int = 1 << 15, max_depth: int = 16, hash_key=F.xxhash64) -> tuple[DataFrame, DataFrame, bool]:
    """(index, directory, whether keys collide). The index has an entry for each different text: slot, bucket, depth, key, chain, t, text_sha256, keep_id, group_size.

    Within a bucket, texts are grouped by key and bytes: copies meet in their map task before any shuffle, so a text that
    fills a third of the rows costs a row for each task. Different texts of one key chain (1, 2, ...); they alone keep
    their bytes, in t, for others to be compared with. The files are written in key ranges, each by one owner task.
    """
    rows = _keyed(docs, id_col, text_col, max_depth, hash_key)
    loads = materialize(rows.groupBy("slot").agg(F.count_distinct("key").alias("n")), "exact-loads")
    found = directory(loads, bucket_rows, max_depth)
    release(loads)
    at = ["slot", "bucket", "depth", "key"]
    # the directory has at most 2 ** max_depth rows
    held = rows.join(F.broadcast(found), "slot").groupBy(*at, "t").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    columns = [*at, "text_sha256", "keep_id", "group_size"]
    entries = materialize(held.select(*at, F.sha2("t", 256).alias("text_sha256"), "keep_id", "group_size"), "exact-entries")
    several = entries.groupBy("bucket", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket", "key")
    collide = not several.isEmpty()
    index = entries.select(*columns, F.lit(1).alias("chain"), F.lit(None).cast("string").alias("t"))
    if collide:
        chain = F.row_number().over(Window.partitionBy("bucket", "key").orderBy("text_sha256"))
        chained = held.join(several, ["bucket", "key"], "left_semi").select(*at, F.sha2("t", 256).alias("text_sha256"), "keep_id", "group_size", "t").withColumn("chain", chain)
        index = index.join(several, ["bucket", "key"], "left_anti").select(*columns, "chain", "t").unionByName(chained.select(*columns, "chain", "t"))
    index = materialize(index.repartitionByRange("slot", "key").sortWithinPartitions("slot", "key", "chain"), "exact-index")
    release(entries)
    return index, found, collide


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, bucket_rows: int = 1 << 15, max_depth: int = 16, hash_key=F.xxhash64) -> DataFrame:
    """For every row of docs: id_col, keep_id, group_size, kept, text_sha256, bucket, depth, chain.

    A null text counts as an empty one; texts are equal when their bytes are. Of equal texts the row of the largest id
    stays. Rows that repeat an id with the same text are counted each and marked alike; a null id stays only where its
    group has no other. Columns beside the two named are not read. An empty table gives an empty result.

    A row finds its bucket by the directory, and its text there by the key. Where texts of the bucket share that key, it
    is compared with the bytes of each. hash_key: a function from the text column to a long; a weak one only makes longer chains.
    """
    index, found, collide = build_index(docs, id_col, text_col, bucket_rows=bucket_rows, max_depth=max_depth, hash_key=hash_key)
    looked = _keyed(docs, id_col, text_col, max_depth, hash_key).join(F.broadcast(found), "slot")
    entries = index.select("bucket", "key", "depth", "chain", "text_sha256", "keep_id", "group_size", F.col("t").alias("bytes"))
    met = looked.select("id", "bucket", "key").join(entries.where("bytes IS NULL").drop("bytes"), ["bucket", "key"])
    if collide:
        chained = entries.where("bytes IS NOT NULL").alias("e")
        rows = looked.select("id", "bucket", "key", "t")
        met = met.unionByName(rows.join(chained, ["bucket", "key"]).where(F.col("t") == F.col("bytes")).select(*met.columns))
    return met.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "bucket", "depth", "chain")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns."""
    kept = exact_dedup(docs, id_col, text_col, **how).where("kept").select(F.col(id_col).alias("__keep"), F.col("text_sha256").alias("__sha")).distinct()
    same = docs[id_col].eqNullSafe(kept["__keep"]) & (F.sha2(F.coalesce(docs[text_col], F.lit("")), 256) == kept["__sha"])
    return docs.join(kept, same, "left_semi")
