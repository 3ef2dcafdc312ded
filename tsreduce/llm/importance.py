"""Importance resampling towards a target: hashed word n-grams of both corpora, gains by bucket, Gumbel top-k."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tsreduce.llm.shared import materialize, release
from tsreduce.llm.tokens import slices

#: A-Z in lower case, other letters, digits and all bytes beyond ASCII as they are; the rest divides words.
_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def word_ids(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(ids, offsets, words): the words of each text side by side as ids, and the word of each id. Null texts have none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = (texts.buffers()[2] or pa.py_buffer(b""))[int(offsets[0]) : int(offsets[-1])].to_pybytes().translate(_WORDS)
    plain = pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer((offsets - offsets[0]).tobytes()), pa.py_buffer(raw)])
    lists = pc.ascii_split_whitespace(plain)
    found = lists.flatten().dictionary_encode()
    ids, edges = found.indices.to_numpy().astype(np.int64), lists.offsets.to_numpy().astype(np.int64)
    words = found.dictionary.cast(pa.large_binary()).to_pylist()
    full = np.array([bool(w) for w in words], bool)[ids] if len(words) else np.zeros(0, bool)
    return ids[full], np.concatenate([[0], np.cumsum(full)])[edges - edges[0]], words


def feature_buckets(texts: pa.Array, longest: int, n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, offsets, words): the bucket of each run of 1 to longest words, text by text, and each text's number of words.

    A run is a tuple of a shorter run's id and a word's id. Each distinct tuple's bytes are hashed once, going on from the
    checksum of the shorter run, and the result goes to all places of the tuple.
    """
    ids, offsets, words = word_ids(texts)
    n_words = np.diff(offsets)
    of_text = np.repeat(np.arange(len(n_words)), n_words)
    runs, checks = ids, np.array([zlib.crc32(w) for w in words], np.uint32)
    named = np.array(words, object)
    parts, owners = [], []
    for size in range(1, longest + 1):
        parts.append((checks[runs] % n_buckets) if len(runs) else np.zeros(0, np.uint32))
        owners.append(of_text[: len(runs)][_same(of_text, size)] if size > 1 else of_text)
        parts[-1] = parts[-1][_same(of_text, size)] if size > 1 else parts[-1]
        if size < longest:
            pairs = runs[:-1] * len(words) + ids[size:] if len(runs) > 1 else np.zeros(0, np.int64)
            pairs, runs = np.unique(pairs, return_inverse=True)
            before, word = np.divmod(pairs, max(len(words), 1))
            begun = [zlib.crc32(b" ", c) for c in checks.tolist()]
            checks = np.array(list(map(zlib.crc32, named[word].tolist(), np.array(begun, np.uint32)[before].tolist())), np.uint32)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(parts)[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(n_words)))]), n_words


def _same(of_text: np.ndarray, size: int) -> np.ndarray:
    """For each place, whether so many words from it are of one text."""
    return of_text[: len(of_text) - size + 1] == of_text[size - 1 :]


def _hashed(rows: DataFrame, longest: int, n_buckets: int) -> DataFrame:
    """(id, n_words, n_features, buckets) of (id, text); buckets are packed in 16 or 32 bits each."""
    kind = np.uint16 if n_buckets <= 1 << 16 else np.uint32

    def batches(it):
        for b in it:
            for s in slices(b):
                found, offsets, n_words = feature_buckets(s.column(1), longest, n_buckets)
                raw = pa.py_buffer(found.astype(kind).tobytes())
                packed = pa.Array.from_buffers(pa.large_binary(), len(s), [None, pa.py_buffer((offsets * kind().itemsize).astype(np.int64).tobytes()), raw])
                yield pa.RecordBatch.from_arrays([s.column(0), pa.array(n_words), pa.array(np.diff(offsets)), packed.cast(pa.binary())], ["id", "n_words", "n_features", "buckets"])

    return rows.mapInArrow(batches, f"id {rows.schema['id'].dataType.simpleString()}, n_words long, n_features long, buckets binary")


def _totals(hashed: DataFrame, n_buckets: int) -> np.ndarray:
    """How many features each bucket holds: so many numbers, whatever the corpus."""
    kind = np.uint16 if n_buckets <= 1 << 16 else np.uint32

    def batches(it) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, np.int64)
        for b in it:
            c = b.column(0)
            total += np.bincount(np.frombuffer(b"".join(x.as_buffer() for x in c if x.is_valid), kind), minlength=n_buckets)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_buckets)), pa.array(total)], ["bucket", "n"])

    out = np.zeros(n_buckets, np.int64)
    for r in hashed.select("buckets").mapInArrow(batches, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket is worth: the floored thousandfold logarithm of its smoothed share in the target over that in the source."""
    s_all, t_all = float(source.sum()) + len(source), float(target.sum()) + len(target)
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def importance_sample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, longest: int = 2, n_buckets: int = 10_000, percent: int = 25, least_words: int = 20, seed: int = 7) -> DataFrame:
    """One row for each row of docs: id_col, n_features, weight, score, rank (of those drawn, from 1).

    Words are letters a-z, digits and all characters beyond ASCII, A-Z lower-cased; features are runs of 1 to longest
    words. weight is the floored mean gain of a text's features, 0 without any; score adds Gumbel noise that the id and
    the seed give. Of the rows with least_words words or more, percent in a hundred (floored) are drawn by score, ties to
    the smaller id. A null text is an empty one. A row without an id has a weight, but no score, and is neither counted
    nor drawn; rows of one id are judged each by its text, and if alike in all that is returned, either may be drawn first.
    Columns other than the two don't matter. Without target texts all of them weigh as t = 0; an empty table gives an empty result.

    The driver holds two numbers for each bucket. Ranks come from how many rows have each score: scores are whole numbers
    within bounds that the logarithms set, about 100,000 of them whatever the corpus.
    """
    source = materialize(_hashed(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), longest, n_buckets), "features")
    aimed = materialize(_hashed(target.select(F.lit(0).alias("id"), F.col(text_col).alias("text")), longest, n_buckets), "target")
    worth = gains(_totals(source, n_buckets), _totals(aimed, n_buckets))
    kind = np.uint16 if n_buckets <= 1 << 16 else np.uint32

    def weigh(it):
        for b in it:
            n = b.column(2).to_numpy()
            sums = np.array([worth[np.frombuffer(x.as_buffer(), kind)].sum() for x in b.column(3)], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(sums // np.maximum(n, 1))], ["id", "n_words", "n_features", "weight"])

    weighed = source.mapInArrow(weigh, f"id {source.schema['id'].dataType.simpleString()}, n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    scored = materialize(weighed.withColumn("score", (F.col("weight") + noise).cast("long")), "scored")
    release(source, aimed)
    able = scored.where((F.col("n_words") >= least_words) & F.col("id").isNotNull())
    # one row for each score: a bounded number
    counts = able.groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    above = F.sum("n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1))
    before = counts.select(F.col("score").alias("of"), F.coalesce(above, F.lit(0)).alias("before"))
    most = (percent * able.count()) // 100
    near = able.join(before.where(F.col("before") < most), F.col("score") == F.col("of"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("score").orderBy("id", "weight", "n_features"))
    drawn = near.withColumn("rank", place.cast("long")).withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    columns = [F.col("id").alias(id_col), "n_features", "weight", "score", "rank"]
    none = F.lit(None).cast("long")
    beyond = able.join(before.where(F.col("before") >= most), F.col("score") == F.col("of"), "left_semi").withColumn("rank", none)
    unable = scored.where((F.col("n_words") < least_words) | F.col("id").isNull()).withColumn("rank", none)
    return drawn.select(*columns).unionByName(beyond.select(*columns)).unionByName(unable.select(*columns))
