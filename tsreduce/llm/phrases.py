"""Phrases by pivot partitioning: each n-gram is counted where its rarest word is.

Words are 62-bit codes, which are checked to be different. The most frequent words, a bounded number of them, go to all tasks with their ranks; the others
come after them, ranked by code. A text is cut into pieces and rewritten for each of its words: the neighbours that are
not rarer than it, up to the longest phrase. Fragments go to their word, and are mined there without the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tsreduce.llm.shared import materialize, release
from tsreduce.llm.shingles import mix
from tsreduce.llm.tokens import slices

#: A-Z in lower case; all that ends a piece as a line end, and a tab as a blank.
_PLAIN = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x0A if chr(b) in ".,;:!?" or 0x0A <= b <= 0x0D else 0x20 if b == 0x09 else b for b in range(256))
_PRIME, _LANES = np.uint64(0x9E3779B97F4A7C15), np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Longer words are hashed one by one.
_LONG = 1024
#: Fragments that are mined at once.
MINED = 1 << 18
#: Beyond so many occurrences, a pivot's fragments are dealt to several tasks.
HOT = 1 << 20
#: Ranks that go to all tasks: 12 bytes for each.
KNOWN = 1 << 20

#: In decimals, as the product goes beyond 64 bits.
SCORE = "CAST((CAST(a AS DECIMAL(20, 0)) * 2000000) div (CAST(l AS DECIMAL(20, 0)) + r) AS BIGINT)"


def _codes(raw: bytes, start: np.ndarray, size: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """62-bit codes of the words raw[start : start + size], with a salt for each."""
    lanes = np.ndarray((len(raw) + 1,), "<u8", raw + bytes(8), strides=(1,))
    h = mix(salt ^ (size.astype(np.uint64) * _PRIME) ^ (lanes[start] & _LANES[np.minimum(size, 8)]))
    left, at = np.flatnonzero((size > 8) & (size <= _LONG)), 8
    while len(left):
        h[left] = mix(h[left] ^ (lanes[start[left] + at] & _LANES[np.minimum(size[left] - at, 8)]))
        at += 8
        left = left[size[left] > at]
    for k in np.flatnonzero(size > _LONG).tolist():
        h[k] = xxhash.xxh3_64_intdigest(raw[start[k] : start[k] + size[k]], seed=int(salt[k]))
    return h >> np.uint64(2)


def _words(b: pa.RecordBatch, seed: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(raw, starts, sizes, codes, pieces, langs, names of langs) of the words of rows (lang, text), side by side; words of one piece have one number."""
    texts, langs = pc.fill_null(b.column(1).cast(pa.large_binary()), b""), pc.fill_null(b.column(0), "und").dictionary_encode()
    raw = b"\n".join(t.as_buffer() for t in texts).translate(_PLAIN)
    chars = np.frombuffer(raw, np.uint8)
    blank = np.ones(len(raw) + 2, bool)
    blank[1:-1] = (chars == 0x20) | (chars == 0x0A)
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    start, size = edge[::2], edge[1::2] - edge[::2]
    ends = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64) + 1)
    lang = langs.indices.to_numpy()[np.searchsorted(ends, start, "right")] if len(start) else np.zeros(0, np.int32)
    salts = np.array([xxhash.xxh3_64_intdigest(x.encode(), seed=seed) for x in langs.dictionary.to_pylist()] or [0], np.uint64)
    return raw, start, size, _codes(raw, start, size, salts[lang]), np.cumsum(chars == 0x0A)[start], lang, langs.dictionary


def _word_counts(rows: DataFrame, seed: int, held_most: int = 1 << 19) -> DataFrame:
    """(code, lang, word, n) of rows (lang, text), summed for each task as far as memory goes."""

    def batches(it):
        held: dict[int, list] = {}
        for b in it:
            for s in slices(b):
                raw, start, size, code, _, lang, names = _words(s, seed)
                names = names.to_pylist()
                code, at, n = np.unique(code, return_index=True, return_counts=True)
                for c, k, m in zip(code.tolist(), at.tolist(), n.tolist()):
                    if (known := held.get(c)) is not None:
                        known[2] += m
                    else:
                        held[c] = [names[lang[k]], raw[start[k] : start[k] + size[k]], m]
                if len(held) > held_most:
                    yield from _rows(held)
                    held = {}
        yield from _rows(held)

    def _rows(held) -> Iterator[pa.RecordBatch]:
        keys, values = list(held), list(held.values())
        for k in range(0, len(keys), 1 << 16):
            lang, word, n = zip(*values[k : k + (1 << 16)])
            yield pa.RecordBatch.from_arrays([pa.array(np.array(keys[k : k + (1 << 16)], np.uint64).view(np.int64)), pa.array(lang), pa.array(word, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], ["code", "lang", "word", "n"])

    return rows.mapInArrow(batches, "code long, lang string, word string, n long").groupBy("code", "lang", "word").agg(F.sum("n").alias("n"))


class Ranks:
    """Ranks of word codes: those of the most frequent words from 0, then all others by code. rare: others are too rare for any phrase."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, rare: bool) -> None:
        self.by_rank, self.counts, self.rare = codes, counts, rare
        self.order = np.argsort(codes)
        self.sorted = codes[self.order]

    def of(self, codes: np.ndarray) -> np.ndarray:
        """-1 for words that are too rare."""
        if not len(self.sorted):
            known = np.zeros(len(codes), bool)
            at = np.zeros(len(codes), np.int64)
        else:
            at = np.minimum(np.searchsorted(self.sorted, codes), len(self.sorted) - 1)
            known = self.sorted[at] == codes
        out = np.full(len(codes), -1, np.int64)
        out[known] = self.order[at[known]]
        if not self.rare:
            out[~known] = codes[~known].view(np.int64) + (1 << 62)
        return out

    def codes(self, ranks: np.ndarray) -> np.ndarray:
        """The codes of ranks; -1 stays."""
        out = np.where(ranks >= 1 << 62, ranks - (1 << 62), -1)
        known = (ranks >= 0) & (ranks < 1 << 62)
        out[known] = self.by_rank[ranks[known]].view(np.int64)
        return out

    def most(self, ranks: np.ndarray) -> np.ndarray:
        """How often words of these ranks occur at most."""
        if not len(self.counts):
            return np.full(len(ranks), 1 << 62)
        return self.counts[np.minimum(ranks, len(self.counts) - 1)]


def fragments(rank: np.ndarray, piece: np.ndarray, longest: int) -> np.ndarray:
    """For each word, the ranks around it as a row of 2 * longest - 1, itself in the middle; -1 is a gap.

    A neighbour is in the row if all from the word to it are of its piece and not rarer; on the left they are more frequent,
    so that an n-gram is owned by the first place of its rarest word.
    """
    n, side = len(rank), longest - 1
    rows = np.full((n, 2 * side + 1), -1, np.int64)
    rows[:, side] = rank
    for way in (-1, 1):
        on = rank >= 0
        for d in range(1, longest):
            other, same = np.full(n, -1, np.int64), np.zeros(n, bool)
            here, there = (slice(d, None), slice(None, n - d)) if way < 0 else (slice(None, n - d), slice(d, None))
            if n > d:
                other[here], same[here] = rank[there], piece[there] == piece[here]
            on = on & same & (other >= 0) & ((other < rank) if way < 0 else (other <= rank))
            rows[on, side + way * d] = other[on]
    return rows


def _grams(rows: np.ndarray, n: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams, counts): the different n-grams of 2 to longest words through the middle of these rows, left-aligned with -1 behind."""
    side, made, counts = longest - 1, [], []
    for first in range(side + 1):
        for end in range(max(side + 1, first + 2), first + longest + 1):
            whole = (rows[:, first] >= 0) & (rows[:, end - 1] >= 0)
            g = np.full((int(whole.sum()), longest), -1, np.int64)
            g[:, : end - first] = rows[whole, first:end]
            made.append(g)
            counts.append(n[whole])
    g, counts = np.concatenate(made), np.concatenate(counts)
    if not len(g):
        return g, counts
    local, codes = np.unique(g, return_inverse=True)
    codes = codes.reshape(g.shape)
    # as many places in one number as fit
    bits = max(1, int(len(local) - 1).bit_length())
    at_once, packed = max(1, 63 // bits), []
    for k in range(0, longest, at_once):
        x = np.zeros(len(g), np.int64)
        for c in range(k, min(longest, k + at_once)):
            x = (x << bits) | codes[:, c]
        packed.append(x)
    order = np.lexsort(packed[::-1])
    new = np.ones(len(g), bool)
    new[1:] = np.logical_or.reduce([x[order][1:] != x[order][:-1] for x in packed])
    heads = np.flatnonzero(new)
    return g[order[heads]], np.add.reduceat(counts[order], heads)


def _routed(rows: DataFrame, ranks, longest: int, seed: int, hot: int) -> DataFrame:
    """(pivot, salt, wide, heads, words): the fragments of rows (lang, text) for each pivot's rank.

    heads has a byte for each fragment: 16 times how many words are on its left, and how many on its right; words has the
    ranks of those, in 3 bytes where the pivot is known, in 8 where it isn't. salt tells parts of a hot pivot apart.
    """

    def batches(it):
        known = ranks.value
        side = longest - 1
        for b in it:
            for s in slices(b):
                _, _, _, code, piece, _, _ = _words(s, seed)
                if not len(code):
                    continue
                code, inverse = np.unique(code, return_inverse=True)
                f = fragments(known.of(code)[inverse], piece, longest)
                present = f >= 0
                f = f[present.sum(1) > 1]
                f = f[np.argsort(f[:, side], kind="stable")]
                present = f >= 0
                present[:, side] = False
                heads = (present[:, :side].sum(1) * 16 + present[:, side + 1 :].sum(1)).astype(np.uint8)
                edges = np.concatenate([[0], np.flatnonzero(f[1:, side] != f[:-1, side]) + 1, [len(f)]]) if len(f) else np.zeros(1, np.int64)
                pivots = f[edges[:-1], side] if len(f) else np.zeros(0, np.int64)
                ends = np.concatenate([[0], np.cumsum(present.sum(1))])[edges]
                words = f[present]
                for wide in (False, True):
                    of = np.flatnonzero((pivots >= len(known.by_rank)) == wide)
                    if not len(of):
                        continue
                    width = 8 if wide else 3
                    body = words.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
                    salt = xxhash.xxh3_64_intdigest(body[: 1 << 12]) % (known.most(pivots[of]) // hot + 1).astype(np.uint64)
                    lo, hi = edges[:-1][of], edges[1:][of]
                    wlo, whi = ends[:-1][of] * width, ends[1:][of] * width
                    raw = heads.tobytes()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(pivots[of]), pa.array(salt.astype(np.int64)), pa.array(np.full(len(of), wide)), pa.array([raw[x:y] for x, y in zip(lo.tolist(), hi.tolist())], pa.binary()), pa.array([body[x:y] for x, y in zip(wlo.tolist(), whi.tolist())], pa.binary())],
                        ["pivot", "salt", "wide", "heads", "words"],
                    )

    return rows.mapInArrow(batches, "pivot long, salt long, wide boolean, heads binary, words binary")


def _mined(routed: DataFrame, ranks, longest: int, least: int, hot: int, at_once: int) -> DataFrame:
    """(words, n, whole): the n-grams that each pivot owns, by their words' codes; whole if all of the pivot was met at once, and then none below least."""
    side = longest - 1
    columns = np.arange(2 * side + 1)

    def mine(held: list, whole: bool) -> Iterator[pa.RecordBatch]:
        known = ranks.value
        for wide in (False, True):
            rows = [r for r in held if r[2] == wide]
            if not rows:
                continue
            heads = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).astype(np.int64)
            raw = np.frombuffer(b"".join(r[4] for r in rows), np.uint8).reshape(-1, 8 if wide else 3)
            words = np.pad(raw, ((0, 0), (0, 8 - raw.shape[1]))).view("<i8").ravel()
            left, right = heads[:, None] // 16, heads[:, None] % 16
            f = np.full((len(heads), len(columns)), -1, np.int64)
            f[(columns >= side - left) & (columns <= side + right) & (columns != side)] = words
            f[:, side] = np.repeat([r[0] for r in rows], [len(r[3]) for r in rows])
            g, n = _grams(f, np.ones(len(f), np.int64), longest)
            if whole:
                g, n = g[n >= least], n[n >= least]
            sizes = (g >= 0).sum(1)
            codes = known.codes(g.ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(codes[codes >= 0]))
            yield pa.RecordBatch.from_arrays([lists, pa.array(n), pa.array(np.full(len(g), whole))], ["words", "n", "whole"])

    def batches(it):
        held, size, cut = [], 0, None
        for b in it:
            for row in zip(*(b.column(c).to_pylist() for c in ("pivot", "salt", "wide", "heads", "words"))):
                key = row[:2]
                if held and size >= at_once and key != held[-1][:2]:
                    yield from close(held, cut)
                    held, size, cut = [], 0, None
                elif held and size >= 2 * at_once:
                    # what comes before the last pivot is whole; the pivot itself goes on
                    yield from close([r for r in held if r[:2] != key], cut)
                    yield from mine([r for r in held if r[:2] == key], False)
                    held, size, cut = [], 0, key
                held.append(row)
                size += len(row[3])
        if held:
            yield from close(held, cut)

    def close(held, cut):
        """cut: the pivot of which a part was mined before."""
        bound = ranks.value.most(np.array([r[0] for r in held], np.int64)) // hot > 0
        parts = [bool(x) or r[:2] == cut for r, x in zip(held, bound)]
        yield from mine([r for r, p in zip(held, parts) if not p], True)
        yield from mine([r for r, p in zip(held, parts) if p], False)

    dealt = routed.repartition("pivot", "salt").sortWithinPartitions("pivot", "salt")
    return dealt.mapInArrow(batches, "words array<long>, n long, whole boolean")


def phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", *, longest: int = 4, least: int = 30, percent: int = 80, top: int = 2000, known: int = KNOWN, hot: int = HOT, at_once: int = MINED) -> DataFrame:
    """The first top phrases of each language: lang, rank (from 1), phrase, a, l, r, n, score.

    Words are what blanks and tabs divide within pieces, A-Z lower-cased; pieces end at . , ; : ! ? and line ends. A phrase
    has 2 to longest words of a piece and occurs a >= least times. Of its cuts into a first part, which occurs l times,
    and the rest, r times, the one of the smallest score 2000000 a / (l + r), floored, counts, of equals the first. A
    phrase within a longer one that occurs percent in a hundred times as often, or more, is left out. n is the number
    of all words of the language. Order is by score, then a, then the phrase in bytes.

    A null language is `und`; null and empty texts have no words, and a language without phrases no row. Repeated rows count
    each. Other columns don't matter; an empty table gives an empty result. The driver holds the codes and counts of the
    known most frequent words; with more words than that which occur least times, the others are ranked by code and never
    left out beforehand, so results are the same.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    for seed in range(8):
        words = materialize(_word_counts(rows, seed), "words")
        if words.groupBy("code").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            break
        release(words)
    else:
        raise RuntimeError("words share a code under every seed")
    frequent = words.where(F.col("n") >= least)
    first = frequent.select("code", "n").orderBy(F.desc("n"), "code").limit(known).toArrow()
    codes, counts = (first.column(c).to_numpy().astype(np.int64) for c in ("code", "n"))
    ranks = spark.sparkContext.broadcast(Ranks(codes.view(np.uint64), counts, frequent.count() <= known))
    mined = materialize(_mined(_routed(rows, ranks, longest, seed, hot), ranks, longest, least, hot, at_once), "mined")
    summed = mined.where("NOT whole").groupBy("words").agg(F.sum("n").alias("a")).where(F.col("a") >= least)
    found = materialize(mined.where("whole").select("words", F.col("n").alias("a")).unionByName(summed), "phrases")
    release(mined)

    size = F.size("words")
    often = found.unionByName(frequent.select(F.array("code").alias("words"), F.col("n").alias("a")))
    cuts = found.select("words", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumns({"head": F.slice("words", F.lit(1), F.col("k")), "tail": F.slice("words", F.col("k") + 1, size - F.col("k"))})
    cuts = cuts.join(often.select(F.col("words").alias("head"), F.col("a").alias("l")), "head").join(often.select(F.col("words").alias("tail"), F.col("a").alias("r")), "tail")
    score = F.expr(SCORE)
    scored = cuts.groupBy("words").agg(F.min("a").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    part = F.sequence(F.lit(2), size - 1)
    within = F.flatten(F.transform(part, lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda s: F.slice("words", s, m))))
    inner = found.where(size > 2).select(F.explode(within).alias("words"), "a").groupBy("words").agg(F.max("a").alias("over"))
    kept = scored.join(inner, "words", "left").where(f"over IS NULL OR CAST(over AS DECIMAL(20, 0)) * 100 < CAST(a AS DECIMAL(20, 0)) * {int(percent)}")

    # those that may be among the first, before their words are looked up
    of = words.select(F.col("code").alias("code"), "lang")
    kept = kept.join(of, kept["words"][0] == of["code"]).select("words", "lang", "a", "cut.score", "cut.l", "cut.r")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    near = materialize(kept.withColumn("at", F.rank().over(order)).where(F.col("at") <= top).drop("at"), "near")
    spelt = near.select("words", F.posexplode("words").alias("place", "code")).join(words.select("code", "word"), "code")
    spelt = spelt.groupBy("words").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    out = near.join(spelt, "words").withColumn("rank", F.row_number().over(order.orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")).where(F.col("rank") <= top)
    return out.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
