"""Quality rules for documents, and for the hosts that they come from."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsreduce.llm.shared import materialize

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = re.compile(r"[#*$%&|<>]")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeat_words(words: list, width: int) -> int:
    """Words that lie in a window of that width which the list holds twice or more."""
    windows = list(zip(*(words[i:] for i in range(width))))
    if len(set(windows)) == len(windows):
        return 0
    first: dict = {}
    again = [i for i, w in enumerate(windows) if first.setdefault(w, i) != i]
    starts = sorted({*again, *(first[windows[i]] for i in again)})
    covered, end = 0, 0
    for i in starts:
        covered += i + width - max(i, end)
        end = i + width
    return covered


def text_counts(text: str | None, width: int = 5) -> tuple[int, ...]:
    """COUNTS of a whole text; of a null text all are 0. Words are what ASCII white space divides."""
    if not text:
        return (0,) * len(COUNTS)
    words = text.encode("utf-8", "surrogatepass").split()
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(SPACE):
            dup += line in seen
            seen.add(line)
    return (len(words), len(text) - sum(map(text.count, SPACE)), len(SYMBOLS.findall(text)), dup, repeat_words(words, width))


def _counting(more: list[str]):
    def batches(it):
        for b in it:
            counts = [text_counts(t.as_py()) for t in b.column("text")]
            columns = list(zip(*counts)) or [()] * len(COUNTS)
            same = ["id", "host", *more]
            yield pa.RecordBatch.from_arrays([*map(b.column, same), *(pa.array(c, pa.int64()) for c in columns)], [*same, *COUNTS])

    return batches


def host_rates(failures: DataFrame, *, least_rate: float = 0.25, times_mean: float = 3.0) -> DataFrame:
    """(host, n, failed, host_rate, rejected) from (host, base_failed): failure rates shrunk towards the hosts' common beta prior.

    The prior's mean m is that of all rows. Its strength a + b is 1/r - 1, held between 1 and a million, where r is the
    share of the hosts' variance that sampling doesn't explain: of S = sum of n(p - m)^2, H hosts would give
    m(1 - m)(H - 1) by chance, so r = (S/(m(1 - m)) - (H - 1)) / (N - sum(n^2)/N - (H - 1)). A host's rate is
    (failed + a) / (n + a + b). It is rejected if that is over least_rate and over times_mean times m, or half way from m to 1 where that is less.
    """
    hosts = failures.where("host is not null").groupBy("host").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col("base_failed").cast("double")).alias("failed"))
    n, failed = F.col("n"), F.col("failed")
    total = hosts.agg(F.count(F.lit(1)).alias("h"), F.sum("n").alias("rows"), F.sum("failed").alias("fails"), F.sum(failed * failed / n).alias("q"), F.sum(n * n).alias("nn"))
    total = total.withColumn("m", F.col("fails") / F.col("rows")).withColumn("chance", F.col("m") * (1 - F.col("m")))
    by_chance = F.col("h") - 1
    share = F.try_divide(F.try_divide(F.col("q") - F.col("rows") * F.col("m") * F.col("m"), F.col("chance")) - by_chance, F.col("rows") - F.col("nn") / F.col("rows") - by_chance)
    strength = F.when(share > 0, F.least(F.lit(1e6), F.greatest(F.lit(1.0), 1 / share - 1))).otherwise(1e6)
    limit = F.greatest(F.lit(least_rate), F.least(F.lit(times_mean) * F.col("m"), (1 + F.col("m")) / 2))
    prior = F.broadcast(total.select("m", strength.alias("s"), limit.alias("limit")))  # one row
    rate = (failed + F.col("m") * F.col("s")) / (n + F.col("s"))
    return hosts.crossJoin(prior).select("host", n.cast("long").alias("n"), failed.cast("long").alias("failed"), rate.alias("host_rate"), (rate > F.col("limit")).alias("rejected"))


def _judged(docs: DataFrame, id_col: str, text_col: str, host_col: str, min_words: int, max_repeat_percent: int, how: dict, *more) -> DataFrame:
    kinds = dict(docs.dtypes)
    rows = docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), F.col(text_col).alias("text"), *more)
    extra = [c for c in rows.columns if c not in ("id", "host", "text")]
    counted = rows.mapInArrow(_counting(extra), f"id {kinds[id_col]}, host {kinds[host_col]}, " + "".join(f"{c} {dict(rows.dtypes)[c]}, " for c in extra) + ", ".join(f"{c} long" for c in COUNTS))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    counted = materialize(counted.withColumn("base_failed", failed), "quality")
    rates = materialize(host_rates(counted, **how).select("host", "host_rate", "rejected"), "hosts")
    size = rates.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.col("host").cast("string"))).alias("bytes")).first()
    # sent to all while the hosts are few; else rows without a host, which match nothing, stay out of the join
    if size["n"] <= 100_000 and (size["bytes"] or 0) <= 8 << 20:
        return counted.join(F.broadcast(rates), "host", "left")
    without = counted.where("host IS NULL").withColumn("host_rate", F.lit(None).cast("double")).withColumn("rejected", F.lit(None).cast("boolean"))
    return counted.where("host IS NOT NULL").join(rates, "host", "left").unionByName(without)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", *, min_words: int = 10, max_repeat_percent: int = 20, **how) -> DataFrame:
    """For every row of docs: id_col, COUNTS, base_failed, kept, host_rate, host_rejected.

    A text fails with fewer than min_words words or more than max_repeat_percent of them in repeated 5-word windows. A
    host whose shrunk failure rate is far over that of all (how: host_rates' limits) is rejected with all its documents.
    Null and empty texts fail; a null host has no rate and is never rejected; repeated rows count each; other columns
    aren't read. An empty table gives an empty result. Whole texts are read once; rates are summed in map tasks before
    they are shuffled, so a host of very many rows costs no more than another.
    """
    out = _judged(docs, id_col, text_col, host_col, min_words, max_repeat_percent, how)
    rejected = F.coalesce("rejected", F.lit(False))
    return out.select(F.col("id").alias(id_col), *COUNTS, "base_failed", (~F.col("base_failed") & ~rejected).alias("kept"), "host_rate", rejected.alias("host_rejected"))


def drop_rejected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", *, min_words: int = 10, max_repeat_percent: int = 20, **how) -> DataFrame:
    """The rows of docs that quality_rules keeps, with all their columns: a row is named by its id, host and text, nulls too."""
    key = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    out = _judged(docs, id_col, text_col, host_col, min_words, max_repeat_percent, how, key.alias("text_key"))
    kept = out.where(~F.col("base_failed") & ~F.coalesce("rejected", F.lit(False))).select(F.col("id").alias("__id"), F.col("host").alias("__host"), F.col("text_key").alias("__key")).distinct()
    same = docs[id_col].eqNullSafe(kept["__id"]) & docs[host_col].eqNullSafe(kept["__host"]) & (F.unhex(F.sha2(F.coalesce(docs[text_col], F.lit("")), 256)) == kept["__key"])
    return docs.join(kept, same, "left_semi")
