import math
import random
import re
from collections import Counter, defaultdict
from hashlib import sha256
from zlib import crc32

import pyarrow as pa
import pytest

from tsreduce.llm import importance, phrases
from tsreduce.llm import queries as Q

LOWER = {i: i + 32 for i in range(65, 91)}


def brute_phrases(rows, longest=4, least=30, percent=80, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f[lang].update(tuple(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    out = []
    for lang, found in f.items():
        good = {g: a for g, a in found.items() if a >= least and len(g) > 1}
        over = Counter()
        for g, a in good.items():
            for k in range(2, len(g)):
                for i in range(len(g) - k + 1):
                    over[g[i : i + k]] = max(over[g[i : i + k]], a)
        kept = []
        for g, a in good.items():
            if 100 * over[g] < percent * a or not over[g]:
                score, k, l, r = min((2000000 * a // (found[g[:k]] + found[g[k:]]), k, found[g[:k]], found[g[k:]]) for k in range(1, len(g)))
                kept.append((-score, -a, " ".join(g).encode(), a, l, r, score))
        for rank, (_, _, phrase, a, l, r, score) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), a, l, r, n[lang], score))
    return sorted(out)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    words = ["The", "of", "a", "é", "日本", "x" * 1500, "longer-than-eight", "longer-than-nine", "rare", "one"]
    rows = []
    for k in range(400):
        t = " ".join(rng.choices(words, [30, 25, 20, 5, 5, 1, 4, 4, 1, 5], k=rng.randint(0, 40)))
        rows.append((rng.choice(["en", "en", "fr", None, "und"]), re.sub(r"a of", "a, of", t, count=1) + rng.choice(["", ".", "\tz z z z z\n", "\r\n!?"])))
    rows += [("en", "is onhe"), ("en", "IS  onhe.")] * 300 + [("en", None), (None, None), ("fr", ""), ("de", "alone"), ("en", " \t ")]
    rows += [("fr", "a b a b a b a b " * 500)]
    return rows


@pytest.mark.parametrize("how", [{}, {"known": 3, "at_once": 64, "hot": 40}, {"known": 0, "at_once": 16}, {"longest": 3, "least": 5, "percent": 50, "top": 7}])
def test_phrases(spark, texts, how):
    df = spark.createDataFrame([(k, t, lang, 0, "w", "c") for k, (lang, t) in enumerate(texts)], "rank long, text string, lang string, n long, words string, code string").repartition(5)
    out = phrases.phrases(df, **how)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, out.collect())) == brute_phrases(texts, **{k: v for k, v in how.items() if k not in ("known", "at_once", "hot")})


def test_no_phrases(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert phrases.phrases(empty).collect() == []
    assert phrases.phrases(spark.createDataFrame([(None, None), ("a b", "x")], empty.schema)).collect() == []


def test_score_beyond_64_bits(spark):
    a, l, r = 9 * 10**18, 9 * 10**18 + 5, 9 * 10**18 + 11
    got = spark.sql(f"SELECT {phrases.SCORE} FROM VALUES ({a}L, {l}L, {r}L), (7L, 9L, 8L) AS t(a, l, r)").collect()
    assert [x[0] for x in got] == [2000000 * a // (l + r), 2000000 * 7 // 17]


def features(text, longest=2):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(w), [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


def brute_sample(rows, target, n_buckets=10_000, percent=25, longest=2):
    """{(id, features, weight, score, rank or None): how often}, by the definition."""
    b = lambda f: crc32(f.encode()) % n_buckets
    s, t = (Counter(b(f) for x in texts for f in features(x, longest)[1]) for texts in ([x for _, x in rows], target))
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda k: math.floor(1000 * math.log((t[k] + 1) * (total_s + n_buckets) / ((s[k] + 1) * (total_t + n_buckets))))
    out, able = [], []
    for i, x in rows:
        n, f = features(x, longest)
        weight = sum(gain(b(g)) for g in f) // len(f) if f else 0
        if i is None:
            out.append((i, len(f), weight, None, None))
            continue
        h = int(sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        row = (i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))))
        (able if n >= 20 else out).append(row if n >= 20 else (*row, None))
    able.sort(key=lambda r: (-r[3], r[0], r[2], r[1]))
    most = percent * len(able) // 100
    return Counter(out + [(*r, k if k <= most else None) for k, r in enumerate(able, 1)])


def test_buckets():
    texts = ["The cat, the CAT 9é日 x", "", None, "  one", "a b c d", "!!", "Ａ b c", "a b"]
    for given in (pa.array(texts), pa.chunked_array([["zz"], texts]).combine_chunks().slice(1)):
        got, offsets, n_words = importance.feature_buckets(given, 3, 997)
        for k, t in enumerate(texts):
            n, f = features(t, 3)
            assert n_words[k] == n and sorted(got[offsets[k] : offsets[k + 1]].tolist()) == sorted(crc32(x.encode()) % 997 for x in f)


@pytest.mark.parametrize("how", [{}, {"n_buckets": 100_000, "percent": 60, "longest": 3}, {"percent": 100}])
def test_sample(spark, how):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(60)] + ["É", "日本", "Ok9"]
    rows = [(k, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for k in range(300)]
    rows += [(3, rows[3][1]), (3, "another " * 30), (None, "lost " * 25), (None, None), (900, None), (901, ""), (902, "x " * 50_000), (-5, "y, z!" * 30)]
    target = ["w1 w2 w3 É 日本 " * 4, None, "", "w5 w6"]
    df = spark.createDataFrame([(i, t, 1, 2, "b") for i, t in rows], "doc_id long, text string, rank long, score long, buckets string").repartition(6)
    out = importance.importance_sample(df, spark.createDataFrame([(0, t) for t in target], "item_id long, text string"), **how)
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, out.collect())) == brute_sample(rows, target, **how)


def test_sample_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a " * 30), (2, "b " * 30), (3, "c " * 30), (4, "d " * 30)], docs.schema)
    assert importance.importance_sample(docs, some).collect() == []
    assert Counter(map(tuple, importance.importance_sample(some, docs).collect())) == brute_sample([tuple(r) for r in some.collect()], [])


def test_sample_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("text").collect()]
    assert Counter(map(tuple, Q.op13_importance_sample(spark, sf).collect())) == brute_sample(rows, target)
