import textwrap
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.compare import assert_same
from tsreduce.llm import chat_format, components, exact_dedup, license_scan, ngram_join, packing, piece_encode, quality_rules, substring_dedup, tokens, url_filter, warc_revisit
from tsreduce.llm import queries as Q

TEXTS = ["", None, "a", "A", "one two three four five six", "one two three four five six", " \n\t", "x " * 3000, "<|im_end|><\\|x|> it's é 日本 \u0085\r\n"]
LONG = " ".join(f"w{i}" for i in range(120))


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty, equal and very long texts, and columns whose names operators use themselves."""
    rows = [(i, t, None if i % 3 else "h", i, "k") for i, t in enumerate([*TEXTS, LONG, LONG + " tail", "start " + LONG])]
    return spark.createDataFrame([*rows, rows[4], (None, "lost", "h", 0, "k")], "doc_id long, text string, source string, rep long, `key` string").cache()


def texts_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_oracle(spark, sf, name):
    assert_same(spark, sf, Q.queries()[name], Q.oracle_sql()[name])


def test_exact_dedup_chains(docs):
    key = lambda rows: sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in rows)
    strong = exact_dedup.exact_dedup(docs).collect()
    # keys of one slot, and keys that spread over all of them
    for weak in (lambda t: F.length(t).cast("long"), lambda t: F.xxhash64(F.length(t) % 3)):
        rows = exact_dedup.exact_dedup(docs, hash_key=weak, bucket_rows=2, max_depth=4).collect()
        assert key(rows) == key(strong) and len(rows) == docs.count()
        assert max(r.chain for r in rows) > 1
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0
    assert exact_dedup.drop_copies(docs).columns == docs.columns
    by_text = {}
    for i, t in texts_of(docs):
        by_text.setdefault(t or "", []).append(i)
    kept = sorted((str(r.doc_id), r.text or "") for r in exact_dedup.drop_copies(docs).select("doc_id", "text").collect())
    top = {t: max((i for i in ids if i is not None), default=None) for t, ids in by_text.items()}
    assert kept == sorted((str(i), t) for t, ids in by_text.items() for i in ids if i == top[t])


def test_exact_index_splits(spark):
    """Buckets against a plain extendible-hash table: depths, entries and key ranges."""
    rows = spark.range(1000).selectExpr("id AS doc_id", "concat('text ', id % 700) AS text")
    index, found, collide = exact_dedup.build_index(rows, "doc_id", "text", bucket_rows=50, max_depth=8)
    entries = index.collect()
    keys = [r.key % 2**64 >> 56 for r in entries]
    assert not collide and len(entries) == 700

    def split(slots, depth, prefix):
        if len(slots) <= 50 or depth == 8:
            return {s: (1 << depth | prefix, depth) for s in slots}
        halves = [[s for s in slots if s >> (7 - depth) & 1 == bit] for bit in (0, 1)]
        return split(halves[0], depth + 1, prefix * 2) | split(halves[1], depth + 1, prefix * 2 + 1)

    want = split(keys, 0, 0)
    assert {r.slot: (r.bucket, r.depth) for r in found.collect()} == want
    assert len({b for b, _ in want.values()}) > 8 and {r.depth for r in entries} >= {4}
    assert all((r.bucket, r.depth) == want[r.slot] for r in entries)
    # at the largest depth a bucket goes on beyond its limit
    shallow, _, _ = exact_dedup.build_index(rows, "doc_id", "text", bucket_rows=50, max_depth=2)
    assert {r.depth for r in shallow.collect()} == {2}


def test_quality_counts():
    text = "a b c d e\nx\na b c d e\n x #$\nx\n\n"
    assert quality_rules.text_counts(text) == (14, 15, 2, 2, 12)
    assert quality_rules.text_counts(None) == (0,) * 5
    assert quality_rules.text_counts("z " * 8)[4] == 8


def test_host_is_rejected(spark):
    good = "a b c d e f g h i j k "
    rows = [(i, "bad" if i < 40 else good + str(i), "spam" if i < 45 else "fine") for i in range(100)]
    # a host that fails in 40 of 100 documents among nine that fail in 5; one bad document of a small host tells little
    rows += [(1000 * h + i, "bad" if i < (40 if h == 9 else 5) else good + str(i), f"h{h}") for h in range(1, 10) for i in range(100)]
    rows += [(20000, "bad", "small"), (20001, good, "small"), (20002, good, None), (20003, None, None), (20002, good, None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, source string, host string, n long")
    out = quality_rules.quality_rules(df).collect()
    assert len(out) == len(rows)
    got = {r.doc_id: r for r in out}
    assert not got[44].base_failed and got[44].host_rejected and not got[44].kept
    assert got[9099].host_rejected and not got[9099].kept
    assert got[99].kept and got[8099].kept and got[20001].kept and got[20002].kept and not got[20003].kept
    kept = quality_rules.drop_rejected(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in out if r.kept)
    assert quality_rules.quality_rules(df.limit(0)).count() == 0 and quality_rules.drop_rejected(df.limit(0)).count() == 0


def test_quality_odd_rows(docs):
    out = quality_rules.quality_rules(docs).collect()
    assert len(out) == docs.count() and all(r.base_failed for r in out if r.n_words == 0)
    assert {r.n_words for r in out if r.doc_id == 7} == {3000}


def test_rates_net_of_sampling(spark):
    # hosts that differ by chance alone are shrunk all the way
    rng = np.random.default_rng(0)
    rows = [(f"h{h}", bool(x)) for h in range(40) for x in rng.random(50) < 0.2]
    rates = [r.host_rate for r in quality_rules.host_rates(spark.createDataFrame(rows, "host string, base_failed boolean")).collect()]
    assert max(rates) - min(rates) < 0.1


def shingle_set(text, width):
    w = (text or "").encode().lower().split()
    return set(zip(*(w[i:] for i in range(width)))) if len(w) >= width else ({tuple(w)} if w else set())


def near_docs(seed, n=70, size=60):
    rng = np.random.default_rng(seed)
    base, out = [f"v{x}" for x in rng.integers(0, 400, size)], []
    for i in range(n):
        w = list(base) if i % 2 else [f"u{x}" for x in rng.integers(0, 300, size)]
        for k in rng.integers(0, len(w), int(rng.integers(0, 4))):
            w[k] = f"z{rng.integers(0, 50)}"
        out.append((i, " ".join(w)))
    return [*out, (n, ""), (n + 1, None), (n + 2, "A b"), (n + 3, "a B"), (n + 4, out[1][1])]


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
def test_ngram_join_brute_force(spark, width, percent):
    rows = near_docs(width)
    sets = {i: shingle_set(t, width) for i, t in rows}
    comp = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= percent * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    got = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), width=width, percent=percent).collect()
    assert {r.doc_id: r.component_id for r in got} == comp
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(s) for i, s in sets.items()}


def test_ngram_join_odd_rows(docs):
    out = ngram_join.ngram_join(docs).collect()
    assert len(out) == docs.count()
    assert all(r.component_id == r.doc_id for r in out if r.n_shingles == 0)
    assert ngram_join.ngram_join(docs.limit(0)).count() == 0


@pytest.mark.parametrize("percent,small", [(90, 9), (90, 28), (80, 13)])
@pytest.mark.parametrize("block", [2, 3, 100])
def test_cross_pairs_of_odd_totals(spark, percent, small, block):
    # sets that lie in one another, tokens at every position, components of several sets, and a token of a few rows
    rows = [(k, pos, small + k % 2, k, k if k < 8 else 0) for k, pos in enumerate([0, 0, 1, 1, 1, 2, 2, 2, 3, 3, 3])]
    near = bytes([small]) + bytes(ngram_join.small_slots(percent) - 1)
    table = [(7, *r) for r in rows] + [(8, k, 0, small, k, k) for k in (20, 21)]
    df = spark.createDataFrame(table, "token long, k long, pos int, n int, rep long, comp long")
    sketches = spark.createDataFrame([(r, near) for r in {x[4] for x in table}], "rep long, small binary")
    most = lambda t: t - 2 * -(-percent * t // (100 + percent))
    want = {(i, j) for _, p, n, i, c in rows for _, q, m, j, d in rows if i < j and c != d and p + q <= most(n + m) and 100 * min(n, m) >= percent * max(n, m)}
    assert want and {(r.a, r.b) for r in ngram_join._cross_pairs(df, sketches, percent, block).collect()} == want | {(20, 21)}


def test_prefixes_of_linked_sets_meet_under_every_order():
    rng = np.random.default_rng(4)
    for _ in range(200):
        n, percent = int(rng.integers(1, 60)), int(rng.choice([80, 90]))
        x = rng.integers(0, 2**63, n).astype(np.uint64)
        y = x.copy()
        y[rng.integers(0, n, int(rng.integers(0, 4)))] = np.uint64(rng.integers(0, 2**63))
        y = np.unique(y)
        both = len(np.intersect1d(x, y))
        if 100 * both < percent * (len(x) + len(y) - both):
            continue
        parts = []
        for s in (x, y):
            p = ngram_join.prefix_length(len(s), percent)
            parts.append(b"".join((ngram_join.mix(np.sort(ngram_join.mix(s, o)), 9) >> np.uint64(32))[:p].astype("<u4").tobytes() for o in (1, 2)))
        assert ngram_join.shares_prefix(*parts, len(x), len(y), percent, 2)
        assert ngram_join.sketch_distance(*(np.frombuffer(ngram_join.sketch(s), np.uint8)[None] for s in (x, y)))[0] <= ngram_join.most_apart(len(x) + len(y), percent)


def test_ngram_join_rows_of_one_id(spark):
    a, b = LONG, LONG.upper().replace("W", "v")
    rows = [(1, a), (1, b), (2, b + " t"), (3, a + " t"), (4, "x " + LONG[60:]), (1, a)]
    got = {(r.doc_id, r.component_id) for r in ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4)}


@pytest.mark.parametrize("block", [2, 5])
def test_ngram_join_of_hot_tokens(spark, block):
    # all texts share a start; one group of near copies, two pairs, and others
    rng = np.random.default_rng(6)
    words = lambda n: [f"y{x}" for x in rng.integers(0, 10**6, n)]
    start, base, pairs = words(40), words(200), [words(200), words(200)]
    texts = [start + base[:k] + ["z"] + base[k + 1 :] for k in range(30)] + [start + p[:k] + ["z"] + p[k + 1 :] for p in pairs for k in (3, 90)] + [start + words(200) for _ in range(10)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()}
    assert got == {i: 0 if i < 30 else i - i % 2 if i < 34 else i for i in got}


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 51), (52, 51), (60, 60), (None, 1)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(edges, "a", "b").collect()}
    assert got == {i: 0 for i in range(31)} | {50: 50, 51: 50, 52: 50}


def test_compact_windows_brute_force():
    rng = np.random.default_rng(0)
    for n in (3, 10, 40):
        v, width = rng.integers(0, 15, n).astype(np.uint64), 4
        found = substring_dedup.compact_windows(v, width)
        for lo in range(n):
            for hi in range(lo + width - 1, n):
                low = v[lo : hi + 1].min()
                assert any(x <= lo and hi <= y and v[c] == low for x, c, y in found), (lo, hi)


def test_repeated_passages(spark):
    rng = np.random.default_rng(1)
    words = lambda n: [f"q{x}" for x in rng.integers(0, 10**6, n)]
    passage = words(60)
    edited = list(passage)
    edited[30] = "edited"
    rows = [(1, words(80) + passage + words(30)), (2, words(10) + passage + words(90)), (3, words(40) + edited), (4, words(200)), (5, passage[:40] + words(100)), (7, words(20))]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows] + [(6, None), (8, ""), (9, " ".join(rows[3][1]))], "doc_id long, text string")
    got = {(r.doc_id, r.start, r.n_words, r.match_id) for r in substring_dedup.repeated_passages(df).collect()}
    assert got - {(3, 40, 60, 2)} == {(2, 10, 60, 1), (3, 40, 60, 1), (9, 0, 200, 4)}  # the edited one may match either
    left = {r.doc_id: r.text for r in substring_dedup.drop_passages(df).collect()}
    assert left[2].split() == rows[1][1][:10] + rows[1][1][70:] and left[1] == " ".join(rows[0][1]) and left[6] is None and left[9] == ""
    assert substring_dedup.repeated_passages(df.limit(0)).count() == 0


def passages_of(a, b):
    wa, wb = substring_dedup.word_hashes([" ".join(a), " ".join(b)])
    return substring_dedup.passages(wa, wb, 5, 50, 80)


def test_passage_with_a_phrase_repeated_elsewhere():
    passage, phrase, other = LONG.split()[:80], LONG.split()[36:44], [f"o{i}" for i in range(40)]
    a, b = [*phrase, *other, *phrase, *passage, *phrase], [*(w.upper() + "n" for w in other[:9]), *phrase, *(w + "n" for w in other[20:]), *passage]
    assert passages_of(a, b) == [(56, 80, 37, 80)]
    assert passages_of(["x"] * 300, ["y"] + ["x"] * 200) == [(0, 200, 1, 200)]


@pytest.mark.parametrize("edits", [(49, 50), (40, 43), (30,), (20, 21, 22), (25, 60), (10, 11, 50, 51), (2, 48, 49), (30, 33, 36, 39, 42)])
def test_near_passages_brute_force(edits):
    words = LONG.split()
    for size in (58, 75, 100):
        for gone in (False, True):
            a, b = words[:size], [w if k not in edits else f"e{k}" for k, w in enumerate(words[:size])]
            if gone:
                del b[edits[0]]
            a, b = ["p", "q", *a, "r"], ["s", *b, "t", "u"]
            sa, sb = [list(zip(*(w[k:] for k in range(5)))) for w in (a, b)]
            hits = [(sa.index(x), k) for k, x in enumerate(sb) if x in sa]
            want = set()
            for x, y in hits:
                for p, q in hits:
                    if q - y >= 45 and p - x >= 45:
                        u, v = set(sa[x : p + 1]), set(sb[y : q + 1])
                        if 100 * len(u & v) >= 80 * len(u | v):
                            want |= set(range(y, q + 5))
            assert {k for _, _, y, m in passages_of(a, b) for k in range(y, y + m)} == want, (size, gone)


def test_passage_of_two_among_boilerplate_of_many(spark):
    rng = np.random.default_rng(2)
    words = lambda n: [f"q{x}" for x in rng.integers(0, 10**6, n)]
    common = words(45)
    rows = [(i, words(20) + common + words(20)) for i in range(20)]
    for k in range(40):
        size = (50, 55, 60)[k % 3]
        before, after = words(k % (size - 44)), words(size - 45 - k % (size - 44))
        rows += [(100 + 2 * k + n, words(20) + before + common + after + words(20)) for n in (0, 1)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = {(r.doc_id, r.match_id) for r in substring_dedup.repeated_passages(df).collect()}
    assert {(101 + 2 * k, 100 + 2 * k) for k in range(40)} <= got


def test_chat_round_trip(spark):
    said = "<|im_end|><\\|im_start|> <|image|>\\ <"
    rows = [(1, 1, "user", said), (1, 2, "assistant", said), (1, 2, "assistant", None), (2, 0, None, "é"), (2, 1, "a\n\\b<|", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat_format.read_back(chat_format.format_turns(df)).collect()}
    assert out[1].n_turns == 3 and out[1].loss_chars == len(said) and out[2].loss_chars == 0
    for t in (said, "<|", "<\\\\|", "|<"):
        assert chat_format.unescape(chat_format.escape(t)) == t and "<|" not in chat_format.escape(t)
    assert chat_format.unescape_role(chat_format.escape_role("a\n\\n<|")) == "a\n\\n<|"
    assert chat_format.read_back(chat_format.format_turns(df.limit(0))).count() == 0


def test_chat_parts():
    parts = [{"type": "text", "text": "a<"}, {"type": "text", "text": "|b"}, {"type": "image", "ref": "i", "width": 57, "height": 28}, {"type": "audio", "ref": "s", "seconds": 2.0}, {"type": "document", "ref": "d", "pages": 3}]
    out = chat_format.format_turn("assistant", parts, ("assistant",))
    assert out["formatted"] == "<|im_start|>assistant\na<\\|b<|image|><|audio|><|document|><|im_end|>\n"
    assert [(a["kind"], a["ref"], a["tokens"]) for a in out["attachments"]] == [("image", "i", 3), ("audio", "s", 50), ("document", "d", 768)]
    assert all(out["formatted"][a["at"] :].startswith(f"<|{a['kind']}|>") for a in out["attachments"]) and out["expanded_tokens"] == 821
    with pytest.raises(ValueError):
        chat_format.format_turn("user", [{"type": "video"}], ())


def test_url_aliases(spark):
    link = '<link href="{}" rel="canonical">'
    pages = [(1, "http://A.example.com/en/1", ""), (2, "http://x.test/1", link.format("https://a.example.com/en/1")), (3, "http://x.test/2", '<meta http-equiv="refresh" content="0; url=/1">'), (4, "http://x.test/3", None), (5, None, None), (6, "nothing", ""), (7, "http://b.example.com/en/8", link.format("http://x.test/9")), (8, "http://x.test/8", link.format("http://x.test/9")), (9, "http://x.test/8", "")]
    redirects = spark.createDataFrame([("http://x.test/3", "http://x.test/2#f")], "source_url string, target_url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), Q.URL_RULES, redirects).collect()}
    assert got == {1: ("com/en/", "block"), 2: (None, "block"), 3: (None, "block"), 4: (None, "block"), 5: (None, "allow"), 6: (None, "allow"), 7: ("com/en/", "block"), 8: (None, "block"), 9: (None, "block")}
    pages[6] = (7, "http://example.com/en/7", pages[6][2])
    allowed = {r.page_id: r.verdict for r in url_filter.filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), Q.URL_RULES).collect()}
    assert allowed[7] == allowed[8] == "allow"


def test_url_rules_of_the_contract(spark):
    """Each rule's word on its host, a subdomain and a longer path; net/de/ allows, and example.net/de/8 within it blocks."""
    want = {
        "http://com/en/1": ("com/en/", "block"), "http://a.example.com/en/1": ("com/en/", "block"), "http://example.com/en/70": ("example.com/en/7", "allow"),
        "http://net/de/": ("net/de/", "allow"), "http://A.Example.NET/de/7": ("net/de/", "allow"), "http://a.example.net/de/81": ("example.net/de/8", "block"),
        "http://b.net/de/8": ("net/de/", "allow"), "http://c.org/es/1": ("org/es/", "block"), "http://c.org/de/1": (None, "allow"), "http://xnet/de/1": (None, "allow"),
    }
    pages = spark.createDataFrame([(k, u, None) for k, u in enumerate(want)], "page_id long, url string, html string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(pages, Q.URL_RULES).collect()}
    assert got == dict(enumerate(want.values()))


@pytest.mark.parametrize("seed", range(3))
def test_url_aliases_of_random_graphs(spark, seed):
    """Verdicts against a union-find over redirects and links; explicit allow goes before block in a class."""
    rng = np.random.default_rng(seed)
    hosts = ["a.com", "b.net", "example.com", "c.org", "d.test", "e.test"]
    urls = [f"http://{hosts[rng.integers(6)]}/{('en', 'de', 'es', 'x')[rng.integers(4)]}/{k}" for k in range(80)] + ["http://example.com/en/7", "http://example.com/en/70"]
    pick = lambda: urls[rng.integers(len(urls))]
    links = [(urls[i], pick(), rng.integers(3)) for i in rng.choice(len(urls), 45, replace=False)]
    html = {u: f'<link rel="canonical" href="{v}">' if kind == 0 else f'<meta http-equiv="refresh" content="1; url={v}">' for u, v, kind in links if kind < 2}
    redirects = [(u, v) for u, v, kind in links if kind == 2] + [(None, urls[0]), (urls[1], None), (urls[2], urls[2])]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    name = lambda u: u.split("://")[1]
    for u, v in [(u, v) for u, v, _ in links]:
        parent[root(name(u))] = root(name(v))

    def own(u):
        host, path = name(u).split("/", 1)
        fits = [(len(r.name), r.verdict) for r in Q.URL_RULES if (host == r.host or host.endswith("." + r.host)) and ("/" + path).startswith(r.path)]
        return max(fits)[1] if fits else None

    members = {}
    for x in list(parent):
        members.setdefault(root(x), []).append(own("http://" + x))

    def verdict(u):
        said = members.get(root(name(u)), [])
        return own(u) or ("block" if "block" in said and "allow" not in said else "allow")

    rows = [(k, u, html.get(u), u, "n", "c") for k, u in enumerate(urls)] + [(0, urls[0], html.get(urls[0]), "", "", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, node string, component string")
    edges = spark.createDataFrame(redirects, "source_url string, target_url string")
    got = [(r.page_id, r.verdict) for r in url_filter.filter_urls(pages, Q.URL_RULES, edges).collect()]
    assert sorted(got) == sorted([(k, verdict(u)) for k, u in enumerate(urls)] + [(0, verdict(urls[0]))])
    assert {"block", "allow"} == {v for _, v in got} and any(own(u) is None and verdict(u) == "block" for u in urls)
    assert url_filter.filter_urls(pages.limit(0), Q.URL_RULES, edges.limit(0)).count() == 0


def test_empty_long_and_clashing(spark, docs):
    records = spark.createDataFrame([], "record_id long, url string, at long, kind string, headers map<string,string>, payload string")
    assert warc_revisit.resolve_revisits(records).count() == 0
    turns = spark.createDataFrame([(1, k, "user", "<|x|>" * 20_000, 7, "f") for k in range(3)], "conv_id long, turn long, role string, text string, n_turns long, formatted string")
    (row,) = chat_format.read_back(chat_format.format_turns(turns)).collect()
    assert row.n_turns == 3
    found = substring_dedup.repeated_passages(docs).collect()
    assert {(r.doc_id, r.match_id, r.n_words) for r in found} >= {(10, 9, 120), (11, 9, 120)}
    assert substring_dedup.drop_passages(docs).columns == docs.columns


def test_packing(docs):
    path = Q.tokenizer_path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    rows = packing.pack(docs.coalesce(1), path, window=64, shard_docs=5).collect()
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x in texts_of(docs)}
    for i, want in ids.items():
        pieces = sorted({(p.start, p.length, p.ids_crc32, p.doc_tokens) for p in rows if p.doc_id == i})
        assert {p[3] for p in pieces} == {len(want)}
        for start, n, crc, _ in pieces:
            assert crc == zlib.crc32(np.array(want[start : start + n], "<u4").tobytes())
    assert sum(p.length for p in rows) == sum(len(ids[i]) for i, _ in texts_of(docs))
    sequences = {}
    for p in rows:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    ends = [sum(n for _, n in s) for s in sequences.values()]
    assert all(sum(n for _, n in sorted(s)[:k]) == o for s in sequences.values() for k, (o, _) in enumerate(sorted(s)))
    assert max(ends) == 64 and sum(e < 64 for e in ends) <= 1
    assert packing.pack(docs.limit(0), path).count() == 0


def bm25(seed, doc, corpus):
    """Plainly: of the seed's different terms, what each adds for doc."""
    total, d = 0.0, doc[:-1].tolist()
    for t in set(seed[:-1].tolist()):
        if tf := d.count(t):
            idf = np.log(1 + (corpus.documents - corpus.df[t] + 0.5) / (corpus.df[t] + 0.5))
            total += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(doc) / corpus.mean_length))
    return total


def plain_pack(docs, corpus, window):
    """(document, sequence) in order: the window's seed is asked until the window is full."""
    unused, out, used, sequence, seed = list(range(len(docs))), [], 0, 0, None
    while unused:
        best = max(unused, key=lambda d: (round(bm25(docs[seed], docs[d], corpus), 4), -d)) if seed is not None else unused[0]
        if seed is not None and bm25(docs[seed], docs[best], corpus) <= 0:
            best = unused[0]
        unused.remove(best)
        left, began = len(docs[best]), used == 0
        while left:
            n = min(left, window - used)
            out.append((best, sequence))
            left, used = left - n, used + n
            if used == window:
                sequence, used, began = sequence + 1, 0, True
        if began:
            seed = best if used else None
    return out


@pytest.mark.parametrize("seed", range(4))
def test_packing_brute_force(seed):
    rng = np.random.default_rng(seed)
    # skewed terms: some in nearly all documents, some in few
    docs = [np.array([*np.minimum(rng.geometric(0.05, int(rng.integers(0, 40))), 90), 0], np.uint16) for _ in range(60)]
    df = np.bincount(np.concatenate([np.unique(d[:-1]) for d in docs]).astype(int), minlength=100) + 3
    corpus = packing.Corpus(200, 23.0, df)
    want = np.array([[0 if i == j else bm25(a, b, corpus) for j, b in enumerate(docs)] for i, a in enumerate(docs)])
    assert np.allclose(packing.scores(docs, corpus), want, atol=1e-3)
    assert [(p[0], p[5]) for p in packing.Packer(64, 0).pack(docs, corpus)] == plain_pack(docs, corpus, 64)


def test_a_seed_stays_until_its_window_is_full():
    docs = [np.array([*d, 0], np.uint16) for d in ([1, 2, 3, 4], [3, 4, 5, 6], [7, 8, 9], [1, 2, 7, 8, 9])]
    corpus = packing.Corpus(4, 5.0, np.array([0, 2, 2, 2, 2, 1, 1, 2, 2, 2]))
    placed = [p[0] for p in packing.Packer(100, 0).pack(docs, corpus)]
    assert placed == [0, 1, 3, 2]


def test_corpus_counts_all_tasks(docs):
    path = Q.tokenizer_path("byte_bpe_50k.json")
    made = packing.tokenized(docs.repartition(3), path, "doc_id", "text", 0)
    b = tokens.byte_bpe(path)
    corpus = packing.corpus_of(made.where("token IS NOT NULL").select("token", "n"), b.size)
    ids = [np.frombuffer(b.encode(t or ""), "<u4") for _, t in texts_of(docs)]
    assert corpus.documents == len(ids) and corpus.mean_length == pytest.approx(np.mean([len(x) + 1 for x in ids]))
    assert (corpus.df == np.bincount(np.concatenate([np.unique(x) for x in ids]), minlength=b.size)).all()


def test_pieces_match_the_library(docs):
    path = Q.tokenizer_path("piece_bpe_32k.model")
    model = piece_encode.piece_model(path)
    got = [(r.doc_id, list(r.ids)) for r in piece_encode.encode(docs, path).collect()]
    assert sorted(map(str, got)) == sorted(str((i, model.library.encode(t or ""))) for i, t in texts_of(docs))
    back = piece_encode.decode(piece_encode.encode(docs, path), path).collect()
    assert sorted(str((r.doc_id, r.text)) for r in back) == sorted(str((i, t or "")) for i, t in texts_of(docs))


def test_decoding_matches_the_library(spark, docs):
    path = Q.tokenizer_path("piece_bpe_32k.model")
    model, rng = piece_encode.piece_model(path), np.random.default_rng(0)
    lists = [model.library.encode(t or "") for _, t in texts_of(docs)] + [[int(x) for x in rng.integers(3, 32000, int(rng.integers(0, 12)))] for _ in range(300)] + [[0xE9 + 3], [0xC3 + 3, 0xA9 + 3], []]
    got = model.decode_lists(pa.array(lists, pa.list_(pa.int32())))
    assert [x.decode() for x in got] == [model.library.decode(x) if x else "" for x in lists]
    assert model.decode_lists(pa.array([[], None, lists[5]], pa.list_(pa.int32())).slice(1)) == [None, got[5]]
    df = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert sorted((r.doc_id, r.text) for r in piece_encode.decode(df, path).collect()) == [(1, None), (2, "")]
    empty = docs.limit(0)
    assert piece_encode.encode(empty, path).count() == piece_encode.digests(empty, path).count() == piece_encode.decode(piece_encode.encode(empty, path), path).count() == 0


def test_odd_spaces_and_marks_match_the_library():
    model = piece_encode.PieceModel(Q.tokenizer_path("piece_bpe_32k.model"))
    texts = ["a b", " a  b ", "   ", "", None, "x▁y ▁", "the \n  end", "🙂🙂 日本 é!?$$$ 0641917ea", " ", "a" * 300]
    for part in (pa.array(texts), pa.array(texts).slice(3), pa.array([], pa.string()), pa.array([None], pa.string())):
        assert model.encode_texts(part).to_pylist() == [model.library.encode(t or "") for t in part.to_pylist()]


def test_unigram_viterbi_brute_force():
    model = piece_encode.PieceModel(Q.tokenizer_path("piece_bpe_32k.model"), piece_encode.UNIGRAM)

    def best(word):
        if not word:
            return 0.0
        return max((model.score[t] + best(word[n:]) for n in range(1, len(word) + 1) if (t := model.ids.get(word[:n])) is not None), default=-np.inf)

    words = ["▁the", "▁there", "▁theres", "▁at", "▁onthe"]
    for w, ids in model.encode_words(words).items():
        ids = np.frombuffer(ids, "<u4").tolist()
        assert "".join(model.pieces[i] for i in ids) == w and sum(model.score[i] for i in ids) == pytest.approx(best(w))


def test_bulk_ids_match_tokenizers(docs):
    path = Q.tokenizer_path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    t, b = Tokenizer.from_file(path), tokens.ByteBPE(path, most=3)
    t.encode_special_tokens = True
    for _, x in texts_of(docs):
        assert b.encode(x or "") == np.array(t.encode(x or "", add_special_tokens=False).ids, "<u4").tobytes()
    odd = ["", None, "a b", " a b", "a  b", "a b ", "x\ny z", "x \ny", "x\n y", "x\n\ny", "a\tb c", "a\u00a0b c", "a\u2003 b", "a\u001cb", "a\u0085b", "it's <|endoftext|> 12 b!", "é 日本 c", "a b"]
    for part in (odd, odd[::-1], odd[2:3], odd[:2], [], odd[2:3] * 3 + odd[3:5] + odd[2:3]):
        ids, ends = b.encode_texts(pa.array(part, pa.string()))
        assert [ids[x:y].tolist() for x, y in zip(ends[:-1], ends[1:])] == [t.encode(x or "", add_special_tokens=False).ids for x in part]


def test_license_scan(spark):
    mit = [w for i, w in license_scan.WORDINGS if i == "MIT"][1]
    wrapped = "/*\n" + "\n".join(" * " + line for line in textwrap.wrap(mit, 60)) + "\n */"
    gpl = license_scan._gnu("General Public License", "3").replace(". ", ".\n#\n# ")
    rows = [
        (1, "prose\nReleased under the MIT License.\nmore prose"), (2, "This work is licensed under the GNU General Public License, version 2."), (3, "He lost his driving licence in the storm."), (4, None), (5, ""),
        (6, "Licensed under the Apache License, Version 2.0, as of today."), (7, wrapped), (8, "Released under the MIT License. Also dual. Licensed under the Apache License, Version 2.0."),
        (9, "Released under the MIT License. " + "word " * 60 + "Licensed under CC BY 4.0. end"), (10, gpl), (11, "// SPDX-License-Identifier: MIT"), (12, "This work is licensed under a Creative Commons Attribution 4.0 International License."),
        (13, "Licensed under CC BY-XX 4.0."), (14, mit.replace("merge, publish", "publish") + " tail"), (15, "license " * 3000), (15, "license " * 3000), (1, "Released under the MIT License."),
    ]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, start long, license string")
    found = license_scan.license_scan(df).collect()
    got = sorted((r.doc_id, r.license, r.exact) for r in found)
    assert got == [(1, "MIT", True), (1, "MIT", True), (2, "GPL-2.0", True), (6, "Apache-2.0", True), (7, "MIT", True), (8, "Apache-2.0", True), (8, "MIT", True), (9, "CC-BY-4.0", True), (9, "MIT", True), (10, "GPL-3.0", True), (11, "MIT", True), (12, "CC-BY-4.0", True), (14, "MIT", False)]
    (edited,) = [r for r in found if r.doc_id == 14]
    assert edited.missing == ["merge"] and edited.extra == []
    assert {rows[0][1][r.start : r.end] for r in found if r.doc_id == 1 and r.start} == {"Released under the MIT License"}
    assert license_scan.license_scan(df.limit(0)).count() == 0


def test_license_versions():
    """Other versions and names than a template's are reported as such, denied notices not at all."""
    wordings = {i: t for i, t in license_scan.WORDINGS}
    gnu = license_scan._gnu
    commons = "This work is licensed under a Creative Commons {} International License."
    unnumbered = wordings["BSD-2-Clause"].replace("1. ", "").replace("2. ", "")
    cases = [
        (wordings["Apache-2.0"], "Apache-2.0"), (wordings["Apache-2.0"].replace("2.0", "1.1"), "LicenseRef-other-Apache-2.0"), (wordings["Apache-2.0"].replace("may obtain", "can obtain"), "Apache-2.0"),
        (wordings["MPL-2.0"].replace("2.0", "1.1"), "LicenseRef-other-MPL-2.0"), (gnu("General Public License", "1"), "LicenseRef-other-GPL-2.0"), (gnu("General Public License", "2"), "GPL-2.0"),
        (gnu("Lesser General Public License", "2.1"), "LGPL-2.1"), (gnu("Library General Public License", "2"), "LicenseRef-other-GPL-2.0"), (commons.format("Attribution 3.0"), "LicenseRef-other-CC-BY-4.0"),
        (commons.format("Attribution-NoDerivs 4.0"), "LicenseRef-other-CC-BY-4.0"), (commons.format("Attribution-NonCommercial 3.0"), "LicenseRef-other-CC-BY-NC-4.0"), (unnumbered, "BSD-2-Clause"),
        ("Released under the GNU General Public License (GPL), version 2", "GPL-2.0"), ("Released under the GNU General Public License, version 2.0", "GPL-2.0"), ("Released under the GNU General Public License, version 1", "LicenseRef-other-GPL-2.0"), ("Not this. Released under the MIT License.", "MIT"), ("This is not released under the MIT License.", None),
        ("It isn't licensed under the MIT License", None), ("It may not be licensed under the MIT License", None),
    ]
    scanner = license_scan.Scanner(license_scan.TEMPLATES, 3)
    for text, license in cases:
        assert [f.license for _, _, f in scanner.scan(text)] == ([license] if license else []), text


def test_license_scan_brute_force():
    """All templates at all places of all texts, with words left out and put in, against what the blocks give."""
    rng = np.random.default_rng(8)
    some = [t for k, t in enumerate(license_scan.TEMPLATES) if k % 7 == 0 or len(license_scan.words(t[1])) > 60]
    scanner = license_scan.Scanner(some, 3)
    for _ in range(60):
        parts = []
        for _ in range(int(rng.integers(1, 5))):
            w = some[rng.integers(len(some))][1].split()
            for _ in range(int(rng.integers(0, 4))):
                at = int(rng.integers(0, len(w)))
                w[at : at + int(rng.integers(0, 2))] = ["inserted"] * int(rng.integers(0, 2))
            parts += w + [f"prose{x}" for x in rng.integers(0, 9, int(rng.integers(0, 30)))]
        text = " ".join(parts)
        have = license_scan.words(text)
        every = []
        for i, want in enumerate(scanner.wording):
            most = min(3, len(want) // 8)
            for at in range(len(have)):
                # the fewest differences of want and a stretch that begins at `at`, by dynamic programming
                best = {(0, 0, 0): at}
                for k, w in enumerate(want):
                    step = {}
                    for (m, x, _), j in sorted(best.items()):
                        for skip in range(most - x + 1):
                            if j + skip < len(have) and have[j + skip] == w and (skip == 0 or k):
                                key = (m, x + skip, j + skip + 1)
                                step.setdefault(key, j + skip + 1)
                        if m < most:
                            step.setdefault((m + 1, x, j), j)
                    best = step
                first = [(m + x, j, m, x) for (m, x, j) in best]
                if first and have[at] in want[: most + 1]:
                    d, j, m, x = min(first)
                    every.append((d, len(want), at, j, i, m))
        found = [f for _, _, f in scanner.scan(text)]
        for f in found:
            assert (len(f.missing) + len(f.extra), f.first, f.end, f.template) in {(d, at, j, i) for d, _, at, j, i, _ in every}
        # whatever else fits shares words with one that fits no worse
        for d, n, at, j, i, m in every:
            assert any(f.first < j and at < f.end for f in found), (some[i], text)


def test_revisits(spark):
    rows = [(1, "http://A.test", 10, "response", {"etag": '"x"', "content-type": "t"}, "p1"), (2, "https://a.test/", 20, "response", {"last-modified": "m"}, "p2"), (3, "http://a.test/#f", 15, "revisit", {"etag": 'W/"x"', "content-type": "u", "date": "d"}, None), (4, "http://a.test/", 20, "revisit", {"etag": '"y"'}, None), (5, "http://a.test/", 200_000, "revisit", None, None), (6, "http://b.test/", 5, "revisit", {}, None), (7, None, 5, "revisit", {}, None)]
    out = {r.record_id: r for r in warc_revisit.resolve_revisits(spark.createDataFrame(rows, "record_id long, url string, at long, kind string, headers map<string,string>, payload string")).collect()}
    assert [out[i].resolution for i in range(1, 8)] == ["response", "response", "resolved", "mismatch", "resolved", "missing", "missing"]
    assert out[3].payload == "p1" and out[3].headers == {"etag": 'W/"x"', "content-type": "t", "date": "d"} and out[5].refers_to == 2 and len(out) == 7


def test_many_rows_without_a_url(spark):
    """Empty tables, clashing columns, repeated rows; rows without a key are dealt to all tasks of the joins."""
    keep = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        made = [(i, None if i % 2 else "no url", None, "x", 1) for i in range(2000)] + [(2000, "http://a.test/1", None, "x", 1)] * 2
        pages = spark.createDataFrame(made, "page_id long, url string, html string, node string, spread int")
        edges = spark.createDataFrame([("http://a.test/1", "http://com/en/1")], "source_url string, target_url string")
        judged = url_filter.filter_urls(pages, Q.URL_RULES, edges)
        assert sorted({(r.host, r.path, r.rule, r.verdict) for r in judged.where("page_id < 2000").collect()}, key=str) == [("", "", None, "allow")]
        assert [r.verdict for r in judged.where("page_id = 2000").collect()] == ["block", "block"]
        held = [r["count"] for r in judged.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert sum(held) == 2002 and max(held) < 1000
        assert url_filter.filter_urls(pages.limit(0), Q.URL_RULES, None).count() == 0

        kind = "record_id long, url string, at long, kind string, headers map<string,string>, payload string, canonical string, prior long, spread int"
        rest = ("c", 1, 1)
        first = (1, "http://a.test/", 10, "response", {"content-type": "t"}, "p", *rest)
        again = (2, "http://a.test/", 20, "revisit", None, None, *rest)
        lost = [(i, None if i % 2 else "http://a.test/", 30 if i % 2 else None, "revisit", None, None, *rest) for i in range(3, 1003)]
        out = warc_revisit.resolve_revisits(spark.createDataFrame([first, first, again, again, *lost], kind)).collect()
        assert len(out) == 1004 and {r.resolution for r in out if r.record_id > 2} == {"missing"}
        assert [(r.resolution, r.refers_to, r.payload) for r in out if r.record_id == 2] == [("resolved", 1, "p")] * 2
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
