"""Jaccard self-join of word shingle sets by prefix filters under several global token orders."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsreduce.llm.components import connected_components
from tsreduce.llm.shared import materialize, release
from tsreduce.llm.shingles import counted, digest, mix, shingle_sets
from tsreduce.llm.text_pairs import with_texts

#: Slots of a set's sketch. The more there are, the fewer unlike sets pass.
SKETCH = 256
#: Rows of a token that are met at once; those of a token with more are met by pairs of blocks, in as many tasks.
BLOCK = 2048
#: Pairs of rows that are looked at in one go.
AT_ONCE = 1 << 20
#: Bytes of sketches that are compared in one go.
COMPARED = 1 << 23
#: Token counts of a task are summed over so many tokens at a time.
COUNTED = 2_000_000


def least_overlap(na: int, nb: int, percent: int) -> int:
    """The smallest intersection with 100 * intersection >= percent * union."""
    return -(-percent * (na + nb) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    """Any partner shares at least ceil(percent * n / 100) tokens, so one of the first of this many."""
    return n - -(-percent * n // 100) + 1


def sketch(s: np.ndarray) -> bytes:
    """How many tokens fall in each of SKETCH slots, modulo 256. Sets that differ in d tokens have sketches at most d apart."""
    return np.bincount((s >> np.uint64(40)) & np.uint64(SKETCH - 1), minlength=SKETCH).astype(np.uint8).tobytes()


def small_slots(percent: int) -> int:
    """Slots of the sketch that rows of a token carry: 32 at 90 percent. Unlike sets are about sqrt(slots * size) apart, so where twice the differences are allowed it takes four times the slots."""
    share = lambda p: (100 - p) / (100 + p)
    return min(SKETCH, 1 << max(3, int(np.ceil(np.log2(32 * (share(percent) / share(90)) ** 2)))))


def small_sketch(sketch: bytes, slots: int) -> bytes:
    """A sketch with its slots added up to fewer, which brings sets no further apart."""
    return np.frombuffer(sketch, np.uint8).reshape(slots, -1).sum(axis=1, dtype=np.uint8).tobytes()


def sketch_distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x - y
    return np.minimum(d, -d).sum(axis=1, dtype=np.int64)


def within(sketches: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether the sketches at i and j are at most so far apart, for COMPARED bytes of pairs at a time: at 80 percent a sketch has 8 times the slots of one at 90."""
    step = max(1, COMPARED // sketches.shape[1])
    return np.concatenate([np.zeros(0, bool), *(sketch_distance(sketches[i[x : x + step]], sketches[j[x : x + step]]) <= most[x : x + step] for x in range(0, len(i), step))])


def most_apart(total, percent: int):
    """In how many tokens linked sets of so many tokens together can differ."""
    return total - 2 * (-(-percent * total // (100 + percent)))


def _sets(rows: DataFrame, width: int) -> DataFrame:
    """Of rows (id, text): (id, n, set_key) each, and (token, uses) for tokens that a task meets in two different sets or more."""

    def often(sets):
        t, n = counted(np.concatenate(sets))
        return t[n > 1].view(np.int64), n[n > 1]

    def batches(it):
        sets, held, seen = [], 0, set()
        for b in it:
            n, keys = [], []
            for s in shingle_sets(b.column("text"), width):
                n.append(len(s))
                keys.append(k := digest(s) if len(s) else None)
                if len(s) and k not in seen:
                    seen.add(k)
                    sets.append(s)
                    held += len(s)
            yield _batch(b.column("id"), n, keys, None, None)
            if held > COUNTED:
                yield _batch(b.column("id").slice(0, 0), [], [], *often(sets))
                sets, held, seen = [], 0, set()
            kind = b.column("id").slice(0, 0)
        if sets:
            yield _batch(kind, [], [], *often(sets))

    def _batch(ids, n, keys, tokens, uses):
        m = 0 if tokens is None else len(tokens)
        k = len(ids)
        ids = pa.concat_arrays([ids, pa.nulls(m, ids.type)])
        none = [None] * m
        return pa.RecordBatch.from_arrays([ids, pa.array(n + none, pa.int64()), pa.array(keys + none, pa.binary()), pa.array([None] * k + (tokens.tolist() if m else []), pa.int64()), pa.array([None] * k + (uses.tolist() if m else []), pa.int64()), pa.array([True] * k + [False] * m, pa.bool_())], ["id", "n", "set_key", "token", "uses", "is_doc"])

    return rows.mapInArrow(batches, "id long, n long, set_key binary, token long, uses long, is_doc boolean")


def frequent_tokens(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens with the highest counts (at most `most`), sorted, the level (log2) of each, and which first 20 bits occur: what ends the global orders."""
    summed = counts.groupBy("token").agg(F.sum("uses").alias("uses")).where("uses >= 4")
    top = summed.orderBy(F.desc("uses"), "token").limit(most).toArrow()
    tokens = top["token"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    known = np.zeros(1 << 20, bool)
    known[tokens >> np.uint64(44)] = True
    return tokens[order], np.minimum(np.log2(np.maximum(top["uses"].to_numpy(), 1)).astype(np.uint64), 62)[order], known


def order_keys(s: np.ndarray, frequent: tuple[np.ndarray, np.ndarray, np.ndarray], orders: int) -> list[np.ndarray]:
    """For each order, the sort keys of the tokens s: rare before frequent ones, and in each level as that order's hash has it."""
    tokens, levels, known = frequent
    level = np.zeros(len(s), np.uint64)
    at = np.flatnonzero(known[s >> np.uint64(44)])
    if len(at):
        found = np.minimum(np.searchsorted(tokens, s[at]), len(tokens) - 1)
        level[at] = np.where(tokens[found] == s[at], levels[found], np.uint64(0))
    return [(level << np.uint64(58)) | (mix(s, k + 1) >> np.uint64(6)) for k in range(orders)]


def _prefixes(rows: DataFrame, width: int, percent: int, orders: int, frequent) -> DataFrame:
    """Two kinds of rows of each set, which a task gives once for equal sets.

    (token, pos, n, id): its prefix under the first order. (id, n, sketch, small, others), where token is null: its
    sketches, and its prefixes under the other orders, each in turn as 32-bit hashes.
    """
    sent, slots = rows.sparkSession.sparkContext.broadcast(frequent), small_slots(percent)
    names = ["token", "pos", "n", "id", "sketch", "small", "others"]

    def batches(it):
        seen: set[bytes] = set()
        for b in it:
            out = []
            for i, s in zip(b.column("id").to_pylist(), shingle_sets(b.column("text"), width)):
                if not len(s) or i is None or (k := (i, digest(s)))[1] in seen:
                    continue
                if len(seen) > 300_000:
                    seen.clear()
                seen.add(k[1])
                p = prefix_length(len(s), percent)
                prefixes = []
                for o, keys in enumerate(order_keys(s, sent.value, orders)):
                    first = np.argpartition(keys, p - 1)[:p] if p < len(s) else np.arange(len(s))
                    prefixes.append(mix(s[first[np.argsort(keys[first])]], 100 + o))
                x = sketch(s)
                out.append((prefixes[0], p, len(s), i, x, small_sketch(x, slots), b"".join((z >> np.uint64(32)).astype("<u4").tobytes() for z in prefixes[1:])))
            if out:
                each = np.array([x[1] for x in out])
                m, at = int(each.sum()), lambda k, t: np.array([x[k] for x in out], t)
                none, n, ids = pa.nulls(len(out), pa.int64()), at(2, np.int32), at(3, np.int64)
                made = [
                    pa.concat_arrays([pa.array(np.concatenate([x[0] for x in out]).view(np.int64)), none]),
                    pa.array(np.concatenate([np.arange(m, dtype=np.int32) - np.repeat(np.cumsum(each) - each, each), np.zeros(len(out), np.int32)]).astype(np.int32)),
                    pa.array(np.concatenate([np.repeat(n, each), n])),
                    pa.array(np.concatenate([np.repeat(ids, each), ids])),
                    *(pa.concat_arrays([pa.nulls(m, pa.binary()), pa.array([x[k] for x in out], pa.binary())]) for k in (4, 5, 6)),
                ]
                yield pa.RecordBatch.from_arrays(made, names)

    return rows.mapInArrow(batches, "token long, pos int, n int, id long, sketch binary, small binary, others binary")


def _shared(prefixes: DataFrame) -> DataFrame:
    """The prefix rows whose token another row has too, each with its place k among them and the token's leader: the row of the lowest position."""
    columns, carried = ["token", "pos", "n", "id"], ("pos", "n", "id")
    dealt = prefixes.select(columns).repartition("token").sortWithinPartitions("token", "pos", "n", "id")

    def batches(it):
        held, lead = None, None  # the row before, if its token may be its alone; the leader of the last token and its last place
        for b in it:
            t = pa.Table.from_batches([b] if held is None else [held, b]).combine_chunks().to_batches()[0] if b.num_rows else b
            if not t.num_rows:
                continue
            token = t.column(0).to_numpy()
            head = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            start = np.repeat(head, np.diff(np.append(head, len(token))))
            place = np.arange(len(token)) - start
            leads = {c: t.column(c).to_numpy()[start] for c in carried}
            on = lead is not None and lead[0] == token[0]  # the first run has begun before
            first_run = slice(0, head[1] if len(head) > 1 else None)
            if on:
                place[first_run] += lead[2] + 1
                for c in leads:
                    leads[c][first_run] = lead[1][c]
            same = np.zeros(len(token), bool)
            same[1:] = token[1:] == token[:-1]
            keep = same.copy()
            keep[:-1] |= same[1:]
            if on:
                keep[first_run] = True
            open_ = not keep[-1]
            held = t.slice(len(token) - 1) if open_ else None
            lead = None if open_ else (token[-1], {c: v[-1] for c, v in leads.items()}, place[-1])
            out = t.filter(pa.array(keep))
            if out.num_rows:
                yield pa.RecordBatch.from_arrays([*(out.column(c) for c in columns), pa.array(place[keep]), *(pa.array(leads[c][keep]) for c in carried)], [*columns, "k", "lead_pos", "lead_n", "lead_id"])

    return dealt.mapInArrow(batches, "token long, pos int, n int, id long, k long, lead_pos int, lead_n int, lead_id long")


def _most_apart(total, percent: int):
    return total - 2 * F.ceil(percent * total / F.lit(100.0 + percent) - 1e-9)


def _may_link(na, nb, pa_, pb, percent: int):
    """If the token at these positions is the first that two sets share: what lies before it isn't shared, and they can't differ in more."""
    return (pa_ + pb <= _most_apart(na + nb, percent)) & (100 * F.least(na, nb) >= percent * F.greatest(na, nb))


def _in_blocks(rows: DataFrame, percent: int, block: int) -> DataFrame:
    """rows (token, k, pos, n, rep, comp) with lo, hi and mine: the pair of blocks of its token in which a row is met, and its own.

    Most tokens are one block. Of others a row is repeated for each pair of blocks that can hold a pair: not if both are
    of one component, or lie beyond the reach of their positions and sizes.
    """
    whole = rows.select("*", *(F.lit(0).cast("long").alias(c) for c in ("lo", "hi", "mine")))
    many = rows.where(F.col("k") == block).select("token").distinct()
    n = many.count()
    if not n:
        return whole
    # one token for each `block` rows at most; sent to all only while there are few of them
    many = F.broadcast(many) if n <= 100_000 else many
    cut = rows.join(many, "token", "left_semi").withColumn("mine", F.floor(F.col("k") / block))
    blocks = cut.groupBy("token", "mine").agg(F.min("pos").alias("at"), F.max("n").alias("n"), F.min("comp").alias("first"), F.max("comp").alias("last"))
    x, y = (blocks.select("token", *(F.col(c).alias(f"{c}_{s}") for c in ("mine", "at", "n", "first", "last"))) for s in "xy")
    largest = 2 * F.greatest("n_x", "n_y")
    reach = F.greatest(_most_apart(largest, percent), _most_apart(largest - 1, percent))
    alike = (F.col("first_x") == F.col("last_x")) & (F.col("first_y") == F.col("last_y")) & (F.col("first_x") == F.col("first_y"))
    met = x.join(y, "token").where("mine_x <= mine_y").where(~alike & (F.col("at_x") + F.col("at_y") <= reach))
    met = met.select("token", F.col("mine_x").alias("lo"), F.col("mine_y").alias("hi")).withColumn("mine", F.explode(F.array_distinct(F.array("lo", "hi"))))
    return whole.join(many, "token", "left_anti").unionByName(cut.join(met, ["token", "mine"]))


def _cross_pairs(rows: DataFrame, sketches: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """(a, b): pairs of sets (by rep) of different components that a token at these positions, sizes and small sketches allow.

    rows (token, k, pos, n, rep, comp); sketches (rep, small), which only rows of tokens of several components get. Rows of a token, or of a pair of its blocks, lie in order of component, so
    each is met with those of later components alone.
    """
    keys = ["token", "lo", "hi"]
    mixed = rows.groupBy("token").agg(F.min("comp").alias("first"), F.max("comp").alias("last")).where("first <> last").select("token")
    met = _in_blocks(rows.join(mixed, "token", "left_semi"), percent, block).join(sketches, "rep")
    dealt = met.repartition(*keys).sortWithinPartitions(*keys, "comp", "pos", "rep")

    def pairs(t: pa.RecordBatch):
        get = lambda c: t.column(c).to_numpy().astype(np.int64)
        token, lo, hi, mine, pos, n, rep, comp = map(get, [*keys, "mine", "pos", "n", "rep", "comp"])
        new_run = np.concatenate([[True], (token[1:] != token[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])
        new_comp = new_run | np.concatenate([[True], comp[1:] != comp[:-1]])

        def end(new):
            heads = np.append(np.flatnonzero(new), len(new))
            return np.repeat(heads[1:], np.diff(heads))

        begin, count = end(new_comp), end(new_run) - end(new_comp)
        if not count.any():
            return
        small = np.frombuffer(b"".join(t.column("small").to_pylist()), np.uint8).reshape(t.num_rows, -1)
        total = np.cumsum(count)
        edges = [0, *np.searchsorted(total, np.arange(AT_ONCE, int(total[-1]), AT_ONCE)).tolist(), len(count)]
        for x, y in zip(edges[:-1], edges[1:]):
            m = count[x:y]
            i = np.repeat(np.arange(x, y), m)
            j = np.arange(len(i)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(begin[x:y], m)
            most = most_apart(n[i] + n[j], percent)
            ok = (pos[i] + pos[j] <= most) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])) & ((lo[i] == hi[i]) | (mine[i] != mine[j]))
            i, j, most = i[ok], j[ok], most[ok]
            ok = within(small, i, j, most)
            i, j = i[ok], j[ok]
            if len(i):
                made = pa.table({"a": np.minimum(rep[i], rep[j]), "b": np.maximum(rep[i], rep[j])}).group_by(["a", "b"]).aggregate([]).combine_chunks()
                yield from made.select(["a", "b"]).to_batches()

    def batches(it):
        held = []  # rows of the run that isn't over: 2 * block at most, but for repeated rows
        for b in it:
            if not b.num_rows:
                continue
            last = [b.column(c)[b.num_rows - 1] for c in keys]
            t = pa.Table.from_batches([*held, b]).combine_chunks().to_batches()[0]
            open_ = np.ones(t.num_rows, bool)
            for c, v in zip(keys, last):
                open_ &= t.column(c).to_numpy() == v.as_py()
            cut = t.num_rows - int(open_.sum())
            if cut:
                yield from pairs(t.slice(0, cut))
            held = [t.slice(cut)]
        if held:
            yield from pairs(held[0])

    return dealt.mapInArrow(batches, "a long, b long").distinct()


def shares_prefix(x: bytes, y: bytes, nx: int, ny: int, percent: int, orders: int) -> bool:
    """If under each of so many orders a token of both prefixes lies early enough for sets of these sizes to link."""
    px, py, most = prefix_length(nx, percent), prefix_length(ny, percent), most_apart(nx + ny, percent)
    x, y = np.frombuffer(x, "<u4").reshape(orders, px), np.frombuffer(y, "<u4").reshape(orders, py)
    for u, v in zip(x, y):
        by = np.argsort(v, kind="stable")
        at = np.minimum(np.searchsorted(v[by], u), py - 1)
        hit = np.flatnonzero(v[by[at]] == u)
        if not len(hit) or (hit + by[at[hit]]).min() > most:
            return False
    return True


def _near(pairs: DataFrame, sets: DataFrame, percent: int, orders: int) -> DataFrame:
    """The pairs (a, b) that share an early token under all other orders too, and whose sketches leave a link possible; sets (rep, n, sketch, others)."""
    of = lambda x: sets.select(F.col("rep").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("n", "sketch", "others")))

    def batches(it):
        for b in it:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, SKETCH) for c in ("sketch_a", "sketch_b"))
                na, nb = b.column("n_a").to_numpy().astype(np.int64), b.column("n_b").to_numpy().astype(np.int64)
                ok = (sketch_distance(x, y) <= most_apart(na + nb, percent)) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))
                others = [b.column(c) for c in ("others_a", "others_b")]
                for k in np.flatnonzero(ok) if orders > 1 else ():
                    ok[k] = shares_prefix(others[0][k].as_py(), others[1][k].as_py(), int(na[k]), int(nb[k]), percent, orders - 1)
                yield b.select(["a", "b"]).filter(pa.array(ok))

    return pairs.join(of("a"), "a").join(of("b"), "b").mapInArrow(batches, "a long, b long").distinct()


def _verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link."""

    def batches(it):
        last, sa = None, None
        for b in it:
            ok, new = [], []
            of_text = b.column("text_a")
            for x in of_text:
                new.append(last is None or not x.equals(last))
                last = x
            of_a = shingle_sets((x for x, n in zip(of_text, new) if n), width)
            for n, sb in zip(new, shingle_sets(b.column("text_b"), width)):
                sa = next(of_a) if n else sa
                both = np.sort(np.concatenate([sa, sb]))
                both = int(np.count_nonzero(both[1:] == both[:-1]))
                ok.append(both > 0 and 100 * both >= percent * (len(sa) + len(sb) - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    pairs = materialize(pairs, "pairs")
    joined, named = with_texts(pairs, texts)
    out = materialize(joined.mapInArrow(batches, "a long, b long").distinct(), "links")
    release(named, pairs)
    return out


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 3, percent: int = 90, orders: int = 2, most_frequent: int = 1 << 20, block: int = BLOCK) -> DataFrame:
    """For every row of docs: id_col, n_shingles, component_id, set_rep, joining_links.

    Sets are the distinct width-word shingles of whole texts (words as ASCII white space divides them, A-Z lower-cased;
    with fewer words the whole sequence). Two rows link when 100 * intersection >= percent * union. component_id is the
    smallest id that links reach, set_rep the smallest id of an equal set, joining_links the verified links that joined
    set_rep to others, not all that it has. Rows without words, or with a null text, have 0 shingles and link with
    nothing; a null id has no component of others' either. Rows of one id are one document: where their texts differ,
    what links with one of them is linked with all. An empty table gives an empty result.

    Equal sets are one class, in each task before any shuffle. All candidates share an early prefix token under each of
    `orders` global orders, in which rare tokens come first (the most_frequent commonest ones end them, which bounds
    what is broadcast): the first order finds them, the others and the sketches filter what it finds, and exact
    comparison of whole texts follows. To build no pairs within a group, each set is met with its tokens' leaders first;
    then with the sets of other components. A token of over `block` rows is met in pairs of blocks.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    both = materialize(_sets(rows, width), "sets")
    sets = both.where("is_doc").select("id", "n", "set_key")
    frequent = frequent_tokens(both.where("NOT is_doc"), most_frequent)
    named = sets.where("set_key IS NOT NULL AND id IS NOT NULL")
    reps = named.groupBy("set_key").agg(F.min("id").alias("rep"))
    rep_of = materialize(named.join(reps, "set_key").select("id", "rep").distinct(), "reps")
    texts = rows.where("id IS NOT NULL AND text IS NOT NULL")

    prefixes = materialize(_prefixes(rows, width, percent, orders, frequent), "prefixes")
    # of the rows that tasks give for one class, those of one id
    given = prefixes.where("token IS NULL").select("id", "n", "sketch", "small", "others")
    chosen = given.select("id").distinct().join(rep_of, "id").groupBy("rep").agg(F.min("id").alias("id"))
    given = materialize(given.join(chosen, "id").drop("id"), "given")
    shared = materialize(_shared(prefixes.where("token IS NOT NULL")), "shared")
    release(prefixes)

    def by_rep(pairs):
        pairs = pairs.join(rep_of.select(F.col("id").alias("x"), F.col("rep").alias("rx")), "x").join(rep_of.select(F.col("id").alias("y"), F.col("rep").alias("ry")), "y")
        return pairs.where("rx <> ry").select(F.least("rx", "ry").alias("a"), F.greatest("rx", "ry").alias("b")).distinct()

    led = shared.where(F.col("id") != F.col("lead_id")).where(_may_link(F.col("n"), F.col("lead_n"), F.col("pos"), F.col("lead_pos"), percent))
    first = materialize(by_rep(led.select(F.col("id").alias("x"), F.col("lead_id").alias("y")).distinct()), "led")
    linked = _verified(_near(first, given, percent, orders), texts, width, percent)
    several = rep_of.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("hi")).where("a <> hi").select("id", "a")
    one_id = rep_of.join(several, "id").select("a", F.col("rep").alias("b"))
    comps = connected_components(linked.unionByName(one_id), "a", "b")

    of_id = rep_of.join(comps.select(F.col("node").alias("rep"), "component"), "rep", "left")
    of_id = of_id.select("id", "rep", F.coalesce("component", "rep").alias("comp"))
    met = materialize(shared.select("token", "k", "pos", "n", "id").join(of_id, "id").drop("id"), "met")
    second = materialize(_cross_pairs(met, given.select("rep", "small"), percent, block), "cross")
    release(shared, met)
    more = _verified(_near(second.join(first, ["a", "b"], "left_anti"), given, percent, orders), texts, width, percent)
    release(first, second, given)
    links = linked.unionByName(more)
    joined = connected_components(links.unionByName(one_id), "a", "b")
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    of_rep = reps.join(joined.select(F.col("node").alias("rep"), "component"), "rep", "left").join(degree, "rep", "left")
    out = sets.join(of_rep, "set_key", "left")
    own = F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"), F.when(F.col("id").isNotNull(), F.coalesce("rep", "id")).alias("set_rep"), F.coalesce("links", F.lit(0)).alias("joining_links"))
