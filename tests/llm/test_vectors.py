import numpy as np
import pytest

from tsreduce.llm import embedding_dedup
from tsreduce.llm import queries as Q

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, least=0.95):
    """{id: (links, component)} of all pairs, for ids that name one vector."""
    good = {i: np.array(v, float) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)}
    links = {i: set() for i, _ in rows if i is not None}
    for a, x in good.items():
        for b, y in good.items():
            if a != b and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                links[a].add(b)
    low = {}
    for i in sorted(links):
        todo = [] if i in low else [i]
        while todo:
            j = todo.pop()
            if j not in low:
                low[j] = i
                todo += links[j]
    return {i: (len(links[i]), low[i]) for i in links}


def near(rng, x, cosine):
    z = rng.normal(size=len(x))
    z -= z @ x * x / (x @ x)
    return cosine * x / np.linalg.norm(x) + np.sqrt(1 - cosine**2) * z / np.linalg.norm(z)


def found(df):
    return {r.vec_id: (r.n_links, r.component_id) for r in df.collect()}


def test_transform():
    rng = np.random.default_rng(0)
    h = np.array([[1.0]])
    while len(h) < 8:
        h = np.block([[h, h], [h, -h]])
    x = rng.normal(size=(5, 8))
    assert np.allclose(embedding_dedup.hadamard(x), x @ h.T / np.sqrt(8))


def test_recall_of_single_pairs(spark):
    """Pairs at the very threshold, which no third vector helps to find, among vectors that are far apart."""
    rng = np.random.default_rng(1)
    rows = []
    for k in range(800):
        x = rng.normal(size=64)
        rows += [(2 * k, x.tolist()), (2 * k + 1, (near(rng, x, 0.9501) * rng.uniform(0.1, 9)).tolist())]
    got = embedding_dedup.near_vectors(spark.createDataFrame(rows, SCHEMA)).where("n_links = 1 AND component_id = vec_id div 2 * 2").count()
    assert got >= 0.9 * len(rows)


@pytest.mark.parametrize("how", [{}, {"few": 2, "block": 16}])
def test_groups(spark, how):
    """A large group, one whose members are mostly too far apart, chains, copies, and rows that link with nothing."""
    rng = np.random.default_rng(2)
    rows, centre = [], rng.normal(size=24)
    rows += [(i, near(rng, centre, 0.985)) for i in range(150)]
    other = rng.normal(size=24)
    rows += [(i, near(rng, other, 0.972)) for i in range(200, 320)]
    chain = [rng.normal(size=24)]
    for _ in range(6):
        chain.append(near(rng, chain[-1], 0.96))
    rows += [(400 + i, v * 3) for i, v in enumerate(chain)]
    same = rng.normal(size=24)
    rows += [(500 + i, same) for i in range(30)] + [(530, -same)]
    rows += [(600 + i, rng.normal(size=24)) for i in range(100)]
    rows += [(700 + i, rng.normal(size=3)) for i in range(4)] + [(710, [2.0]), (711, [0.5]), (712, [-1.0])]
    rows = [(i, np.asarray(v).tolist()) for i, v in rows]
    odd = [(800, None), (801, []), (802, [0.0] * 24), (803, [float("nan")] * 24), (804, [1.0, None]), (805, [float("inf"), 1.0]), (806, [1e200] * 24), (807, [1e-200] * 24)]
    got = found(embedding_dedup.near_vectors(spark.createDataFrame(rows + odd, SCHEMA), **how))
    want = brute(rows + odd[:-2])
    assert got.pop(806) == (1, 806) and got.pop(807) == (1, 806)
    assert got == want
    assert want[0][0] > 100 and 0 < want[200][0] < 110 and want[406][1] == 400 and want[529] == (29, 500)


def test_odd_rows(spark):
    x, y = [1.0, 2.0, 3.0, 4.0], [4.0, -3.0, 2.0, -1.0]
    rows = [(1, x, 0, "a"), (1, x, 0, "a"), (2, x, 1, "b"), (None, x, 1, "b"), (None, None, 1, "b"), (3, y, 2, "c"), (3, [0.0, -9.0, 0.0, 0.0], 2, "c"), (4, [8.0, -6.0, 4.0, -2.0], 3, "d")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component long, node string")
    out = sorted(map(tuple, embedding_dedup.near_vectors(df).collect()), key=str)
    assert out == sorted([(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (None, 0, None, True), (None, 0, None, True), (3, 1, 3, True), (3, 1, 3, True), (4, 1, 3, False)], key=str)
    assert embedding_dedup.near_vectors(df.limit(0)).collect() == []
    assert embedding_dedup.near_vectors(df.where("vec_id IS NULL")).count() == 2


def test_query_has_all_rows(spark, sf):
    df = Q.op11_embedding_dedup(spark, sf)
    assert df.columns == ["vec_id", "n_links", "component_id", "kept"]
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert found(df) == brute(rows)
