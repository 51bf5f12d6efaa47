import numpy as np
from pyspark.sql import functions as F

from claimcheck.llm import common
from claimcheck.llm.common import components
from claimcheck.llm.embeddings import Tile, matches, near_vectors


def brute(rows, t):
    ok = [x is not None and l is not None and all(v is not None and np.isfinite(v) for v in x) and any(x) and len(x) > 0 for _, x, l in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    n = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= t:
                    n[i] += 1
                    n[j] += 1
                    up[max(root(i), root(j))] = min(root(i), root(j))
    return {rows[i][0]: (n[i], rows[root(i)][0]) for i in range(len(rows))}


def test_near_vectors(spark):
    rng = np.random.default_rng(1)
    rows = []
    for label in (1, 2, 2, 3):
        base = rng.normal(size=16)
        for s in (0.02, 0.05, 0.08, 0.3):
            rows += [((base + s * rng.normal(size=16)).astype(np.float32).tolist(), label) for _ in range(15)]
        rows += [(base.astype(np.float32).tolist(), label)] * 6 + [((3 * base).astype(np.float32).tolist(), label)]
    rows += [(None, 1), ([0.0] * 16, 1), ([float("nan")] * 16, 1), ([1.0] * 16, None), ([None] + [1.0] * 15, 1), ([], 1), ([1.0, 2.0], 1), ([1.0, 2.0], 1), ([1e300] * 3, 1), ([-0.0, 1.0, 0.0], 3), ([0.0, 1.0, -0.0], 3)]
    rows = [(i, x, l) for i, (x, l) in enumerate(rows)]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "vec_id long, embedding array<double>, label int, digest string, tile int")
    want = brute(rows, 0.98)
    for tile in (1024, 16):
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors(df, tile=tile).collect()}
        assert got == want
    assert near_vectors(df.limit(0)).count() == 0
    again = near_vectors(df.union(df.limit(1)).withColumn("vec_id", F.when(F.col("vec_id") != 3, F.col("vec_id"))))
    assert again.count() == len(rows) + 1 and again.where("vec_id is null and component_id is null and kept").count() == 1


def test_bound_never_loses_a_pair():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8))
    x[150:] = x[:150] + 0.14 * rng.normal(size=(150, 8))
    t = Tile([r.tobytes() for r in x], 8)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert (matches(t, t, 0.98) == (np.einsum("ik,jk->ij", t.x, t.x) >= 0.98)).all() and np.abs(u - t.x).max() < 1e-12


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, k) for k in range(1001, 1300)] + [(int(a), int(b)) for a, b in rng.integers(2000, 2300, (260, 2))] + [(5, 5)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    df = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(df).collect()}
    assert got == {x: root(x) for x in list(up)}
    assert components(df.limit(0)).count() == 0
    text = components(spark.createDataFrame([("b", "a"), ("c", "b")], "a string, b string"))
    assert {tuple(r) for r in text.collect()} == {("a", "a"), ("b", "a"), ("c", "a")}


def test_components_of_one_block_need_no_rounds(spark, monkeypatch):
    """A chain in one block is one star at once: two tables are written, whatever its length; smaller blocks need rounds and give the same."""
    made, written = [], common.written
    monkeypatch.setattr(common, "written", lambda df, name: made.append(name) or written(df, name))
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 200)] + [(i + 1, i) for i in range(0, 200)] + [(500, 499), (500, 500), (None, 1)], "a long, b long").repartition(7)
    want = {i: 0 for i in range(201)} | {499: 499, 500: 499}
    assert {r["node"]: r["component"] for r in components(edges).collect()} == want
    assert made == ["edges", "edges"]
    assert {r["node"]: r["component"] for r in components(edges, block=20).collect()} == want
    assert len(made) > 4
