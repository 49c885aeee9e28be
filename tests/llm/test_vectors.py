"""Whitening and near-duplicate vectors against plain numpy on whole tables, and their edge cases."""

import numpy as np
import pytest
from conftest import DATA

from qasidalake.llm import near_vectors, whitening
from qasidalake.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, component string, n_links string"


def table(spark, rows):
    floats = lambda v: v if v is None else [c if c is None else float(c) for c in v]
    return spark.createDataFrame([(i, floats(v), label, "x", "y") for i, v, label in rows], SCHEMA)


def plain_whitening(rows, k=4):
    """By numpy's own eigenvectors: {id: [(component, n, deviation, whitened, explained)]}."""
    good = [(i, [int(np.floor(256 * float(np.float32(c)))) for c in v]) for i, v, *_ in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in good})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    x = np.array(fit, float) - np.array(sums) / n
    values, vectors = np.linalg.eigh(x.T @ x / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = []
    for i, own in good:
        deviation = sum((n * c - s) ** 2 for c, s in zip(own, sums))
        w = (np.array(own) - np.array(sums) / n) @ vectors[:, :k] / np.sqrt(values[:k])
        out += [(i, c + 1, n, deviation, w[c], values[c] / values.sum()) for c in range(k)]
    return out


def same_whitening(found, wanted):
    found = sorted(found, key=lambda r: (r["vec_id"], r["component"]))
    wanted.sort(key=lambda r: r[:2])
    assert [(r["vec_id"], r["component"], r["n"], r["deviation"]) for r in found] == [w[:4] for w in wanted]
    assert [r["explained"] for r in found] == pytest.approx([w[5] for w in wanted], rel=1e-9)
    for c in range(1, 5):
        a, b = (np.array(z) for z in ([r["whitened"] for r in found if r["component"] == c], [w[4] for w in wanted if w[1] == c]))
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-7
    assert len({r["identity_error"] for r in found}) == 1 and found[0]["identity_error"] < 1e-8


def test_op11_by_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding").collect()]
    same_whitening(QUERIES["op11_embedding_whitening"](spark, DATA).collect(), plain_whitening(rows))


def test_whitening_of_odd_rows(spark):
    random = np.random.RandomState(3)
    odd = [(i, [float(c) for c in random.normal(size=6) * [5, 4, 3, 2, 1, 1]], 0) for i in range(60)]
    odd += [(i + 100, odd[7][1], 1) for i in range(200)]  # copies count once in the fit list
    clean = list(odd)
    odd += [(900, None, 0), (901, [1.0, None, 1, 1, 1, 1], 0), (902, [float("nan")] * 6, 0), (903, [float("inf")] * 6, 0), (904, [], 0), (905, [1.0, 2.0], 0)]
    odd += [(odd[3][0], odd[3][1], 5)]  # a repeated row
    df = table(spark, odd)
    found = whitening.whitened_components(df).dropDuplicates(["vec_id", "component"]).collect()
    same_whitening(found, plain_whitening(clean))
    assert whitening.whitened_components(df).where(f"vec_id = {odd[3][0]}").count() == 8
    assert whitening.whitened_components(df.withColumnRenamed("vec_id", "n"), "n").columns == ["n_", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    nulls = whitening.whitened_components(df.selectExpr("if(vec_id < 100, null, vec_id) AS vec_id", "embedding"))
    assert nulls.where("vec_id IS NULL").count() == 4 * 61


def test_whitening_without_variation(spark):
    assert whitening.whitened_components(table(spark, [])).collect() == []
    assert whitening.whitened_components(table(spark, [(1, None, 0)])).collect() == []
    assert whitening.whitened_components(table(spark, [(i, [1.0, 2.0], 0) for i in range(5)])).collect() == []
    line = whitening.whitened_components(table(spark, [(i, [float(i), 2.0 * i], 0) for i in range(9)])).collect()
    assert {r["component"] for r in line} == {1} and line[0]["explained"] == pytest.approx(1)


def test_huge_entries(spark):
    found = whitening.whitened_components(table(spark, [(1, [3e38, 1.0], 0), (2, [-3e38, 2.0], 0)])).collect()
    assert [r["deviation"] for r in found] == [None, None]


def test_lanczos_restarts_and_converges():
    random = np.random.RandomState(1)
    q = np.linalg.qr(random.normal(size=(40, 40)))[0]
    for values in (np.linspace(9, 1, 40), np.r_[[7.0] * 6, [1.0] * 34], np.r_[[5.0, 3.0], np.zeros(38)], 0.5 ** np.arange(40)):
        a = (q * values) @ q.T
        passes = []

        def times(block):
            passes.append(block.shape[1])
            return a @ block

        found, vectors, residuals = whitening.block_lanczos(times, 40, 4, block=3)
        assert found == pytest.approx(np.sort(values)[::-1][:4], abs=1e-10)
        assert np.abs(vectors.T @ vectors - np.eye(4)).max() < 1e-10
        assert np.abs(a @ vectors - vectors * found).max() < 1e-9 and sum(passes) <= 40
    far = whitening.block_lanczos(lambda b: (0.2 ** np.arange(300))[:, None] * b, 300, 2, block=4)
    assert far[0] == pytest.approx([1, 0.2])


def plain_links(rows, cosine=0.98):
    """{id: (n_links, component_id)} by all pairs."""
    ids = [r[0] for r in rows]
    x = np.array([np.zeros(len(rows[0][1])) if v is None else v for _, v, *_ in rows], np.float32).astype(float)
    size = np.linalg.norm(x, axis=1)
    near = (x @ x.T) / np.outer(np.where(size > 0, size, 1), np.where(size > 0, size, 1)) >= cosine
    label = np.array([-1 if r[2] is None else r[2] for r in rows])
    near &= (label[:, None] == label) & (label >= 0)[:, None] & (size > 0) & (size > 0)[:, None]
    np.fill_diagonal(near, False)
    root = near_vectors.least_linked(near)
    least = {}
    for i, r in zip(ids, root):
        least[r] = min(i, least.get(r, i))
    return {i: (int(k), least[r]) for i, k, r in zip(ids, near.sum(axis=1), root)}


def clusters(n=700, groups=12, dims=32, seed=5):
    """Vectors in groups about the threshold, with copies, over three labels of which one holds most."""
    random = np.random.RandomState(seed)
    centres = random.normal(size=(groups, dims))
    rows = []
    for i in range(n):
        g = min(int(random.exponential(2.0)), groups - 1)
        v = centres[g] + random.normal(size=dims) * 0.14 * random.uniform(0.3, 1.2) if i % 3 else random.normal(size=dims)
        rows.append((i * 3 + 1, [float(np.float32(c)) for c in v], int(g % 5 == 1) + 2 * int(g % 7 == 3)))
    rows += [(10_000 + i, rows[1][1], rows[1][2]) for i in range(150)]
    rows += [(20_000, rows[1][1], 7), (20_001, [2 * c for c in rows[1][1]], rows[1][2]), (20_002, rows[1][1], None), (20_003, [0.0] * dims, 0), (20_004, [0.0] * dims, 0)]
    return rows


@pytest.mark.parametrize("index", [{}, {"block": 16}, {"least_pivots": 8}])
def test_links_by_all_pairs(spark, index):
    rows = clusters()
    wanted = plain_links(rows)
    found = {r["vec_id"]: r for r in near_vectors.near_vector_links(table(spark, rows), **index).collect()}
    assert set(found) == set(wanted) and sum(n for n, _ in wanted.values()) > 10_000
    assert all(r["n_links"] <= wanted[i][0] for i, r in found.items())  # none below the threshold
    if "least_pivots" not in index:
        assert {i: (r["n_links"], r["component_id"]) for i, r in found.items()} == wanted
    assert sum(r["n_links"] for r in found.values()) >= 0.9 * sum(n for n, _ in wanted.values())
    assert all(r["kept"] == (i == r["component_id"]) for i, r in found.items())


def test_op12_by_all_pairs(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    found = QUERIES["op12_embedding_near_dedup"](spark, DATA).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in found} == plain_links(rows) and len(found) == len(rows)


def test_links_of_odd_rows(spark):
    one = [1.0, 2.0, 3.0]
    rows = [(5, one, 1), (3, one, 1), (3, one, 1), (None, one, 1), (7, None, 1), (8, [1.0, None, 3.0], 1), (9, [float("nan"), 1.0, 1.0], 1), (10, [1.0, 2.0], 1), (11, [], 1), (12, [3e38, 6e37, 0.0], 2), (13, [3e38, 6e37, 0.0], 2), (None, None, None)]
    found = near_vectors.near_vector_links(table(spark, rows))
    got = sorted(((r["vec_id"] or -1, r["n_links"], r["component_id"], r["kept"]) for r in found.collect()))
    assert got == [(-1, 0, None, True), (-1, 3, 3, False), (3, 3, 3, True), (3, 3, 3, True), (5, 3, 3, False), *((i, 0, i, True) for i in range(7, 12)), (12, 1, 12, True), (13, 1, 12, False)]
    assert near_vectors.near_vector_links(table(spark, [])).collect() == []
    renamed = near_vectors.near_vector_links(table(spark, rows).drop("n_links").withColumnRenamed("vec_id", "n_links"), "n_links")
    assert renamed.columns == ["n_links_", "n_links", "component_id", "kept"] and renamed.count() == len(rows)
