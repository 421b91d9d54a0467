import numpy as np
import pytest

from larkspur.llm import embeddings as em
from larkspur.llm import queries


def brute(rows, threshold=0.98):
    n, up = [0] * len(rows), list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (_, v, a) in enumerate(rows):
        for j in range(i):
            _, w, b = rows[j]
            if a is None or a != b or len(v) != len(w):
                continue
            x, y = np.array(v, float), np.array(w, float)
            if np.isfinite(x).all() and np.isfinite(y).all() and x.any() and y.any() and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                n[i] += 1
                n[j] += 1
                up[root(i)] = root(j)
    low = {}
    for i, r in enumerate(rows):
        low[root(i)] = min(low.get(root(i), r[0]), r[0])
    return [(r[0], n[i], low[root(i)]) for i, r in enumerate(rows)]


@pytest.mark.parametrize(("labels", "dims"), [(1, 16), (3, 9)])
def test_brute_force(spark, labels, dims):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((6, dims))
    rows = []
    for k in range(700):
        c = centres[k % 6] + rng.standard_normal(dims) * (0.06 if k % 3 else 0.8)
        rows.append((1000 - k, [float(np.float32(x)) for x in c * rng.choice([0.01, 1, 500])], int(k % labels)))
    rows += [(2000, rows[0][1], rows[0][2]), (2001, rows[0][1], rows[0][2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumnRenamed("x", "x")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in em.embedding_links(df).collect()}
    want = {k: (n, c) for k, n, c in brute(rows)}
    links = sum(n for n, _ in want.values())
    assert all(got[k][0] <= want[k][0] for k in want)
    assert sum(n for n, _ in got.values()) >= 0.99 * links > 0
    assert sum(got[k][1] != want[k][1] for k in want) <= 0.01 * len(want)


@pytest.mark.parametrize("per_cell", [256, 4])
def test_query_against_brute_force(spark, tmp_path, monkeypatch, per_cell):
    """Planted partners at and around the threshold, through the registered query; with coarse and with fine grids."""
    monkeypatch.setattr(em, "PER_CELL", per_cell)
    rng, rows = np.random.default_rng(5), []
    for k in range(400):
        v = rng.standard_normal(64)
        rows.append((len(rows), v, k % 2))
        for cosine in rng.uniform(0.97, 1, k % 4):
            side = rng.standard_normal(64)
            side -= (side @ v) / (v @ v) * v
            rows.append((len(rows), cosine * v / np.linalg.norm(v) + (1 - cosine**2) ** 0.5 * side / np.linalg.norm(side), k % 2))
    rows = [(i, [float(np.float32(x)) for x in v], label) for i, v, label in rows]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r["vec_id"]: r for r in queries.op2_embedding_dedup(spark, str(tmp_path)).collect()}
    want = brute(rows)
    assert len(got) == len(rows) and all(got[k]["n_links"] <= n for k, n, _ in want)
    assert sum(r["n_links"] for r in got.values()) >= 0.995 * sum(n for _, n, _ in want) > 400
    assert sum(got[k]["component_id"] != c for k, _, c in want) <= 0.005 * len(want)
    assert all(r["kept"] == (k == r["component_id"]) for k, r in got.items())


def test_repeated_ids(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [1.0, 0.01], 1), (3, [0.01, 1.0], 1), (3, [0.01, 1.0], 1), (9, [0.0, 1.0], 2)]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in em.embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == sorted(brute(rows)) == [(1, 1, 1), (1, 2, 1), (2, 1, 1), (3, 2, 1), (3, 2, 1), (9, 0, 9)]


def test_many_lengths(spark, monkeypatch):
    """Every length of vectors has grids of its own where it needs them."""
    monkeypatch.setattr(em, "PER_CELL", 8)
    rng, rows = np.random.default_rng(2), []
    for size in range(1, 14):
        centres = rng.standard_normal((10, size))
        rows += [(len(rows) + k, [float(x) for x in centres[k % 10] * (1 + rng.random() * 0.01) + rng.standard_normal(size) * 0.02], 1) for k in range(50)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in em.embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    want = brute(rows)
    assert sum(n for n, _ in got.values()) >= 0.99 * sum(n for _, n, _ in want) and all(got[k][0] <= n for k, n, _ in want)


def test_strange_vectors(spark):
    v, nan, inf = [1.0, 2.0], float("nan"), float("inf")
    rows = [(1, v, 1), (2, [2.0, 4.0], 1), (3, v, 2), (4, v, None), (5, None, 1), (6, [0.0, 0.0], 1), (7, [nan, 1.0], 1), (8, [inf, 1.0], 1), (9, [None, 1.0], 1), (10, [], 1), (11, [1.0, 2.0, 0.0], 1), (12, v, 1), (13, [1e-40, 2e-40], 1), (None, v, 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, size string")
    got = {r["vec_id"]: tuple(r)[1:] for r in em.embedding_links(df).collect()}
    assert len(got) == len(rows)
    assert got[1] == (3, 1, True) and got[12] == (3, 1, False) and got[2] == (3, 1, False)
    for k in (3, 4, 5, 6, 7, 8, 9, 10, 11):
        assert got[k] == (0, k, True), k
    assert got[None] == (0, None, False)
    assert em.embedding_links(df.limit(0)).count() == 0


def test_crowded_cell(spark, monkeypatch):
    """A group much larger than a chunk is compared chunk by chunk and loses nothing."""
    monkeypatch.setattr(em, "CHUNK", 64)
    rng = np.random.default_rng(1)
    base = rng.standard_normal(12)
    rows = [(k, [float(x) for x in base + rng.standard_normal(12) * 0.01], 1) for k in range(400)]
    got = em.embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert all(r["n_links"] == 399 and r["component_id"] == 0 for r in got)


def test_traversal_is_ordered():
    rng = np.random.default_rng(0)
    first, second = rng.random((9, 7)), rng.random((9, 5))
    rows, cells = em.traverse(first, second, 0.9)
    for k in range(9):
        a, b, own = first[k], second[k], cells[rows == k]
        sums = [a[c // 5] + b[c % 5] for c in own]
        assert sums == sorted(sums) and set(own) == {i * 5 + j for i in range(7) for j in range(5) if a[i] + b[j] <= 0.9}
