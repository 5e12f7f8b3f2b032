import numpy as np
import pytest

from markloom.llm import embeddings as E

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, cosine=0.93):
    def sound(v, label):
        return label is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)

    n = len(rows)
    unit = [np.asarray(v, np.float32).astype(float) / np.linalg.norm(np.asarray(v, np.float32).astype(float)) if sound(v, label) else None for _, v, label in rows]
    links = [{j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine} for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        own = rows[i][0]
        out.append((own, len(links[i]) if own is not None else 0, min(ids) if own is not None else None, own is not None and own == min(ids)))
    return sorted(out, key=str)


@pytest.mark.parametrize("dim,block_bytes,plan_rows", [(64, 4 << 20, 100), (64, 4096, 0), (5, 160, 100), (1, 32, 0)])
def test_links(spark, dim, block_bytes, plan_rows, monkeypatch):
    monkeypatch.setattr(E, "PLAN_ROWS", plan_rows)
    rng = np.random.default_rng(dim + block_bytes)
    rows = []
    for k in range(30):
        centre = rng.normal(size=dim)
        for _ in range(4):
            rows.append((len(rows), (centre + rng.normal(size=dim) * rng.choice([0.05, 0.2, 0.35])).astype(np.float32).tolist(), int(k % 3)))
    first = rows[0][1]
    rows += [(900, first, 0), (901, first, 0), (901, first, 0), (902, first, 1), (903, first, None), (None, first, 0), (904, None, 0), (905, [], 0), (906, [0.0] * dim, 0), (907, [float("nan")] * dim, 0), (908, [None] * dim, 0), (909, [float("inf")] * dim, 0), (910, [2 * x for x in first], 0), (911, first + [0.5], 0)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as n_links", "2 as node", "3 as cell", "4 as h1")
    got = E.near_duplicates(spark, df, block_bytes=block_bytes).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_doubles_are_compared_as_doubles(spark):
    a, b = [1.0, 0.0], [1.0, 1e-9]
    rows = [(1, a, 0), (2, b, 0), (3, [0.93, (1 - 0.93**2) ** 0.5 * (1 + 1e-9)], 0)]
    got = E.near_duplicates(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    cos = lambda x, y: np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y)
    assert {r.vec_id: r.n_links for r in got} == {k: sum(cos(v, w) >= 0.93 for j, w, _ in rows if j != k) for k, v, _ in rows}


def test_no_rows(spark):
    assert E.near_duplicates(spark, spark.createDataFrame([], SCHEMA)).count() == 0


def test_calibration_holds_for_every_linked_pair():
    rng = np.random.default_rng(0)
    width, need = E.calibrated(64, 0.93)
    basis = E.rotation(64)
    assert np.allclose(basis @ basis.T, np.eye(len(basis)))
    for _ in range(500):
        a = rng.normal(size=64)
        a /= np.linalg.norm(a)
        b = rng.normal(size=64)
        b -= (a @ b) * a
        b = 0.93 * a + np.sqrt(1 - 0.93**2) * b / np.linalg.norm(b)
        assert (np.abs(basis @ (a - b)) <= width).sum() >= need
