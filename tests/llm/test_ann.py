import numpy as np
import pytest

from textloom.llm import ann as A


def brute(rows, k=20):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == 8 and all(c is not None and np.isfinite(c) for c in v) and any(v):
            good[i] = min(good.get(i, v), v)
    out = []
    for q in good:
        if q % 20 == 0:
            near = sorted((-float((np.array(good[q]) * np.array(v)).sum()), i) for i, v in good.items() if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(near)]
    return out


def table(n=1500, clustered=True):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, 8)) * 0.3 + (rng.normal(size=(12, 8))[rng.integers(0, 12, n)] if clustered else 0)
    rows = [(i, x[i].tolist()) for i in range(n)]
    rows[7] = (7, rows[20][1])
    rows[9] = (9, rows[20][1])
    return rows + [(2000, None), (2020, [0.0] * 8), (2040, [float("nan")] * 8), (2060, [1.0, None] * 4), (None, [1.0] * 8), (2080, [1.0]), (2100, []), rows[40], rows[41]]


SCHEMA = "vec_id long, embedding array<double>, score string, cell string"


@pytest.mark.parametrize(("rows", "share"), [(64, None), (8192, None), (100, 1.0)])
def test_recall_and_scores(spark, rows, share, monkeypatch):
    data = table()
    if share:
        monkeypatch.setattr(A.MultiIndex, "tune", lambda self, *a: None)
    df = spark.createDataFrame([(*r, "x", "y") for r in data], SCHEMA)
    got = A.nearest(df, df.where("vec_id % 20 = 0"), rows=rows).collect()
    want = brute(data)
    truth = {(q, i): s for q, _, i, s in want}
    hits = sum((r.query_id, r.vec_id) in truth for r in got)
    assert hits >= 0.9 * len(want) and len(got) == len(want)
    assert all(truth.get((r.query_id, r.vec_id), r.score) == pytest.approx(r.score, abs=1e-12) for r in got)
    if share:
        assert {(r.query_id, r["rank"], r.vec_id) for r in got} == {w[:3] for w in want}
    for q in {r.query_id for r in got}:
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)


def test_small_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], "x", "y"), (1, [0.5, 0.5], "x", "y"), (2, [0.5, 0.5], "x", "y")], SCHEMA)
    assert [(r.query_id, r["rank"], r.vec_id) for r in A.nearest(df, df.where("vec_id = 0")).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]
    assert A.nearest(df.limit(0), df.limit(0)).count() == 0
    assert A.nearest(df.limit(1), df.limit(1)).count() == 0


def test_traversal_is_by_summed_distance():
    rng = np.random.default_rng(0)
    index = A.MultiIndex(rng.normal(size=(400, 6)), 9.0, 8)
    a, b = rng.random(8), rng.random(8)
    cells = index.traverse(a, b, 1e9)
    cost = [a[c // 8] + b[c % 8] for c in cells]
    assert cost == sorted(cost) and set(cells) == set(np.flatnonzero(index.sizes))
