import math

import numpy as np
import pytest

import gneiss.llm.lattice_dedup as lattice
import gneiss.llm.voronoi_topk as voronoi
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int, node string, cell int"


def vectors(seed, n=400, d=12):
    rnd = np.random.default_rng(seed)
    centre = rnd.standard_normal((40, d))
    x = centre[rnd.integers(0, 40, n)] + rnd.choice([0, 0.02, 0.05, 1], n)[:, None] * rnd.standard_normal((n, d))
    rows = [(int(i), [float(np.float32(v)) for v in x[i] / np.linalg.norm(x[i])], int(i % 3), "x", 1) for i in range(n)]
    bad = [(1000, None, 0), (1100, [], 0), (1200, [1.0, None] + [0.0] * (d - 2), 1), (1300, [math.nan] * d, 1), (1400, [math.inf] * d, 1), (None, rows[0][1], 0), (1500, [0.0] * d, 0), (1600, [1.0, 2.0], 1), (1700, [1.0, 2.0], 1), (1800, rows[5][1], None), (200, rows[200][1], rows[200][2]), (1900, rows[0][1], 0), (2000, rows[0][1], 0)]
    return rows + [(*b, "x", 1) for b in bad]


def usable(v):
    return v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v)


@pytest.mark.parametrize("block,pivots", [(8192, 64), (16, 5)])
def test_top_k_against_brute_force(spark, monkeypatch, block, pivots):
    monkeypatch.setattr(voronoi, "BLOCK", block)
    monkeypatch.setattr(voronoi, "QUERIES", block)
    rows = vectors(1)
    got = voronoi.top_inner(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0, k=10, pivots=pivots).collect()
    whole = [(i, [math.floor(1024 * float(np.float32(c))) for c in v]) for i, v, *_ in rows if i is not None and usable(v)]
    want = set()
    for q in {i for i, _ in whole if i % 50 == 0}:
        best = {}
        for _, a in [w for w in whole if w[0] == q]:
            for i, b in whole:
                if i != q and len(a) == len(b):
                    s = sum(x * y for x, y in zip(a, b))
                    best[i] = max(s, best.get(i, s))
        for r, (i, s) in enumerate(sorted(best.items(), key=lambda t: (-t[1], t[0]))[:10]):
            want.add((q, r + 1, i, s))
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got} == want and len(got) == len(want)


def test_top_k_with_many_rows_of_one_id(spark):
    x = np.random.default_rng(4).standard_normal((40, 4)).round(2)
    x[0], x[7] = (10, 0, 0, 0), (4, 0, 0, 0)
    rows = [(i, x[i].tolist(), 0, "", 0) for i in range(40) for _ in range({0: 20, 7: 25}.get(i, 1))]
    got = voronoi.top_inner(spark.createDataFrame(rows, SCHEMA), F.col("vec_id").isin(0, 3), k=10, pivots=83).collect()
    whole = [[math.floor(1024 * float(np.float32(c))) for c in v] for v in x]
    want = set()
    for q in (0, 3):
        best = {i: sum(a * b for a, b in zip(whole[q], whole[i])) for i in range(40) if i != q}
        want |= {(q, r + 1, i, s) for r, (i, s) in enumerate(sorted(best.items(), key=lambda t: (-t[1], t[0]))[:10])}
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got} == want and len(got) == 20


def test_top_k_of_empty_tables_and_large_components(spark):
    assert voronoi.top_inner(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 50 == 0).count() == 0
    rows = [(0, [3e18, 1.0], 0, "", 0), (1, [2e15, -1.0], 0, "", 0), (2, [1e-9, -1e-9], 0, "", 0)]
    got = voronoi.top_inner(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 0).collect()
    assert [(r.rank, r.vec_id) for r in got] == [(1, 1), (2, 2)] and got[0].score == 2**63 - 1


def test_bounds_hold():
    rnd = np.random.default_rng(2)
    x, q = rnd.standard_normal((500, 6)) + 3, rnd.standard_normal((20, 6)) * 2
    p = voronoi.Pivots([x[i] for i in range(12)])
    cell, distance = p.nearest(x)
    assert (cell == ((x[:, None] - p.of(6)[1]) ** 2).sum(axis=2).argmin(axis=1)).all()
    least, most, norm = (np.array([f(v[cell == c]) for c in range(12)]) for f, v in ((np.min, distance), (np.max, distance), (np.max, np.linalg.norm(x, axis=1))))
    above = voronoi.bounds(q, p.of(6)[1], least, most, norm)
    sure = voronoi.guaranteed(q, p.of(6)[1], [np.sort(distance[cell == c])[:6] for c in range(12)], 5)
    for i in range(20):
        score = x @ q[i]
        assert (score <= above[i][cell]).all() and np.sort(score)[-6] >= sure[i] - 1e-9


def test_pairs_looked_at_in_clustered_data(spark, monkeypatch):
    monkeypatch.setattr(voronoi, "SHELL", 20)
    rnd = np.random.default_rng(9)
    centre = rnd.standard_normal((50, 16))
    x = centre[rnd.integers(0, 50, 3000)] + 0.08 * rnd.standard_normal((3000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows, seen = [(i, v.tolist(), 0, "", 0) for i, v in enumerate(x)], {}
    got = voronoi.top_inner(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0, k=10, looked_at=seen).collect()
    whole = np.floor(1024 * x.astype(np.float32).astype(np.float64))
    for i in range(0, 3000, 50):
        score = whole @ whole[i]
        score[i] = -np.inf
        assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == i] == np.lexsort((np.arange(3000), -score))[:10].tolist()
    print("share of pairs looked at", seen["pairs"] / seen["all"])
    assert seen["pairs"] < 0.3 * seen["all"]


def test_lattice_points_are_nearest():
    assert lattice.SHORTEST.shape == (240, 8) and len(np.unique(lattice.SHORTEST, axis=0)) == 240
    y = np.random.default_rng(1).uniform(-4, 4, (3000, 8))
    point = lattice.decode(y)
    assert (np.isclose(point % 1, 0).all(axis=1) | np.isclose(point % 1, 0.5).all(axis=1)).all() and (np.rint(point.sum(axis=1)) % 2 == 0).all()
    assert (((y - point) ** 2).sum(axis=1) <= 1 + 1e-9).all()
    assert ((y - point) @ lattice.SHORTEST.T <= 1 + 1e-9).all()


def links(rows, threshold):
    good = [(k, np.array(r[1], dtype=np.float64), r[2]) for k, r in enumerate(rows) if usable(r[1]) and any(r[1]) and r[2] is not None]
    out = {k: set() for k in range(len(rows))}
    for a, x, l in good:
        for b, y, m in good:
            if a != b and l == m and len(x) == len(y) and x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= threshold:
                out[a].add(b)
    return out


@pytest.mark.parametrize("crowd,block,many", [(2048, 2048, 1 << 26), (2, 3, 1 << 26), (4, 3, 1)])
def test_near_vectors_against_brute_force(spark, monkeypatch, crowd, block, many):
    monkeypatch.setattr(lattice, "CROWD", crowd)
    monkeypatch.setattr(lattice, "BLOCK", block)
    rows = vectors(3)
    got = lattice.near_vectors(spark.createDataFrame(rows, SCHEMA), many=many).collect()
    want = links(rows, 0.98)
    up = list(range(len(rows)))
    for a in want:
        for b in want[a]:
            x, y = up[a], up[b]
            if x != y:
                up = [x if u == y else u for u in up]
    head = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            head[up[k]] = min(head.get(up[k], r[0]), r[0])
    key = lambda t: tuple(-1 if v is None else v for v in t)
    expect = sorted((key((r[0], len(want[k]), head.get(up[k]), r[0] == head.get(up[k]))) for k, r in enumerate(rows)))
    assert sorted(key((r.vec_id, r.n_links, r.component_id, r.kept)) for r in got) == expect
    assert lattice.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def pairs_at(cosine, n, d, seed):
    rnd = np.random.default_rng(seed)
    a = lattice._unit(rnd.standard_normal((n, d)))
    side = rnd.standard_normal((n, d))
    side = lattice._unit(side - (side * a).sum(axis=1, keepdims=True) * a)
    return a, cosine * a + math.sqrt(1 - cosine**2) * side


@pytest.mark.parametrize("codes", [2, 3])
def test_recall_of_pairs_at_the_threshold(codes):
    for d in (16, 64, 384):
        a, b = pairs_at(0.9805, 1000, d, 5)
        label = np.zeros(1000, dtype=np.int64)
        x, y = (lattice.buckets(v, label, codes=codes) for v in (a, b))
        found = np.array([len(np.intersect1d(p, q)) > 0 for p, q in zip(x, y)]).mean()
        strangers = np.array([len(np.intersect1d(p, q)) > 0 for p, q in zip(x, np.roll(x, 1, axis=0))]).mean()
        assert found >= 0.98 and strangers < 0.01


def test_links_found_end_to_end(spark):
    a, b = pairs_at(0.981, 1500, 48, 6)
    rows = [(i, v.tolist(), 0, "", 0) for i, v in enumerate(np.concatenate((a, b)))]
    got = {r.vec_id: r for r in lattice.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sum(got[i + 1500].component_id == i for i in range(1500)) >= 0.98 * 1500


def test_largest_bucket_grows_slower_than_the_table():
    rnd = np.random.default_rng(7)
    most = []
    for n in (20_000, 320_000):
        x, seen = lattice._unit(rnd.standard_normal((n, 32))), []
        for i in range(0, n, 20_000):
            seen.append(lattice.buckets(x[i : i + 20_000], np.zeros(min(20_000, n), dtype=np.int64), tables=1))
        most.append(np.unique(np.concatenate(seen), return_counts=True)[1].max())
    assert most[1] < 8 * most[0] and most[1] < 100


def test_a_dense_group_larger_than_a_bucket(spark, monkeypatch):
    monkeypatch.setattr(lattice, "CROWD", 50)
    monkeypatch.setattr(lattice, "BLOCK", 64)
    rnd = np.random.default_rng(8)
    x = np.concatenate((lattice._unit(np.ones((400, 24)) + 0.02 * rnd.standard_normal((400, 24))), lattice._unit(rnd.standard_normal((100, 24)))))
    got = {r.vec_id: r for r in lattice.near_vectors(spark.createDataFrame([(i, v.tolist(), 0, "", 0) for i, v in enumerate(x)], SCHEMA)).collect()}
    close = lattice._unit(x.astype(np.float32).astype(np.float64))
    want = (close @ close.T >= 0.98).sum(axis=1) - 1
    assert [got[i].n_links for i in range(500)] == want.tolist() and {got[i].component_id for i in range(400)} == {0}


@pytest.mark.parametrize("many", [1, 1 << 26])
def test_buckets_do_not_depend_on_the_size_of_the_table(spark, monkeypatch, many):
    asked, real = [], lattice._bucket_batches
    monkeypatch.setattr(lattice, "_bucket_batches", lambda tables, codes: asked.append(codes) or real(tables, codes))
    rows = [(i, [1.0, 0.01 * i], "a") for i in range(4)]
    got = lattice.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string"), many=many).collect()
    assert asked == [2] and {r.component_id for r in got} == {0}
