from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from unbrev.llm import lattice


def vectors() -> list[tuple]:
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 16))
    rows = [list(map(float, v)) for v in base]
    rows += [[x * 3.0 for x in rows[0]], rows[1], rows[1], [x + 0.01 for x in rows[2]]]
    walk = rng.normal(size=16)
    for _ in range(25):  # a chain whose ends are far apart
        walk = walk + rng.normal(size=16) * 0.22
        rows.append(list(map(float, walk)))
    rows += [[0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] * 16, [None] + [1.0] * 15, None, []]
    rows += [[1.0, 2.0], [2.0, 4.0], [-1.0, -2.0], [1e-300] * 16, [1e300] * 16]
    out = [(i, v, i % 4) for i, v in enumerate(rows)]
    return out + [(5, rows[5], 1), (None, rows[6], 1)]


def brute(rows):
    unit = []
    for i, v, _ in rows:
        ok = i is not None and v and None not in v and np.isfinite(v).all() and any(v)
        u = np.array(v, float) / np.abs(v).max() if ok else None
        unit.append(u / np.sqrt((u**2).sum()) if ok else None)
    parent = {i: i for i, *_ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(len(rows)):
            x, y = unit[a], unit[b]
            if a != b and x is not None and y is not None and len(x) == len(y) and x @ y >= 0.95:
                links[a] += 1
                i, j = find(rows[a][0]), find(rows[b][0])
                parent[max(i, j)] = min(i, j)
    return sorted(
        (-1 if i is None else i, n, -1 if i is None else find(i)) for (i, *_), n in zip(rows, links)
    )


def test_links_equal_brute_force(spark):
    frame = spark.createDataFrame(vectors(), "vec_id bigint, embedding array<double>, label int")
    frame = frame.withColumns({c: F.lit("x") for c in ("rep", "copies", "key", "links", "component")})
    want = brute(vectors())
    for block in (4, 1000):
        got = lattice.near_vectors(frame, block_rows=block).collect()
        found = sorted(
            (-1 if r.vec_id is None else r.vec_id, r.n_links, -1 if r.component_id is None else r.component_id)
            for r in got
        )
        assert found == want
        assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in got)


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert lattice.near_vectors(none).count() == 0


def test_nearest_point_is_nearest():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 8)) * 2
    got = lattice.nearest_point(x)
    around = np.concatenate([np.zeros((1, 8)), lattice.shortest() / 2])
    best = (((x[:, None] - (got[:, None] + around[None])) ** 2).sum(-1)).argmin(1)
    assert (best == 0).all() and len(around) == 241
    doubled = np.rint(got * 2).astype(int)
    assert ((doubled % 2 == doubled[:, :1] % 2).all(1)).all() and (doubled.sum(1) % 4 == 0).all()


def test_recall_at_the_threshold():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * z
    a, b = (lattice.cell_keys(v, lattice.Hashing()) for v in (x, y))
    meet = (a == b[:, :, :1]).any((1, 2)) | (b == a[:, :, :1]).any((1, 2))
    assert meet.mean() >= 0.99
