import numpy as np
import pytest

from tidelane.llm import lattice as L


def brute(rows, least=0.95):
    good = [(i, d, np.array(v, float)) for i, (d, v) in enumerate(rows) if d is not None and v and None not in v]
    good = [(i, d, v / np.sqrt((v * v).sum())) for i, d, v in good if np.isfinite(v).all() and v.any()]
    links = {i: 0 for i in range(len(rows))}
    top = {d: d for d, _ in rows if d is not None}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, d, v in good:
        for j, e, w in good:
            if i != j and len(v) == len(w) and (v * w).sum() >= least:
                links[i] += 1
                p, q = sorted((find(d), find(e)))
                top[q] = p
    return sorted((d if d is not None else -1, links[i], -1 if d is None else find(d)) for i, (d, _) in enumerate(rows))


def cloud(seed, groups=25, dims=64):
    r = np.random.default_rng(seed)
    rows = []
    for _ in range(groups):
        base = r.normal(size=dims)
        for _ in range(r.integers(1, 9)):
            rows.append((len(rows), (base + r.normal(size=dims) * r.choice([0, 0.05, 0.15])).tolist()))
    return rows


def got(df):
    return sorted((-1 if r.vec_id is None else r.vec_id, r.n_links, -1 if r.component_id is None else r.component_id) for r in df.collect())


@pytest.mark.parametrize("block", [1024, 3])
def test_matches_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(L, "BLOCK", block)
    rows = cloud(3) + [(900, None), (901, [0.0] * 64), (902, [float("nan")] * 64), (903, [1.0, None]), (904, []), (905, [1.0, 2.0])]
    rows += [(906, [2.0, 4.0]), (None, [1.0, 2.0]), (0, rows[5][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert got(L.near_vectors(df)) == brute(rows)


def test_empty_and_clashing_names(spark):
    kind = "vec_id long, embedding array<float>, label int, rep int, cell string, key int"
    assert L.near_vectors(spark.createDataFrame([], kind)).count() == 0
    df = spark.createDataFrame([(7, [1.0, 0.0], 1, 1, "x", 1)] * 3, kind)
    assert got(L.near_vectors(df)) == [(7, 2, 7)] * 3


def test_lattice_points_are_nearest():
    r = np.random.default_rng(0)
    x = r.normal(size=(200, 8)) * 3
    near = L.nearest_e8(x)
    assert (np.rint(2 * near) == 2 * near).all() and (near.sum(1) % 2 == 0).all()
    around = near[:, None, :] + L.SHORTEST[None]
    assert (((x[:, None] - around) ** 2).sum(2).min(1) >= ((x - near) ** 2).sum(1) - 1e-9).all()


def test_recall_of_planted_pairs():
    r = np.random.default_rng(1)
    a = r.normal(size=(2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    o = r.normal(size=a.shape)
    o -= (o * a).sum(1, keepdims=True) * a
    o /= np.linalg.norm(o, axis=1, keepdims=True)
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * o
    hit = np.zeros(len(a), bool)
    for k in range(L.TABLES):
        p, q = (L.cells(v, k, L.BLOCKS, L.PROBES, L.WIDTH) for v in (a, b))
        hit |= (p == q[:, :1]).any(1) | (q == p[:, :1]).any(1)
    assert hit.mean() > 0.99
