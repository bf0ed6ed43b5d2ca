"""op12 against all pairs of a label."""

import numpy as np
import pytest

from agrolattice.llm.embeddings import near_vectors, spherical_kmeans, unit

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, least=0.93):
    usable = [v is not None and tag is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, tag in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, v, tag) in enumerate(rows):
        for j in range(i):
            _, w, other = rows[j]
            if usable[i] and usable[j] and tag == other and len(v) == len(w):
                a, b = unit(np.array([v], float))[0], unit(np.array([w], float))[0]
                if a @ b >= least:
                    links[i], links[j] = links[i] + 1, links[j] + 1
                    root[find(i)] = find(j)
    low = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return sorted(((d, n, low.get(find(i)), d is not None and d == low.get(find(i))) for i, ((d, *_), n) in enumerate(zip(rows, links))), key=repr)


def result(spark, rows, schema=SCHEMA, **options):
    df = spark.createDataFrame(rows, schema).selectExpr("*", "'x' as node", "1 as weight", "2 as cell", "3 as dim", "4 as vec")
    return sorted(map(tuple, near_vectors(df, **options).select("vec_id", "n_links", "component_id", "kept").collect()), key=repr)


def clustered(rng, n, dim, groups, spread):
    """Some loose vectors, and groups whose members' cosines are scattered about the threshold."""
    out = list(rng.normal(size=(n, dim)))
    for size in groups:
        middle = rng.normal(size=dim)
        middle /= np.linalg.norm(middle)
        out += list(middle + rng.normal(size=(size, dim)) * spread / np.sqrt(dim))
    return [[float(x) for x in v] for v in out]


@pytest.mark.parametrize("spread", [0.05, 0.27])
def test_matches_brute_force(spark, spread):
    rng = np.random.default_rng(4)
    vs = clustered(rng, 60, 24, [40, 12, 5, 2], spread)
    rows = [(100 + i, v, i % 2) for i, v in enumerate(vs)] + [(300 + i, vs[-1], 1) for i in range(5)] + [(310, [3 * x for x in vs[-1]], 1)]
    rows += [(400, None, 1), (401, [0.0] * 24, 1), (402, [float("nan")] * 24, 1), (403, [None] + [1.0] * 23, 1), (404, vs[-1], None), (405, [], 1),
             (406, [1e300] * 24, 0), (407, [1e-300] * 24, 0), (408, [float("inf")] * 24, 0), (None, vs[-1], 1), (None, [1.0] + [0.0] * 23, 0), (409, [1.0, -0.0], 0), (410, [2.0, 0.0], 0),
             (100, vs[0], 0), (411, [float("nan")], 2)]
    # one cell compares all pairs of a label; small blocks and copies change nothing
    assert result(spark, rows, cell_rows=10_000) == brute(rows)
    assert result(spark, rows, cell_rows=10_000, block=7) == brute(rows)


def test_empty_and_floats(spark):
    assert result(spark, []) == []
    rows = [(1, [1.0, 0.5], 0), (2, [1.0, 0.5], 0), (3, [0.1, 1.0], 0)]
    assert result(spark, rows, "vec_id long, embedding array<float>, label string") == brute(rows)


@pytest.mark.parametrize("spread", [0.1, 0.25, 0.36])
def test_recall_of_cells(spark, spread):
    rng = np.random.default_rng(9)
    vs = clustered(rng, 1500, 64, [3] * 150 + [10] * 30 + [200], spread)
    rows = [(i, v, 0) for i, v in enumerate(vs)]
    u = unit(np.array(vs))
    want = ((u @ u.T) >= 0.93).sum(axis=1) - 1
    got = {r[0]: r[1] for r in result(spark, rows, cell_rows=64)}
    assert all(got[i] <= n for i, n in enumerate(want))
    assert want.sum() > 200 and sum(got.values()) >= 0.97 * want.sum()


def test_centroids():
    rng = np.random.default_rng(1)
    axes = np.eye(8)[:3]
    rows = unit(np.concatenate([a + rng.normal(size=(50, 8)) * 0.02 for a in axes]))
    centres = spherical_kmeans(rows[rng.permutation(150)], 3)
    assert np.allclose(np.linalg.norm(centres, axis=1), 1) and (centres @ axes.T).max(axis=0).min() > 0.99
