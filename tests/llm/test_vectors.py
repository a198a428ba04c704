import math
import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from courtfold.llm import vectors
from courtfold.llm.vectors import _hadamard, embedding_groups

SCHEMA = "vec_id long, embedding array<float>, label int, node long, n string, kept int"


def brute(rows, threshold=0.93):
    links, parent = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    unit = []
    for _, v, label in rows:
        ok = label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        a = np.array(v, np.float32).astype(float) if ok else None
        unit.append(a / np.sqrt(a @ a) if ok else None)
    for i in range(len(rows)):
        for j in range(i):
            if rows[i][2] == rows[j][2] and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted((r[0], links[i], least[find(i)], least[find(i)] == r[0]) for i, r in enumerate(rows))


def cluster_rows(seed=0, d=24):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(25):
        centre = rng.normal(size=d)
        for _ in range(rng.integers(1, 12)):
            v = (centre + rng.normal(size=d) * rng.choice([0.05, 0.2, 0.3])) * rng.choice([1.0, 3.0])
            rows.append((len(rows), [float(np.float32(x)) for x in v], int(c % 3)))
    dup = rows[0][1]
    rows += [(1000 + i, dup, 0) for i in range(6)]
    rows += [(2000, None, 1), (2001, [], 1), (2002, [0.0] * d, 1), (2003, [float("nan")] * d, 1), (2004, [None] + [1.0] * (d - 1), 1), (2005, dup, None), (2006, [1.0, 2.0], 0), (2007, [2.0, 4.0], 0), (2008, [float("inf")] * d, 1)]
    return rows


@pytest.mark.parametrize("chunk", [1024, 3])
def test_links_and_groups_match_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(vectors, "CHUNK", chunk)
    rows = cluster_rows()
    frame = spark.createDataFrame([(*r, 1, "x", 0) for r in rows], SCHEMA)
    got = sorted(map(tuple, embedding_groups(frame).collect()))
    assert got == brute(rows)


def test_rotation_keeps_lengths():
    x = np.random.default_rng(1).normal(size=(5, 32))
    assert np.allclose((_hadamard(x) ** 2).sum(1), (x**2).sum(1)) and np.allclose(_hadamard(_hadamard(x)), x)


def test_recall_on_random_pairs_at_the_threshold():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(4000, 64))
    a /= np.sqrt((a * a).sum(1, keepdims=True))
    noise = rng.normal(size=a.shape)
    noise -= (noise * a).sum(1, keepdims=True) * a
    noise /= np.sqrt((noise * noise).sum(1, keepdims=True))
    b = 0.93 * a + math.sqrt(1 - 0.93**2) * noise
    args = (vectors.TABLES, vectors.FUNCTIONS, vectors.PROBES, 7)
    x, y = vectors.cross_polytope(a, *args), vectors.cross_polytope(b, *args)
    met = (x[:, :, :, None] == y[:, :, None, :]).any(axis=(1, 2, 3))
    assert met.mean() >= 0.99


def test_null_ids_and_empty_tables(spark):
    frame = spark.createDataFrame([(None, [1.0, 0.0], 1, None, None, None), (5, [1.0, 0.0], 1, None, None, None)], SCHEMA)
    assert sorted((r.vec_id or -1, r.n_links, r.component_id, r.kept) for r in embedding_groups(frame).collect()) == [(-1, 1, 5, False), (5, 1, 5, True)]
    assert embedding_groups(frame.limit(0)).count() == 0
