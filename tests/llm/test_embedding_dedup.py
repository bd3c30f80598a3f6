import math
import random

import numpy as np
import pytest
from test_jaccard_join import root_of

from sparkrel.llm import embedding_dedup as e

SCHEMA = "vec_id long, embedding array<float>, label int, cell int, unit string"


def brute(rows):
    def unit(v):
        if not v or any(x is None or not math.isfinite(x) for x in v):
            return None
        n = math.sqrt(sum(x * x for x in v))
        return [x / n for x in v] if n else None

    u = [unit(v) for _, v, *_ in rows]
    links = []
    for a in range(len(rows)):
        for b in range(a):
            if u[a] and u[b] and len(u[a]) == len(u[b]) and rows[a][2] is not None and rows[a][2] == rows[b][2] and sum(x * y for x, y in zip(u[a], u[b])) >= 0.98:
                links.append((a, b))
    n = [0] * len(rows)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    roots = root_of(len(rows), links)
    low = {r: min((x[0] for x, y in zip(rows, roots) if y == r and x[0] is not None), default=None) for r in roots}
    return sorted(((r[0], n[i], low[root], r[0] == low[root]) for i, (r, root) in enumerate(zip(rows, roots))), key=str)


def single(rows):
    return [(a, None if v is None else [None if x is None else float(np.float32(x)) for x in v], b) for a, v, b in rows]


@pytest.mark.parametrize("options", [{}, {"pivots": 5, "block": 16}, {"pivots": 60, "block": 8}, {"pivots": 0, "block": 30}])
def test_against_brute_force(spark, options):
    rng = random.Random(2)
    rows = []
    for c in range(12):
        center = [rng.gauss(0, 1) for _ in range(6)]
        for _ in range(20):
            rows.append((len(rows), [x + rng.gauss(0, 0.12) for x in center], c % 3))
    rows += [(len(rows), list(rows[0][1]), 0), (len(rows) + 1, [2 * x for x in rows[0][1]], 0)]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 6, 1), (n + 2, [float("nan")] + [1.0] * 5, 1), (n + 3, [None] + [1.0] * 5, 1), (n + 4, [], 1), (n + 5, list(rows[0][1]), None), (n + 6, [1.0, 0.0], 0), (n + 7, [1.0, 0.01], 0), (n + 8, [float("inf")] * 6, 0), (n + 9, [1e-30, 0.0], 0)]
    # Repeated rows, different vectors under one id, and vectors without an id: each is a vector of its own.
    rows += [rows[3], (5, [-x for x in rows[5][1]], 0), (None, list(rows[7][1]), 1), (None, [-x for x in rows[7][1]], 1), (None, list(rows[0][1]), 0), (None, None, None)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    got = [tuple(r) for r in e.near_duplicates(spark, df, **options).collect()]
    assert sorted(got, key=str) == brute(single(rows))


def test_double_precision_and_few_pivots(spark):
    rng = random.Random(5)
    rows = [(k, [rng.gauss(0, 1) for _ in range(3)], k % 2) for k in range(400)]
    df = spark.createDataFrame(rows, SCHEMA.split(", cell")[0].replace("float", "double"))
    assert sorted((tuple(r) for r in e.near_duplicates(spark, df, pivots=16, block=20).collect()), key=str) == brute(rows)


def test_clusters_of_near_copies(spark):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(40, 16))
    x = np.repeat(centers, 50, axis=0) + 0.02 * rng.normal(size=(2000, 16))
    df = spark.createDataFrame([(k, v, 0) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int")
    got = e.near_duplicates(spark, df, block=100)
    assert got.filter("kept").count() == 40 and {r.n_links for r in got.collect()} == {49}


def test_empty(spark):
    assert e.near_duplicates(spark, spark.createDataFrame([], SCHEMA)).count() == 0
