import math

import numpy as np
import pytest

from pageframe.llm import epsilon

SCHEMA = "vec_id long, embedding array<double>, label int, g string, u int, c0 string, idx int, node string"


def brute(rows, least):
    def fine(r):
        return r[0] is not None and r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])

    unit = [epsilon._unit(np.array([r[1]]))[0] if fine(r) else None for r in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least:
                links[i], links[j] = links[i] + 1, links[j] + 1
                parent[top(i)] = top(j)
    least_id = {}
    for i, r in enumerate(rows):
        least_id[top(i)] = min(least_id.get(top(i), r[0] or 0), r[0] or 0)
    return sorted([(r[0], n, r[0] if r[0] is None else least_id[top(i)], r[0] is None or r[0] == least_id[top(i)]) for i, (r, n) in enumerate(zip(rows, links))], key=str)


def rows(n, dim=8):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(n // 8, dim))
    made = [(i, (centres[i % len(centres)] * rng.uniform(0.5, 2) + rng.normal(size=dim) * rng.choice([0.05, 0.25, 1.0])).tolist(), i % 3) for i in range(n)]
    same = made[5][1]
    made += [(1000 + i, same, made[5][2]) for i in range(40)] + [(2000, same, made[5][2] + 1), (2001, same, None), (1000, same, made[5][2])]
    made += [(3000, None, 1), (3001, [], 1), (3002, [0.0] * dim, 1), (3003, [1.0, None], 1), (3004, [float("nan")] * dim, 1), (3005, [float("inf")] * dim, 1), (None, same, 1)]
    return made + [(4000, [1.0, 2.0], 1), (4001, [1.01, 2.0], 1), (4002, [1e-300, 2e-300], 1), (4003, [1e300, 2e300], 1)]


@pytest.mark.parametrize("block, fan", [(16, 2), (1024, 8)])
def test_matches_brute_force(spark, block, fan):
    data = rows(300)
    table = spark.createDataFrame([(*r, "x", 1, "y", 2, "z") for r in data], SCHEMA).repartition(4)
    for least in (0.93, 0.8):
        got = epsilon.near_embeddings(table, least, block=block, fan=fan, dimensions=3, sample=100)
        assert sorted(map(tuple, got.collect()), key=str) == brute(data, least)


def test_intervals_skip_what_is_distant():
    rng = np.random.default_rng(1)
    u = epsilon._unit(np.concatenate([rng.normal(size=(300, 6)) * 0.01 + np.eye(6)[k] for k in range(3)]))
    c = u[:, :3]
    seen = [(i, j) for x, y in epsilon.join_intervals(u, c, (0, 900), (0, 900), 0.93, 0.375) for i, j in zip(x.tolist(), y.tolist())]
    i, j = np.nonzero(np.triu(u @ u.T >= 0.93, 1))
    assert sorted(seen) == list(zip(i.tolist(), j.tolist()))
    assert not list(epsilon.join_intervals(u, c, (0, 300), (600, 900), 0.93, 0.375))


def test_empty_table(spark):
    assert epsilon.near_embeddings(spark.createDataFrame([], SCHEMA)).collect() == []
