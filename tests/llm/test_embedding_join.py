import math

import numpy as np
import pytest

from pageloom.llm import embedding_join


def brute(rows, similarity=0.93):
    """Links of all pairs and what they reach, with Python floats."""

    def unit(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v, float) / max(abs(x) for x in v)
        return v / math.sqrt(math.fsum(v * v))

    units = [unit(v) for _, v, _ in rows]
    n = len(rows)
    links = [set() for _ in rows]
    for i in range(n):
        for j in range(i):
            if units[i] is not None and units[j] is not None and rows[i][2] is not None and rows[i][2] == rows[j][2]:
                if len(units[i]) == len(units[j]) and units[i] @ units[j] >= similarity:
                    links[i].add(j)
                    links[j].add(i)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids, default=None)
        out.append((rows[i][0], len(links[i]), least, rows[i][0] is not None and rows[i][0] == least))
    return sorted(out, key=str)


def run(spark, rows, kind="double", **options):
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], f"vec_id long, embedding array<{kind}>, label int, run int, node string")
    return sorted((tuple(r) for r in embedding_join.near_vectors(frame, **options).collect()), key=str)


def clustered(seed, n=400, dims=12, labels=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    rows = []
    for i in range(n):
        v = centres[rng.integers(12)] + rng.normal(size=dims) * rng.choice([0.05, 0.25, 0.6])
        rows.append((i, [float(x) for x in v], int(rng.integers(labels))))
    return rows


@pytest.mark.parametrize("seed, dims", [(1, 12), (2, 3), (3, 2)])
def test_equals_brute_force(spark, seed, dims):
    rows = clustered(seed, dims=dims)
    assert run(spark, rows) == brute(rows)


def test_many_runs(spark):
    rows = clustered(4, n=700, labels=1)
    assert run(spark, rows, run_rows=16) == brute(rows)
    assert run(spark, rows, similarity=0.99, run_rows=5) == brute(rows, 0.99)


def test_small_leaves(monkeypatch):
    monkeypatch.setattr(embedding_join, "LEAF", 4)
    rows = clustered(5, n=200, labels=1)
    units = embedding_join._units([r[1] for r in rows])
    order = np.lexsort(units[:, :6].T[::-1])
    units = units[order]
    side = (units, units[:, :6], np.ones(len(units), np.int64))
    whole = embedding_join.Joined(side, None, 0.93)
    whole.join()
    linked = units @ units.T >= 0.93
    assert whole.links.tolist() == (linked.sum(0) - 1).tolist()
    halves = [tuple(x[:90] for x in side), tuple(x[90:] for x in side)]
    both = embedding_join.Joined(*halves, 0.93)
    both.join()
    assert both.links.tolist() == np.concatenate([linked[:90, 90:].sum(1), linked[:90, 90:].sum(0)]).tolist()


def test_copies_and_dense_groups(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=8)
    rows = [(i, [float(x) for x in base], 1) for i in range(150)]
    rows += [(1000 + i, [float(x) for x in base + rng.normal(size=8) * 0.05], 1) for i in range(150)]
    rows += [(2000 + i, [float(x) for x in base * 3], 2) for i in range(5)]
    assert run(spark, rows) == brute(rows)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (9, [1.0, 0.0], 1), (8, [2.0, 0.0], 1), (None, [1.0, 0.1], 1), (None, [5.0, -90.0], 1),
        (7, None, 1), (6, [], 1), (5, [0.0, 0.0], 1), (4, [nan, 1.0], 1), (3, [inf, 1.0], 1), (2, [None, 1.0], 1),
        (1, [1.0, 0.0], None), (0, [1.0, 0.0], None), (11, [1.0], 1), (12, [3.0], 1), (13, [-1.0], 1),
        (14, [1e300, 1e299], 2), (15, [1e-300, 1e-301], 2), (16, [1.0, 0.1], 2), (16, [1.0, 0.1], 2), (17, [-0.0, 1.0], 3), (18, [0.0, 1.0], 3),
    ]
    assert run(spark, rows) == brute(rows)
    assert run(spark, [r for r in rows if r[0] in (7, 6, 5)]) == brute([r for r in rows if r[0] in (7, 6, 5)])
    assert run(spark, []) == []
    with pytest.raises(ValueError):
        run(spark, rows, similarity=0.0)


def test_exact_half_plane(spark):
    """Vectors on both sides of the threshold, none of them within rounding of it."""
    at = math.acos(0.93)
    rows = [(0, [1.0, 0.0], 1)] + [(i, [math.cos(a), math.sin(a)], 1) for i, a in enumerate((at - 1e-9, at + 1e-9, 2 * at, -at + 1e-9), 1)]
    assert run(spark, rows) == brute(rows)
