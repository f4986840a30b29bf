"""Near-duplicate vectors against all pairs compared."""

import math
import random

import numpy as np
import pytest

from pulseframe.llm import projections

SCHEMA = "vec_id long, embedding array<float>, label int, node string, n_links string"


def brute_force(rows, cosine=projections.COSINE):
    """``id, links, component`` of each row."""
    unit = []
    for _, v, label in rows:
        good = label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        unit.append(np.array(v) / np.linalg.norm(v) if good else None)
    links = [set() for _ in rows]
    for i, (_, _, label) in enumerate(rows):
        for j in range(i):
            if label == rows[j][2] and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]):
                if unit[i] @ unit[j] >= cosine:
                    links[i].add(j)
                    links[j].add(i)
    out, seen = [], {}
    for i in range(len(rows)):
        if i not in seen:
            todo, group = [i], {i}
            while todo:
                new = links[todo.pop()] - group
                group |= new
                todo += new
            least = min((rows[j][0] for j in group if rows[j][0] is not None), default=None)
            seen |= dict.fromkeys(group, least)
        out.append((rows[i][0], len(links[i]), seen[i], rows[i][0] == seen[i]))
    return out


def noisy(pick, base, cosine):
    """A vector at the given cosine from a unit vector."""
    side = pick.standard_normal(len(base))
    side -= (side @ base) * base
    return cosine * base + math.sqrt(1 - cosine**2) * side / np.linalg.norm(side)


@pytest.fixture(scope="module")
def rows():
    """Pairs just above and below the threshold, chains, a group of hundreds, and rows that take no part."""
    pick = np.random.default_rng(4)
    unit = lambda: (lambda v: v / np.linalg.norm(v))(pick.standard_normal(16))
    vectors = []
    for _ in range(60):
        base = unit()
        vectors += [base, noisy(pick, base, pick.choice([0.9805, 0.99, 0.9795, 0.97])) * pick.uniform(0.1, 30)]
    chain = unit()
    for _ in range(12):
        vectors.append(chain)
        chain = noisy(pick, chain, 0.985)
    hub = unit()
    vectors += [noisy(pick, hub, pick.uniform(0.98, 1)) for _ in range(300)] + [unit() for _ in range(200)]
    out = [(i, np.float32(v).tolist(), int(pick.integers(0, 3)) if i > 140 else i % 2 // 2) for i, v in enumerate(vectors)]
    twin = out[5][1]
    out += [(1000 + i, twin, out[5][2]) for i in range(30)] + [(1, out[0][1], 0), (1, out[0][1], 0), (None, twin, out[5][2])]
    out += [(2000, None, 0), (2001, [], 0), (2002, [0.0] * 16, 0), (2003, [None] * 16, 0), (2004, [float("nan")] * 16, 0)]
    out += [(2005, [float("inf")] * 16, 0), (2006, twin, None), (2007, twin, None), (2008, twin[:8], out[5][2]), (None, None, None), (2000, None, 0)]
    out += [(3000, [1e30] * 16, 1), (3001, [1e-30] * 16, 1), (3002, [-1.0] * 16, 1)]
    random.Random(1).shuffle(out)
    return out


@pytest.mark.parametrize(("task", "block", "batch"), [(1 << 17, 1024, "10000"), (300, 40, "70")])
def test_links_and_components(spark, rows, monkeypatch, task, block, batch):
    """Small ranges, blocks and batches in the second case, so that borders of each are met."""
    monkeypatch.setattr(projections, "TASK_ROWS", task)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    found = projections.near_vectors(spark, table, block=block).collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert found[0].asDict().keys() == {"vec_id", "n_links", "component_id", "kept"}
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, brute_force(rows)))


def test_recall_of_the_passes_alone(rows):
    """Pairs at the threshold among random vectors, by the windows of all passes, without the count afterwards."""
    pick = np.random.default_rng(9)
    base = pick.standard_normal((4000, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    near = np.array([noisy(pick, b, 0.98001) for b in base[:500]])
    unit = np.concatenate([base, near])
    keys = projections.projection_keys(unit, projections.passes_for(len(unit)))
    met = set()
    for n in range(keys.shape[1]):
        order = np.argsort(keys[:, n])
        a, b = projections.window_links(unit[order], np.zeros(len(unit), int), 0.98, projections.WINDOW)
        met |= {(min(x, y), max(x, y)) for x, y in zip(order[a].tolist(), order[b].tolist())}
    assert sum((i, 4000 + i) in met for i in range(500)) >= 495


def test_forest_keeps_components():
    a, b = np.array([5, 1, 2, 8]), np.array([6, 2, 7, 9])
    left, right = projections.forest(a, b, 10)
    assert sorted(zip(left.tolist(), right.tolist())) == [(2, 1), (6, 5), (7, 1), (9, 8)]


def test_empty_and_unlinked(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert projections.near_vectors(spark, none).count() == 0
    odd = spark.createDataFrame([(1, None, 1, "", ""), (2, [0.0], 1, "", ""), (3, [1.0], None, "", "")], SCHEMA)
    assert sorted(map(tuple, projections.near_vectors(spark, odd).collect())) == [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True)]
