"""Graphs side by side give the increments of graphs run one by one."""

import random

import numpy as np
import pandas as pd
import pytest

from graphtide.operators import incremental, lockstep

NAMES = ["node_id", "dim", "x", "y", "theta"]
INFO = {"P": (4.0, 0.5, 0.0, 4.0, 0.0, 16.0), "L": (2.0, 0.25, 0.0, 2.0, 0.0, 0.0), "G": (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)}


def trajectory(rng: random.Random, n: int):
    """A noisy walk with closures, landmarks between poses, a self-loop and fixes."""
    truth = [(i * 0.9, (i % 5) * 0.4, 0.1 * i) for i in range(n)]
    marks = {1000 + m: (3.0 * m, 4.0) for m in range(rng.randint(0, 3))}
    nodes = [(i, 3, x + rng.gauss(0, 0.05), y + rng.gauss(0, 0.05), t + rng.gauss(0, 0.02)) for i, (x, y, t) in enumerate(truth)] + [(m, 2, x + 0.1, y - 0.1, None) for m, (x, y) in marks.items()]

    def seen(i, x, y):
        c, s, dx, dy = np.cos(truth[i][2]), np.sin(truth[i][2]), x - truth[i][0], y - truth[i][1]
        return c * dx + s * dy + rng.gauss(0, 0.02), c * dy - s * dx + rng.gauss(0, 0.02)

    edges = []
    for i in range(1, n):
        edges.append(("P", i - 1, i, *seen(i - 1, *truth[i][:2]), 0.1))
        if i > 6 and i % 4 == 0:
            edges.append(("P", i, i - 6, *seen(i, *truth[i - 6][:2]), -0.6))
        for m, at in marks.items():
            if rng.random() < 0.3:
                edges.append(("L", i, m, *seen(i, *at), None))
        if rng.random() < 0.2:
            edges.append(("G", i, None, *truth[i][:2], None))
    if n > 5:
        edges.append(("P", 5, 5, 0.0, 0.0, 0.0))
    named = {e[1] for e in edges} | {e[2] for e in edges}
    frame = pd.DataFrame([(*e, *INFO[e[0]], p + 1) for p, e in enumerate(edges)], columns=["type", "from_id", "to_id", "z1", "z2", "z3", "i11", "i12", "i13", "i22", "i23", "i33", "seq"])
    real = pd.DataFrame([(i, x, y) for i, (x, y, _) in enumerate(truth)], columns=["node_id", "x", "y"])
    return pd.DataFrame([v for v in nodes if v[0] in named], columns=NAMES).sort_values("node_id"), frame, real


OPTIONS = [{"gating": "IGG"}, {"gating": "LCG", "batch": 3}, {"gating": "LCG", "selective": False}, {"gating": "none", "most_iterations": 2}, {"gating": "LCG", "most_iterations": 0}]


@pytest.mark.parametrize("options", OPTIONS, ids=str)
@pytest.mark.parametrize("most", [1 << 21, 400])
def test_side_by_side_equals_one_by_one(monkeypatch, options, most):
    monkeypatch.setattr(lockstep, "MOST", most)
    rng, config = random.Random(7), incremental.Config(**options)
    parts = [trajectory(rng, n) for n in (2, 3, 9, 14, 14, 22, 31)]
    parts[2] = (*parts[2][:2], None)
    # No factor at first: negative information. The others are untouched.
    parts[3][1].loc[:, "i11"] = -4.0
    got = incremental.run_many(parts, config)
    for part, rows in zip(parts, got, strict=True):
        want = incremental.run(*part, config)[0]
        assert len(rows) == len(want)
        for mine, whole in zip(rows, want, strict=True):
            assert list(mine) == [pytest.approx(v, rel=1e-7, abs=1e-9) if isinstance(v, float) else v for v in whole]


def test_closures_are_dealt_to_as_many_tasks_as_the_rows_ask_for(spark, data_dir, monkeypatch):
    from graphtide.operators import growth, kept
    from graphtide.sources import fixture

    edges = fixture.edges(spark, data_dir)
    few = [sorted(map(tuple, f(edges).collect())) for f in (growth.pose_closures, growth.landmark_closures)]
    monkeypatch.setattr(kept, "ROWS", 100)
    wanted = -(-edges.count() // 100)
    many = [f(fixture.edges(spark, data_dir)) for f in (growth.pose_closures, growth.landmark_closures)]
    assert [df.rdd.getNumPartitions() for df in many] == [wanted, wanted]
    assert [sorted(map(tuple, df.collect())) for df in many] == few
