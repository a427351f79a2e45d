"""Growth, numbers, steps and determinants over tables, where no task holds a graph, against literal rules and dense algebra."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from graphtide.operators import elimination, growth, incremental, linsys, prefix, solver, spanning
from graphtide.sources import fixture
from tests.test_graphs import literal_order, random_edges

EDGES = "graph_id long, edge_pos long, type string, from_id long, to_id long"


@pytest.fixture(autouse=True)
def one_job_a_table(spark):
    """On tables of a few rows, planning stage by stage costs more than all else."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.enabled")


def shapes():
    """Graphs whose trees are deep, whose openers form long chains, or whose first round's roots aren't the seed."""
    n = 10
    yield [(p, "P", p - 1, p) for p in range(1, n)]
    yield [(p, "P", n - p - 1, n - p) for p in range(1, n)]
    yield [(p, "P", (p * 7) % n, (p * 7 + 7) % n) for p in range(1, n)]
    yield [(p, "P", p // 2, p) for p in range(1, n)]
    yield [(n - p, "P", p // 2, p) for p in range(1, n)]
    rng = random.Random(4)
    order = list(range(1, n))
    rng.shuffle(order)
    yield [(order[p - 1], "P", p - 1, p) for p in range(1, n)]
    yield [(1, "P", 0, 0), (2, "P", 5, 6), (3, "G", 0, None)]
    for _ in range(12):
        yield random_edges(rng, rng.randint(2, 8), rng.randint(1, 16))


def test_growth_over_tables_equals_the_literal_rule(spark):
    graphs = {g: sorted(rows) for g, rows in enumerate(shapes())}
    df = spark.createDataFrame([(g, *e) for g, rows in graphs.items() for e in rows], EDGES)
    found = growth.growth_steps(df, walked=0)
    steps = {(r["graph_id"], r["node_id"]): r["step"] for r in found.collect()}
    assert steps == {(g, v): s for g, rows in graphs.items() for v, s in growth.prim_steps(rows, 0).items()}
    got = {}
    for r in growth.growth_order(df, steps=found).orderBy("graph_id", "seq").collect():
        got.setdefault(r["graph_id"], []).append((r["edge_pos"], r["kind"]))
    assert got == {g: w for g, rows in graphs.items() if (w := literal_order(rows))}
    with pytest.raises(ValueError, match="no node 999"):
        growth.growth_steps(df, seed=999, walked=0)


def test_blocks_of_nodes_are_joined_before_the_rounds(spark, monkeypatch):
    """Parts that end at blocks' borders, are entered elsewhere than at their root, or stay apart within a block; the rounds get what is left between parts."""
    rng = random.Random(7)
    graphs = dict(enumerate(shapes()))
    for n in (9, 14):
        order = rng.sample(range(1, 40), 30)
        graphs[len(graphs)] = [(p, "P", rng.choice(order[:n] + [0]), v) for p, v in zip(rng.sample(range(1, 99), 30), order, strict=True)]
    # A chain with sights of one far node; each block is one part.
    long = len(graphs)
    graphs[long] = [(p, "P", p - 1, p) for p in range(1, 400)] + [(400 + p, "L", p, 1 << 60) for p in range(400)]
    df = spark.createDataFrame([(g, *e) for g, rows in graphs.items() for e in rows if e[1] != "G" and e[2] != e[3]], EDGES)
    given, by_rounds = [], spanning._tree_by_rounds
    monkeypatch.setattr(spanning, "_tree_by_rounds", lambda edges, seed: (given.append(edges.filter(F.col("graph_id") == long).count()), by_rounds(edges, seed))[1])
    steps = {(r["graph_id"], r["node_id"]): r["step"] for r in spanning.walk_steps(df, block=5).collect()}
    want = {(g, v): s for g, rows in graphs.items() for v, s in growth.prim_steps(rows, 0).items()}
    assert steps == {k: v for k, v in want.items() if any(0 in e[2:] for e in graphs[k[0]] if e[1] != "G" and e[2] != e[3])}
    # 80 blocks of poses: a step to the next and a sight of each, of 799 edges.
    assert given == [79 + 80]


def test_text_ids_walks_beside_tables_and_an_empty_table(spark):
    df = spark.createDataFrame([("a", 1, "P", 3, 0), ("a", 2, "P", 3, 4), ("b", 1, "P", 0, 1)], EDGES.replace("graph_id long", "graph_id string"))
    rows = {tuple(r) for r in growth.growth_steps(df, walked=1).collect()}
    assert rows == {("a", 0, 0), ("a", 3, 1), ("a", 4, 2), ("b", 0, 0), ("b", 1, 1)}
    assert growth.growth_steps(df.limit(0), walked=0).collect() == []


def test_running_sums_over_ranges_equal_windows(spark):
    rng = random.Random(1)
    rows = [(0 if i % 3 else i % 7, i * 17 % 1009, rng.randrange(-5, 9)) for i in range(1000)]
    df = spark.createDataFrame(rows, "g long, o long, v long").repartition(7)
    w = Window.partitionBy("g").orderBy("o")
    want = df.withColumns({"a": F.sum("v").over(w), "b": F.coalesce(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "n": F.row_number().over(w).cast("long")})
    got = prefix.running_sum(df, ["g"], ["o"], "v", "a")
    got = prefix.running_sum(got, ["g"], ["o"], "v", "b", inclusive=False)
    got = prefix.numbered(got, ["g"], ["o"], "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))


def dense(nodes, edges, graph):
    pdf = nodes.filter(F.col("graph_id") == graph).toPandas().sort_values("node_id")
    g, sizes = incremental.build(pdf, edges.filter(F.col("graph_id") == graph).orderBy("edge_pos").toPandas())
    h, rhs = g.system(sizes[-1][1], sizes[-1][0])
    dx = np.zeros((len(g.ids), 3))
    dx[g.layout(len(g.ids))] = np.linalg.solve(h, rhs)
    return dict(zip(g.ids.tolist(), dx, strict=True)), len(rhs), np.linalg.slogdet(h)[1] / 2


@pytest.mark.parametrize("size", [256, 12])
def test_elimination_equals_dense_algebra(spark, data_dir, size):
    nodes, edges = fixture.nodes(spark, data_dir), fixture.with_information(fixture.edges(spark, data_dir))
    nodes, edges = (t.filter("graph_id < 3").checkpoint() for t in (nodes, edges))
    found = elimination.eliminate(linsys.normal_blocks(edges, nodes), linsys.gradient_blocks(edges, nodes), size)
    assert len(found.rounds) > 1 or size == 256
    steps, logs = found.solution().collect(), {r["graph_id"]: r for r in elimination.log_determinants(nodes, edges, size).collect()}
    for g in range(3):
        exact, n_vars, half = dense(nodes, edges, g)
        mine = {r["node_id"]: (r["dx1"], r["dx2"], r["dx3"]) for r in steps if r["graph_id"] == g}
        assert mine.keys() == exact.keys()
        for node, dx in mine.items():
            assert dx == pytest.approx(exact[node], rel=1e-8, abs=1e-8)
        assert (logs[g]["n_vars"], logs[g]["half_logdet"]) == (n_vars, pytest.approx(half, rel=1e-10))
        # The newest nodes' part of the solution is the whole one's.
        last = [r for r in elimination.newest_steps(nodes, edges, 4, size).collect() if r["graph_id"] == g]
        order, _ = incremental.build(nodes.filter(F.col("graph_id") == g).toPandas().sort_values("node_id"), edges.filter(F.col("graph_id") == g).orderBy("edge_pos").toPandas())
        assert {r["node_id"] for r in last} == set(order.ids[-4:].tolist())
        for r in last:
            assert (r["dx1"], r["dx2"], r["dx3"]) == pytest.approx(exact[r["node_id"]], rel=1e-8, abs=1e-8)


def test_a_graph_without_a_factor_gets_nulls_and_others_are_untouched(spark, data_dir):
    nodes, edges = fixture.nodes(spark, data_dir), fixture.with_information(fixture.edges(spark, data_dir))
    nodes, edges = (t.filter("graph_id < 2").checkpoint() for t in (nodes, edges))
    bad = edges.withColumn("i11", F.when((F.col("graph_id") == 1) & (F.col("type") == "P"), -1000.0).otherwise(F.col("i11")))
    for size in (256, 12):
        logs = {r["graph_id"]: r["half_logdet"] for r in elimination.log_determinants(nodes, bad, size).collect()}
        assert logs[1] is None and logs[0] == pytest.approx(dense(nodes, edges, 0)[2], rel=1e-10)
        steps = elimination.steps(nodes, bad, size).collect()
        assert {r["dx1"] is None for r in steps if r["graph_id"] == 1} >= {True} and all(r["dx1"] is not None for r in steps if r["graph_id"] == 0)
    rows = incremental.increments(nodes, bad.withColumn("seq", F.col("edge_pos"))).collect()
    assert any(r["failed"] and r["half_logdet"] is None and r["di"] is None for r in rows if r["graph_id"] == 1)
    assert not any(r["failed"] for r in rows if r["graph_id"] == 0)


def test_graphs_that_no_border_cuts_name_the_other_solver(spark, monkeypatch):
    monkeypatch.setattr(elimination, "LARGEST", 4)
    pairs = [(a, b) for a in range(12) for b in range(a + 1, 12)]
    nodes = spark.createDataFrame([(0, i, 3, float(i % 4), float(i // 4), 0.0) for i in range(12)], "graph_id long, node_id long, dim int, x double, y double, theta double")
    edges = fixture.with_information(spark.createDataFrame([(0, k + 1, "P", a, b, float(b % 4 - a % 4), float(b // 4 - a // 4), 0.01) for k, (a, b) in enumerate(pairs)], EDGES.replace("to_id long", "to_id long, z1 double, z2 double, z3 double")))
    blocks, gradient = linsys.normal_blocks(edges, nodes), linsys.gradient_blocks(edges, nodes)
    # One node a round can go; in the end a graph is left that is small enough.
    got = {r["node_id"]: r["dx1"] for r in elimination.eliminate(blocks, gradient, 4).solution().collect()}
    exact, *_ = dense(nodes, edges, 0)
    assert got == pytest.approx({k: v[0] for k, v in exact.items()}, abs=1e-8)


def test_a_step_after_which_there_is_no_factor_is_taken_back(spark, data_dir, monkeypatch):
    nodes, edges = fixture.nodes(spark, data_dir), fixture.with_information(fixture.edges(spark, data_dir))
    nodes, edges = nodes.filter("graph_id = 0").toPandas().sort_values("node_id"), growth.growth_order(edges.filter("graph_id = 0")).orderBy("seq").toPandas()
    config = incremental.Config(gating="none", most_iterations=3)
    calls, solve = [0], solver.Factor.solve

    def wild(self, n, since=0):
        calls[0] += 1
        return solve(self, n, since) * (1e14 if calls[0] == 200 else 1)

    monkeypatch.setattr(solver.Factor, "solve", wild)
    rows, graph = incremental.run(nodes, edges, None, config)
    rows = [dict(zip(incremental.COLUMNS, r, strict=True)) for r in rows]
    assert len(rows) == len(edges) and sum(r["failed"] for r in rows) == 1 and all(r["half_logdet"] is not None and np.isfinite(r["err"]) for r in rows)
    assert np.abs(graph.x).max() < 1e6


def test_the_known_diverging_graph_ends(spark):
    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("no test tables here")
    nodes, edges = fixture.nodes(spark, folder).filter("graph_id in (174, 175)"), fixture.with_information(fixture.edges(spark, folder)).filter("graph_id in (174, 175)").checkpoint()
    rows = incremental.increments(nodes, growth.growth_order(edges), None, incremental.Config(gating="IGG")).collect()
    failed = [r for r in rows if r["failed"]]
    assert len(rows) == edges.count() and failed and {r["graph_id"] for r in failed} == {175} and all(r["gn"] >= 0 for r in rows)


def test_small_graphs_solved_together_equal_those_solved_alone():
    import pandas as pd

    rng = np.random.default_rng(3)
    frames, alone = [], []
    for g, n in enumerate((1, 4, 2, 7, 3, 5)):
        root = rng.normal(size=(3 * n, 3 * n))
        h = root @ root.T + np.eye(3 * n)
        if g == 3:
            h[0, 0] = -1
        if g == 4:
            h[-1, :], h[:, -1] = 0, 0
        ids = np.sort(rng.choice(100, n, replace=False))
        rows = [(ids[i], ids[j], *h[3 * i : 3 * i + 3, 3 * j : 3 * j + 3].ravel()) for i in range(n) for j in range(i, n)]
        rows += [(ids[i], None, *(rng.normal(size=3) if not (g == 4 and i == n - 1) else [1.0, 2.0, 0.0]), *[np.nan] * 6) for i in range(n)]
        pdf = pd.DataFrame(rows, columns=["a", "b", *elimination.V]).astype({"b": "float"})
        frames.append(pdf.assign(g=g).sample(frac=1, random_state=g))
        alone.append(elimination._eliminated(pdf.assign(a_in=True, b_in=True)))
    every = pd.concat(frames, ignore_index=True)
    of, together = elimination._together(every, every.g.to_numpy())
    for g, want in enumerate(alone):
        mine = together[of == g].sort_values(["kind", "a"]).reset_index(drop=True)
        np.testing.assert_allclose(mine[elimination.V].to_numpy(float), want.sort_values(["kind", "a"])[elimination.V].to_numpy(float), rtol=1e-9, atol=1e-12)
        assert mine[["kind", "a"]].values.tolist() == want.sort_values(["kind", "a"])[["kind", "a"]].values.tolist()


def test_panels_give_what_one_matrix_gives_and_determinants_need_no_solution():
    import pandas as pd

    rng = np.random.default_rng(5)
    n, width = 83, 9
    a, b = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(n)))
    near = (a <= b) & (b - a <= width)
    a, b = a[near], b[near]
    values = rng.normal(size=(len(a), 3, 3))
    own = a == b
    values[own] = values[own] + values[own].transpose(0, 2, 1) + 200 * np.eye(3)
    # Landmarks.
    flat = a % 7 == 3, b % 7 == 3
    values[flat[0], 2, :], values[flat[1], :, 2] = 0, 0
    rhs = rng.normal(size=(3 * n, 5))
    rhs[2::3][np.arange(n) % 7 == 3] = 0
    want, got = elimination._dense(a, b, values, rhs), elimination._narrow(a, b, values, rhs, width, True)
    for mine, whole in zip(got, want, strict=True):
        np.testing.assert_allclose(mine, whole, rtol=1e-10, atol=1e-12)
    rows = pd.DataFrame(values.reshape(-1, 9), columns=elimination.V).assign(a=a, b=b.astype(float), a_in=a < 70, b_in=b < 70)
    rows = rows[rows.a_in | rows.b_in]
    whole, part = elimination._eliminated(rows), elimination._eliminated(rows, solve=False)
    assert set(part.kind) == {elimination.BLOCK, elimination.SIDE, elimination.DETERMINANT}
    pd.testing.assert_frame_equal(part, whole[whole.kind.isin(set(part.kind))])
