"""Sources, growth, systems, solving and streaming against brute force and invariants."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from graphtide.operators import elimination, growth, incremental, linsys, metrics, plots
from graphtide.operators.solver import Factor, align, elimination_parents, half_logdet, reach, solve, solve_partly, trajectory_rmse, whitening
from graphtide.sources import fixture, presets, text
from graphtide.streaming import edges as edge_stream

DIRTY = """# a comment
VERTEX_SE2 0 0 0 0
VERTEX_SE2 1 1 0 0.1  # behind

VERTEX_SE2 2 2 0
\tVERTEX_SE2 9 1 1 1
VERTEX_XY 5 1 x
VERTEX_SE2 1 1.5 0 0.2
VERTEX_XY 6 3
FIX 0
EDGE_SE2 0 1 1 0 0.1 1 2 3 4 5 6
EDGE_SE2 0 1 1 0
EDGE_SE2_XY 0 5 1 1 2 0.5 2
EDGE_SE2_XY 0 5 1 1 2
"""
TORO = "VERTEX2 0 0 0 0\nVERTEX2 1 1 0 0\nEDGE2 0 1 1 0 0 11 12 22 33 13 23\nEDGE2 0 1 1\n"


def test_g2o_reader(spark, tmp_path):
    (tmp_path / "dirty.g2o").write_text(DIRTY)
    nodes, edges = text.read_graph(spark, str(tmp_path / "dirty.g2o"))
    got = {r["node_id"]: r for r in nodes.collect()}
    assert set(got) == {0, 1, 5} and got[1]["x"] == 1.5 and got[5]["dim"] == 2 and math.isnan(got[5]["y"]) and got[0]["graph_id"] == "dirty"
    rows = edges.orderBy("edge_pos").collect()
    assert [(r["edge_pos"], r["type"]) for r in rows] == [(1, "P"), (2, "L")]
    assert [rows[0][k] for k in ("i11", "i12", "i13", "i22", "i23", "i33")] == [1, 2, 3, 4, 5, 6] and rows[1]["i22"] == 2 and rows[1]["z3"] is None
    text.write_snapshot(nodes, edges, str(tmp_path / "snap"))
    again = text.read_graph(spark, str(tmp_path / "snap"))
    assert [t.count() for t in again] == [3, 2]


def test_toro_reader_and_failures(spark, tmp_path):
    (tmp_path / "t.graph").write_text(TORO)
    row = text.read_graph(spark, str(tmp_path / "t.graph"))[1].first()
    assert [row[k] for k in ("i11", "i12", "i13", "i22", "i23", "i33")] == [11, 12, 13, 22, 23, 33]
    (tmp_path / "bad.graph").write_text("VERTEX2 0 0 0 0\nEDGE2 0 7 1 0 0 11 12 22 33 13 23\n")
    with pytest.raises(ValueError, match="7"):
        text.read_graph(spark, str(tmp_path / "bad.graph"))
    for path in ("x.mat", "x.csv"):
        with pytest.raises(ValueError):
            text.read_graph(spark, path)
    with pytest.raises(ValueError):
        presets.preset("nowhere")
    with pytest.raises(ValueError):
        incremental.Config(gating="XYZ")


def literal_order(edges, seed=0):
    """The rule word for word: grow by the first edge with one end inside, then append all that are closed."""
    inside, used, out = {seed}, set(), []
    while True:
        grow = next((e for e in edges if e[0] not in used and e[1] != "G" and (e[2] in inside) != (e[3] in inside)), None)
        if grow:
            used.add(grow[0])
            out.append((grow[0], "growth"))
            inside |= {grow[2], grow[3]}
        closed = [e for e in edges if e[0] not in used and e[2] in inside and (e[1] == "G" or e[3] in inside)]
        for e in closed:
            used.add(e[0])
            out.append((e[0], "closure"))
        if not grow and not closed:
            return out


def random_edges(rng, n_nodes, n_edges):
    rows = []
    for pos in range(1, n_edges + 1):
        kind = rng.choice("PPPLG")
        a = rng.randrange(n_nodes)
        rows.append((pos, kind, a, None if kind == "G" else rng.randrange(n_nodes) if kind == "P" else 100 + rng.randrange(4)))
    rows[0] = (1, "P", 0, rows[0][3] if rows[0][1] == "P" else 1)
    return rows


def test_growth_order_equals_the_literal_rule(spark):
    rng = random.Random(2)
    graphs = {g: random_edges(rng, rng.randint(2, 12), rng.randint(1, 30)) for g in range(120)}
    df = spark.createDataFrame([(g, *e) for g, rows in graphs.items() for e in rows], "graph_id long, edge_pos long, type string, from_id long, to_id long")
    ordered = growth.growth_order(df)
    got = {}
    for r in ordered.orderBy("graph_id", "seq").collect():
        got.setdefault(r["graph_id"], []).append((r["edge_pos"], r["kind"]))
    want = {g: literal_order(rows) for g, rows in graphs.items()}
    assert got == {g: w for g, w in want.items() if w}
    assert growth.dropped_edges(df, ordered).count() == sum(len(rows) - len(want[g]) for g, rows in graphs.items())
    with pytest.raises(Exception, match="no node 999"):
        growth.growth_steps(df, seed=999).collect()


def brute_flags(edges, gap, batch=1):
    """The rule with whole histories kept."""
    orders, marks, counter, out = {}, {}, [1], []

    def order(n):
        if n not in orders:
            orders[n] = counter[0]
            counter[0] += 1

    for at in range(0, len(edges), batch):
        hit = False
        for _, kind, a, b in edges[at : at + batch]:
            if kind == "P":
                known_a, known_b = a in orders, b in orders
                if known_a and known_b and abs(orders[a] - orders[b]) > gap:
                    hit = True
                    break
                if not known_a:
                    orders[a] = counter[0]
                    counter[0] += 1
                if not known_b:
                    orders[b] = counter[0]
                    counter[0] += 1
            elif kind == "L":
                order(a)
                if any(abs(o - orders[a]) > gap for o in marks.get(b, [])):
                    hit = True
                    break
                marks.setdefault(b, []).append(orders[a])
            else:
                order(a)
        out += [hit] * len(edges[at : at + batch])
    return out


def test_loop_closures_equal_brute_force(spark):
    rng = random.Random(4)
    graphs = {g: [e for e in random_edges(rng, 14, 40) if e[2] != e[3]] for g in range(60)}
    graphs = {g: [(i + 1, *e[1:]) for i, e in enumerate(rows)] for g, rows in graphs.items()}
    df = spark.createDataFrame([(g, *e) for g, rows in graphs.items() for e in rows], "graph_id long, edge_pos long, type string, from_id long, to_id long")
    want = {(g, e[0]): f for g, rows in graphs.items() for e, f in zip(rows, brute_flags(rows, 3), strict=True)}
    for found in (growth.pose_closures(df, 3), growth.landmark_closures(df, 3)):
        rows = found.collect()
        assert rows and all(want[r["graph_id"], r["edge_pos"]] == r["loop_closure"] for r in rows)
    loops = random_edges(rng, 6, 60)
    for rows in (*graphs.values(), loops):
        for batch in (1, 3):
            detector = growth.LoopDetector(3)
            got = []
            for at in range(0, len(rows), batch):
                got += [detector.batch([e[1:] for e in rows[at : at + batch]])] * len(rows[at : at + batch])
            assert got == brute_flags(rows, 3, batch)
    assert growth.LoopDetector(float("nan")).gap == growth.LoopDetector().gap == 5


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(8)
    graphs = {g: [e for e in random_edges(rng, 10, 20) if e[2] != e[3]] for g in range(5)}
    rows = [(g, i + 1, *e[1:]) for g, es in graphs.items() for i, e in enumerate(es)]
    schema = "graph_id long, edge_pos long, type string, from_id long, to_id long"
    rng.shuffle(rows)
    for i in range(3):
        spark.createDataFrame(rows[i::3], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame(rows[:2], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = edge_stream.flags(stream, gap=3).writeStream.format("memory").queryName("flags").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    out = spark.table("flags").collect()
    got = {(r["graph_id"], r["edge_pos"]): r["loop_closure"] for r in out if not r["late"]}
    want = {(g, i + 1): f for g, es in graphs.items() for i, f in enumerate(brute_flags(es, 3))}
    assert got == want and sum(r["late"] for r in out) == 2
    seen = [(r["graph_id"], n) for r in out for n in r["new_nodes"]]
    assert len(seen) == len(set(seen))


def frames(spark, data_dir):
    nodes, edges = fixture.nodes(spark, data_dir), fixture.with_information(fixture.edges(spark, data_dir))
    return nodes, edges


def test_blocks_gradients_and_solvers_agree(spark, data_dir):
    nodes, edges = frames(spark, data_dir)
    nodes, edges = (t.filter("graph_id < 3") for t in (nodes, edges))
    blocks, gradient = linsys.normal_blocks(edges, nodes), linsys.gradient_blocks(edges, nodes)
    exact = {(r["graph_id"], r["node_id"]): r for r in elimination.steps(nodes, edges).collect()}
    for g in range(3):
        graph, sizes = incremental.build(nodes.filter(F.col("graph_id") == g).toPandas().sort_values("node_id"), edges.filter(F.col("graph_id") == g).orderBy("edge_pos").toPandas())
        h, grad = graph.system(sizes[-1][1], sizes[-1][0])
        index = {int(n): i for i, n in enumerate(graph.ids)}
        for r in blocks.filter(F.col("graph_id") == g).collect():
            a, b = index[r["row_node"]], index[r["col_node"]]
            mine = np.array([[r[f"h{i}{j}"] for j in (1, 2, 3)] for i in (1, 2, 3)])[: graph.dims[a], : graph.dims[b]]
            assert mine == pytest.approx(h[graph.offset[a] : graph.offset[a + 1], graph.offset[b] : graph.offset[b + 1]], abs=1e-8)
        for r in gradient.filter(F.col("graph_id") == g).collect():
            a = index[r["node_id"]]
            assert [r["g1"], r["g2"], r["g3"]][: graph.dims[a]] == pytest.approx(grad[graph.offset[a] : graph.offset[a + 1]], abs=1e-8)
    assert len(exact) == nodes.join(growth.endpoints(edges).select("graph_id", "node_id").distinct(), ["graph_id", "node_id"], "left_semi").count()


def test_conjugate_gradients_on_a_chain(spark):
    rows = [(0, i, i, 3, float(i), 0.1 * (i % 3), 0.0) for i in range(8)]
    nodes = spark.createDataFrame([(r[0], r[1], r[3], *r[4:]) for r in rows], "graph_id long, node_id long, dim int, x double, y double, theta double")
    edges = fixture.with_information(spark.createDataFrame([(0, i + 1, "P", i, i + 1, 1.0, 0.0, 0.05) for i in range(7)] + [(0, 8, "G", 7, None, 6.5, 0.3, None)], "graph_id long, edge_pos long, type string, from_id long, to_id long, z1 double, z2 double, z3 double"))
    exact = {r["node_id"]: r for r in elimination.steps(nodes, edges).collect()}
    got = linsys.conjugate_gradients(linsys.normal_blocks(edges, nodes), linsys.gradient_blocks(edges, nodes), tolerance=1e-10, most=40).collect()
    assert len(got) == 8
    for r in got:
        assert [r["dx1"], r["dx2"], r["dx3"]] == pytest.approx([exact[r["node_id"]][f"dx{i}"] for i in (1, 2, 3)], abs=1e-6)


def test_conjugate_gradients_reach_the_target_on_a_long_chain_beside_a_short_one(spark):
    sizes = {0: 210, 1: 6}
    nodes = spark.createDataFrame([(g, i, 3, float(i), 0.1 * (i % 3), 0.0) for g, n in sizes.items() for i in range(n)], "graph_id long, node_id long, dim int, x double, y double, theta double")
    links = [(g, i + 1, "P", i, i + 1, 1.0, 0.0, 0.01) for g, n in sizes.items() for i in range(n - 1)] + [(g, n + i, "G", i, None, i - 0.5, 0.3, None) for g, n in sizes.items() for i in range(1, n, 2)]
    edges = fixture.with_information(spark.createDataFrame(links, "graph_id long, edge_pos long, type string, from_id long, to_id long, z1 double, z2 double, z3 double"))
    blocks, gradient = linsys.normal_blocks(edges, nodes).checkpoint(), linsys.gradient_blocks(edges, nodes).checkpoint()
    short = linsys.conjugate_gradients(blocks, gradient, most=2).collect()
    assert max(r["residual"] for r in short) > 1e-3
    got = linsys.conjugate_gradients(blocks, gradient, tolerance=1e-4).collect()
    assert len(got) == 216 and max(r["residual"] for r in got) < 1.01e-4
    for g, n in sizes.items():
        h, b, x = np.zeros((3 * n, 3 * n)), np.zeros(3 * n), np.zeros(3 * n)
        for r in blocks.filter(f"graph_id = {g}").collect():
            m = np.array([r[k] for k in linsys.H]).reshape(3, 3)
            i, j = 3 * r["row_node"], 3 * r["col_node"]
            h[i : i + 3, j : j + 3] = m
            h[j : j + 3, i : i + 3] = m.T
        for r in gradient.filter(f"graph_id = {g}").collect():
            b[3 * r["node_id"] : 3 * r["node_id"] + 3] = [r[k] for k in linsys.G]
        for r in got:
            if r["graph_id"] == g:
                x[3 * r["node_id"] : 3 * r["node_id"] + 3] = [r[f"dx{i}"] for i in (1, 2, 3)]
        assert x == pytest.approx(np.linalg.solve(h, b), abs=1e-2)


def test_conjugate_gradients_refuse_what_has_no_solution(spark):
    zeros = {k: 0.0 for k in linsys.H}
    block = lambda i, j, **h: (0, i, j, *(zeros | h).values())
    unit = {"h11": 1.0, "h22": 1.0, "h33": 1.0}
    blocks = spark.createDataFrame([block(0, 0, **unit), block(1, 1, **unit), block(0, 1, h11=2.0)], "graph_id long, row_node long, col_node long, " + ", ".join(f"{k} double" for k in linsys.H))
    gradient = spark.createDataFrame([(0, 0, 1.0, 0.0, 0.0), (0, 1, -1.0, 0.0, 0.0)], "graph_id long, node_id long, g1 double, g2 double, g3 double")
    with pytest.raises(ArithmeticError):
        linsys.conjugate_gradients(blocks, gradient).collect()


def test_partial_solve_equals_the_whole():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n = int(rng.integers(4, 30))
        m = rng.normal(size=(n, n)) * (rng.random((n, n)) < 0.15)
        h = m @ m.T + np.eye(n)
        g = rng.normal(size=n)
        wanted = np.sort(rng.choice(n, int(rng.integers(1, n)), replace=False))
        whole = solve(h, g)
        for share in (0.0, 0.3, 1.0):
            assert solve_partly(h, np.linalg.cholesky(h), g, wanted, share) == pytest.approx(whole[wanted], abs=1e-8)
        lower = np.linalg.cholesky(h)
        parents = elimination_parents(h)
        for k in range(n):
            below = [i for i in range(k + 1, n) if abs(lower[i, k]) > 1e-12]
            assert not below or parents[k] == below[0]
        assert reach(parents, [n - 1]) >= {n - 1}


def test_a_kept_factor_equals_whole_solves(spark, data_dir):
    nodes, edges = frames(spark, data_dir)
    for g in (0, 3):
        ordered = growth.growth_order(edges.filter(F.col("graph_id") == g)).orderBy("seq").toPandas()
        graph, sizes = incremental.build(nodes.filter(F.col("graph_id") == g).toPandas().sort_values("node_id"), ordered)
        factor = Factor(graph)
        for n_edges, n_nodes in sizes:
            factor.grow(n_edges)
            n = int(graph.offset[n_nodes])
            h, grad = graph.system(n_nodes, n_edges)
            whole, lower = solve(h, grad), np.linalg.cholesky(h)
            assert factor.solve(n) == pytest.approx(whole, rel=1e-8, abs=1e-8) and factor.solve(n, n - 2)[-2:] == pytest.approx(whole[-2:], rel=1e-8, abs=1e-8)
            assert factor.half_logdet(n) == pytest.approx(half_logdet(lower))
            assert ((np.abs(lower) > 1e-12).sum(0) <= factor.filling(n_nodes)).all()
            last = np.arange(max(0, n_nodes - 2), n_nodes)
            graph.x[last, 0] += 0.1
            factor.moved(last)


def test_alignment(spark):
    rng = np.random.default_rng(1)
    p = rng.normal(size=(30, 2))
    turn = np.array([[math.cos(2.5), -math.sin(2.5)], [math.sin(2.5), math.cos(2.5)]])
    q = p @ turn.T + [3, -1]
    r, t = align(p, q)
    assert r == pytest.approx(turn) and t == pytest.approx([3, -1]) and trajectory_rmse(p, q) == pytest.approx(0, abs=1e-12)
    for bad in ((p[:1], q[:1]), (p, q[:5]), (p * np.nan, q)):
        with pytest.raises(ValueError):
            align(*bad)
    assert math.isnan(trajectory_rmse(p[:1], q[:1]))
    w = whitening(np.array([[2.0, 0.25], [0.25, 2.0]]))
    assert w @ w == pytest.approx(np.array([[2.0, 0.25], [0.25, 2.0]]))
    one = spark.createDataFrame([(0, 1, 3, 1.0, 2.0, 0.0)], "graph_id long, node_id long, dim int, x double, y double, theta double")
    assert metrics.trajectory_error(one, one).first()["rmse"] is None


def test_incremental_runs(spark, data_dir):
    nodes, edges = frames(spark, data_dir)
    ordered = growth.growth_order(edges.filter("graph_id < 4"))
    truth = fixture.ground_truth(nodes)
    for config in (incremental.Config(), incremental.Config(gating="LCG", batch=3), incremental.Config(gating="none", selective=False), incremental.Config(gating="IGG", selective=False)):
        rows = incremental.increments(nodes, ordered, truth, config).collect()
        assert {r["graph_id"] for r in rows} == {0, 1, 2, 3}
        assert all((r["err"] is None) == r["skipped"] for r in rows)
        assert all(r["di"] == 0 for r in rows if r["it"] == 1)
        if config.gating == "none":
            last = {r["graph_id"]: r["err"] for r in sorted(rows, key=lambda r: r["it"])}
            final = incremental.estimates(nodes, ordered, config)
            at_end = {r["graph_id"]: r["normalised_error"] for r in metrics.global_error(edges.filter("graph_id < 4"), final).collect()}
            assert at_end == pytest.approx(last)
    summary = metrics.run_summary(incremental.increments(nodes, ordered, truth, incremental.Config()))
    assert summary.count() == 4
    parity = metrics.parity_series(incremental.increments(nodes, ordered, truth, incremental.Config(entropy_threshold=1e9)))
    assert parity.filter("skipped and err = 0 and isnan(ate_rmse)").count() == parity.filter("skipped").count() > 0


def test_solving_a_noisy_loop_lowers_its_error(spark):
    rng = np.random.default_rng(3)
    n = 24
    real = [(8 * math.cos(2 * math.pi * i / n), 8 * math.sin(2 * math.pi * i / n), 2 * math.pi * i / n + math.pi / 2) for i in range(n)]

    def seen(a, b):
        c, s = math.cos(a[2]), math.sin(a[2])
        dx, dy = b[0] - a[0], b[1] - a[1]
        return [c * dx + s * dy + rng.normal() * 0.02, c * dy - s * dx + rng.normal() * 0.02, math.remainder(b[2] - a[2], 2 * math.pi) + rng.normal() * 0.02]

    guess = [real[0]]
    pairs = [(i, i + 1) for i in range(n - 1)] + [(n - 1, 0), (0, 12), (6, 18)]
    rows = []
    for pos, (a, b) in enumerate(pairs, 1):
        z = seen(real[a], real[b])
        rows.append((0, pos, "P", a, b, *z))
        if b == len(guess):
            x, y, t = guess[a]
            guess.append((x + math.cos(t) * z[0] - math.sin(t) * z[1], y + math.sin(t) * z[0] + math.cos(t) * z[1], t + z[2]))
    nodes = spark.createDataFrame([(0, i, 3, *g) for i, g in enumerate(guess)], "graph_id long, node_id long, dim int, x double, y double, theta double")
    edges = fixture.with_information(spark.createDataFrame(rows, "graph_id long, edge_pos long, type string, from_id long, to_id long, z1 double, z2 double, z3 double"))
    ordered = growth.growth_order(edges)
    before = metrics.global_error(edges, nodes).first()["normalised_error"]
    finals = []
    for config in (incremental.Config(entropy_threshold=0.01, dx_threshold=1e-9), incremental.Config(gating="LCG", dx_threshold=1e-9), incremental.Config(gating="none", selective=False, dx_threshold=1e-9)):
        after = metrics.global_error(edges, incremental.estimates(nodes, ordered, config)).first()["normalised_error"]
        assert after < before / 2
        finals.append(after)
    assert finals == pytest.approx([finals[0]] * 3, rel=1e-6)


def test_error_is_the_same_after_a_rigid_move(spark, data_dir):
    nodes, edges = frames(spark, data_dir)
    edges = edges.filter("type <> 'G'")
    c, s = math.cos(1.1), math.sin(1.1)
    moved = nodes.withColumns({"x": c * F.col("x") - s * F.col("y") + 5, "y": s * F.col("x") + c * F.col("y") - 2, "theta": F.col("theta") + 1.1})
    a, b = ({r["graph_id"]: r["chi2"] for r in metrics.global_error(edges, n).collect()} for n in (nodes, moved))
    assert a == pytest.approx(b)


def test_missing_parts_fail(spark):
    from graphtide.operators.linearise import checked, with_states

    bad = spark.createDataFrame([(0, None, 1, 2, 1.0, 1.0, 1.0, 1.0)], "graph_id long, type string, from_id long, to_id long, z1 double, z2 double, i11 double, i22 double")
    with pytest.raises(Exception, match="known type"):
        checked(bad).collect()
    with pytest.raises(Exception, match="two numbers"):
        checked(bad.withColumns({"type": F.lit("G"), "z2": F.lit(None).cast("double")})).collect()
    nodes = spark.createDataFrame([(0, 1, 1.0, 2.0, 0.0)], "graph_id long, node_id long, x double, y double, theta double")
    for first, second, message in ((1, 2, "second node is missing: 2"), (3, 1, "first node is missing: 3")):
        with pytest.raises(Exception, match=message):
            with_states(bad.withColumns({"type": F.lit("P"), "from_id": F.lit(first), "to_id": F.lit(second)}), nodes).collect()
    with pytest.raises(ValueError, match="lacks"):
        incremental.build(pd.DataFrame({"node_id": [0], "dim": [3], "x": [0.0], "y": [0.0], "theta": [0.0]}), pd.DataFrame({"from_id": [0], "to_id": [9]}))


def test_drawing_tables(spark, data_dir):
    nodes, edges = frames(spark, data_dir)
    assert plots.segments(edges, nodes).count() == edges.count()
    affected = spark.createDataFrame([(0, 0), (0, 999_999)], "graph_id long, node_id long")
    assert plots.highlighted(nodes, affected).count() == 1
    series = spark.createDataFrame([(0, 1, False), (0, 2, True)], "graph_id long, it long, loop_closure boolean")
    assert [tuple(r) for r in plots.closure_marks(series).collect()] == [(0, 2)]
