"""SQL for the queries of the catalogue, in the dialect of the engine that checks them, over the raw tables."""

from __future__ import annotations

GRAPH = """
ev as (select user_id as graph_id, event_id as e, event_type, row_number() over (partition by user_id order by ts, event_id) - 1 as k from events),
poses as (select graph_id, k as node_id, 3 as dim, k * 1.0e0 as x, (e % 16) / 8.0e0 as y, ((e * 7) % 64) / 16.0e0 - 2.0e0 as theta from ev),
marks as (select distinct graph_id, 1000000 + e % 5 as node_id, 2 as dim, (e % 5) * 4.0e0 as x, (e % 5) * 0.5e0 - 1.0e0 as y, cast(null as double) as theta from ev where k % 3 = 0),
nodes as (select * from poses union all select * from marks),
raw as (
  select graph_id, 0 as grp, k, 'P' as type, k as from_id, k + 1 as to_id, 1.0e0 as z1, ((e % 8) - 4) / 8.0e0 as z2, ((e % 16) - 8) / 16.0e0 as z3 from ev
  union all select graph_id, 1, k, 'P', k, k - 10, -10.0e0, ((e % 8) - 4) / 8.0e0, ((e % 16) - 8) / 16.0e0 from ev where k >= 10 and k % 7 = 0
  union all select graph_id, 2, k, 'L', k, 1000000 + e % 5, ((e % 32) - 16) / 4.0e0, ((e % 8) - 4) / 4.0e0, cast(null as double) from ev where k % 3 = 0
  union all select graph_id, 3, k, 'G', k, cast(null as bigint), k * 1.0e0 + ((e % 4) - 2) / 4.0e0, (e % 8) / 4.0e0, cast(null as double) from ev where event_type = 'purchase'),
edges as (select r.graph_id, row_number() over (partition by r.graph_id order by grp, k) as edge_pos, type, from_id, to_id, z1, z2, z3 from raw r left join nodes n on n.graph_id = r.graph_id and n.node_id = r.to_id where type = 'G' or n.node_id is not null)
"""

STATES = """,
st as (select d.*, f.x as xf, f.y as yf, f.theta as tf, t.x as xt, t.y as yt, t.theta as tt,
  case type when 'P' then 4.0e0 when 'L' then 2.0e0 else 1.0e0 end as i11, case type when 'P' then 0.5e0 when 'L' then 0.25e0 else 0e0 end as i12, case type when 'P' then 4.0e0 when 'L' then 2.0e0 else 1.0e0 end as i22, case type when 'P' then 16.0e0 else 0e0 end as i33
  from edges d join nodes f on f.graph_id = d.graph_id and f.node_id = d.from_id left join nodes t on t.graph_id = d.graph_id and t.node_id = d.to_id),
loc as (select *, cos(tf) as c, sin(tf) as s, cos(z3) as cz, sin(z3) as sz, xt - xf as dx, yt - yf as dy from st),
uv as (select *, c * dx + s * dy as u, c * dy - s * dx as v from loc),
er as (select *,
  case type when 'P' then cz * (u - z1) + sz * (v - z2) when 'L' then u - z1 else xf - z1 end as e1,
  case type when 'P' then cz * (v - z2) - sz * (u - z1) when 'L' then v - z2 else yf - z2 end as e2,
  case type when 'P' then (tt - tf - z3 + pi()) - 2 * pi() * floor((tt - tf - z3 + pi()) / (2 * pi())) - pi() else 0e0 end as e3
  from uv)
"""

JACOBIANS = """,
ja as (select *,
  case type when 'P' then -cz * c + sz * s when 'L' then -c else 1e0 end as a11, case type when 'P' then -cz * s - sz * c when 'L' then -s else 0e0 end as a12, case type when 'P' then cz * v - sz * u when 'L' then v else 0e0 end as a13,
  case type when 'P' then sz * c + cz * s when 'L' then s else 0e0 end as a21, case type when 'P' then sz * s - cz * c when 'L' then -c else 1e0 end as a22, case type when 'P' then -sz * v - cz * u when 'L' then -u else 0e0 end as a23,
  0e0 as a31, 0e0 as a32, case type when 'P' then -1e0 else 0e0 end as a33,
  case type when 'P' then cz * c - sz * s when 'L' then c else 0e0 end as b11, case type when 'P' then cz * s + sz * c when 'L' then s else 0e0 end as b12, 0e0 as b13,
  case type when 'P' then -sz * c - cz * s when 'L' then -s else 0e0 end as b21, case type when 'P' then -sz * s + cz * c when 'L' then c else 0e0 end as b22, 0e0 as b23,
  0e0 as b31, 0e0 as b32, case type when 'P' then 1e0 else 0e0 end as b33
  from er)
"""

BATCHED = """,
its as (select *, (edge_pos - 1) // 4 + 1 as it from edges),
ends as (select graph_id, it, edge_pos, from_id as node_id from its union all select graph_id, it, edge_pos, to_id from its where to_id is not null),
seen as (select graph_id, node_id, min(it) as first_it from ends where exists (select 1 from nodes n where n.graph_id = ends.graph_id and n.node_id = ends.node_id) group by graph_id, node_id),
offs as (select s.*, dim, x, y, cast(coalesce(sum(dim) over (partition by s.graph_id order by first_it, s.node_id rows between unbounded preceding and 1 preceding), 0) as bigint) as o from seen s join nodes n on n.graph_id = s.graph_id and n.node_id = s.node_id),
vars as (select graph_id, node_id, cast(unnest(range(o + 1, o + dim + 1)) as bigint) as var from offs),
steps as (select graph_id, var, node_id, ((var * 37) % 101 - 50) / 64.0e0 as dx from vars),
moved as (select distinct graph_id, node_id from steps where abs(dx) > 0.75)
"""

SMALL = """,
inc0 as (select graph_id, first_it as it, sum(dim) as d, sum(node_id) as s from offs group by graph_id, first_it),
inc as (select graph_id, it, sum(d) over w as n_vars, (sum(s % 64 + 1) over w) / 8.0e0 as half_logdet, cast(d * d as double) as update_flops from inc0 window w as (partition by graph_id order by it rows between unbounded preceding and current row))
"""

ORDERS = """,
named as (select graph_id, edge_pos, 0 as place, from_id as node_id from edges union all select graph_id, edge_pos, 1, to_id from edges where type = 'P'),
firsts as (select graph_id, node_id, edge_pos, place from named qualify row_number() over (partition by graph_id, node_id order by edge_pos, place) = 1),
orders as (select graph_id, node_id, edge_pos as first_pos, row_number() over (partition by graph_id order by edge_pos, place) as po from firsts)
"""


def r(expression: str, name: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0 as {name}"


def q(select: str, *parts: str) -> str:
    """`select` may begin with a comma and further tables."""
    return f"with {GRAPH}{''.join(parts)} {select}"


def _entry(m: str, n: str, i: int, j: int) -> str:
    """Entry (i, j) of M' W N as text, W the information matrix."""
    w = {(1, 1): "i11", (1, 2): "i12", (2, 1): "i12", (2, 2): "i22", (3, 3): "i33"}
    return " + ".join(f"{m}{a}{i} * {w[a, b]} * {n}{b}{j}" for a, b in w)


def _normal() -> str:
    entries = [(i, j) for i in (1, 2, 3) for j in (1, 2, 3)]
    block = lambda m, n: ", ".join(f"{_entry(m, n, i, j)} as h{i}{j}" for i, j in entries)
    parts = [
        f"select graph_id, from_id as row_node, from_id as col_node, {block('a', 'a')} from ja",
        f"select graph_id, to_id, to_id, {block('b', 'b')} from ja where to_id is not null",
        f"select graph_id, from_id, to_id, {block('a', 'b')} from ja where from_id < to_id",
        f"select graph_id, to_id, from_id, {block('b', 'a')} from ja where from_id > to_id",
        "select graph_id, min(node_id), min(node_id), 1e0, 0e0, 0e0, 0e0, 1e0, 0e0, 0e0, 0e0, 1e0 from poses group by graph_id having count(*) > 1",
    ]
    return q(f"select graph_id, row_node, col_node, {', '.join(r(f'sum(h{i}{j})', f'h{i}{j}', 4) for i, j in entries)} from ({' union all '.join(parts)}) group by graph_id, row_node, col_node", STATES, JACOBIANS)


def _gradient(name: str = "g", shift: str = "") -> str:
    w = {(1, 1): "i11", (1, 2): "i12", (2, 1): "i12", (2, 2): "i22", (3, 3): "i33"}
    part = lambda m, i: " + ".join(f"{m}{a}{i} * {x} * e{b}" for (a, b), x in w.items())
    both = " union all ".join(f"select graph_id, {node} as node_id, {', '.join(f'{part(m, i)} as g{i}' for i in (1, 2, 3))} from ja where {node} is not null" for node, m in (("from_id", "a"), ("to_id", "b")))
    return q(f"select graph_id, node_id, {', '.join(r(f'sum(g{i}){shift}', f'{name}{i}', 4) for i in (1, 2, 3))} from ({both}) group by graph_id, node_id", STATES, JACOBIANS)


ERRORS = ", chi as (select *, case type when 'P' then atan2(sin(tt - tf - z3), cos(tt - tf - z3)) else 0e0 end as ea, case type when 'P' then 3 else 2 end as m from er), wq as (select *, i11 * e1 * e1 + 2 * i12 * e1 * e2 + i22 * e2 * e2 + i33 * ea * ea as q from chi)"

TRUTH = """,
both_ as (select graph_id, node_id, x as px, y as py, x * 0.6e0 - y * 0.8e0 + 3 + (node_id % 5 - 2) / 64.0e0 as qx, x * 0.8e0 + y * 0.6e0 - 1 + (node_id % 3 - 1) / 32.0e0 as qy from poses),
sums as (select graph_id, count(*) as n, avg(px) as mpx, avg(py) as mpy, avg(qx) as mqx, avg(qy) as mqy, case when count(*) >= 2 then atan2(covar_pop(px, qy) - covar_pop(py, qx), covar_pop(px, qx) + covar_pop(py, qy)) end as phi from both_ group by graph_id),
al as (select graph_id, n, phi, mqx - (cos(phi) * mpx - sin(phi) * mpy) as tx, mqy - (sin(phi) * mpx + cos(phi) * mpy) as ty from sums)
"""

LINES = """
with ev as (select user_id as graph_id, event_id as e from events),
ln as (select graph_id, e * 6 + i as line_no, e, i from ev, (select unnest(range(0, 6)) as i))
"""

MARKS = """
with recursive """ + GRAPH.strip().removesuffix("\n") + ORDERS + """,
sights as (select d.graph_id, d.to_id, d.edge_pos, o.po, row_number() over (partition by d.graph_id, d.to_id order by d.edge_pos) as i from edges d join orders o on o.graph_id = d.graph_id and o.node_id = d.from_id where d.type = 'L'),
fold as (
  select graph_id, to_id, edge_pos, i, po as lo, po as hi, false as hit from sights where i = 1
  union all
  select s.graph_id, s.to_id, s.edge_pos, s.i,
    case when s.po - f.lo > 5 or f.hi - s.po > 5 then f.lo else least(f.lo, s.po) end, case when s.po - f.lo > 5 or f.hi - s.po > 5 then f.hi else greatest(f.hi, s.po) end, s.po - f.lo > 5 or f.hi - s.po > 5
  from fold f join sights s on s.graph_id = f.graph_id and s.to_id = f.to_id and s.i = f.i + 1)
select graph_id, edge_pos, hit as loop_closure from fold
"""

GROWTH = """,
last as (select graph_id, max(node_id) as n from poses group by graph_id),
mark_first as (select graph_id, to_id, min(edge_pos) as edge_pos from edges where type = 'L' group by graph_id, to_id),
mark_step as (select m.graph_id, to_id, m.edge_pos, n + row_number() over (partition by m.graph_id order by m.edge_pos) as step from mark_first m join last using (graph_id)),
stepped as (select d.graph_id, d.edge_pos, greatest(1, case when d.type = 'L' then m.step else greatest(from_id, coalesce(d.to_id, from_id)) end) as step,
  case when (d.type = 'P' and d.z1 > 0) or (d.type = 'L' and m.edge_pos = d.edge_pos) then 'growth' else 'closure' end as kind
  from edges d left join mark_step m on m.graph_id = d.graph_id and m.to_id = d.to_id)
"""

AT_GUESS = """
with recursive """ + GRAPH.strip() + STATES + ERRORS + GROWTH + """,
sd as (select d.*, row_number() over (partition by d.graph_id order by step, kind = 'closure', d.edge_pos) as seq from edges d join stepped s on s.graph_id = d.graph_id and s.edge_pos = d.edge_pos),
named as (select graph_id, seq, 0 as place, from_id as node_id from sd union all select graph_id, seq, 1, to_id from sd where type = 'P'),
firsts as (select graph_id, node_id, seq, place from named qualify row_number() over (partition by graph_id, node_id order by seq, place) = 1),
orders as (select graph_id, node_id, seq as first_seq, row_number() over (partition by graph_id order by seq, place) as po from firsts),
sights as (select d.graph_id, d.to_id, d.seq, o.po, row_number() over (partition by d.graph_id, d.to_id order by d.seq) as i from sd d join orders o on o.graph_id = d.graph_id and o.node_id = d.from_id where d.type = 'L'),
fold as (
  select graph_id, to_id, seq, i, po as lo, po as hi, false as hit from sights where i = 1
  union all
  select s.graph_id, s.to_id, s.seq, s.i, case when s.po - f.lo > 4 or f.hi - s.po > 4 then f.lo else least(f.lo, s.po) end, case when s.po - f.lo > 4 or f.hi - s.po > 4 then f.hi else greatest(f.hi, s.po) end, s.po - f.lo > 4 or f.hi - s.po > 4
  from fold f join sights s on s.graph_id = f.graph_id and s.to_id = f.to_id and s.i = f.i + 1),
hits as (
  select d.graph_id, d.seq, a.first_seq < d.seq and b.first_seq < d.seq and abs(a.po - b.po) > 4 as hit from sd d join orders a on a.graph_id = d.graph_id and a.node_id = d.from_id join orders b on b.graph_id = d.graph_id and b.node_id = d.to_id where d.type = 'P'
  union all select graph_id, seq, hit from fold),
came as (select graph_id, node_id, min(seq) as seq from (select graph_id, seq, from_id as node_id from sd union all select graph_id, seq, to_id from sd where to_id is not null) group by graph_id, node_id),
grown as (select graph_id, seq, sum(case when node_id >= 1000000 then 2 else 3 end) as d from came group by graph_id, seq),
series as (
  select sd.graph_id, sd.seq, coalesce(hit, false) as hit, d is null as old, sum(coalesce(d, 0)) over w as n_vars, sum(q) over w / sum(m) over w as err
  from sd join wq on wq.graph_id = sd.graph_id and wq.edge_pos = sd.edge_pos left join hits h on h.graph_id = sd.graph_id and h.seq = sd.seq left join grown g on g.graph_id = sd.graph_id and g.seq = sd.seq
  window w as (partition by sd.graph_id order by sd.seq rows between unbounded preceding and current row))
select graph_id, seq as it, hit as loop_closure, cast(n_vars as bigint) as n_vars, hit as gated, old and not hit as skipped, 0 as gn, case when hit or not old then round(err, 4) + 0.0 end as err from series
"""

ORACLE_SQL = {
    "pose_nodes": q("select graph_id, node_id, x, y, theta from poses"),
    "landmark_nodes": q("select graph_id, node_id, x, y from marks"),
    "edges_pos": q("select * from edges"),
    "info_symmetrised": q("select graph_id, edge_pos, i11 as w11, i12 as w12, 0e0 as w13, i12 as w21, i22 as w22, 0e0 as w23, 0e0 as w31, 0e0 as w32, i33 as w33 from st", STATES),
    "dangling_edges": q(", kept as (select * from nodes where node_id % 7 <> 3) select distinct graph_id, node_id from (select graph_id, from_id as node_id from edges union all select graph_id, to_id from edges where to_id is not null) p where not exists (select 1 from kept k where k.graph_id = p.graph_id and k.node_id = p.node_id)"),
    "parse_g2o_nodes": LINES + "select graph_id, case when i = 0 then e when i = 1 then e + 1000000 end as node_id, max(case when i = 0 then 3 else 2 end) as dim, max(cast(case when i = 0 then e % 16 else e % 5 end as double)) as x, max(cast(case when i = 0 then e % 8 else e % 3 end as double)) as y, max(case when i = 0 then cast(e % 4 as double) end) as theta, max(line_no) as file_pos from ln where i in (0, 1) group by 1, 2",
    "parse_g2o_edges": LINES + "select graph_id, line_no, case i when 2 then 'P' else 'L' end as type, e as from_id, case i when 2 then e + 1 else e + 1000000 end as to_id, case i when 2 then 1e0 else 2e0 end as z1, case i when 2 then 0.5e0 else cast(e % 7 as double) end as z2, case i when 2 then -0.25e0 end as z3, case i when 2 then 4e0 else 2e0 end as i11, case i when 2 then 0.5e0 else 0.25e0 end as i12, 0e0 as i13, case i when 2 then 4e0 else 2e0 end as i22, 0e0 as i23, case i when 2 then 16e0 else 0e0 end as i33 from ln where (i = 2 and e % 3 = 0) or i = 3",
    "parse_toro": "select user_id as graph_id, event_id as line_no, 'P' as type, event_id as from_id, event_id + 1 as to_id, 1e0 as z1, cast(event_id % 4 as double) as z2, 0.5e0 as z3, 11e0 as i11, 12e0 as i12, 13e0 as i13, 22e0 as i22, case event_id % 4 when 0 then 23e0 else -1e0 end as i23, 33e0 as i33 from events where event_id % 4 in (0, 1)",
    "parse_toro_nodes": "select user_id as graph_id, event_id as node_id, 3 as dim, cast(event_id % 4 as double) as x, -0.5e0 as y, cast(event_id % 8 as double) as theta, event_id as file_pos from events where event_id % 3 < 2",
    "batch_assign": q("select graph_id, edge_pos, it from its", BATCHED),
    "first_seen_batch": q("select * from seen", BATCHED),
    "new_nodes_per_batch": q("select graph_id, first_it as it, count(*) as new_nodes from seen group by graph_id, first_it", BATCHED),
    "node_offsets": q("select graph_id, node_id, cast(o as bigint) as \"offset\" from offs", BATCHED),
    "var2node": q("select graph_id, var, node_id from vars", BATCHED),
    "seeded_states": q("select graph_id, first_it, node_id, x, y from offs", BATCHED),
    "incidence": q("select graph_id, node_id, count(distinct edge_pos) as degree, string_agg(distinct cast(edge_pos as varchar), ',' order by edge_pos) as edge_list from ends group by graph_id, node_id", BATCHED).replace("string_agg(distinct cast(edge_pos as varchar), ',' order by edge_pos)", "array_to_string(list_sort(list(distinct edge_pos)), ',')"),
    "growth_closure_order": q("select graph_id, edge_pos, row_number() over (partition by graph_id order by step, kind = 'closure', edge_pos) as seq, step, kind from stepped", GROWTH),
    "growth_candidates": q("select d.graph_id, d.edge_pos from edges d where type <> 'G' and (from_id % 2 = 0) <> (to_id % 2 = 0)"),
    "disconnected_edges": q(", cut as (select * from edges where type = 'G' or (type = 'P' and z1 > 0 and from_id % 30 <> 29)) select graph_id, count(*) as dropped from cut where from_id >= 30 group by graph_id"),
    "loop_closure_pose": q("select d.graph_id, d.edge_pos, a.first_pos < d.edge_pos and b.first_pos < d.edge_pos and abs(a.po - b.po) > 5 as loop_closure from edges d join orders a on a.graph_id = d.graph_id and a.node_id = d.from_id join orders b on b.graph_id = d.graph_id and b.node_id = d.to_id where d.type = 'P'", ORDERS),
    "loop_closure_landmark": MARKS,
    "wrap_angle": q(f"select graph_id, node_id, {r('w - 2 * pi() * floor(w / (2 * pi())) - pi()', 'wrapped')} from (select *, theta * 5 + node_id % 3 + pi() as w from poses)"),
    "se2_matrix": q(f"select graph_id, node_id, {r('cos(theta)', 'm11')}, {r('-sin(theta)', 'm12')}, {r('x', 'm13')}, {r('sin(theta)', 'm21')}, {r('cos(theta)', 'm22')}, {r('y', 'm23')} from poses"),
    "se2_vector": q(f"select graph_id, node_id, {r('x', 'vx')}, {r('y', 'vy')}, {r('atan2(sin(theta), cos(theta))', 'vt')} from poses"),
    "se2_inverse": q(f"select graph_id, node_id, {r('cos(theta)', 'm11')}, {r('sin(theta)', 'm12')}, {r('-(cos(theta) * x + sin(theta) * y)', 'm13')}, {r('-sin(theta)', 'm21')}, {r('cos(theta)', 'm22')}, {r('sin(theta) * x - cos(theta) * y', 'm23')} from poses"),
    "se2_compose": q(f"select graph_id, edge_pos, {r('u', 'rx')}, {r('v', 'ry')}, {r('cos(tt - tf)', 'rc')}, {r('sin(tt - tf)', 'rs')} from uv where type = 'P'", STATES),
    "residual_pose_pose": q(f"select graph_id, edge_pos, {r('e1', 'e1')}, {r('e2', 'e2')}, {r('e3', 'e3')} from er where type = 'P'", STATES),
    "residual_pose_landmark": q(f"select graph_id, edge_pos, {r('e1', 'e1')}, {r('e2', 'e2')} from er where type = 'L'", STATES),
    "residual_gnss": q(f"select graph_id, edge_pos, {r('e1', 'e1')}, {r('e2', 'e2')} from er where type = 'G'", STATES),
    "jacobian_blocks": q("select graph_id, edge_pos, type, " + ", ".join(r(f"{m}{i}{j}", f"{m}{i}{j}") for m in "ab" for i in (1, 2, 3) for j in (1, 2, 3)) + " from ja", STATES, JACOBIANS),
    "whitened_residual": q(f", wh as (select *, sqrt(i11 * i22 - i12 * i12) as d from er where type <> 'P') select graph_id, edge_pos, {r('((i11 + d) * e1 + i12 * e2) / sqrt(i11 + i22 + 2 * d)', 'r1')}, {r('(i12 * e1 + (i22 + d) * e2) / sqrt(i11 + i22 + 2 * d)', 'r2')} from wh", STATES),
    # The pose information's upper left part is a I + b J with eigenvalues a + b and a - b.
    "whitened_residual_pose": q(f"select graph_id, edge_pos, {r('(sqrt(4.5e0) + sqrt(3.5e0)) / 2 * e1 + (sqrt(4.5e0) - sqrt(3.5e0)) / 2 * e2', 'r1')}, {r('(sqrt(4.5e0) - sqrt(3.5e0)) / 2 * e1 + (sqrt(4.5e0) + sqrt(3.5e0)) / 2 * e2', 'r2')}, {r('4 * e3', 'r3')} from er where type = 'P'", STATES),
    "chi2_per_graph": q(f"select graph_id, count(*) as n_edges, cast(sum(m) as bigint) as n_measurements, {r('sum(q)', 'chi2', 4)}, {r('sum(q) / greatest(sum(m), 1)', 'normalised_error')} from wq group by graph_id", STATES, ERRORS),
    "chi2_by_type": q(f"select type, count(*) as n_edges, {r('sum(q)', 'chi2', 2)} from wq group by type", STATES, ERRORS),
    "normalised_error": q(f"select {r('sum(q) / greatest(sum(m), 1)', 'normalised_error')} from wq", STATES, ERRORS),
    "ate_alignment": q(f"select graph_id, n, {r('phi', 'phi')}, {r('tx', 'tx')}, {r('ty', 'ty')} from al", TRUTH),
    "ate_rmse": q(f"select graph_id, count(*) as n, {r('sqrt(avg(pow(cos(phi) * px - sin(phi) * py + tx - qx, 2) + pow(sin(phi) * px + cos(phi) * py + ty - qy, 2)))', 'rmse')} from both_ join al using (graph_id) group by graph_id", TRUTH),
    "normal_blocks": _normal(),
    "gradient_blocks": _gradient(),
    "gn_step_image": _gradient("q", " + 3e-6"),
    "incremental_at_guess": AT_GUESS,
    "affected_vars": q("select graph_id, var from vars where exists (select 1 from moved m where m.graph_id = vars.graph_id and m.node_id = vars.node_id)", BATCHED),
    "affected_edges": q("select distinct graph_id, edge_pos from ends where exists (select 1 from moved m where m.graph_id = ends.graph_id and m.node_id = ends.node_id)", BATCHED),
    "converged": q("select graph_id, max(abs(dx)) as most, max(abs(dx)) <= 0.75 as converged from steps group by graph_id", BATCHED),
    "info_gain": q(f"select graph_id, it, {r('coalesce(half_logdet - lag(half_logdet) over w * (n_vars * 1e0 / lag(n_vars) over w), 0)', 'di')} from inc window w as (partition by graph_id order by it)", BATCHED, SMALL),
    "cumulative_flops": q("select graph_id, it, sum(update_flops) over (partition by graph_id order by it rows between unbounded preceding and current row) as cumulative_flops from inc", BATCHED, SMALL),
    "run_summary": q(f"select graph_id, count(*) as increments, count(*) filter (where it % 3 = 0) as skipped, count(*) filter (where it % 5 = 0) as loop_closures, cast(sum(it % 4) as bigint) as iterations, {r('max_by(half_logdet, it) filter (where it % 3 <> 0)', 'final_error')}, {r('avg(half_logdet) filter (where it % 3 <> 0)', 'mean_error')}, {r('max_by(half_logdet / 2, it) filter (where it % 3 <> 0)', 'final_ate')}, {r('avg(half_logdet / 2) filter (where it % 3 <> 0)', 'mean_ate')}, {r('avg(update_flops)', 'mean_update_flops')} from inc group by graph_id", BATCHED, SMALL),
    "plot_segments": q("select d.graph_id, edge_pos, d.type, f.x as x1, f.y as y1, case d.type when 'G' then z1 else t.x end as x2, case d.type when 'G' then z2 else t.y end as y2 from edges d join nodes f on f.graph_id = d.graph_id and f.node_id = d.from_id left join nodes t on t.graph_id = d.graph_id and t.node_id = d.to_id"),
    "plot_new_gnss": q("select graph_id, min(edge_pos) as edge_pos, z1, z2 from edges where type = 'G' and edge_pos > 40 group by graph_id, z1, z2"),
    "plot_highlight": q("select graph_id, node_id, x, y from nodes where exists (select 1 from moved m where m.graph_id = nodes.graph_id and m.node_id = nodes.node_id)", BATCHED),
}


def one(sql: str) -> str:
    """The same SQL over one graph of all events."""
    return sql.replace("user_id as graph_id", "cast(0 as bigint) as graph_id").replace("partition by user_id order by", "order by").replace("1000000 + e % 5", "1000000000000 + e % 5")


ORACLE_SQL |= {
    "one_graph_growth": one(q("select edge_pos, row_number() over (order by step, kind = 'closure', edge_pos) as seq, step, kind from stepped", GROWTH)),
    "one_graph_step_image": f"select node_id, q1, q2, q3 from ({one(_gradient('q', ' + 3e-6'))})",
}
