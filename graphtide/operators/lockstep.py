"""Incremental runs of many small graphs side by side: the rule of `incremental.run`, with graphs as the last axis of every array.

A small graph's increment costs numpy's calls rather than its arithmetic. Here one call does a step for all graphs of a
batch that are at the same place. Poses are eliminated in the order of insertion, landmarks after them; a row of the factor reaches
from the first column that an edge of any of the batch's graphs gives it (its envelope, within which all filling stays). Rows that a
graph doesn't have, or not yet, count as those of the identity. Rows with wide envelopes are made a few at a time.
`incremental.increments` has the same rule in Java, which costs less.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np

from graphtide.operators.solver import Filling, Graph

#: Rows that reach further back than this are made together, as many at once.
WIDE, TOGETHER = 8, 8
#: Edges that are linearised at once, which keeps the numbers in the cache.
CHUNK = 4096
#: Places of a batch's matrix (144 bytes each with the factor's), beyond which it is cut in two.
MOST = 1 << 21


def _linearised(kind, f, t, z, upper: bool = False, jacobians: bool = True):
    """Residuals (3, n) and the Jacobian (3, 6, n) of edges with states f and t (3, n)."""
    n = len(kind)
    c, s = np.cos(f[2]), np.sin(f[2])
    dx, dy = t[0] - f[0], t[1] - f[1]
    u, v = c * dx + s * dy, c * dy - s * dx
    pose, mark, fix = kind == 0, kind == 1, kind == 2
    cz, sz = np.where(pose, np.cos(z[2]), 1.0), np.where(pose, np.sin(z[2]), 0.0)
    r = np.empty((3, n))
    du, dv = u - z[0], v - z[1]
    r[0] = np.where(fix, f[0] - z[0], cz * du + sz * dv)
    r[1] = np.where(fix, f[1] - z[1], cz * dv - sz * du)
    angle = t[2] - f[2] - z[2]
    r[2] = np.where(pose, np.arctan2(np.sin(angle), np.cos(angle)) if upper else np.mod(angle + np.pi, 2 * np.pi) - np.pi, 0.0)
    if not jacobians:
        return r, None
    j = np.zeros((3, 6, n))
    # Both rotations of a pose's edge at once; cz and sz are those of none for a landmark's.
    cc, ss = cz * c - sz * s, cz * s + sz * c
    two = pose | mark
    cc, ss = np.where(two, cc, 0.0), np.where(two, ss, 0.0)
    j[0, 0], j[0, 1], j[1, 0], j[1, 1] = -cc, -ss, ss, -cc
    j[0, 3], j[0, 4], j[1, 3], j[1, 4] = cc, ss, -ss, cc
    j[0, 2], j[1, 2] = np.where(two, cz * v - sz * u, 0.0), np.where(two, -sz * v - cz * u, 0.0)
    j[2, 2], j[2, 5] = np.where(pose, -1.0, 0.0), np.where(pose, 1.0, 0.0)
    j[0, 0], j[1, 1] = np.where(fix, 1.0, j[0, 0]), np.where(fix, 1.0, j[1, 1])
    return r, j


class TooLarge(Exception):
    """A batch's envelopes don't fit."""


class Batch:
    """H, its factor and the gradient of some graphs; H and the factor by envelopes."""

    def __init__(self, graphs: list[Graph]) -> None:
        self.size = size = len(graphs)
        poses = max(int((g.dims == 3).sum()) for g in graphs)
        self.rows: list[np.ndarray] = []
        for g in graphs:
            pose = g.dims == 3
            self.rows.append(np.where(pose, np.cumsum(pose) - 1, poses + np.cumsum(~pose) - 1))
        self.n = n = max(poses, max(int(r.max()) + 1 for r in self.rows))
        most = max(len(g.kind) for g in graphs)
        self.kind, self.a, self.b = np.full((most, size), 2), np.zeros((most, size), dtype=np.int64), np.full((most, size), -1)
        self.z, self.w, self.x = np.zeros((3, most, size)), np.zeros((3, 3, most, size)), np.zeros((n, 3, size))
        #: Which variables a graph has at its end.
        self.has = np.zeros((n, 3, size), dtype=bool)
        for i, (g, row) in enumerate(zip(graphs, self.rows, strict=True)):
            m = len(g.kind)
            self.kind[:m, i], self.a[:m, i] = g.kind, row[g.a]
            self.b[:m, i] = np.where(g.b >= 0, row[np.maximum(g.b, 0)], -1)
            self.z[:, :m, i], self.w[:, :, :m, i] = g.z.T, g.w.transpose(1, 2, 0)
            self.x[row, :, i] = g.x
            self.has[row, :2, i], self.has[row, 2, i] = True, g.dims == 3
        first = np.arange(n)
        high, low = np.maximum(self.a, self.b), np.where(self.b >= 0, np.minimum(self.a, self.b), self.a)
        np.minimum.at(first, high.ravel(), low.ravel())
        self._panels(first)
        s = self.slots
        if size > 1 and s * size > MOST:
            raise TooLarge(s)
        self.at_a, self.at_b = self.slot(self.a, self.a), self.slot(np.where(self.b >= 0, self.b, self.a), np.where(self.b >= 0, self.b, self.a))
        self.at_ab = self.slot(high, low)
        self.h, self.g = np.zeros((s, 9, size)), np.zeros((n, 3, size))
        self.lower, self.inverse = np.zeros((s, 9, size)), np.zeros((n, 9, size))
        self.y, self.logs = np.zeros((n, 3, size)), np.zeros((n, size))
        self.good, self.parts = np.zeros(size, dtype=np.int64), np.zeros((33, most * size))
        self.edges = np.zeros(size, dtype=np.int64)
        # Where the first node's variables have their place in H; a landmark's second stands twice.
        self.anchor = np.array([[(self.slot(row[0], row[0]) * 9 + c) * size + i for c in ((0, 4, 8) if g.dims[0] == 3 else (0, 4, 4))] for i, (g, row) in enumerate(zip(graphs, self.rows, strict=True))])

    def _panels(self, first: np.ndarray) -> None:
        n, at, self.panels, self.slots = self.n, 0, [], 0
        self.start, self.begin, self.panel = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        while at < n:
            end = at + 1
            if first[at] < at - WIDE:
                while end < n and end - at < TOGETHER and first[end] < at - WIDE:
                    end += 1
            begin = int(first[at:end].min())
            width = end - begin
            for i in range(at, end):
                self.start[i], self.begin[i], self.panel[i] = self.slots + (i - at) * width, begin, len(self.panels)
            self.panels.append((at, end, begin, self.slots))
            self.slots += (end - at) * width
            at = end

    def slot(self, row, column):
        return self.start[row] + column - self.begin[row]

    # ---- the matrix; an edge of a graph is named by its place in (edges, graphs)

    def _states(self, at: np.ndarray, p: np.ndarray) -> np.ndarray:
        return np.take(self.x.reshape(-1), at * (3 * self.size) + p + self.size * np.arange(3)[:, None])

    def _parts(self, ep: np.ndarray) -> np.ndarray:
        """(33, n): the first node's block, the second's, the mixed one (its row the later in elimination; a self-loop's both together) and the gradients."""
        out = np.empty((33, len(ep)))
        z, w = self.z.reshape(3, -1), self.w.reshape(9, -1)
        for i in range(0, len(ep), CHUNK):
            some = ep[i : i + CHUNK]
            a, b, p = self.a.reshape(-1)[some], self.b.reshape(-1)[some], some % self.size
            to = np.maximum(b, 0)
            r, j = _linearised(self.kind.reshape(-1)[some], self._states(a, p), self._states(to, p), np.take(z, some, axis=1))
            j[:, 2] *= self.has[a, 2, p]
            j[:, 5] *= self.has[to, 2, p]
            wj = np.einsum("ijn,jkn->ikn", np.take(w, some, axis=1).reshape(3, 3, -1), j)
            made = out[:, i : i + CHUNK]
            made[:9] = np.einsum("jin,jkn->ikn", j[:, :3], wj[:, :3]).reshape(9, -1)
            made[9:18] = np.einsum("jin,jkn->ikn", j[:, 3:], wj[:, 3:]).reshape(9, -1)
            ab = np.einsum("jin,jkn->ikn", j[:, :3], wj[:, 3:])
            ba = ab.transpose(1, 0, 2)
            made[18:27] = np.where(a == b, ab + ba, np.where(a > b, ab, ba)).reshape(9, -1)
            made[27:] = np.einsum("jin,jn->in", wj, r)
        return out

    def _add(self, ep: np.ndarray, parts: np.ndarray) -> None:
        p = ep % self.size
        nine, three, flat = self.size * np.arange(9)[:, None], self.size * np.arange(3)[:, None], self.h.reshape(-1)
        for k, at in enumerate((self.at_a, self.at_b, self.at_ab)):
            np.add.at(flat, (at.reshape(-1)[ep] * (9 * self.size) + p + nine).reshape(-1), parts[9 * k : 9 * k + 9].reshape(-1))
        a, b = self.a.reshape(-1)[ep], self.b.reshape(-1)[ep]
        to, sides = np.where(b >= 0, b, a), self.g.reshape(-1)
        np.add.at(sides, (a * (3 * self.size) + p + three).reshape(-1), parts[27:30].reshape(-1))
        np.add.at(sides, (to * (3 * self.size) + p + three).reshape(-1), parts[30:].reshape(-1))
        np.minimum.at(self.good, p, np.minimum(a, to))

    def _cleared(self, who: np.ndarray) -> None:
        if len(who) == self.size:
            self.h[:], self.g[:] = 0, 0
        else:
            self.h[:, :, who], self.g[:, :, who] = 0, 0
        self.good[who] = 0
        self.h.reshape(-1)[self.anchor[who].reshape(-1)] = 1

    def grow(self, who: np.ndarray, n_edges: np.ndarray) -> None:
        new = self.edges[who] == 0
        if new.any():
            self._cleared(who[new])
        ep = np.concatenate([np.arange(self.edges[i], m) * self.size + i for i, m in zip(who.tolist(), n_edges.tolist(), strict=True)])
        self.edges[who] = n_edges
        made = self._parts(ep)
        self.parts[:, ep] = made
        self._add(ep, made)

    def _inside(self, who: np.ndarray) -> np.ndarray:
        """(edges, graphs): the edges so far of these graphs."""
        count = np.zeros(self.size, dtype=np.int64)
        count[who] = self.edges[who]
        return np.arange(int(count.max()))[:, None] < count

    def moved(self, who: np.ndarray, nodes: np.ndarray) -> None:
        """Linearises the edges of these nodes (n, who) again; sums anew where more than half of a graph's edges changed, so that no rounding gathers."""
        # One row more for what unary edges don't have.
        flag = np.zeros((self.n + 1, self.size), dtype=bool)
        flag[:-1, who] = nodes
        inside = self._inside(who)
        most, column = len(inside), np.arange(self.size)
        flags = flag.reshape(-1)
        hit = inside & (np.take(flags, self.a[:most] * self.size + column) | np.take(flags, np.where(self.b[:most] < 0, self.n, self.b[:most]) * self.size + column))
        whole = 2 * hit.sum(axis=0) > self.edges
        ep = np.flatnonzero(hit)
        made = self._parts(ep)
        part = ~whole[ep % self.size]
        if part.any():
            self._add(ep[part], made[:, part] - np.take(self.parts, ep[part], axis=1))
        self.parts[:, ep] = made
        if whole[who].any():
            self._summed(who[whole[who]])

    def _summed(self, who: np.ndarray) -> None:
        self._cleared(who)
        ep = np.flatnonzero(self._inside(who))
        self._add(ep, np.take(self.parts, ep, axis=1))

    def anew(self, who: np.ndarray) -> None:
        ep = np.flatnonzero(self._inside(who))
        self.parts[:, ep] = self._parts(ep)
        self._summed(who)

    # ---- the factor

    def _many(self, who: np.ndarray) -> bool:
        """Whether it is cheaper to do all graphs where they are than to take these out. Others are done along, which leaves them as valid as they were."""
        return 2 * len(who) >= self.size

    def update(self, who: np.ndarray, n: int) -> None:
        """Brings rows up to n of these graphs up to date. A graph without a factor gets NaN from its bad row on."""
        stale = self.good[who] < n
        # Graphs that changed far back are done apart from those that changed near the end.
        far = stale & (self.good[who] < n // 2)
        for some in (who[far], who[stale & ~far]):
            if len(some):
                self._update(some, int(self.good[some].min()), n)
                self.good[some] = n

    def _update(self, who: np.ndarray, since: int, n: int) -> None:
        todo = self.panels[self.panel[since] : self.panel[n - 1] + 1]
        lo, hi, made = todo[0][0], todo[-1][1], todo[0][3]
        s1 = self.panels[self.panel[hi]][3] if hi < self.n else self.slots
        low = self.panels[self.panel[min(p[2] for p in todo)]][0]
        s0 = self.panels[self.panel[low]][3]
        diagonal = self.h[self.slot(np.arange(lo, hi), np.arange(lo, hi))]
        if self._many(who):
            m = self.size
            self.lower[made:s1], self.y[lo:hi], self.inverse[lo:hi] = self.h[made:s1], self.g[lo:hi], 0
            lower, inverse, y = self.lower[s0:s1], self.inverse[low:hi], self.y[low:hi]
            self._rows(todo, lo, low, s0, lower.reshape(-1, 3, 3, m), inverse.reshape(-1, 3, 3, m), y, diagonal)
        else:
            m = len(who)
            lower = np.concatenate([np.take(self.lower[s0:made], who, axis=2), np.take(self.h[made:s1], who, axis=2)])
            inverse = np.concatenate([np.take(self.inverse[low:lo], who, axis=2), np.zeros((hi - lo, 9, m))])
            y = np.concatenate([np.take(self.y[low:lo], who, axis=2), np.take(self.g[lo:hi], who, axis=2)])
            self._rows(todo, lo, low, s0, lower.reshape(-1, 3, 3, m), inverse.reshape(-1, 3, 3, m), y, np.take(diagonal, who, axis=2))
            self.lower[made:s1, :, who], self.inverse[lo:hi, :, who], self.y[lo:hi, :, who] = lower[made - s0 :], inverse[lo - low :], y[lo - low :]
        self.logs[lo:hi] = -np.log(self.inverse[lo:hi, 0] * self.inverse[lo:hi, 4] * self.inverse[lo:hi, 8])

    def _rows(self, todo, lo: int, low: int, s0: int, lower: np.ndarray, inverse: np.ndarray, y: np.ndarray, diagonal: np.ndarray) -> None:
        """Makes the panels `todo` in place; arrays begin at row `low` and slot `s0`."""
        # Variables that a graph hasn't, or not yet, are those of the identity.
        missing = diagonal[:, [0, 4, 8]] == 0
        some = missing.any(axis=(1, 2))
        for r0, r1, begin, off in todo:
            width = r1 - begin
            panel = lower[off - s0 : off - s0 + (r1 - r0) * width].reshape(r1 - r0, width, 3, 3, -1)
            for j in range(begin, r0):
                k = max(begin, int(self.begin[j]))
                if j > k:
                    at = self.start[j] - s0 - self.begin[j]
                    panel[:, j - begin] -= np.einsum("rkabz,kcbz->racz", panel[:, k - begin : j - begin], lower[at + k : at + j])
                panel[:, j - begin] = np.einsum("rabz,cbz->racz", panel[:, j - begin], inverse[j - low])
            for i in range(r0, r1):
                here = panel[i - r0]
                for j in range(r0, i):
                    here[j - begin] -= np.einsum("kabz,kcbz->acz", here[: j - begin], panel[j - r0, : j - begin])
                    here[j - begin] = np.einsum("abz,cbz->acz", here[j - begin], inverse[j - low])
                d = here[i - begin]
                if i > begin:
                    d -= np.einsum("kabz,kcbz->acz", here[: i - begin], here[: i - begin])
                    y[i - low] -= np.einsum("kabz,kbz->az", here[: i - begin], y[begin - low : i - low])
                if some[i - lo]:
                    for k in range(3):
                        d[k, k] = np.where(missing[i - lo, k], 1.0, d[k, k])
                inv = inverse[i - low]
                inv[0, 0] = 1 / np.sqrt(d[0, 0])
                l1, l2 = d[1:, 0] * inv[0, 0]
                inv[1, 1] = 1 / np.sqrt(d[1, 1] - l1 * l1)
                l21 = (d[2, 1] - l2 * l1) * inv[1, 1]
                inv[2, 2] = 1 / np.sqrt(d[2, 2] - l2 * l2 - l21 * l21)
                inv[1, 0] = -l1 * inv[0, 0] * inv[1, 1]
                inv[2, 1] = -l21 * inv[1, 1] * inv[2, 2]
                inv[2, 0] = -(l2 * inv[0, 0] + l21 * inv[1, 0]) * inv[2, 2]
                y[i - low] = np.einsum("abz,bz->az", inv, y[i - low])

    def half_logdet(self, who: np.ndarray, n: int) -> np.ndarray:
        """NaN without a factor, by which the next update begins anew."""
        self.update(who, n)
        out = self.logs[:n, who].sum(axis=0)
        bad = ~np.isfinite(out)
        self.good[who[bad]] = 0
        return np.where(bad, np.nan, out)

    def solve(self, who: np.ndarray, n: int, since: int) -> tuple[np.ndarray, np.ndarray]:
        """The solution (n, 3, who), 0 before row `since`, and which graphs have none."""
        bad = np.isnan(self.half_logdet(who, n))
        first = self.panels[self.panel[since]][3]
        end, every = self.slot(n - 1, n - 1) + 1, self._many(who)
        taken = lambda v: v if every else np.take(v, who, axis=2)
        m = self.size if every else len(who)
        lower, inverse = taken(self.lower[first:end]).reshape(-1, 3, 3, m), taken(self.inverse[since:n]).reshape(-1, 3, 3, m)
        x, r = np.zeros((n, 3, m)), taken(self.y[:n]).copy()
        for i in range(n - 1, since - 1, -1):
            x[i] = np.einsum("baz,bz->az", inverse[i - since], r[i])
            begin = max(since, int(self.begin[i]))
            if begin < i:
                at = self.start[i] - first - self.begin[i]
                r[begin:i] -= np.einsum("kbaz,bz->kaz", lower[at + begin : at + i], x[i])
        if every:
            x = np.take(x, who, axis=2)
        return x, bad | ~np.isfinite(x).all(axis=(0, 1))

    def chi2(self, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The weighted error of each graph's edges so far, and how many numbers they measure."""
        inside, total = self._inside(who), np.zeros(self.size)
        ep, z, w = np.flatnonzero(inside), self.z.reshape(3, -1), self.w.reshape(9, -1)
        for i in range(0, len(ep), CHUNK):
            some = ep[i : i + CHUNK]
            p = some % self.size
            r, _ = _linearised(self.kind.reshape(-1)[some], self._states(self.a.reshape(-1)[some], p), self._states(np.maximum(self.b.reshape(-1)[some], 0), p), np.take(z, some, axis=1), upper=True, jacobians=False)
            total += np.bincount(p, np.einsum("in,ijn,jn->n", r, np.take(w, some, axis=1).reshape(3, 3, -1), r), self.size)
        return total[who], np.where(inside, np.where(self.kind[: len(inside)] == 0, 3, 2), 0).sum(axis=0)[who]


def _rmse(x: np.ndarray, target: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """solver.trajectory_rmse of each graph: x, target (n, 2, who), inside (n, who)."""
    if not np.isfinite(np.where(inside[:, None], x, 0)).all() or not np.isfinite(np.where(inside[:, None], target, 0)).all():
        raise ValueError("two finite n x 2 arrays with n >= 2 are needed")
    count = inside.sum(axis=0)
    mean = lambda v: np.where(inside[:, None], v, 0).sum(axis=0) / count
    a, b = np.where(inside[:, None], x - mean(x), 0), np.where(inside[:, None], target - mean(target), 0)
    phi = np.arctan2((a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]).sum(axis=0), (a * b).sum(axis=(0, 1)))
    c, s = np.cos(phi), np.sin(phi)
    return np.sqrt(((c * a[:, 0] - s * a[:, 1] - b[:, 0]) ** 2 + (s * a[:, 0] + c * a[:, 1] - b[:, 1]) ** 2).sum(axis=0) / count)


def _places(graph: Graph, sizes: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Where each increment is, never falling: before the first landmark by the number of nodes, then by increments. Graphs at one place go together."""
    marks = np.concatenate([[0], np.cumsum(graph.dims == 2)])
    out, last, within = [], -1, 0
    for _, nodes in sizes:
        if marks[nodes] == 0:
            within = within + 1 if nodes == last else 0
            out.append((0, nodes, within))
            last = nodes
        else:
            within = within + 1 if last == -2 else 0
            out.append((1, within, 0))
            last = -2
    return out


def run(graphs: list[tuple[Graph, list[tuple[int, int]], list[bool], dict]], config) -> list[list[tuple]]:
    """For each graph (with its sizes and closures by increment, and true places by node id) the tuples that incremental.run gives."""
    try:
        batch = Batch([g for g, _, _, _ in graphs])
    except TooLarge:
        half = len(graphs) // 2
        return run(graphs[:half], config) + run(graphs[half:], config)
    size, n = batch.size, batch.n
    out: list[list[tuple]] = [[] for _ in graphs]
    when = defaultdict(list)
    for i, (g, sizes, _, _) in enumerate(graphs):
        for it, place in enumerate(_places(g, sizes)):
            when[place].append((i, it))
    fills = [Filling(g) for g, _, _, _ in graphs]
    target, known = np.zeros((n, 2, size)), np.zeros((n, size), dtype=bool)
    for i, (g, _, _, real) in enumerate(graphs):
        for row, node, dim in zip(batch.rows[i].tolist(), g.ids.tolist(), g.dims.tolist(), strict=True):
            if dim == 3 and node in real:
                target[row, :, i], known[row, i] = real[node], True
    squares, present = np.zeros((n, 3, size)), np.zeros((n, 3, size), dtype=bool)
    before, variables = np.full(size, np.nan), np.zeros(size)
    edges_in, nodes_in = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
    with np.errstate(all="ignore"):
        for place in sorted(when):
            who = np.array([i for i, _ in when[place]])
            its = [it for _, it in when[place]]
            ends = np.array([graphs[i][1][it] for i, it in when[place]])
            closure = np.array([graphs[i][2][it] for i, it in when[place]])
            new = np.zeros((n, 3, size), dtype=bool)
            for i, (m, nodes) in zip(who.tolist(), ends.tolist(), strict=True):
                g, fill = graphs[i][0], fills[i]
                for a, b in zip(g.a[edges_in[i] : m].tolist(), g.b[edges_in[i] : m].tolist(), strict=True):
                    fill.near_by(a, b)
                rows = batch.rows[i][nodes_in[i] : nodes]
                new[rows, :, i] = batch.has[rows, :, i]
                if fill.changed < nodes:
                    node, component = g.layout(nodes)
                    squares[batch.rows[i][node], component, i] = fill.columns_of(nodes).astype(float) ** 2
            new = new[:, :, who]
            present[:, :, who] |= new
            batch.grow(who, ends[:, 0])
            here = present[:, :, who]
            n_vars = here.sum(axis=(0, 1))
            top = int(np.flatnonzero(here.any(axis=(1, 2))).max()) + 1
            logdet = batch.half_logdet(who, top)
            failed = np.isnan(logdet)
            gain = np.where(np.isnan(before[who]), 0.0, logdet - before[who] * n_vars / variables[who])
            gain[failed] = np.nan
            before[who], variables[who] = np.where(failed, before[who], logdet), np.where(failed, variables[who], n_vars)
            fire = {"none": np.ones(len(who), dtype=bool), "IGG": gain > config.entropy_threshold, "LCG": closure}[config.gating]
            sq = squares[:, :, who]
            work, whole = (sq * new).sum(axis=(0, 1)), sq.sum(axis=(0, 1))
            active = np.where(fire, here, new if config.selective else False)
            any_active = active.any(axis=(0, 1))
            skipped = config.selective & ~any_active
            steps = np.zeros(len(who), dtype=np.int64)
            for some in (fire, ~fire):
                some = np.flatnonzero(some & any_active & ~failed)
                if len(some) and config.most_iterations > 0:
                    _iterate(batch, who, some, top, active, here, sq, whole, work, steps, failed, config)
            edges_in[who], nodes_in[who] = ends[:, 0], ends[:, 1]
            err, ate = np.full(len(who), np.nan), np.full(len(who), np.nan)
            done = np.flatnonzero(~skipped)
            if len(done):
                total, measured = batch.chi2(who[done])
                err[done] = total / np.maximum(1, measured)
                inside = known[:, who[done]] & here[:, 0, done]
                enough = inside.sum(axis=0) >= 2
                if enough.any():
                    ate[done[enough]] = _rmse(batch.x[:, :2][:, :, who[done[enough]]], target[:, :, who[done[enough]]], inside[:, enough])
            for q, i in enumerate(who.tolist()):
                value = lambda v, q=q: None if np.isnan(v[q]) else float(v[q])
                error = None if skipped[q] else float(err[q])
                out[i].append((its[q] + 1, bool(closure[q]), value(logdet), int(n_vars[q]), value(gain), bool(fire[q]), bool(skipped[q]), int(steps[q]), error, value(ate), float(work[q]), bool(failed[q])))
    for i, (g, _, _, _) in enumerate(graphs):
        g.x[:] = batch.x[batch.rows[i], :, i]
    return out


def _iterate(batch, who, some, top, active, here, sq, whole, work, steps, failed, config) -> None:
    """Steps of the graphs who[some] until none of their active variables moves far, or one has no factor."""
    moved, old = np.zeros((batch.n, len(who)), dtype=bool), np.zeros((batch.n, 3, len(who)))

    def back(which):
        """Takes the last step of these back, where there was one."""
        failed[which] = True
        which = which[moved[:, which].any(axis=0)]
        if len(which):
            at = np.where(moved[:, None, which], old[:, :, which], batch.x[:, :, who[which]])
            batch.x[:, :, who[which]] = at
            batch.anew(who[which])
            steps[which] -= 1

    for k in range(1, config.most_iterations + 1):
        since = int(np.flatnonzero(active[:, :, some].any(axis=(1, 2))).min())
        dx, bad = batch.solve(who[some], top, since)
        if bad.any():
            back(some[bad])
            some, dx = some[~bad], dx[:, :, ~bad]
        far = active[:top][:, :, some] & (np.abs(dx) > config.dx_threshold)
        going = far.any(axis=(0, 1))
        some, dx, far = some[going], dx[:, :, going], far[:, :, going]
        if not len(some):
            return
        if config.selective:
            active[:, :, some] = False
            active[:top, :, some] = far.any(axis=1)[:, None] & here[:top][:, :, some]
        now = active[:, :, some]
        moved[:, some], old[:, :, some] = now.any(axis=1), batch.x[:, :, who[some]]
        batch.x[:top, :, who[some]] -= np.where(now[:top], dx, 0)
        batch.moved(who[some], moved[:, some])
        work[some] += np.minimum(2 * (sq[:, :, some] * now).sum(axis=(0, 1)), whole[some]) if config.selective else whole[some]
        steps[some] = k
    # The last step's matrix isn't looked at before the next increment; it is taken back here.
    bad = np.isnan(batch.half_logdet(who[some], top))
    if bad.any():
        back(some[bad])
