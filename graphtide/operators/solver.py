"""Dense kernels for one trajectory's graph, run inside tasks. Graphs are independent, so the cluster solves many at once."""

from __future__ import annotations

import numpy as np

CODES = {"P": 0, "L": 1, "G": 2}


class Graph:
    """Edges and states as arrays. States have three numbers a node; a landmark's third is unused and has no variable."""

    def __init__(self, node_ids, dims, x, edges) -> None:
        """edges: arrays by name (type codes, from, to (-1: none), z (n, 3), w (n, 3, 3)) in insertion order; nodes in insertion order."""
        self.ids = np.asarray(node_ids, dtype=np.int64)
        self.dims = np.asarray(dims, dtype=np.int64)
        self.x = np.array(x, dtype=float)
        self.kind, self.a, self.b, self.z, self.w = edges
        self.offset = np.concatenate([[0], np.cumsum(self.dims)])
        # Where each edge's entries go, in terms of variables; unused ones point at a place behind the last variable.
        node, component = self.layout(len(self.dims))
        self.variable = np.full((len(self.dims), 3), len(node))
        self.variable[node, component] = np.arange(len(node))
        ra, rb = self.variable[self.a], np.where(self.b[:, None] >= 0, self.variable[np.maximum(self.b, 0)], len(node))
        self.ends = np.concatenate([ra, rb], axis=1)

    def residuals(self, e: slice | np.ndarray, upper: bool = False):
        """(residual (n, 3), A, B (n, 3, 3)) of some edges at the current state. `upper`: angles in (-pi, pi]."""
        kind, f, z = self.kind[e], self.x[self.a[e]], self.z[e]
        t = self.x[np.maximum(self.b[e], 0)]
        n = len(kind)
        c, s = np.cos(f[:, 2]), np.sin(f[:, 2])
        dx, dy = t[:, 0] - f[:, 0], t[:, 1] - f[:, 1]
        u, v = c * dx + s * dy, c * dy - s * dx
        r, ja, jb = np.zeros((n, 3)), np.zeros((n, 3, 3)), np.zeros((n, 3, 3))
        local = np.zeros((n, 2, 3))
        local[:, 0], local[:, 1] = np.stack([-c, -s, v], 1), np.stack([s, -c, -u], 1)
        rot = np.stack([np.stack([c, s], 1), np.stack([-s, c], 1)], 1)
        p, mark, fix = kind == 0, kind == 1, kind == 2
        if p.any():
            cz, sz = np.cos(z[p, 2]), np.sin(z[p, 2])
            back = np.stack([np.stack([cz, sz], 1), np.stack([-sz, cz], 1)], 1)
            r[p, :2] = np.einsum("nij,nj->ni", back, np.stack([u[p] - z[p, 0], v[p] - z[p, 1]], 1))
            angle = t[p, 2] - f[p, 2] - z[p, 2]
            r[p, 2] = np.arctan2(np.sin(angle), np.cos(angle)) if upper else np.mod(angle + np.pi, 2 * np.pi) - np.pi
            ja[p, :2] = back @ local[p]
            jb[p, :2, :2] = back @ rot[p]
            ja[p, 2, 2], jb[p, 2, 2] = -1, 1
        if mark.any():
            r[mark, 0], r[mark, 1] = u[mark] - z[mark, 0], v[mark] - z[mark, 1]
            ja[mark, :2] = local[mark]
            jb[mark, :2, :2] = rot[mark]
        if fix.any():
            r[fix, :2] = f[fix, :2] - z[fix, :2]
            ja[fix, 0, 0] = ja[fix, 1, 1] = 1
        return r, ja, jb

    def products(self, e: slice | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """J'WJ (n, 6, 6) and J'We (n, 6) of some edges at the current state."""
        r, ja, jb = self.residuals(e)
        j = np.concatenate([ja, jb], axis=2)
        wj = self.w[e] @ j
        return j.transpose(0, 2, 1) @ wj, np.einsum("nij,ni->nj", wj, r)

    def system(self, n_nodes: int, n_edges: int):
        """H and g over the first nodes and edges, the anchor on the first node included."""
        e, n = slice(0, n_edges), int(self.offset[n_nodes])
        blocks, sides = self.products(e)
        at = np.minimum(self.ends[e], n)
        flat = (at[:, :, None] * (n + 1) + at[:, None, :]).ravel()
        h = np.bincount(flat, blocks.ravel(), (n + 1) ** 2).reshape(n + 1, n + 1)[:n, :n]
        g = np.bincount(at.ravel(), sides.ravel(), n + 1)[:n]
        first = np.arange(self.dims[0])
        h[first, first] += 1
        return h, g

    def chi2(self, n_edges: int) -> float:
        r, _, _ = self.residuals(slice(0, n_edges), upper=True)
        return float(np.einsum("ni,nij,nj->", r, self.w[:n_edges], r))

    def measurements(self, n_edges: int) -> int:
        return int(np.where(self.kind[:n_edges] == 0, 3, 2).sum())

    def step(self, node: np.ndarray, component: np.ndarray, dx: np.ndarray) -> None:
        self.x[node, component] -= dx

    def layout(self, n_nodes: int):
        """(node, component) of each variable."""
        node = np.repeat(np.arange(n_nodes), self.dims[:n_nodes])
        return node, np.arange(len(node)) - self.offset[node]


class Factor:
    """H = LL' and L^-1 g of a growing graph, kept between steps.

    Only edges whose states moved are linearised again. L is made in panels of rows: those above the first changed variable
    stay, and a panel begins at the first column that its edges reach. A solution is taken from the last variable back to
    the first one that is wanted, so a step of the newest nodes alone costs little.
    """

    PANEL = 48

    def __init__(self, graph: Graph) -> None:
        n = int(graph.offset[-1])
        self.graph, self.n_edges, self.good = graph, 0, 0
        # One row more, for what unused entries of an edge point at.
        self.h, self.g = np.zeros((n + 1, n + 1)), np.zeros(n + 1)
        self.lower, self.y, self.first = np.zeros((n, n)), np.zeros(n), np.arange(n + 1)
        self.inverse: list[np.ndarray] = [np.zeros((0, 0))] * -(-n // self.PANEL)
        self.begin = [0] * len(self.inverse)
        self.blocks, self.sides = np.zeros((len(graph.kind), 6, 6)), np.zeros((len(graph.kind), 6))
        self.fill = Filling(graph)

    def _anchor(self) -> None:
        first = np.arange(self.graph.dims[0])
        self.h[first, first] += 1

    def _add(self, e: np.ndarray, blocks: np.ndarray, sides: np.ndarray) -> None:
        at = self.graph.ends[e]
        np.add.at(self.h, (at[:, :, None], at[:, None, :]), blocks)
        np.add.at(self.g, at, sides)
        self.good = min(self.good, int(at.min()))

    def grow(self, n_edges: int) -> None:
        """Takes in the edges up to `n_edges`."""
        e = np.arange(self.n_edges, n_edges)
        if not len(e):
            return
        if not self.n_edges:
            self._anchor()
        at = self.graph.ends[e]
        np.minimum.at(self.first, at, at.min(axis=1)[:, None])
        for a, b in zip(self.graph.a[e].tolist(), self.graph.b[e].tolist(), strict=True):
            self.fill.near_by(a, b)
        self.n_edges = n_edges
        self.blocks[e], self.sides[e] = self.graph.products(e)
        self._add(e, self.blocks[e], self.sides[e])

    def moved(self, nodes: np.ndarray) -> None:
        """Linearises the edges of these nodes again."""
        graph, flag = self.graph, np.zeros(len(self.graph.dims) + 1, dtype=bool)
        flag[nodes] = True
        e = np.flatnonzero(flag[graph.a[: self.n_edges]] | flag[graph.b[: self.n_edges]])
        blocks, sides = graph.products(e)
        if 2 * len(e) > self.n_edges:
            # Anew, so that no rounding gathers.
            self.h[:], self.g[:] = 0, 0
            self._anchor()
            self.blocks[e], self.sides[e] = blocks, sides
            e = np.arange(self.n_edges)
            self._add(e, self.blocks[e], self.sides[e])
        else:
            self._add(e, blocks - self.blocks[e], sides - self.sides[e])
            self.blocks[e], self.sides[e] = blocks, sides

    def anew(self) -> None:
        """Linearises all edges again and sums up without what was summed before."""
        e = np.arange(self.n_edges)
        self.h[:], self.g[:], self.good = 0, 0, 0
        self._anchor()
        self.blocks[e], self.sides[e] = self.graph.products(e)
        self._add(e, self.blocks[e], self.sides[e])

    def update(self, n: int) -> None:
        """Brings the factor of the first n variables up to date."""
        p, lower, h = self.PANEL, self.lower, self.h
        for i in range(self.good // p * p, n, p):
            end = min(i + p, n)
            c = int(self.first[i:end].min()) // p * p
            part = h[i:end, c:end].copy()
            for j in range(c, i, p):
                since = max(c, self.begin[j // p])
                here = part[:, j - c : j - c + p]
                if j > since:
                    here -= part[:, since - c : j - c] @ lower[j : j + p, since:j].T
                part[:, j - c : j - c + p] = here @ self.inverse[j // p].T
            part[:, i - c :] = np.linalg.cholesky(part[:, i - c :] - part[:, : i - c] @ part[:, : i - c].T)
            lower[i:end, c:end] = part
            self.inverse[i // p], self.begin[i // p] = np.linalg.inv(part[:, i - c :]), c
            self.y[i:end] = self.inverse[i // p] @ (self.g[i:end] - part[:, : i - c] @ self.y[c:i])
        self.good = n

    def half_logdet(self, n: int) -> float:
        self.update(n)
        return float(np.log(np.diagonal(self.lower)[:n]).sum())

    def solve(self, n: int, since: int = 0) -> np.ndarray:
        """The solution of the first n variables from variable `since` on; 0 before its panel."""
        self.update(n)
        p, x, r = self.PANEL, np.zeros(n), self.y[:n].copy()
        stop = since // p * p
        for i in reversed(range(stop, n, p)):
            end, c = min(i + p, n), max(stop, self.begin[i // p])
            x[i:end] = self.inverse[i // p].T @ r[i:end]
            r[c:i] -= self.lower[i:end, c:i].T @ x[i:end]
        return x

    def filling(self, n_nodes: int) -> np.ndarray:
        """How many entries each variable's column of the factor has. It doesn't change with the states."""
        return self.fill.columns_of(n_nodes)


class Filling:
    """The factor's filling by nodes: earlier neighbours, the columns of each row, how many rows a column has."""

    def __init__(self, graph: Graph) -> None:
        nodes = len(graph.dims)
        self.graph = graph
        self.near: list[set[int]] = [set() for _ in range(nodes)]
        self.columns: list[list[int]] = []
        self.parent, self.rows, self.changed = np.full(nodes, -1), np.zeros(nodes, dtype=np.int64), 0

    def near_by(self, a: int, b: int) -> None:
        """Takes in an edge (b < 0: unary)."""
        if b >= 0 and a != b:
            self.near[max(a, b)].add(min(a, b))
            self.changed = min(self.changed, max(a, b))

    def columns_of(self, n_nodes: int) -> np.ndarray:
        """How many entries each variable's column of the factor has, by the elimination tree of the nodes."""
        dims = self.graph.dims
        for i in range(self.changed, len(self.columns)):
            self.rows[self.columns[i]] -= dims[i]
        del self.columns[self.changed :]
        self.parent[self.parent >= self.changed] = -1
        parent, met = self.parent, np.full(n_nodes, -1)
        for i in range(self.changed, n_nodes):
            found: list[int] = []
            for j in self.near[i]:
                while j != i and met[j] != i:
                    met[j] = i
                    found.append(j)
                    if parent[j] < 0:
                        parent[j] = i
                    j = int(parent[j])
            self.columns.append(found)
            self.rows[found] += dims[i]
        self.changed = n_nodes
        node, component = self.graph.layout(n_nodes)
        return self.rows[node] + dims[node] - component


def solve(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    return np.linalg.solve(h, g)


def half_logdet(lower: np.ndarray) -> float:
    return float(np.log(np.abs(np.diag(lower))).sum())


def elimination_parents(h: np.ndarray) -> list[int]:
    """The elimination tree's parents of a symmetric matrix (-1: a root)."""
    n = len(h)
    parent, ancestor = [-1] * n, [-1] * n
    for k in range(n):
        for i in np.flatnonzero(h[:k, k]):
            i = int(i)
            while i != -1 and i < k:
                above, ancestor[i] = ancestor[i], k
                if above == -1:
                    parent[i] = k
                i = above
    return parent


def reach(parent: list[int], start) -> set[int]:
    """All that the starts' paths to their roots meet."""
    out: set[int] = set()
    for i in start:
        while i != -1 and i not in out:
            out.add(int(i))
            i = parent[i]
    return out


def solve_partly(h: np.ndarray, lower: np.ndarray, g: np.ndarray, wanted: np.ndarray, share: float = 0.5) -> np.ndarray:
    """The wanted entries of the solution. Up to `share` of the variables: only the trailing part that their elimination paths reach is solved backward, which gives the same values as the whole solve."""
    n = len(g)
    if len(wanted) > share * n:
        return solve(h, g)[wanted]
    part = np.array(sorted(reach(elimination_parents(h), wanted)))
    y = np.linalg.solve(lower, g)
    # Reach is closed upward, so the wanted rows of the upper factor touch no other variable.
    upper = lower.T[np.ix_(part, part)]
    return np.linalg.solve(upper, y[part])[np.searchsorted(part, wanted)]


def align(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rotation and shift of the plane that bring the rows of p closest to those of q."""
    if p.shape != q.shape or p.ndim != 2 or p.shape[1] != 2 or len(p) < 2 or not (np.isfinite(p).all() and np.isfinite(q).all()):
        raise ValueError("two finite n x 2 arrays with n >= 2 are needed")
    mp, mq = p.mean(0), q.mean(0)
    a, b = p - mp, q - mq
    phi = np.arctan2((a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]).sum(), (a * b).sum())
    r = np.array([[np.cos(phi), -np.sin(phi)], [np.sin(phi), np.cos(phi)]])
    return r, mq - r @ mp


def trajectory_rmse(p: np.ndarray, q: np.ndarray) -> float:
    if len(p) < 2:
        return float("nan")
    r, t = align(p, q)
    return float(np.sqrt((((p @ r.T + t) - q) ** 2).sum(1).mean()))


def whitening(w: np.ndarray) -> np.ndarray:
    """The symmetric square root; negative directions count as 0."""
    values, vectors = np.linalg.eigh((w + w.T) / 2)
    return (vectors * np.sqrt(np.maximum(values, 0))) @ vectors.T
