"""A robust-pruned directed graph over one block of vectors, in numpy.

Points are inserted in batches: a greedy beam search from the medoid proposes neighbours (everything
it reached), relaxed-distance pruning keeps those that no kept neighbour is ``alpha`` times closer to,
and reverse edges are added and pruned alike. All searches and prunings of a batch run side by side.
"""

from __future__ import annotations

import numpy as np


def _distances(vectors: np.ndarray, norms: np.ndarray, ids: np.ndarray, to: np.ndarray, to_norm: np.ndarray) -> np.ndarray:
    """Squared distances from row i of ``to`` to ``vectors[ids[i]]``; infinite where an id is -1."""
    dots = np.matmul(vectors[ids], to[:, :, None])[:, :, 0]
    d = norms[ids] + to_norm[:, None] - 2 * dots
    d[ids < 0] = np.inf
    return np.maximum(d, 0, out=d)


#: Edges per point kept free for reconnecting points that pruning has cut off.
SPARE = 4


class Graph:
    def __init__(self, vectors: np.ndarray, degree: int = 32, edges: np.ndarray | None = None, start: int | None = None):
        self.x = np.ascontiguousarray(vectors, dtype=np.float32)
        self.norms = np.einsum("ij,ij->i", self.x, self.x)
        self.degree = degree
        n = len(self.x)
        self.edges = np.full((n, degree + SPARE), -1, dtype=np.int32) if edges is None else edges
        if start is None:
            start = int(np.argmin(((self.x - self.x.mean(axis=0)) ** 2).sum(axis=1)))
        self.start = start

    def search(self, queries: np.ndarray, beam: int, width: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, squared distances) of the nearest ``beam`` points reached, ascending, and all expanded ids."""
        q = np.ascontiguousarray(queries, dtype=np.float32)
        n, m = len(q), len(self.x)
        q_norm = np.einsum("ij,ij->i", q, q)
        rows = np.arange(n)
        seen = np.zeros((n, m), dtype=bool)
        ids = np.full((n, beam), -1, dtype=np.int32)
        ids[:, 0] = self.start
        dist = np.full((n, beam), np.inf, dtype=np.float32)
        dist[:, :1] = _distances(self.x, self.norms, ids[:, :1], q, q_norm)
        seen[:, self.start] = True
        done = np.zeros((n, beam), dtype=bool)
        paths = []
        while True:
            open_at = np.where(done | (ids < 0), np.inf, dist)
            pick = np.argpartition(open_at, min(width, beam) - 1, axis=1)[:, :width] if beam > width else np.tile(np.arange(beam), (n, 1))
            usable = np.isfinite(np.take_along_axis(open_at, pick, 1))
            live = usable.any(axis=1)
            if not live.any():
                break
            np.put_along_axis(done, pick, np.take_along_axis(done, pick, 1) | usable, 1)
            chosen = np.where(usable, np.take_along_axis(ids, pick, 1), -1)
            paths.append(chosen)
            act = rows[live]
            near = self.edges[chosen[act]]
            near[chosen[act] < 0] = -1
            near = near.reshape(len(act), -1)
            fresh = (near >= 0) & ~seen[act[:, None], near]
            # the same neighbour may come from two expanded nodes: keep its first place
            order = np.argsort(near, axis=1, kind="stable")
            sorted_ids = np.take_along_axis(near, order, 1)
            again = np.zeros_like(fresh)
            again[:, 1:] = sorted_ids[:, 1:] == sorted_ids[:, :-1]
            repeat = np.zeros_like(fresh)
            np.put_along_axis(repeat, order, again, 1)
            fresh &= ~repeat
            near = np.where(fresh, near, -1)
            seen[np.repeat(act, fresh.sum(axis=1)), near[fresh]] = True
            d = _distances(self.x, self.norms, near, q[act], q_norm[act])
            all_ids = np.concatenate([ids[act], near], axis=1)
            all_d = np.concatenate([dist[act], d], axis=1)
            all_done = np.concatenate([done[act], np.zeros(near.shape, dtype=bool)], axis=1)
            best = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
            ids[act] = np.take_along_axis(all_ids, best, 1)
            dist[act] = np.take_along_axis(all_d, best, 1)
            done[act] = np.take_along_axis(all_done, best, 1)
        order = np.argsort(dist, axis=1, kind="stable")
        reached = np.concatenate(paths, axis=1) if paths else np.full((n, 1), -1, np.int32)
        return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1), reached

    def prune(self, points: np.ndarray, candidates: np.ndarray, alpha: float) -> np.ndarray:
        """Robust pruning: up to ``degree`` diverse neighbours for each of ``points``; -1 fills candidates and result."""
        c = np.where(candidates == points[:, None], -1, candidates)
        order = np.sort(c, axis=1)
        order[:, 1:][order[:, 1:] == order[:, :-1]] = -1
        d = _distances(self.x, self.norms, order, self.x[points], self.norms[points])
        by = np.argsort(d, axis=1, kind="stable")
        c, d = np.take_along_axis(order, by, 1), np.take_along_axis(d, by, 1)
        vectors = self.x[c]
        norms = self.norms[c]
        alive = c >= 0
        out = np.full((len(points), self.degree), -1, dtype=np.int32)
        rows = np.arange(len(points))
        for k in range(self.degree):
            first = alive.argmax(axis=1)
            has = alive[rows, first]
            if not has.any():
                break
            out[has, k] = c[rows[has], first[has]]
            p = vectors[rows, first]
            between = np.maximum(norms + norms[rows, first][:, None] - 2 * np.matmul(vectors, p[:, :, None])[:, :, 0], 0)
            alive &= ~((alpha * alpha * between <= d) & has[:, None])
            alive[rows, first] = False
        return out

    def build(self, beam: int = 64, alpha: float = 1.2, batch: int = 512, seed: int = 1) -> "Graph":
        order = np.random.default_rng(seed).permutation(len(self.x))
        order = order[order != self.start]
        at, size = 0, 8
        while at < len(order):
            points = order[at : at + min(size, batch)]
            at += len(points)
            size *= 2
            near, _, reached = self.search(self.x[points], beam)
            self.edges[points, : self.degree] = self.prune(points, np.concatenate([near, reached], axis=1), alpha)
            self._reverse(points, alpha)
        self._reconnect(beam)
        return self

    def _reverse(self, points: np.ndarray, alpha: float) -> None:
        """Edges back to ``points`` from the neighbours they chose."""
        new = self.edges[points, : self.degree]
        source = np.repeat(points, self.degree)[(new >= 0).ravel()]
        target = new[new >= 0]
        order = np.argsort(target, kind="stable")
        target, source = target[order], source[order]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        for lo in range(0, len(nodes), 512):
            part = slice(lo, lo + 512)
            widest = int(count[part].max())
            add = np.full((len(nodes[part]), widest), -1, dtype=np.int32)
            place = np.arange(len(target))[first[part][0] : first[part][-1] + count[part][-1]]
            row = np.repeat(np.arange(len(nodes[part])), count[part])
            add[row, place - np.repeat(first[part], count[part])] = source[place]
            both = np.concatenate([self.edges[nodes[part], : self.degree], add], axis=1)
            both = -np.sort(-both, axis=1)
            fits = (both >= 0).sum(axis=1) <= self.degree
            self.edges[nodes[part][fits], : self.degree] = both[fits][:, : self.degree]
            if (~fits).any():
                self.edges[nodes[part][~fits], : self.degree] = self.prune(nodes[part][~fits], both[~fits], alpha)

    def _reached(self) -> np.ndarray:
        seen = np.zeros(len(self.x), dtype=bool)
        seen[self.start] = True
        front = np.array([self.start])
        while len(front):
            near = np.unique(self.edges[front])
            front = near[near >= 0]
            front = front[~seen[front]]
            seen[front] = True
        return seen

    def _reconnect(self, beam: int) -> None:
        """Give every point that cannot be reached an edge from a near one that can."""
        while len(lost := np.flatnonzero(~self._reached())):
            near, _, _ = self.search(self.x[lost[:512]], beam)
            linked = 0
            for point, found in zip(lost[:512].tolist(), near.tolist()):
                for host in found:
                    free = np.flatnonzero(self.edges[host, self.degree :] < 0) if host >= 0 else []
                    if len(free):
                        self.edges[host, self.degree + free[0]] = point
                        linked += 1
                        break
            if not linked:
                return
