"""Hierarchical navigable small-world graphs over unit vectors, searched in lock step.

Nodes come in a random order, so a prefix of them is a random sample: layer k has the
first 1/M^k of the nodes. Many queries walk a layer together, each with a beam of its
own, so that a step is a few array operations for all of them.
"""

from __future__ import annotations

import numpy as np

#: Links of a node in the upper layers (twice as many in the lowest), beam while building.
M, BUILD_BEAM = 8, 48
#: Bytes of the notes which query has seen which node; small, so that they stay in a core's cache.
BLOCK = 1 << 20
_LEAST = np.float32(-2)


def layer_sizes(n: int) -> list[int]:
    sizes = [n]
    while sizes[-1] > 8 * M:
        sizes.append(-(-sizes[-1] // M))
    return sizes


class Graph:
    def __init__(self, unit: np.ndarray, links: list[np.ndarray]) -> None:
        self.unit, self.links = unit, links

    @classmethod
    def build(cls, unit: np.ndarray) -> Graph:
        sizes = layer_sizes(len(unit))
        g = cls(unit, [np.full((n, 2 * M if k == 0 else M), -1, np.int32) for k, n in enumerate(sizes)])
        for k in range(len(sizes) - 1, -1, -1):
            done = min(sizes[k + 1] if k + 1 < len(sizes) else 8 * M, sizes[k])
            g._join(k, 0, done)
            while done < sizes[k]:
                upto = min(sizes[k], done + min(done, 1024))
                g._join(k, done, upto)
                done = upto
        return g

    def _join(self, k: int, start: int, end: int) -> None:
        """Nodes start to end get links in layer k to what is there and to each other."""
        width = self.links[k].shape[1]
        for at in range(start, end, 512):
            new = np.arange(at, min(end, at + 512))
            sims = self.unit[new] @ self.unit[start:end].T
            sims[np.arange(len(new)), new - start] = _LEAST
            ids, near = _best(np.broadcast_to(np.arange(start, end, dtype=np.int32), sims.shape), sims, BUILD_BEAM)
            if start:
                old, olds = self._descend(self.unit[new], k, BUILD_BEAM, start)
                ids, near = _best(np.concatenate([ids, old], 1), np.concatenate([near, olds], 1), BUILD_BEAM)
            self.links[k][new] = self._chosen(ids, near, width)
        src = np.repeat(np.arange(start, end, dtype=np.int32), width)
        dst = self.links[k][start:end].ravel()
        self._link_back(k, dst[dst >= 0], src[dst >= 0])

    def _chosen(self, ids: np.ndarray, sims: np.ndarray, width: int) -> np.ndarray:
        """Of candidates in falling order: first those nearer to the node than to any chosen before, so
        that links lead in all directions; then the nearest of the rest."""
        out = np.full((len(ids), width), -1, np.int32)
        for at in range(0, len(ids), 256):
            i, s = ids[at : at + 256], sims[at : at + 256]
            v = self.unit[np.maximum(i, 0)]
            between = v @ v.transpose(0, 2, 1)
            worst = np.full(s.shape, _LEAST, np.float32)
            picked = np.zeros(s.shape, bool)
            count = np.zeros(len(i), np.int64)
            for c in range(i.shape[1]):
                ok = (i[:, c] >= 0) & (count < width) & (worst[:, c] < s[:, c])
                picked[:, c] = ok
                count += ok
                worst = np.where(ok[:, None], np.maximum(worst, between[:, c]), worst)
            rank = np.where(i < 0, 2, np.where(picked, 0, 1)) * i.shape[1] + np.arange(i.shape[1])
            first = np.argsort(rank, axis=1)[:, :width]
            out[at : at + 256, : first.shape[1]] = np.take_along_axis(i, first, 1)
        return out

    def _link_back(self, k: int, dst: np.ndarray, src: np.ndarray) -> None:
        links, width = self.links[k], self.links[k].shape[1]
        order = np.argsort(dst, kind="stable")
        dst, src = dst[order], src[order]
        nodes, first, counts = np.unique(dst, return_index=True, return_counts=True)
        for at in range(0, len(nodes), 1024):
            own, f, c = nodes[at : at + 1024], first[at : at + 1024], counts[at : at + 1024]
            more = np.full((len(own), int(c.max())), -1, np.int32)
            row = np.repeat(np.arange(len(own)), c)
            more[row, np.arange(len(row)) - np.repeat(np.cumsum(c) - c, c)] = src[f[0] : f[-1] + c[-1]]
            ids = np.sort(np.concatenate([links[own], more], 1), 1)
            ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
            full = (ids >= 0).sum(1) > width
            few = np.sort(ids[~full], 1)[:, ::-1][:, :width]
            links[own[~full], : few.shape[1]] = few
            for part in np.array_split(np.flatnonzero(full), max(1, full.sum() * ids.shape[1] // 32_768)):
                if len(part):
                    x = ids[part]
                    sims = np.where(x < 0, _LEAST, np.einsum("bd,bkd->bk", self.unit[own[part]], self.unit[np.maximum(x, 0)]))
                    links[own[part]] = self._chosen(*_best(x, sims, BUILD_BEAM + width), width)

    def _descend(self, q: np.ndarray, to: int, beam: int, visible: int) -> tuple[np.ndarray, np.ndarray]:
        """The beam of each query in layer `to`, whose first `visible` nodes are linked so far."""
        top = len(self.links) - 1
        if top == to:
            n = min(visible, len(self.links[top]))
            ids = np.broadcast_to(np.arange(n, dtype=np.int32), (len(q), n))
            return _best(ids, q @ self.unit[:n].T, beam)
        n = len(self.links[top])
        ids, sims = _best(np.broadcast_to(np.arange(n, dtype=np.int32), (len(q), n)), q @ self.unit[:n].T, 4)
        for k in range(top - 1, to, -1):
            ids, sims = self._walk(q, ids, sims, k, 8)
            ids, sims = ids[:, :4], sims[:, :4]
        return self._walk(q, ids, sims, to, beam)

    def _walk(self, q: np.ndarray, ids: np.ndarray, sims: np.ndarray, k: int, beam: int, fan: int = 4) -> tuple[np.ndarray, np.ndarray]:
        links, n = self.links[k], len(self.links[k])
        # Whether a query has seen a node, as one row after the other; the last place of a row takes what is no node.
        seen = np.zeros(len(q) * (n + 1), bool)
        base = np.arange(len(q), dtype=np.int64)[:, None] * (n + 1)
        seen[(base + np.where(ids < 0, n, ids)).ravel()] = True
        have = np.full((len(q), beam), -1, np.int32)
        near = np.full((len(q), beam), _LEAST, np.float32)
        have[:, : ids.shape[1]], near[:, : ids.shape[1]] = ids[:, :beam], sims[:, :beam]
        todo = have >= 0
        rows = np.flatnonzero(todo.any(1))
        while len(rows):
            open_ = todo.take(rows, 0)
            # Of each beam the nearest nodes that are not yet expanded.
            at = np.argsort(~open_, axis=1, kind="stable")[:, :fan]
            flat = rows[:, None] * beam + at
            live = todo.ravel().take(flat)
            todo.ravel()[flat] = False
            step = links.take(np.where(live, have.ravel().take(flat), 0), 0)
            step[~live] = n
            step[step < 0] = n
            step = np.sort(step.reshape(len(rows), -1), axis=1)
            spot = base.take(rows, 0) + step
            fresh = ~seen.take(spot)
            fresh[:, 1:] &= step[:, 1:] != step[:, :-1]
            fresh &= step < n
            seen[spot.ravel()] = True
            r, c = np.nonzero(fresh)
            s = np.einsum("nd,nd->n", q.take(rows.take(r), 0), self.unit.take(step[r, c], 0))
            better = s > near[:, -1].take(rows.take(r))
            r, s, node = r[better], s[better], step[r[better], c[better]]
            if len(r):
                # The better ones of a query stand side by side behind its beam.
                own, first, count = np.unique(r, return_index=True, return_counts=True)
                k_ = np.arange(len(r)) - np.repeat(first, count)
                line = np.repeat(np.arange(len(own)), count)
                more_s = np.full((len(own), int(count.max())), _LEAST, np.float32)
                more_i = np.full(more_s.shape, -1, np.int32)
                more_s[line, k_], more_i[line, k_] = s, node
                g = rows[own]
                all_s = np.concatenate([near.take(g, 0), more_s], 1)
                all_i = np.concatenate([have.take(g, 0), more_i], 1)
                all_t = np.concatenate([todo.take(g, 0), more_i >= 0], 1)
                best = np.argsort(-all_s, axis=1, kind="stable")[:, :beam]
                best += np.arange(len(g))[:, None] * all_s.shape[1]
                near[g], have[g], todo[g] = all_s.ravel().take(best), all_i.ravel().take(best), all_t.ravel().take(best)
            rows = rows[todo.take(rows, 0).any(1)]
        return have, near

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """ids and cosines of up to `beam` near nodes for each query, nearest first; -1 where there is none."""
        ids, sims = [], []
        size = max(8, min(512, BLOCK // max(1, len(self.unit)), (2 << 20) // beam))
        for at in range(0, len(q), size):
            i, s = self._descend(q[at : at + size], 0, beam, len(self.unit))
            pad = ((0, 0), (0, beam - i.shape[1]))
            ids.append(np.pad(i, pad, constant_values=-1))
            sims.append(np.pad(s, pad, constant_values=_LEAST))
        if not ids:
            return np.zeros((0, beam), np.int32), np.zeros((0, beam), np.float32)
        return np.concatenate(ids), np.concatenate(sims)


def _best(ids: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest of each row, in falling order."""
    if sims.shape[1] > k:
        at = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        ids, sims = np.take_along_axis(ids, at, 1), np.take_along_axis(sims, at, 1)
    at = np.argsort(-sims, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, at, 1), np.take_along_axis(sims, at, 1)
    return np.where(sims > _LEAST, ids, -1).astype(np.int32), sims
