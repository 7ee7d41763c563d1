"""Hierarchical navigable small-world graphs in numpy: whole blocks of vectors are searched and inserted in step.

Vectors are unit float32 rows; nearness is their inner product. Level 0 holds all nodes, each higher level about
1 / ``links`` of the one below. A block of new nodes is searched in the graph so far; what is found, and the nearest of the
block itself, are the candidates of each new node, of which a diverse few become neighbours: a candidate is passed over if it is nearer to
one already taken than to the node. Neighbours link back, and lists that are too long are thinned the same way.
"""

from __future__ import annotations

import numpy as np


class Graph:
    def __init__(self, vectors: np.ndarray, links: int = 16, beam: int = 64, seed: int = 3, block: int = 1024):
        self.x = np.ascontiguousarray(vectors, np.float32)
        n = len(self.x)
        self.links = links
        rng = np.random.default_rng(seed)
        level = np.minimum((-np.log(1 - rng.random(n)) / np.log(links)).astype(np.int64), 4) if n else np.zeros(0, np.int64)
        self.nodes = [np.flatnonzero(level >= k) for k in range(int(level.max(initial=0)) + 1)]
        self.edges = [np.full((len(own), links * (2 if k == 0 else 1)), -1, np.int32) for k, own in enumerate(self.nodes)]
        self.filled = [0] * len(self.nodes)
        for k in reversed(range(len(self.nodes))):
            self._build(k, beam if k == 0 else max(16, beam // 2), block)

    def _build(self, k: int, beam: int, block: int) -> None:
        """Insert the level's nodes, in places 0 .. m - 1 of its own numbering, in blocks no larger than what is there."""
        x, edges = self.x[self.nodes[k]], self.edges[k]
        m, width = len(x), edges.shape[1]
        at = 0
        while at < m:
            step = min(m - at, block, max(64, at))
            new = np.arange(at, at + step)
            near = x[new] @ x[new].T
            np.fill_diagonal(near, -2)
            take = min(step - 1, beam // 2)
            ids = [new[np.argpartition(near, step - take, axis=1)[:, step - take :]] if take > 0 else np.zeros((step, 0), np.int64)]
            if at:
                found, _ = search(x, edges, x[new], self._entries(k, x[new], at), beam, at)
                ids.append(found)
            candidates = np.concatenate(ids, axis=1)
            edges[new] = self._diverse(x, x[new], candidates, width)
            self._link_back(x, edges, new)
            at += step
            self.filled[k] = at

    def _entries(self, k: int, queries: np.ndarray, limit: int) -> np.ndarray:
        """Places of level k to start from: what the levels above lead to, or the first few."""
        entry = None
        for level in range(len(self.nodes) - 1, k, -1):
            start = entry if entry is not None else np.tile(np.arange(min(4, len(self.nodes[level]))), (len(queries), 1))
            found, _ = search(self.x[self.nodes[level]], self.edges[level], queries, start, 8, len(self.nodes[level]))
            at = np.searchsorted(self.nodes[level - 1], self.nodes[level][np.maximum(found, 0)])
            entry = np.where(found >= 0, at, -1)[:, :4]
        first = np.tile(np.arange(min(4, limit)), (len(queries), 1))
        if entry is None:
            return first
        entry = np.where(entry < limit, entry, -1)
        return np.concatenate([entry, first], axis=1)

    def _diverse(self, x: np.ndarray, own: np.ndarray, candidates: np.ndarray, width: int) -> np.ndarray:
        """Of each row's candidates (-1: none) up to ``width``, nearest first, none nearer to one taken than to the node; then the nearest of the rest."""
        n, c = candidates.shape
        out = np.full((n, width), -1, np.int32)
        if c == 0:
            return out
        for a in range(0, n, 256):
            ids = candidates[a : a + 256]
            v = x[np.maximum(ids, 0)]
            near = np.where(ids >= 0, np.einsum("ncd,nd->nc", v, own[a : a + 256]), -3)
            order = np.argsort(-near, axis=1, kind="stable")
            ids, near = np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1)
            v = np.take_along_axis(v, order[:, :, None], 1)
            twice = np.zeros(ids.shape, bool)
            by_id = np.argsort(ids, axis=1, kind="stable")
            sorted_ids = np.take_along_axis(ids, by_id, 1)
            same = np.concatenate([np.zeros((len(ids), 1), bool), sorted_ids[:, 1:] == sorted_ids[:, :-1]], axis=1)
            np.put_along_axis(twice, by_id, same, 1)
            open_ = (near > -2.5) & ~twice
            between = np.matmul(v, v.transpose(0, 2, 1))
            closest = np.full(ids.shape, -2, np.float32)
            taken = np.zeros(ids.shape, bool)
            count = np.zeros(len(ids), np.int64)
            for j in range(c):
                yes = open_[:, j] & (closest[:, j] < near[:, j]) & (count < width)
                taken[:, j] = yes
                count += yes
                closest[yes] = np.maximum(closest[yes], between[yes, j])
            rank = np.where(taken, 0, np.where(open_, 1, 2))
            keep = np.argsort(rank, axis=1, kind="stable")[:, :width]
            good = np.take_along_axis(rank, keep, 1) < 2
            out[a : a + 256, : keep.shape[1]] = np.where(good, np.take_along_axis(ids, keep, 1), -1)
        return out

    def _link_back(self, x: np.ndarray, edges: np.ndarray, new: np.ndarray) -> None:
        width = edges.shape[1]
        src = np.repeat(new, width)
        dst = edges[new].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        order = np.lexsort((-np.einsum("nd,nd->n", x[src], x[dst]), dst))
        src, dst = src[order], dst[order]
        first = np.concatenate([[True], dst[1:] != dst[:-1]])
        nth = np.arange(len(dst)) - np.maximum.accumulate(np.where(first, np.arange(len(dst)), 0))
        src, dst, nth = src[nth < width], dst[nth < width], nth[nth < width]
        nodes, row = np.unique(dst, return_inverse=True)
        more = np.full((len(nodes), width), -1, np.int64)
        more[row, nth] = src
        edges[nodes] = self._diverse(x, x[nodes], np.concatenate([edges[nodes], more], axis=1), width)

    def search(self, queries: np.ndarray, beam: int, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` nearest nodes that are found for each query (-1: none), nearest first, and their nearness."""
        ids, near = np.full((len(queries), beam), -1, np.int64), np.full((len(queries), beam), -2, np.float32)
        for a in range(0, len(queries), block):
            q = queries[a : a + block]
            found, value = search(self.x, self.edges[0], q, self._entries(0, q, len(self.x)), beam, len(self.x))
            ids[a : a + block, : found.shape[1]], near[a : a + block, : found.shape[1]] = found, value
        return ids, near


def search(x: np.ndarray, edges: np.ndarray, queries: np.ndarray, entries: np.ndarray, beam: int, limit: int, at_once: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Beam search of all queries in step: each step opens the ``at_once`` nearest unopened nodes of each beam."""
    n = len(queries)
    rows = np.arange(n)[:, None]
    seen = np.zeros((n, limit + 1), bool)  # the last column stands for no node
    ids = np.where((entries >= 0) & (entries < limit), entries, limit)
    ids = np.sort(ids, axis=1)
    ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = limit
    seen[rows, ids] = True
    near = np.where(ids < limit, np.einsum("ncd,nd->nc", x[np.minimum(ids, limit - 1)], queries), -2).astype(np.float32)
    opened = ids >= limit
    live = np.arange(n)
    out_ids, out_near = np.full((n, beam), -1, np.int64), np.full((n, beam), -2, np.float32)
    while len(live):
        waiting = np.where(opened, -2, near)
        k = min(at_once, waiting.shape[1])
        pick = np.argpartition(-waiting, k - 1, axis=1)[:, :k]
        good = np.take_along_axis(waiting, pick, 1) > -1.5
        np.put_along_axis(opened, pick, True, 1)
        nodes = np.where(good, np.take_along_axis(ids, pick, 1), 0)
        next_ = np.where(good[:, :, None], edges[np.minimum(nodes, limit - 1)], -1).reshape(len(live), -1).astype(np.int64)
        next_ = np.where((next_ >= 0) & (next_ < limit), next_, limit)
        next_.sort(axis=1)
        next_[:, 1:][next_[:, 1:] == next_[:, :-1]] = limit
        fresh = ~seen[live[:, None], next_] & (next_ < limit)
        seen[live[:, None], next_] = True
        r, c = np.nonzero(fresh)
        value = np.full(next_.shape, -2, np.float32)
        value[r, c] = np.einsum("nd,nd->n", x[next_[r, c]], queries[live[r]])
        ids, near = np.concatenate([ids, next_], axis=1), np.concatenate([near, value], axis=1)
        opened = np.concatenate([opened, ~fresh], axis=1)
        if ids.shape[1] > beam:
            keep = np.argpartition(-near, beam - 1, axis=1)[:, :beam]
            ids, near, opened = (np.take_along_axis(v, keep, 1) for v in (ids, near, opened))
        done = opened.all(axis=1)
        if done.any():
            w = ids.shape[1]
            out_ids[live[done], :w], out_near[live[done], :w] = np.where(near[done] > -1.5, ids[done], -1), near[done]
            live, ids, near, opened = live[~done], ids[~done], near[~done], opened[~done]
    order = np.argsort(-out_near, axis=1, kind="stable")
    return np.take_along_axis(out_ids, order, 1), np.take_along_axis(out_near, order, 1)
