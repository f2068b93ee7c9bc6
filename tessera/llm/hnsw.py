"""A hierarchical navigable small-world graph of one shard, with beams that run for many queries at once."""

from __future__ import annotations

import numpy as np

LINKS = 16
TOP = 256
BATCH = 512


class Graph:
    """Unit vectors of a shard; ``layers[0]`` holds all of them, each further layer about one in LINKS.

    Nodes come in batches of at most as many as there are already: a batch is searched for in the graph so far and
    compared within itself, its links are those neighbours that are nearer to the node than to a neighbour already
    linked (so that links also lead out of a crowd), and links back are chosen anew in the same way.
    """

    def __init__(self, vectors: np.ndarray, ef: int = 32, seed: int = 5):
        self.vectors = np.ascontiguousarray(vectors, np.float32)
        n, rng = len(vectors), np.random.default_rng(seed)
        self.order = rng.permutation(n)
        self.layers: list[tuple[np.ndarray, np.ndarray]] = []
        size = n
        sizes = [n]
        while size > TOP:
            size = max(TOP, size // LINKS)
            sizes.append(size)
        for size in reversed(sizes):  # from the top; a layer's nodes are the first ones of a random order
            nodes = self.order[:size]
            self.layers.insert(0, (nodes, np.full((size, 2 * LINKS), -1, np.int32)))
            if len(self.layers) > 1:
                self._build(ef)
        self.place = np.empty(n, np.int64)  # positions in the order, which all layers share
        self.place[self.order] = np.arange(n)
        self.sorted = self.vectors[self.order]

    def _build(self, ef: int) -> None:
        nodes, links = self.layers[0]
        x = self.vectors[nodes]
        above = len(self.layers[1][0])
        done = 0
        while done < len(nodes):
            to = min(len(nodes), done + min(BATCH, max(done, TOP)))
            q = x[done:to]
            near = q @ q.T
            np.fill_diagonal(near, -2)
            k = min(len(q) - 1, LINKS)
            inside = np.argpartition(-near, k - 1, axis=1)[:, :k] if k > 0 else np.empty((len(q), 0), int)
            ids, sims = inside + done, np.take_along_axis(near, inside, 1)
            if done:
                start = self._enter(q) if done >= above else nearest(q, x[:done])
                found, s = beam(x[:done], links[:done], q, start, ef)
                ids, sims = np.concatenate([ids, found], 1), np.concatenate([sims, s], 1)
            links[done:to, :LINKS] = diverse(x, q, ids, sims, LINKS)
            self._back(x, links, np.arange(done, to))
            done = to

    def _back(self, x: np.ndarray, links: np.ndarray, new: np.ndarray) -> None:
        """Links from the neighbours of ``new`` back to them."""
        target = links[new, :LINKS].ravel()
        source = np.repeat(new, LINKS)[target >= 0]
        target = target[target >= 0]
        by = np.argsort(target, kind="stable")
        target, source = target[by], source[by]
        owners, first, counts = np.unique(target, return_index=True, return_counts=True)
        rank = np.arange(len(target)) - np.repeat(first, counts)
        width = min(int(counts.max(initial=0)), 4 * LINKS)
        for a in range(0, len(owners), BATCH):
            own = owners[a : a + BATCH]
            more = np.full((len(own), width), -1, np.int64)
            at = slice(first[a], first[a] + counts[a : a + BATCH].sum())
            rows, cols = np.repeat(np.arange(len(own)), counts[a : a + BATCH]), rank[at] % max(width, 1)
            more[rows, cols] = source[at]
            ids = np.concatenate([links[own].astype(np.int64), more], 1)
            ids = np.where(ids == own[:, None], -1, ids)
            ids.sort(axis=1)
            ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
            sims = np.where(ids >= 0, np.einsum("bd,bkd->bk", x[own], x[ids]), -2)
            free = (ids >= 0).sum(1) <= 2 * LINKS
            kept = diverse(x, x[own], ids, sims, 2 * LINKS)
            all_of = np.sort(ids, axis=1)[:, ::-1][:, : 2 * LINKS]
            if all_of.shape[1] < 2 * LINKS:
                all_of = np.pad(all_of, ((0, 0), (0, 2 * LINKS - all_of.shape[1])), constant_values=-1)
            links[own] = np.where(free[:, None], all_of, kept)

    def _enter(self, q: np.ndarray) -> np.ndarray:
        """For each query a few nodes near it, of the layers above the lowest built one."""
        start = None
        for nodes, links in reversed(self.layers[1:]):
            x = self.vectors[nodes]
            start = nearest(q, x) if start is None else beam(x, links, q, start, 8)[0][:, :4]
        return start

    def search(self, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of the best ``ef`` that the beam finds for each query; -1 where there are fewer."""
        n = len(self.vectors)
        if n <= TOP or ef >= n // 4:
            s = q @ self.vectors.T
            k = min(n, ef)
            ids = np.argpartition(-s, k - 1, axis=1)[:, :k] if k < n else np.broadcast_to(np.arange(n), s.shape)
            return ids, np.take_along_axis(s, ids, 1)
        found, s = beam(self.sorted, self.layers[0][1], q, self._enter(q), ef)
        return np.where(found >= 0, self.order[found], -1), s


def nearest(q: np.ndarray, x: np.ndarray, k: int = 4) -> np.ndarray:
    s, k = q @ x.T, min(k, len(x))
    return np.argpartition(-s, k - 1, axis=1)[:, :k]


def diverse(x: np.ndarray, q: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` of each query's candidates, best first, leaving out one that is nearer to a chosen one than to the query while others are left."""
    sims = np.where(ids >= 0, sims, -2)
    by = np.argsort(-sims, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, by, 1), np.take_along_axis(sims, by, 1)
    b, k = ids.shape
    out = np.full((b, most), -1, np.int64)
    if not k:
        return out
    v = x[ids]
    between = np.einsum("bkd,bjd->bkj", v, v)
    chosen = np.zeros((b, k), bool)
    for j in range(k):
        worst = np.where(chosen[:, :j], between[:, j, :j], -2).max(axis=1, initial=-2)
        chosen[:, j] = (ids[:, j] >= 0) & (sims[:, j] > worst) & (chosen.sum(1) < most)
    # Places that are left go to the best of those left out.
    rank = np.where(ids < 0, 3 * k, np.where(chosen, 0, k) + np.arange(k))
    pick = np.argsort(rank, axis=1, kind="stable")[:, :most]
    got = np.take_along_axis(ids, pick, 1)
    out[:, : got.shape[1]] = got
    return out


def beam(x: np.ndarray, links: np.ndarray, q: np.ndarray, start: np.ndarray, ef: int, steps: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """The best ``ef`` nodes (ids, similarities; best first) that each query reaches from ``start``: a beam expands its best open nodes until none is left among its best ``ef``."""
    b, n = len(q), len(x)
    rows = np.arange(b)[:, None]
    seen = np.zeros((b, n + 1), bool)
    seen[:, n] = True
    start = np.where(start >= 0, start, n)
    seen[rows, start] = True
    ids = np.full((b, ef), n, np.int64)
    sims = np.full((b, ef), -3.0, np.float32)
    opened = np.ones((b, ef), bool)
    k = min(ef, start.shape[1])
    ids[:, :k] = start[:, :k]
    sims[:, :k] = np.where(ids[:, :k] < n, np.einsum("bd,bkd->bk", q, x[np.minimum(ids[:, :k], n - 1)]), -3)
    opened[:, :k] = ids[:, :k] == n
    live = np.arange(b)
    while len(live):
        s = np.where(opened[live], -3.0, sims[live])
        best = np.argpartition(-s, min(steps, ef) - 1, axis=1)[:, :steps] if steps < ef else np.argsort(-s, axis=1)[:, :steps]
        ok = np.take_along_axis(s, best, 1) > -3
        going = ok.any(1)
        live, best, ok = live[going], best[going], ok[going]
        if not len(live):
            break
        at = live[:, None]
        opened[at, best] = True
        nodes = np.where(ok, ids[at, best], n)
        more = np.where(nodes[:, :, None] < n, links[np.minimum(nodes, n - 1)], -1).reshape(len(live), -1)
        more = np.where((more >= 0) & (more < n), more, n)
        more = np.where(seen[at, more], n, more)
        more.sort(axis=1)
        more[:, 1:][more[:, 1:] == more[:, :-1]] = n
        seen[at, more] = True
        width = int((more < n).sum(1).max(initial=0))
        if not width:
            continue
        more = more[:, :width] if width < more.shape[1] and (more[:, width:] == n).all() else more
        near = np.where(more < n, np.einsum("bd,bkd->bk", q[live], x[np.minimum(more, n - 1)]), -3)
        all_ids, all_sims = np.concatenate([ids[live], more], 1), np.concatenate([sims[live], near], 1)
        all_open = np.concatenate([opened[live], more == n], 1)
        top = np.argpartition(-all_sims, ef - 1, axis=1)[:, :ef]
        ids[live], sims[live], opened[live] = (np.take_along_axis(z, top, 1) for z in (all_ids, all_sims, all_open))
    by = np.argsort(-sims, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, by, 1), np.take_along_axis(sims, by, 1)
    return np.where(ids < n, ids, -1), sims
