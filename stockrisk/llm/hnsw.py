"""A navigable small-world graph in layers over unit vectors, built and searched in numpy, many points at a time.

Layers are built from the top.  A node's layers follow from a hash of its place, so that a graph is the same each time it
is built.  Points are added in batches: each finds its neighbours by a beam search among the points before it, and by
direct comparison inside its batch; of these it keeps such that are nearer to it than to any neighbour kept before.
"""

from __future__ import annotations

import io

import numpy as np

from stockrisk.llm.blocks import mix

DEGREE = 16
BUILD_BEAM = 64
BATCH = 256


def _dots(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return (rows @ queries[:, :, None])[:, :, 0]


class Graph:
    def __init__(self, unit: np.ndarray, layers: list[np.ndarray], counts: list[int]) -> None:
        self.unit = unit  # rows in insertion order
        self.layers = layers  # neighbours (rows x degree, -1: none) of each layer's first ``counts[k]`` rows
        self.counts = counts

    @classmethod
    def build(cls, unit: np.ndarray) -> tuple[Graph, np.ndarray]:
        """The graph of these rows, and the order in which it holds them."""
        n = len(unit)
        draw = mix(np.arange(1, n + 1, dtype=np.uint64))
        share = (draw >> np.uint64(11)).astype(np.float64) / 2.0**53
        level = np.floor(-np.log(np.maximum(share, 1e-18)) / np.log(DEGREE)).astype(int)
        order = np.lexsort((draw, -level))
        level, unit = level[order], np.ascontiguousarray(unit[order])
        graph = cls(unit, [], [])
        for k in range(int(level.max(initial=0)), -1, -1):
            graph._add_layer(int((level >= k).sum()), 2 * DEGREE if k == 0 else DEGREE)
        return graph, order

    def _add_layer(self, count: int, width: int) -> None:
        links = np.full((count, width), -1, np.int32)
        above = list(self.layers)
        self.layers.append(links)
        self.counts.append(0)
        done = 0
        while done < count:
            batch = np.arange(done, min(count, done + max(1, min(BATCH, done or 32))))
            inner = self.unit[batch] @ self.unit[batch].T
            np.fill_diagonal(inner, -2)
            near = np.argsort(-inner, axis=1, kind="stable")[:, :width]
            ids, sims = batch[near], np.take_along_axis(inner, near, axis=1)
            if done:
                self.counts[-1] = done
                found, like = self.search(self.unit[batch], BUILD_BEAM, above)
                ids, sims = np.c_[found, ids], np.c_[like, sims]
            ids = np.where(sims > -1.5, ids, -1)
            self._link(links, batch, ids, sims, width)
            done = int(batch[-1]) + 1
        self.counts[-1] = count

    def _select(self, rows: np.ndarray, ids: np.ndarray, sims: np.ndarray, width: int) -> np.ndarray:
        """At most ``width`` spread neighbours of each row out of its candidates."""
        order = np.argsort(-sims, axis=1, kind="stable")[:, : 2 * width]
        ids, sims = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)
        places = self.unit[np.maximum(ids, 0)]
        among = places @ places.transpose(0, 2, 1)
        keep, again = np.zeros(ids.shape, bool), np.zeros(ids.shape, bool)
        for j in range(ids.shape[1]):
            blocked = (keep[:, :j] & (among[:, j, :j] > sims[:, j : j + 1])).any(axis=1) if j else np.zeros(len(ids), bool)
            again[:, j] = (ids[:, :j] == ids[:, j : j + 1]).any(axis=1) if j else False
            keep[:, j] = (ids[:, j] >= 0) & ~blocked & ~again[:, j]
        # Free places go to the nearest of the others.
        order = np.argsort(np.where(keep, 0, np.where(again, 2, 1)), axis=1, kind="stable")[:, :width]
        out = np.full((len(ids), width), -1, np.int32)
        out[:, : order.shape[1]] = np.take_along_axis(np.where(again, -1, ids), order, axis=1)
        return out

    def _link(self, links: np.ndarray, batch: np.ndarray, ids: np.ndarray, sims: np.ndarray, width: int) -> None:
        links[batch] = self._select(batch, ids, sims, width)
        back, to = links[batch].ravel(), np.repeat(batch, width)
        to, back = to[back >= 0], back[back >= 0]
        order = np.lexsort((to, back))
        to, back = to[order], back[order]
        nodes, at = np.unique(back, return_index=True)
        sizes = np.diff(np.r_[at, len(back)])
        wide = int(sizes.max(initial=0))
        if not wide:
            return
        offered = np.full((len(nodes), wide), -1, np.int64)
        offered[np.repeat(np.arange(len(nodes)), sizes), np.arange(len(back)) - np.repeat(at, sizes)] = to
        for a in range(0, len(nodes), BATCH):
            own = nodes[a : a + BATCH]
            every = np.c_[links[own], offered[a : a + BATCH]]
            like = _dots(self.unit[own], self.unit[np.maximum(every, 0)])
            like = np.where((every >= 0) & (every != own[:, None]), like, -2)
            links[own] = self._select(own, np.where(like > -1.5, every, -1), like, width)

    def search(self, queries: np.ndarray, beam: int, layers: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` most alike rows found for each query, best first; -1 and -2 where there are fewer."""
        parts = [self._search(queries[a : a + BATCH], beam, layers) for a in range(0, len(queries), BATCH)]
        return tuple(np.concatenate(x) for x in zip(*parts))

    def _search(self, queries: np.ndarray, beam: int, above: list | None) -> tuple[np.ndarray, np.ndarray]:
        upper, links, count = self.layers[:-1] if above is None else above, self.layers[-1], self.counts[-1]
        each = np.arange(len(queries))
        now = np.zeros(len(queries), np.int64)
        sim = queries @ self.unit[0]
        for layer in upper:
            moving = each
            while len(moving):
                ids = layer[now[moving]]
                like = _dots(queries[moving], self.unit[np.maximum(ids, 0)])
                like[ids < 0] = -2
                best = like.argmax(axis=1)
                gain = np.take_along_axis(like, best[:, None], 1)[:, 0] > sim[moving]
                moving, best, ids, like = moving[gain], best[gain], ids[gain], like[gain]
                at = np.arange(len(moving))
                now[moving], sim[moving] = ids[at, best], like[at, best]
        outside = now >= count  # not added to this layer yet
        now[outside], sim[outside] = 0, queries[outside] @ self.unit[0]
        beam = min(beam, count)
        ids = np.full((len(queries), beam), -1, np.int64)
        sims = np.full((len(queries), beam), -2, np.float32)
        spent = np.ones((len(queries), beam), bool)
        ids[:, 0], sims[:, 0], spent[:, 0] = now, sim, False
        seen = np.zeros((len(queries), count), bool)
        seen[each, now] = True
        active = each
        while len(active):
            slot = np.where(spent[active], -3, sims[active]).argmax(axis=1)
            fresh = ~spent[active, slot]
            active, slot = active[fresh], slot[fresh]
            if not len(active):
                break
            spent[active, slot] = True
            near = links[ids[active, slot]].astype(np.int64)
            valid = near >= 0
            valid &= ~seen[active[:, None], np.maximum(near, 0)]
            like = _dots(queries[active], self.unit[np.maximum(near, 0)])
            like[~valid] = -2
            q, k = np.nonzero(valid)
            seen[active[q], near[q, k]] = True
            all_sims = np.c_[sims[active], like]
            order = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
            sims[active] = np.take_along_axis(all_sims, order, 1)
            ids[active] = np.take_along_axis(np.c_[ids[active], np.where(valid, near, -1)], order, 1)
            spent[active] = np.take_along_axis(np.c_[spent[active], ~valid], order, 1)
        return ids, sims

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, unit=self.unit, counts=np.array(self.counts), **{f"layer{k}": x for k, x in enumerate(self.layers)})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Graph:
        with np.load(io.BytesIO(data)) as f:
            counts = f["counts"].tolist()
            return cls(f["unit"], [f[f"layer{k}"] for k in range(len(counts))], counts)
