"""A robust-pruned directed graph over unit vectors, built and searched in numpy for many vectors at a time."""

from __future__ import annotations

import numpy as np


def _place(sims: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return (((sims + 2) * 2.0**29).astype(np.int64) << 32) | (ids.astype(np.int64) << 1)


def _ids(places: np.ndarray) -> np.ndarray:
    return (places & 0xFFFFFFFF) >> 1


def _dots(q: np.ndarray, x: np.ndarray, row: np.ndarray, col: np.ndarray, part: int = 2048) -> np.ndarray:
    """q[row] . x[col], in parts that stay in the cache."""
    out = np.empty(len(row), np.float32)
    for at in range(0, len(row), part):
        end = at + part
        out[at:end] = np.vecdot(q.take(row[at:end], 0), x.take(col[at:end], 0))
    return out


class VectorGraph:
    """Greedy searches from an entry point propose a new vector's neighbours; relaxed distance pruning keeps those that lie in different
    directions; edges back to the new vector are added and pruned in turn. Vectors enter in growing batches, so that the searches of a batch run as
    array operations on the graph as it stood before.

    x: (n, d) float32 of length one. degree: edges kept by pruning; a node may hold ``slack`` times as many before it is pruned again. beam: width of building
    searches. alpha: how far pruning is relaxed, 1 is strictest.
    """

    def __init__(self, x: np.ndarray, degree: int = 24, beam: int = 36, alpha: float = 1.1, slack: float = 1.6, batch: int = 512, step: int = 4, seed: int = 7):
        self.x = np.ascontiguousarray(x, np.float32)
        n = len(x)
        self.degree, self.room, self.alpha, self.step = degree, int(degree * slack), alpha, step
        self.edges = np.full((n, self.room), -1, np.int32)
        self.count = np.zeros(n, np.int32)
        if n == 0:
            self.entry = 0
            return
        centre = self.x.mean(0)
        self.entry = int(np.argmax(self.x @ centre))
        order = np.random.default_rng(seed).permutation(n).astype(np.int32)
        order = np.concatenate([[self.entry], order[order != self.entry]]).astype(np.int32)
        done = 1
        while done < n:
            now = order[done : done + min(batch, max(1, done))]
            ids, sims = self.search(self.x[now], beam)
            self._insert(now, ids, sims)
            done += len(now)

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The beam after greedy search of every query: (ids, similarities), best first; -1 fills what is missing.

        A place of a beam is one integer: the similarity in steps of 2^-29 above, the node's id below, and in the lowest bit whether the node is still to be
        expanded; so one partition by value moves all three.
        """
        b, n = len(q), len(self.x)
        step = min(self.step, beam)
        places = np.zeros((b, beam), np.int64)
        places[:, 0] = _place(q @ self.x[self.entry], np.full(b, self.entry)) | 1
        seen = np.zeros((b, n), bool)
        seen[:, self.entry] = True
        flat_seen = seen.reshape(-1)
        live = np.arange(b)
        while len(live):
            own = places[live]
            todo = own * (own & 1)
            best = np.partition(todo, beam - step, axis=1)[:, beam - step :]
            own -= (todo >= np.maximum(best.min(1), 1)[:, None]) & (todo > 0)
            row, col = np.nonzero(best)
            near = self.edges.take(_ids(best[row, col]), 0)
            ok = near >= 0
            row, near = np.repeat(row, ok.sum(1)), near[ok]
            cell = live[row] * n + near
            new = np.flatnonzero(~flat_seen[cell])
            row, near = row[new], near[new]
            flat_seen[cell[new]] = True
            s = _dots(q, self.x, live[row], near)
            # Only what beats the beam's last place can enter.
            code = _place(s, near) | 1
            enter = np.flatnonzero(code > own.min(1)[row])
            if len(enter):
                row, code = row[enter], code[enter]
                start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                times = np.diff(np.concatenate([start, [len(row)]]))
                touched = row[start]
                more = np.zeros((len(touched), int(times.max())), np.int64)
                more[np.repeat(np.arange(len(touched)), times), np.arange(len(row)) - np.repeat(start, times)] = code
                # A node that two expanded nodes name comes twice.
                more.sort(axis=1)
                more[:, 1:][more[:, 1:] == more[:, :-1]] = 0
                both = np.concatenate([own[touched], more], axis=1)
                own[touched] = np.partition(both, both.shape[1] - beam, axis=1)[:, both.shape[1] - beam :]
            places[live] = own
            live = live[(own & 1).any(1)]
        places = -np.sort(-places, axis=1)
        ids = np.where(places > 0, _ids(places), -1).astype(np.int32)
        sims = np.where(places > 0, (places >> 32) / 2.0**29 - 2, -np.inf).astype(np.float32)
        return ids, sims

    def _prune(self, nodes: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each node's candidates, best first: keep the best, drop those it is nearer to than the node is (relaxed by alpha), and so on.
        Returns (ids with -1 for none, number kept)."""
        m, width = ids.shape
        v = self.x.take(np.maximum(ids, 0), 0)
        # Squared distances; 2 - 2 * similarity on unit vectors.
        between = 2 - 2 * np.matmul(v, v.transpose(0, 2, 1))
        own = 2 - 2 * sims
        alive = (ids >= 0) & (ids != nodes[:, None])
        kept = np.full((m, self.degree), -1, np.int32)
        number = np.zeros(m, np.int32)
        alpha = self.alpha * self.alpha
        for i in range(width):
            take = alive[:, i] & (number < self.degree)
            if not take.any():
                continue
            t = np.flatnonzero(take)
            kept[t, number[t]] = ids[t, i]
            number[t] += 1
            if i + 1 < width:
                alive[t, i + 1 :] &= ~(alpha * between[t, i, i + 1 :] <= own[t, i + 1 :])
        return kept, number

    def _insert(self, now: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        kept, number = self._prune(now, ids, sims)
        self.edges[now] = -1
        self.edges[now, : self.degree] = kept
        self.count[now] = number
        # Edges back, grouped by the node that gets them.
        ok = kept >= 0
        to, new = kept[ok], np.repeat(now, ok.sum(1))
        order = np.argsort(to, kind="stable")
        to, new = to[order], new[order]
        node, first, times = np.unique(to, return_index=True, return_counts=True)
        place = self.count[to] + np.arange(len(to)) - np.repeat(first, times)
        fits = np.repeat(self.count[node] + times <= self.room, times)
        self.edges[to[fits], place[fits]] = new[fits]
        roomy = self.count[node] + times <= self.room
        self.count[node[roomy]] += times[roomy].astype(np.int32)
        full = np.flatnonzero(~roomy)
        for at in range(0, len(full), 512):
            part = full[at : at + 512]
            n = node[part]
            width = int((self.count[n] + times[part]).max())
            ids = np.full((len(n), width), -1, np.int32)
            ids[:, : self.room] = self.edges[n]
            which = np.repeat(np.arange(len(n)), times[part])
            flat = np.concatenate([np.arange(first[p], first[p] + times[p]) for p in part])
            ids[which, place[flat]] = new[flat]
            s = np.matmul(self.x.take(np.maximum(ids, 0), 0), self.x[n][:, :, None])[:, :, 0]
            s[ids < 0] = -np.inf
            order = np.argsort(-s, axis=1)
            kept, number = self._prune(n, np.take_along_axis(ids, order, 1), np.take_along_axis(s, order, 1))
            self.edges[n] = -1
            self.edges[n, : self.degree] = kept
            self.count[n] = number
