"""A hierarchical navigable small-world graph over the unit vectors of one shard, built and searched in batches of rows.

Nodes are balls: a vector within half the linking angle of an earlier node joins that node's ball, as all members of a ball then are
within the linking angle of one another.  So a crowd of near copies is one node, whose members are counted without meeting each other.
"""

from __future__ import annotations

import io
from math import log

import numpy as np

#: What angles may be off by when a ball as a whole is taken or left; between these its members are compared.
SLACK = 1e-7


class Graph:
    """Nodes' vectors, balls and links by layer; layer 0 has all nodes, each higher one a share of 1 / degree of the one below."""

    def __init__(self, rows: np.ndarray, unit: np.ndarray, least: float, degree: int = 16, beam: int = 64, seed: int = 7):
        """rows: numbers of the vectors; unit: their directions; least: the cosine from which two vectors are linked."""
        self.rows, self.unit, self.least, self.ef, self.recall = rows, unit, least, 32, 1.0
        self.angle = float(np.arccos(min(1.0, least)))
        self.ball = np.full(len(rows), -1, np.int32)
        self.node = np.zeros(0, np.int32)  # the vector of each node
        self.radius = np.zeros(0)
        self.top = int(log(max(len(rows), 1)) / log(degree))
        self.links = [np.full((len(rows), 2 * degree if layer == 0 else degree), -1, np.int32) for layer in range(self.top + 1)]
        self._close = [np.full(x.shape, -np.inf, np.float32) for x in self.links]
        self._short = unit.astype(np.float32)
        self.vectors = np.zeros((0, unit.shape[1]), np.float32)
        chance, size = np.random.default_rng(seed), 32
        at = 0
        while at < len(rows):
            step = min(256, max(size, len(self.node) // 8))  # a batch is a small part of the graph that it enters
            self._enter(np.arange(at, min(len(rows), at + step)), degree, beam, chance)
            at += step
        del self._close, self._short
        self._members()

    # -- building ---------------------------------------------------------------------------------------------------------------

    def _enter(self, new: np.ndarray, degree: int, beam: int, chance: np.random.Generator) -> None:
        q = self._short[new]
        found = self._descend(q, beam)
        limit = np.cos(self.angle / 2 - SLACK)
        near = found[0][0][:, 0] if len(self.node) else np.full(len(new), -1)
        cosine = np.where(near >= 0, np.einsum("ij,ij->i", self.unit[new], self.unit[self.node[near]]) if len(self.node) else 0.0, -1.0)
        joins = cosine >= limit
        among = self.unit[new] @ self.unit[new].T
        first: list[int] = []  # of this batch, those that become nodes
        count = len(self.node)
        for i in np.flatnonzero(~joins):
            mates = among[i, first] if first else np.zeros(0)
            if len(mates) and mates.max() >= limit:
                near[i], cosine[i], joins[i] = count + int(mates.argmax()), mates.max(), True
            else:
                first.append(int(i))
        keep = np.array(first, int)
        self.node = np.concatenate([self.node, new[keep].astype(np.int32)])
        self.radius = np.concatenate([self.radius, np.zeros(len(keep))])
        self.vectors = np.concatenate([self.vectors, q[keep]])
        self.ball[new[keep]] = count + np.arange(len(keep))
        self.ball[new[joins]] = near[joins]
        np.maximum.at(self.radius, near[joins], np.arccos(np.clip(cosine[joins], -1, 1)))
        if not len(keep):
            return
        level = np.minimum(self.top, (-np.log(1 - chance.random(len(keep))) / log(degree)).astype(int))
        if count == 0:
            level[0] = self.top  # where every search begins
        ids, mates = count + np.arange(len(keep)), among[np.ix_(keep, keep)].astype(np.float32)
        np.fill_diagonal(mates, -np.inf)
        for layer in range(self.top + 1):
            at = np.flatnonzero(level >= layer)
            if len(at):
                idx, sim = found[layer] if count else (np.zeros((len(new), 0), np.int64), np.zeros((len(new), 0), np.float32))
                own = mates[np.ix_(at, at)]
                close = np.argsort(-own, axis=1)[:, :degree]
                self._connect(layer, ids[at], np.concatenate([idx[keep[at]], ids[at][close]], axis=1), np.concatenate([sim[keep[at]], np.take_along_axis(own, close, 1)], axis=1), degree)

    def _connect(self, layer: int, ids: np.ndarray, near: np.ndarray, sim: np.ndarray, degree: int) -> None:
        """Links each new node to candidates that are closer to it than to those chosen before, and these back to it."""
        order = np.argsort(-sim, axis=1, kind="stable")
        near, sim = np.take_along_axis(near, order, 1), np.take_along_axis(sim, order, 1)
        n = len(ids)
        chosen, many = np.full((n, degree), -1, np.int64), np.zeros(n, int)
        close = np.full((n, degree), -np.inf, np.float32)
        for c in range(near.shape[1]):
            able = np.flatnonzero((near[:, c] >= 0) & np.isfinite(sim[:, c]) & (many < degree))
            if not len(able):
                continue
            v = self.vectors[near[able, c]]
            width = max(1, int(many[able].max(initial=0)))
            had = chosen[able, :width]
            others = np.einsum("ij,ikj->ik", v, self.vectors[np.maximum(had, 0)])
            apart = (np.where(had >= 0, others, -np.inf) < sim[able, c][:, None]).all(axis=1)
            take = able[apart]
            chosen[take, many[take]], close[take, many[take]] = near[take, c], sim[take, c]
            many[take] += 1
        links, closeness = self.links[layer], self._close[layer]
        links[ids, :degree], closeness[ids, :degree] = chosen, close
        i, j = np.nonzero(chosen >= 0)
        if not len(i):
            return
        to, back, s = chosen[i, j], ids[i], close[i, j]
        touched = np.unique(to)
        cap = links.shape[1]
        t = np.concatenate([np.repeat(touched, cap), to])
        x = np.concatenate([links[touched].ravel(), back])
        s = np.concatenate([closeness[touched].ravel(), s])
        real = x >= 0
        t, x, s = t[real], x[real], s[real]
        order = np.lexsort((-s, t))
        t, x, s = t[order], x[order], s[order]
        same = np.concatenate([[True], (t[1:] != t[:-1]) | (x[1:] != x[:-1])])  # batch mates may choose each other
        t, x, s = t[same], x[same], s[same]
        begin = np.searchsorted(t, touched)
        rank = np.arange(len(t)) - np.repeat(begin, np.diff(np.append(begin, len(t))))
        fits = rank < cap
        links[touched], closeness[touched] = -1, -np.inf
        links[t[fits], rank[fits]], closeness[t[fits], rank[fits]] = x[fits], s[fits]

    # -- searching --------------------------------------------------------------------------------------------------------------

    def _descend(self, q: np.ndarray, ef: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """The beam of each layer: nodes (-1: none) and their cosines, closest first."""
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        if not len(self.node):
            return {0: (np.full((len(q), 1), -1), np.full((len(q), 1), -np.inf, np.float32))}
        entry = np.zeros((len(q), 1), np.int64)
        for layer in range(self.top, -1, -1):
            found[layer] = self._beam(layer, q, entry, 16 if layer else ef)
            entry = found[layer][0][:, :4]
        return found

    def _beam(self, layer: int, q: np.ndarray, entry: np.ndarray, ef: int, wide: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search for all rows of q side by side: each round follows the links of the ``wide`` best nodes not yet followed."""
        rows, n, links = len(q), len(self.node), self.links[layer]
        idx, sim, fresh = np.full((rows, ef), -1, np.int64), np.full((rows, ef), -np.inf, np.float32), np.zeros((rows, ef), bool)
        seen = np.zeros(rows * n, bool)
        r, c = np.nonzero(entry >= 0)
        flat = np.unique(r * n + entry[r, c])
        while True:
            flat = flat[~seen[flat]]
            seen[flat] = True
            r, node = np.divmod(flat, n)
            s = np.einsum("ij,ij->i", q[r], self.vectors[node])
            better = s > sim[r, -1]
            r, node, s = r[better], node[better], s[better]
            if len(r):
                act, at = np.unique(r, return_inverse=True)
                many = np.bincount(at)
                place = np.arange(len(r)) - np.repeat(np.cumsum(many) - many, many)
                more, more_sim = np.full((len(act), many.max()), -1, np.int64), np.full((len(act), many.max()), -np.inf, np.float32)
                more[at, place], more_sim[at, place] = node, s
                all_sim = np.concatenate([sim[act], more_sim], axis=1)
                order = np.argsort(-all_sim, axis=1, kind="stable")[:, :ef]
                take = lambda a, b: np.take_along_axis(np.concatenate([a, b], axis=1), order, 1)
                idx[act], fresh[act], sim[act] = take(idx[act], more), take(fresh[act], more >= 0), np.take_along_axis(all_sim, order, 1)
            pick = fresh & (np.cumsum(fresh, axis=1) <= wide)
            r, c = np.nonzero(pick)
            if not len(r):
                return idx, sim
            fresh[r, c] = False
            to = links[idx[r, c]]
            flat = np.unique((r[:, None] * n + to)[to >= 0])

    def within(self, q: np.ndarray, ef: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(row of q, node) of the balls that may have members linked with that row, as far as the beams find them.

        A beam that is full of such nodes may have left others out: it is widened until it isn't, or holds the whole shard."""
        ef, short = max(1, min(ef or self.ef, len(self.node))), q.astype(np.float32)
        reach = float(np.cos(min(np.pi, self.angle + self.radius.max(initial=0.0) + 1e-3)))
        rows = np.arange(len(q))
        out: list[tuple[np.ndarray, np.ndarray]] = []
        while len(rows) and len(self.node):
            block = max(16, min(256, (1 << 24) // len(self.node), (1 << 21) // ef))  # what is seen, and the beams, stay bounded
            again = []
            for lo in range(0, len(rows), block):
                part = rows[lo : lo + block]
                idx, sim = self._descend(short[part], ef)[0]
                full = (sim[:, -1] >= reach) & (ef < len(self.node))
                again.append(part[full])
                i, j = np.nonzero((sim >= reach) & ~full[:, None])
                out.append((part[i], idx[i, j]))
            rows, ef = np.concatenate(again), min(2 * ef, len(self.node))
        r, node = (np.concatenate([x[i] for x in out] or [np.zeros(0, np.int64)]) for i in (0, 1))
        far = np.arccos(np.clip(self._cosines(q, r, node), -1, 1)) > self.angle + self.radius[node] + SLACK
        return r[~far], node[~far]

    def _cosines(self, q: np.ndarray, r: np.ndarray, node: np.ndarray) -> np.ndarray:
        out = np.zeros(len(r))
        for lo in range(0, len(r), 1 << 14):
            part = slice(lo, lo + (1 << 14))
            out[part] = np.einsum("ij,ij->i", q[r[part]], self.unit[self.node[node[part]]])
        return out

    def audit(self, target: float, sample: int = 256, seed: int = 11) -> None:
        """Widens the beam until searches find ``target`` of what comparing with all nodes finds.

        Asked are directions near the linking angle from a sample of nodes, so that each has something to find."""
        chance = np.random.default_rng(seed)
        x = self.unit[self.node[chance.permutation(len(self.node))[:sample]]]
        aside = chance.standard_normal(x.shape)
        aside -= np.einsum("ij,ij->i", aside, x)[:, None] * x
        aside /= np.maximum(np.linalg.norm(aside, axis=1), 1e-300)[:, None]
        turn = self.angle * chance.uniform(0.5, 0.999, (len(x), 1))
        q = np.cos(turn) * x + np.sin(turn) * aside
        truth = np.arccos(np.clip(q @ self.unit[self.node].T, -1, 1)) <= self.angle + self.radius
        while True:
            r, node = self.within(q)
            hit = int(truth[r, node].sum())
            self.recall = hit / max(1, int(truth.sum()))
            if self.recall >= target or self.ef >= len(self.node):
                return
            self.ef *= 2

    # -- linking ----------------------------------------------------------------------------------------------------------------

    def _members(self) -> None:
        self._order = np.argsort(self.ball, kind="stable")
        self._begin = np.searchsorted(self.ball[self._order], np.arange(len(self.node) + 1))
        self.size = np.diff(self._begin)

    def linked(self, rows: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How many other vectors of this shard each row of q is linked with; and (row of q, node) with a link between them."""
        r, node = self.within(q)
        order = np.argsort(self.rows)
        at = np.minimum(np.searchsorted(self.rows, rows, sorter=order), max(0, len(self.rows) - 1))
        mine = self.rows[order[at]] == rows if len(self.rows) else np.zeros(len(rows), bool)
        own = np.stack([np.flatnonzero(mine), self.ball[order[at[mine]]]], axis=1)  # a vector's own ball, whatever the beam found
        r, node = np.unique(np.concatenate([np.stack([r, node], axis=1), own]), axis=0).T
        cosine = self._cosines(q, r, node)
        alone = self.size[node] == 1
        angle = np.arccos(np.clip(cosine, -1, 1))
        some = np.where(alone, (cosine >= self.least).astype(np.int64), np.where(angle + self.radius[node] <= self.angle - SLACK, self.size[node], -1))
        is_own = np.zeros(len(q), np.int64) - 1
        is_own[own[:, 0]] = own[:, 1]
        some[is_own[r] == node] = self.size[node[is_own[r] == node]]  # members of a ball are linked with one another
        unsure = np.flatnonzero(some < 0)
        for ball in np.unique(node[unsure]):
            members = self.unit[self._order[self._begin[ball] : self._begin[ball + 1]]]
            asked = unsure[node[unsure] == ball]
            for lo in range(0, len(asked), 256):
                part = asked[lo : lo + 256]
                some[part] = (q[r[part]] @ members.T >= self.least).sum(axis=1)
        counts = np.bincount(r, weights=some, minlength=len(q)).astype(np.int64) - mine
        hit = some > 0
        return counts, r[hit], node[hit]

    # -- keeping ----------------------------------------------------------------------------------------------------------------

    def dumped(self) -> bytes:
        n, to = len(self.node), io.BytesIO()
        np.savez(to, rows=self.rows, unit=self.unit, ball=self.ball, node=self.node, radius=self.radius, facts=np.array([self.least, self.ef, self.recall, self.top]), **{f"links{i}": x[:n] for i, x in enumerate(self.links)})
        return to.getvalue()

    @classmethod
    def loaded(cls, data: bytes) -> Graph:
        out, had = cls.__new__(cls), np.load(io.BytesIO(data))
        for name in ("rows", "unit", "ball", "node", "radius"):
            setattr(out, name, had[name])
        out.vectors = out.unit[out.node].astype(np.float32)
        least, ef, out.recall, top = had["facts"].tolist()
        out.least, out.ef, out.top, out.angle = least, int(ef), int(top), float(np.arccos(min(1.0, least)))
        out.links = [had[f"links{i}"] for i in range(out.top + 1)]
        out._members()
        return out
