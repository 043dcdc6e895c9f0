"""A hierarchical navigable small-world graph over unit vectors, built and searched in numpy for many vectors at once.

A vector's level falls off geometrically with its hash. Each layer links the vectors of its level and above; the layers
are built from the top, so that a search enters a layer at what it found in the layer above. Searches of a whole block
run side by side: in each round every query opens the best candidates of its beam that are not open yet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Links of a vector in the layers above the ground; twice as many on the ground.
LINKS = 16
#: Cells of the table of seen vectors that one block of queries may use.
CELLS = 1 << 24


def spread(n: int, seed: int) -> np.ndarray:
    """n numbers in (0, 1), always the same."""
    return np.random.default_rng(seed).random(n)


class Graph:
    """Layers over the unit rows ``x``: ``members[l]`` are the rows in layer l, ``links[l]`` their neighbours (-1: none)."""

    def __init__(self, x: np.ndarray, members: list[np.ndarray], links: list[np.ndarray]):
        self.x, self.members, self.links = x, members, links
        self.place = []
        for rows in members:
            place = np.full(len(x), -1, np.int32)
            place[rows] = np.arange(len(rows), dtype=np.int32)
            self.place.append(place)

    # -- search ------------------------------------------------------------------------------------------------

    def enter(self, q: np.ndarray, down_to: int, beam: int) -> np.ndarray:
        """For each query the rows at which layer ``down_to`` is entered (-1 fills)."""
        top = len(self.members) - 1
        if down_to >= top:
            return np.full((len(q), 1), self.members[top][0], np.int32)
        at = np.full((len(q), 1), self.members[top][0], np.int32)
        for layer in range(top, down_to, -1):
            at = self.walk(q, at, layer, beam)[0]
        return at

    def walk(
        self, q: np.ndarray, start: np.ndarray, layer: int, beam: int, least: float | None = None, opens: int = 4
    ) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """The best ``beam`` rows of a layer for each query, best first, with their products; found rows (query, row) whose
        product is ``least`` or more, all that the search met, opened as long as there are new ones."""
        n, rows, links, place = len(q), self.members[layer], self.links[layer], self.place[layer]
        seen = np.full((n, len(rows)), -1, np.int32)
        best = np.full((n, beam), -1, np.int32)  # places in the layer
        score = np.full((n, beam), -np.inf, np.float32)
        opened = np.ones((n, beam), bool)
        hits: list[tuple[np.ndarray, np.ndarray]] = []

        def new(who: np.ndarray, what: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Pairs not seen before, once each, with their products."""
            fresh = seen[who, what] < 0
            who, what = who[fresh], what[fresh]
            mark = np.arange(len(who), dtype=np.int32)
            seen[who, what] = mark
            once = seen[who, what] == mark
            who, what = who[once], what[once]
            got = np.empty(len(who), np.float32)
            for lo in range(0, len(who), 1 << 16):
                i, j = who[lo : lo + (1 << 16)], rows[what[lo : lo + (1 << 16)]]
                got[lo : lo + (1 << 16)] = np.einsum("ij,ij->i", q[i], self.x[j])
            if least is not None:
                ok = got >= least
                hits.append((who[ok], what[ok]))
            return who, what, got

        def merge(who: np.ndarray, what: np.ndarray, got: np.ndarray) -> None:
            """Put scored pairs into the beams."""
            good = got > score[who, -1]
            who, what, got = who[good], what[good], got[good]
            if not len(who):
                return
            order = np.lexsort((-got, who))
            who, what, got = who[order], what[order], got[order]
            own, first, count = np.unique(who, return_index=True, return_counts=True)
            slot = np.arange(len(who)) - np.repeat(first, count)
            few = slot < beam
            line = np.repeat(np.arange(len(own)), count)[few]
            width = min(beam, int(count.max()))
            s = np.full((len(own), beam + width), -np.inf, np.float32)
            w = np.full((len(own), beam + width), -1, np.int32)
            o = np.ones((len(own), beam + width), bool)
            s[:, :beam], w[:, :beam], o[:, :beam] = score[own], best[own], opened[own]
            s[line, beam + slot[few]], w[line, beam + slot[few]], o[line, beam + slot[few]] = got[few], what[few], False
            take = np.argsort(-s, axis=1, kind="stable")[:, :beam]
            score[own], best[own], opened[own] = (np.take_along_axis(v, take, 1) for v in (s, w, o))

        i, j = np.nonzero(start >= 0)
        merge(*new(i.astype(np.int32), place[start[i, j]]))
        while True:
            rank = np.cumsum(~opened, axis=1)
            i, j = np.nonzero(~opened & (rank <= opens))
            if not len(i):
                break
            opened[i, j] = True
            near = links[best[i, j]]
            a, b = np.nonzero(near >= 0)
            merge(*new(i[a].astype(np.int32), near[a, b]))
        found = (np.zeros(0, np.int32), np.zeros(0, np.int32))
        if hits:
            found = tuple(np.concatenate(c) for c in zip(*hits, strict=True))
            # A beam that is full of hits may have left some unopened: go on from all of these.
            many = np.bincount(found[0], minlength=n) >= beam
            front = tuple(c[many[found[0]]] for c in found)
            while len(front[0]):
                hits.clear()
                for lo in range(0, len(front[0]), 1 << 14):
                    near = links[front[1][lo : lo + (1 << 14)]]
                    a, b = np.nonzero(near >= 0)
                    new(front[0][lo : lo + (1 << 14)][a], near[a, b])
                front = tuple(np.concatenate(c) for c in zip(*hits, strict=True))
                found = tuple(np.concatenate(c) for c in zip(found, front, strict=True))
            found = (found[0], rows[found[1]])
        return np.where(best >= 0, rows[best], -1), score, found

    def near(self, q: np.ndarray, beam: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, row) met on the ground whose product is ``least`` or more, by blocks of queries."""
        step = max(1, min(1024, CELLS // max(1, len(self.x))))
        for lo in range(0, len(q), step):
            own = q[lo : lo + step]
            i, j = self.walk(own, self.enter(own, 0, 8), 0, beam, least)[2]
            yield i.astype(np.int64) + lo, j.astype(np.int64)


def choose(x: np.ndarray, own: np.ndarray, found: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` of each row's candidates (-1 fills), best first, as links in different directions: a candidate is
    taken if it is nearer to the row than to all taken ones; the best of the others fill up."""
    n, width = found.shape
    take = np.zeros((n, width), bool)
    step = max(1, (1 << 22) // max(1, width * max(width, x.shape[1])))
    for lo in range(0, n, step):
        f, s = found[lo : lo + step], score[lo : lo + step]
        v = x[f]
        between = v @ v.transpose(0, 2, 1)
        t = take[lo : lo + step]
        closest = np.full(f.shape, -np.inf, np.float32)  # to any taken one
        count = np.zeros(len(f), int)
        for k in range(width):
            ok = (f[:, k] >= 0) & (s[:, k] > closest[:, k]) & (count < most)
            t[:, k] = ok
            count += ok
            closest = np.where(ok[:, None], np.maximum(closest, between[:, :, k]), closest)
    valid = found >= 0
    order = np.argsort(np.where(take, 0, np.where(valid, 1, 2)), axis=1, kind="stable")[:, :most]
    out = np.take_along_axis(found, order, 1)
    if out.shape[1] < most:
        out = np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)
    return out


def build(x: np.ndarray, links: int = LINKS, beam: int = 48, seed: int = 3, batch: int = 1024) -> Graph:
    """The graph over unit rows; ``beam`` is how many candidates a new vector's links are chosen from."""
    n = len(x)
    level = np.floor(-np.log(np.maximum(spread(n, seed), 1e-300)) / np.log(links)).astype(int)
    top = int(level.max()) if n else 0
    while top and (level >= top).sum() < links // 2:  # no layer of a few
        top -= 1
    level = np.minimum(level, top)
    graph = Graph(x, [], [])
    for layer in range(top, -1, -1):
        order = np.lexsort((np.arange(n), -level))
        rows = order[level[order] >= layer].astype(np.int32)
        most = links * 2 if layer == 0 else links
        own = np.full((len(rows), most), -1, np.int32)
        layers = Graph(x, [rows, *graph.members], [own, *graph.links])
        known = min(len(rows), int((level > layer).sum()) or 1)
        done = 0
        while done < len(rows):
            # The layer above comes first, then batches that grow with what is there.
            end = min(len(rows), done + min(batch, max(links, done) if done else known))
            _insert(layers, rows, done, end, most, links, beam)
            done = end
        graph = layers
    return graph


def _insert(graph: Graph, rows: np.ndarray, done: int, end: int, most: int, links: int, beam: int) -> None:
    """Link rows[done:end] in the lowest layer of ``graph`` with those before and with each other."""
    x, own = graph.x, graph.links[0]
    new = rows[done:end]
    q = x[new]
    # Among themselves.
    product = q @ q.T
    np.fill_diagonal(product, -np.inf)
    few = min(beam, len(new) - 1)
    at = np.argpartition(-product, few - 1, axis=1)[:, :few] if few > 0 else np.zeros((len(new), 0), int)
    found, score = new[at].astype(np.int32), np.take_along_axis(product, at, 1)
    if done:
        step = max(1, CELLS // len(rows))
        old, old_score = [], []
        for lo in range(0, len(q), step):
            part = q[lo : lo + step]
            start = _entries(graph, part, rows, done)
            f, s, _ = graph.walk(part, start, 0, min(beam, done))
            old.append(f)
            old_score.append(s)
        found = np.concatenate([found, np.concatenate(old)], axis=1)
        score = np.concatenate([score, np.concatenate(old_score)], axis=1).astype(np.float32)
    order = np.argsort(-score, axis=1, kind="stable")[:, :beam]
    found, score = np.take_along_axis(found, order, 1), np.take_along_axis(score, order, 1)
    found = np.where(np.isfinite(score), found, -1)
    picked = choose(x, new, found, score, links)
    place = graph.place[0]
    own[done:end, :links] = np.where(picked >= 0, place[picked], -1)
    # The way back: a row that gets more links than it may have chooses again.
    i, j = np.nonzero(picked >= 0)
    target, source = place[picked[i, j]], (done + i).astype(np.int32)
    worth = np.einsum("ij,ij->i", q[i], x[rows[target]]) if len(i) else np.zeros(0, np.float32)
    order = np.lexsort((-worth, target))
    target, source = target[order], source[order]
    hit, first, count = np.unique(target, return_index=True, return_counts=True)
    slot = np.arange(len(target)) - np.repeat(first, count)
    few = slot < 2 * most
    width = min(2 * most, int(count.max())) if len(hit) else 0
    if not width:
        return
    incoming = np.full((len(hit), width), -1, np.int32)
    incoming[np.repeat(np.arange(len(hit)), count)[few], slot[few]] = source[few]
    # A link that is there already (both chose each other) isn't taken twice.
    twice = (incoming[:, :, None] == own[hit][:, None, :]).any(2)
    incoming[twice] = -1
    every = np.concatenate([own[hit], incoming], axis=1)
    for lo in range(0, len(hit), 4096):
        part = every[lo : lo + 4096]
        v = x[rows[part]]
        s = np.einsum("ijk,ik->ij", v, x[rows[hit[lo : lo + 4096]]])
        s = np.where(part >= 0, s, -np.inf).astype(np.float32)
        order = np.argsort(-s, axis=1, kind="stable")
        part, s = np.take_along_axis(part, order, 1), np.take_along_axis(s, order, 1)
        full = (part >= 0).sum(1) > most
        chosen = part[:, :most].copy()
        if full.any():
            again = choose(x, rows[hit[lo : lo + 4096]][full], np.where(part[full] >= 0, rows[part[full]], -1), s[full], most)
            chosen[full] = np.where(again >= 0, place[again], -1)
        own[hit[lo : lo + 4096], : chosen.shape[1]] = chosen


def _entries(graph: Graph, q: np.ndarray, rows: np.ndarray, done: int) -> np.ndarray:
    """Where new rows enter the lowest layer: at what the layers above hold nearest, all of which it has already."""
    if len(graph.members) == 1:
        return np.broadcast_to(rows[:1], (len(q), 1)).astype(np.int32)
    return graph.enter(q, 0, 8)


def audit(graph: Graph, beam: int, least: float, sample: int = 128, seed: int = 9) -> float:
    """The share that a search finds of the rows with a product of ``least`` or more, over queries that are ``least`` away
    from sampled rows in random directions; all are compared for the truth."""
    n, d = graph.x.shape
    rng = np.random.default_rng(seed)
    rows = np.sort(rng.permutation(n)[:sample])
    v = graph.x[rows].astype(np.float64)
    side = rng.normal(size=v.shape)
    side -= (side * v).sum(1)[:, None] * v
    norm = np.linalg.norm(side, axis=1)[:, None]
    near = min(1.0, least + 1e-3)
    q = np.where(norm > 1e-9, near * v + np.sqrt(1 - near**2) * side / np.maximum(norm, 1e-300), v).astype(np.float32)
    want = 0
    for lo in range(0, n, 1 << 14):
        want += int((q @ graph.x[lo : lo + (1 << 14)].T >= least).sum())
    return sum(len(i) for i, _ in graph.near(q, beam, least)) / want if want else 1.0


def audited_beam(graph: Graph, least: float, recall: float = 0.99, start: int = 32) -> int:
    """The first beam of ``start``, twice that, and so on whose audit reaches ``recall``; at last the whole ground."""
    beam = start
    while beam < len(graph.x) and audit(graph, beam, least) < recall:
        beam *= 2
    return min(beam, max(1, len(graph.x)))
