"""Navigable small-world graphs over Hamming distance, many groups of points at a time.

The points of a group are inserted in a random order, in stages that double the graph. The first
`ROOTS` are linked to each other; every later point searches the graph as it stands, links to the `OUT`
nearest it finds, and these link back while they have room or the newcomer is nearer than what they hold.
A search keeps a beam of the nearest points met, starts at the first points of the group and always
opens the nearest unopened one; it ends when all of the beam are open.
"""

from __future__ import annotations

import numpy as np

from echofold.llm.simhash import distance
from echofold.llm.vectext import mixed

ROOTS, OUT, BACK = 8, 8, 16
_FAR = np.uint64(2**64 - 1)


class SmallWorld:
    """sig: (n, 4) SimHashes; size: points of each group, the groups lying one after the other."""

    def __init__(self, sig: np.ndarray, size: np.ndarray, beam: int = 16):
        self.sig, self.size = sig, size
        n = len(sig)
        self.first = np.cumsum(size) - size
        self.group = np.repeat(np.arange(len(size)), size)
        self.adj = np.full((n, OUT + BACK), -1, np.int32)
        rank = np.arange(n) - self.first[self.group]
        for k in range(ROOTS):  # the roots of a group know each other
            other = self.first[self.group] + k
            at = np.flatnonzero((rank < ROOTS) & (rank != k) & (k < size[self.group]))
            self.adj[at, k] = other[at]
        stage = ROOTS
        while len(size) and stage < size.max():
            new = np.flatnonzero((rank >= stage) & (rank < 2 * stage))
            ids, dist = self.search(new, beam, inserted=stage)
            self.adj[new, :OUT] = ids[:, :OUT]
            self._link_back(new, ids[:, :OUT], dist[:, :OUT])
            stage *= 2

    def _link_back(self, new: np.ndarray, to: np.ndarray, dist: np.ndarray) -> None:
        """Each target keeps the BACK nearest of what pointed to it and the newcomers."""
        ok = to >= 0
        target, source = to[ok].astype(np.int64), np.repeat(new, ok.sum(1))
        touched, back = np.unique(target, return_inverse=True)
        old = self.adj[touched, OUT:]
        held = old >= 0
        t = np.concatenate([np.repeat(np.arange(len(touched)), held.sum(1)), back])
        s = np.concatenate([old[held].astype(np.int64), source])
        d = distance(self.sig[touched[t]], self.sig[s])
        order = np.lexsort((s, d, t))
        t, s = t[order], s[order]
        place = np.arange(len(t)) - np.searchsorted(t, t)
        keep = place < BACK
        fresh = np.full(old.shape, -1, np.int32)
        fresh[t[keep], place[keep]] = s[keep]
        self.adj[touched, OUT:] = fresh

    def search(self, query: np.ndarray, beam: int, inserted: int | None = None, step: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
        """(points, distances) of the beam for each query point, nearest first, -1 where there is none.
        With `inserted`, only that many points of a group are in the graph yet."""
        ids = np.full((len(query), beam), -1, np.int64)
        dist = np.full((len(query), beam), 1 << 20, np.int64)
        for a in range(0, len(query), step):
            ids[a : a + step], dist[a : a + step] = self._search(query[a : a + step], beam, inserted)
        return ids, dist

    def _search(self, query: np.ndarray, beam: int, inserted: int | None) -> tuple[np.ndarray, np.ndarray]:
        # a beam entry: distance << 41 | point << 1 | not opened yet
        group = self.group[query]
        there = np.minimum(self.size[group], inserted or 1 << 40)
        state = np.full((len(query), beam), _FAR, np.uint64)
        roots = np.arange(min(ROOTS, beam))
        start = self.first[group][:, None] + roots
        valid = (roots < there[:, None]) & (start != query[:, None])
        met = self._entries(query, np.where(valid, start, 0))
        met = np.where(self.size[group][:, None] <= ROOTS, met ^ np.uint64(1), met)  # all of a small group: nothing to open
        state[:, : len(roots)] = np.where(valid, met, _FAR)
        state.sort(1)
        active = np.arange(len(query))
        while len(active):
            now = state[active]
            open_ = (now & np.uint64(1) == 1) & (now != _FAR)
            some = open_.any(1)
            active, now, open_ = active[some], now[some], open_[some]
            if not len(active):
                break
            at = open_.argmax(1)
            row = np.arange(len(active))
            point = (now[row, at] >> np.uint64(1)) & np.uint64((1 << 40) - 1)
            now[row, at] ^= np.uint64(1)
            near = self.adj[point.astype(np.int64)]
            valid = (near >= 0) & (near != query[active][:, None])
            new = np.where(valid, self._entries(query[active], np.where(valid, near, 0)), _FAR)
            both = np.concatenate([now, new], 1)
            both.sort(1)
            same = (both[:, 1:] >> np.uint64(1)) == (both[:, :-1] >> np.uint64(1))
            both[:, 1:][same] = _FAR
            both.sort(1)
            state[active] = both[:, :beam]
        none = state == _FAR
        ids = np.where(none, -1, ((state >> np.uint64(1)) & np.uint64((1 << 40) - 1)).astype(np.int64))
        return ids, np.where(none, 1 << 20, (state >> np.uint64(41)).astype(np.int64))

    def _entries(self, query: np.ndarray, points: np.ndarray) -> np.ndarray:
        d = distance(self.sig[query][:, None, :], self.sig[points])
        return d.astype(np.uint64) << np.uint64(41) | points.astype(np.uint64) << np.uint64(1) | np.uint64(1)

    def exact_counts(self, g: int, query: np.ndarray, radius: int) -> np.ndarray:
        """How many other points of group g are within the radius of each of these points of it."""
        a, b = int(self.first[g]), int(self.first[g] + self.size[g])
        step = max(1, PAIRS // max(1, b - a))
        return np.concatenate([(pairwise(self.sig[query[k : k + step]], self.sig[a:b]) <= radius).sum(1) - 1 for k in range(0, len(query), step)])


LEAST, SMALL, PAIRS = 8, 32, 2_000_000


def pairwise(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(len(a), len(b)) Hamming distances."""
    out = np.zeros((len(a), len(b)), np.uint16)
    for k in range(a.shape[1]):
        out += np.bitwise_count(a[:, k, None] ^ b[None, :, k])
    return out


class Meeting:
    """Where a pair of points counts: in the group of the first key they share, and of a key split by salts in the
    group of both their salts. marks: (n, keys) the keys of a point; place: which of them its group is of."""

    def __init__(self, marks: np.ndarray, place: np.ndarray, salt: np.ndarray, size: np.ndarray):
        first = np.cumsum(size) - size
        self.marks, self.place, self.salt = marks, place, salt
        low, high = (f.reduceat(salt, first) if len(size) else salt for f in (np.minimum, np.maximum))
        self.across = np.repeat(low != high, size)

    @classmethod
    def anywhere(cls, size: np.ndarray) -> Meeting:
        n = int(size.sum())
        return cls(np.zeros((n, 1), np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), size)

    def here(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of pairs of one group, given as arrays that broadcast."""
        ok = ~self.across[a] | (self.salt[a] != self.salt[b])
        for k in range(int(self.place[a].max(initial=0))):
            ok = ok & ((self.marks[a, k] != self.marks[b, k]) | (k >= self.place[a]))
        return ok


class Links:
    """Of n points: how many links each has, and edges that connect what the links connect. A link is told once.
    Points take the least label they are linked to, each time an edge; links between labels that still
    differ then are edges, too. So a family of n points has about n edges, whatever its links."""

    def __init__(self, n: int):
        self.counts, self.label = np.zeros(n, np.int64), np.arange(n)
        self.edges: list[np.ndarray] = []

    def _edge(self, a: np.ndarray, b: np.ndarray) -> None:
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        apart = lo != hi
        if apart.any():
            self.edges.append(np.unique(lo[apart] * len(self.label) + hi[apart]))

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Links as lists."""
        self.counts += np.bincount(a, minlength=len(self.counts)) + np.bincount(b, minlength=len(self.counts))
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        least = self.label.copy()
        np.minimum.at(least, hi, self.label[lo])
        moved = np.flatnonzero(least != self.label)
        self._edge(moved, least[moved])
        self.label = least
        self._edge(least[lo], least[hi])

    def add_block(self, rows: np.ndarray, first: int, mask: np.ndarray) -> None:
        """Links of some points with the points from `first` on, as a matrix."""
        cols = np.arange(first, first + mask.shape[1])
        self.counts[rows] += mask.sum(1)
        self.counts[cols] += mask.sum(0)
        none = np.int64(len(self.label))
        for points, axis in ((rows, 1), (cols, 0)):
            other = self.label[cols][None, :] if axis else self.label[rows][:, None]
            least = np.minimum(self.label[points], np.where(mask, other, none).min(axis, initial=none))
            self._edge(points, np.where(least < self.label[points], least, points))
            self.label[points] = least
        i, j = np.nonzero(mask & (self.label[rows][:, None] != self.label[cols][None, :]))
        self._edge(self.label[rows[i]], self.label[cols[j]])

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        code = np.unique(np.concatenate(self.edges)) if self.edges else np.zeros(0, np.int64)
        return code // len(self.label), code % len(self.label)


def linked(sig: np.ndarray, size: np.ndarray, radius: int, meeting: Meeting | None = None, beam: int = 16, widest: int = 256, target: float = 0.995) -> Links:
    """The links within the radius between points of a group, the groups lying one after the other.

    Groups of up to `SMALL` points are compared whole. In the others every point is a query to the graph.
    Some points of each group are audited with exact search; while a group finds less than `target` of that,
    its points get twice the beam. A point whose beam is full of points within the radius may have more of
    them: it is compared with its whole group, as is what the `widest` beam leaves below the target."""
    out = Links(len(sig))
    meeting = meeting or Meeting.anywhere(size)
    first = np.cumsum(size) - size
    group = np.repeat(np.arange(len(size)), size)
    _small(sig, size, first, group, radius, meeting, out)
    large = np.flatnonzero(size > SMALL)
    if not len(large):
        return out
    at = np.flatnonzero((size > SMALL)[group])  # place of the world's points among all
    world = SmallWorld(sig[at], size[large], max(beam, 2 * OUT))
    n = len(at)
    rank = np.arange(n) - world.first[world.group]
    asked = np.flatnonzero(rank % np.maximum(1, world.size // LEAST)[world.group] == 0)  # groups are shuffled
    truth = np.full(n, -1, np.int64)
    for g, q in _by_group(world.group, asked):
        truth[q] = world.exact_counts(g, q, radius)
    whole = np.zeros(n, bool)
    met: list[np.ndarray] = []
    todo = np.arange(n)
    while len(todo) and beam <= widest:
        ids, dist = world.search(todo, beam)
        near = (dist <= radius).sum(1)
        of = world.group[todo]
        full = (near == beam) & (beam < world.size[of] - 1)
        whole[todo[full]] = True
        told = np.flatnonzero((truth[todo] >= 0) & ~full)
        hit, there = (np.bincount(of[told], x, len(large)) for x in (near[told], truth[todo[told]]))
        again = (hit < target * there)[of] & ~full
        ok = (dist <= radius) & ~again[:, None] & ~full[:, None]
        a, b = np.repeat(todo, ok.sum(1)), ids[ok]
        met.append(np.minimum(a, b) * n + np.maximum(a, b))
        todo = todo[again]
        beam *= 2
    whole[todo] = True
    code = np.unique(np.concatenate(met)) if met else np.zeros(0, np.int64)
    a, b = code // n, code % n
    keep = ~(whole[a] | whole[b])  # those meet below
    a, b = at[a[keep]], at[b[keep]]
    keep = meeting.here(a, b)
    out.add(a[keep], b[keep])
    for g, q in _by_group(world.group, np.flatnonzero(whole)):
        lo, hi = int(world.first[g]), int(world.first[g] + world.size[g])
        step = max(1, PAIRS // (hi - lo))
        for k in range(0, len(q), step):
            rows = q[k : k + step]
            mask = pairwise(world.sig[rows], world.sig[lo:hi]) <= radius
            mask &= ~whole[lo:hi] | (np.arange(lo, hi) > rows[:, None])
            mask &= meeting.here(at[rows][:, None], at[lo:hi][None, :])
            out.add_block(at[rows], int(at[lo]), mask)
    return out


def _small(sig: np.ndarray, size: np.ndarray, first: np.ndarray, group: np.ndarray, radius: int, meeting: Meeting, out: Links) -> None:
    """All pairs within the groups of up to SMALL points, a bounded number at a time."""
    left = np.where((size <= SMALL)[group], (first + size)[group] - np.arange(len(sig)) - 1, 0)
    upto = np.cumsum(left)
    start = 0
    while start < len(sig):
        end = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + PAIRS, "right")))
        n = left[start:end]
        a = np.repeat(np.arange(start, end), n)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        near = distance(sig[a], sig[b]) <= radius
        a, b = a[near], b[near]
        keep = meeting.here(a, b)
        out.add(a[keep], b[keep])
        start = end


def _by_group(group: np.ndarray, points: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(group, its points) of ascending points."""
    own = group[points]
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
    return list(zip(own[first].tolist(), np.split(points, first[1:]), strict=True)) if len(own) else []


def shuffled_order(keys: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Order that groups equal keys and shuffles within them, the same in every run."""
    return np.lexsort((mixed(nodes.astype(np.uint64)), keys))
