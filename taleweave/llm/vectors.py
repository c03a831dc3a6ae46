"""Vectors on their way between tasks, and an index of posting lists over them."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SCALE = 10_000


def usable(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that hold ``dims`` finite numbers, not all zero: (their places, their vectors as float32)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros(0, np.int64), np.zeros((0, dims), np.float32)
    offsets = column.offsets.to_numpy()
    right = (np.diff(offsets) == dims) & ~np.asarray(column.is_null())
    rows = np.flatnonzero(right)
    if not len(rows):
        return rows, np.zeros((0, dims), np.float32)
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float32, copy=False)  # nulls become NaN
    at = offsets[rows]
    x = values[at[0] : at[0] + dims * len(rows)].reshape(-1, dims) if at[-1] - at[0] == dims * (len(rows) - 1) else values[at[:, None] + np.arange(dims)]
    good = np.isfinite(x).all(axis=1) & x.any(axis=1)
    return rows[good], x[good]


def pack(x: np.ndarray) -> pa.Array:
    """float32 rows as binary, losslessly: rows of numbers with four decimals as 16-bit whole numbers
    (half the bytes in every exchange), all others as they are."""
    n, d = x.shape
    if n == 0:
        return pa.array([], pa.binary())
    whole = np.rint(x.astype(np.float64) * SCALE)
    short = (np.abs(whole) <= 32767).all(axis=1) & ((whole / SCALE).astype(np.float32) == x).all(axis=1)
    sizes = np.where(short, 2 * d, 4 * d)
    offsets = np.zeros(n + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    if short.all():
        data = whole.astype("<i2").tobytes()
    elif not short.any():
        data = np.ascontiguousarray(x, "<f4").tobytes()
    else:
        data = b"".join(whole[i].astype("<i2").tobytes() if short[i] else x[i].astype("<f4").tobytes() for i in range(n))
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])


def unpack(column: pa.Array, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.binary())
    n = len(column)
    out = np.empty((n, dims), np.float32)
    if n == 0:
        return out
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)
    short = np.diff(offsets) == 2 * dims
    for flag, kind, width in ((True, "<i2", 2 * dims), (False, "<f4", 4 * dims)):
        rows = np.flatnonzero(short == flag)
        if len(rows):
            if len(rows) == n:
                raw = data[offsets[0] : offsets[n]]
            else:
                raw = data[offsets[rows][:, None] + np.arange(width)].ravel()
            part = np.frombuffer(raw.tobytes(), kind).reshape(len(rows), dims)
            out[rows] = (part / SCALE).astype(np.float32) if flag else part
    return out


def unit(x: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    return (x / np.where(norms > 0, norms, 1)).astype(np.float32)


def two_means(x: np.ndarray, rng: np.random.Generator, rounds: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Split unit vectors by their direction: (the side of each, the two unit centres)."""
    c = np.stack([x[rng.integers(len(x))], x[0]])
    c[1] = x[np.argmin(x @ c[0])]
    side = np.zeros(len(x), bool)
    for _ in range(rounds):
        new = x @ (c[1] - c[0]) > 0
        k = int(new.sum())
        if k in (0, len(x)) or (new == side).all():
            break
        side = new
        one = x[side].sum(axis=0)
        c = unit(np.stack([x.sum(axis=0) - one, one]))
    return side, c


@dataclass
class Lists:
    """Centroids of posting lists, a graph that links each to its nearest others, and coarse groups of them where a
    search begins."""

    centroids: np.ndarray
    graph: np.ndarray
    #: Centres of the coarse groups and the centroids in each; none if all centroids are compared at once.
    coarse: np.ndarray
    groups: list[np.ndarray]
    #: Share of the sample that is nearest to each centroid.
    share: np.ndarray

    #: Centroids up to which all are compared; links per centroid; share of the coarse groups that a search begins in;
    #: centroids that a search keeps in hand; steps of a search at most, and steps without gain that end it.
    PIVOTS = 1024
    LINKS = 16
    BEGIN = 0.12
    BEAM = 16
    STEPS, IDLE = 48, 3

    @classmethod
    def fit(cls, sample: np.ndarray, limit: int, most: int, seed: int = 7) -> Lists:
        """Balanced lists: the sample is split in two again and again until no list has more than
        ``limit`` of it, the largest first, up to ``most`` lists."""
        rng = np.random.default_rng(seed)
        parts = _halved(unit(sample), limit, most, rng) if len(sample) else []
        dims = sample.shape[1]
        if not parts:
            return cls(np.zeros((0, dims), np.float32), np.zeros((0, 0), np.int64), np.zeros((0, dims), np.float32), [], np.zeros(0))
        x = unit(sample)
        c = unit(np.stack([x[p].mean(axis=0) for p in parts]))
        for _ in range(4 if len(c) <= cls.PIVOTS else 1):  # Lloyd rounds over all lists mend the borders that halving drew
            own = cls._over(c, rng)._nearest(x)
            sums = np.zeros_like(c)
            np.add.at(sums, own, x)
            c = unit(np.where(np.bincount(own, minlength=len(c))[:, None] > 0, sums, c))
        index = cls._over(c, rng)
        index.share = np.bincount(index._nearest(x), minlength=len(c)) / len(x)
        return index

    @classmethod
    def _over(cls, c: np.ndarray, rng: np.random.Generator) -> Lists:
        links = min(cls.LINKS, len(c) - 1)
        graph = np.zeros((len(c), links), np.int64)
        groups: list[np.ndarray] = []
        if len(c) > cls.PIVOTS:
            for a in range(0, len(c), 1024):
                s = c[a : a + 1024] @ c.T
                s[np.arange(len(s)), a + np.arange(len(s))] = -2
                graph[a : a + 1024] = np.argpartition(-s, links - 1, axis=1)[:, :links]
            groups = _halved(c, max(8, int(len(c) ** 0.5)), len(c), rng)
        coarse = unit(np.stack([c[g].mean(axis=0) for g in groups])) if groups else np.zeros((0, c.shape[1]), np.float32)
        return cls(c, graph, coarse, groups, np.zeros(len(c)))

    def _nearest(self, x: np.ndarray) -> np.ndarray:
        step = self._step()
        return np.concatenate([self.search(x[a : a + step], 1)[0][:, 0] for a in range(0, len(x), step)])

    def _step(self) -> int:
        """Vectors that are searched for at once: their cosines to all centroids are held."""
        return max(128, min(1024, 8_000_000 // max(len(self.centroids), 1)))

    def search(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` nearest centroids of each unit vector, nearest first: (places, cosines). Few centroids are
        all compared. Of many, those of the nearest coarse groups are; from the best of them the search walks
        the graph, best first, until IDLE steps have brought none of the ``k`` best."""
        n, m = len(x), len(self.centroids)
        k = min(k, m)
        if not self.groups:
            score = x @ self.centroids.T
        else:
            score = np.full((n, m), -2, np.float32)
            near = max(2, int(np.ceil(self.BEGIN * len(self.groups))))
            s = x @ self.coarse.T
            first = np.argpartition(-s, near - 1, axis=1)[:, :near] if near < len(self.groups) else np.tile(np.arange(len(self.groups)), (n, 1))
            for g in range(len(self.groups)):
                rows = np.flatnonzero((first == g).any(axis=1))
                if len(rows):
                    at = self.groups[g]
                    score[rows[:, None], at] = x[rows] @ self.centroids[at].T
            # The best so far of each vector, and which of them have been walked from.
            width = min(max(self.BEAM, k), m)
            place = np.argpartition(-score, width - 1, axis=1)[:, :width] if width < m else np.tile(np.arange(m), (n, 1))
            value, seen = np.take_along_axis(score, place, 1), score > -2
            done = value == -2
            rows, idle = np.arange(n), np.zeros(n, np.int64)
            for _ in range(self.STEPS):
                own = np.arange(len(rows))
                best = np.where(done[rows], -3, value[rows]).argmax(axis=1)
                done[rows, best] = True
                links = self.graph[place[rows, best]]
                r, j = np.nonzero(~seen[rows[:, None], links])
                at = links[r, j]
                more = np.full(links.shape, -2, np.float32)
                more[r, j] = np.einsum("ij,ij->i", x[rows[r]], self.centroids[at])
                seen[rows[r], at] = True
                kth = np.partition(value[rows], width - k, axis=1)[:, width - k]
                idle[rows] = np.where(more.max(axis=1) > kth, 0, idle[rows] + 1)
                both = np.concatenate([value[rows], more], axis=1)
                keep = np.argpartition(-both, width - 1, axis=1)[:, :width]
                value[rows] = both[own[:, None], keep]
                place[rows] = np.concatenate([place[rows], links], axis=1)[own[:, None], keep]
                done[rows] = np.concatenate([done[rows], more == -2], axis=1)[own[:, None], keep]
                rows = rows[idle[rows] < self.IDLE]
                if not len(rows):
                    break
            order = np.argsort(-value, axis=1, kind="stable")[:, :k]
            return np.take_along_axis(place, order, 1), np.take_along_axis(value, order, 1)
        top = np.argpartition(-score, k - 1, axis=1)[:, :k] if k < m else np.tile(np.arange(m), (n, 1))
        s = np.take_along_axis(score, top, 1)
        order = np.argsort(-s, axis=1, kind="stable")
        return np.take_along_axis(top, order, 1), np.take_along_axis(s, order, 1)

    def lists_of(self, x: np.ndarray, most: int, ratio: float) -> tuple[np.ndarray, np.ndarray]:
        """(place of the vector, list): the nearest list and, for vectors near a border, up to ``most``
        lists whose centroid is at most ``1 + ratio`` times as far as the nearest."""
        rows, lists = [], []
        step = self._step()
        for a in range(0, len(x), step):
            top, s = self.search(x[a : a + step], most)
            far = np.sqrt(np.maximum(2 - 2 * s, 0))
            keep = far <= (1 + ratio) * far[:, :1] + 1e-6
            r, j = np.nonzero(keep)
            rows.append(a + r)
            lists.append(top[r, j])
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(rows), np.concatenate(lists)


def _halved(x: np.ndarray, limit: int, most: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Places of unit vectors in parts of at most ``limit``, by splitting the largest in two; copies of one vector
    stay together, and there are at most ``most`` parts."""
    todo, out, k = [(-len(x), 0, np.arange(len(x)))], [], 1
    while todo and len(todo) + len(out) < most and -todo[0][0] > limit:
        _, _, at = heapq.heappop(todo)
        side, _ = two_means(x[at], rng)
        if side.all() or not side.any():
            out.append(at)
            continue
        for part in (at[side], at[~side]):
            heapq.heappush(todo, (-len(part), k, part))
            k += 1
    return out + [at for _, _, at in todo]
