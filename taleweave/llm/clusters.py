"""Clusters of mutually similar records by bisecting k-means across the cluster.

1. Top of the tree: in every round all nodes of more than ``LOCAL_ROWS`` vectors are split in two, the
   most dispersed first (at most ``MOST_NODES``). One pass over all vectors sums up both sides of every
   node and finds the member farthest from its centre, which starts a split where the sample has too few
   rows; only sums and these reach the driver. A node that cannot be split further (copies of one vector,
   or the tree is full) is cut into blocks by id, so a task's size is bounded whatever the data.
2. Each block then is one bounded task, which goes on splitting its most dispersed node until all leaves are
   compact: every member has at least the asked cosine to the leaf's medoid, so a leaf is joined by true
   similarities.
3. Similarities between leaves are checked exactly inside a block, between all members that the leaves'
   radii leave possible. Between blocks (above ``LOCAL_ROWS`` vectors) only medoids and loosely tied members
   that share a posting list are compared, so a link of closely tied members can be missed. With ``exact``
   every vector also visits each other block that the block's radius lets it have a similar member in; this
   misses nothing, but the visits grow with vectors times blocks where the data have no gaps.
4. Records without a vector are joined by the words they share with a record that has one: a prefix
   filter finds the groups a record may belong to, and the shared words are counted against the
   members of these.
5. Connected groups are the clusters.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window, functions as F

from taleweave.llm import neighbours
from taleweave.llm.vectors import Lists, pack, two_means, unit, unpack
from taleweave.operators.components import components, roots
from taleweave.plans.shared import cut, release, written

#: Vectors of a node that one task splits further, nodes split by passes over all vectors, sample for first centres.
LOCAL_ROWS, MOST_NODES, SAMPLE = 8_192, 4_096, 8_192
#: Sample rows that a split starts from at least; with fewer it starts from the farthest member. Tries to split a node.
SPLIT_ROWS, TRIES = 16, 3
#: Members with a lower cosine to their medoid take part in the check between nodes, as medoids do.
TIED = 0.8
#: Rows of a node that are split by their cosines alone.
SMALL = 64
#: Members of a group that are compared with records without vectors in one task, and such records at most; the pairs of
#: a record and a part that are compared at once.
BLOCK, ASKERS, PAIRS = 4_096, 4_096, 262_144
#: Word sets of records without vectors that are sent in one turn, or as many as there are members if these are more.
TURN_ROWS = 200_000
#: Sizes of word sets that count as one band; 64-bit numbers of a word set's signature.
BAND, SIGNS = 4, 4
#: Members that are compared pair by pair before the rest goes into a matrix product; words whose bits are held at once.
TRIED, VOCABULARY = 4, 8_192
#: Words in at least this share of the records without vectors come last in the order of the prefix filter.
COMMON = 0.002
#: Bits of the filter of asked words that all tasks hold; rows whose words a task takes at once.
FILTER_BITS, WORD_ROWS = 2**27, 1_024


class Tree:
    """Binary tree of centres; node 1 is the root, 2i and 2i+1 the sides of i."""

    def __init__(self) -> None:
        self.centres: dict[int, np.ndarray] = {}

    def holds(self, i: int) -> bool:
        """Whether rows can end in node ``i``."""
        return i not in self.centres and (i == 1 or i // 2 in self.centres)

    def route(self, x: np.ndarray) -> np.ndarray:
        node = np.ones(len(x), np.int64)
        todo = [1]
        while todo:
            i = todo.pop()
            if i not in self.centres:
                continue
            rows = np.flatnonzero(node == i)
            if len(rows):
                c = self.centres[i]
                node[rows] = 2 * i + (x[rows] @ (c[1] - c[0]) > 0)
            todo += [2 * i, 2 * i + 1]
        return node


def _sums(tree, dims: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple[int, np.ndarray, float, np.ndarray]] = {}
        for b in batches:
            x = unit(unpack(b.column("vec"), dims))
            node = tree.value.route(x)
            for i in np.unique(node):
                part = x[node == i]
                n, s, least, far = total.get(int(i), (0, 0.0, 2.0, None))
                s = s + part.sum(axis=0, dtype=np.float64)
                # Nearly the farthest: the centre is that of the rows so far.
                cos = part @ (s / max(np.linalg.norm(s), 1e-12)).astype(np.float32)
                m = int(cos.argmin())
                if cos[m] < least:
                    least, far = float(cos[m]), part[m].copy()
                total[int(i)] = n + len(part), s, least, far
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(list(total), pa.int64()),
                pa.array([t[0] for t in total.values()], pa.int64()),
                pa.array([t[1].tobytes() for t in total.values()], pa.binary()),
                pa.array([t[2] for t in total.values()], pa.float64()),
                pa.array([t[3].tobytes() for t in total.values()], pa.binary()),
            ],
            names=["node", "n", "total", "least", "far"],
        )

    return go


NODE = "node long, n long, total binary, least double, far binary"


def _add(table: pa.Table) -> pa.Table:
    s = sum(np.frombuffer(v, np.float64) for v in table.column("total").to_pylist())
    n = sum(table.column("n").to_pylist())
    least = table.column("least").to_numpy()
    m = int(least.argmin())
    return pa.table({"node": table.column("node")[:1], "n": [n], "total": pa.array([s.tobytes()], pa.binary()), "least": least[m : m + 1], "far": table.column("far")[m : m + 1]})


def grow(vectors: DataFrame, sample: np.ndarray, dims: int, local_rows: int = LOCAL_ROWS, seed: int = 11) -> tuple[Tree, dict[int, int]]:
    """The top of the tree, and the number of vectors in each of its nodes. The sample only starts a
    split's centres; one pass over all vectors then places them, and the counts of the next decide what
    is split further."""
    sc = vectors.sparkSession.sparkContext
    rng = np.random.default_rng(seed)
    tree, x = Tree(), unit(sample)
    tried: Counter[int] = Counter()
    while True:
        shared = sc.broadcast(tree)
        got = vectors.mapInArrow(_sums(shared, dims), NODE).groupBy("node").applyInArrow(_add, NODE).collect()  # at most MOST_NODES + 1 rows
        state = {r["node"]: (r["n"], np.frombuffer(r["total"], np.float64), np.frombuffer(r["far"], np.float32)) for r in got}
        for i in list(tree.centres):  # centres become those of all vectors
            sides = [state.get(2 * i), state.get(2 * i + 1)]
            if all(sides):
                tree.centres[i] = unit(np.stack([s[1] for s in sides]))
            elif any(sides) and 2 * i not in tree.centres and 2 * i + 1 not in tree.centres:  # all went to one side
                del tree.centres[i]
                tried[i] += 1
                state[i] = sides[0] or sides[1]
        # |sum| close to n: the node is dense; n - |sum|^2 / n is its dispersion.
        open_ = sorted(((n - s @ s / n, i) for i, (n, s, _) in state.items() if n > local_rows and tried[i] < TRIES), reverse=True)
        own = tree.route(x)
        fresh = 0
        for dispersion, i in open_[: max(0, MOST_NODES - len(tree.centres))]:
            part = x[own == i]
            side, c = two_means(part, rng, 12) if len(part) >= SPLIT_ROWS else (None, None)
            if side is None or side.all() or not side.any():
                n, s, far = state[i]
                if dispersion < 1e-5 * n:
                    tried[i] = TRIES
                    continue
                c = unit(np.stack([s - far, far]))
            tree.centres[i] = c
            fresh += 1
        if not fresh:
            return tree, {i: n for i, (n, _, _) in state.items() if tree.holds(i)}


def leaves_of(x: np.ndarray, least: float, rng: np.random.Generator) -> list[tuple[np.ndarray, int, np.ndarray]]:
    """Bisect until compact, the most dispersed node first: (members, the medoid's place, centre). Copies and
    single vectors are compact; a node that does not split (all on one side) is halved around its medoid."""
    out: list = []
    todo: list[tuple[float, int, np.ndarray, np.ndarray]] = []

    def look(at: np.ndarray) -> None:
        if len(at) <= SMALL:
            return small(at, x[at] @ x[at].T)
        part = x[at]
        total = part.sum(axis=0, dtype=np.float64)
        size = float(np.linalg.norm(total))
        centre = (total / max(size, 1e-12)).astype(np.float32)
        m = int((part @ centre).argmax())
        near = part @ part[m] >= least
        near[m] = True
        if near.all():
            out.append((at, int(at[m]), centre))
        else:
            heapq.heappush(todo, (size * size / len(at) - len(at), int(at[0]), at, near))

    def small(at: np.ndarray, cos: np.ndarray) -> None:
        """The same for few rows from their cosines alone: the sides gather around two rows far apart."""
        stack = [np.arange(len(at))]
        while stack:
            own = stack.pop()
            g = cos[own[:, None], own]
            m = int(g.sum(axis=0).argmax())
            near = g[m] >= least
            near[m] = True
            if near.all():
                centre = x[at[own]].sum(axis=0) if len(own) > 1 else x[at[own[0]]]
                out.append((at[own], int(at[own[m]]), centre / max(float(np.linalg.norm(centre)), 1e-12)))
                continue
            j = int(g[m].argmin())
            side = g[int(g[j].argmin())] > g[j]
            if side.all() or not side.any():
                side = near
            stack += [own[side], own[~side]]

    look(np.arange(len(x)))
    while todo:
        _, _, at, near = heapq.heappop(todo)
        side, _ = two_means(x[at], rng, 4)
        if side.all() or not side.any():
            side = near
        look(at[side])
        look(at[~side])
    return out


def _local(least: float, dims: int, seed: int):
    edge = float(np.arccos(np.clip(least, -1, 1)))

    def go(table: pa.Table) -> pa.Table:
        ids, first = neighbours.distinct_rows(table)
        raw = unpack(table.column("vec").combine_chunks().take(pa.array(first)), dims)
        x = unit(raw)
        n = len(ids)
        leaves = leaves_of(x, least, np.random.default_rng(seed))
        leaf = np.zeros(n, np.int64)
        typical = np.zeros(n)
        for k, (at, _, c) in enumerate(leaves):
            leaf[at] = k
            typical[at] = x[at] @ c
        centres = np.stack([c for _, _, c in leaves])
        # A member of another leaf can be similar only if it lies within the leaf's radius plus the asked angle.
        widest = np.ones(len(leaves))
        np.minimum.at(widest, leaf, typical)
        bound = np.cos(np.minimum(np.pi, np.arccos(np.clip(widest, -1, 1)) + edge + 1e-4))
        up = np.arange(len(leaves))
        for lo in range(0, n, 1024):
            r, k = np.nonzero(x[lo : lo + 1024] @ centres.T >= bound)
            r += lo
            open_ = up[leaf[r]] != up[k]
            r, k = r[open_], k[open_]
            order = np.lexsort((k, leaf[r]))
            r, k = r[order], k[order]
            cuts = np.flatnonzero(np.r_[True, (leaf[r][1:] != leaf[r][:-1]) | (k[1:] != k[:-1])]) if len(r) else []
            a, b = [], []
            for p, q in zip(cuts, [*cuts[1:], len(r)]):
                if (x[r[p:q]] @ x[leaves[int(k[p])][0]].T >= least).any():
                    a.append(leaf[r[p]])
                    b.append(k[p])
            if a:
                up = _merged(up, np.array(a), np.array(b))
        # A group is named by its smallest id; ids are in order, so that is its first row's.
        group = up[leaf]
        _, low = np.unique(group, return_index=True)
        name = np.zeros(len(leaves), np.int64)
        name[group[low]] = low
        sent = np.zeros(n, bool)  # what the check between nodes sees of a leaf
        for at, m, _ in leaves:
            sent[at[x[at] @ x[m] < TIED]] = True
            sent[m] = True
        vec = pack(raw[sent])
        where = np.cumsum(sent) - 1
        return pa.table(
            {
                "id": ids,
                "part": ids.take(pa.array(name[group])),
                "leaf": ids.take(pa.array(np.array([m for _, m, _ in leaves])[leaf])),
                "typical": pa.array(typical, pa.float64()),
                "vec": vec.take(pa.array(np.where(sent, where, 0), mask=~sent)),
            }
        )

    return go


def _merged(up: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return roots(len(up), up[a], up[b])[up]


def _joined(least: float, dims: int):
    """Links between parts in one list, as a forest: no part is named more often than needed."""

    def go(table: pa.Table) -> pa.Table:
        x = unit(unpack(table.column("vec"), dims))
        parts = table.column("part").combine_chunks().dictionary_encode()
        place = parts.indices.to_numpy()
        up = np.arange(len(parts.dictionary))
        for lo in range(0, len(x), 1024):
            i, j = np.nonzero(x[lo : lo + 1024] @ x[lo:].T >= least)
            a, b = place[lo + i], place[lo + j]
            open_ = up[a] != up[b]
            if open_.any():
                up = _merged(up, a[open_], b[open_])
        more = np.flatnonzero(up != np.arange(len(up)))
        return pa.table({"a": parts.dictionary.take(pa.array(more)), "b": parts.dictionary.take(pa.array(up[more]))})

    return go


def _reach(tree: Tree, blocks: dict[int, int], centres: dict[int, np.ndarray], radii: dict[int, float], edge: float, dims: int):
    """Vectors on a visit: to every block but their own in which a similar one may be."""
    nodes = np.array(sorted(centres), np.int64)
    c = np.stack([centres[int(i)] for i in nodes])
    bound = np.cos(np.minimum(np.pi, np.array([radii[int(i)] for i in nodes]) + edge + 1e-4))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = unit(unpack(b.column("vec"), dims))
            own, block = tree.route(x), _blocks(tree.route(x), b.column("id"), blocks)
            r, k = np.nonzero(x @ c.T >= bound)
            n = np.array([blocks.get(int(i), 1) for i in nodes])[k]
            r, k, j = np.repeat(r, n), np.repeat(k, n), np.concatenate([np.arange(m) for m in n]) if len(n) else np.zeros(0, np.int64)
            away = (nodes[k] != own[r]) | (j != block[r])
            r, k, j = r[away], k[away], j[away]
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes[k]), pa.array(j.astype(np.int32)), b.column("part").take(pa.array(r)), b.column("vec").take(pa.array(r)), pa.array(np.ones(len(r), bool))],
                names=["node", "block", "part", "vec", "visits"],
            )

    return go


def _blocks(node: np.ndarray, ids: pa.Array, blocks: dict[int, int]) -> np.ndarray:
    """The block of each row in its node, by a hash of its id."""
    block = np.zeros(len(node), np.int32)
    for i in np.flatnonzero(np.isin(node, list(blocks))) if blocks else ():
        block[i] = zlib.crc32(ids[i].as_py().encode()) % blocks[int(node[i])]
    return block


def _visited(least: float, dims: int):
    """Links between the parts of a block's own vectors and those of its visitors."""

    def go(table: pa.Table) -> pa.Table:
        x = unit(unpack(table.column("vec"), dims))
        parts = table.column("part").combine_chunks().dictionary_encode()
        place, visits = parts.indices.to_numpy(), table.column("visits").to_numpy()
        own, up = np.flatnonzero(~visits), np.arange(len(parts.dictionary))
        for lo in range(0, len(x), 1024):
            some = np.arange(lo, min(lo + 1024, len(x)))
            some = some[visits[some]]
            i, j = np.nonzero(x[some] @ x[own].T >= least)
            a, b = place[some[i]], place[own[j]]
            open_ = up[a] != up[b]
            if open_.any():
                up = _merged(up, a[open_], b[open_])
        more = np.flatnonzero(up != np.arange(len(up)))
        return pa.table({"a": parts.dictionary.take(pa.array(more)), "b": parts.dictionary.take(pa.array(up[more]))})

    return go


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, WORD_ROWS):
            yield b.slice(lo, WORD_ROWS)


def word_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, part and composite_text to id, part and the text's distinct words (runs of letters and digits, case
    ignored) as 64-bit hashes; texts without words are left out."""
    for b in _pieces(batches):
        words = pc.split_pattern_regex(pc.utf8_lower(b.column("composite_text")), r"[^\pL\pN]+")
        row = np.repeat(np.arange(b.num_rows), np.diff(words.offsets.to_numpy()))
        coded = words.flatten().dictionary_encode()
        names = np.array(coded.dictionary.to_pylist(), object)
        hashes = pd.util.hash_array(names, categorize=False).view(np.int64) if len(names) else np.zeros(0, np.int64)
        code = coded.indices.to_numpy().astype(np.int64)
        keep = (names != "")[code] if len(names) else np.zeros(0, bool)
        both = np.unique(row[keep] * len(names) + code[keep])
        rows, size = np.unique(both // max(len(names), 1), return_counts=True)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(hashes[both % max(len(names), 1)]))
        take = pa.array(rows)
        yield pa.RecordBatch.from_arrays([b.column("id").take(take), b.column("part").take(take), lists], names=["id", "part", "words"])


SIGNATURE = [f"sign{i}" for i in range(SIGNS)]


def _first_words(shared, share: float, asks: bool):
    """Each word set's first words in the common order, as far as any partner could need them: key, word, its
    position (from 1), the set's size, the band of sizes (``BAND`` wide) of the word set that holds it, and the set's
    signature: a bit for each value that its words' hashes leave modulo 64 ``SIGNS``.
    A set that ``asks`` names them for each band that a partner may be in, no more than that band needs: two
    sets of about one size must agree on one of few, rare words, and only unlike sizes need further ones."""
    common, counts, wanted = shared.value

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches):
            column = b.column("words")
            size = np.diff(column.offsets.to_numpy())
            words = column.flatten().to_numpy()
            row = np.repeat(np.arange(len(size)), size)
            flags = np.zeros((len(size), 64 * SIGNS), bool)
            flags[row, words & (64 * SIGNS - 1)] = True
            signs = np.packbits(flags, axis=1).view(np.int64)
            rank = np.zeros(len(words), np.int64)
            if len(common):
                at = np.minimum(np.searchsorted(common, words), len(common) - 1)
                rank = np.where(common[at] == words, counts[at], 0)
            order = np.lexsort((words, rank, row))
            words, pos = words[order], np.arange(len(words)) - np.repeat(np.cumsum(size) - size, size) + 1
            n = size[row]
            keep = np.flatnonzero(pos <= n - np.ceil(share * n - 1e-9).astype(np.int64) + 1)
            if wanted is not None:
                low = words[keep] & (FILTER_BITS - 1)
                keep = keep[(wanted[low >> 3] >> (low & 7) & 1) > 0]
            band = n[keep] // BAND
            if asks:
                low, high = np.ceil(share * n[keep] - 1e-9).astype(np.int64), np.floor(n[keep] / share + 1e-9).astype(np.int64)
                many = high // BAND - low // BAND + 1
                step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                keep, low = np.repeat(keep, many), np.repeat(low, many)
                band = low // BAND + step
                least = np.ceil(share / (1 + share) * (n[keep] + np.maximum(low, band * BAND)) - 1e-9).astype(np.int64)
                early = pos[keep] <= n[keep] - least + 1
                keep, band = keep[early], band[early]
            at = row[keep]
            yield pa.RecordBatch.from_arrays(
                [pa.array(b.column("key").to_numpy()[at]), pa.array(words[keep]), pa.array(pos[keep].astype(np.int32)), pa.array(n[keep].astype(np.int32)), pa.array(band.astype(np.int32)), *(pa.array(c[at]) for c in signs.T)],
                names=["key", "word", "pos", "size", "band", *SIGNATURE],
            )

    return go


def _bits(words: DataFrame) -> np.ndarray:
    """A bit for each value that ``word`` leaves modulo ``FILTER_BITS``, eight to a byte, the lowest first."""
    got = words.groupBy(F.expr(f"cast((word & {FILTER_BITS - 1}) >> 5 AS int)").alias("at")).agg(F.expr("bit_or(shiftleft(1, cast(word & 31 AS int)))").alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS // 32, "<i4")
    bits[got.column("at").to_numpy()] = got.column("bits").to_numpy()
    return bits.view(np.uint8)


def _shared_words(share: float):
    def go(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        """left: records without a vector and the parts each may belong to; right: members of parts."""
        some = [t.column("words").combine_chunks() for t in (left, right)]
        sizes = [np.diff(w.offsets.to_numpy()) for w in some]
        _, word = np.unique(np.concatenate([w.flatten().to_numpy() for w in some]), return_inverse=True)
        starts = [np.r_[0, np.cumsum(sizes[0])], len(some[0].flatten()) + np.r_[0, np.cumsum(sizes[1])]]
        asked = left.column("parts").combine_chunks()
        both = pa.concat_arrays([right.column("part").combine_chunks(), asked.flatten()]).dictionary_encode().indices.to_numpy()
        of, wanted = both[: right.num_rows], both[right.num_rows :]
        members = np.argsort(of, kind="stable")
        bounds = np.searchsorted(of[members], np.arange(both.max(initial=-1) + 2))
        asker = np.repeat(np.arange(left.num_rows), np.diff(asked.offsets.to_numpy()))
        # The first members decide most, pair by pair; what they leave open in larger parts goes part by part.
        n = (bounds[1:] - bounds[:-1])[wanted]
        hit = np.zeros(len(wanted), bool)
        for lo in range(0, len(wanted), PAIRS):
            many = np.minimum(n[lo : lo + PAIRS], TRIED)
            pair = np.repeat(np.arange(lo, lo + len(many)), many)
            first = members[bounds[wanted[pair]] + np.arange(len(pair)) - np.repeat(np.cumsum(many) - many, many)]
            both = _in_both(word, (starts[0], sizes[0]), asker[pair], (starts[1], sizes[1]), first)
            either = sizes[0][asker[pair]] + sizes[1][first] - both
            hit[pair[both >= share * either - 1e-6]] = True
        open_ = np.flatnonzero(~hit & (n > TRIED))
        open_ = open_[np.argsort(wanted[open_], kind="stable")]
        for lo, hi in zip(*_cuts(wanted[open_])):
            some = open_[lo:hi]
            its = members[bounds[wanted[some[0]]] + TRIED : bounds[wanted[some[0]] + 1]]
            hit[some] = _any_shared(word, (starts[0], sizes[0]), asker[some], (starts[1], sizes[1]), its, share)
        a, b = asker[hit], members[bounds[wanted[hit]]]
        return pa.table({"a": left.column("id").take(pa.array(a)), "b": right.column("part").take(pa.array(b))})

    return go


def _in_both(words: np.ndarray, left: tuple, rows: np.ndarray, right: tuple, others: np.ndarray) -> np.ndarray:
    """How many words the sets of each pair of places have in common, by bits, ``VOCABULARY`` words at a time."""
    met = np.zeros(words.max(initial=-1) + 1, bool)
    split = left[0][-1]
    met[words[split:]] = True
    both = np.zeros(len(met), bool)
    both[words[:split]] = True
    at = np.cumsum(both & met) - 1  # place among the words that are on both sides
    total = np.zeros(len(rows), np.int64)
    for lo in range(0, int(at[-1]) + 1 if len(at) else 0, VOCABULARY):
        bits = []
        for (start, size), part in ((left, words[:split]), (right, words[split:])):
            row = np.repeat(np.arange(len(size)), size)
            in_ = both[part] & met[part] & (at[part] >= lo) & (at[part] < lo + VOCABULARY)
            width = -(-min(VOCABULARY, int(at[-1]) + 1 - lo) // 64) * 64
            flags = np.zeros((len(size), width), bool)
            flags[row[in_], at[part][in_] - lo] = True
            bits.append(np.packbits(flags, axis=1).view(np.uint64))
        for k in range(0, len(rows), 8192):
            total[k : k + 8192] += np.bitwise_count(bits[0][rows[k : k + 8192]] & bits[1][others[k : k + 8192]]).sum(axis=1, dtype=np.int64)
    return total


def _cuts(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin and end."""
    first = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]]) if len(sorted_) else np.zeros(0, np.int64)
    return first, np.r_[first[1:], len(sorted_)] if len(first) else first


def _matrix(words: np.ndarray, sets: tuple[np.ndarray, np.ndarray], rows: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Word sets as rows of zeros and ones over ``known`` words (or their own), and these words."""
    start, size = sets[0][rows], sets[1][rows]
    row = np.repeat(np.arange(len(rows)), size)
    own = words[np.arange(len(row)) + np.repeat(start - (np.cumsum(size) - size), size)]
    known = np.unique(own) if known is None else known
    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
    in_ = known[at] == own
    x = np.zeros((len(rows), len(known)), np.float32)
    x[row[in_], at[in_]] = 1
    return x, known


def _any_shared(words: np.ndarray, left: tuple, rows: np.ndarray, right: tuple, members: np.ndarray, share: float) -> np.ndarray:
    """For each of ``rows`` whether any of ``members`` shares enough, by matrix products."""
    hit = np.zeros(len(rows), bool)
    for lo in range(0, len(rows), 256):
        some = rows[lo : lo + 256]
        open_ = np.ones(len(some), bool)
        for ro in range(0, len(members), 512):
            left_ = np.flatnonzero(open_)
            if not len(left_):
                break
            y, known = _matrix(words, right, members[ro : ro + 512])
            x, _ = _matrix(words, left, some[left_], known)
            both = x @ y.T
            either = left[1][some[left_]][:, None] + right[1][members[ro : ro + 512]][None, :] - both
            open_[left_[(both >= share * either - 1e-6).any(axis=1)]] = False
        hit[lo : lo + 256] = ~open_
    return hit


def text_links(lacking: DataFrame, members: DataFrame, share: float, turn_rows: int | None = None) -> DataFrame:
    """Links (a: record without a vector, b: part) where the record shares at least ``share`` of all
    distinct words with a member of the part. ``lacking``: id, words. ``members``: id, part, words."""
    counted = lacking.select(F.explode("words").alias("word")).groupBy("word").count()
    floor = max(2, int(COMMON * lacking.count()))
    # At most words-per-record / COMMON rows: the common words.
    ranked = counted.where(F.col("count") >= floor).toArrow().sort_by("word")
    order = ranked.column("word").to_numpy(), ranked.column("count").to_numpy()
    sc = lacking.sparkSession.sparkContext
    # Ids and parts are met by their hashes; should two agree, a comparison too many is made below.
    entry = "key long, word long, pos int, size int, band int" + "".join(f", {c} long" for c in SIGNATURE)
    asking = lacking.select(F.xxhash64("id").alias("key"), "words")
    left = cut(asking.distinct().mapInArrow(_first_words(sc.broadcast((*order, None)), share, True), entry), "prefixes")
    right = members.select(F.xxhash64("part").alias("key"), "words").mapInArrow(_first_words(sc.broadcast((*order, _bits(left))), share, False), entry)
    right = right.groupBy("key", "word", "size", "band", *SIGNATURE).agg(F.min("pos").alias("pos"))
    x, y = left.alias("x"), right.alias("y")
    # The words two sets must share, by their sizes; the first of them comes early enough in both.
    least = F.ceil(F.lit(share / (1 + share)) * (F.col("x.size") + F.col("y.size")) - 1e-9)
    early = (F.col("x.pos") <= F.col("x.size") - least + 1) & (F.col("y.pos") <= F.col("y.size") - least + 1)
    enough = F.least(F.col("x.size"), F.col("y.size")) >= least
    # Each bit in which the signatures differ is a word, and another one, that is in one set only. Most that share but
    # frequent words end here; without that the pairs grow with the square of the input.
    unlike = sum(F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}"))) for c in SIGNATURE)
    near = unlike <= (F.col("x.size") + F.col("y.size")) * F.lit((1 - share) / (1 + share)) + 1e-6
    on = (F.col("x.word") == F.col("y.word")) & (F.col("x.band") == F.col("y.band")) & near & early & enough
    pairs = cut(x.join(y, on).select(F.col("x.key").alias("id_h"), F.col("y.key").alias("part_h")).distinct(), "pairs")
    members = members.withColumn("part_h", F.xxhash64("part"))
    sizes = members.join(pairs.select("part_h").distinct(), "part_h", "left_semi").groupBy("part", "part_h").count()
    blocks = cut(sizes.select("part", "part_h", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"), "count"), "sizes")
    total = int(blocks.agg(F.sum("count")).first()[0] or 0)
    spread = pairs.join(blocks, "part_h").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # A record's words go to every bucket that holds a part it may belong to. That grows faster than the input, so it
    # goes in turns, each with its share of the parts; what a turn exchanges is gone before the next begins.
    sent = spread.select("id_h", _bucket(total)).distinct().count()
    turns = max(1, -(-sent // (turn_rows or max(TURN_ROWS, total))))
    found = None
    for t in range(turns):
        mine = F.pmod("part_h", F.lit(turns)) == t
        asked = cut(spread.where(mine).select("id_h", "part", _bucket(total // turns)), "asked")
        # Many records may ask one bucket: they are cut into slices, and its members go to each.
        slices = cut(asked.groupBy("bucket").agg(F.ceil(F.countDistinct("id_h") / ASKERS).cast("int").alias("slices")), "slices")
        lhs = asked.groupBy("bucket", "id_h").agg(F.collect_set("part").alias("parts")).join(slices, "bucket").withColumn("slice", F.pmod("id_h", "slices").cast("int"))
        lhs = lhs.join(lacking.withColumn("id_h", F.xxhash64("id")), "id_h").select("bucket", "slice", "id", "words", "parts")
        rhs = members.where(mine).join(blocks.where(mine).drop("part_h"), "part").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        rhs = rhs.select(_bucket(total // turns), "part", "words").join(slices, "bucket").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        links = lhs.groupBy("bucket", "slice").cogroup(rhs.select("bucket", "slice", "part", "words").groupBy("bucket", "slice")).applyInArrow(_shared_words(share), "a string, b string")
        links = links if turns == 1 else cut(links.distinct(), "turn")
        found = links if found is None else found.unionByName(links)
    return found


def _bucket(members: int) -> Column:
    """Buckets of about BLOCK members: small parts share one, a large part is spread over several."""
    return F.pmod(F.xxhash64("part", "block"), F.lit(max(1, -(-members // BLOCK)))).cast("int").alias("bucket")


def clusters(
    rows: DataFrame, least: float = 0.7, share: float = 0.7, dims: int = 384, smallest: int = 3, local_rows: int = LOCAL_ROWS, seed: int = 11, exact: bool = False
) -> DataFrame:
    """One row per member of a cluster: id, cluster_id (the smallest id in it), typical (cosine to the
    centre of its leaf; null for records without a vector), leaf (the medoid's id).

    ``rows``: id, embedding array<float>, composite_text. A vector is usable if it has ``dims`` finite
    numbers, not all zero. Two records with vectors are similar from a cosine of ``least``; one without
    is similar to one with, if both have texts and at least ``share`` of all distinct words of both are
    in both. Clusters are the connected groups of at least ``smallest`` records. Null ids, and records
    with neither vector nor text, take no part. Repeated rows count once; an id with
    several texts or vectors is similar by any. Empty input gives no rows.
    """
    rows = rows.where("id is not null").select("id", "embedding", "composite_text")
    mark = written()
    # What does not fit into memory is read from the input again: on disk it would take about as much as the input.
    vectors = neighbours.packed(rows, dims).persist(StorageLevel.MEMORY_ONLY)
    sample, n = neighbours.sample_of(vectors, dims, SAMPLE)
    tree, counts = grow(vectors, sample, dims, local_rows, seed)
    blocks = {i: -(-n // local_rows) for i, n in counts.items() if n > local_rows}
    shared = vectors.sparkSession.sparkContext.broadcast((tree, blocks))

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, blocks = shared.value
        for b in batches:
            node = tree.route(unit(unpack(b.column("vec"), dims)))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(_blocks(node, b.column("id"), blocks)), b.column("id"), b.column("vec")], names=["node", "block", "id", "vec"])

    found = vectors.mapInArrow(routed, "node long, block int, id string, vec binary").groupBy("node", "block").applyInArrow(
        _local(least, dims, seed), "id string, part string, leaf string, typical double, vec binary"
    )
    found = cut(found, "leaves")
    if not exact:
        vectors.unpersist()
    links = [f for f in (_between(found, least, dims), _exactly(vectors, found, tree, blocks, least, dims) if exact and len(counts) + len(blocks) > 1 else None) if f is not None]
    # Records without a vector, by their words. A text is read, and its words are found, once.
    texts = rows.where("composite_text is not null").select("id", "composite_text").join(found.select("id", "part").distinct(), "id", "left")
    words = cut(texts.select("id", "part", "composite_text").mapInArrow(word_sets, "id string, part string, words array<long>"), "words")
    fresh = [F.col(c).alias(c) for c in ("id", "words", "part")]  # for both sides come from one table
    lacking, members = words.where("part is null").select(*fresh[:2]), words.where("part is not null").select(*fresh)
    links.append(text_links(lacking, members, share))
    joined = links[0]
    for f in links[1:]:
        joined = joined.unionByName(f)
    groups = components(joined)
    alone = found.select("id", "part", "typical", "leaf")
    nodes = alone.join(groups.withColumnRenamed("node", "part"), "part", "left").select(
        "id", F.coalesce("component", "part").alias("component"), "typical", "leaf"
    )
    late = lacking.select("id").join(groups.withColumnRenamed("node", "id"), "id").select(
        "id", "component", F.lit(None).cast("double").alias("typical"), F.lit(None).cast("string").alias("leaf")
    )
    all_ = cut(nodes.unionByName(late).groupBy("id", "component").agg(F.max_by("leaf", "typical").alias("leaf"), F.max("typical").alias("typical")), "grouped")
    vectors.unpersist()
    release(mark, all_)
    named = all_.groupBy("component").agg(F.min("id").alias("cluster_id"), F.countDistinct("id").alias("n")).where(F.col("n") >= smallest)
    return all_.join(named, "component").select("id", "cluster_id", "typical", "leaf")


def _between(found: DataFrame, least: float, dims: int) -> DataFrame | None:
    """Links between parts of different blocks, by the posting lists of what the leaves show of themselves."""
    shown = found.where("vec is not null").select(F.col("part").alias("id"), "vec")
    some, m = neighbours.sample_of(shown, dims, neighbours.SAMPLE)
    if not m:
        return None
    index = Lists.fit(some, max(1, int(neighbours.LIST_ROWS * len(some) / m)), neighbours.MOST_LISTS)
    listed = neighbours.in_lists(shown, index, dims, m).withColumnRenamed("id", "part")
    return listed.groupBy("list", "block_a", "block_b").applyInArrow(_joined(least, dims), "a string, b string")


def _exactly(vectors: DataFrame, found: DataFrame, tree: Tree, blocks: dict[int, int], least: float, dims: int) -> DataFrame:
    """Links between parts of different blocks, none missed: vectors visit all blocks within reach."""
    sc = vectors.sparkSession.sparkContext
    state = {}
    for r in vectors.mapInArrow(_sums(sc.broadcast(tree), dims), NODE).groupBy("node").applyInArrow(_add, NODE).collect():  # at most MOST_NODES + 1 rows
        s = np.frombuffer(r["total"], np.float64)
        state[r["node"]] = (s / max(np.linalg.norm(s), 1e-12)).astype(np.float32)
    centres = sc.broadcast(state)

    def radius(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most: dict[int, float] = {}
        for b in batches:
            x = unit(unpack(b.column("vec"), dims))
            node = tree.route(x)
            for i in np.unique(node):
                far = float(np.arccos(np.clip(x[node == i] @ centres.value[int(i)], -1, 1)).max())
                most[int(i)] = max(most.get(int(i), 0.0), far)
        yield pa.RecordBatch.from_arrays([pa.array(list(most), pa.int64()), pa.array(list(most.values()), pa.float64())], names=["node", "far"])

    radii = {r["node"]: r["far"] for r in vectors.mapInArrow(radius, "node long, far double").groupBy("node").agg(F.max("far").alias("far")).collect()}
    edge = float(np.arccos(np.clip(least, -1, 1)))
    placed = cut(vectors.join(found.select("id", "part").distinct(), "id"), "placed")

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node = tree.route(unit(unpack(b.column("vec"), dims)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(node), pa.array(_blocks(node, b.column("id"), blocks)), b.column("part"), b.column("vec"), pa.array(np.zeros(len(node), bool))], names=["node", "block", "part", "vec", "visits"]
            )

    kind = "node long, block int, part string, vec binary, visits boolean"
    both = placed.mapInArrow(home, kind).union(placed.mapInArrow(_reach(tree, blocks, state, radii, edge, dims), kind))
    return both.groupBy("node", "block").applyInArrow(_visited(least, dims), "a string, b string")


def leaves(members: DataFrame, typical: int = 3) -> DataFrame:
    """The leaves of the tree that lie in clusters: leaf (its medoid's id), cluster_id, n_members, and the ids
    of the members nearest to the leaf's centre, best first, joined by blanks."""
    w = Window.partitionBy("leaf").orderBy(F.desc("typical"), "id")
    at_all = members.where("leaf is not null")
    best = at_all.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= typical)
    best = best.groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("best"))
    sizes = at_all.groupBy("leaf", "cluster_id").agg(F.count(F.lit(1)).alias("n_members"))
    return sizes.join(best, "leaf").select("leaf", "cluster_id", "n_members", F.concat_ws(" ", "best.id").alias("typical"))


def describe(members: DataFrame, rows: DataFrame, dims: int = 384, typical: int = 3) -> DataFrame:
    """cluster_id, n_members, n_leaves, largest_leaf (its number of members), and the ids of the members
    nearest to the centre of all the cluster's vectors, best first, joined by blanks (ties go to the smaller
    id; of an id with several vectors the nearest counts). ``members``: result of ``clusters`` over ``rows``."""
    members = cut(members, "members")
    sizes = members.groupBy("cluster_id", "leaf").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.groupBy("cluster_id").agg(F.sum("n").alias("n_members"), F.count("leaf").alias("n_leaves"), F.max(F.when(F.col("leaf").isNotNull(), F.col("n"))).alias("largest_leaf"))
    vectors = cut(neighbours.packed(rows, dims).join(members.select("id", "cluster_id").distinct(), "id").distinct(), "vectors")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = unit(unpack(b.column("vec"), dims))
            key = b.column("cluster_id").dictionary_encode()
            total = np.zeros((len(key.dictionary), dims))
            np.add.at(total, key.indices.to_numpy(), x)
            yield pa.RecordBatch.from_arrays([key.dictionary, pa.array([t.tobytes() for t in total], pa.binary())], names=["cluster_id", "total"])

    def add(table: pa.Table) -> pa.Table:
        s = sum(np.frombuffer(v, np.float64) for v in table.column("total").to_pylist())
        return pa.table({"cluster_id": table.column("cluster_id")[:1], "total": pa.array([s.tobytes()], pa.binary())})

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = unit(unpack(b.column("vec"), dims))
            c = np.frombuffer(b"".join(b.column("total").to_pylist()), np.float64).reshape(-1, dims)
            cos = np.round(np.einsum("ij,ij->i", x, c) / np.maximum(np.linalg.norm(c, axis=1), 1e-12), 9)
            yield pa.RecordBatch.from_arrays([b.column("cluster_id"), b.column("id"), pa.array(cos)], names=["cluster_id", "id", "cos"])

    centres = vectors.mapInArrow(sums, "cluster_id string, total binary").groupBy("cluster_id").applyInArrow(add, "cluster_id string, total binary")
    scored = vectors.join(centres, "cluster_id").mapInArrow(near, "cluster_id string, id string, cos double").groupBy("cluster_id", "id").agg(F.max("cos").alias("cos"))
    w = Window.partitionBy("cluster_id").orderBy(F.desc("cos"), "id")
    best = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= typical)
    best = best.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("best"))
    return sizes.join(best.select("cluster_id", F.concat_ws(" ", "best.id").alias("typical")), "cluster_id")
