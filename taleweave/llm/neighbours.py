"""The most similar vectors of every vector, by balanced posting lists.

The centroids are fitted on a bounded sample (MOST_SAMPLE); every vector is indexed. A vector goes to the list of
its nearest centroid and, if it lies near a border, to further lists by the ratio of distances; the
centroids are searched through an in-memory graph. As each vector is both a query and an entry, and
finds what shares a list with it, one copy per list serves both. Inside a list all scores come from
one matrix product, and the best are computed again in double precision.

Lists are balanced by fitting, and those that cannot be (copies of one vector) are cut into blocks:
every pair of blocks is one task, so the size of a task is bounded and no pair is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window, functions as F

from taleweave.llm.vectors import Lists, pack, unit, unpack, usable

#: Vectors that the centroids are fitted on: at least, and at most; up to there, two for each list.
SAMPLE, MOST_SAMPLE = 16_384, 65_536
#: Vectors that a list is to have, lists at most (from 33 million vectors on, lists grow), rows of a block.
LIST_ROWS, MOST_LISTS, BLOCK_ROWS = 1_024, 32_768, 8_192
#: Lists of a vector at most, and how much farther than the nearest centroid they may be.
COPIES, RATIO = 4, 0.05
#: Margin of single precision below a threshold, settled in double precision.
SLACK = 4e-6


def packed(rows: DataFrame, dims: int) -> DataFrame:
    """id and vec (packed) of the rows with a usable embedding."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = usable(b.column("embedding"), dims)
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at)).cast(pa.string()), pack(x)], names=["id", "vec"])

    return rows.where(F.col("id").isNotNull() & (F.size("embedding") == dims)).select("id", "embedding").mapInArrow(go, "id string, vec binary")


def sample_of(vectors: DataFrame, dims: int, size: int = SAMPLE) -> tuple[np.ndarray, int]:
    """Of the packed vectors (id, vec) ``size``, or two for each list that they will make, but at most MOST_SAMPLE,
    chosen by a hash of both; and their number."""
    n = vectors.count()
    size = max(size, min(MOST_SAMPLE, 2 * n // LIST_ROWS))
    bound = int(min(1.0, 1.1 * size / max(n, 1)) * 2**62)
    some = vectors.where(F.shiftrightunsigned(F.xxhash64("id", "vec"), 2) < bound)
    return unpack(some.select("vec").toArrow().column("vec"), dims)[:size], n


def in_lists(vectors: DataFrame, index: Lists, dims: int, rows: int) -> DataFrame:
    """list, block_a, block_b, side, id, vec: a row for every list (and pair of blocks) of a vector."""
    shared = vectors.sparkSession.sparkContext.broadcast(index)
    blocks = np.maximum(1, np.ceil(index.share * rows * COPIES / BLOCK_ROWS)).astype(int)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = unpack(b.column("vec"), dims)
            at, lists = shared.value.lists_of(unit(x), COPIES, RATIO)
            if not len(at):
                continue
            many = blocks[lists] > 1
            first, second = np.zeros(len(at), np.int32), np.zeros(len(at), np.int32)
            if many.any():
                ids = b.column("id").to_pylist()
                a2, l2, f2, s2 = [at[~many]], [lists[~many]], [first[~many]], [second[~many]]
                for i, li in zip(at[many], lists[many]):
                    n = int(blocks[li])
                    own = _hash(ids[i]) % n
                    others = np.arange(n, dtype=np.int32)
                    a2.append(np.full(n, i))
                    l2.append(np.full(n, li))
                    f2.append(np.minimum(others, own).astype(np.int32))
                    s2.append(np.maximum(others, own).astype(np.int32))
                at, lists, first, second = map(np.concatenate, (a2, l2, f2, s2))
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(lists.astype(np.int32)), pa.array(first), pa.array(second), b.column("id").take(take), b.column("vec").take(take)],
                names=["list", "block_a", "block_b", "id", "vec"],
            )

    return vectors.mapInArrow(go, "list int, block_a int, block_b int, id string, vec binary")


def _hash(s: str) -> int:
    import zlib

    return zlib.crc32(s.encode())


def _best(k: int, least: float, dims: int):
    def go(table: pa.Table) -> pa.Table:
        ids, first = distinct_rows(table)
        ids = np.array(ids.to_pylist(), object)
        x = unpack(table.column("vec").combine_chunks().take(pa.array(first)), dims)
        y = x.astype(np.float64)
        y /= np.linalg.norm(y, axis=1, keepdims=True)
        z = y.astype(np.float32)
        a, b, scores = [], [], []
        n = len(ids)
        step = max(16, min(1024, 4_000_000 // max(n, 1)))
        for lo in range(0, n, step):
            s = z[lo : lo + step] @ z.T
            s[ids[lo : lo + step, None] == ids[None, :]] = -2
            kth = np.partition(s, n - k, axis=1)[:, n - k] if n > k else np.full(len(s), -1, np.float32)
            r, c = np.nonzero(s >= np.maximum(kth - SLACK, least - SLACK)[:, None])
            for p in range(0, len(r), 65_536):  # copies of one vector may tie by the thousand
                rr, cc = r[p : p + 65_536], c[p : p + 65_536]
                exact = np.round(np.einsum("ij,ij->i", y[lo + rr], y[cc]), 9)
                ok = exact >= least
                rr, cc, exact = rr[ok], cc[ok], exact[ok]
                order = np.lexsort((cc, -exact, rr))  # ids are sorted, so places order ties
                rr, cc, exact = rr[order], cc[order], exact[order]
                start = np.flatnonzero(np.r_[True, rr[1:] != rr[:-1]]) if len(rr) else np.zeros(0, int)
                rank = np.arange(len(rr)) - np.repeat(start, np.diff(np.r_[start, len(rr)]))
                keep = rank < k
                a.append(lo + rr[keep])
                b.append(cc[keep])
                scores.append(exact[keep])
        a, b, scores = (np.concatenate(v) if v else np.zeros(0, int) for v in (a, b, scores))
        return pa.table({"id": pa.array(ids[a], pa.string()), "other": pa.array(ids[b], pa.string()), "score": pa.array(scores, pa.float64())})

    return go


def distinct_rows(table: pa.Table) -> tuple[pa.Array, np.ndarray]:
    """The ids in order and the place of each one's row; repeated rows count once, an id with several vectors
    keeps each."""
    column = table.column("id").combine_chunks()
    order = pc.sort_indices(column).to_numpy()
    ids = column.take(pa.array(order))
    place = ids.dictionary_encode().indices.to_numpy()
    again = np.r_[False, place[1:] == place[:-1]]
    if again.any():
        vec, seen, keep = table.column("vec"), set(), np.ones(len(order), bool)
        for i in np.flatnonzero(again | np.r_[again[1:], False]):
            row = place[i], vec[int(order[i])].as_py()
            keep[i] = row not in seen
            seen.add(row)
        order, ids = order[keep], ids.filter(pa.array(keep))
    return ids, order


def nearest(rows: DataFrame, k: int = 5, least: float = 0.7, dims: int = 384) -> DataFrame:
    """The ``k`` others of highest cosine, of at least ``least``, of every usable vector: id, other, score.

    ``rows``: id string, embedding array<float>. A vector is usable if it has ``dims`` finite numbers,
    not all zero; other rows, also those with null ids, take no part. The cosine is of the stored
    numbers in double precision, rounded to 9 decimals; ties go to the smaller id. Repeated rows
    count once; an id with several vectors is compared by each, and the best score counts. Empty
    input gives no rows; other columns are ignored.
    """
    vectors = packed(rows, dims).persist(StorageLevel.MEMORY_AND_DISK)  # read for the sample and for the lists
    sample, n = sample_of(vectors, dims)
    index = Lists.fit(sample, max(1, int(LIST_ROWS * len(sample) / max(n, 1))), MOST_LISTS)
    found = in_lists(vectors, index, dims, n).groupBy("list", "block_a", "block_b").applyInArrow(
        _best(k, least, dims), "id string, other string, score double"
    )
    best = found.groupBy("id", "other").agg(F.max("score").alias("score"))
    w = Window.partitionBy("id").orderBy(F.desc("score"), "other")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("rank")
