"""Connected components: forests of single parts, then stars, with lineage cut in the shared folder every round."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from taleweave.plans.shared import cut

#: Links that one task settles at the end (about 100 bytes each), links that a part's forest is made of at once.
BASE_LINKS, PART_LINKS = 200_000, 500_000


def components(links: DataFrame, max_rounds: int = 60, base_links: int = BASE_LINKS) -> DataFrame:
    """node, component (the smallest node of the component) for every node of ``links`` (a, b).

    First each part of the links is reduced to a forest by itself, so at most one link a node and part is
    exchanged. Then two steps alternate until nothing changes: every node's larger neighbours are linked to
    its smallest one, then its smaller ones and itself. Each step keeps the components, and a round at least
    halves the trees' heights; a node with very many links is aggregated by its minimum only, never
    gathered. A forest of at most ``base_links`` links is settled by one task. Null ends are no links,
    self-links only name their node; empty input gives no rows.
    """
    links = links.where("a is not null and b is not null").select(F.col("a").cast("string"), F.col("b").cast("string"))
    edges = cut(links.mapInArrow(_forest, "hi string, lo string").distinct(), "links")
    before = None
    for round_ in range(max_rounds):
        state = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first())
        if state[0] <= base_links:
            return edges.toDF("a", "b").coalesce(1).mapInArrow(_settled, "node string, component string")
        if state == before:
            return edges.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("component"))
        before = state
        large = _star(edges.union(edges.select("lo", "hi").toDF("hi", "lo")), "large")
        # A node's link to itself only keeps it in the result.
        edges = cut(_star(large, "small").union(edges.where("hi = lo")).distinct(), f"round{round_}")
    raise RuntimeError("the components did not settle")


def _star(edges: DataFrame, kind: str) -> DataFrame:
    """edges: hi, lo as (node, neighbour). Large: neighbours larger than the node go to its smallest
    neighbour or itself. Small: the node and its smaller neighbours go to its smallest."""
    edges = edges.where("hi <> lo")
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    both = edges.join(least, "hi")
    if kind == "large":
        return both.where("lo > hi").select(F.col("lo").alias("hi"), F.least("m", "hi").alias("lo")).distinct()
    out = both.where("lo <> m").select(F.col("lo").alias("a"), F.col("m").alias("b")).union(least.select("hi", "m"))
    return out.toDF("hi", "lo").distinct()


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number that each of ``n`` is linked to, over the links a[i] - b[i]."""
    up = np.arange(n)
    while len(a):
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while (new := up[up]).tobytes() != up.tobytes():
            up = new
        a, b = up[a], up[b]
        open_ = a != b
        a, b = a[open_], b[open_]
    return up


def _rooted(a: pa.Array, b: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct nodes in order, and the place of each one's root."""
    both = pa.concat_arrays([a, b]).dictionary_encode()
    order = pc.sort_indices(both.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    place = rank[both.indices.to_numpy()]
    return both.dictionary.take(pa.array(order)), roots(len(order), place[: len(a)], place[len(a):])


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (hi, lo) of each node to its root; a root is linked to itself."""
    held: list[tuple[pa.Array, pa.Array]] = []
    size = 0

    def settle() -> tuple[pa.Array, pa.Array]:
        nodes, up = _rooted(*(pa.concat_arrays([h[i] for h in held]) for i in (0, 1)))
        return nodes, nodes.take(pa.array(up))

    for batch in batches:
        if batch.num_rows:
            held.append((batch.column(0), batch.column(1)))
            size += batch.num_rows
        if size > PART_LINKS:
            nodes, up = settle()
            if len(nodes) > PART_LINKS // 2:  # too many nodes to go on with
                yield pa.RecordBatch.from_arrays([nodes, up], names=["hi", "lo"])
                held, size = [], 0
            else:
                held, size = [(nodes, up)], len(nodes)
    if held:
        yield pa.RecordBatch.from_arrays(list(settle()), names=["hi", "lo"])


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = [b for b in batches if b.num_rows]
    if got:
        nodes, up = _rooted(*(pa.concat_arrays([b.column(i) for b in got]) for i in (0, 1)))
        yield pa.RecordBatch.from_arrays([nodes, nodes.take(pa.array(up))], names=["node", "component"])
