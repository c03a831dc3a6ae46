"""Parent-child links of unknown depth: full path, depth, root and descendants, with cycles detected.

Every round splits the open nodes over parts, contracts the chains that stay inside a part to the
part's exits, and keeps as the next, smaller forest only the nodes that some chain exits to. The
rounds end when the quotient forest fits one bounded task; then the results are expanded back, round
by round, with one equi-join each.

So that long chains shrink at every scale, a node is placed by a coin: with its parent (tails) or at
its own hash (heads). A tails child of a heads parent is local, so at least a quarter of a chain's
links contract per round whatever the number of parts. Parents with more than ``SPREAD`` children
attract none of them, so a hot parent fills no part. Leaves are no exits and vanish in round one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from taleweave.plans.shared import cut

#: Rows of a quotient forest that one task solves (about 100 bytes each).
BASE_ROWS = 20_000
#: Rows of a part in a contracting round, and parts at least.
PART_ROWS, LEAST_PARTS = 50_000, 8
#: Children that a parent may draw into its part.
SPREAD = 1_000


def newest_parents(statements: DataFrame) -> DataFrame:
    """The parent of each node as its newest statement has it: id, parent.

    ``statements``: id string, parent string, said_us long, rank int. Of statements at one moment the
    highest rank holds, then the largest parent; a null parent there means none. A null ``said_us``
    counts as earliest. Statements with a null id are left out.
    """
    best = F.max(F.struct(F.coalesce("said_us", F.lit(-(2**62))).alias("t"), "rank", F.coalesce("parent", F.lit("")).alias("p")))
    newest = statements.where("id is not null").groupBy("id").agg(best.alias("b"))
    return newest.select("id", F.when(F.col("b.p") != "", F.col("b.p")).alias("parent"))


def resolve(
    nodes: DataFrame,
    with_paths: bool = False,
    base_rows: int = BASE_ROWS,
    part_rows: int = PART_ROWS,
    max_rounds: int = 60,
) -> DataFrame:
    """Root and depth of each node of ``nodes`` (id string, parent string): id, root_id, depth and,
    if asked for, path (ids from the root to the node, joined by ``/``).

    A parent that is null or has no row counts as none: the node is a root with depth 0. Nodes on a
    cycle or below one get depth -1, the cycle's smallest id as root and a null path. Repeated rows
    count once; of rows with one id and different parents the largest parent holds. Empty input gives
    no rows; other columns are ignored.
    """
    nodes = nodes.where("id is not null").groupBy("id").agg(F.max("parent").alias("parent"))
    nodes = cut(nodes, "nodes")
    rooted = nodes.join(nodes.select(F.col("id").alias("parent")), "parent", "left_semi")
    path = F.col("id") if with_paths else F.lit(None).cast("string")
    done = nodes.join(rooted.select("id"), "id", "left_anti").select(
        "id", F.col("id").alias("root_id"), F.lit(0).cast("long").alias("depth"), path.alias("path")
    )
    # A fragment: from a node up to its exit, the next node to look at; frag is the path between, low its smallest id.
    open_ = rooted.select("id", F.col("parent").alias("exit"), F.lit(1).cast("long").alias("steps"), path.alias("frag"), F.col("id").alias("low"))
    levels: list[DataFrame] = []
    for round_ in range(max_rounds):
        open_ = cut(open_, f"open{round_}")
        n = open_.count()
        if n > base_rows:
            # Only nodes that are exits themselves go on; the rest waits for its exit's result.
            exits = open_.select(F.col("exit").alias("id")).distinct()
            levels.append(open_.join(exits, "id", "left_anti"))
            parts = max(LEAST_PARTS, -(-n // part_rows))
            placed = _placed(open_.join(exits, "id", "left_semi"), parts, round_).repartition(parts, "part")
        else:
            placed = open_.coalesce(1)
        contracted = cut(placed.select("id", "exit", "steps", "frag", "low").mapInPandas(_contract, FRAGMENT), f"contracted{round_}")
        done = done.unionByName(
            contracted.where("cycle").select(
                "id",
                F.col("exit").alias("root_id"),
                F.lit(-1).cast("long").alias("depth"),
                F.lit(None).cast("string").alias("path"),
            )
        )
        open_ = contracted.where("not cycle").drop("cycle")
        if n <= base_rows:
            levels.append(open_)
            break
    else:
        raise RuntimeError("the forest did not contract")
    done = cut(done, "done")
    for k, level in enumerate(reversed(levels)):
        up = done.select(F.col("id").alias("exit"), "root_id", F.col("depth").alias("up"), "path")
        looped = F.col("up") == -1
        solved = level.join(up, "exit").select(
            "id",
            "root_id",
            F.when(looped, F.lit(-1)).otherwise(F.col("up") + F.col("steps")).cast("long").alias("depth"),
            F.when(~looped, F.concat("path", F.lit("/"), "frag")).alias("path"),
        )
        # Every level is written once, and read by those below it.
        done = done.unionByName(cut(solved, f"done{k}") if k + 1 < len(levels) else solved)
    return done if with_paths else done.drop("path")


FRAGMENT = "id string, exit string, steps long, frag string, low string, cycle boolean"


def descendants(paths: DataFrame) -> DataFrame:
    """All pairs (id, descendant, distance) from ``resolve(..., with_paths=True)``; nodes on or below
    a cycle have no path and give none. The result has as many rows as the depths sum up to."""
    steps = paths.where("depth > 0").select(F.col("id").alias("descendant"), "depth", F.split("path", "/").alias("p"))
    up = steps.select("descendant", "depth", F.posexplode(F.slice("p", 1, F.size("p") - 1)).alias("at", "id"))
    return up.select("id", "descendant", (F.col("depth") - F.col("at")).alias("distance"))


def _placed(core: DataFrame, parts: int, round_: int) -> DataFrame:
    hot = core.groupBy("exit").count().where(F.col("count") > SPREAD).select("exit", F.lit(True).alias("hot"))
    coin = lambda c: F.pmod(F.xxhash64(c, F.lit(f"coin{round_}")), F.lit(2))
    at = lambda c: F.pmod(F.xxhash64(c, F.lit(round_)), F.lit(parts))
    drawn = (coin("id") == 1) & F.col("hot").isNull()
    return core.join(hot, "exit", "left").withColumn("part", F.when(drawn, at("exit")).otherwise(at("id")))


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Follow the exits as far as they stay in this part. Where they close a cycle, ``exit`` is its
    smallest id and ``cycle`` is true, for the nodes on it and below it."""
    got = [b for b in batches if len(b)]
    if not got:
        return
    rows = pd.concat(got, ignore_index=True)
    ids, exits, steps = rows["id"].to_numpy(object), rows["exit"].to_numpy(object), rows["steps"].to_numpy(np.int64)
    index = pd.Index(ids)
    step = index.get_indexer(exits)  # -1: the exit is in another part, or is no open node
    here = np.arange(len(ids))
    nxt = np.where(step >= 0, step, here)
    dist, hops = np.where(step >= 0, steps, 0), (step >= 0).astype(np.int64)
    names, own = np.unique(rows["low"].to_numpy(object), return_inverse=True)
    least = own
    for _ in range(len(ids).bit_length() + 1):  # pointer doubling
        dist, hops, least, nxt = dist + dist[nxt], hops + hops[nxt], np.minimum(least, least[nxt]), nxt[nxt]
    looped = step[nxt] >= 0
    out, total = exits[nxt].copy(), dist + steps[nxt]
    frag = rows["frag"].to_numpy(object)
    if looped.any():
        low: dict[int, object] = {}
        for start in np.unique(nxt[looped]):  # these lie on the cycles
            if start not in low:
                loop, at = [start], step[start]
                while at != start:
                    loop.append(at)
                    at = step[at]
                low.update(dict.fromkeys(loop, names[min(own[i] for i in loop)]))
        out[looped] = [low[i] for i in nxt[looped]]
        total[looped] = 0
    if frag[0] is not None:
        frag = frag.copy()
        for i in np.argsort(hops, kind="stable"):
            if step[i] >= 0 and not looped[i]:
                frag[i] = f"{frag[step[i]]}/{frag[i]}"
    yield pd.DataFrame({"id": ids, "exit": out, "steps": total, "frag": frag, "low": names[least], "cycle": looped})
