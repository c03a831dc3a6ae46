"""History of changing attributes: closed versions with their periods of validity.

1. All snapshots are partitioned by the same bounds over (entity, time), by one range exchange over their
   union, and each is sorted by itself within each part. What is stored of a part is one sorted run per snapshot.
2. The runs of a part are merged as iterators, k at once: of every run only the batch at hand is held. The
   batches' parts below the least last key are brought into one order, and a version is closed where the payload
   changes.

A range exchange over (entity, time) also splits an entity that holds a third of all rows over many
tasks. What crosses a part's edge is settled from one row per part: the part's first and last state.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from taleweave.plans.shared import cut, cut_parts

OPEN, FIRST = -1, -(2**63)
#: Rows that a part is to have, rows of a run that are held at once.
PART_ROWS, HELD_ROWS = 2_000_000, 50_000
KEY = ("entity", "at_us", "said_us", "tie")


def merge_snapshots(snapshots: list[DataFrame]) -> DataFrame:
    """Union by name of snapshots that share the columns entity, at_us, said_us, payload and tie. A frame with a
    column ``snapshot`` (int) holds several; any other is one by itself."""
    merged = None
    for k, s in enumerate(snapshots):
        own = F.col("snapshot").cast("int") if "snapshot" in s.columns else F.lit(None).cast("int")
        s = s.select(F.lit(k).alias("frame"), F.coalesce(own, F.lit(-1)).alias("snapshot"), *KEY, "payload")
        merged = s if merged is None else merged.unionByName(s)
    return merged


def versions(snapshots: list[DataFrame], parts: int | None = None) -> DataFrame:
    """One row per version: entity, payload, valid_from_us, valid_to_us (-1 for the last version).

    Input columns of every snapshot: ``entity`` string, ``at_us`` long (moment stated), ``said_us``
    long (when it was said; of several rows for one entity and moment the latest holds), ``payload``
    string, ``tie`` string (breaks what is left, the largest holds; null counts as empty).
    Rows with a null entity, moment or payload state nothing. A null ``said_us`` counts as earliest.
    Repeated rows have no effect; empty input gives no rows; other columns are ignored, but for
    ``snapshot`` (see ``merge_snapshots``).
    """
    rows = merge_snapshots(snapshots)
    spark = rows.sparkSession
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(s.count() for s in snapshots) // PART_ROWS))
    rows = rows.where(F.col("entity").isNotNull() & F.col("at_us").isNotNull() & F.col("payload").isNotNull())
    rows = rows.withColumns({"said_us": F.coalesce("said_us", F.lit(FIRST)), "tie": F.coalesce("tie", F.lit(""))})
    # Spark drops constants from a sort; a writer that misses a column of its own there sorts anew by that alone,
    # and the order of a run is lost. So runs are told by one column, or by none if there is only one.
    by = ["run"] if len(snapshots) > 1 or "snapshot" in snapshots[0].columns else []
    rows = rows.select((F.shiftleft(F.col("frame").cast("long"), 32) + F.col("snapshot")).alias("run"), *KEY, "payload")
    # Rows of one entity and moment fall into one part, as the bounds are over (entity, at_us).
    sorted_ = rows.repartitionByRange(parts, "entity", "at_us").sortWithinPartitions(*by, *KEY)
    files: dict[int, list[str]] = {}
    for f in cut_parts(sorted_, by, "snapshots"):
        files.setdefault(int(re.search(r"/part-(\d+)-[^/]*$", f)[1]), []).append(f)
    shared = spark.sparkContext.broadcast(files)

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part in b["id"]:
                yield from _runs(merged([_batches(f) for f in shared.value.get(part, [])]), part)

    # Lineage is cut here as the runs are read twice below.
    runs = cut(spark.range(0, parts, 1, parts).mapInPandas(merge, RUN), "runs")
    inner = runs.where("not edge").select("entity", "payload", "at_us", "to_us")
    # At most two rows per part: settled in one task, in the order of the parts.
    edges = runs.where("edge").repartition(1).sortWithinPartitions("part", "entity", "at_us")
    settled = edges.mapInPandas(_settle, "entity string, payload string, at_us long, to_us long")
    return inner.unionByName(settled).select(
        "entity", "payload", F.col("at_us").alias("valid_from_us"), F.col("to_us").alias("valid_to_us")
    )


def _batches(uri: str) -> Iterator[pa.Table]:
    """The rows of one sorted run, a batch at a time; raises if they are not in order."""
    # Hadoop's names of local files and object stores, as Arrow has them.
    where, path = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", re.sub(r"^s3[an]:", "s3:", uri)))
    with where.open_input_file(path) as f:
        yield from in_order((pa.Table.from_batches([b]) for b in pq.ParquetFile(f).iter_batches(HELD_ROWS, columns=[*KEY, "payload"])), uri)


def in_order(tables: Iterator[pa.Table], name: str) -> Iterator[pa.Table]:
    """The same tables; raises where a row comes before the one ahead of it."""
    last = None
    for t in tables:
        rows = t if last is None else pa.concat_tables([last, t])
        a, b = rows.slice(0, max(rows.num_rows - 1, 0)), rows.slice(1)
        late = pc.less(b[KEY[-1]], a[KEY[-1]])
        for k in reversed(KEY[:-1]):
            late = pc.or_(pc.less(b[k], a[k]), pc.and_(pc.equal(b[k], a[k]), late))
        if pc.any(late).as_py():
            raise RuntimeError(f"run is not sorted: {name}")
        if t.num_rows:
            last = t.slice(t.num_rows - 1)
            yield t


def merged(runs: list[Iterator[pa.Table]]) -> Iterator[pa.Table]:
    """K-way merge of runs that are sorted by KEY, as tables in that order; a moment's rows are in one table.
    Of a moment that fills more than a batch of a run, only the run's last row is kept: it overrules the others."""
    heads = [[t, next(r, None), r] for r in runs if (t := next(r, None)) is not None]  # a batch, the next, and the rest
    while heads:
        lasts = [(t["entity"][-1].as_py(), t["at_us"][-1].as_py()) for t, _, _ in heads]
        going = [k for k, (_, more, _) in zip(lasts, heads) if more is not None]
        # A run may go on with its last moment, so only what is before the least of these is complete.
        cuts = [_below(t, min(going)) if going else t.num_rows for t, _, _ in heads]
        blocks = [t.slice(0, c) for (t, _, _), c in zip(heads, cuts) if c]
        if blocks:
            block = pa.concat_tables(blocks)
            yield block.take(pc.sort_indices(block, [(k, "ascending") for k in KEY])) if len(blocks) > 1 else block
        for h, c, k in zip(heads, cuts, lasts):
            h[0] = h[0].slice(c)
            if h[1] is not None and k == min(going):
                h[0], h[1] = pa.concat_tables([h[0].slice(h[0].num_rows - 1), h[1]]), next(h[2], None)
        heads = [h for h in heads if h[0].num_rows]


def _below(table: pa.Table, bound: tuple[str, int]) -> int:
    """How many of the sorted rows come before a moment."""
    entity, at = bound
    e = table["entity"]
    before = pc.or_(pc.less(e, entity), pc.and_(pc.equal(e, entity), pc.less(table["at_us"], at)))
    return pc.sum(before).as_py() or 0


RUN = "entity string, payload string, at_us long, to_us long, edge boolean, part int"


def _runs(tables: Iterator[pa.Table], part: int) -> Iterator[pd.DataFrame]:
    """Runs of equal payload in one part. ``to_us`` is null where the part ends before the run.

    Held between tables: the last row, whose moment may go on, and the last run, which is still open.
    """
    held = run = None
    sent_first = False

    def flush(rows: pd.DataFrame, final: bool) -> pd.DataFrame | None:
        nonlocal held, run, sent_first
        if held is not None:
            rows = pd.concat([held, rows], ignore_index=True)
        if rows.empty:
            return None
        e, t = rows["entity"].to_numpy(object), rows["at_us"].to_numpy()
        wins = np.ones(len(rows), bool)
        wins[:-1] = (e[1:] != e[:-1]) | (t[1:] != t[:-1])
        if not final:
            wins[-1] = False
            held = rows.iloc[-1:]
        else:
            held = None
        rows = rows[wins]
        if run is not None:
            rows = pd.concat([run, rows], ignore_index=True)
        if rows.empty:
            return None
        e, v, t = (rows[c].to_numpy() for c in ("entity", "payload", "at_us"))
        new = np.ones(len(rows), bool)
        new[1:] = (e[1:] != e[:-1]) | (v[1:] != v[:-1])
        e, v, t = e[new], v[new], t[new]
        run = pd.DataFrame({"entity": e[-1:], "payload": v[-1:], "at_us": t[-1:]})
        if len(e) == 1:
            return None
        out = pd.DataFrame({"entity": e[:-1], "payload": v[:-1], "at_us": t[:-1]})
        out["to_us"] = pd.array(np.where(e[1:] == e[:-1], t[1:], OPEN), dtype="Int64")
        out["edge"] = False
        out.loc[out.index[0], "edge"] = not sent_first
        sent_first = True
        out["part"] = part
        return out

    for table in tables:
        if (out := flush(table.select(["entity", "payload", "at_us"]).to_pandas(), False)) is not None:
            yield out
    if held is not None and (out := flush(held.iloc[:0], True)) is not None:
        yield out
    if run is not None:
        yield run.assign(to_us=pd.array([None], dtype="Int64"), edge=True, part=part)


def _settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Join the runs that go on over the edges of parts."""
    out, at = [], None
    for batch in batches:
        for e, v, t, to in zip(batch["entity"], batch["payload"], batch["at_us"], batch["to_us"]):
            if at is None or at[0] != e or at[1] != v:
                if at is not None:
                    out.append((*at, t if at[0] == e else OPEN))
                at = (e, v, t)
            if not pd.isna(to):
                out.append((*at, int(to)))
                at = None
    if at is not None:
        out.append((*at, OPEN))
    yield pd.DataFrame(out, columns=["entity", "payload", "at_us", "to_us"])
