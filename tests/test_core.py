import random
import time

import numpy as np
import pyarrow as pa
import pytest

from taleweave.functions.links import canonical_certainty, canonical_link, link_key
from taleweave.operators import hierarchy, history, orphans
from taleweave.operators.betweenness import brandes, centrality, dependencies, placed, shares
from taleweave.operators.components import components
from pyspark.sql import functions as F

K = "c0123456789"


def test_links(spark):
    spellings = [f"character:{K}", K, f"character:⟨{K}⟩", f"Character:{K}", f"character:{K.upper()}", f" character:{K}", f"character:`{K}` ", f"character%3A{K}", "", " ", None]
    df = spark.createDataFrame([(s,) for s in spellings], "s string")
    got = [r[0] for r in df.select(canonical_link(F.col("s"))).collect()]
    assert got == [f"character:{K}"] * 8 + [None] * 3
    assert df.select(link_key(F.col("s"))).distinct().count() == 2


def test_certainty(spark):
    df = spark.createDataFrame([(s,) for s in ["Believes wrongly", "BelievesWrongly", "believes-wrongly ", "KNOWS", "certain", "odd", None]], "s string")
    assert [r[0] for r in df.select(canonical_certainty(F.col("s"))).collect()] == ["believes_wrongly"] * 3 + ["knows", "knows", "uncertain", None]


def versions_by_hand(rows):
    out, by = set(), {}
    for e, at, said, payload, tie in rows:
        if None not in (e, at, payload):
            k, v = (e, at), (said if said is not None else -(2**62), tie, payload)
            by[k] = max(by.get(k, v), v)
    for e in {e for e, _ in by}:
        points, last = [], None
        for at in sorted(at for x, at in by if x == e):
            p = by[e, at][2]
            if p != last:
                points.append((at, p))
            last = p
        for (at, p), nxt in zip(points, [*points[1:], (-1, None)]):
            out.add((e, p, at, nxt[0]))
    return out


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_versions(spark, parts):
    rng = random.Random(parts)
    # One entity holds most rows; repeated rows, ties, nulls in every column.
    rows = [(rng.choice(["a", "a", "a", "b", "c", None]), rng.choice([*range(40), None]), rng.choice([1, 2, None]), rng.choice(["x", "y", None]), f"t{i}") for i in range(400)]
    rows += rows[:50]
    schema = "entity string, at_us long, said_us long, payload string, tie string"
    half = [spark.createDataFrame(r, schema).withColumn("part", F.lit(1)) for r in (rows[:200], rows[200:])]
    got = [tuple(r) for r in history.versions(half, parts).collect()]
    assert len(got) == len(set(got)) and set(got) == versions_by_hand(rows)


@pytest.mark.parametrize("by", [["snapshot"], []])
def test_runs_longer_than_a_batch_keep_their_order(spark, by):
    n, entities = 150_000, 1_000  # 75 000 rows a run: more than HELD_ROWS
    rows = spark.range(n).select(
        F.format_string("e%04d", F.col("id") % entities).alias("entity"), F.expr("id div 1000").alias("at_us"), F.lit(0).cast("long").alias("said_us"),
        F.format_string("p%d", F.expr("id div 2000")).alias("payload"), F.lit("t").alias("tie"), F.expr("cast(2020 + hash(id) % 2 as int)").alias("snapshot"),
    ).orderBy(F.hash("id"))
    got = {tuple(r) for r in history.versions([rows.select(*history.KEY, "payload", *by)], 1).collect()}
    last = n // entities // 2 - 1
    assert got == {(f"e{e:04d}", f"p{v}", 2 * v, 2 * v + 2 if v < last else -1) for e in range(entities) for v in range(last + 1)}


def test_a_run_out_of_order_is_refused():
    table = lambda *at: pa.table({"entity": ["a"] * len(at), "at_us": list(at), "said_us": [0] * len(at), "tie": [""] * len(at)})
    assert len(list(history.in_order(iter([table(1, 2, 2), table(2, 3)]), "run"))) == 2
    for tables in ([table(1, 3, 2)], [table(1, 3), table(2)]):
        with pytest.raises(RuntimeError):
            list(history.in_order(iter(tables), "run"))


@pytest.mark.parametrize("size", [1, 3, 50])
def test_merge_of_sorted_runs(size):
    rng = random.Random(size)
    runs = [sorted((rng.choice("ab"), rng.randrange(9), rng.randrange(3), f"t{rng.randrange(4)}") for _ in range(n)) for n in (40, 17, 1, 0)]
    tables = [[pa.table(dict(zip(history.KEY, map(list, zip(*r[i : i + size])))) | {"payload": ["p"] * len(r[i : i + size])}) for i in range(0, len(r), size)] for r in runs]
    got = [tuple(r[k] for k in history.KEY) for t in history.merged([iter(t) for t in tables]) for r in t.to_pylist()]
    whole = sorted(r for run in runs for r in run)
    assert got == sorted(got) and set(got) <= set(whole)
    # Rows of one moment are next to each other, and its last row, which holds, is there.
    assert {r[:2]: r for r in got} == {r[:2]: r for r in whole}
    if size == 50:
        assert got == whole


def test_versions_of_snapshots_in_one_frame(spark):
    rng = random.Random(5)
    rows = [(rng.choice("abc"), rng.randrange(30), rng.randrange(3), rng.choice("xyz"), f"t{i}", rng.choice([2021, 2022, None])) for i in range(300)]
    df = spark.createDataFrame(rows, "entity string, at_us long, said_us long, payload string, tie string, snapshot int")
    assert {tuple(r) for r in history.versions([df], 4).collect()} == versions_by_hand([r[:5] for r in rows])


def test_versions_empty(spark):
    empty = spark.createDataFrame([], "entity string, at_us long, said_us long, payload string, tie string")
    assert history.versions([empty]).collect() == []


def forest_by_hand(parent):
    out = {}
    for v in parent:
        seen, at = [], v
        while parent.get(at) in parent and at not in seen:
            seen.append(at)
            at = parent[at]
        if at in seen:
            out[v] = (min(seen[seen.index(at):]), -1)
        else:
            out[v] = (at, len(seen))
    return out


@pytest.mark.parametrize("base,part", [(10_000, 100), (3, 5), (10, 20)])
def test_hierarchy(spark, base, part):
    rng = random.Random(base)
    names = [f"n{i:03}" for i in range(120)]
    parent = {n: rng.choice([None, "gone", *names[max(0, i - 4) : i + 1]]) if i else None for i, n in enumerate(names)}
    parent |= {f"chain{i:02}": f"chain{i + 1:02}" for i in range(40)} | {"chain40": None}
    parent |= {f"ring{i}": f"ring{(i + 1) % 5}" for i in range(5)} | {"below": "ring3", "lower": "below", "self": "self"}
    parent |= {f"leaf{i:02}": "n000" for i in range(60)}
    rows = list(parent.items()) * 2 + [(None, "n000")]
    got = hierarchy.resolve(spark.createDataFrame(rows, "id string, parent string").withColumn("path", F.lit(1)), True, base, part).collect()
    assert {r.id: (r.root_id, r.depth) for r in got} == forest_by_hand(parent) and len(got) == len(parent)
    for r in got:
        if r.depth < 0:
            assert r.path is None
        else:
            ids = r.path.split("/")
            assert ids[0] == r.root_id and ids[-1] == r.id and len(ids) == r.depth + 1
            assert all(parent[b] == a for a, b in zip(ids, ids[1:]))


def test_hierarchy_descendants(spark):
    got = hierarchy.descendants(hierarchy.resolve(spark.createDataFrame([("a", None), ("b", "a"), ("c", "b")], "id string, parent string"), True)).collect()
    assert {tuple(r) for r in got} == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1)}
    assert hierarchy.resolve(spark.createDataFrame([], "id string, parent string"), True).collect() == []


def test_newest_parent(spark):
    rows = [("a", "x", 1, 0), ("a", None, 2, 1), ("b", "x", 5, 1), ("b", "y", 5, 0), ("c", "x", None, 0), (None, "x", 1, 0)]
    got = hierarchy.newest_parents(spark.createDataFrame(rows, "id string, parent string, said_us long, rank int")).collect()
    assert {tuple(r) for r in got} == {("a", None), ("b", "x"), ("c", "x")}


def test_orphans(spark, monkeypatch):
    monkeypatch.setattr(orphans, "HEAVY_SHARE", 0.3)  # "hot" is heavy
    # Heavy keys go by broadcast, all others through the anti-join; with no key heavy the result is the same.
    targets = spark.createDataFrame([("hot", 10), ("hot", 20), ("gone", 5), ("late", 50), ("back", 5), ("back", 90), (None, 1)], "key string, created_us long")
    deletions = spark.createDataFrame([("gone", 6), ("back", 60), ("hot", 15), (None, 3)], "key string, deleted_us long")
    refs = [(f"h{i}", "hot", 30) for i in range(20)] + [("early", "hot", 5), ("m", "missing", 1), ("g", "gone", 9), ("l", "late", 49), ("ok", "late", 50), ("b", "back", 70), ("n", None, 1), ("u", "late", None)]
    df = spark.createDataFrame(refs + refs[:5], "record_id string, key string, created_us long")
    states = orphans.target_states(targets, deletions)
    got = {(r.record_id, r.reason) for r in orphans.orphan_references(df.withColumn("known", F.lit(1)), states).collect()}
    assert got == {("early", "later"), ("m", "missing"), ("g", "deleted"), ("l", "later")}
    counts = orphans.orphan_counts(df.withColumn("period", F.lit("p")), states).collect()
    assert {(r.reason, r.n_links) for r in counts} == {("later", 2), ("missing", 1), ("deleted", 1)}
    assert orphans.orphan_references(df.limit(0), states).collect() == []


@pytest.mark.parametrize("base", [200_000, 5])
def test_components(spark, base):
    links = [(f"p{i:02}", f"p{i + 1:02}") for i in range(30)] + [("x", "y"), ("y", "x"), ("z", "z"), (None, "x"), ("x", None)] + [("hub", f"s{i}") for i in range(40)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a string, b string").repartition(4), base_links=base).collect()}
    assert got["p30"] == "p00" and got["y"] == "x" and got["z"] == "z" and got["s7"] == "hub" and len(got) == 31 + 2 + 1 + 41
    assert components(spark.createDataFrame([], "a string, b string")).collect() == []


def test_brandes_star_and_line():
    star = [[1, 2, 3], [0], [0], [0]]
    total, near = brandes(star, [0, 1, 2, 3])
    assert total == [6.0, 0, 0, 0] and near[0] == (3, 3) and near[1] == (3, 5)
    line = [[1], [2], []]
    assert brandes(line, [0, 1, 2])[0] == [0, 1.0, 0]


def as_arrays(adjacent):
    return np.cumsum([0, *map(len, adjacent)]), np.array([w for a in adjacent for w in a], dtype=np.int64)


def hub_graph(n, rng):
    """Node 0 is linked with a third of all, like the character that holds a tenth of the ledger."""
    adjacent = [sorted({rng.randrange(n) for _ in range(rng.randrange(6))} - {v} | ({0} if v and rng.random() < 0.3 else set())) for v in range(n)]
    adjacent[0] = sorted(rng.sample(range(1, n), n // 3))
    return adjacent


@pytest.mark.parametrize("n", [3, 40, 700])
def test_searches_over_arrays_give_the_same(n):
    adjacent = hub_graph(n, random.Random(n))
    adjacent[-1] = []
    total, near = brandes(adjacent, list(range(n)))
    got, got_near = dependencies(*as_arrays(adjacent), list(range(n)))
    assert got_near == near and np.allclose(got, total, rtol=1e-12, atol=1e-12)


def test_more_shortest_paths_than_a_double_holds():
    # 1 100 diamonds in a row: 2 ** 1100 paths from end to end.
    adjacent = [x for i in range(1100) for x in ([3 * i + 1, 3 * i + 2], [3 * i + 3], [3 * i + 3])] + [[]]
    got, near = dependencies(*as_arrays(adjacent), [0])
    assert np.isfinite(got).all() and got[1] == (len(adjacent) - 1 - 2) / 2 and near[0][0] == len(adjacent) - 1


def test_a_search_of_a_large_graph_is_quick():
    adjacent = hub_graph(30_000, random.Random(1))
    arrays, sources = as_arrays(adjacent), list(range(1, 9))
    began = time.thread_time()
    total, near = brandes(adjacent, sources)
    by_node, began = time.thread_time() - began, time.thread_time()
    got, got_near = dependencies(*arrays, sources)
    assert time.thread_time() - began < by_node / 4
    assert got_near == near and np.allclose(got, total, rtol=1e-12, atol=1e-9)


def test_a_search_takes_its_own_component_only(spark):
    copies, n = 150, 600
    one = hub_graph(n, random.Random(2))
    adjacent = [[copies * w + i for w in one[v]] for v in range(n) for i in range(copies)]
    starts, ends = as_arrays(adjacent)
    order, *graph = placed(len(adjacent), np.repeat(np.arange(len(adjacent)), np.diff(starts)), ends)
    sources = np.arange(0, len(adjacent), 1999)
    began = time.thread_time()
    total, near = dependencies(starts, ends, order[sources].tolist())
    whole, began = time.thread_time() - began, time.thread_time()
    at, some, got_near = shares(*graph, sources)
    assert time.thread_time() - began < whole / 3
    got = np.zeros(len(adjacent))
    got[order[at]] = some
    assert {int(order[s]): r for s, r in got_near.items()} == near and np.allclose(got, total, rtol=1e-12, atol=1e-9)

    few = [(f"{v:02d}{i}", f"{w:02d}{i}") for i in range(3) for v, links in enumerate(hub_graph(20, random.Random(3))) for w in links]
    found = {r.id: r.betweenness for r in centrality(spark.createDataFrame([(x,) for x in sorted({x for e in few for x in e})], "id string"), spark.createDataFrame(few, "in_id string, out_id string")).collect()}
    names = sorted(found)
    want = brandes([sorted(names.index(b) for a, b in few if a == x) for x in names], list(range(len(names))))[0]
    assert [found[x] for x in names] == [round(x / (len(names) - 1) / (len(names) - 2), 9) for x in want]


def test_centrality(spark):
    nodes = spark.createDataFrame([(x,) for x in ["a", "b", "c", "d", None, "a"]], "id string")
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), ("c", "c"), ("c", "gone"), (None, "a")], "in_id string, out_id string")
    got = {r.id: (r.betweenness, r.closeness) for r in centrality(nodes, edges).collect()}
    assert got == {"a": (0.0, round(2 / 3 * 2 / 3, 9)), "b": (round(1 / 6, 9), round(1 / 3, 9)), "c": (0.0, 0.0), "d": (0.0, 0.0)}
    assert centrality(nodes.limit(0), edges).collect() == []
