"""Operations against small worlds whose rows are worked out by hand or by brute force."""

import re
from datetime import datetime

import pytest

from taleweave.plans import operations
from taleweave.plans.dialect import Spark
from taleweave.plans.registry import query, run
from taleweave.plans.world import raw_tables, with_views

SF = "/root/testdata/sf0.001"


@pytest.fixture
def world(spark, tmp_path):
    """Writes tables from rows as dicts; columns that a row leaves out are null."""

    def write(**tables):
        for name, rows in tables.items():
            schema = spark.read.parquet(f"{SF}/{name}.parquet").schema
            spark.createDataFrame([tuple(r.get(c) for c in schema.names) for r in rows], schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def day(n):
    return datetime(2024, 1, n)


def witnessed(i, character, event, target="knowledge:k0001", **more):
    return {"id": f"knows:w{i}", "in_id": character, "out_id": target, "certainty": "knows", "learning_method": "witnessed", "event": event, "learned_at": day(1), "created_at": day(1)} | more


def test_timeline_violations(spark, world):
    a, b = "character:c000a", "character:c000b"
    sf = world(
        timeline_events=[{"id": f"event:e{n}", "title": f"E{n}", "sequence": 10 * n, "created_at": day(n)} for n in (1, 2, 3)],
        scenes=[{"id": "scene:s1a", "event": "event:e2", "created_at": day(2)}],
        knowledge=[{"id": "knowledge:k0001", "character": a, "fact": "x"}],
        part=[{"p_brand": "Brand#11", "p_type": "STEEL"}],
        # a is in the scene of e2, which precedes only e3; b witnessed it too but takes part in no scene.
        knows=[witnessed(1, a, "event:e1"), witnessed(2, a, "event:e2"), witnessed(3, a, "event:e3"), witnessed(4, b, "event:e2"), witnessed(5, b, "event:e3"), witnessed(6, a, None)],
    )
    assert [(r.id, r.in_id, r.event_id, r.gap) for r in run(spark, sf, "timeline_violations").collect()] == [("knows:w3", a, "event:e3", 10)]
    assert [tuple(r) for r in run(spark, sf, "entity_validation").where("check_name = 'timeline'").collect()] == [(a, "timeline", 1)]


def test_location_current_takes_every_spelling(spark, world):
    links = ["location:l00000001", "l00000002", "Location:l00000003", "location:⟨l00000004⟩", " location:l00000005", "location:L0000000A", "l00000099"]
    places = ["location:l00000001", "location:l00000002", "location:l00000003", "location:l00000004", "location:l00000005", "location:l0000000a"]
    sf = world(
        locations=[{"id": p, "name": "old", "loc_type": "town", "updated_at": day(1)} for p in places],
        location_updates=[{"location_id": x, "name": "new", "fields_set": ["name"], "updated_at": day(2)} for x in links],
    )
    assert sorted(tuple(r) for r in run(spark, sf, "location_current").collect()) == [(p, "new", "town") for p in places]


def test_knowledge_at_event_for_all_witnesses(spark):
    got = sorted(tuple(r) for r in run(spark, SF, "knowledge_at_event").collect())
    rows = spark.sql(with_views(Spark(), "SELECT k.*, e.created_at AS at FROM knows_ k LEFT JOIN events_ e ON e.id = k.event_id")).collect()
    want = set()
    for c, event, at in {(r.in_id, r.event_id, r.at) for r in rows if r.method == "witnessed" and r.at}:
        held = {}
        for r in sorted((r for r in rows if r.in_id == c and r.certainty and r.learned_at <= at), key=lambda r: (r.learned_at, r.created_at, r.id)):
            held[r.out_id] = r.certainty
        want |= {(c, event, target, certainty) for target, certainty in held.items()}
    assert len({r[0] for r in got}) > 2 and got == sorted(want)


def test_theme_clusters_measure_from_the_mean(spark):
    labels = {}
    for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect():
        labels.setdefault(r.label, []).append((r.vec_id, r.embedding))
    want = {}
    for label, members in labels.items():
        centre = [sum(xs) / len(members) for xs in zip(*(v for _, v in members))]
        dist = {i: sum((x - y) ** 2 for x, y in zip(v, centre)) ** 0.5 for i, v in members}
        want[label] = (len(members), min(dist, key=lambda i: (dist[i], i)), sum(1 / (1 + x) for x in dist.values()) / len(members))
    got = {r.label: (r.n, r.most_central, r.centrality) for r in run(spark, SF, "theme_clusters").collect()}
    assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in want.items()}
    assert all(abs(got[k][2] - want[k][2]) < 2e-6 for k in want)


def rows_of(spark, sql):
    for t in raw_tables(whole := with_views(Spark(), sql)):
        spark.read.parquet(f"{SF}/{t}.parquet").createOrReplaceTempView(t)
    return [tuple(r) for r in spark.sql(whole).collect()]


def walks(near, path, hops):
    """All simple paths on from ``path`` of at most ``hops`` further steps."""
    if len(path) > 1:
        yield path
    if hops:
        for x in near.get(path[-1], set()) - set(path):
            yield from walks(near, (*path, x), hops - 1)


def by_start(pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
    return near


def test_connection_paths_of_three_hops_and_shared_events(spark):
    (start,), (end,) = rows_of(spark, "SELECT id FROM focus_ UNION ALL SELECT id FROM other_")
    seen = rows_of(spark, "SELECT in_id, out_id FROM perceives_")
    witnesses = by_start(rows_of(spark, "SELECT out_id, in_id FROM involved_"))
    told = {(a, b) for a, b in seen} | {(b, a) for a, b in seen}
    shared = {(a, b) for who in witnesses.values() for a in who for b in who if a != b}
    for events, edges in ((True, told | shared), (False, told)):
        want = sorted((len(p) - 1, ">".join(p)) for p in walks(by_start(edges), (start,), 3) if p[-1] == end)
        more = {} if events else {"include_events": False}
        assert sorted((r.hops, r.path) for r in run(spark, SF, "connection_paths", **more).collect()) == want
        assert max(h for h, _ in want) == 3


def test_influence_and_impact_of_three_hops(spark):
    ((start,),) = rows_of(spark, "SELECT id FROM focus_")
    scale = {"mentor": 1.0, "family": 1.0, "ally": 0.9, "friend": 0.9, "professional": 0.7, "rival": 0.4}
    factor = {(a, b): (0.7 if (t or 0) >= 7 else 1.0) * scale.get(kind, 0.85) for a, b, t, kind in rows_of(spark, "SELECT in_id, out_id, tension, rel_type FROM perceives_")}
    best = {}
    for p in walks(by_start(factor), (start,), 3):
        strength = {1: 1.0, 2: 0.6, 3: 0.3}[len(p) - 1]
        for pair in zip(p, p[1:]):
            strength *= factor[pair]
        # The fewest hops, then the strongest.
        best[p[-1]] = max(best.get(p[-1], (-9, 0.0)), (1 - len(p), strength))
    got = {r.id: (-r.hops, r.strength, r.label) for r in run(spark, SF, "influence").collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in best.items()}
    assert all(abs(got[k][1] - best[k][1]) < 2e-6 for k in best) and {v[2] for v in got.values()} == {"direct", "likely", "possible"}

    edges = rows_of(spark, "SELECT in_id, out_id FROM edges_")
    near, hops, level = by_start(edges + [(b, a) for a, b in edges]), {start: 0}, {start}
    for h in (1, 2, 3):
        level = {b for a in level for b in near.get(a, ())} - hops.keys()
        hops |= dict.fromkeys(level, h)
    want = {(h, n, s) for h, s in ((1, "high"), (2, "medium"), (3, "low")) if (n := sum(x == h for x in hops.values()))}
    assert {(r.hops, r.n, r.severity) for r in run(spark, SF, "impact").collect()} == want and len(want) == 3


def test_irony_totals_without_pairing_beliefs_and_scenes(spark, world):
    a, b, c = "character:c000a", "character:c000b", "character:c0001"
    sf = world(
        scenes=[{"id": f"scene:s{i}", "created_at": at} for i, at in enumerate([*map(day, range(1, 7)), datetime(2024, 2, 1)])],
        knowledge=[{"id": "knowledge:k0028", "character": a, "fact": "x"}, {"id": "knowledge:k0002", "character": a, "fact": "y"}],
        part=[{"p_brand": "Brand#13", "p_type": "STEEL"}],  # governs k0028 strictly
        knows=[{"id": f"knows:w{i}", "in_id": x, "out_id": y, "certainty": z, "learned_at": day(n), "created_at": day(n)} for i, (x, y, z, n) in enumerate([
            (a, "knowledge:k0028", "knows", 1), (a, "knowledge:k0002", "knows", 3), (a, b, "knows", 1), (a, c, "knows", 1), (b, "knowledge:k0028", "suspects", 1)])],
    )
    got = run(spark, sf, "irony_totals")
    # After day 1 six scenes, after day 3 four. b holds k0028; a's tension with b is 8, with c none.
    assert sorted(tuple(r) for r in got.collect()) == [(a, c, 3, 2, 19.0), (a, b, 2, 1, 16.0)]
    for name in ("irony_totals", "scenes_since"):
        text = run(spark, sf, name)._jdf.queryExecution().toString()
        assert not re.search(r"created_at#\d+ > learned_at#\d+", text)
    assert not re.search(r"scenes_since#\d+", got._jdf.queryExecution().toString())  # beliefs summed up before they meet who is perceived


@pytest.mark.parametrize("pairs", [1, 4, 100_000])
def test_narrative_tensions_lists_the_pairs_of_hubs_once(spark, world, monkeypatch, pairs):
    monkeypatch.setattr(operations, "HUB_PAIRS", pairs)
    hubs, tellers = [f"character:c{x}" for x in ("0f00", "0f01", "0f02")], [f"character:c{i:04x}" for i in range(1, 30)]
    told = [(h, t) for i, h in enumerate(hubs) for t in tellers[i * 3 :]]
    rows = [{"id": f"knows:w{i}", "in_id": h, "out_id": "knowledge:k0001", "certainty": "uncertain", "source_character": t, "learned_at": day(1), "created_at": day(1)} for i, (h, t) in enumerate(told)]
    rows += [{"id": f"knows:v{i}", "in_id": t, "out_id": o, "certainty": c, "learned_at": day(1), "created_at": day(1)} for i, (t, o, c) in enumerate(
        [(a, b, "knows") for a in tellers[:6] for b in tellers[4:12]] + [(t, "knowledge:k0002", c) for t, c in zip(tellers, ["knows", "denies", "believes_wrongly"] * 3)])]
    sf = world(knows=rows)
    got = run(spark, sf, "narrative_tensions")
    want = query(spark, sf, operations.OPS["narrative_tensions"](Spark()))  # signal by signal
    assert got.dtypes == want.dtypes
    found = sorted(tuple(r) for r in got.collect())
    assert found == sorted(tuple(r) for r in want.collect()) and {r[3] for r in found} >= {"loyalty", "contradiction", "edge"} and max(r[2] for r in found) > 2
    plan = got._jdf.queryExecution().toString()
    assert "Window" in want._jdf.queryExecution().toString() and "Window" not in plan  # no pair is ranked or exchanged
    assert all(float(r[4]) >= 0.85 for r in run(spark, sf, "narrative_tensions", min_severity=0.85).collect())
