import re
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from taleweave.functions.models import embed, hash_vector
from taleweave.operators import mutations
from taleweave.plans.registry import run
from taleweave.sources.documents import export_world, import_section
from taleweave.streaming import upkeep

SF = "/root/testdata/sf0.001"
FAST = ["lookup", "knowledge_at_event", "dramatic_irony", "narrative_tensions", "graph_traversal", "connection_paths", "arc_drift", "keyword_search", "perception_matrix", "location_current", "token_budget", "phases"]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", FAST)
def test_operation_against_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    cur = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    tidy = lambda rows: sorted(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in rows)
    assert tidy(run(spark, SF, name).select(*columns).collect()) == tidy(cur.fetchall())


def test_no_limits_by_modulo():
    for text in Path(entry.__file__).parent.glob("taleweave/plans/operations.py"):
        assert not re.search(r"TABLESAMPLE|rand\(", text.read_text())


def test_create_update_delete(spark):
    like = "id string, name string, parent string, created_at timestamp, updated_at timestamp"
    t = spark.createDataFrame([("l1", "A", None, None, None), ("l2", "B", "l1", None, None), ("l3", "C", None, None, None)], like)
    new = spark.createDataFrame([("l2", "B2"), ("l4", "D"), (None, "E")], "id string, name string")
    made = mutations.create(t, new, "error")
    assert made.table.count() == 4 and {r.message for r in made.issues.collect()} == {"id is missing", "id exists"}
    merged = {r.id: (r.name, r.parent) for r in mutations.create(t, new, "update").table.collect()}
    assert merged == {"l1": ("A", None), "l2": ("B2", "l1"), "l3": ("C", None), "l4": ("D", None)}
    assert mutations.create(t, new, "skip").table.count() == 4
    events = spark.createDataFrame([("e1", None)], "id string, title string")
    scenes = spark.createDataFrame([("s1", "e1", "l3", ["l2", "l3"]), ("s2", "e2", None, ["l2"])], "id string, event string, primary_location string, secondary_locations array<string>")
    characters = spark.createDataFrame([("c1",), ("c2",)], "id string")
    knowledge = spark.createDataFrame([("k1", "c1"), ("k2", "c2")], "id string, character string")
    ids = spark.createDataFrame([("l1",), ("l2",), ("l3",), ("e1",), ("c1",), (None,)], "id string")
    d = mutations.delete(characters, t, events, scenes, knowledge, ids)
    assert {(r.id, r.why) for r in d.rejected.collect()} == {("l1", "in use"), ("l3", "in use")}
    assert {r.id for r in d.locations.collect()} == {"l1", "l3"} and d.events.count() == 0
    assert [tuple(r) for r in d.scenes.collect()] == [("s2", "e2", None, [])] and [r.id for r in d.knowledge.collect()] == ["k2"]


def test_record_knowledge(spark):
    knows = spark.read.parquet(f"{SF}/knows.parquet")
    events = spark.read.parquet(f"{SF}/timeline_events.parquet").select("id", "created_at")
    e = events.first()
    rows = spark.createDataFrame([("knows:w1", "character:c1", "knowledge:k1", "certain", "direct", e.id, None), ("knows:w2", "character:c1", "knowledge:k2", "wrong", None, None, None)],
                                 "id string, in_id string, out_id string, certainty string, learning_method string, event string, truth_value string").withColumn("at", F.lit("2024-01-01").cast("timestamp_ntz"))
    c = mutations.record_knowledge(knows, rows, events)
    got = {r.id: r for r in c.table.where("id in ('knows:w1', 'knows:w2')").collect()}
    assert got["knows:w1"].certainty == "knows" and got["knows:w1"].learning_method == "told" and got["knows:w1"].learned_at == e.created_at
    assert got["knows:w2"].certainty == "believes_wrongly" and got["knows:w2"].learning_method == "discovered"
    assert c.issues.count() == 2


def test_links_and_latest(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c")], "note string, entity string")
    more = spark.createDataFrame([("a", "c"), ("d", "e"), ("d", "e")], "note string, entity string")
    assert mutations.link(edges, more).count() == 3 and mutations.unlink(edges, more).count() == 1
    log = spark.createDataFrame([("x", 1, "old"), ("x", 2, "new"), ("y", 1, "only")], "id string, at int, v string")
    assert {(r.id, r.v) for r in mutations.latest(log, ["id"], "at").collect()} == {("x", "new"), ("y", "only")}


def test_debounce_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    (tmp_path / "in").mkdir()
    events.coalesce(1).write.parquet(str(tmp_path / "in" / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in" / "e"))
    q = upkeep.debounce(stream, "user_id", "ts", "event_id").writeStream.format("memory").queryName("kept").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.row_id for r in spark.sql("SELECT row_id FROM kept").collect()}
    assert got == {r.event_id for r in run(spark, SF, "debounced_events").collect()}


def test_regenerate_appends_only_changes(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    rows = lambda r: spark.createDataFrame(r, "id string, composite_text string, at timestamp_ntz")
    from datetime import datetime as dt

    def go():
        upkeep.regenerate(spark.readStream.schema("id string, composite_text string, at timestamp_ntz").parquet(src), embed, out, str(tmp_path / "cp")).awaitTermination(120)

    rows([("a", "one two", dt(2024, 1, 1)), ("b", "three", dt(2024, 1, 1))]).write.parquet(src)
    go()
    rows([("a", "one two", dt(2024, 1, 2)), ("b", "four", dt(2024, 1, 2))]).write.mode("append").parquet(src)
    go()
    got = {(r.id, r.at.day): r.delta for r in spark.read.parquet(out).collect()}
    assert set(got) == {("a", 1), ("b", 1), ("b", 2)} and got["b", 1] is None and got["b", 2] > 0


def test_export_import_round_trip(spark, tmp_path):
    counts = {r.section: r.n for r in export_world(spark, SF, str(tmp_path)).collect()}
    t = spark.read.parquet(f"{SF}/characters.parquet")
    assert counts["characters"] == t.select("id").distinct().count()
    back = import_section(spark, f"{tmp_path}/characters", t)
    assert back.dtypes == t.dtypes and back.count() == counts["characters"]
    a, b = t.select("id", "name", F.to_json("profile"), "embedding").distinct(), back.select("id", "name", F.to_json("profile"), "embedding")
    assert a.exceptAll(b).isEmpty()


def test_hash_vector():
    assert hash_vector(None) is None and hash_vector("...") is None
    v = hash_vector("a b c")
    assert v == hash_vector("A b, c!") and abs(sum(x * x for x in v) - 1) < 1e-5
