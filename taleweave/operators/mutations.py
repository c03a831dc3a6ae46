"""Changes to the world as functions from tables to tables; a caller writes the result.

A mutation never updates in place: appends are unions, updates a join with the new fields, deletions
anti-joins. Checks come back as rows of issues (severity critical, warning or info) beside the result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from taleweave.functions.links import canonical_certainty

# Synonyms of the ways of learning; anything else counts as discovered.
METHODS = {"told": "told", "direct": "told", "overheard": "overheard", "witnessed": "witnessed", "discovered": "discovered", "deduced": "deduced", "read": "read", "remembered": "remembered", "initial": "initial"}


@dataclass
class Changed:
    table: DataFrame
    issues: DataFrame


def create(table: DataFrame, rows: DataFrame, mode: str = "error", now: str = "current_timestamp()") -> Changed:
    """Add entities. ``mode`` for ids that exist: 'error' (an issue, the row is not added), 'skip', or
    'update' (non-null fields replace). Of rows with one id the first by all columns counts; rows
    without an id are issues. Missing columns become null."""
    for c, t in table.dtypes:
        if c not in rows.columns:
            value = F.expr(now) if c in ("created_at", "updated_at") else F.lit(None)
            rows = rows.withColumn(c, value.cast(t))
    rows = rows.select(*[F.col(c).cast(t) for c, t in table.dtypes])
    bad = rows.where("id is null").select(F.lit(None).cast("string").alias("id"), F.lit("critical").alias("severity"), F.lit("id is missing").alias("message"))
    rows = rows.where("id is not null").dropDuplicates(["id"])
    fresh = rows.join(table.select("id").distinct(), "id", "left_anti").select(*table.columns)
    known = rows.join(table.select("id").distinct(), "id", "left_semi").select(*table.columns)
    if mode == "update":
        return Changed(update(table, known).unionByName(fresh), bad)
    if mode == "error":
        bad = bad.unionByName(known.select("id", F.lit("critical").alias("severity"), F.lit("id exists").alias("message")))
    return Changed(table.unionByName(fresh), bad)


def update(table: DataFrame, fields: DataFrame) -> DataFrame:
    """Replace by every non-null field of ``fields`` (one row per id)."""
    new = fields.select(F.col("id"), *[F.col(c).alias(f"_{c}") for c in fields.columns if c != "id" and c in table.columns])
    given = [c for c in table.columns if f"_{c}" in new.columns]
    joined = table.join(new, "id", "left")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in given else F.col(c) for c in table.columns])


@dataclass
class Deletion:
    characters: DataFrame
    locations: DataFrame
    events: DataFrame
    scenes: DataFrame
    knowledge: DataFrame
    rejected: DataFrame


def delete(characters: DataFrame, locations: DataFrame, events: DataFrame, scenes: DataFrame, knowledge: DataFrame, ids: DataFrame, protected: DataFrame | None = None) -> Deletion:
    """Delete ``ids`` (id) with referential actions: knowledge goes with its character, scenes with their
    event; a location that is a primary location or a parent is rejected; secondary locations are
    unset. Protected ids are rejected."""
    ids = ids.where("id is not null").select("id").distinct()
    used = scenes.select(F.col("primary_location").alias("id")).union(locations.select(F.col("parent").alias("id"))).where("id is not null").distinct()
    used = used.join(locations.select("id").distinct(), "id", "left_semi")
    rejected = ids.join(used, "id", "left_semi").withColumn("why", F.lit("in use"))
    if protected is not None:
        rejected = rejected.unionByName(ids.join(protected.select("id"), "id", "left_semi").withColumn("why", F.lit("protected"))).dropDuplicates(["id"])
    gone = ids.join(rejected.select("id"), "id", "left_anti")
    left = lambda t: t.join(gone, "id", "left_anti").select(*t.columns)
    lost_events = events.join(gone, "id", "left_semi").select(F.col("id").alias("event"))
    kept = left(scenes).join(lost_events, "event", "left_anti").select(*scenes.columns)
    loose = kept.select("id", F.explode("secondary_locations").alias("l")).join(gone.withColumnRenamed("id", "l"), "l", "left_semi").groupBy("id").agg(F.collect_set("l").alias("_lost"))
    kept = kept.join(loose, "id", "left").withColumn("secondary_locations", F.when(F.col("_lost").isNull(), F.col("secondary_locations")).otherwise(F.array_except("secondary_locations", "_lost")))
    orphaned = knowledge.join(gone.withColumnRenamed("id", "character"), "character", "left_anti")
    return Deletion(left(characters), left(locations), left(events), kept.select(*scenes.columns), left(orphaned.select(*knowledge.columns)), rejected)


def record_knowledge(knows: DataFrame, entries: DataFrame, events: DataFrame) -> Changed:
    """Append beliefs (id, in_id, out_id, certainty, learning_method, event, truth_value, at). Synonyms
    are resolved; learned_at is the event's time, else ``at``. Nothing is blocked: a method other than
    initial without an event, and a wrong belief without its truth, are infos."""
    method = F.coalesce(F.create_map(*[F.lit(x) for kv in METHODS.items() for x in kv])[F.lower("learning_method")], F.lit("discovered"))
    when = events.groupBy(F.col("id").alias("event")).agg(F.max("created_at").alias("_at"))
    rows = entries.join(when, "event", "left").withColumn("certainty", canonical_certainty(F.col("certainty"))).withColumn("learning_method", method)
    rows = rows.withColumn("learned_at", F.coalesce("_at", "at")).withColumn("created_at", F.col("at")).withColumn("updated_at", F.col("at"))
    checks = F.array(
        F.when((F.col("learning_method") != "initial") & F.col("event").isNull(), "no event"),
        F.when((F.col("certainty") == "believes_wrongly") & F.col("truth_value").isNull(), "no truth value"),
    )
    issues = rows.select("id", F.lit("info").alias("severity"), F.explode(F.array_compact(checks)).alias("message"))
    for c, t in knows.dtypes:
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast(t))
    return Changed(knows.unionByName(rows.select(*[F.col(c).cast(t) for c, t in knows.dtypes])), issues)


def link(edges: DataFrame, rows: DataFrame) -> DataFrame:
    """Add edges that do not exist yet."""
    return edges.unionByName(rows.select(*edges.columns).join(edges, edges.columns, "left_anti").distinct())


def unlink(edges: DataFrame, rows: DataFrame) -> DataFrame:
    return edges.join(rows.distinct(), rows.columns, "left_anti").select(*edges.columns)


def latest(log: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Latest row per key of an append-only log (annotations, decisions, protections); ties go to the
    larger row by all columns."""
    order = [F.desc(at), *[F.desc(c) for c in log.columns if c not in keys and c != at]]
    w = Window.partitionBy(*keys).orderBy(*order)
    return log.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
