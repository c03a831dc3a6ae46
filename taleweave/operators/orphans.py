"""References to records that do not exist, are deleted, or came into being only later.

One split serves all fields and both results:

1. References are pre-aggregated per field, key and period, so what is exchanged is one row per key and
   period instead of one per reference.
2. Keys that hold a large share of a field's references (a third of all rows may link to one place) are
   checked by a broadcast whose size is bounded by the definition of heavy: at most ``1 / share`` keys reach
   ``share`` of all references.
3. The remaining keys are taken out by a shuffled anti-join with the records that were there at the time.
4. Both sides' orphans are united. A key whose first record came within the period is settled reference by
   reference, which is one period of a key at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from taleweave.plans.shared import cut

#: A key is heavy if it has at least this share of a field's references: at most 1000 keys a field.
HEAVY_SHARE = 0.001


def target_states(targets: DataFrame, deletions: DataFrame) -> DataFrame:
    """One row per key of ``targets``: first and last creation and last deletion.

    ``targets``: key string, created_us long. ``deletions``: key string, deleted_us long. Null keys
    are left out; null times are ignored.
    """
    t = (
        targets.where("key is not null")
        .groupBy("key")
        .agg(F.min("created_us").alias("first_us"), F.max("created_us").alias("last_us"))
    )
    d = deletions.where("key is not null").groupBy("key").agg(F.max("deleted_us").alias("deleted_us"))
    return t.join(d, "key", "left")


def _groups(refs: DataFrame, states: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Groups of orphans (field, key, period, n, reason, first_us), of heavy keys and of the rest, and the heavy
    keys (field, key). Of a group whose reason is ``partly`` the references before first_us are orphans."""
    per = refs.groupBy("field", "key", "period").agg(
        F.count(F.lit(1)).alias("n"), F.min("created_us").alias("lo"), F.max("created_us").alias("hi")
    )
    per = cut(per, "references")
    totals = {r["field"]: r["n"] for r in per.groupBy("field").agg(F.sum("n").alias("n")).collect()}  # one row a field
    limit = F.coalesce(*[F.when(F.col("field") == f, F.lit(n * HEAVY_SHARE)) for f, n in totals.items()], F.lit(0.0))
    keys = per.groupBy("field", "key").agg(F.sum("n").alias("n"))
    heavy = cut(keys.where(F.col("n") >= limit).select("field", "key"), "heavy")
    states = states.withColumn("known", F.lit(True))
    reason = (
        F.when(F.col("known").isNull(), "missing")
        .when(F.col("deleted_us") > F.col("last_us"), "deleted")
        .when(F.col("first_us") > F.col("hi"), "later")
        .when(F.col("first_us") > F.col("lo"), "partly")
    )
    out = ["field", "key", "period", "n", F.col("reason"), "first_us"]
    # Heavy keys: at most 1 / HEAVY_SHARE a field, with one state each.
    heavy_states = F.broadcast(heavy).join(states, ["field", "key"], "left")
    hot = per.join(F.broadcast(heavy_states), ["field", "key"]).withColumn("reason", reason).where("reason is not null")
    # The rest: whatever has a record, and had it before its first reference, goes.
    there = states.where("deleted_us is null or last_us is null or deleted_us <= last_us").select(
        F.col("field").alias("f"), F.col("key").alias("k"), F.col("first_us").alias("from_us")
    )
    alive = (F.col("field") == F.col("f")) & (F.col("key") == F.col("k")) & ~F.coalesce(F.col("from_us") > F.col("lo"), F.lit(False))
    rest = per.join(F.broadcast(heavy), ["field", "key"], "left_anti").join(there, alive, "left_anti")
    rest = rest.join(states, ["field", "key"], "left").withColumn("reason", reason).where("reason is not null")
    return hot.select(*out), rest.select(*out), heavy


def _settled(refs: DataFrame, groups: DataFrame) -> DataFrame:
    """The single references of groups of orphans."""
    partly = F.col("reason") == "partly"
    g = groups.select(
        F.col("field").alias("f"), F.col("key").alias("k"), F.col("period").alias("p"), F.when(partly, "later").otherwise(F.col("reason")).alias("reason"), F.when(partly, F.col("first_us")).alias("before_us")
    )
    same = (F.col("field") == F.col("f")) & (F.col("key") == F.col("k")) & F.col("period").eqNullSafe(F.col("p"))
    return refs.join(g, same).where("before_us is null or created_us < before_us")


def _prepared(refs: DataFrame, states: DataFrame) -> tuple[DataFrame, DataFrame]:
    field = F.col("field") if "field" in refs.columns else F.lit("")
    period = F.col("period") if "period" in refs.columns else F.lit(None).cast("string")
    record = F.col("record_id") if "record_id" in refs.columns else F.lit(None).cast("string")
    refs = refs.where("key is not null").select(field.alias("field"), record.alias("record_id"), "key", period.alias("period"), "created_us")
    field = F.col("field") if "field" in states.columns else F.lit("")
    return refs, states.select(field.alias("field"), "key", "first_us", "last_us", "deleted_us")


def orphan_references(refs: DataFrame, states: DataFrame) -> DataFrame:
    """Orphans among ``refs``: field, record_id, key, created_us, reason ('missing', 'deleted' or 'later').

    ``refs``: record_id string, key string, created_us long and, if there are, period string and field string;
    ``states``: as ``target_states`` gives them, with field if ``refs`` has it. Null keys are no references. A
    reference without created_us can be missing or deleted, never too early. Repeated references
    come out once. Empty ``states`` makes every reference an orphan; other columns are ignored.
    """
    refs, states = _prepared(refs, states)
    hot, rest, heavy = _groups(refs, states)
    columns = ["field", "record_id", "key", "created_us", "reason"]
    some = refs.join(F.broadcast(heavy), ["field", "key"], "left_semi")
    found = _settled(some, hot).select(*columns).unionByName(_settled(refs, rest).select(*columns))
    return found.distinct()


def orphan_counts(refs: DataFrame, states: DataFrame) -> DataFrame:
    """Orphans per field, period and reason, counted from the groups: field, period, reason, n_links. Input as
    for ``orphan_references``; every row of ``refs`` counts."""
    refs, states = _prepared(refs, states)
    hot, rest, heavy = _groups(refs, states)
    groups = hot.unionByName(rest)
    columns = ["field", "period", "reason", "n"]
    whole = groups.where("reason <> 'partly'").select(*columns)
    single = F.lit(1).cast("long").alias("n")
    # One period of a key at most is partly there: of heavy keys 1 / HEAVY_SHARE groups a field.
    some = _settled(refs.join(F.broadcast(heavy), ["field", "key"], "left_semi"), F.broadcast(hot.where("reason = 'partly'")))
    others = _settled(refs, rest.where("reason = 'partly'"))
    all_ = whole.unionByName(some.select("field", "period", "reason", single)).unionByName(others.select("field", "period", "reason", single))
    return all_.groupBy("field", "period", "reason").agg(F.sum("n").alias("n_links"))
