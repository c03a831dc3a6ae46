"""Queries of the general problems: histories (p2), hierarchies (p5) and orphan references (p6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from taleweave.functions.links import canonical_certainty, canonical_link, link_key, micros
from taleweave.operators import hierarchy, history, orphans
from taleweave.sources.tables import table


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    knows = table(spark, sf, "knows").select(
        F.concat_ws("|", canonical_link(F.col("in_id")), canonical_link(F.col("out_id"))).alias("entity"),
        F.coalesce(micros(F.col("learned_at")), micros(F.col("created_at"))).alias("at_us"),
        micros(F.col("created_at")).alias("said_us"),
        canonical_certainty(F.col("certainty")).alias("payload"),
        F.col("id").alias("tie"),
        F.year("created_at").alias("snapshot"),  # the ledger as its yearly deliveries
    )
    v = history.versions([knows])
    pair = F.split("entity", r"\|")
    return v.select(
        pair[0].alias("in_id"), pair[1].alias("out_id"), F.col("payload").alias("certainty"), "valid_from_us", "valid_to_us"
    )


def _statements(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf, "locations").select(
        canonical_link(F.col("id")).alias("id"),
        canonical_link(F.col("parent")).alias("parent"),
        micros(F.col("updated_at")).alias("said_us"),
        F.lit(0).alias("rank"),
    )
    updates = (
        table(spark, sf, "location_updates")
        .where(F.array_contains("fields_set", "parent"))
        .select(
            canonical_link(F.col("location_id")).alias("id"),
            canonical_link(F.col("parent")).alias("parent"),
            micros(F.col("updated_at")).alias("said_us"),
            F.lit(1).alias("rank"),
        )
    )
    return rows, updates


def _forest(spark: SparkSession, sf: str) -> DataFrame:
    rows, updates = _statements(spark, sf)
    newest = hierarchy.newest_parents(rows.unionByName(updates))
    return newest.join(rows.select("id").distinct(), "id", "left_semi")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.resolve(_forest(spark, sf)).select("id", "root_id", "depth")


def p5_paths(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.resolve(_forest(spark, sf), with_paths=True).select("id", "root_id", "depth", "path")


def p5_descendants(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.descendants(hierarchy.resolve(_forest(spark, sf), with_paths=True))


#: table, field, target table
REFERENCES = (
    ("scenes", "event", "timeline_events"),
    ("scenes", "primary_location", "locations"),
    ("knowledge", "character", "characters"),
)


def _references(spark: SparkSession, sf: str) -> DataFrame:
    """All references to check, with ``field`` as ``table/field``."""
    created = F.col("created_at")
    return _union(
        [
            table(spark, sf, name).select(
                F.lit(f"{name}/{field}").alias("field"),
                canonical_link(F.col("id")).alias("record_id"),
                link_key(F.col(field)).alias("key"),
                micros(created).alias("created_us"),
                F.date_format(created, "yyyy-MM").alias("period"),
            )
            for name, field, _ in REFERENCES
        ]
    )


def _states(spark: SparkSession, sf: str) -> DataFrame:
    gone = table(spark, sf, "deletion_log").select(
        link_key(F.col("entity_id")).alias("key"), micros(F.col("deleted_at")).alias("deleted_us")
    )

    def of(target: str) -> DataFrame:
        rows = table(spark, sf, target).select(link_key(F.col("id")).alias("key"), micros(F.col("created_at")).alias("created_us"))
        return orphans.target_states(rows, gone)

    return _union([of(target).withColumn("field", F.lit(f"{name}/{field}")) for name, field, target in REFERENCES])


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _named() -> list:
    return [F.substring_index("field", "/", 1).alias("table_name"), F.substring_index("field", "/", -1).alias("field_name")]


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    found = orphans.orphan_references(_references(spark, sf), _states(spark, sf))
    return found.select(*_named(), "record_id").distinct()


def p6_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Orphan links per table, field, month of created_at and reason; repeated rows count once."""
    counts = orphans.orphan_counts(_references(spark, sf).distinct(), _states(spark, sf))
    return counts.select(*_named(), "period", "reason", "n_links")


def queries() -> dict:
    return {
        "p2_found": p2_found,
        "p5_found": p5_found,
        "p5_paths": p5_paths,
        "p5_descendants": p5_descendants,
        "p6_found": p6_found,
        "p6_counts": p6_counts,
    }


def _key(c: str) -> str:
    return f"string_split(replace(replace(replace(lower(trim({c})), '⟨', ''), '⟩', ''), ' ', ''), ':')[-1]"


def _link(c: str) -> str:
    k = _key(c)
    return (
        f"CASE WHEN {c} IS NULL THEN NULL ELSE CASE left({k}, 1) WHEN 'c' THEN 'character' WHEN 'l' THEN 'location' "
        f"WHEN 'e' THEN 'event' WHEN 's' THEN 'scene' WHEN 'k' THEN 'knowledge' ELSE 'knows' END || ':' || {k} END"
    )


_P2 = f"""
WITH said AS (
  SELECT {_link('in_id')} AS i, {_link('out_id')} AS o, epoch_us(coalesce(learned_at, created_at)) AS t,
         epoch_us(created_at) AS said, id,
         CASE replace(replace(replace(lower(trim(certainty)), ' ', ''), '-', ''), '_', '')
              WHEN 'believeswrongly' THEN 'believes_wrongly' ELSE lower(trim(certainty)) END AS c
  FROM knows WHERE certainty IS NOT NULL),
one AS (SELECT i, o, t, last(c ORDER BY said, id) AS c FROM said GROUP BY i, o, t),
chg AS (SELECT *, lag(c) OVER (PARTITION BY i, o ORDER BY t) AS p FROM one)
SELECT i AS in_id, o AS out_id, c AS certainty, t AS valid_from_us,
       coalesce(lead(t) OVER (PARTITION BY i, o ORDER BY t), -1) AS valid_to_us
FROM chg WHERE p IS NULL OR p <> c
"""

_FOREST = f"""
WITH RECURSIVE st AS (
  SELECT {_link('id')} AS id, {_link('parent')} AS parent, updated_at AS t, 0 AS r FROM locations
  UNION ALL
  SELECT {_link('location_id')}, {_link('parent')}, updated_at, 1 FROM location_updates
  WHERE list_contains(fields_set, 'parent')),
nw AS (SELECT id, last(parent ORDER BY t, r, coalesce(parent, '')) AS parent FROM st GROUP BY id),
n AS (SELECT id, CASE WHEN parent IN (SELECT {_link('id')} FROM locations) THEN parent END AS parent
      FROM nw WHERE id IN (SELECT {_link('id')} FROM locations)),
down AS (SELECT id, id AS root_id, 0::BIGINT AS depth, id AS path FROM n WHERE parent IS NULL
         UNION ALL
         SELECT n.id, d.root_id, d.depth + 1, d.path || '/' || n.id FROM n JOIN down d ON n.parent = d.id),
lost AS (SELECT * FROM n WHERE id NOT IN (SELECT id FROM down)),
walk AS (SELECT id AS start, parent AS pos FROM lost
         UNION
         SELECT w.start, l.parent FROM walk w JOIN lost l ON w.pos = l.id),
ring AS (SELECT start AS id FROM walk WHERE start = pos),
looped AS (SELECT w.start AS id, min(w.pos) AS root_id FROM walk w JOIN ring ON w.pos = ring.id GROUP BY 1)
"""


def _p6(t: str, f: str, target: str) -> str:
    return f"""
SELECT '{t}' AS table_name, '{f}' AS field_name, r.record_id, strftime(r.created_at, '%Y-%m') AS period, r.k, r.created_at,
       CASE WHEN s.k IS NULL THEN 'missing' WHEN d.gone > s.hi THEN 'deleted' WHEN s.lo > r.created_at THEN 'later' END AS reason
FROM (SELECT DISTINCT id AS record_id, {_key(f)} AS k, created_at FROM {t} WHERE {f} IS NOT NULL) r
LEFT JOIN (SELECT {_key('id')} AS k, min(created_at) AS lo, max(created_at) AS hi FROM {target} GROUP BY 1) s ON r.k = s.k
LEFT JOIN (SELECT {_key('entity_id')} AS k, max(deleted_at) AS gone FROM deletion_log GROUP BY 1) d ON r.k = d.k
"""


def oracle_sql() -> dict[str, str]:
    orphan = " UNION ALL ".join(_p6(*r) for r in REFERENCES)
    both = "SELECT id, root_id, depth, path FROM down UNION ALL SELECT id, root_id, -1, NULL FROM looped"
    return {
        "p2_found": _P2,
        "p5_found": f"{_FOREST} SELECT id, root_id, depth FROM ({both})",
        "p5_paths": f"{_FOREST} {both}",
        "p5_descendants": f"""{_FOREST}, u AS (
            SELECT id AS descendant, depth, unnest(string_split(path, '/')) AS id, generate_subscripts(string_split(path, '/'), 1) AS pos FROM down)
            SELECT id, descendant, depth - pos + 1 AS distance FROM u WHERE pos <= depth""",
        "p6_found": f"SELECT DISTINCT table_name, field_name, record_id FROM ({orphan}) WHERE reason IS NOT NULL",
        "p6_counts": f"""SELECT table_name, field_name, period, reason, count(*) AS n_links FROM ({orphan})
            WHERE reason IS NOT NULL GROUP BY ALL""",
    }
