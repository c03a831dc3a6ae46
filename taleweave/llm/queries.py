"""Queries of the problems tagged llm, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from taleweave.llm import clusters, encodings, leakage, mixing, names, neighbours
from taleweave.sources.tables import table


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def _characters(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "characters")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.clusters(_characters(spark, sf)).select("id", "cluster_id")


def p1_clusters(spark: SparkSession, sf: str) -> DataFrame:
    rows = _characters(spark, sf)
    return clusters.describe(clusters.clusters(rows), rows)


def p1_leaves(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.leaves(clusters.clusters(_characters(spark, sf)))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return names.variants(_characters(spark, sf))


def p3_entities(spark: SparkSession, sf: str) -> DataFrame:
    return names.entities(_characters(spark, sf))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    n = neighbours.nearest(_characters(spark, sf))
    return n.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


def p4_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.nearest(_characters(spark, sf))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return p7_spans(spark, sf).select("doc_id", "item_id").distinct()


def p7_spans(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaks(_documents(spark, sf), table(spark, sf, "eval_items")).distinct()


def p8_draw(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.draw_and_report(_documents(spark, sf), table(spark, sf, "mix_targets"))[0]


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.draw_and_report(_documents(spark, sf), table(spark, sf, "mix_targets"))[1]


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return encodings.garbled(_documents(spark, sf)).select("doc_id").distinct()


def p9_restored(spark: SparkSession, sf: str) -> DataFrame:
    return encodings.garbled(_documents(spark, sf)).distinct()


def queries() -> dict:
    return {
        "p1_found": p1_found,
        "p1_clusters": p1_clusters,
        "p1_leaves": p1_leaves,
        "p3_found": p3_found,
        "p3_entities": p3_entities,
        "p4_found": p4_found,
        "p4_neighbours": p4_neighbours,
        "p7_found": p7_found,
        "p7_spans": p7_spans,
        "p8_draw": p8_draw,
        "p8_shares": p8_shares,
        "p9_found": p9_found,
        "p9_restored": p9_restored,
    }


def _plain(c: str) -> str:
    return f"regexp_extract_all(regexp_replace(strip_accents(lower(replace({c}, 'ß', 'ss'))), '[\\p{{M}}\\p{{Cf}}]', '', 'g'), '[\\p{{L}}\\p{{N}}]+')"


_P7 = f"""
WITH d AS (SELECT doc_id, {_plain('text')} AS w FROM (SELECT DISTINCT doc_id, text FROM documents) WHERE text IS NOT NULL),
e AS (SELECT item_id, {_plain('text')} AS w FROM eval_items),
ew AS (SELECT DISTINCT item_id, array_to_string(w[i:i+19], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 18)) AS i FROM e)),
dw AS (SELECT doc_id, array_to_string(w[i:i+19], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 18)) AS i FROM d))
SELECT DISTINCT doc_id, item_id FROM dw JOIN ew USING (g)
"""


# Brute force over all pairs, for small tables.
_USABLE = """u AS (SELECT DISTINCT id, embedding::DOUBLE[] AS v FROM characters WHERE len(embedding) = 384 AND len([x FOR x IN embedding IF x <> 0]) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.id, b.id AS other, max(round(list_cosine_similarity(a.v, b.v), 9)) AS score FROM u a JOIN u b ON a.id <> b.id GROUP BY a.id, b.id)"""
_P4 = f"""WITH {_USABLE}, n AS (SELECT id, other, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, other) AS r FROM s) WHERE r <= 5 AND score >= 0.7)"""
_P1 = f"""WITH RECURSIVE {_USABLE},
t AS (SELECT DISTINCT id, list_distinct(regexp_extract_all(lower(composite_text), '[\\p{{L}}\\p{{N}}]+')) AS w FROM characters WHERE composite_text IS NOT NULL),
link AS (SELECT id AS a, other AS b FROM s WHERE score >= 0.7 UNION
    SELECT x.id, y.id FROM t x JOIN t y ON x.id NOT IN (SELECT id FROM u) AND y.id IN (SELECT id FROM u) AND len(list_intersect(x.w, y.w)) > 0
    AND len(list_intersect(x.w, y.w)) >= 0.7 * (len(x.w) + len(y.w) - len(list_intersect(x.w, y.w)))),
both_ AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
walk AS (SELECT a, b FROM both_ UNION SELECT w.a, n.b FROM walk w JOIN both_ n ON n.a = w.b),
low AS (SELECT a AS id, least(a, min(b)) AS cluster_id FROM walk GROUP BY a)
SELECT id, cluster_id FROM (SELECT *, count(*) OVER (PARTITION BY cluster_id) AS n FROM low) WHERE n >= 3"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _P1,
        "p4_neighbours": f"{_P4} SELECT id, other, score FROM n",
        "p4_found": f"{_P4} SELECT DISTINCT least(id, other) AS id_a, greatest(id, other) AS id_b FROM n",
        "p7_found": _P7,
    }
