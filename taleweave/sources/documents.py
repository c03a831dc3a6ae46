"""World documents: import and export of a whole world as one document per entity (JSON lines or YAML)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

SECTIONS = ("characters", "locations", "timeline_events", "scenes", "knowledge")


def export_world(spark: SparkSession, sf_dir: str, out: str) -> DataFrame:
    """Write every section as JSON lines under ``out/<section>``; gives section and number of entities.
    Repeated rows count once."""
    counts = None
    for s in SECTIONS:
        t = spark.read.parquet(f"{sf_dir}/{s}.parquet")
        maps = [c for c, k in t.dtypes if k.startswith("map")]
        for c in maps:
            t = t.withColumn(c, F.to_json(c))
        t.distinct().write.mode("overwrite").json(f"{out}/{s}")
        n = t.groupBy(F.lit(s).alias("section")).agg(F.countDistinct("id").alias("n"))
        counts = n if counts is None else counts.unionByName(n)
    return counts


def import_section(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """Read a section back in the columns and types of ``like``; unreadable lines fail the read."""
    maps = {c: k for c, k in like.dtypes if k.startswith("map")}
    schema = ", ".join(f"`{c}` {'string' if c in maps else k}" for c, k in like.dtypes)
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    for c, k in maps.items():
        rows = rows.withColumn(c, F.from_json(c, k))
    return rows.select(*like.columns)


def import_yaml(spark: SparkSession, path: str, section: str, like: DataFrame) -> DataFrame:
    """A hand-written YAML document is small by nature: it is parsed on the driver. Unknown fields are
    ignored, missing ones null. Needs the optional ``yaml`` module."""
    import yaml

    with open(path, encoding="utf-8") as f:
        doc = yaml.safe_load(f) or {}
    rows = [{c: r.get(c) for c in like.columns} for r in doc.get(section) or []]
    return spark.createDataFrame(rows, like.schema)
