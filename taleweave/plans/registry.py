"""Operations by name: ``run(spark, sf_dir, name, **parameters)`` gives a DataFrame."""

from __future__ import annotations

import re
import uuid
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from taleweave.functions.models import embed, hash_vector, tag_names
from taleweave.operators.betweenness import centrality
from taleweave.plans.dialect import Duck, Spark
from taleweave.plans.operations import OPS, WHAT_IF, _graded, irony_known, tension_steps, tensions
from taleweave.plans import upkeep_operations  # noqa: F401 - registers its operations
from taleweave.plans.shared import cut
from taleweave.plans.world import raw_tables, views, with_views
from taleweave.sources.tables import table


#: Views that are written once per query if it would read them this often.
WRITTEN, MENTIONS = ("knows_", "held_", "perceives_", "relates_", "involved_", "scenes_", "participates_", "applies_", "edges_", "entity_", "focus_", "other_"), 3


def run(spark: SparkSession, sf_dir: str, name: str, **parameters) -> DataFrame:
    """The operation's result. Only the tables it names are opened. A view that the plan would repeat is written to
    the shared folder first, so the ledger is read once for it; nothing else is executed yet."""
    if name in PLAIN:
        return PLAIN[name](spark, sf_dir, **parameters)
    return query(spark, sf_dir, OPS[name](Spark(), **parameters))


def query(spark: SparkSession, sf_dir: str, sql: str, steps: dict[str, str] | None = None) -> DataFrame:
    """Spark SQL over the stored tables and the world's views; ``steps``: the SQL of further tables, by the names
    (ending in _) under which ``sql`` and later steps read them, written first."""
    d, steps = Spark(), steps or {}
    sql = d.numbers(sql)
    all_ = views(d)
    for text in (*steps.values(), sql):
        for t in raw_tables(with_views(d, text)):
            table(spark, sf_dir, t).createOrReplaceTempView(t)
    written = repeated(" ".join([*steps.values(), sql]), all_)
    stored: dict[str, str] = {}
    for v, text in [*((v, f"SELECT * FROM {v}") for v in all_ if v in written), *steps.items()]:
        df = cut(spark.sql(with_views(d, text, stored)), v.strip("_"))
        stored[v] = f"written_{v}{uuid.uuid4().hex}"
        df.createOrReplaceTempView(stored[v])
    try:
        return spark.sql(with_views(d, sql, stored))
    finally:
        for v in stored.values():  # the plan has what it needs of them
            spark.catalog.dropTempView(v)


def repeated(sql: str, all_: dict[str, str]) -> set[str]:
    """Views to write: those that ``sql`` would read MENTIONS times or more, counting one read for each written view."""
    count = lambda v, text: len(re.findall(rf"\b{v}\b", text))
    reads: dict[str, int] = {}
    for v in reversed(list(all_)):
        reads[v] = count(v, sql) + sum(count(v, all_[u]) * (min(n, 1) if u in WRITTEN and n >= MENTIONS else n) for u, n in reads.items() if n)
    return {v for v, n in reads.items() if v in WRITTEN and n >= MENTIONS}


def _both_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(query(spark, sf_dir, "SELECT in_id AS a, out_id AS b FROM edges_ UNION SELECT out_id, in_id FROM edges_"), "both")


def graph_traversal(spark: SparkSession, sf_dir: str, start: str | None = None, depth: int = 2) -> DataFrame:
    """Breadth-first: characters within ``depth`` undirected hops of ``start`` (by default the one with most ledger
    rows), with the fewest hops. The edges are written once and read once a level; what was seen is taken out."""
    edges = _both_ways(spark, sf_dir)
    first = query(spark, sf_dir, "SELECT id FROM focus_") if start is None else spark.createDataFrame([(start,)], "id string")
    seen = cut(first.select("id", F.lit(0).alias("hops")), "level0")
    for h in range(1, depth + 1):
        level = seen.where(F.col("hops") == h - 1).select(F.col("id").alias("a"))
        found = edges.join(level, "a", "left_semi").select(F.col("b").alias("id")).distinct().join(seen, "id", "left_anti")
        seen = seen.unionByName(cut(found.select("id", F.lit(h).alias("hops")), f"level{h}"))
    return seen.where("hops > 0")


def impact(spark: SparkSession, sf_dir: str, start: str | None = None, depth: int = 3) -> DataFrame:
    """How many entities a change reaches at each distance, with the severity of that distance."""
    n = graph_traversal(spark, sf_dir, start, depth).groupBy("hops").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))  # one row a level
    severity = F.when(F.col("hops") == 1, "high").when(F.col("hops") == 2, "medium").otherwise("low")
    return n.select("hops", "n", severity.alias("severity"), F.when(total > 10, "high").when(total > 3, "medium").otherwise("low").alias("overall"))


def irony_totals(spark: SparkSession, sf_dir: str, min_scenes: int = 3) -> DataFrame:
    """What characters know and those they perceive do not, summed up per pair of knower and unknower."""
    return query(spark, sf_dir, OPS["irony_totals"](Spark(), min_scenes), {"known_": irony_known(Spark(), min_scenes)})


def narrative_tensions(spark: SparkSession, sf_dir: str, min_severity: float = 0.0) -> DataFrame:
    """Pairs with signals of conflict, their mean weight and the severity."""
    return query(spark, sf_dir, tensions(min_severity), tension_steps())


def semantic_knowledge(spark: SparkSession, sf_dir: str, text: str = "the ransom was paid to the fleet", limit: int = 10) -> DataFrame:
    """The knowledge items whose fact's vector is most like that of a text (cosine; ties go to the smaller id)."""
    facts = query(spark, sf_dir, "SELECT id, owner, fact FROM knowledge_ WHERE fact IS NOT NULL")
    asked = hash_vector(text)
    if asked is None:
        return facts.select("id", "owner", F.lit(0.0).alias("score")).limit(0)
    score = F.aggregate(F.zip_with(embed("fact"), F.array(*[F.lit(x) for x in asked]), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)
    return facts.select("id", "owner", F.round(score, 6).alias("score")).where("score is not null").orderBy(F.desc("score"), "id").limit(limit)


def betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact betweenness and closeness over the distinct directed edges of the world."""
    return centrality(table(spark, sf_dir, "characters").select("id"), query(spark, sf_dir, "SELECT in_id, out_id FROM edges_"))


def annotate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that the tagger finds in scene summaries, counted per name and label."""
    scenes = table(spark, sf_dir, "scenes").where("summary is not null").select("id", "summary").distinct()
    found = scenes.select("id", F.explode(tag_names("summary")).alias("t"))
    return found.groupBy(F.col("t.text").alias("name"), F.col("t.label").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("n_scenes"))


def what_if(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each character's text vector would move if they learnt the newest fact."""
    c = table(spark, sf_dir, "characters").where("composite_text is not null").groupBy("id").agg(F.max("composite_text").alias("text"))
    fact = table(spark, sf_dir, "knowledge").agg(F.max_by("fact", F.struct("created_at", "id")).alias("fact"))
    both = c.crossJoin(F.broadcast(fact)).select("id", embed("text").alias("a"), embed(F.concat("text", F.lit(". Additionally, "), "fact")).alias("b"))
    dot = F.aggregate(F.zip_with("a", "b", lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)
    delta = F.round(1 - dot, 6)
    return both.select("id", delta.alias("delta")).withColumn("label", F.expr(Spark().numbers(_graded("delta", WHAT_IF))))


def theme_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Theme clusters by k-means over the vectors, k by the rule sqrt(n / 2)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    n = v.count()
    if n < 3:
        return spark.createDataFrame([], "cluster int, n long, labels string")
    k = max(2, min(n - 1, -(-int((n / 2) ** 0.5 * 1000) // 1000)))
    model = KMeans(k=k, maxIter=300, tol=1e-4, seed=42).fit(v)
    return model.transform(v).groupBy(F.col("prediction").alias("cluster")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set(F.col("label").cast("string"))), ",").alias("labels"))


PLAIN = {"graph_traversal": graph_traversal, "impact": impact, "irony_totals": irony_totals, "narrative_tensions": narrative_tensions, "semantic_knowledge": semantic_knowledge, "betweenness": betweenness, "annotate_names": annotate_names, "what_if": what_if, "theme_kmeans": theme_kmeans}


def queries() -> dict:
    return {name: partial(lambda spark, sf, n: run(spark, sf, n), n=name) for name in OPS} | PLAIN


def oracle_sql() -> dict[str, str]:
    return {name: with_views(Duck(), f(Duck())) for name, f in OPS.items()}
