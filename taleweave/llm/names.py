"""Variant spellings of the names of persons and organisations, linked to one entity.

1. Every name and alias is parsed: titles, numbers and ``the Elder`` go to their own fields, order and
   case are undone, an organisation's kind is told from its core.
2. Each name becomes a vector of its character n-grams, weighted by their rarity among all names, in two
   parts: the core (family name, or what an organisation is called after) and the given name with its initial.
   A sparse similarity join finds the pairs of names: a prefix filter over the core's rarest grams finds all
   pairs of cores above a cosine, and of their names those that have a key of the given name in common get the
   cosine of the whole vectors. ``top`` keeps each name's best partners only; by default all are kept.
3. An exact check follows: few edits, or a short form of the given name; initials and pet names count only
   where they can mean one person.
4. The linked names form small groups, and average linkage over the cosines cuts each where two persons were
   chained.
"""

from __future__ import annotations

import heapq
import math
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window, functions as F

from taleweave.operators.components import components
from taleweave.plans.shared import cut

# Fixed values of the language the names are in.
TITLES = {"lord", "lady", "captain", "sister", "brother", "dame", "warden", "provost", "doctor", "magister", "sir", "dr", "capt", "mr", "mrs"}
KINDS = ("brotherhood", "circle", "company", "guild", "house", "order")
#: Endings of pet names.
PET_ENDINGS = ("", "y", "ie", "ey", "kin")
NUMBERS = {"i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x"}
AGES = {"elder", "younger"}

#: Least cosine of two cores and of two names, share of the core in a name's vector.
CORES, NAMES, CORE_SHARE = 0.35, 0.35, 0.7
#: Edits of two names, least average cosine within an entity.
EDITS, LINKAGE = 2, 0.3
#: Letters of a gram in the core and in the given name.
CORE_GRAM, GIVEN_GRAM = 4, 2

_TOKEN = regex.compile(r"[\p{L}\p{N}]+\.?")


@lru_cache(10_000)
def kind_of(token: str) -> str:
    """The kind of organisation that a word names: in full, or abbreviated to up to four of its letters in
    their order: its beginning, or its first letter and consonants or letters up to its last."""
    if token in KINDS:
        return token
    if not 2 <= len(token) <= 4:
        return ""
    for kind in KINDS:
        rest = iter(kind)
        if token[0] == kind[0] and all(c in rest for c in token) and (kind.startswith(token) or not set(token[1:]) & set("aeiou") or token[-1] == kind[-1]):
            return kind
    return ""


@lru_cache(100_000)
def parse(name: str) -> tuple[str, str, str, str] | None:
    """(kind, core, given, number): kind is empty for persons; None where there is no core to go by."""
    text = regex.sub(r"(\p{Ll})(\p{Lu})", r"\1 \2", name.replace("_", " "))
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).casefold()
    text = regex.sub(r"['’]s\b", " ", text)
    parts = [_TOKEN.findall(p) for p in text.split(",")]
    parts = [p for p in parts if p]
    tokens = [t for p in parts for t in p]
    bare = [t.rstrip(".") for t in tokens]
    if len(bare) < 2:
        return None
    # An abbreviation has a full stop, or stands beside ``of``; a kind in full needs neither.
    marked = [t for t, b in zip(tokens, bare) if kind_of(b) and (b in KINDS or t.endswith(".") or "of" in bare)]
    if len(marked) == 1 and (marked[0] in (tokens[0], tokens[-1]) or bare[0] == "the"):
        kind = marked[0].rstrip(".")
        core = "".join(t for t in bare if t != kind and t not in ("of", "the"))
        return (kind_of(kind), core, "", "") if core else None
    number = ""
    if len(bare) >= 3:
        for p in parts:
            if len(p) >= 2 and p[-1] in AGES and p[-2] == "the":
                number, p[-2:] = p[-1], []
            elif len(p) >= 1 and p[-1] in NUMBERS and sum(map(len, parts)) > 2:
                number, p[-1:] = p[-1], []
        parts = [p for p in parts if p]
    if len(parts) == 2:
        parts = [parts[1] + parts[0]]  # Family, Given
    tokens = [t for p in parts for t in p]
    if len(tokens) > 2 and tokens[0].rstrip(".") in TITLES:
        tokens = tokens[1:]
    if len(tokens) == 2 and len(tokens[1].rstrip(".")) == 1:
        tokens = tokens[::-1]  # Family I.
    tokens = [t.rstrip(".") for t in tokens]
    if len(tokens) < 2 or len(tokens[-1]) < 3:
        return None
    return "", tokens[-1], tokens[0], number


def edits(a: str, b: str, most: int = 3) -> int:
    """Insertions, deletions, replacements and swaps of neighbours between two words."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return row[-1]


def short(given: str) -> bool:
    return len(given) <= 4 or (given.endswith("kin") and len(given) <= 7)


def pet_name(pet: str, given: str) -> bool:
    """Whether ``pet`` is a short form of ``given``: its beginning with one of the usual endings or, of
    two letters or more, without one, its end (three letters or more), or its initial."""
    if len(pet) == 1:
        return given.startswith(pet)
    stems = [pet.removesuffix(e) for e in PET_ENDINGS if pet.endswith(e)]
    return any(x and given.startswith(x) for x in stems) or (len(pet) >= 3 and given.endswith(pet))


def similarity(a: tuple[str, str, str, str], b: tuple[str, str, str, str]) -> float:
    """Of two parsed names, 0 to 1; from 0.8 it holds by itself, below only if nobody else can be meant."""
    if a[0] != b[0] or a[3] != b[3]:
        return 0.0
    core = edits(a[1], b[1])
    if core > EDITS or (core > 1 and min(len(a[1]), len(b[1])) < 7):
        return 0.0
    if a[0]:
        return 1 - 0.05 * core
    p, q = sorted((a[2], b[2]), key=len)
    if short(p) and short(q):
        return 0.6 if core <= 1 and (p == q or (len(p) == 1 and q.startswith(p))) else 0.0
    if short(p):
        return 0.7 - 0.05 * core if core <= 1 and pet_name(p, q) else 0.0
    given = edits(p, q)
    if core + given > EDITS or (given > 1 and len(p) < 9):
        return 0.0
    return 1 - 0.05 * (core + given)


def similar_cores(cores: DataFrame, least: float = CORES) -> DataFrame:
    """Pairs (core, other, cosine) of different cores with a cosine of at least ``least``, both ways round: all that
    lie within EDITS edits."""
    n = max(cores.count(), 1)
    padded = F.concat(F.lit("^"), "core", F.lit("$"))
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(padded) - CORE_GRAM + 1))
    grams = cores.select("core", F.explode(F.transform(at, lambda i: F.substring(padded, i, F.lit(CORE_GRAM)))).alias("gram"))
    tf = grams.groupBy("core", "gram").count()
    df = tf.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    # A gram met in few cores is often a slip; it weighs no more than one met in five.
    weighed = tf.join(df, "gram").withColumn("w", F.col("count") * F.log(1 + n / F.greatest("df", F.lit(5))))
    norm = Window.partitionBy("core")
    weighed = weighed.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(norm)))
    rarest = Window.partitionBy("core").orderBy("df", "gram").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    # What is left from this gram on; once below the threshold, the grams met so far are needed in common. From
    # one gram to a pair's first in common, what both have left bounds their cosine.
    weighed = cut(weighed.withColumn("rest", F.sqrt(F.sum(F.col("w") * F.col("w")).over(rarest))), "grams")
    prefix = weighed.where(F.col("rest") >= least).select("core", "gram", "rest")
    # The exact check of names allows no more than EDITS edits, so cores of other lengths need no cosine; nor, below,
    # do cores farther apart than that (a swap of neighbours is one edit there and two here).
    near = F.abs(F.length("a.core") - F.length("b.core")) <= EDITS
    pairs = prefix.alias("a").join(prefix.alias("b"), "gram").where("a.core < b.core").where(near).groupBy(F.col("a.core").alias("x"), F.col("b.core").alias("y"))
    pairs = pairs.agg(F.max(F.col("a.rest") * F.col("b.rest")).alias("bound")).where(F.col("bound") >= least - 1e-9).where(F.levenshtein("x", "y", 2 * EDITS) >= 0).select("x", "y")
    w = weighed.select("core", "gram", "w")
    cos = (
        pairs.join(w.select(F.col("core").alias("x"), "gram", F.col("w").alias("wx")), "x")
        .join(w.select(F.col("core").alias("y"), "gram", F.col("w").alias("wy")), ["y", "gram"])
        .groupBy("x", "y")
        .agg(F.sum(F.col("wx") * F.col("wy")).alias("cosine"))
        .where(F.col("cosine") >= least)
    )
    return cos.select(F.col("x").alias("core"), F.col("y").alias("other"), "cosine").union(cos.select("y", "x", "cosine"))


def given_grams(given: str) -> list[str]:
    """The grams of a given name, with its initial, which counts twice."""
    padded = f"^{given}$"
    return [padded[i : i + GIVEN_GRAM] for i in range(max(1, len(padded) - GIVEN_GRAM + 1))] + ["^" + given[:1]] * 2


def given_weights(names: DataFrame) -> tuple[int, dict[str, int]]:
    """The number of distinct given names, and in how many of them each gram is. There are no more grams than
    pairs of letters, whatever the number of names."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found: dict[str, int] = {}
            for g in b["given"]:
                for x in set(given_grams(g)):
                    found[x] = found.get(x, 0) + 1
            yield pd.DataFrame({"gram": list(found), "df": list(found.values())})

    given = names.select("given").distinct()
    df = given.mapInPandas(go, "gram string, df long").groupBy("gram").agg(F.sum("df").alias("df")).collect()
    return given.count(), {r["gram"]: r["df"] for r in df}


def given_vector(given: str, n: int, df: dict[str, int]) -> dict[str, float]:
    v: dict[str, float] = {}
    for g in given_grams(given):
        v[g] = v.get(g, 0.0) + math.log(1 + n / max(df.get(g, 0), 5))
    size = math.sqrt(sum(w * w for w in v.values()))
    return {g: w / size for g, w in v.items()} if size else v


NAME = "kind string, core string, given string, number string"


def _parsed(rows: DataFrame) -> DataFrame:
    """id, form ('name' or 'alias'), and the parsed parts; names without a core are left out."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, f, t in zip(b["id"], b["form"], b["text"]):
                if (p := parse(t)) is not None:
                    out.append((i, f, *p))
            yield pd.DataFrame(out, columns=["id", "form", "kind", "core", "given", "number"])

    names = rows.select("id", F.lit("name").alias("form"), F.col("name").alias("text"))
    aliases = rows.select("id", F.lit("alias").alias("form"), F.explode("aliases").alias("text"))
    return names.unionByName(aliases).where("id is not null and text is not null").distinct().mapInPandas(go, f"id string, form string, {NAME}")


def _scored(shared):
    """x, y and the cosine of their cores to the cosine of the names and the score of the exact check."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, df = shared.value
        vector = lru_cache(100_000)(lambda given: given_vector(given, n, df))
        for b in batches:
            out = []
            for x, y, cosine in zip(b["x"], b["y"], b["cosine"]):
                p, q = tuple(x.split("|")), tuple(y.split("|"))
                if not p[0]:
                    v, w = vector(p[2]), vector(q[2])
                    cosine = CORE_SHARE * cosine + (1 - CORE_SHARE) * sum(a * w.get(g, 0.0) for g, a in v.items())
                if cosine >= NAMES and (s := similarity(p, q)) > 0:
                    out.append((x, y, s, round(1000 * min(cosine, 1.0))))
            yield pd.DataFrame(out, columns=["x", "y", "s", "cosine"])

    return go


def _linkage(pdf: pd.DataFrame) -> pd.DataFrame:
    """Average linkage within one group of names (component, node, the similar nodes as lists of (node, cosine
    in thousandths), and the known pairs as lists), of any size.

    A pair of names that are not similar counts 0 where they tell two persons apart, and not at all where they
    say nothing of each other: a short form beside a name it does not shorten, or an alias beside spellings of
    the true name. Only groups with a similar pair are held; how many of the other pairs count is found when two
    groups merge. Cosines are whole thousandths, so sums are exact and ties go to the first names.
    """
    nodes = sorted(pdf["node"])
    place = {v: i for i, v in enumerate(nodes)}
    parsed = [tuple(v.split("|")) for v in nodes]
    #: Of two groups, by their first names: thousandths, and the pairs that count.
    sums: list[dict[int, tuple[int, int]]] = [{} for _ in nodes]
    near: set[tuple[str, str]] = set()
    for v, others in zip(pdf["node"], pdf["alike"]):
        for o in others if others is not None else ():
            if o["y"] in place:
                i, j = place[v], place[o["y"]]
                sums[i][j] = sums[j][i] = (int(o["cosine"]), 1)
                near |= {(parsed[i][1], parsed[j][1]), (parsed[j][1], parsed[i][1])}
    for v, others in zip(pdf["node"], pdf["known"]):
        for o in others if others is not None else ():
            if o in place and o != v:
                sums[place[v]][place[o]] = sums[place[o]][place[v]] = (1000, 1)
    groups = {i: [i] for i in range(len(nodes))}
    silent = [short(p[2]) for p in parsed]

    def counting(x: int, y: int) -> int:
        n = 0
        for i in groups[x]:
            a = parsed[i]
            for j in groups[y]:
                b = parsed[j]
                n += a[0] != b[0] or a[3] != b[3] or not (silent[i] or silent[j] or (a[1] != b[1] and (a[1], b[1]) not in near))
        return n

    heap = [(-t / n, i, j, t, n) for i, row in enumerate(sums) for j, (t, n) in row.items() if i < j and t > 1000 * LINKAGE * n]
    heapq.heapify(heap)
    while heap:
        _, x, y, *was = heapq.heappop(heap)
        if x not in groups or y not in groups or sums[x].get(y) != tuple(was):
            continue
        for c in (sums[x].keys() | sums[y].keys()) - {x, y}:
            (t, n), (u, m) = (sums[g].get(c) or (0, counting(g, c)) for g in (x, y))
            sums[x][c] = sums[c][x] = (t + u, n + m)
            sums[c].pop(y, None)
            if t + u > 1000 * LINKAGE * (n + m):
                heapq.heappush(heap, (-(t + u) / (n + m), min(x, c), max(x, c), t + u, n + m))
        sums[x].pop(y)
        sums[y] = {}
        groups[x] += groups.pop(y)
    entity = {nodes[i]: nodes[g] for g, members in groups.items() for i in members}
    return pd.DataFrame({"node": nodes, "entity": [entity[v] for v in nodes]})


def _key():
    return F.concat_ws("|", "kind", "core", "given", "number")


def entities(rows: DataFrame, top: int | None = None) -> DataFrame:
    """id and the entity its name belongs to (a name's parsed form), one row per id and entity.

    ``rows``: id, name string, aliases array<string>. Null names, null aliases and names without two
    words (epithets) link nothing. Repeated rows count once; an id with several names belongs to the
    entity of each. Names that are the same after case, accents, title, order and punctuation are one
    name, however many ids have it. Empty input gives no rows; other columns are ignored. With ``top`` a name
    is compared with its ``top`` partners of highest cosine only (ties go to the smaller name).
    """
    parsed = cut(_parsed(rows.select("id", "name", "aliases")).withColumn("node", _key()), "parsed")
    names = parsed.where("form = 'name'")
    nodes = names.select("node", "kind", "core", "given", "number").distinct()
    alias = parsed.where("form = 'alias'").select("id", "node", "kind", "core", "given", "number")
    near = cut(similar_cores(parsed.select("core").distinct()), "cores")
    near = near.union(parsed.select("core", F.col("core").alias("other"), F.lit(1.0).alias("cosine")).distinct())
    # Names to compare: similar cores, and of the given name the first letter, the ending or, where both may be
    # slips, three letters after it in common. Two names within EDITS edits or one a short form of the other do.
    g = F.col("given")
    ends = F.array(F.left(g, F.lit(1)), F.concat(F.lit("$"), F.right(g, F.lit(3))))
    inner = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.concat(F.lit("~"), F.substring(g, i, F.lit(3))))
    ends = F.array_distinct(F.when(F.length(g) >= 8, F.concat(ends, inner)).otherwise(ends))
    left = nodes.unionByName(alias.drop("id")).distinct().withColumn("end", F.explode(ends)).join(near, "core").select("node", "other", "end", "kind", "number", "cosine")
    right = nodes.withColumn("end", F.explode(ends)).select(F.col("node").alias("to"), F.col("core").alias("other"), "end", "kind", "number")
    pairs = left.join(right, ["other", "end", "kind", "number"]).where("node <> to").select(F.col("node").alias("x"), F.col("to").alias("y"), "cosine").distinct()
    weights = pairs.sparkSession.sparkContext.broadcast(given_weights(parsed))
    scored = pairs.mapInPandas(_scored(weights), "x string, y string, s double, cosine int")
    if top is not None:
        best = Window.partitionBy("x").orderBy(F.desc("cosine"), "y")
        scored = scored.withColumn("place", F.row_number().over(best)).where(F.col("place") <= top).drop("place")
    scored = cut(scored, "scored")
    named = nodes.select("node")
    between = scored.join(named.withColumnRenamed("node", "x"), "x", "left_semi")
    strong = between.where(F.col("s") >= 0.8).select("x", "y")
    # What an alias says in full, or letter by letter, is said of the alias's bearer.
    said = alias.select("id", F.col("node").alias("alias")).join(names.select("id", F.col("node").alias("own")), "id")
    exact = said.join(named.withColumnRenamed("node", "alias"), "alias").select(F.col("own").alias("x"), F.col("alias").alias("y"))
    close = said.join(scored.where(F.col("s") >= 0.8).select(F.col("x").alias("alias"), "y"), "alias").select(F.col("own").alias("x"), "y")
    known = exact.union(close).where("x <> y").distinct()
    # A pet name that several bearers' aliases spell tells nothing.
    pets = F.length(F.split("y", r"\|")[2]) <= 7
    base = components(strong.union(known.where(~pets)).toDF("a", "b"))
    of = base.select(F.col("node").alias("v"), "component")
    w = Window.partitionBy("y")

    def single(links: DataFrame) -> DataFrame:
        """Links from short forms (y) that lead to one person only."""
        led = links.join(of.withColumnRenamed("v", "x"), "x", "left").withColumn("to", F.coalesce("component", "x"))
        spread = led.withColumn("least", F.min("to").over(w)).withColumn("most", F.max("to").over(w))
        return spread.where("least = most").select("x", "y")

    by_alias = single(known.where(pets))
    weak = between.where((F.col("s") < 0.8) & (F.length(F.split("y", r"\|")[2]) < F.length(F.split("x", r"\|")[2])))
    # Where a short form has bearers of exactly its core, those of similar cores are no candidates.
    core = lambda c: F.split(c, r"\|")[1]
    same = (core("x") == core("y")).cast("int")
    weak = weak.withColumn("same", same).withColumn("any", F.max("same").over(w)).where("same = any")
    weak = weak.join(by_alias.select("y"), "y", "left_anti").select("x", "y")
    given = F.split("x", r"\|")[2]
    long_ = weak.where(~((F.length(given) <= 4) | (given.endswith("kin") & (F.length(given) <= 7))))
    links = strong.union(known.where(~pets)).union(by_alias).union(single(long_)).distinct()
    links = cut(links.toDF("a", "b"), "namelinks")
    groups = components(links)
    told = known.select(F.col("x").alias("node"), F.col("y").alias("o")).union(known.select("y", "x")).groupBy("node").agg(F.collect_set("o").alias("known"))
    alike = between.groupBy(F.col("x").alias("node")).agg(F.collect_list(F.struct("y", "cosine")).alias("alike"))
    # A group is one task; the groups are spread over all tasks, however few bytes they have.
    spread = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = groups.join(told, "node", "left").join(alike, "node", "left").repartition(spread, "component")
    linked = spread.groupBy("component").applyInPandas(_linkage, "node string, entity string")
    return names.select("id", "node").distinct().join(linked, "node", "left").select("id", F.coalesce("entity", "node").alias("entity")).distinct()


def variants(rows: DataFrame, top: int | None = None) -> DataFrame:
    """Pairs of ids of one entity: id_a < id_b, every pair of a group once."""
    e = cut(entities(rows, top), "entities")
    b = e.select(F.col("id").alias("id_b"), "entity")
    return e.withColumnRenamed("id", "id_a").join(b, "entity").where("id_a < id_b").select("id_a", "id_b").distinct()
