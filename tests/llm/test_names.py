import random

import pandas as pd

from taleweave.llm import names


def test_parse():
    for text in ["Koralia Malmelbosbol", "KORALIA  MALMELBOSBOL", "Malmelbosbol, Koralia", "Sister Koralia Malmelbosbol", "Koralia_Malmelbosbol", "KoraliaMalmelbosbol", "Kóralia Beliloleth Malmelbosbol"]:
        assert names.parse(text) == ("", "malmelbosbol", "koralia", ""), text
    assert names.parse("Malmelbosbol K.") == names.parse("K. Malmelbosbol") == ("", "malmelbosbol", "k", "")
    assert names.parse("Bo Tarn II") == ("", "tarn", "bo", "ii") and names.parse("Bo Tarn the Elder") == ("", "tarn", "bo", "elder")
    assert names.parse("Company of Panjun") == names.parse("Panjun's Company") == names.parse("Co. Panjun") == ("company", "panjun", "", "")
    assert names.parse("Saltfinger") is None and names.parse("") is None


def test_edits():
    assert names.edits("abc", "acb") == 1 and names.edits("abc", "abc") == 0 and names.edits("", "ab") == 2 and names.edits("abcdef", "x") > 3


CASES = [
    ("a1", "Elaritus Dilvarirlar", ["The Late Heir"]), ("a2", "Dilvarirlar, Elaritus", None), ("a3", "E. Dilvarirlar", []), ("a4", "Elaritsu Dilvarirlar", []),
    ("b1", "Damamira Dilvarirlar", ["The Late Heir"]),
    ("c1", "Gwandoric Juslolgalmin the Elder", None), ("c2", "Gwandoric Juslolgalmin the Younger", None), ("c3", "Gwandoric Juslolgalmin III", []), ("c4", "Lord Gwan Juslolgalmin the Elder", None),
    ("d1", "House of Kantonkankar", None), ("d2", "HOUSE OF KANTONCANKAR", None), ("d3", "Guild of Kantonkankar", None), ("d4", "Ulilomond Kantonkankar", None),
    ("e1", "Sevarimira Busnendeñvil", ["Two-Bells", "Wynolunette izerleszer"]), ("e2", "Wynolunette Vizerleszer", []), ("e3", "Sevkin Busnendenvil", []),
    ("f1", "Alevemond Tarbolsin", None), ("f2", "Anoraline Tarbolsin", None), ("f3", "A. Tarbolsin", None), ("g1", None, None), ("g2", "Saltfinger", None), ("g3", "", [None, ""]), (None, "E. Dilvarirlar", None),
]
GROUPS = [{"a1", "a2", "a3", "a4"}, {"c1", "c4"}, {"d1", "d2"}, {"e1", "e2", "e3"}]


def test_variants(spark):
    df = spark.createDataFrame(CASES + CASES[:3], "id string, name string, aliases array<string>").selectExpr("*", "1 AS core", "2 AS kind", "3 AS entity")
    got = {(r.id_a, r.id_b) for r in names.variants(df).collect()}
    assert got == {(a, b) for g in GROUPS for a in g for b in g if a < b}
    assert names.variants(df.limit(0)).collect() == []


def test_kinds_and_short_forms():
    assert [names.kind_of(t) for t in ("guild", "gld", "ord", "co", "hse", "bhd", "bo", "koralia", "lord")] == ["guild", "guild", "order", "company", "house", "brotherhood", "", "", ""]
    assert names.pet_name("kor", "koralia") and names.pet_name("korkin", "koralia") and names.pet_name("cy", "caelidowen") and names.pet_name("ria", "damaria")
    assert not names.pet_name("kor", "damaria") and not names.pet_name("ia", "damaria") and names.pet_name("d", "damaria")


def test_top_keeps_the_best_partners(spark):
    df = spark.createDataFrame(CASES, "id string, name string, aliases array<string>")
    few, all_ = ({(r.id_a, r.id_b) for r in names.variants(df, top).collect()} for top in (1, None))
    assert few and all_ == {(a, b) for g in GROUPS for a in g for b in g if a < b}


def test_similar_cores_are_all_found(spark):
    cores = ["dilvarirlar", "dilvarirlr", "dilvrairlar", "kantonkankar", "kantoncankar", "malmelbosbol", "xy", "x"]
    got = {(r.core, r.other) for r in names.similar_cores(spark.createDataFrame([(c,) for c in cores], "core string")).collect()}
    assert {("dilvarirlar", "dilvarirlr"), ("dilvarirlar", "dilvrairlar"), ("kantonkankar", "kantoncankar")} <= got and ("dilvarirlar", "malmelbosbol") not in got
    assert {(b, a) for a, b in got} == got


def frame_of(nodes):
    """Names with the similar ones among them, their similarity standing in for the cosine."""
    parsed = [tuple(n.split("|")) for n in nodes]
    by = {}
    for i, p in enumerate(parsed):  # two given names within two edits have a letter of the first three in common
        for c in set(p[2][:3]):
            by.setdefault(c, []).append(i)
    alike = [[] for _ in nodes]
    for i, p in enumerate(parsed):
        for j in {j for c in set(p[2][:3]) for j in by[c]} if p[2] else range(len(nodes)):
            if i != j and (v := names.similarity(p, parsed[j])) > 0:
                alike[i].append({"y": nodes[j], "cosine": round(1000 * v)})
    return pd.DataFrame({"component": "x", "node": nodes, "known": None, "alike": alike})


def test_a_large_chain_is_cut_like_a_small_one():
    # Each given name differs from the one before in one letter: neighbours are alike, the ends are not.
    rng, given, chain = random.Random(1), list("abcdefghijkl"), []
    for i in range(2_000):
        given[i % 12] = rng.choice("abcdefghijklmnopqrstuvwxyz")
        chain.append("".join(given))
    nodes = sorted({f"|malmelbosbol|{g}|" for g in chain})
    assert len(nodes) > 1_500

    def grouped(part):
        got = names._linkage(frame_of(part))
        return got.groupby("entity")["node"].apply(list).tolist()

    groups = grouped(nodes)
    assert 1 < len(groups) and max(map(len, groups)) < 20
    # Each entity holds by itself: average linkage of its names alone joins them all.
    assert all(len(grouped(g)) == 1 for g in groups)


def test_linkage_equals_all_pairs():
    rng = random.Random(3)
    letters = "abcd"
    for _ in range(15):
        cores = ["".join(rng.choice(letters) for _ in range(8)) for _ in range(2)]
        slip = lambda t: t if rng.random() < 0.4 else (lambda i: t[:i] + rng.choice(letters) + t[i + 1:])(rng.randrange(len(t)))
        nodes = sorted({f"|{slip(slip(rng.choice(cores)))}|{rng.choice(['koralia', 'koralai', 'kor', 'k', 'korkin', 'damamira', ''])}|" for _ in range(30)})
        parsed = [tuple(n.split("|")) for n in nodes]
        value = {}
        alike_cores = {(a[1], b[1]) for a in parsed for b in parsed if names.similarity(a, b)}
        for i, a in enumerate(parsed):
            for j, b in enumerate(parsed):
                v = names.similarity(a, b)
                if v or not (names.short(a[2]) or names.short(b[2]) or (a[1] != b[1] and (a[1], b[1]) not in alike_cores)):
                    value[i, j] = round(1000 * v)
        groups = [[i] for i in range(len(nodes))]
        while True:
            found = []
            for x in range(len(groups)):
                for y in range(x + 1, len(groups)):
                    told = [value[i, j] for i in groups[x] for j in groups[y] if (i, j) in value]
                    if told and sum(told) > 1000 * names.LINKAGE * len(told):
                        found.append((-sum(told) / len(told), x, y))
            if not found:
                break
            _, x, y = min(found)
            groups[x] += groups.pop(y)
        got = names._linkage(frame_of(nodes))
        want = {nodes[i]: nodes[g[0]] for g in groups for i in g}
        assert dict(zip(got["node"], got["entity"])) == want
