import random
import unicodedata

import numpy as np
from hypothesis import given, settings, strategies as st

from taleweave.llm import encodings, leakage, mixing
from taleweave.llm.words import plain, word_spans, words

ITEM = " ".join(f"w{i}" for i in range(50))


def test_words_ignore_case_accents_and_the_invisible():
    assert words("É́tait­-il​ là, Straße_2?") == ["etait", "il", "la", "strasse", "2"]
    assert words("") == []


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aÉé́ß \n-_­​ﬂ1,", max_size=40))
def test_spans_agree_with_words(text):
    spans = word_spans(text)
    assert [w for w, _, _ in spans] == words(text)
    assert all(0 <= a < b <= len(text) for _, a, b in spans)


def by_hand(doc, item, window):
    d, i = words(doc), words(item)
    grams = {tuple(i[k : k + window]) for k in range(len(i) - window + 1)}
    return any(tuple(d[k : k + window]) in grams for k in range(len(d) - window + 1))


def test_leaks_against_brute_force(spark):
    rng = random.Random(5)
    items = [(k, " ".join(rng.choice(["ab", "cd", "ef", f"u{rng.randrange(60)}"]) for _ in range(45))) for k in range(6)] + [(9, "too short"), (10, None), (11, "")]
    docs = []
    for n in range(60):
        ws = [rng.choice(["ab", "cd", "ef", "zz"]) for _ in range(rng.randrange(0, 40))]
        k, a = rng.randrange(6), rng.randrange(20)
        part = words(items[k][1])[a : a + rng.choice([18, 19, 20, 21, 25])]
        at = rng.randrange(len(ws) + 1)
        docs.append((n, " ".join(ws[:at]) + "\n" + ", ".join(w.upper() for w in part) + ".\n" + " ".join(ws[at:])))
    docs += [(100, None), (101, ""), (102, "x " * 200_000 + items[0][1]), (103, items[0][1]), (103, items[0][1])]
    rows = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS item_id", "'x' AS n_words")
    got = leakage.leaks(rows, spark.createDataFrame(items + items[:1], "item_id long, text string")).collect()
    want = {(d, k) for d, t in docs if t for k, i in items if i and by_hand(t, i, 20)}
    assert {(r.doc_id, r.item_id) for r in got} == want
    text = dict(docs)
    for r in got:
        assert len(words(text[r.doc_id][r.start : r.end])) == r.n_words >= 20
    assert leakage.leaks(rows.limit(0), spark.createDataFrame(items, "item_id long, text string")).collect() == []


def test_many_items_take_several_automata(spark, monkeypatch):
    monkeypatch.setattr(leakage, "MAX_WORDS", 60)
    items = spark.createDataFrame([(k, " ".join(f"v{k}x{i}" for i in range(30))) for k in range(5)], "item_id long, text string")
    docs = items.selectExpr("item_id AS doc_id", "text")
    assert {(r.doc_id, r.item_id) for r in leakage.leaks(docs, items).collect()} == {(k, k) for k in range(5)}


def test_draw(spark):
    rng = random.Random(3)
    docs = [(i, "big", rng.randrange(1, 400)) for i in range(3000)] + [(5000 + i, "small", 100) for i in range(50)] + [(9000 + i, "other", 10) for i in range(5)] + [(9500, None, 5), (9501, "big", 0)]
    tokens = spark.createDataFrame(docs + docs[:10], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.3, 4), ("none", 0.1, 2), ("big", 0.6, 1), ("bad", None, 1)], "source string, target_share double, max_repeats int")
    drawn = mixing.draw(tokens, targets).collect()
    assert len({r.doc_id for r in drawn}) == len(drawn) and {r.source for r in drawn} == {"big", "small"}
    total = sum(r.n_tokens * r.copies for r in drawn)
    share = {s: sum(r.n_tokens * r.copies for r in drawn if r.source == s) / total for s in ("big", "small")}
    assert abs(share["big"] - 2 / 3) < 0.005 and abs(share["small"] - 1 / 3) < 0.005
    assert all(r.copies == 4 for r in drawn if r.source == "small") and all(r.copies == 1 for r in drawn if r.source == "big")
    again = mixing.draw(tokens.repartition(5), targets).collect()
    assert {tuple(r) for r in again} == {tuple(r) for r in drawn}
    other = mixing.draw(tokens, targets, seed=7).collect()
    assert {r.doc_id for r in other} != {r.doc_id for r in drawn}
    half = mixing.draw(tokens, targets, total=3000).collect()
    assert abs(sum(r.n_tokens * r.copies for r in half) - 3000) < 600
    assert mixing.draw(tokens.limit(0), targets).collect() == []


def test_tokens_and_shares(spark):
    docs = spark.createDataFrame([(1, "Scene Summary", "one two three"), (2, "scene-summary ", None), (3, "letter", ""), (4, "letter", "déjà vu " * 5000)], "doc_id long, source string, text string")
    n = {r.doc_id: r.n_tokens for r in mixing.with_tokens(docs).collect()}
    assert n[1] == 3 and n[2] == n[3] == 0 and n[4] > 10_000
    targets = spark.createDataFrame([("scene_summary", 0.5, 2), ("letter", 0.5, 1)], "source string, target_share double, max_repeats int")
    drawn, report = mixing.draw_and_report(docs, targets)
    assert {r.source for r in report.collect()} == {"scene_summary", "letter"}
    assert drawn.where("copies > 2").count() == 0


TEXT = {
    "en": "The scene turns on the mask: Koralia described it. “If the fleet had turned back,” Lunidôwen said—and left. It’s naïve. ",
    "fr": "Âgé de treize ans, l’élève a retrouvé un coffret doré à la tombée de la nuit ; où était-elle ? Ça va. ",
    "de": "Später prüfte Jörg die kupferne Maske in der Bücherstube, müde und übermütig. Für Öle zählt nur Äußeres. ",
    "es": "Según él, nadie había visto al señor en un año, ¿y así lo creyó la niña al día siguiente? ¡Corazón! ",
}


def fixture():
    rng = random.Random(1)
    docs, bad, n = [], {}, 0
    pairs = [("utf-8", e) for e in ("cp1252", "latin-1", "cp437", "mac_roman", "cp1250", "cp1251")] + [("cp1252", "cp1251"), ("cp1252", "mac_roman")]
    for lang, text in TEXT.items():
        for i in range(60):
            parts = text.replace(". ", ".|").split("|")
            t = "".join(rng.sample(parts, min(2, len(parts)))) * rng.randrange(1, 4)
            docs.append((n, t, lang if i % 9 else None))
            n += 1
    for lang, text in TEXT.items():
        for true, wrong in pairs:
            raw = text.encode(true)
            t = "".join((bytes([b]).decode(wrong) if wrong == "latin-1" or _ok(b, wrong) else chr(b)) for b in raw)
            docs.append((n, text + t, lang.upper()))
            bad[n] = text + text
            n += 1
        docs.append((n, text.encode("latin-1", "ignore").decode("utf-8", "replace"), lang))
        bad[n] = None
        n += 1
    clean = ["ΛΗΘΗ ΚΑΙ ΑΛΑΣ", "ТРИ КОЛОКОЛА", "╔═══╗ ║ ⚓ ║ ╚═══╝", "© 1887 ®", "ŁÓDŹ, ČAS, ĐURO", "Ærø", "the letter Ã was carved twice", unicodedata.normalize("NFD", TEXT["fr"]), TEXT["es"].encode("ascii", "ignore").decode(), "£12 ½", "", "ascii only", None]
    for t in clean:
        docs.append((n, None if t is None else TEXT["en"] + t, "en"))
        n += 1
    return docs, bad


def _ok(b, encoding):
    try:
        bytes([b]).decode(encoding)
        return True
    except UnicodeDecodeError:
        return False


def test_garbled_texts_are_found_and_restored(spark):
    docs, bad = fixture()
    rows = spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr("*", "1 AS pairs", "2 AS restored")
    got = {r.doc_id: r for r in encodings.garbled(rows).collect()}
    # No clean text is taken for garbled; a text with two garbled letters in a corpus this small may be missed.
    assert set(got) <= set(bad) and len(got) >= 0.95 * len(bad)
    whole = [k for k, t in bad.items() if t is not None and k in got]
    assert np.mean([got[k].restored == bad[k] for k in whole]) >= 0.9
    assert all("�" in got[k].restored for k, t in bad.items() if t is None and k in got)
    assert encodings.garbled(rows.limit(0)).collect() == []
    assert set(r.doc_id for r in encodings.garbled(rows.drop("lang")).collect()) <= set(bad)  # also without languages


def test_runs_garbled_in_part_are_cut():
    counts = [("fr", "a", "é", 500), ("fr", "^", "é", 20), ("fr", "l", "a", 400), ("fr", "l", "»", 60), ("fr", "a", "»", 60), ("fr", " ", "«", 90), ("fr", "p", "a", 200), ("fr", "p", " ", 200), ("fr", "l", " ", 100), ("fr", "l", ".", 50), ("fr", "a", "ascii", 9000), ("fr", " ", "ascii", 2000)]
    labels = encodings.Labels(encodings.Chain(counts))
    text = "il dit «le cafÃ©» au café."
    found = labels.label(text, "fr")
    assert [text[i:j] for i, j, _ in found] == ["Ã©"] and labels.restored(text, found) == "il dit «le café» au café."
    assert labels.label("il dit «le café» au café.", "fr") == []


def test_plain_of_long_text():
    assert len(plain("é" * 1_000_000)) == 1_000_000
