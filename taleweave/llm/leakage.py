"""Evaluation passages inside documents, found by one Aho-Corasick automaton.

An item's words are cut into blocks of ``window // 2`` words at fixed places. Any ``window`` words in
a row contain a whole block, so the automaton over all blocks misses nothing, and it is twenty times
smaller than one over all windows. Each document is normalised and scanned once; a hit is extended
word by word in both directions, and counts if at least ``window`` words in a row agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame

from taleweave.llm.words import word_spans, words

#: Words of items per automaton (about 100 bytes each); more items are scanned for in several passes.
MAX_WORDS = 2_000_000

SPANS = "doc_id long, item_id long, n_words int, start int, end int"

_built: dict[int, tuple] = {}


def _automaton(items: list[tuple[int, list[str]]], block: int) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    at: dict[str, list[tuple[int, int]]] = {}
    for k, (_, ws) in enumerate(items):
        for j in range(0, len(ws) - block + 1, block):
            at.setdefault(f" {' '.join(ws[j : j + block])} ", []).append((k, j))
    for key, places in at.items():
        a.add_word(key, (len(key), places))
    a.make_automaton()
    return a


def runs(ws: list[str], items: list[tuple[int, list[str]]], automaton: ahocorasick.Automaton, window: int) -> list[tuple[int, int, int]]:
    """Maximal agreeing runs of at least ``window`` words: (place in items, first word, words)."""
    line = f" {' '.join(ws)} "
    starts = None
    done: dict[tuple[int, int], int] = {}
    found = []
    for end, (length, places) in automaton.iter(line):
        if starts is None:
            starts, p = {}, 0
            for n, w in enumerate(ws):
                starts[p] = n
                p += len(w) + 1
        at = starts[end + 1 - length]
        for k, j in places:
            if done.get((k, at - j), -1) > at:
                continue  # within a run of this item at this offset that is known
            item, lo, hi = items[k][1], 0, 0
            while at - lo > 0 and j - lo > 0 and ws[at - lo - 1] == item[j - lo - 1]:
                lo += 1
            while at + hi < len(ws) and j + hi < len(item) and ws[at + hi] == item[j + hi]:
                hi += 1
            done[(k, at - j)] = at + hi
            if lo + hi >= window:
                found.append((k, at - lo, lo + hi))
    return found


def leaks(documents: DataFrame, items: DataFrame, window: int = 20) -> DataFrame:
    """Each passage of an item in a document: doc_id, item_id, n_words, and its place [start, end) in
    the document's original text.

    ``documents``: doc_id, text. ``items``: item_id, text; repeated items with one text count once.
    Null and empty texts and items of fewer than ``window`` words match nothing; texts of any length
    are scanned whole. Repeated documents give repeated rows; other columns are ignored. The items
    are held-out tests, sent to every task in automata of at most ``MAX_WORDS`` words.
    """
    spark = documents.sparkSession
    block = window // 2
    batch: list[tuple[int, list[str]]] = []
    batches, size = [batch], 0
    for r in items.where("text is not null").select("item_id", "text").distinct().orderBy("item_id").toLocalIterator():
        ws = words(r["text"])
        if len(ws) < window:
            continue
        if size + len(ws) > MAX_WORDS and batch:
            batches.append(batch := [])
            size = 0
        batch.append((r["item_id"], ws))
        size += len(ws)
    out = None
    for b in batches:
        shared = spark.sparkContext.broadcast(b)
        found = documents.select("doc_id", "text").mapInPandas(_scan(shared, block, window), SPANS)
        out = found if out is None else out.unionByName(found)
    return out


def _scan(shared, block: int, window: int):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        key = (shared.id if hasattr(shared, "id") else id(shared), os.getpid())
        if key not in _built:
            _built.clear()
            _built[key] = (shared.value, _automaton(shared.value, block))
        items, automaton = _built[key]
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                if not text or not items:
                    continue
                hit = runs(words(text), items, automaton, window)
                if hit:
                    spans = word_spans(text)
                    rows += [(doc, items[k][0], n, spans[at][1], spans[at + n - 1][2]) for k, at, n in hit]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "n_words", "start", "end"])

    return scan
