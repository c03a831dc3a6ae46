"""Text decoded with the wrong character encoding: found and restored with a hidden Markov model.

States: one clean state, one for characters that are lost for good (U+FFFD), and one per pair (true
encoding, wrong encoding). Only runs of characters beyond ASCII tell the states apart, so they are
the observations. The clean state emits a run by a chain over characters; the state of a pair emits
what the pair's inverse transform makes of the run by the same chain, so nothing but clean text has
to be learnt. A run that is garbled in part is cut where its characters' best labels change. The Viterbi path
labels the runs' characters; every span of one state gets its inverse transform.

The chain is learnt from the documents themselves in rounds: counts over all documents, labelling,
counts over what then counts as clean or restored. Garbled text in the first counts does no harm
while true characters are more frequent than any garbled form of theirs.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

RUN = regex.compile(r"[^\x00-\x7f]+")
LOST = "�"
#: Encodings that text in UTF-8 was read as, and single-byte encodings taken for one another.
READ_AS = ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1250", "cp1251", "cp1254", "iso8859-2", "iso8859-15", "koi8-r", "cp1253")
TWICE = ("cp1252", "latin-1")
SINGLE = tuple(("cp1252", b) for b in ("cp1251", "mac_roman", "cp437", "cp850", "cp1250", "koi8-r"))
#: Log-probabilities: entering a state, going over to the clean state, a character that was never seen.
ENTER_UTF8, ENTER_TWICE, ENTER_SINGLE, ENTER_LOST, LEAVE, FLOOR = -5.0, -6.0, -8.0, -2.0, -2.0, -18.0
#: In a pair's state, a sequence that does not decode (bytes lost on the way) has this log-probability.
BROKEN = -9.0
PRIOR, LANGUAGE_PRIOR = 5.0, 200.0
#: Characters of a run that stand for one true character at most, where it is cut.
LONGEST = 12
ROUNDS = 2


@lru_cache
def _bytes_of(encoding: str) -> dict[str, int]:
    """Characters to bytes 0x80-0xff; bytes without a character stand for themselves, as decoders leave them."""
    table = {}
    for b in range(0x80, 0x100):
        try:
            c = bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            c = chr(b)
        table.setdefault(c, b)
    return table


def _once(run: str, encoding: str) -> str | None:
    table = _bytes_of(encoding)
    try:
        return bytes(table[c] for c in run).decode("utf-8")
    except (KeyError, UnicodeDecodeError):
        return None


def _broken(run: str, encoding: str) -> str | None:
    """As ``_once`` where some of the bytes were lost: what does not decode becomes U+FFFD."""
    table = _bytes_of(encoding)
    if any(c not in table and c != LOST for c in run):
        return None
    out = bytes(table.get(c, 0xFF) for c in run).decode("utf-8", "replace")
    return out if any(c != LOST for c in out) else None


@lru_cache(200_000)
def restore(run: str, state: int) -> tuple[str, int] | None:
    """The text that a pair's state stands for, and how many of its characters were broken."""
    kind, a, b = STATES[state]
    if kind == "utf8":
        out = _once(run, a)
        if out is not None:
            return out, 0
        out = _broken(run, a)
        return None if out is None else (out, out.count(LOST))
    if kind == "twice":
        out = _once(run, a)
        out = out and _once(out, a)
        return None if out is None else (out, 0)
    if kind == "single":
        table = _bytes_of(b)
        try:
            return bytes(table[c] for c in run).decode(a), 0
        except (KeyError, UnicodeDecodeError):
            return None
    return run, 0


STATES: list[tuple[str, str, str]] = [("clean", "", ""), ("lost", "", "")]
STATES += [("utf8", a, "") for a in READ_AS] + [("twice", a, "") for a in TWICE] + [("single", a, b) for a, b in SINGLE]
_ENTER = {"clean": 0.0, "lost": ENTER_LOST, "utf8": ENTER_UTF8, "twice": ENTER_TWICE, "single": ENTER_SINGLE}
ENTER = [_ENTER[k] for k, _, _ in STATES]


def state_name(state: int) -> str:
    kind, a, b = STATES[state]
    return {"utf8": f"utf-8 read as {a}", "twice": f"utf-8 read as {a} twice", "single": f"{a} read as {b}"}.get(kind, kind)


@lru_cache(100_000)
def kind_of(c: str) -> str:
    """Class of a character; the empty string stands for the edge of the text."""
    if c == "":
        return "^"
    if c.isascii():
        return "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else " " if c.isspace() else "."
    cat = unicodedata.category(c)
    if cat[0] == "L":
        name = unicodedata.name(c, "")
        script = name.split(" ", 1)[0]
        if script == "LATIN":
            return "l" if cat == "Ll" else "L"
        return {"GREEK": "g", "CYRILLIC": "c"}.get(script, "o")
    return {"S": "s", "P": "p", "M": "m", "Z": "z", "N": "n", "C": "x"}[cat[0]]


def token(c: str) -> str:
    return kind_of(c) if len(c) == 0 or c.isascii() else c


class Chain:
    """log P(next token | class of the character before, language), from counts; a language's counts
    fall back on those of all languages, and these on the token's overall frequency."""

    def __init__(self, counts: list[tuple[str, str, str, int]]) -> None:
        self.of: dict[tuple[str, str, str], int] = {}
        self.classes: Counter = Counter()
        self.pairs: Counter = Counter()
        self.tokens: Counter = Counter()
        for lang, a, b, n in counts:
            self.of[lang, a, b] = n
            self.pairs[a, b] += n
            self.classes[lang, a] += n
            self.classes[a] += n
            self.tokens[b] += n
        self.total = sum(self.tokens.values()) + 1
        self.memo: dict[tuple[str, str, str], float] = {}

    def step(self, before: str, c: str, lang: str) -> float:
        a, b = kind_of(before), token(c)
        key = (lang, a, b)
        if key not in self.memo:
            p = self.tokens[b] / self.total
            p = (self.pairs[a, b] + PRIOR * p) / (self.classes[a] + PRIOR)
            p = (self.of.get(key, 0) + LANGUAGE_PRIOR * p) / (self.classes[lang, a] + LANGUAGE_PRIOR)
            self.memo[key] = max(FLOOR, math.log(p)) if p > 0 else FLOOR
        return self.memo[key]

    def text(self, run: str, left: str, right: str, lang: str) -> float:
        total = 0.0
        for c in run:
            total += self.step(left, c, lang)
            left = c
        return total + self.step(left, right, lang)


class Labels:
    """Viterbi labelling of the runs of a text."""

    def __init__(self, chain: Chain) -> None:
        self.chain = chain
        self.memo: dict[tuple[str, str, str, str], tuple[float, list[tuple[int, float]]]] = {}
        self.cuts: dict[tuple[str, str, str, str], list[tuple[int, int]]] = {}

    def scores(self, run: str, left: str, right: str, lang: str) -> tuple[float, list[tuple[int, float]]]:
        """Gain of every possible state over the clean one; states that cannot emit the run are absent."""
        key = (run, kind_of(left), kind_of(right), lang)
        if key not in self.memo:
            clean = self.chain.text(run, left, right, lang)
            gains = []
            for s in range(1, len(STATES)):
                if STATES[s][0] == "lost":
                    if set(run) <= {LOST} or LOST in run:
                        gains.append((s, -clean if set(run) == {LOST} else -3.0 * sum(c != LOST for c in run) - clean))
                    continue
                got = restore(run, s)
                if got is None or got[0] == run:
                    continue
                text, broken = got
                whole = text.replace(LOST, "")
                gain = self.chain.text(whole, left, right, lang) + BROKEN * broken - clean
                gains.append((s, gain))
            if len(self.memo) > 500_000:
                self.memo.clear()
            self.memo[key] = (max([g for _, g in gains], default=-1.0), gains)
        return self.memo[key]

    def pieces(self, run: str, left: str, right: str, lang: str) -> list[tuple[int, int, list[tuple[int, float]], float]]:
        """Parts of a run that are labelled one by one: (start, end, gains, best gain). It is one part unless
        several explain it better; each of their labels then pays for entering and leaving its state."""
        top, gains = self.scores(run, left, right, lang)
        if len(run) < 3:
            return [(0, len(run), gains, top)]
        key = (run, kind_of(left), kind_of(right), lang)
        if key not in self.cuts:
            net = lambda g: max([x + ENTER[s] + LEAVE for s, x in g if STATES[s][0] in ("utf8", "twice")], default=0.0)
            # best[j]: gain of the characters before j, and where the last part begins; a clean character is a part.
            best = [(0.0, 0, False)]
            for j in range(1, len(run) + 1):
                at = (best[j - 1][0], j - 1, False)
                for i in range(max(0, j - LONGEST), j - 1):
                    g = net(self.scores(run[i:j], run[i - 1] if i else left, run[j] if j < len(run) else right, lang)[1])
                    if g > 0 and best[i][0] + g > at[0]:
                        at = (best[i][0] + g, i, True)
                best.append(at)
            parts, j = [], len(run)
            # Against the run as one part, of which what does not decode is as unlikely as a character never seen.
            one = [x + ENTER[s] + LEAVE + (FLOOR - BROKEN) * (restore(run, s) or ("", 0))[1] for s, x in gains]
            if best[j][0] > max(0.0, max(one, default=0.0)) + 1.0:
                end = j
                while j:  # neighbouring clean characters are one part
                    _, i, labelled = best[j]
                    if labelled:
                        parts += [(j, end)] * (end > j) + [(i, j)]
                        end = i
                    j = i
                parts += [(0, end)] * (end > 0)
            if len(self.cuts) > 500_000:
                self.cuts.clear()
            self.cuts[key] = sorted(parts)
        cuts = self.cuts[key]
        if not cuts:
            return [(0, len(run), gains, top)]
        out = []
        for i, j in cuts:
            t, g = self.scores(run[i:j], run[i - 1] if i else left, run[j] if j < len(run) else right, lang)
            out.append((i, j, g, t))
        return out

    def label(self, text: str, lang: str = "") -> list[tuple[int, int, int]]:
        """(start, end, state) of each run that is not clean."""
        if text.isascii():
            return []
        runs, best = [], 0.0
        n = len(text)
        for m in RUN.finditer(text):
            i, j = m.span()
            for a, b, gains, top in self.pieces(m.group(), text[i - 1] if i else "", text[j] if j < n else "", lang):
                best = max(best, top)
                runs.append((i + a, i + b, gains))
        if best <= 0:
            return []  # no state gains anywhere
        # Scores are relative to the clean state, so a state costs only entering and leaving.
        path: dict[int, float] = {0: 0.0}
        back: list[dict[int, int]] = []
        for _, _, gains in runs:
            out_of, into = max(((v + (LEAVE if s else 0.0), s) for s, v in path.items()))
            new, came = {0: out_of}, {0: into}
            for s, g in gains:
                stay = path.get(s)
                enter = out_of + ENTER[s]
                if stay is not None and stay >= enter:
                    new[s], came[s] = stay + g, s
                else:
                    new[s], came[s] = enter + g, into
            path = new
            back.append(came)
        s = max(path, key=lambda k: (path[k] + (LEAVE if k else 0.0), -k))
        states = []
        for came in reversed(back):
            states.append(s)
            s = came[s]
        return [(i, j, s) for (i, j, _), s in zip(runs, reversed(states)) if s]

    def restored(self, text: str, labelled: list[tuple[int, int, int]]) -> str:
        out, at = [], 0
        for i, j, s in labelled:
            out += [text[at:i], restore(text[i:j], s)[0]]
            at = j
        return "".join([*out, text[at:]])


def _count(text: str, lang: str, counts: Counter) -> None:
    for m in RUN.finditer(text):
        i, j = m.span()
        left = text[i - 1] if i else ""
        for c in m.group():
            if c != LOST:
                counts[lang, kind_of(left), c] += 1
            left = c
        counts[lang, kind_of(left), token(text[j] if j < len(text) else "")] += 1


def _counting(chain_rows: list | None):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        labels = Labels(Chain(chain_rows)) if chain_rows else None
        counts: Counter = Counter()
        ascii_: dict[str, np.ndarray] = {}
        for b in batches:
            if labels is None:  # bytes below 128 are the ASCII characters; counted in the first round only
                for lang, texts in b.groupby("lang", sort=False)["text"]:
                    total = ascii_.setdefault(lang, np.zeros(257, np.int64))
                    total[:256] += np.bincount(np.frombuffer("".join(texts).encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
                    total[256] += len(texts)
            for text, lang in zip(b["text"], b["lang"]):
                if not text or text.isascii():
                    continue
                if labels and (found := labels.label(text, lang)):
                    text = labels.restored(text, found)
                _count(text, lang, counts)
        rows = [(*key, n) for key, n in counts.items()]
        # What follows an ASCII character is mostly ASCII; it is booked under one token as only its size matters.
        for lang, total in ascii_.items():
            kinds: Counter = Counter({"^": int(total[256])})
            for c in range(128):
                kinds[kind_of(chr(c))] += int(total[c])
            rows += [(lang, k, "ascii", n) for k, n in kinds.items()]
        yield pd.DataFrame(rows, columns=["lang", "kind", "token", "n"])

    return count


def _texts(documents: DataFrame) -> DataFrame:
    lang = F.coalesce(F.lower(F.trim("lang")), F.lit("")) if "lang" in documents.columns else F.lit("")
    return documents.select("doc_id", "text", lang.alias("lang")).where("text is not null")


def learn(documents: DataFrame, rounds: int = ROUNDS) -> list[tuple[str, str, str, int]]:
    """Counts of the clean chain over all documents: (language, class before, token, n). Their number
    is bounded by the characters and languages there are, not by the documents."""
    texts = _texts(documents)
    rows: list | None = None
    base: list = []
    for _ in range(max(1, rounds)):
        got = texts.mapInPandas(_counting(rows), "lang string, kind string, token string, n long")
        got = sorted(tuple(r) for r in got.groupBy("lang", "kind", "token").agg(F.sum("n").alias("n")).collect())
        base = base or [r for r in got if r[2] == "ascii"]
        rows = base + [r for r in got if r[2] != "ascii"]
    return rows


def garbled(documents: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Documents with garbled text: doc_id, pairs (names of the states met, sorted, joined by ``; ``),
    n_spans, first_start, restored (the whole text, U+FFFD where characters are lost).

    ``documents``: doc_id, text and, if there is one, lang (case and blanks are ignored; null is a
    language of its own). Null, empty and ASCII texts are clean; texts of any length are read whole.
    Repeated documents give repeated rows; other columns are ignored.
    """
    rows = learn(documents, rounds)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        labels = Labels(Chain(rows))
        for b in batches:
            out = []
            for doc, text, lang in zip(b["doc_id"], b["text"], b["lang"]):
                if not text or not (found := labels.label(text, lang)):
                    continue
                spans = 1 + sum(x[2] != y[2] for x, y in zip(found, found[1:]))
                names = "; ".join(sorted({state_name(s) for _, _, s in found}))
                out.append((doc, names, spans, found[0][0], labels.restored(text, found)))
            yield pd.DataFrame(out, columns=["doc_id", "pairs", "n_spans", "first_start", "restored"])

    return _texts(documents).mapInPandas(find, "doc_id long, pairs string, n_spans int, first_start int, restored string")
