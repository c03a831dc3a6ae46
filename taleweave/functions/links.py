"""Record links: every spelling of a link becomes one canonical ``table:key``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values of the data model: the letter that begins a key tells its table.
TABLE_OF_LETTER = {
    "c": "character",
    "l": "location",
    "e": "event",
    "s": "scene",
    "k": "knowledge",
    "w": "knows",
}


# Blanks and the marks that clients escape a key with.
_MARKS = " \t\r\n⟨⟩`'\"\\"


def link_key(link: Column) -> Column:
    """Key of a link, without table, escapes, blanks and case; null and blank links give null."""
    return F.nullif(_bare(link), F.lit(""))


def _bare(link: Column) -> Column:
    decoded = F.when(link.contains("%"), F.try_url_decode(link)).otherwise(link)
    return F.substring_index(F.translate(F.lower(decoded), _MARKS, ""), ":", -1)


def canonical_link(link: Column) -> Column:
    """``table:key`` of a link; the table follows from the key's letter, so a bare key is enough. A key
    of another letter counts as one of ``unknown``."""
    names = F.create_map(*[F.lit(x) for pair in TABLE_OF_LETTER.items() for x in pair])
    key = _bare(link)
    whole = F.concat(F.coalesce(F.try_element_at(names, F.left(key, F.lit(1))), F.lit("unknown")), F.lit(":"), key)
    # Most links are written in full; to see that costs less than to write them anew.
    full = link.rlike(f"^({'|'.join(f'{t}:{a}' for a, t in TABLE_OF_LETTER.items())})[0-9a-f]+$")
    return F.when(full, link).otherwise(F.nullif(whole, F.lit("unknown:")))


# The seven certainties of the ledger, in the schema's order.
CERTAINTIES = ("knows", "suspects", "believes_wrongly", "uncertain", "assumes", "denies", "forgotten")


def snake(value: Column) -> Column:
    """``Believes Wrongly``, ``BelievesWrongly`` and ``believes-wrongly `` all become ``believes_wrongly``."""
    split = F.regexp_replace(F.trim(value), r"([a-z])([A-Z])", "$1_$2")
    return F.lower(F.regexp_replace(split, r"[\s\-]+", "_"))


def canonical_certainty(value: Column) -> Column:
    """The schema's spelling of a certainty. The client synonyms ``certain`` and ``wrong`` are accepted;
    any other unknown word counts as ``uncertain``, null stays null."""
    s = snake(value)
    s = F.when(s == "certain", "knows").when(s == "wrong", "believes_wrongly").otherwise(s)
    return F.when(s.isin(*CERTAINTIES), s).when(value.isNotNull(), F.lit("uncertain"))


def micros(ts: Column) -> Column:
    """Microseconds since 1970-01-01 of a timestamp with or without zone (read as UTC)."""
    return F.unix_micros(ts.cast("timestamp"))
