"""The few spots where Spark SQL and DuckDB SQL differ, so one text of an operation serves as the
query in one engine and as its independent check in the other."""

from __future__ import annotations


import re

_DECIMAL = re.compile(r"(?<![\w'.])(\d+\.\d+)(?![\w'.])")


class Spark:
    name = "spark"
    recursive = "WITH RECURSIVE"
    double = r"\1D"

    def numbers(self, sql):
        """Decimal literals as doubles."""
        return _DECIMAL.sub(self.double, sql)


    def key(self, c): return f"substring_index(translate(lower({c}), ' ⟨⟩`', ''), ':', -1)"
    def link(self, c, tables):
        # A lookup instead of a case per table keeps the generated code small.
        names = ", ".join(f"'{a}', '{t}:'" for a, t in tables.items())
        return f"try_element_at(map({names}), left({self.key(c)}, 1)) || {self.key(c)}"
    def hex(self, c): return f"cast(conv({c}, 16, 10) AS BIGINT)"
    def month(self, c): return f"date_format({c}, 'yyyy-MM')"
    def micros(self, c): return f"unix_micros(cast({c} AS TIMESTAMP))"
    def cosine(self, a, b):
        dot = lambda x, y: f"aggregate(zip_with({x}, {y}, (p, q) -> cast(p AS DOUBLE) * cast(q AS DOUBLE)), 0D, (s, v) -> s + v)"
        return f"({dot(a, b)} / (sqrt({dot(a, a)}) * sqrt({dot(b, b)})))"
    def dot(self, a, b): return f"aggregate(zip_with({a}, {b}, (p, q) -> cast(p AS DOUBLE) * cast(q AS DOUBLE)), 0D, (s, v) -> s + v)"
    def minus(self, a, b): return f"zip_with({a}, {b}, (p, q) -> cast(p AS DOUBLE) - cast(q AS DOUBLE))"
    def plus(self, a, b): return f"zip_with({a}, {b}, (p, q) -> cast(p AS DOUBLE) + cast(q AS DOUBLE))"
    def scale(self, a, k): return f"transform({a}, p -> cast(p AS DOUBLE) * {k})"
    def doubles(self, a): return f"cast({a} AS ARRAY<DOUBLE>)"
    def slice(self, a, start, n): return f"slice({a}, {start}, {n})"
    def explode(self, table, arr, alias): return f"{table} LATERAL VIEW explode({arr}) ex AS {alias}"
    def words(self, c): return f"regexp_extract_all(lower({c}), '[a-z0-9]+', 0)"
    def split_words(self, c): return f"split({c}, ' +')"
    def texts(self, c, sep=","): return f"array_join(array_sort(collect_list({c})), '{sep}')"
    def distinct_texts(self, c, sep=","): return f"array_join(array_sort(collect_set({c})), '{sep}')"
    def joined(self, a, sep=","): return f"array_join({a}, '{sep}')"
    def has(self, a, v): return f"array_contains({a}, {v})"
    def size(self, a): return f"cast(greatest(size({a}), 0) AS BIGINT)"
    def intdiv(self, a, b): return f"({a} div {b})"
    def pos(self, needle, hay): return f"instr({hay}, {needle})"
    def b64(self, c): return f"base64(encode({c}, 'utf-8'))"
    def array(self, *xs): return f"array({', '.join(xs)})"
    def append(self, a, x): return f"array_append({a}, {x})"
    def entry(self, m, k): return f"{m}['{k}']"
    def sub(self, c, a, n): return f"substring({c}, {a}, {n})"
    def string(self, c): return f"cast({c} AS STRING)"
    def tokens(self, c): return f"cast(ceil(length({c}) / 4.0) AS BIGINT)"


class Duck(Spark):
    name = "duckdb"
    double = r"cast(\1 AS DOUBLE)"

    def key(self, c): return f"string_split(replace(replace(replace(replace(lower({c}), ' ', ''), '⟨', ''), '⟩', ''), '`', ''), ':')[-1]"
    def link(self, c, tables):
        cases = " ".join(f"WHEN '{a}' THEN '{t}:'" for a, t in tables.items())
        return f"CASE left({self.key(c)}, 1) {cases} END || {self.key(c)}"
    def hex(self, c): return f"('0x' || {c})::BIGINT"
    def month(self, c): return f"strftime({c}, '%Y-%m')"
    def micros(self, c): return f"epoch_us({c})"
    def cosine(self, a, b): return f"list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[])"
    def dot(self, a, b): return f"list_dot_product({a}::DOUBLE[], {b}::DOUBLE[])"
    def minus(self, a, b): return f"[x[1]::DOUBLE - x[2]::DOUBLE FOR x IN list_zip({a}, {b})]"
    def plus(self, a, b): return f"[x[1]::DOUBLE + x[2]::DOUBLE FOR x IN list_zip({a}, {b})]"
    def scale(self, a, k): return f"[x::DOUBLE * {k} FOR x IN {a}]"
    def doubles(self, a): return f"{a}::DOUBLE[]"
    def slice(self, a, start, n): return f"{a}[{start}:{start} + {n} - 1]"
    def explode(self, table, arr, alias): return f"(SELECT *, unnest({arr}) AS {alias} FROM {table})"
    def words(self, c): return f"regexp_extract_all(lower({c}), '[a-z0-9]+')"
    def split_words(self, c): return f"string_split_regex({c}, ' +')"
    def texts(self, c, sep=","): return f"string_agg({c}, '{sep}' ORDER BY {c})"
    def distinct_texts(self, c, sep=","): return f"string_agg(DISTINCT {c}, '{sep}' ORDER BY {c})"
    def joined(self, a, sep=","): return f"array_to_string({a}, '{sep}')"
    def has(self, a, v): return f"list_contains({a}, {v})"
    def size(self, a): return f"coalesce(len({a}), 0)::BIGINT"
    def intdiv(self, a, b): return f"({a} // {b})"
    def b64(self, c): return f"base64(encode({c}))"
    def array(self, *xs): return f"[{', '.join(xs)}]"
    def append(self, a, x): return f"list_append({a}, {x})"
    def entry(self, m, k): return f"{m}['{k}']"
    def string(self, c): return f"cast({c} AS VARCHAR)"
    def tokens(self, c): return f"cast(ceil(length({c}) / 4.0) AS BIGINT)"
