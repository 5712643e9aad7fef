"""Pieces of DuckDB SQL shared by the oracles."""

from __future__ import annotations

from threadloom.functions import lexical as L

_CLASS = r"\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{180E}\x{2000}-\x{200F}\x{2028}\x{2029}\x{202F}\x{205F}\x{2060}\x{3000}\x{FEFF}"


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^[{_CLASS}]+|[{_CLASS}]+$', '', 'g')"


def blank(c: str) -> str:
    return f"({c} IS NULL OR NOT regexp_matches({c}, '[^{_CLASS}]'))"


def collapse(c: str) -> str:
    return strip(f"regexp_replace({c}, '[{_CLASS}]+', ' ', 'g')")


def norm(c: str) -> str:
    return collapse(f"lower(coalesce({c}, ''))")


def tokens(c: str) -> str:
    stop = "[" + ", ".join(map(quote, L.STOPWORDS)) + "]"
    split = f"string_split_regex(regexp_replace({norm(c)}, '[^a-z0-9\\s\\-.()/%λ]', ' ', 'g'), '\\s+')"
    return f"list_distinct(list_filter(list_transform({split}, lambda x: trim(x, {quote(L.PUNCTUATION)})), lambda x: length(x) >= 2 AND NOT list_contains({stop}, x)))"


def words(c: str) -> str:
    return f"list_filter(string_split_regex(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


def has_any(c: str, markers: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, {quote(m)})" for m in markers) + ")"


def latest(table: str, key: str, ts: str, columns: dict[str, str]) -> str:
    """One row per key, the latest; columns: name to expression."""
    pack = ", ".join(f"{n} := {e}" for n, e in columns.items())
    out = ", ".join(f"v.{n} AS {n}" for n in columns)
    return f"(SELECT {key}, {out} FROM (SELECT {key}, arg_max(struct_pack({pack}), {ts}) AS v FROM {table} WHERE {key} IS NOT NULL GROUP BY {key}))"


def json_opened(x: str) -> str:
    """A JSON value stored as JSON text, read; any other as it is."""
    return f"CASE WHEN json_type({x}) = 'VARCHAR' AND regexp_matches({x}->>'$', '^\\s*[\\[{{]') AND json_valid({x}->>'$') THEN CAST({x}->>'$' AS JSON) ELSE {x} END"


def json_object(x: str) -> str:
    o = f"({json_opened(x)})"
    return f"CASE json_type({o}) WHEN 'OBJECT' THEN {o} WHEN 'ARRAY' THEN CASE WHEN json_array_length({o}) = 1 THEN json_extract({o}, '$[0]') END END"
