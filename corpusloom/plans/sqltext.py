"""Pieces of DuckDB SQL that several oracle statements share."""

from __future__ import annotations

from corpusloom.functions.text import STOP_WORDS

_STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


def fold(x: str) -> str:
    return f"strip_accents(lower(coalesce({x}, '')))"


def raw_tokens(x: str) -> str:
    return rf"regexp_extract_all(replace({fold(x)}, chr(8209), '-'), '[\p{{L}}\p{{N}}]+(?:[.-]+[\p{{L}}\p{{N}}]+)*')"


_PARTS = "list_filter(string_split(t, '-'), lambda p: p <> '')"
_JOINED = f"array_to_string({_PARTS}, '')"


def pieces(t_list: str) -> str:
    split = f"list_concat({_PARTS}, CASE WHEN len({_PARTS}) > 3 OR regexp_full_match({_JOINED}, '[0-9]*') THEN [] ELSE [{_JOINED}] END)"
    return f"flatten(list_transform({t_list}, lambda t: CASE WHEN contains(t, '.') THEN [t] WHEN contains(t, '-') THEN {split} ELSE [t] END))"


def index_terms(x: str) -> str:
    return f"list_filter({pieces(raw_tokens(x))}, lambda w: NOT list_contains({_STOP}, w))"


NAME = "string_split(coalesce(text, ''), chr(10))[1]"

#: The documents in flat form, with their index terms.
FLAT = f"""flat AS (
  SELECT doc_id AS id, {NAME} AS name, coalesce(text, '') AS content, lang AS kind, source AS scope, CAST(doc_id % 6 AS INTEGER) AS depth,
    {index_terms(NAME)} AS t_name, {index_terms("text")} AS t_content FROM documents)"""


def scored(terms: list[str], fields: tuple[str, ...] = ("name", "content"), where: str = "true") -> str:
    """CTEs ending in ``scored`` (id, kind, scope, depth, score, matched)."""
    boosts = {"name": "3.0", "content": "1.0"}
    tf = ", ".join(f"len(list_filter(t_{f}, lambda w: w = '{t}')) AS tf_{f}_{i}" for f in fields for i, t in enumerate(terms))
    lens = ", ".join(f"len(list_distinct(t_{f})) AS len_{f}" for f in fields)
    stats = ", ".join([f"avg(len_{f}) AS avg_{f}" for f in fields] + [f"sum(CAST(tf_{f}_{i} > 0 AS INT)) AS df_{f}_{i}" for f in fields for i in range(len(terms))])
    parts = " + ".join(
        f"CASE WHEN tf_{f}_{i} > 0 THEN {boosts[f]}::DOUBLE * ln(1 + (n - df_{f}_{i} + 0.5::DOUBLE) / (df_{f}_{i} + 0.5::DOUBLE)) * (0.5::DOUBLE + tf_{f}_{i} * 2.2::DOUBLE / (tf_{f}_{i} + 1.2::DOUBLE * (0.3::DOUBLE + 0.7::DOUBLE * len_{f} / avg_{f}))) ELSE 0 END"
        for f in fields for i in range(len(terms))
    )
    matched = " + ".join("CAST((" + " OR ".join(f"tf_{f}_{i} > 0" for f in fields) + ") AS INT)" for i in range(len(terms)))
    return f"""{FLAT},
counts AS (SELECT id, kind, scope, depth, {lens}, {tf} FROM flat),
corpus AS (SELECT count(*)::DOUBLE AS n, {stats} FROM counts),
scored AS (SELECT * FROM (SELECT id, kind, scope, depth, round(({parts}) * ({matched}) * (1 + greatest(0, 4 - depth) * 0.05::DOUBLE), 6) AS score,
  CAST({matched} AS INTEGER) AS matched FROM counts, corpus) WHERE matched > 0 AND {where})"""
