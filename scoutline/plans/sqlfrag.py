"""Small helpers that render the fixed value tables as DuckDB SQL for the
oracle queries (the oracle logic itself is written out in SQL)."""

from __future__ import annotations


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def list_lit(xs) -> str:
    return "[" + ", ".join(q(x) for x in xs) + "]::VARCHAR[]"


def case_list(expr: str, mapping: dict) -> str:
    """CASE expr WHEN key THEN [values] ... ELSE [] END"""
    whens = " ".join(f"WHEN {q(k)} THEN {list_lit(v)}" for k, v in mapping.items())
    return f"(CASE {expr} {whens} ELSE []::VARCHAR[] END)"


def case_str(expr: str, mapping: dict) -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in mapping.items())
    return f"(CASE {expr} {whens} ELSE NULL END)"
