"""Pieces of the SQL oracles."""

from __future__ import annotations


def lit(s: str) -> str:
    """An SQL string literal; a newline is spelled out, as literals have no escapes."""
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def rewrite(expr: str, rules) -> str:
    for pattern, to in rules:
        expr = f"regexp_replace({expr}, {lit(pattern)}, {lit(to)}, 'g')"
    return expr


def count(expr: str, pattern: str) -> str:
    return f"len(regexp_extract_all({expr}, {lit(pattern)}))"


def has(expr: str, pattern: str) -> str:
    return f"regexp_matches({expr}, {lit(pattern)})"
