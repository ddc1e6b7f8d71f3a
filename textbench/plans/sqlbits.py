"""DuckDB SQL fragments mirroring the column functions (oracle side only)."""

from __future__ import annotations


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '\\s+'), lambda t: t <> '')"


def normalize_ws(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'), ' ')"


def regex_tokens(x: str) -> str:
    return f"regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]')"


def token_f1(pred: str, ref: str) -> str:
    p = f"list_distinct({words(pred)})"
    r = f"list_distinct({words(ref)})"
    common = f"CAST(len(list_distinct(list_intersect({p}, {r}))) AS DOUBLE)"
    prec = f"({common} / len({p}))"
    rec = f"({common} / len({r}))"
    return (
        f"(CASE WHEN len({p}) = 0 OR len({r}) = 0 THEN 0.0 WHEN {common} = 0 THEN 0.0 "
        f"ELSE 2 * {prec} * {rec} / ({prec} + {rec}) END)"
    )


def r6(x: str) -> str:
    return f"round({x}, 6)"
