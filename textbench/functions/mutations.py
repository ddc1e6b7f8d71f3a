"""TXT12-14: code mutations as column expressions.

A mutation picks one regex match of a file (by a P1 hash instead of a
seeded ``random.choice``) and rewrites the file around it.  Positional
splices use ``split`` (the text between matches) interleaved with
``regexp_extract_all`` (the matches themselves): both scan left to right
with the same non-overlapping matcher, so piece ``i`` is followed by match
``i``.  Each returns ``struct<original, mutated, old_text, new_text>`` or
null, exactly like the reference's ``None``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textbench.functions.hashing import hash_uniform

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for identical output.
# Assignment patterns (multiline) per language:
#   py: ^(\s*)(\w+)\s*=\s*(.+)$
#   js: ^(\s*)(?:let|const|var)\s+(\w+)\s*=\s*(.+)$
#   rs: ^(\s*)let\s+(?:mut\s+)?(\w+)\s*=\s*(.+)$
# Names never renamed: self cls i j k x y _ (and any 1-character name)
# Rename suffix: _renamed
# String literal patterns: "([^"]{3,30})"  then, if none, '([^']{3,30})'
# String suffix: _modified
# Called-name pattern for typos: \b(\w{4,})\s*\(
# ---------------------------------------------------------------------------
ASSIGN_PATTERNS = {
    "py": r"^(\s*)(\w+)\s*=\s*(.+)$",
    "js": r"^(\s*)(?:let|const|var)\s+(\w+)\s*=\s*(.+)$",
    "rs": r"^(\s*)let\s+(?:mut\s+)?(\w+)\s*=\s*(.+)$",
}
SKIP_NAMES = ["self", "cls", "i", "j", "k", "x", "y", "_"]
RENAME_SUFFIX = "_renamed"
DQ_LITERAL = r'"([^"]{3,30})"'
SQ_LITERAL = r"'([^']{3,30})'"
STRING_SUFFIX = "_modified"
CALL_NAME = r"\b(\w{4,})\s*\("

# Java flags: (?d) only \n ends a line (Python semantics), (?m) multiline,
# (?U) Unicode \w \s \b as in Python 3 str patterns.
_JFLAGS = "(?dmU)"

MUTATION_TYPE = "struct<original:string,mutated:string,old_text:string,new_text:string>"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _pick(arr: Column, seed, salt: str, *keys) -> Column:
    """0-based index of a uniformly chosen element (hash instead of RNG)."""
    return F.floor(hash_uniform(seed, F.lit(salt), *keys) * F.size(arr)).cast("int")


def _splice(code: Column, pattern: str, n: Column, replacement: Column) -> Column:
    """Replace the n-th (0-based) match of ``pattern`` in ``code``."""
    pieces = F.split(code, pattern, -1)
    matches = F.regexp_extract_all(code, F.lit(pattern), 0)
    # zip piece i with match i (the last piece has none); lambdas only touch
    # the zipped element, so neither regex is re-run per element
    zipped = F.arrays_zip(pieces.alias("p"), matches.alias("m"))
    return F.array_join(
        F.transform(
            zipped,
            lambda z, i: F.concat(
                z["p"], F.when(i == n, replacement).otherwise(F.coalesce(z["m"], F.lit(""))),
            ),
        ),
        "",
    )


def rename_mutation(code, lang, seed, *keys, whole_word: bool = False) -> Column:
    """TXT12: rename one assigned variable everywhere.  The default replaces the
    name as a substring, also inside longer identifiers; ``whole_word`` leaves
    those alone."""
    code_c, lang_c = _c(code), _c(lang)
    names = F.when(lang_c == "py", F.regexp_extract_all(code_c, F.lit(_JFLAGS + ASSIGN_PATTERNS["py"]), 2)) \
        .when(lang_c == "js", F.regexp_extract_all(code_c, F.lit(_JFLAGS + ASSIGN_PATTERNS["js"]), 2)) \
        .when(lang_c == "rs", F.regexp_extract_all(code_c, F.lit(_JFLAGS + ASSIGN_PATTERNS["rs"]), 2))
    name = F.element_at(names, _pick(names, seed, "rename", *keys) + 1)
    skip = name.isin(*SKIP_NAMES) | (F.length(name) < 2)
    new = F.concat(name, F.lit(RENAME_SUFFIX))
    # names hold word characters only, so the name itself needs no escaping
    whole = F.regexp_replace(code_c, F.concat(F.lit("(?U)\\b"), name, F.lit("\\b")), new)
    return F.when(
        names.isNotNull() & (F.size(names) > 0) & ~skip,
        F.struct(code_c.alias("original"), (whole if whole_word else F.replace(code_c, name, new)).alias("mutated"),
                 name.alias("old_text"), new.alias("new_text")),
    ).otherwise(F.lit(None).cast(MUTATION_TYPE))


def string_literal_mutation(code, seed, *keys) -> Column:
    """TXT13: append a suffix inside one 3-30 character string literal
    (double-quoted if any, else single-quoted)."""
    code_c = _c(code)
    dq = F.regexp_extract_all(code_c, F.lit(DQ_LITERAL), 0)
    sq = F.regexp_extract_all(code_c, F.lit(SQ_LITERAL), 0)
    use_dq = F.size(dq) > 0
    lits = F.when(use_dq, dq).otherwise(sq)
    n = _pick(lits, seed, "string", *keys)
    old = F.element_at(lits, n + 1)
    new = F.concat(F.substring(old, 1, F.length(old) - 1), F.lit(STRING_SUFFIX), F.substring(old, -1, 1))
    mutated = F.when(use_dq, _splice(code_c, DQ_LITERAL, n, new)).otherwise(_splice(code_c, SQ_LITERAL, n, new))
    return F.when(
        F.size(lits) > 0,
        F.struct(code_c.alias("original"), mutated.alias("mutated"), old.alias("old_text"), new.alias("new_text")),
    ).otherwise(F.lit(None).cast(MUTATION_TYPE))


def typo_mutation(code, seed, *keys) -> Column:
    """TXT14: swap two adjacent inner characters of one called name.
    Returns (broken, fixed, typo, name) in the struct's
    (original, mutated, old_text, new_text) slots, like the reference."""
    code_c = _c(code)
    pat = "(?U)" + CALL_NAME
    calls = F.regexp_extract_all(code_c, F.lit(pat), 0)
    n = _pick(calls, seed, "typo", *keys)
    m = F.element_at(calls, n + 1)
    name = F.regexp_extract(m, "^(?U)(\\w+)", 1)
    ln = F.length(name)
    idx = (F.lit(1) + F.floor(hash_uniform(seed, F.lit("typo-pos"), *keys) * (ln - 2))).cast("int")  # [1, len-2]
    typo = F.concat(F.substring(name, 1, idx), F.substring(name, idx + 2, 1), F.substring(name, idx + 1, 1),
                    F.substring(name, idx + 3, 1 << 30))
    broken = _splice(code_c, pat, n, F.concat(typo, F.substring(m, ln + 1, 1 << 30)))
    return F.when(
        (F.size(calls) > 0) & (typo != name),
        F.struct(broken.alias("original"), code_c.alias("mutated"), typo.alias("old_text"), name.alias("new_text")),
    ).otherwise(F.lit(None).cast(MUTATION_TYPE))


# DuckDB text (oracle side) -------------------------------------------------

def sql_pick(arr: str, seed, salt: str, key: str) -> str:
    from textbench.functions.hashing import sql_hash_uniform

    return f"CAST(floor({sql_hash_uniform(seed, repr(salt), key)} * len({arr})) AS INTEGER)"


def sql_splice(code: str, pattern: str, n: str, replacement: str) -> str:
    return (f"array_to_string(list_transform(string_split_regex({code}, '{pattern}'), lambda p, i: "
            f"concat(p, CASE WHEN i - 1 = {n} THEN {replacement} "
            f"WHEN i - 1 < len(regexp_extract_all({code}, '{pattern}')) THEN regexp_extract_all({code}, '{pattern}')[i] "
            f"ELSE '' END)), '')")
