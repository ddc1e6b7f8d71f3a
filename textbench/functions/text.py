"""Text scalars as Spark column expressions (TXT1-TXT8).

All functions return ``Column``s built from built-in functions, so they stay
inside whole-stage code generation (array lambdas excepted) and never leave
the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textbench.functions.hashing import hash_randint

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for identical output.
# Query templates of the document-selection task, in natural order:
#   position query: There are {doc_count} documents. Return document #{index} exactly. If no document matches, reply with: "{refusal_text}"
#   content query:  There are {doc_count} documents. Return the document that contains the phrase "{phrase}" exactly. If no document matches, reply with: "{refusal_text}"
# Default refusal text: Sorry, I couldn't find a matching document in this set.
# Fallback chat template per message: {bos}{role}\n{content}{eos}\n ; generation header: {bos}assistant\n
# ---------------------------------------------------------------------------
REFUSAL_TEXT = "Sorry, I couldn't find a matching document in this set."
INDEX_QUERY_HEAD = "There are %d documents. Return document #%d exactly. If no document matches, reply with: \"%s\""
CONTENT_QUERY_HEAD = (
    "There are %d documents. Return the document that contains the phrase \"%s\" exactly. "
    "If no document matches, reply with: \"%s\""
)

WS = "(?U)\\s+"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_ws(c) -> Column:
    """TXT1: trim and collapse every whitespace run to one space."""
    return F.trim(F.regexp_replace(_c(c), WS, " "))


def words(c) -> Column:
    """TXT2: whitespace tokens (Python ``str.split()``), never empty strings."""
    return F.array_remove(F.split(_c(c), WS), "")


TOKEN_RE = "(?U)[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]"


def regex_tokens(c) -> Column:
    """Default tokenizer: runs of letters, digits and ``_`` of any script, and
    single other marks."""
    return F.regexp_extract_all(_c(c), F.lit(TOKEN_RE), 0)


def token_length(c, tokenizer=regex_tokens) -> Column:
    """TXT3: length of a text in tokens of a pluggable column tokenizer (the
    default tokenizer's matches are counted without building the array)."""
    if tokenizer is regex_tokens:
        return F.regexp_count(_c(c), F.lit(TOKEN_RE))
    return F.size(tokenizer(_c(c)))


# sacreBLEU "13a" tokenisation [public: mteval-v13a; Post 2018].
# The four substitution patterns of the 13a tokenizer, in order.
_13A_RULES = [
    ("([\\{-\\~\\[-\\` -\\&\\(-\\+\\:-\\@\\/])", " $1 "),
    ("([^0-9])([\\.,])", "$1 $2 "),
    ("([\\.,])([^0-9])", " $1 $2"),
    ("([0-9])(-)", "$1 $2 "),
]
_13A_ENTITIES = [("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")]


def replaced_13a(c) -> Column:
    """A segment after the literal replacements of the 13a tokenizer."""
    line = _c(c)
    line = F.when(F.right(line, F.lit(1)).rlike(WS), F.regexp_replace(line, "(?U)\\s+$", "")).otherwise(line)
    line = F.replace(line, F.lit("<skipped>"), F.lit(""))
    line = F.replace(line, F.lit("-\n"), F.lit(""))
    for ent, ch in _13A_ENTITIES:
        line = F.replace(line, F.lit(ent), F.lit(ch))
    return line


def spaced_13a(c) -> Column:
    """The 13a tokens of a segment in one string, with one space between them
    (and perhaps one before and after)."""
    line = F.concat(F.lit(" "), F.replace(replaced_13a(c), F.lit("\n"), F.lit(" ")), F.lit(" "))
    for pat, rep in _13A_RULES:
        line = F.regexp_replace(line, pat, rep)
    return F.regexp_replace(line, WS, " ")


def tokens_13a(c) -> Column:
    """Tokens of a segment as BLEU sees them (13a tokenizer, right-stripped)."""
    return F.filter(F.split(spaced_13a(c), " "), lambda x: x != F.lit(""))


def sample_phrase(text, seed, *keys, min_words: int = 3, max_words: int = 6) -> Column:
    """TXT4: random contiguous span of ``min_words..max_words`` words.

    Whole text (whitespace-normalised) when it has at most ``min_words``
    words, '' when it has none.  Length and start are drawn from P1 hashes
    of ``(seed, keys)``.
    """
    w = words(text)
    n = F.size(w)
    length = hash_randint(F.lit(min_words), F.least(F.lit(max_words), n), seed, *keys, F.lit("len"))
    start = hash_randint(F.lit(0), n - length, seed, *keys, F.lit("start"))
    return (
        F.when(n == 0, F.lit(""))
        .when(n <= min_words, F.array_join(w, " "))
        .otherwise(F.array_join(F.slice(w, (start + 1).cast("int"), length.cast("int")), " "))
    )


def phrase_in_docs(phrase, docs, exclude_index=None) -> Column:
    """TXT5: phrase is a substring of any document of the (small) group array.

    ``exclude_index`` is a 0-based position to skip (or None).  An empty
    phrase is always "found".
    """
    ph = _c(phrase)
    if exclude_index is None:
        hit = F.exists(_c(docs), lambda d: F.instr(d, ph) > 0)
    else:
        ex = _c(exclude_index)
        hit = F.exists(
            F.transform(_c(docs), lambda d, i: F.struct(d.alias("d"), i.alias("i"))),
            lambda s: (s["i"] != ex) & (F.instr(s["d"], ph) > 0),
        )
    return F.when(ph == F.lit(""), F.lit(True)).otherwise(hit)


def index_query(doc_count, index, refusal_text: str = REFUSAL_TEXT) -> Column:
    """TXT7: position query (index is 1-based)."""
    return F.format_string(INDEX_QUERY_HEAD, _c(doc_count).cast("int"), _c(index).cast("int"), F.lit(refusal_text))


def content_query(doc_count, phrase, refusal_text: str = REFUSAL_TEXT) -> Column:
    """TXT7: content query around a phrase."""
    return F.format_string(CONTENT_QUERY_HEAD, _c(doc_count).cast("int"), _c(phrase), F.lit(refusal_text))


def message(role, content) -> Column:
    return F.struct(_c(role).alias("role"), _c(content).alias("content"))


def render_prompt(messages, bos: str = "", eos: str = "", add_generation_prompt: bool = False) -> Column:
    """TXT6: fallback chat template over an ``array<struct<role,content>>``."""
    parts = F.transform(
        _c(messages),
        lambda m: F.concat(F.lit(bos), m["role"], F.lit("\n"), m["content"], F.lit(eos), F.lit("\n")),
    )
    out = F.array_join(parts, "")
    if add_generation_prompt:
        out = F.concat(out, F.lit(f"{bos}assistant\n"))
    return out


def selection_user_content(query, user_prefix: str | None) -> Column:
    """Selection variant: user prefix and query joined by a newline."""
    if user_prefix:
        return F.concat(F.lit(user_prefix), F.lit("\n"), _c(query))
    return _c(query)


#: Fixed value: the default cap on target tokens.
MAX_TOKENS = 512


def label_layout(prefix_tokens, doc_mask, prompt_len, target_len, pad_len) -> Column:
    """TXT8: per-token loss mask: prefix (K per document, masked), prompt
    (masked), target (kept), padding (masked).  Returns ``array<int>`` of
    1 (supervised) / 0 (ignored) of length ``K*docs + prompt + target + pad``.
    ``doc_mask`` is an ``array<boolean>`` (one bit per document slot)."""
    k = _c(prefix_tokens).cast("int")
    prefix = F.flatten(F.transform(_c(doc_mask), lambda _b: F.array_repeat(F.lit(0), k)))
    return F.concat(
        prefix,
        F.array_repeat(F.lit(0), _c(prompt_len).cast("int")),
        F.array_repeat(F.lit(1), _c(target_len).cast("int")),
        F.array_repeat(F.lit(0), _c(pad_len).cast("int")),
    )


def prefix_attention(prefix_tokens, doc_mask) -> Column:
    """Each document-mask bit repeated K times (attention over prefix slots)."""
    k = _c(prefix_tokens).cast("int")
    return F.flatten(F.transform(_c(doc_mask), lambda b: F.array_repeat(b, k)))
