"""Columnar n-gram counting over Arrow batches (P3's kernel).

A batch has two text columns whose tokens are separated by one byte, or lie as
the 13a rules cut them (``_alone_13a``, in place of four regular expressions).  Tokens
become 64-bit hashes, read off running sums over the bytes of many texts at
once; an n-gram is a combination of neighbouring hashes, filed under its row in
the upper bits of a key.  One sort per order and side brings equal grams of a row
together, and the clipped matches are run lengths: no gram becomes a row, an
object of its own, or part of a shuffle.

Texts are taken in slices of about SLICE bytes, a longer text by itself, so memory
follows the slice and the longest text.  Two different grams of a row
share a key with a chance of about (grams of the row)^2 / 2^(64 - bits of the
number of rows in the slice): below 1e-6 for a million words in one text.

``batch_pair_stats`` finds in the same pass, from the same running sums, what token F1
and the length in tokens need, so a text is read once for all three.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SLICE = 1 << 18  # the arrays of a slice stay in a core's cache
WORDS = -1  # in place of a separator: tokens lie between white space
MARK = 1  # the byte that separates words among tokens, where prefixes are asked for
MAX_ORDER = 4


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_WORD, _SPACE, _SYMBOL, _POINT, _DIGIT, _DASH = range(6)
_KIND = np.full(256, _WORD, np.uint8)
_KIND[[*range(0x09, 0x0E), 0x20]] = _SPACE
_KIND[[*range(0x21, 0x27), *range(0x28, 0x2C), 0x2F, *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = _SYMBOL
_KIND[[0x2C, 0x2E]] = _POINT
_KIND[0x30:0x3A] = _DIGIT
_KIND[0x2D] = _DASH
# the white space beyond ASCII: U+0085, U+00A0, U+1680, U+2000-200A, U+2028, U+2029, U+202F, U+205F, U+3000
_WIDE_SPACES = {2: [0xC285, 0xC2A0], 3: [0xE19A80, *range(0xE28080, 0xE2808B), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080]}
_SPACES = "\t\n\x0b\x0c\r " + "".join(s.to_bytes(w).decode() for w, spaces in _WIDE_SPACES.items() for s in spaces)
# the literal replacements of the 13a tokenizer (text.replaced_13a), after which a line end is white space like any other
_REPLACED = [("<skipped>", ""), ("-\n", ""), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")]


def replaced(column: pa.Array) -> pa.Array:
    """Texts after the literal replacements of the 13a rules; the same column where
    none of them occurs.  White space at an end matters only to the dash before it."""
    raw = _buffers(column)[0].tobytes()
    if b"-\n" in raw or b"<skipped>" in raw:
        column = pc.utf8_rtrim(column, characters=_SPACES)
    elif b"&" not in raw:
        return column
    for old, new in _REPLACED:
        if old.encode() in _buffers(column)[0].tobytes():
            column = pc.replace_substring(column, pattern=old, replacement=new)
    return column


def _inside(data: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Which bytes are not white space."""
    inside = kind != _SPACE
    lead = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
    for width, spaces in _WIDE_SPACES.items() if len(lead) else ():
        here = lead[lead + width <= len(data)]
        code = np.zeros(len(here), np.int64)
        for k in range(width):
            code = code << 8 | data[here + k]
        here = here[np.isin(code, spaces)]
        for k in range(width):
            inside[here + k] = False
    return inside


def _alone_13a(data: np.ndarray, kind: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which bytes are a token by themselves, by the 13a rules (their literal
    replacements made before).

    A symbol stands alone, and so does a dash after a digit.  Of a run of points
    and commas the rules take two at a time, from its first one after a digit, else
    from the character before it; all stand alone but the last, which stays with a
    digit after the run if the twos leave it over."""
    n, alone = len(data), kind == _SYMBOL
    first = np.zeros(n + 1, bool)
    first[offsets] = True  # also past the last byte
    at = np.flatnonzero(kind == _POINT)
    if len(at):
        start = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1] + 1) | first[at[1:]])))
        length = np.diff(np.append(start, len(at)))
        begin = at[start]
        end = begin + length
        after_digit = ~first[begin] & (kind[begin - 1] == _DIGIT)
        before_digit = ~first[end] & (kind[np.minimum(end, n - 1)] == _DIGIT)
        alone[at] = True
        alone[end[before_digit & ((length % 2 == 1) == after_digit)] - 1] = False
    at = np.flatnonzero(kind == _DASH)
    alone[at[~first[at] & (kind[at - 1] == _DIGIT)]] = True
    return alone


class Tokenised:
    """Token hashes of a slice of rows: ``h``, the row of each, and whether it
    is the mark.  Without a separator, tokens are cut by the 13a rules.  ``like``: the
    same bytes cut in another way, whose running sums are taken."""

    _base = 0x2545F4914F6CDD1D
    _up = _down = np.ones(1, U64)

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separator: int | None, like: Tokenised | None = None):
        n = len(data)
        if n > len(Tokenised._up):
            Tokenised._up = np.cumprod(np.full(2 * n, self._base, U64))
            Tokenised._down = np.cumprod(np.full(2 * n, pow(self._base, -1, 1 << 64), U64))
        if like is None:
            self.kind = self.not_space = None
            self.total = np.zeros(n + 1, U64)
            part = self.total[1:]
            np.add(data, U64(1), out=part)
            part *= self._up[:n]
            np.cumsum(part, out=part)
        else:
            self.kind, self.not_space, self.total = like.kind, like.not_space, like.total
        if separator in (None, WORDS) and self.kind is None:
            self.kind = _KIND[data]
            self.not_space = _inside(data, self.kind)
        inside, cut = np.zeros(n + 2, bool), np.zeros(n + 1, bool)
        inside[1:-1] = self.not_space if separator in (None, WORDS) else data != separator
        if separator is None:
            alone = _alone_13a(data, self.kind, offsets)
            cut[:-1] = alone
            cut[1:] |= alone
        cut[offsets] = True  # texts are laid end to end: a token also ends where its text does
        begin = np.flatnonzero(inside[1:] & (cut | ~inside[:-1]))
        end = np.flatnonzero(inside[:-1] & (cut | ~inside[1:]))
        self.h = _mix((self.total[end] - self.total[begin]) * self._down[begin])
        self.count = np.diff(np.searchsorted(begin, offsets))
        self.row = np.repeat(np.arange(len(self.count)), self.count)
        self.marked = (end - begin == 1) & (data[begin] == MARK) if separator == 0x20 else np.zeros(len(begin), bool)


def _grams(h: np.ndarray, row: np.ndarray, n: int, shift: int):
    """Keys of the n-grams inside rows, and the place of their first token."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    acc = h[:m].copy()
    for j in range(1, n):
        acc = acc * U64(0xD6E8FEB86659FD93) + h[j:j + m]
    at = np.flatnonzero(row[:m] == row[n - 1:])
    return (row[at].astype(U64) << U64(64 - shift)) | (_mix(acc[at] + U64(n)) >> U64(shift)), at


def _runs(keys: np.ndarray):
    """Distinct sorted keys, where their runs start, and the runs' lengths."""
    start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[start], start, np.diff(np.append(start, len(keys)))


def _counts(keys: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """How often each of the sorted ``asked`` keys is among ``keys``."""
    keys = np.sort(keys)
    return np.searchsorted(keys, asked, "right") - np.searchsorted(keys, asked, "left")


def _shared(hyp: np.ndarray, ref: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of two sides, how often each occurs, and at which of them the key is one
    of the first side that the second one has too (as the next).  The lowest bit of a key
    gives way to the side, so that one sort brings equal keys of both together."""
    keys = np.concatenate((hyp & ~U64(1), ref | U64(1)))
    keys.sort()
    distinct, _, count = _runs(keys)
    return distinct, count, np.flatnonzero((distinct[1:] ^ distinct[:-1]) == U64(1))


def _slice_stats(hyp: Tokenised, ref: Tokenised, rows: int) -> np.ndarray:
    """(rows, 10): lengths, clipped matches and totals of whole texts."""
    shift = max(1, int(rows - 1).bit_length())
    out = np.zeros((rows, 2 + 2 * MAX_ORDER), np.int64)
    out[:, 0], out[:, 1] = hyp.count, ref.count
    filed = [t.row.astype(U64) << U64(64 - shift) for t in (hyp, ref)]
    grams = [hyp.h, ref.h]
    for n in range(1, MAX_ORDER + 1):
        if n > 1:  # a gram of n tokens from that of its first n - 1
            grams = [g[:-1] * U64(0xD6E8FEB86659FD93) + t.h[n - 1:] for g, t in zip(grams, (hyp, ref))]
        keys = [(f[:len(g)] | (g >> U64(shift)))[t.row[:len(g)] == t.row[n - 1:]] for f, g, t in zip(filed, grams, (hyp, ref))]
        keys, count, both = _shared(*keys)
        out[:, 1 + n] = np.bincount((keys[both] >> U64(64 - shift)).astype(np.int64), weights=np.minimum(count[both], count[both + 1]), minlength=rows)
        out[:, 1 + MAX_ORDER + n] = np.maximum(out[:, 0] - n + 1, 0)
    return out


def _slice_sets(hyp: Tokenised, ref: Tokenised, rows: int) -> np.ndarray:
    """(rows, 3): the sizes of both texts' sets of tokens, and of what they share."""
    shift = max(1, int(rows - 1).bit_length())
    keys, _, both = _shared(*[(t.row.astype(U64) << U64(64 - shift)) | (t.h >> U64(shift)) for t in (hyp, ref)])
    row, of_ref = (keys >> U64(64 - shift)).astype(np.int64), (keys & U64(1)) == U64(1)
    return np.column_stack([np.bincount(row[side], minlength=rows) for side in (~of_ref, of_ref, both)])


# Which bytes belong to letters, numbers and "_" in texts of U+0000 to LATIN: beyond ASCII all but some of C2 and C3
LATIN = "\u024f"
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), 0x5F, *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_C2_IN_WORD = np.zeros(256, bool)
_C2_IN_WORD[[0xAA, 0xB2, 0xB3, 0xB5, 0xB9, 0xBA, 0xBC, 0xBD, 0xBE]] = True


def _latin_lengths(data: np.ndarray, offsets: np.ndarray, not_space: np.ndarray) -> np.ndarray:
    """Per text the number of matches of the default tokenizer's expression (text.TOKEN_RE),
    for texts without characters beyond LATIN: runs of letters, numbers and "_", and single other marks."""
    word = np.zeros(len(data) + 1, bool)
    word[1:] = _IN_WORD[data]
    in_word = word[1:]
    mark = ~in_word & not_space
    lead = np.flatnonzero((data == 0xC2) | (data == 0xC3))
    low = data[lead + 1]
    other = lead[np.where(data[lead] == 0xC2, ~_C2_IN_WORD[low], (low == 0x97) | (low == 0xB7))]
    in_word[other] = in_word[other + 1] = False
    mark[other] = not_space[other]
    before = word[:-1].copy()
    before[offsets[offsets < len(data)]] = False  # a run ends where its text does
    found = np.zeros(len(data) + 1, np.int64)
    np.cumsum(mark | (in_word & ~before), out=found[1:])
    return np.diff(found[offsets])


def _slice_prefix_stats(hyp: Tokenised, ref: Tokenised, rows: int, budgets: list[int]) -> np.ndarray:
    """(rows, 10 * budgets): the same for the first ``budget`` words of the
    first text, for all budgets in one walk: the j-th occurrence of a gram in
    the text is a match exactly if the other text has the gram j times or more, in
    whatever prefix it lies, so matches add up along the text."""
    shift = max(1, int(rows - 1).bit_length())
    marks = np.cumsum(hyp.marked)
    first = np.searchsorted(hyp.row, np.arange(rows))  # first token of each row
    before = np.concatenate(([0], marks))[first]
    word = (marks - before[hyp.row])[~hyp.marked]
    h, row = hyp.h[~hyp.marked], hyp.row[~hyp.marked]
    place = np.arange(len(h)) - np.searchsorted(row, np.arange(rows))[row]
    width = 2 + 2 * MAX_ORDER
    out = np.zeros((rows, width * len(budgets)), np.int64)
    length = [np.bincount(row, weights=word < b, minlength=rows).astype(np.int64) for b in budgets]
    out[:, 1::width] = np.bincount(ref.row, minlength=rows)[:, None]
    for k in range(len(budgets)):
        out[:, k * width] = length[k]
    for n in range(1, MAX_ORDER + 1):
        keys, at = _grams(h, row, n, shift)
        order = np.argsort(keys, kind="stable")
        distinct, start, count = _runs(keys[order])
        times = np.arange(len(order)) - np.repeat(start, count)
        matched = at[order[times < np.repeat(_counts(_grams(ref.h, ref.row, n, shift)[0], distinct), count)]]
        own, end = row[matched], place[matched] + n
        for k in range(len(budgets)):
            out[:, k * width + 1 + n] = np.bincount(own, weights=end <= length[k][own], minlength=rows)
            out[:, k * width + 1 + MAX_ORDER + n] = np.maximum(length[k] - n + 1, 0)
    return out


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (from 0) of an Arrow string column."""
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def _slices(ho: np.ndarray, ro: np.ndarray):
    """Stretches of rows of about SLICE bytes of both texts."""
    both, i = ho + ro, 0
    while i < len(both) - 1:
        j = min(max(int(np.searchsorted(both, both[i] + SLICE, "right")) - 1, i + 1), len(both) - 1)
        yield i, j
        i = j


def batch_stats(hyp: pa.Array, ref: pa.Array, separator: int | None, budgets: list[int] | None = None) -> np.ndarray:
    """Statistics of each pair of texts, one row per pair: sys_len, ref_len,
    m1..m4, t1..t4 (for each budget, with ``budgets``)."""
    (hd, ho), (rd, ro) = _buffers(hyp), _buffers(ref)
    parts = []
    for i, j in _slices(ho, ro):
        h = Tokenised(hd[ho[i]:ho[j]], ho[i:j + 1] - ho[i], separator)
        r = Tokenised(rd[ro[i]:ro[j]], ro[i:j + 1] - ro[i], separator)
        parts.append(_slice_stats(h, r, j - i) if budgets is None else _slice_prefix_stats(h, r, j - i, budgets))
    return np.concatenate(parts) if parts else np.zeros((0, (2 + 2 * MAX_ORDER) * len(budgets or [0])), np.int64)


def batch_pair_stats(hyp: pa.Array, ref: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each pair of texts the statistics of :func:`batch_stats` by the 13a rules, the sizes
    of both sets of words and of what they share, and the length of the second text in
    tokens of the default tokenizer (for texts without characters beyond LATIN)."""
    sides = [(column, replaced(column)) for column in (hyp, ref)]
    held = [(_buffers(raw), None if cut is raw else _buffers(cut)) for raw, cut in sides]
    stats, sets, lengths = [np.zeros((0, 2 + 2 * MAX_ORDER), np.int64)], [np.zeros((0, 3), np.int64)], [np.zeros(0, np.int64)]
    for i, j in _slices(held[0][0][1], held[1][0][1]):
        words, tokens = [], []
        for (data, at), other in held:
            data, at = data[at[i]:at[j]], at[i:j + 1] - at[i]
            words.append(Tokenised(data, at, WORDS))
            if other is None:
                tokens.append(Tokenised(data, at, None, like=words[-1]))
            else:
                tokens.append(Tokenised(other[0][other[1][i]:other[1][j]], other[1][i:j + 1] - other[1][i], None))
        stats.append(_slice_stats(*tokens, j - i))
        sets.append(_slice_sets(*words, j - i))
        lengths.append(_latin_lengths(data, at, words[-1].not_space))
    return np.concatenate(stats), np.concatenate(sets), np.concatenate(lengths)
