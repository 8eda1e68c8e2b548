"""Pre-tokens of whole Arrow text columns, found with array operations.

Byte-level BPE first cuts a text into *pre-tokens* by this pattern (a fixed value of
the public vocabulary)::

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

A regex engine walks it text by text. Here the same cuts are found for all bytes of a
column at once: each byte gets the class of its character (letter, number, white space,
other), and a cut is a local property of the classes around it:

* where the class changes between two characters that are no white space;
* before a white-space run, and before the last character of a run of two or more that
  is followed by something else (a plain space then opens the next pre-token);
* before a character that follows white space other than a plain space;
* around a contraction: an apostrophe that opens a pre-token and is followed by one of the
  seven endings takes just that ending with it.

Cost is a few byte-wide array passes, so it runs at memory speed.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3

# The contraction endings of the pattern, and Unicode White_Space.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
WHITE = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


@functools.cache
def class_table() -> np.ndarray:
    """Class of every code point."""
    import regex

    out = np.full(0x110000, OTHER, np.uint8)
    text = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "\x00" for c in range(0x110000))
    for cls, pat in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pat, text):
            out[m.start() : m.end()] = cls
    out[list(WHITE)] = SPACE
    return out


def buffer_of(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the n+1 offsets of its rows in them (nulls are empty)."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("")
    wide = pa.types.is_large_string(arr.type)
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32, len(arr) + 1 + arr.offset)[arr.offset :].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def byte_classes(b: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """Class of each byte's character; mask of continuation bytes (None if all is ASCII)."""
    table = class_table()
    low = np.full(256, OTHER, np.uint8)
    low[:128] = table[:128]
    cls = low[b]
    lead = np.flatnonzero(b >= 0xC0)
    if not len(lead):
        return cls, None
    first = b[lead].astype(np.int32)
    n = 2 + (first >= 0xE0) + (first >= 0xF0)
    cp = np.where(n == 2, first & 0x1F, np.where(n == 3, first & 0x0F, first & 0x07))
    for k in (1, 2, 3):
        at = n > k
        cp[at] = (cp[at] << 6) | (b[lead[at] + k] & 0x3F)
    kinds = table[np.minimum(cp, 0x10FFFF)]
    cls[lead] = kinds
    for k in (1, 2, 3):
        at = n > k
        cls[lead[at] + k] = kinds[at]
    return cls, (b & 0xC0) == 0x80


def starts(b: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions where the pre-tokens of all rows begin, ascending."""
    n = len(b)
    if not n:
        return np.zeros(0, np.int64)
    cls, cont = byte_classes(b)
    first = np.zeros(n + 1, bool)
    first[offsets] = True  # row starts; position n closes the last row
    ws = cls == SPACE
    cut = np.empty(n, bool)
    cut[0] = True
    # class changes: from a word to white space, or between two kinds of words
    np.not_equal(cls[1:], cls[:-1], out=cut[1:])
    # after white space: a plain space belongs to what follows, so the cut is not here
    after = np.flatnonzero(cut[1:] & ws[:-1]) + 1
    cut[after[b[after - 1] == 0x20]] = False
    # the last character of a white-space run that something follows
    last = after
    if cont is not None:
        last = last.copy()
        prev = last - 1
        while (c := cont[prev]).any():
            prev[c] -= 1
    else:
        prev = last - 1
    prev = prev[~first[last]]  # a row's end closes the run as a whole
    cut[prev] = True
    # contractions
    apo = np.flatnonzero(b == 0x27)
    if len(apo):
        opens = first[apo] | ((apo > 0) & (cls[np.maximum(apo - 1, 0)] != OTHER) & (b[np.maximum(apo - 1, 0)] != 0x20))
        apo = apo[opens]
        pad = np.concatenate([b, np.zeros(3, np.uint8)])
        ends = np.zeros(len(apo), np.int64)
        for e in ENDINGS:
            ok = ends == 0
            for k, ch in enumerate(e.encode(), 1):
                ok &= (pad[apo + k] == ch) & ~first[np.minimum(apo + k, n)]
            ends[ok] = 1 + len(e)
        hit = ends > 0
        cut[apo[hit] + 1] = False
        stop = apo[hit] + ends[hit]
        cut[stop[stop < n]] = True
        # a plain space or more after the ending keeps its own rules: a cut before it is there anyway
    if cont is not None:
        cut &= ~cont
    cut |= first[:n]
    return np.flatnonzero(cut)


def words(b: np.ndarray, offsets: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The pre-tokens as a dictionary (each distinct one once), and how many each row has."""
    at = starts(b, offsets)
    bounds = np.append(at, len(b)).astype(np.int32)
    arr = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(b))])
    per_row = np.diff(np.searchsorted(at, offsets))
    return arr.dictionary_encode(), per_row


def slices(arr: pa.Array | pa.ChunkedArray, most: int):
    """Row ranges [i, j) of about ``most`` bytes of text; a longer text stands alone."""
    _, off = buffer_of(arr)
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j
