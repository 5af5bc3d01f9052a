"""Words of whole texts as the tokenizer's file cuts them, found with array operations.

Most texts hold only characters whose class is certain; they are cut here, all texts of a
block at once. Any other text is left to the tokenizers library.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE, LETTER, DIGIT, OTHER, UNSURE = 0, 1, 2, 3, 255
#: Fixed values of the file: what follows an apostrophe that begins a word of its own.
_ONE, _TWO = "stmd", ("re", "ve", "ll")
#: Beyond these ranges, and for these characters in them, the library decides.
_SURE = (range(0x00, 0x250), range(0x2010, 0x2028), range(0x2030, 0x205F), range(0x20A0, 0x20BA))
_ODD = frozenset([*range(0x1C, 0x20), *range(0x7F, 0xA1), 0xAD])


@lru_cache(1)
def _classes() -> np.ndarray:
    """The class of every character of the basic plane."""
    out = np.full(1 << 16, UNSURE, np.uint8)
    for span in _SURE:
        for c in span:
            if c in _ODD:
                continue
            general = unicodedata.category(chr(c))[0]
            out[c] = SPACE if c == 0x20 or 0x09 <= c <= 0x0D else LETTER if general == "L" else DIGIT if general == "N" else OTHER
    return out


def cut_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words, counts, unsure): lower-case words in a row, how many each text has, and texts left out.

    Null texts have no words. Texts with a special token's mark or a character of uncertain
    class are ``unsure`` and have none here.
    """
    texts = pc.fill_null(texts, "")
    lower = pc.utf8_lower(texts)
    if isinstance(lower, pa.ChunkedArray):
        lower = lower.combine_chunks()
    ends = np.frombuffer(lower.buffers()[1], np.int32)[lower.offset : lower.offset + len(lower) + 1].astype(np.int64)
    size = int(ends[-1] - ends[0])
    if not size:
        return pa.array([], pa.string()), np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
    raw = np.frombuffer(lower.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    kind = _classes()[:256][raw]
    lead = np.flatnonzero(raw >= 0xC0)
    if len(lead):
        first = raw[lead].astype(np.int64)
        tail = lambda k: raw[np.minimum(lead + k, size - 1)].astype(np.int64) & 0x3F
        long = first >= 0xE0
        code = np.where(long, (first & 0x0F) << 12 | tail(1) << 6 | tail(2), (first & 0x1F) << 6 | tail(1))
        found = np.where(first < 0xF0, _classes()[code & 0xFFFF], UNSURE).astype(np.uint8)
        kind[lead] = found
        kind[lead + 1] = found
        kind[lead[long] + 2] = found[long]
        more = first >= 0xF0
        kind[lead[more] + 3] = UNSURE
    begins = np.zeros(size + 1, bool)
    begins[ends] = True  # words end with their text
    start = begins.copy()
    start[1:-1] |= kind[1:] != kind[:-1]
    digits = np.flatnonzero(kind == DIGIT)
    start[digits[(raw[digits] & 0xC0) != 0x80]] = True  # each digit is a word
    marks = np.flatnonzero(raw == ord("'"))
    marks = marks[start[marks] & ~begins[marks + 1]]
    if len(marks):
        _contract(raw, kind, start, begins, marks)
    bounds = np.flatnonzero(start)
    bounds, stops = bounds[:-1], bounds[1:]  # the last one is the end
    full = kind[bounds] != SPACE
    bounds, length = bounds[full], (stops - bounds)[full]
    unsure = np.zeros(len(texts), bool)
    odd = np.flatnonzero(kind == UNSURE)
    special = np.flatnonzero((raw[:-1] == ord("<")) & (raw[1:] == ord("|")))
    # the library makes two characters of this one's lower case
    dotted = pc.match_substring(texts, "İ").to_numpy(zero_copy_only=False)
    unsure |= dotted
    for where in (odd, special):
        if len(where):
            unsure[np.unique(np.searchsorted(ends, where, "right") - 1)] = True
    counts = np.diff(np.searchsorted(bounds, ends))
    offsets = np.concatenate(([0], np.cumsum(length)))
    words = pa.StringArray.from_buffers(len(length), pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(raw[kind != SPACE].tobytes()))
    if unsure.any():
        words = words.filter(pa.array(~np.repeat(unsure, counts)))
        counts = np.where(unsure, 0, counts)
    return words, counts, unsure


def _contract(raw: np.ndarray, kind: np.ndarray, start: np.ndarray, begins: np.ndarray, marks: np.ndarray) -> None:
    """An apostrophe that begins a word takes certain letters with it."""
    size = len(raw)
    at = lambda k: raw[np.minimum(marks + k, size - 1)]
    one = np.isin(at(1), np.frombuffer(_ONE.encode(), np.uint8))
    two = np.zeros(len(marks), bool)
    for a, b in _TWO:
        two |= (at(1) == ord(a)) & (at(2) == ord(b)) & (marks + 2 < size) & ~begins[np.minimum(marks + 2, size)]
    for some, n in ((marks[one], 2), (marks[two], 3)):
        start[some + 1] = False
        after = some + n
        after = after[(after < size) & ~begins[np.minimum(after, size)]]
        start[after[kind[after] == LETTER]] = True


def text_blocks(texts: pa.Array, most: int = 1 << 21):
    """Runs (lo, hi) of texts of about ``most`` bytes at most, one text at least."""
    ends = np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))))
    lo, n = 0, len(texts)
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(ends, ends[lo] + most, "right")) - 1))
        yield lo, hi
        lo = hi
