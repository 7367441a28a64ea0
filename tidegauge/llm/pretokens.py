"""Pre-tokens of many texts at once, without a regular expression.

For the pattern of byte-level vocabularies (``public_tokenizers.PATTERN``) a pre-token is a
contraction, a run of letters, of digits or of other signs with the one blank before it, or
white space; white space before something else leaves its last character to what follows.
All of that is told by the classes of neighbouring characters, so the places where pre-tokens
begin come out of a few passes over an array of all texts' characters.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

OTHER, LETTER, DIGIT, SPACE = range(4)
#: Characters of white space, as Unicode's property has them.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@functools.cache
def class_table() -> np.ndarray:
    """The class of each code point."""
    out = np.zeros(0x110000, np.int8)
    for c in range(0x110000):
        out[c] = {"L": LETTER, "N": DIGIT}.get(unicodedata.category(chr(c))[0], OTHER)
    out[WHITE] = SPACE
    return out


def pretoken_starts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(byte places where pre-tokens begin in the texts put together, pre-tokens of each text)."""
    raw = "".join(texts.to_pylist())
    sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    code = np.frombuffer(raw.encode("utf-32-le"), np.uint32)
    n = len(code)
    ends = np.cumsum(sizes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    kind = class_table()[code]
    first = np.zeros(n + 1, bool)  # a text begins here
    first[np.append(0, ends)] = True
    run = first[:n].copy()  # a run of one class, in one text, begins here
    run[1:] |= kind[1:] != kind[:-1]
    white = kind == SPACE
    blank = np.append(False, code[:-1] == 32) & ~first[:n]  # after a blank of the same text
    starts = run & (white | ~blank)
    # The last character of white space before something else begins what follows, or is alone.
    last = np.append(white[:-1] & ~white[1:], False) & ~first[1:]
    starts |= last
    # A contraction is what it is, and parts the letters after it.
    padded, foreign = np.append(code, np.zeros(2, np.uint32)), np.append(first, True)
    after = [padded[k:k + n] for k in range(3)]
    own = [~foreign[k:k + n] for k in (1, 2)]  # the k-th next is of the same text
    at = starts & (code == 39)
    if at.any():
        for letters in CONTRACTIONS:
            hit = at & own[0] & (after[1] == ord(letters[0]))
            if len(letters) == 2:
                hit = hit & own[1] & (after[2] == ord(letters[1]))
            where = np.flatnonzero(hit)
            starts[where + 1] = False
            where = where + 1 + len(letters)
            starts[where[where < n]] = True
    width = 1 + (code >= 0x80).astype(np.int8) + (code >= 0x800) + (code >= 0x10000)
    begin = np.cumsum(width, dtype=np.int64) - width
    places = np.flatnonzero(starts)
    return begin[places], np.diff(np.searchsorted(places, np.append(0, ends)))
