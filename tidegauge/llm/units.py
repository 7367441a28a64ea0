"""Pre-tokens of byte-level BPE, grouped into white-space units that can be cached.

A *unit* is a run of non-space characters with the single space or newline before it.
Where every white-space run of a text is one space or one newline, the pre-tokens of the
text are the pre-tokens of its units one after another, because the pattern looks behind
nowhere and looks ahead only from white space. Other texts take the pattern itself.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable, Iterable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken

#: Entries, and characters of keys, of one cache generation; two are alive at most.
CACHE_ENTRIES, CACHE_CHARS = 350_000, 16_000_000

_SPACE = regex.compile(r"\s")
#: A clean unit, for RE2: no control character or separator but the one at its front.
CLEAN_UNIT = r"^[ \n]?[^\x00-\x20\x{85}\p{Z}]+\z"


class BulkCache:
    """key -> value, computed many at a time, in two generations so that frequent keys stay."""

    def __init__(self, compute_many: Callable[[list[str]], Iterable], entries: int = CACHE_ENTRIES, chars: int = CACHE_CHARS):
        self.compute_many, self.entries, self.chars = compute_many, entries, chars
        self.now: dict = {}
        self.old: dict = {}
        self.held = 0

    def load(self, keys: set[str]) -> dict:
        """A dict that has all of ``keys`` until the next call."""
        if len(self.now) > self.entries or self.held > self.chars:
            self.old, self.now, self.held = self.now, {}, 0
        now, old = self.now, self.old
        new = [k for k in keys if k not in now]
        if new:
            now.update((k, old[k]) for k in new if k in old)
            fresh = [k for k in new if k not in now]
            now.update(zip(fresh, self.compute_many(fresh), strict=True))
            self.held += sum(map(len, new))
        return self.now


def split_units(text: str) -> list[str] | None:
    """Candidate units (each still has to be clean), or None if the text holds NUL."""
    if "\0" in text:
        return None
    return text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")


def are_clean(units: list[str]) -> list[bool]:
    """Whether each is one optional space or newline, then non-space characters only; '' is."""
    bodies = [u[1:] if u[:1] in (" ", "\n") else u for u in units]
    if " ".join(bodies).split() == bodies and not _SPACE.search("".join(bodies)):
        return [True] * len(units)
    return [u == "" or b.split() == [b] and not _SPACE.search(b) for u, b in zip(units, bodies, strict=True)]


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in character of each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def read_ranks(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Ranks and special tokens of a file of ranks or of a byte-level vocabulary.

    A vocabulary's merges have to be in the order of their results' ids, so that ids are ranks.
    """
    if path.endswith(".tiktoken"):
        with open(path, "rb") as f:
            return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, {}
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = byte_alphabet()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    vocab = spec["model"]["vocab"]
    made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
    if made != sorted(made):
        raise ValueError("merges are not in the order of ids")
    return {bytes(letters[c] for c in s): i for s, i in vocab.items() if s not in special}, special


class Rows(NamedTuple):
    """Ids of many texts: row k has units row_units[k]..row_units[k + 1], unit u has ids
    unit_ids[u]..unit_ids[u + 1] of ``ids`` and unit_bytes[u] bytes; rows that aren't clean
    have no meaning here."""

    ids: np.ndarray
    unit_ids: np.ndarray
    unit_bytes: np.ndarray
    row_units: np.ndarray
    clean: np.ndarray

    def of_row(self, k: int) -> bytes:
        return self.of_units(self.row_units[k], self.row_units[k + 1])

    def of_units(self, a: int, b: int) -> bytes:
        return self.ids[self.unit_ids[a]:self.unit_ids[b]].tobytes()


class RankEncoder:
    """Little-endian unsigned 32-bit ids of texts, special strings as ordinary text."""

    def __init__(self, path: str, pattern: str):
        ranks, self.specials = read_ranks(path)
        self.pattern = regex.compile(pattern)
        self.core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.lengths = np.array([len(t) for t in self.bytes_of], np.int64)

    def plain(self, text: str) -> bytes:
        return np.array(self.core.encode_ordinary(text), "<u4").tobytes()

    def rows(self, texts: pa.Array) -> Rows:
        """All texts at once: every distinct unit is encoded once, then ids are gathered."""
        texts = pc.fill_null(texts, "")
        split = pc.split_pattern(pc.replace_substring(pc.replace_substring(texts, " ", "\0 "), "\n", "\0\n"), "\0")
        row_units = split.offsets.to_numpy().astype(np.int64)
        row_units = row_units - row_units[0]
        coded = split.flatten().dictionary_encode()
        unit, distinct = coded.indices.to_numpy(), coded.dictionary
        size = pc.binary_length(distinct).to_numpy().astype(np.int64)
        ok = pc.match_substring_regex(distinct, CLEAN_UNIT).to_numpy(zero_copy_only=False)
        # A newline before each unit is a token of its own, and parts the units.
        ids = np.array(self.core.encode_ordinary("".join("\n" + u for u in distinct.filter(pa.array(ok)).to_pylist())), "<u4")
        upto = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum(size[ok] + 1)) + 1
        start, count = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        start[ok] = np.append(0, upto[:-1])[:len(upto)] + 1
        count[ok] = upto - start[ok]
        unit_ids = np.append(0, np.cumsum(count[unit]))
        flat = ids[np.repeat(start[unit] - unit_ids[:-1], count[unit]) + np.arange(unit_ids[-1])] if len(ids) else ids
        wrong = np.append(0, np.cumsum((~ok & (size > 0))[unit]))
        clean = (wrong[row_units[1:]] == wrong[row_units[:-1]]) & ~pc.match_substring(texts, "\0").to_numpy(zero_copy_only=False)
        return Rows(flat, unit_ids, size[unit], row_units, clean)
