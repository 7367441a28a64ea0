"""Operator 1: exact token counts at every prefix, by dynamic programming.

For a pre-token, ``last[i]`` is the token that ends the encoding of its first ``i`` bytes.
A token ``t`` ending at ``i`` is that one exactly if it is compatible with ``last[i - |t|]``:
encoding the two tokens' bytes together gives back the two tokens. So one pass gives
``count[i] = count[i - |t|] + 1`` for every prefix. A text's table is kept as one signed
byte per code point: the change of the count from the prefix before. Its running sum is
the exact count of every prefix, which answers truncation and budget questions without
encoding anything again. Counts are not monotone: a longer prefix may need fewer tokens.

Defined results: null text counts as empty (0 tokens); the special token's string inside a
text counts as the library counts it, once; rows are independent, so repeated rows, ties,
null ids and extra columns change nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from tidegauge.llm.shared import in_arrow, slices, table
from tidegauge.llm.units import BulkCache, are_clean, read_ranks, split_units

VOCABULARY = "byte_bpe_50k.json"
TOKEN_LIMIT = 512
#: Token pairs whose compatibility a worker remembers.
PAIR_ENTRIES = 600_000
NO_RANK = 1 << 40

_RUN = regex.compile(r"\s+")


class Fits(dict):
    """(left token << 17 | right token) -> whether encoding both together gives both."""

    def __init__(self, fits):
        super().__init__()
        self.fits = fits

    def __missing__(self, key: int) -> bool:
        if len(self) >= PAIR_ENTRIES:
            self.clear()
        self[key] = value = self.fits(key >> 17, key & 0x1FFFF)
        return value


class PrefixCounter:
    """Prefix tables for one vocabulary file of the ``tokenizers`` library."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        self.rank, special = read_ranks(path)
        self.specials = sorted(special, key=len, reverse=True)
        self.bytes_of = {r: t for t, r in self.rank.items()}
        self.start = len(self.rank) + len(special)  # stands for the token before the first
        if max(map(len, self.rank)) > 128:
            # A step of the count is less than a token's length, which must fit a signed byte.
            raise ValueError("tokens of over 128 bytes")
        self.matcher = ahocorasick.Automaton()
        for token, rank in self.rank.items():
            self.matcher.add_word(token.decode("latin-1"), (rank, len(token)))
        self.matcher.make_automaton()
        self.pattern = regex.compile(pattern)
        self.fits = Fits(self._fits)
        self.units = BulkCache(self._clean_units)

    def merge(self, piece: bytes) -> list[int]:
        """Plain merging, for the short strings that compatibility is asked about."""
        parts, rank = [piece[k:k + 1] for k in range(len(piece))], self.rank
        pairs = [rank.get(piece[k:k + 2], NO_RANK) for k in range(len(piece) - 1)]
        while pairs and (best := min(pairs)) != NO_RANK:
            at = pairs.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at < len(pairs):
                pairs[at] = rank.get(parts[at] + parts[at + 1], NO_RANK)
            if at:
                pairs[at - 1] = rank.get(parts[at - 1] + parts[at], NO_RANK)
        return [rank[p] for p in parts]

    def _fits(self, left: int, right: int) -> bool:
        pair = [self.bytes_of[t] for t in (left, right) if t != self.start]
        return self.merge(b"".join(pair)) == [t for t in (left, right) if t != self.start]

    def prefix_counts(self, pieces: list[bytes]) -> list[list[int]]:
        """For each pre-token, the exact token counts of its first 1, 2, ... bytes.

        All pieces go in one scan of the token automaton, parted by a character that no
        token holds; position k of the scan stands for the prefix that ends there.
        """
        count, out, at = self.scan_counts(pieces), [], 1
        for p in pieces:
            out.append(count[at:at + len(p)])
            at += len(p) + 1
        return out

    def scan_counts(self, pieces: list[bytes]) -> list[int]:
        """The counts at every place of one scan: 0 before each piece, then those of its prefixes."""
        scan = "\u0100" + "\u0100".join(p.decode("latin-1") for p in pieces)
        last, count, fits = [self.start] * len(scan), [0] * len(scan), self.fits
        for end, (token, size) in self.matcher.iter(scan):
            if not count[end]:
                before = end - size
                if fits[last[before] << 17 | token]:
                    last[end], count[end] = token, count[before] + 1
        return count

    def unit_deltas(self, units: list[str]) -> list[bytes]:
        """Steps of the count over each unit: white space and the non-space characters after it."""
        run = [_RUN.match(u) for u in units]
        long = [k for k, m in enumerate(run) if m and m.end() > 1]
        if not long:
            return self.steps(units)
        odd = set(long)
        plain = iter(self.steps([u for k, u in enumerate(units) if k not in odd]))
        rest = iter(self.run_deltas([units[k] for k in long]))
        return [next(rest) if k in odd else next(plain) for k in range(len(units))]

    def steps(self, units: list[str]) -> list[bytes]:
        """:meth:`unit_deltas` of units with one character of white space at most, in one array.

        A step is the count at a character's last byte, less that at the character before it
        in the same pre-token: a pre-token begins at 0 again, as counts of pre-tokens add up.
        """
        pieces: list[str] = []
        upto = [0]
        for unit in units:
            if unit.isalpha() or unit[0] == " " and unit[1:].isalpha():
                pieces.append(unit)
            else:
                pieces += self.pattern.findall(unit)
            upto.append(upto[-1] + len(unit))
        raw = [p.encode() for p in pieces]
        count = np.array(self.scan_counts(raw), np.int32)
        scan = np.frombuffer(b"\0" + b"\0".join(raw), np.uint8)
        before = np.cumsum([0, *(len(r) + 1 for r in raw)])[:-1] if raw else np.zeros(0, np.int64)  # the place before each piece
        for k, p in enumerate(pieces):
            if len(p) == 3 and p[0] == "'" and p[1].isalpha():
                count[before[k] + 2] = 2  # cut inside a contraction, the apostrophe and the letter stand apart
        ends = np.append(scan[1:] & 0xC0 != 0x80, True)
        start = np.zeros(len(scan), bool)
        start[before] = True
        steps = np.diff(count[ends], prepend=0)[~start[ends]].astype(np.int8).tobytes() if raw else b""
        return [steps[x:y] for x, y in zip(upto, upto[1:], strict=False)]

    def run_deltas(self, units: list[str]) -> list[bytes]:
        """:meth:`unit_deltas` of any units: a prefix that ends in the white space has all of it as one pre-token."""
        plans, pieces = [], []
        for unit in units:
            m = run.end() if (run := _RUN.match(unit)) else 0
            own = self.pattern.findall(unit)
            plans.append((m, own))
            pieces += [unit[:m], *own] if m > 1 else own
        raw = [p.encode() for p in pieces]
        counts = iter(self.prefix_counts(raw))
        sized = iter(zip(pieces, raw, strict=True))

        def code_points() -> list[int]:
            (piece, encoded), found = next(sized), next(counts)
            if len(piece) == len(encoded):
                return found
            at, out = -1, []
            for c in piece:
                at += len(c.encode())
                out.append(found[at])
            return out

        result = []
        for m, own in plans:
            steps = array("b")
            before = base = at = 0
            for c in code_points() if m > 1 else ():
                steps.append(c - before)
                before = c
            for piece in own:
                here = code_points()
                if len(piece) == 3 and piece[0] == "'" and piece[1].isalpha():
                    here[1] = 2  # cut inside a contraction, the apostrophe and the letter stand apart
                for c in here if m <= 1 else here[max(0, m - at):]:
                    steps.append(base + c - before)
                    before = base + c
                base += here[-1]
                at += len(piece)
            result.append(steps.tobytes())
        return result

    def _clean_units(self, units: list[str]) -> list[bytes | None]:
        clean = are_clean(units)
        known = iter(self.unit_deltas([u for u, ok in zip(units, clean, strict=True) if ok and u]))
        return [(next(known) if u else b"") if ok else None for u, ok in zip(units, clean, strict=True)]

    def _plain(self, text: str, units: list[str] | None) -> bytes:
        if units is not None:
            try:
                return b"".join(map(self.units.now.__getitem__, units))
            except (KeyError, TypeError):  # not loaded, or not clean
                pass
        bounds = sorted({0, len(text), *(m.start() for m in _RUN.finditer(text))})
        return b"".join(self.unit_deltas([text[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]))

    def all_deltas(self, texts: list[str]) -> list[bytes]:
        """For each text one signed byte per code point: the step of the count to that prefix."""
        split = [split_units(t) for t in texts]
        self.units.load(set().union(*filter(None, split)))
        return [self._deltas(t, u) for t, u in zip(texts, split, strict=True)]

    def deltas(self, text: str) -> bytes:
        return self._deltas(text, split_units(text))

    def _deltas(self, text: str, units: list[str] | None) -> bytes:
        for s in self.specials:
            if s in text:
                *parts, rest = text.split(s)
                return b"".join(self._special(part, s) for part in parts) + self.deltas(rest)
        return self._plain(text, units) if text else b""

    def _special(self, before: str, special: str) -> bytes:
        """``before`` and one special string: ordinary text until its last character."""
        open_end = self._plain(before + special[:-1], None)
        steps = np.frombuffer(open_end, dtype=np.int8)
        whole = int(steps[:len(before)].sum(dtype=np.int64)) + 1
        return open_end + np.int8(whole - int(steps.sum(dtype=np.int64))).tobytes()

    def table(self, text: str) -> np.ndarray:
        """Token counts of text[:0], text[:1], ..., text."""
        steps = np.frombuffer(self.deltas(text), dtype=np.int8)
        return np.concatenate([[0], np.cumsum(steps, dtype=np.int64)])


def count_at(deltas: bytes, chars: int) -> int:
    """Exact token count of the first ``chars`` code points, from a stored table."""
    return int(np.frombuffer(deltas, dtype=np.int8)[:chars].sum(dtype=np.int64))


def longest_fit(deltas: bytes, budget: int) -> int:
    """Code points of the longest prefix that needs at most ``budget`` tokens."""
    steps = np.frombuffer(deltas, dtype=np.int8)
    total = np.cumsum(steps, dtype=np.int32)
    return int(np.flatnonzero(total <= budget)[-1]) + 1 if (total <= budget).any() else 0


@functools.cache
def counter(path: str) -> PrefixCounter:
    """One per Python worker."""
    return PrefixCounter(path)


def token_tables(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = TOKEN_LIMIT, keep_tables: bool = True) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit, fit_chars and, if kept, prefix_deltas of each row.

    ``fit_chars`` is the longest prefix, in code points, within ``limit`` tokens.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    small = docs.select(docs[id_col].alias(id_col), docs[text_col].alias("text"))
    id_type = small.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, n_bytes bigint, n_tokens bigint, over_limit boolean, fit_chars bigint" + ", prefix_deltas binary" * keep_tables

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = counter(path)
        for batch in slices(batches):
            n_tokens, fit, kept = [], [], []
            for d in of.all_deltas([t or "" for t in batch.column(1).to_pylist()]):
                n = count_at(d, len(d))
                n_tokens.append(n)
                fit.append(len(d) if n <= limit else longest_fit(d, limit))
                kept.append(d)
            n_bytes = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            tokens = pa.array(n_tokens, pa.int64())
            columns = [batch.column(0), n_bytes, tokens, pc.greater(tokens, limit), pa.array(fit, pa.int64())]
            names = [id_col, "n_bytes", "n_tokens", "over_limit", "fit_chars"]
            if keep_tables:
                columns, names = [*columns, pa.array(kept, pa.binary())], [*names, "prefix_deltas"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return in_arrow(small, run, schema)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_tables(table(spark, sf_dir, "documents"), keep_tables=False)
