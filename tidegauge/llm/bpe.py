"""Operator 8: byte-level BPE over overlapping chunks, and decoding by concatenation.

A text is dealt into chunks that overlap. Each chunk is pre-tokenised on its own, all chunks
of a batch of texts side by side in one array; a chunk starts anywhere, so its first
pre-tokens may be wrong until its boundaries meet the true ones. Pre-tokenising looks
behind nowhere: from a boundary that two neighbours share, the later chunk is right, so the
stitch takes the earlier chunk up to the first shared boundary that is safe from the
earlier chunk's cut end. Where an overlap shares none, the earlier chunk is pre-tokenised
on, in windows that double, until one is found. Then the pieces are encoded, each distinct
one once, and their ids put in the order of the texts.

Defined results: null text is empty (no ids, digests of the empty string); rows are
independent, so repeated rows, ties, null ids and extra columns change nothing; a very long
text is many chunks of one batch; an empty table gives an empty result; no special tokens,
their strings are ordinary text.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidegauge.llm.pretokens import pretoken_starts
from tidegauge.llm.shared import in_arrow, slices, table
from tidegauge.llm.units import BulkCache, RankEncoder

RANKS = "byte_bpe_50k.tiktoken"
CHUNK_BYTES = 4096
OVERLAP_BYTES = 128
#: Bytes of text whose characters are an array at once: about 40 bytes for each.
PRETOKEN_BYTES = 1_000_000
#: A boundary this close to a chunk's cut end may depend on what follows.
UNSAFE_TAIL = 4


class Chunk:
    """Pre-tokens of bytes start..end of a text; bounds[k] is where piece k begins, the last one the end."""

    def __init__(self, start: int, end: int, bounds: np.ndarray):
        self.start, self.end, self.bounds = start, end, bounds

    def safe(self, text_end: int) -> np.ndarray:
        return self.bounds if self.end == text_end else self.bounds[self.bounds <= self.end - UNSAFE_TAIL]


def spans(raw: bytes, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """Windows of about ``chunk`` bytes, each ``overlap`` into the next, cut between characters."""
    n = len(raw)
    return [(whole(raw, a), whole(raw, min(n, a + chunk))) for a in range(0, max(1, n - overlap), chunk - overlap)]


def whole(raw: bytes, at: int) -> int:
    """The first place from ``at`` on that isn't inside a character."""
    while at < len(raw) and raw[at] & 0xC0 == 0x80:
        at += 1
    return at


def stitch(n: int, chunks: list[Chunk], again) -> list[tuple[Chunk, int, int]]:
    """Runs (chunk, first piece, piece after the last) that make up a text of n bytes.

    again(a, b): a chunk of bytes a..b, where an overlap shares no boundary.
    """
    out, at, k = [], chunks[0], 0
    for after in chunks[1:]:
        if after.end <= at.end:
            continue
        safe = at.safe(n)
        safe = safe[safe >= at.bounds[k]]
        shared = np.intersect1d(safe, after.bounds, assume_unique=False)
        here = int(shared[0]) if len(shared) else int(safe[-1]) if len(safe) else int(at.bounds[k])
        out.append((at, k, int(np.searchsorted(at.bounds, here))))
        if len(shared):
            at, k = after, int(np.searchsorted(after.bounds, here))
        else:
            at, k = again(here, max(after.end, here + 2 * (at.end - here))), 0
    return [*out, (at, k, len(at.bounds) - 1)]


class ChunkedBpe(RankEncoder):
    """Encoder and decoder for one file of ranks."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN, chunk: int = CHUNK_BYTES, overlap: int = OVERLAP_BYTES):
        super().__init__(path, pattern)
        self.chunk, self.overlap, self.own = chunk, overlap, pattern == public_tokenizers.PATTERN
        self.pieces = BulkCache(lambda pieces: [self.plain(p.decode()) for p in pieces])

    def chunks(self, windows: list[tuple[bytes, int, int]]) -> list[Chunk]:
        """The pre-tokens of each window (text, start, end), on its own."""
        parts = [raw[a:b].decode() for raw, a, b in windows]
        if self.own:
            starts, counts = pretoken_starts(pa.array(parts, pa.string()))
        else:
            sizes = [[len(p.encode()) for p in self.pattern.findall(x)] for x in parts]
            starts, counts = np.cumsum([0, *(n for x in sizes for n in x)])[:-1], [len(x) for x in sizes]
        upto = np.append(0, np.cumsum(counts))
        base = np.append(0, np.cumsum([b - a for _, a, b in windows]))
        return [Chunk(a, b, np.append(starts[i:j] - at + a, b)) for (_, a, b), i, j, at in zip(windows, upto[:-1].tolist(), upto[1:].tolist(), base.tolist(), strict=False)]

    def bounds(self, texts: list[bytes]) -> list[np.ndarray]:
        """Where the pre-tokens of each text begin, and its end."""
        windows, of = [], []
        for raw in texts:
            own = spans(raw, self.chunk, self.overlap)
            of.append((len(windows), len(windows) + len(own)))
            windows += [(raw, a, b) for a, b in own]
        chunks, out = self.chunks(windows), []
        for raw, (a, b) in zip(texts, of, strict=True):
            if b - a == 1:
                out.append(chunks[a].bounds)
            else:
                again = lambda x, y, raw=raw: self.chunks([(raw, x, whole(raw, min(y, len(raw))))])[0]
                runs = stitch(len(raw), chunks[a:b], again)
                out.append(np.concatenate([*(c.bounds[i:j] for c, i, j in runs), [len(raw)]]))
        return out

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each text: chunks, seams, then every distinct piece is encoded once."""
        raws = [(t or "").encode() for t in texts.to_pylist()]
        bounds = self.bounds(raws)
        base = np.append(0, np.cumsum([len(r) for r in raws]))
        offsets = np.concatenate([*(b[:-1] + at for b, at in zip(bounds, base.tolist(), strict=False)), base[-1:]]).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(raws))]).dictionary_encode()
        distinct, at = pieces.dictionary.to_pylist(), pieces.indices.to_numpy()
        known = self.pieces.load(set(distinct))
        ids = [known[p] for p in distinct]
        count = np.array([len(x) // 4 for x in ids], np.int64)
        start = np.append(0, np.cumsum(count))
        flat, upto = np.frombuffer(b"".join(ids), "<u4"), np.append(0, np.cumsum(count[at]))
        flat = flat[np.repeat(start[at] - upto[:-1], count[at]) + np.arange(upto[-1])]
        ends = upto[np.append(0, np.cumsum([len(b) - 1 for b in bounds]))]
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            yield flat[a:b].tobytes()

    def encode(self, text: str) -> bytes:
        return next(self.encode_all(pa.array([text], pa.string())))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@functools.cache
def coder(path: str) -> ChunkedBpe:
    """One per Python worker."""
    return ChunkedBpe(path)


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """id and ``ids``, an array of token ids, for each row."""
    path = path or public_tokenizers.path(RANKS)
    small = docs.select(docs[id_col].alias(id_col), docs[text_col].alias("text"))
    kind = small.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in slices(batches, size=PRETOKEN_BYTES):
            ids = [np.frombuffer(x, dtype="<u4").astype(np.int32) for x in bpe.encode_all(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"])

    return in_arrow(small, run, f"`{id_col}` {kind}, ids array<int>")


def decode_ids(encoded: DataFrame, id_col: str = "doc_id", path: str | None = None) -> DataFrame:
    """id and ``bytes``, the raw bytes of ``ids``; null ids decode as none."""
    path = path or public_tokenizers.path(RANKS)
    small = encoded.select(encoded[id_col].alias(id_col), encoded["ids"].alias("ids"))
    kind = small.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in batches:
            raw = [bpe.decode(np.array(x or [], dtype="<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=[id_col, "bytes"])

    return in_arrow(small, run, f"`{id_col}` {kind}, bytes binary")


def encode_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Encode and decode each text in one pass; the ids stay in the task, digests leave it."""
    path = path or public_tokenizers.path(RANKS)
    small = docs.select(docs[id_col].alias(id_col), docs[text_col].alias("text"))
    kind = small.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in slices(batches, size=PRETOKEN_BYTES):
            n, of_ids, of_bytes = [], [], []
            for ids in bpe.encode_all(batch.column(1)):
                n.append(len(ids) // 4)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                of_bytes.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return in_arrow(small, run, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"))
