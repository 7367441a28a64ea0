"""Operators 1, 8 and 10 against the libraries, on odd texts."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from tidegauge.llm import bpe, packing, pretokens, token_counts

SCHEMA = "doc_id bigint, text string, lang string, n_tokens string"
ODD = ["a", "the", "'s", "'re", " 'll", " ", "  ", "\n", "\n\n", "\t", "\r\n", "é", "日本", "🙂", "12", "!", "...", "\u00a0", "\x1c", "\x85", "<|endoftext|>", "<|end", " hello", "World", "٣", "'", "\0", "\u200b", " so", "\nThe", " end."]


def odd_texts(n=250, seed=4):
    r = random.Random(seed)
    return ["".join(r.choice(ODD) for _ in range(r.randrange(14))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def rows(spark):
    texts = [None, "", "  \n", "word " * 9000, "x" * 5000, *odd_texts(), "same", "same"]
    data = [(k, t, "en", "clash") for k, t in enumerate(texts)] + [(None, "no id", None, None), (3, "repeated id", None, None)]
    return spark.createDataFrame(data, SCHEMA), data


def test_every_prefix(library):
    of = token_counts.PrefixCounter(public_tokenizers.path("byte_bpe_50k.json"))
    for text in [*odd_texts(400), "naïve déjà-vu's end", "aaaa" * 20]:
        want = [len(library.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
        assert of.table(text).tolist() == want
        deltas = of.deltas(text)
        for budget in (1, 3, 7):
            assert token_counts.longest_fit(deltas, budget) == max(k for k, n in enumerate(want) if n <= budget)
        assert token_counts.count_at(deltas, len(text) // 2) == want[len(text) // 2]


def test_token_tables(rows, library):
    df, data = rows
    got = sorted(token_counts.token_tables(df).collect(), key=str)
    assert len(got) == len(data)
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] != 3}
    for k, text, *_ in data:
        if k != 3:
            n = len(library.encode(text or "", add_special_tokens=False).ids)
            assert (by_id[k]["n_tokens"], by_id[k]["n_bytes"], by_id[k]["over_limit"]) == (n, len((text or "").encode()), n > 512)
    assert token_counts.token_tables(df.limit(0)).count() == 0


def test_byte_bpe(rows):
    df, data = rows
    core = bpe.ChunkedBpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), chunk=64, overlap=16)
    want = {}
    for k, text, *_ in data:
        ids = np.array(core.core.encode_ordinary(text or ""), "<u4").tobytes()
        assert core.encode(text or "") == ids, text
        assert core.decode(ids) == (text or "").encode()
        want.setdefault(k, set()).add((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    for r in bpe.encode_digests(df).collect():
        assert tuple(r)[1:] in want[r["doc_id"]]
    encoded = bpe.encode_texts(df)
    back = {r["doc_id"]: bytes(r["bytes"]) for r in bpe.decode_ids(encoded).collect()}
    assert back[5] == (data[5][1] or "").encode() and back[0] == b""
    assert bpe.encode_digests(df.limit(0)).count() == 0


@pytest.mark.parametrize(("chunk", "overlap"), [(8, 5), (16, 6), (40, 9)])
def test_stitching(chunk, overlap):
    core = bpe.ChunkedBpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), chunk=chunk, overlap=overlap)
    for text in odd_texts(150, seed=chunk):
        assert np.frombuffer(core.encode(text), "<u4").tolist() == core.core.encode_ordinary(text)


def test_pretokens_are_the_patterns():
    """Against the pattern itself: odd texts side by side, and every character among others."""
    import pyarrow as pa
    import regex

    pattern = regex.compile(public_tokenizers.PATTERN)
    texts = [*odd_texts(400, seed=9), "", "'s", "''s", " 's'll 'x don't'", "we'rea 're", "a  b \n c\n\n", "x'l", "'", "  "]
    starts, counts = pretokens.pretoken_starts(pa.array(texts))
    want = [[len(p.encode()) for p in pattern.findall(t)] for t in texts]
    assert counts.tolist() == [len(x) for x in want]
    assert starts.tolist() == np.cumsum([0, *(n for x in want for n in x)])[:-1].tolist()


def test_every_character_as_the_library():
    core = bpe.ChunkedBpe(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for a in range(0, 0x30000, 0x400):
        text = "".join(f"a{chr(c)}b {chr(c)}{chr(c)}1 " for c in range(a, a + 0x400) if not 0xD800 <= c < 0xE000)
        assert np.frombuffer(core.encode(text), "<u4").tolist() == core.core.encode_ordinary(text), hex(a)


def test_seams_need_their_overlap():
    """Chunks of long runs share no boundary in the overlap: the earlier one is pre-tokenised on."""
    core, calls = bpe.ChunkedBpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), chunk=32, overlap=5), []
    make = core.chunks
    core.chunks = lambda windows: (calls.append(len(windows)), make(windows))[1]
    text = " ".join(w * n for w, n in (("ab", 40), ("it's we'll ", 9), ("  \n", 30), ("1", 70), ("!?", 33), ("\u00e9", 50)))
    assert np.frombuffer(core.encode(text), "<u4").tolist() == core.core.encode_ordinary(text)
    assert calls[0] > 10 and len(calls) > 1
    alone = [c.bounds for c in make([(text.encode(), a, b) for a, b in bpe.spans(text.encode(), 32, 5)])]
    assert any(not len(np.intersect1d(x[x <= x[-1] - bpe.UNSAFE_TAIL], y)) for x, y in zip(alone, alone[1:]))


def test_plan_is_a_packing():
    r = random.Random(1)
    for capacity in (10, 64, 1024):
        counts = {s: r.randrange(0, 40) for s in r.sample(range(1, capacity + 1), min(capacity, 60))}
        runs, bins = packing.plan_bins(counts, capacity)
        fill, seen = {}, {}
        for size, a, b, first, per_bin, offset in runs:
            seen.setdefault(size, []).extend(range(a, b))
            for k in range(b - a):
                at = offset + k % per_bin * size
                fill.setdefault(first + k // per_bin, []).append((at, at + size))
        assert {s: sorted(x) for s, x in seen.items()} == {s: list(range(n)) for s, n in counts.items() if n}
        for spans in fill.values():
            spans.sort()
            assert spans[0][0] == 0 and spans[-1][1] <= capacity and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))
            assert sum(3 * (b - a) > capacity for a, b in spans) <= 2
        assert bins == len(fill) and bins <= 1.2 * -(-sum(s * n for s, n in counts.items()) // capacity) + 1


def test_packing(rows, library):
    df, data = rows
    got = packing.pack_documents(df).collect()
    assert set(df.limit(0).columns) and packing.pack_documents(df.limit(0)).count() == 0
    spans = {}
    for r in got:
        spans.setdefault(r["sequence_id"], []).append((r["offset"], r["offset"] + r["length"]))
    for s in spans.values():
        s.sort()
        assert s[0][0] == 0 and s[-1][1] <= 1024 and all(x[1] == y[0] for x, y in zip(s, s[1:]))
    for k, text, *_ in data:
        if k in (3, None):
            continue
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        pieces = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got if r["doc_id"] == k)
        assert sum(p[2] for p in pieces) == len(ids) and all(p[2] == 1024 for p in pieces[1:])
        assert [p[3] for p in pieces] == [zlib.crc32(ids[s:s + n].tobytes()) for _, s, n, _ in pieces]
