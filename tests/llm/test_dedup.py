"""Operators 2 and 7 against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tidegauge.llm import exact_dedup, near_dedup
from tidegauge.llm.components import connected_components

SCHEMA = "doc_id bigint, text string, fp string, keep_id string"


def test_quotient_filters_merge_losslessly():
    r = np.random.default_rng(2)
    for bits in (8, 40, 64):
        parts = [r.integers(0, 2 ** min(bits, 63), n, dtype=np.uint64) % np.uint64(200 if bits == 8 else 2**62) for n in (1, 50, 3000)]
        parts.append(parts[2][:500])
        built = [exact_dedup.CountingQuotientFilter.build(*np.unique(p, return_counts=True), bits) for p in parts]
        again = [exact_dedup.CountingQuotientFilter.unpack(*f.pack()) for f in built]
        keys, counts = exact_dedup.CountingQuotientFilter.merge(again).entries()
        want, n = np.unique(np.concatenate(parts), return_counts=True)
        assert np.array_equal(keys, want) and np.array_equal(counts, n.astype(np.uint64))


def test_exact_groups(spark):
    texts = ["a b", "ab", " a\tb\n", "a\u00a0b", None, "", " \n", "x" * 50_000, "x" * 50_000, "y", "ab"]
    data = [(k, t, "clash", "clash") for k, t in enumerate(texts)] + [(None, "ab  ", "", ""), (20, "ab   ", "", ""), (20, "ab   ", "", "")]
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    got = exact_dedup.exact_groups(df).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for k, t, *_ in data:
        groups.setdefault(norm(t), []).append((-len(t or ""), k is None, k or 0, k))
    assert len(got) == len(data) and sum(r["kept"] for r in got) == len(groups)
    for r in got:
        text = next(n for n in groups if hashlib.sha256(n.encode()).hexdigest() == r["text_sha256"])
        assert r["keep_id"] == min(groups[text])[3] and r["group_size"] == len(groups[text])
    kept = exact_dedup.drop_exact_copies(df)
    assert kept.columns == df.columns and sorted(norm(r["text"]) for r in kept.collect()) == sorted(groups)
    assert exact_dedup.exact_groups(df.limit(0)).count() == 0 and exact_dedup.drop_exact_copies(df.limit(0)).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def changed(r, words, edits):
    words = list(words)
    for _ in range(edits):
        at = r.randrange(len(words) + 1)
        words[at:at + r.choice([0, 1, 1])] = [f"new{r.randrange(10**6)}"] if r.random() < 0.8 else []
    return words


def test_banded_distance():
    r = random.Random(3)
    for _ in range(800):
        a = [r.randrange(9) for _ in range(r.randrange(25))]
        b = changed(r, a, r.randrange(7)) if a else []
        b = [x if isinstance(x, int) else int(x[3:]) for x in b]
        most, d = r.randrange(10), distance(a, b)
        assert near_dedup.banded_distance(np.array(a, np.uint32), np.array(b, np.uint32), most) == (d if d <= most else None)


def test_near_classes(spark):
    r = random.Random(8)
    words = [f"w{k}" for k in range(400)]
    texts = [None, "", "one two", "One  two", "three"]
    for _ in range(25):
        base = [r.choice(words) for _ in range(r.choice([40, 120, 400]))]
        texts += [" ".join(changed(r, base, e)) for e in (0, 0, 1, 2, 4, 30)]
    chain = [r.choice(words) for _ in range(200)]
    for _ in range(6):  # each near the one before it
        chain = changed(r, chain, 4)
        texts.append(" ".join(chain))
    ids = [*range(len(texts))]
    data = [(k, t, "", "") for k, t in zip(ids, texts)] + [(None, "one two", "", ""), (7, texts[7], "", "")]
    df = spark.createDataFrame(data, SCHEMA).repartition(4)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(df).collect()}
    sh, n = near_dedup.word_hashes(pa.array(texts, pa.string()))
    ends = np.append(0, np.cumsum(n))
    seqs = [sh[a:b].astype(np.uint32) for a, b in zip(ends, ends[1:])]
    parent = list(ids)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in ids:
        for j in ids[:i]:
            if near_dedup.similar(seqs[i], seqs[j]) is not None:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    assert all(got[i] == find(i) for i in ids)
    kept = near_dedup.keep_one(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted({find(i) for i in ids})
    assert near_dedup.near_classes(df.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_components(spark, kind):
    r = random.Random(5)
    pairs = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 140)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)] + [(7, 7), (300, 301), (301, 300)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    as_ = (lambda x: x) if kind == "bigint" else (lambda x: f"{x:05d}")
    for a, b in pairs:
        if a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    want = {(as_(x), as_(find(x))) for x in parent}
    df = spark.createDataFrame([(as_(a), as_(b)) for a, b in pairs], f"a {kind}, b {kind}")
    assert {tuple(x) for x in connected_components(df).collect()} == want


def test_block_links_lose_none():
    """Every pair of different components at 0.8 or more that shares the bucket first is linked, or its component is."""
    r = random.Random(12)
    words = [f"w{k}" for k in range(300)]
    base = [r.choice(words) for _ in range(90)]
    texts = [" ".join(changed(r, base, r.randrange(24))) for _ in range(90)] + [" ".join(base[:60] + [r.choice(words) for _ in range(30)]) for _ in range(8)] + ["the " * 80, "the " * 90, "of " * 80, "the " * 40 + "of " * 40]
    hashes, counts = near_dedup.word_hashes(pa.array(texts))
    ends = np.append(0, np.cumsum(counts))
    kmer, k = near_dedup.kmers(hashes, counts)
    keys = near_dedup.order_sketches(near_dedup.labelled(kmer, k), k).view(np.int64)
    seqs = [hashes[a:b].astype(np.uint32) for a, b in zip(ends, ends[1:])]
    rows = [{"node": k, "n": int(counts[k]), "comp": k % 5, "inside": k % 5 == 0, "keys": keys[k].tolist(), "seq": seqs[k].tobytes()} for k in range(len(texts))]
    kind = pa.struct([("node", pa.int64()), ("n", pa.int32()), ("comp", pa.int64()), ("inside", pa.bool_()), ("keys", pa.list_(pa.int64())), ("seq", pa.binary())])
    found, want = set(), set()
    for key in {x for row in rows for x in row["keys"]}:
        members = [x for x in rows if key in x["keys"]]
        if all(x["inside"] for x in members):
            continue
        for a, b, s in near_dedup.block_links(key, pa.array([x for x in members if not x["inside"]], kind), pa.array(members, kind), 0.8):
            assert a > b and abs(s - (1 - distance(texts[a].split(), texts[b].split()) / max(len(texts[a].split()), len(texts[b].split())))) < 1e-9
            found |= {(a, b % 5), (b, a % 5)}
        for x in members:
            for y in members:
                if x["comp"] != y["comp"] and near_dedup.similar(seqs[x["node"]], seqs[y["node"]]) is not None:
                    want.add((x["node"], y["node"]))
    assert len(want) > 50 and all((a, b % 5) in found or (b, a % 5) in found for a, b in want)


def test_order_sketches_are_the_least_kmers_in_text_order():
    r = random.Random(4)
    texts = ["", "a", "a b", *(" ".join(r.choice("abcdefghij") * r.randint(1, 2) for _ in range(n)) for n in (3, 4, 5, 18, 60, 400))]
    kmer, counts = near_dedup.kmers(*near_dedup.word_hashes(pa.array(texts)))
    split = [t.split() for t in texts]
    assert counts.tolist() == [max(1, len(w) - 2) if w else 0 for w in split]
    grams = [tuple(w[k:k + 3]) for w in split if w for k in range(max(1, len(w) - 2))]
    assert all((x == y) == (a == b) for x, a in zip(kmer, grams) for y, b in zip(kmer, grams))
    of = near_dedup.labelled(kmer, counts)
    nth = lambda k, row: sum(grams[j] == grams[k] for j in range(row, k))
    ends = np.append(0, np.cumsum(counts))
    names = [(grams[k], nth(k, a)) for a, b in zip(ends, ends[1:]) for k in range(a, b)]
    assert all((x == y) == (a == b) for x, a in zip(of, names) for y, b in zip(of, names))
    keys = near_dedup.order_sketches(of, counts)
    seeds = np.random.default_rng(near_dedup.SEED).integers(1, 1 << 63, near_dedup.SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    seen = {}
    for row, (a, b) in enumerate((a, b) for a, b in zip(ends, ends[1:]) if b > a):
        for s, seed in enumerate(seeds):
            value = of[a:b] * seed
            value ^= value >> np.uint64(31)
            at = sorted(sorted(range(b - a), key=lambda k: value[k])[:near_dedup.KEPT])
            seen.setdefault((s, tuple(of[a:b][at].tolist())), set()).add(int(keys[row, s]))
    assert all(len(x) == 1 for x in seen.values()) and len({x for y in seen.values() for x in y}) == len(seen)


@pytest.mark.parametrize("n", [20, 100, 1000])
def test_recall_against_all_pairs(n):
    """Of the pairs that an alignment of words, written apart, puts at 0.8 or more, 0.9 share a sketch and are verified."""
    r = random.Random(n)
    words = [f"w{k}" for k in range(5000)]
    pairs = []
    for _ in range(120):
        base = [r.choice(words) for _ in range(n)]
        pairs.append((base, changed(r, base, r.randint(1, max(1, n // 5)))))
    near = [(a, b) for a, b in pairs if 1 - distance(a, b) / max(len(a), len(b)) >= 0.8 - 1e-9]
    hashes, counts = near_dedup.word_hashes(pa.array([" ".join(x) for pair in near for x in pair]))
    kmer, k = near_dedup.kmers(hashes, counts)
    keys = near_dedup.order_sketches(near_dedup.labelled(kmer, k), k)
    ends = np.append(0, np.cumsum(counts))
    seqs = [hashes[a:b].astype(np.uint32) for a, b in zip(ends, ends[1:])]
    found = [bool((keys[i] == keys[i + 1]).any()) and near_dedup.similar(seqs[i], seqs[i + 1]) is not None for i in range(0, len(seqs), 2)]
    print("recall", n, len(near), np.mean(found))
    assert len(near) > 60 and np.mean(found) >= 0.9


def test_keep_one_passes_any_column_through(spark):
    texts = ["a b c d e f g h i j", "a b c d e f g h i k", None, "", "x y", "x y", "long " * 30_000, "long " * 29_990 + "end"]
    data = [(k, t, k * 10, f"r{k}", k) for k, t in enumerate(texts)] + [(0, texts[0], 0, "r0", 0), (None, texts[4], 5, "null", 5)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, __row bigint, own_0 string, comp bigint").repartition(3)
    got = sorted(near_dedup.keep_one(df).collect())
    assert [tuple(r) for r in got] == [data[k] for k in (0, 2, 4, 6)]
