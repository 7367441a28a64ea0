"""Operator 2: near-duplicates by order MinHash, verified by banded alignment.

A text is its sequence of lower-cased words between white space. Its k-mers are the runs of
KMER_WORDS words; order MinHash labels each with its occurrence number, takes per sketch the
few labelled k-mers of least hash and keeps them in the order of the text: two texts agree
in a sketch with a probability that follows their edit similarity, not only their overlap.
Texts that agree in a sketch are candidates; the edit distance of their word sequences,
aligned within the band that the threshold allows, decides:
    similarity = 1 - distance / longer length, linked from 0.8 on.
So one changed word costs one edit. Two texts whose five-word shingles have a Jaccard
similarity of 0.8 or more differ in a few words in a hundred and are linked as well.

Equal sequences are one node from the start. A sketch bucket is not expanded into pairs:
each node is aligned with the bucket's first node, the one whose sketches most other nodes
share (an original before its variants), and the verified links are contracted by connected
components. Where a bucket then still spans several components, its nodes are dealt into
blocks of bounded size and blocks meet in pairs, spread over the tasks: there, nodes outside
the first node's component are compared with the nodes of other components, by lengths and
word bitmaps first, and what passes is aligned. Only links leave a task; a pair is aligned in
the first bucket that it shares; a node that is linked with a component needs no second link
with it. So no link between different texts of a bucket is lost.

Defined results: null text counts as empty; texts without words form one class; texts of
fewer words than a k-mer have one k-mer of all their words; repeated rows fall in one class;
a null id takes part, and a class id is the least non-null id of its class (null if there is
none), so that two classes share a class id only where different texts share a doc id; ties
change nothing, since every candidate is aligned or already linked; very long texts are taken
whole, and the band of an alignment grows with them; extra columns are ignored, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegauge.llm.components import connected_components
from tidegauge.llm.exact_dedup import text_mark
from tidegauge.llm.shared import cut, in_arrow, new_names, release, slices, table, trim

KMER_WORDS, SIMILARITY = 3, 0.8
#: Sketches, and labelled k-mers in each. Where scattered edits leave a similarity of s, texts
#: share j = s**3 / (2 - s**3) of their k-mers and are missed with probability (1 - j**3)**40:
#: 0.19 at 0.8, 0.03 at 0.85, 2e-4 at 0.9. Texts that share a tenth of their k-mers (a passage)
#: agree in a sketch with probability 40 * 0.1**3 = 0.04.
SKETCHES, KEPT = 40, 3
#: Values of a row, about, among which its least ones are looked for.
LOW_VALUES = 16
SEED = 0x51ED270B
#: 64-bit words of the bitmap of a text's words, each with its occurrence number: a changed
#: word changes two bits at most, an added one one, so more differing bits than the allowed
#: distance can make rule a pair out.
BITMAP_WORDS = 64
#: Bytes of a block, in the mean, counting NODE_BYTES and the words' for each node, and nodes
#: that are compared with a block at once.
BLOCK_BYTES, NODE_BYTES, COMPARED = 2_000_000, 1_000, 64
#: Bytes of text that are sketched at once: about 30 bytes for each.
SKETCH_BYTES = 2_000_000
#: Node ids up to which a list of nodes is broadcast (about 50 MB in Spark).
BROADCAST_NODES = 1_000_000

_M = np.uint64(0xFF51AFD7ED558CCD)
_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread bits: a bijection of 64-bit integers."""
    x = (x ^ (x >> np.uint64(33))) * _M
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word, words of each row)."""
    split = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    offsets = split.offsets.to_numpy().astype(np.int64)
    coded = split.flatten().dictionary_encode()
    of = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    full = pc.binary_length(coded.dictionary).to_numpy() > 0
    at = coded.indices.to_numpy()
    keep = full[at] if len(at) else np.zeros(0, bool)
    counts = np.diff(np.append(0, np.cumsum(keep))[offsets - offsets[0]])
    return of[at][keep] if len(at) else np.zeros(0, np.uint64), counts


def kmers(hashes: np.ndarray, words: np.ndarray, k: int = KMER_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the k-mers of all rows in order, k-mers of each row)."""
    counts = np.where(words > 0, np.maximum(1, words - k + 1), 0)
    row = np.repeat(np.arange(len(words)), counts)
    first = np.append(0, np.cumsum(words))[:-1]
    base = np.append(0, np.cumsum(counts))[:-1]
    start = first[row] + np.arange(len(row)) - base[row]
    left = np.minimum(k, words[row])
    out = np.zeros(len(row), np.uint64)
    for j in range(k):
        there = j < left
        w = np.where(there, hashes[np.minimum(start + j, max(0, len(hashes) - 1))], np.uint64(0)) if len(hashes) else np.zeros(0, np.uint64)
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + w + np.uint64(j + 1))
    return out, counts


def labelled(kmer: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Hashes of (k-mer, occurrence number within its row)."""
    row = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((kmer, row))
    s, r = kmer[order], row[order]
    new = np.append(True, (s[1:] != s[:-1]) | (r[1:] != r[:-1])) if len(s) else np.zeros(0, bool)
    place = np.arange(len(s))
    nth = np.empty(len(s), np.uint64)
    nth[order] = (place - np.maximum.accumulate(np.where(new, place, 0))).astype(np.uint64)
    return mix(kmer + nth * np.uint64(0xD6E8FEB86659FD93))


def order_sketches(hashes: np.ndarray, counts: np.ndarray, sketches: int = SKETCHES, kept: int = KEPT) -> np.ndarray:
    """rows-with-k-mers x sketches keys; each covers the ``kept`` least k-mers in text order.

    Each sketch orders the hashes anew. A row's least values are looked for among those below
    a bound that about LOW_VALUES of them pass; a row where too few do is looked at whole.
    """
    some = counts[counts > 0]
    n = len(some)
    seeds = np.random.default_rng(SEED).integers(1, 1 << 63, sketches, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    keys = np.zeros((n, sketches), np.uint64)
    if not n:
        return keys
    row = np.repeat(np.arange(n, dtype=np.int32), some)
    bound = np.repeat(np.where(some <= LOW_VALUES, _MAX, (LOW_VALUES / np.maximum(some, LOW_VALUES + 1) * 2.0**64).astype(np.uint64)), some)
    for s in range(sketches):
        value = hashes * seeds[s]
        value ^= value >> np.uint64(31)
        low = value <= bound
        few = np.bincount(row[low], minlength=n) < np.minimum(kept, some)
        if few.any():
            low |= few[row]
        at = np.flatnonzero(low)
        at = at[np.lexsort((value[at], row[at]))]
        first = np.searchsorted(row[at], np.arange(n))
        place = np.full((n, kept), len(hashes))
        for j in range(kept):
            there = j < some
            place[there, j] = at[first[there] + j]
        place.sort(axis=1)
        key = np.full(n, s + 1, np.uint64)
        for j in range(kept):
            key = mix(key * np.uint64(31) + np.where(place[:, j] < len(hashes), hashes[np.minimum(place[:, j], len(hashes) - 1)], np.uint64(j)))
        keys[:, s] = key
    return keys


def bitmaps(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """rows x BITMAP_WORDS: which of 64 * BITMAP_WORDS places a row's numbered words take.

    words: hashes of all rows, as ``seq`` keeps them.
    """
    row = np.repeat(np.arange(len(counts)), counts)
    out = np.zeros(len(counts) * BITMAP_WORDS, np.uint64)
    place = labelled(words.astype(np.uint64), counts) >> np.uint64(40)
    np.bitwise_or.at(out, row * BITMAP_WORDS + ((place >> np.uint64(6)) % np.uint64(BITMAP_WORDS)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
    return out.reshape(-1, BITMAP_WORDS)


def sketched(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, mark, row_id, n words, h1 and h2 (of the whole sequence), seq and keys of every row."""
    small = docs.select(F.col(text_col).alias("text"), F.col(id_col).cast("bigint").alias("doc_id"), text_mark(F.col(text_col)).alias("mark"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in slices(batches, text=0, size=SKETCH_BYTES):
            hashes, words = word_hashes(batch.column(0))
            kmer, counts = kmers(hashes, words)
            keys = order_sketches(labelled(kmer, counts), counts).view(np.int64)
            ends = np.append(0, np.cumsum(words))
            h = np.array([xxhash.xxh3_128_digest(hashes[a:b].data) for a, b in zip(ends, ends[1:], strict=False)], "V16").view("<i8").reshape(-1, 2)
            low = hashes.astype(np.uint32)
            seq = [low[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)]
            key_ends = np.append(0, np.cumsum(np.where(counts > 0, keys.shape[1], 0))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), pa.array(row + np.arange(batch.num_rows)), pa.array(words.astype(np.int32)), pa.array(h[:, 0].astype(np.int64)), pa.array(h[:, 1].astype(np.int64)), pa.array(seq, pa.binary()), pa.ListArray.from_arrays(pa.array(key_ends), pa.array(keys.ravel()))],
                names=["doc_id", "mark", "row_id", "n", "h1", "h2", "seq", "keys"],
            )
            row += batch.num_rows

    return in_arrow(small, run, "doc_id bigint, mark bigint, row_id bigint, n int, h1 bigint, h2 bigint, seq binary, keys array<bigint>")


def banded_distance(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Edit distance of two sequences if it is at most ``most``, else None.

    Equal ends are cut off, too few common items give it up, the rest is aligned in the band
    of diagonals |j - i| <= most.
    """
    if len(a) > len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if m - n > most:
        return None
    same = np.flatnonzero(a != b[:n])
    head = int(same[0]) if len(same) else n
    a, b = a[head:], b[head:]
    n, m = n - head, m - head
    same = np.flatnonzero(a[::-1] != b[::-1][:n])
    tail = int(same[0]) if len(same) else n
    a, b = a[:n - tail], b[:m - tail]
    n, m = n - tail, m - tail
    if not n:
        return m if m <= most else None
    if m - _common(a, b) > most:  # each edit mends one item at most
        return None
    return _band(a.tolist(), b.tolist(), most) if n > most else _column(a.tolist(), b.tolist(), most)


def _band(a: list[int], b: list[int], most: int) -> int | None:
    """Bit-parallel alignment within the diagonals |j - i| <= most, for len(a) > most.

    Column j keeps the vertical differences (+1 in ``up``, -1 in ``down``) of the rows
    j - most .. j + most only; the window moves one row with every column. The distance is
    followed along the window's lowest diagonal, then along the last row.
    """
    n, m, width = len(a), len(b), 2 * most + 1
    full, places = (1 << width) - 1, _places(a)
    up, down, dist = ((1 << (most + 1)) - 1) << most, 0, most
    lowest, row = 1 << (width - 1), 1 << (width - 2) if width > 1 else 0
    give_up = most + m - (n - most)
    for j in range(m):
        eq = 0
        for i in places.get(b[j], ()):
            if -most <= i - j <= most:
                eq |= 1 << (i - j + most)
        diag = ((((eq & up) + up) ^ up) | eq | down) & full
        right, left = down | (~(diag | up) & full), diag & up
        if j < n - most:
            dist += not diag & lowest
        else:
            dist += bool(right & row) - bool(left & row)
            row >>= 1
        if dist > give_up:
            return None
        diag >>= 1
        up, down = left | (~(diag | right) & full), diag & right
    return dist if dist <= most else None


def _column(a: list[int], b: list[int], most: int) -> int | None:
    """Bit-parallel alignment over whole columns, for len(a) <= most: all rows are in the band."""
    n = len(a)
    full, places, last = (1 << n) - 1, _places(a), 1 << (n - 1)
    up, down, dist = full, 0, n
    for x in b:
        eq = 0
        for i in places.get(x, ()):
            eq |= 1 << i
        diag = ((((eq & up) + up) ^ up) | eq | down) & full
        right, left = down | (~(diag | up) & full), diag & up
        dist += bool(right & last) - bool(left & last)
        right, left = (right << 1 | 1) & full, (left << 1) & full
        up, down = left | (~(diag | right) & full), diag & right
    return dist if dist <= most else None


def _places(a: list[int]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for i, x in enumerate(a):
        out.setdefault(x, []).append(i)
    return out


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the common multiset."""
    (x, n), (y, m) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return int(np.minimum(n[i], m[j]).sum())


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float | None:
    """The alignment similarity if it is at least ``least``, else None."""
    longer = max(len(a), len(b), 1)
    d = banded_distance(a, b, int((1 - least) * longer + 1e-9))
    return None if d is None else 1 - d / longer


def aligned(pairs: DataFrame, sequences: DataFrame, least: float) -> DataFrame:
    """pairs (a, b) of nodes whose sequences (node, seq) are similar: a, b, similarity."""
    both = pairs.join(sequences.select(F.col("node").alias("a"), F.col("seq").alias("seq_a")), "a").join(sequences.select(F.col("node").alias("b"), F.col("seq").alias("seq_b")), "b")
    size_a, size_b = F.octet_length("seq_a"), F.octet_length("seq_b")
    may = F.least(size_a, size_b) >= F.lit(least) * F.greatest(size_a, size_b) - 1e-6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, rows=256, text=2):
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            x, y = ([np.frombuffer(s, np.uint32) for s in batch.column(k).to_pylist()] for k in (2, 3))
            found = [similar(p, q, least) for p, q in zip(x, y, strict=True)]
            keep = [k for k, f in enumerate(found) if f is not None]
            yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in keep], pa.int64()), pa.array([b[k] for k in keep], pa.int64()), pa.array([found[k] for k in keep], pa.float64())], names=["a", "b", "similarity"])

    return in_arrow(both.filter(may).select("a", "b", "seq_a", "seq_b"), run, "a bigint, b bigint, similarity double")


def _rank(support: F.Column, node: F.Column) -> F.Column:
    """One number: more support first, then the smaller node (nodes are at least 0)."""
    return (support.cast("decimal(18,0)") * F.lit("9223372036854775808").cast("decimal(19,0)") + (F.lit(2**63 - 1).cast("decimal(19,0)") - node.cast("decimal(19,0)"))).cast("decimal(38,0)")


def _node_of(rank: F.Column) -> F.Column:
    return (F.lit(2**63 - 1).cast("decimal(19,0)") - rank % F.lit("9223372036854775808").cast("decimal(19,0)")).cast("bigint")


def across(mixed: DataFrame, sequences: DataFrame, least: float) -> DataFrame:
    """Links between nodes of one bucket that are in different components: a, b, similarity.

    mixed: key, node, n, comp, inside (the first node's component). Nodes are dealt into blocks
    by their hash; every block's nodes outside meet every block of the bucket.
    """
    sizes = mixed.groupBy("key").agg(F.sum(4 * F.col("n").cast("bigint") + NODE_BYTES).alias("bytes"))
    parts = F.ceil(F.col("bytes") / BLOCK_BYTES).cast("int")
    dealt = mixed.join(sizes, "key").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).drop("bytes")
    member = F.struct("node", "n", "comp", "inside", "keys", "seq")
    blocks = cut(dealt.join(sequences, "node").groupBy("key", "part", "parts").agg(F.collect_list(member).alias("members")), "blocks")
    outside = blocks.select("key", "parts", F.filter("members", lambda m: ~m["inside"]).alias("outside")).filter(F.size("outside") > 0)
    outside = outside.select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "outside")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, key in enumerate(batch.column(0).to_pylist()):
                links = block_links(key, batch.column(1)[k].values, batch.column(2)[k].values, least)
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in links], kind) for c, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["a", "b", "similarity"])
        trim()

    links = cut(in_arrow(outside.join(blocks.select("key", "part", "members"), ["key", "part"]).select("key", "outside", "members"), run, "a bigint, b bigint, similarity double").dropDuplicates(["a", "b"]), "links")
    release(blocks)
    return links


class Block:
    """A block's columns as arrays."""

    def __init__(self, members: pa.StructArray):
        self.node, self.n, self.comp, self.inside = (members.field(f).to_numpy(zero_copy_only=False) for f in ("node", "n", "comp", "inside"))
        self.n = self.n.astype(np.int64)
        self.keys = members.field("keys").flatten().to_numpy().reshape(len(members), -1)
        self.seq = [np.frombuffer(x, np.uint32) for x in members.field("seq").to_pylist()]
        self.bits = bitmaps(np.concatenate(self.seq), self.n)


def block_links(key: int, outside: pa.StructArray, members: pa.StructArray, least: float) -> list[tuple[int, int, float]]:
    """(larger node, smaller node, similarity) of the links whose first shared bucket is ``key``."""
    x, y = Block(outside), Block(members)
    out, linked = [], set()
    for at in range(0, len(x.node), COMPARED):
        i = slice(at, at + COMPARED)
        longer = np.maximum(x.n[i, None], y.n[None])
        may = (x.comp[i, None] != y.comp[None]) & (y.inside[None] | (x.node[i, None] < y.node[None]))
        may &= np.minimum(x.n[i, None], y.n[None]) >= least * longer - 1e-9
        most = 2 * np.floor((1 - least) * longer + 1e-9).astype(np.int32) - np.abs(x.n[i, None] - y.n[None])
        a, b = np.nonzero(may)
        a += at
        differing = np.concatenate([np.bitwise_count(x.bits[a[k:k + 4096]] ^ y.bits[b[k:k + 4096]]).sum(axis=-1, dtype=np.int32) for k in range(0, max(1, len(a)), 4096)])
        near = differing <= most[a - at, b]
        a, b, differing = a[near], b[near], differing[near]
        shared = np.where(x.keys[a] == y.keys[b], x.keys[a], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max)
        for k in np.argsort(np.where(shared == key, differing, -1), kind="stable").tolist():
            p, q = int(a[k]), int(b[k])
            if shared[k] != key or (p, y.comp[q]) in linked:
                continue
            found = similar(x.seq[p], y.seq[q], least)
            if found is not None:
                linked.add((p, y.comp[q]))
                out.append((max(int(x.node[p]), int(y.node[q])), min(int(x.node[p]), int(y.node[q])), found))
    return out


def if_small(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast of a thin table of so many rows, if it is short enough."""
    return F.broadcast(df) if rows <= BROADCAST_NODES else df


def component_table(links: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """node, comp of all nodes with links; ``before``: the components that the links join."""
    comps = cut(connected_components(links.select("a", "b")).withColumnRenamed("component", "comp"), "comps", 2 * links.count())
    if before is None:
        return comps
    moved = before.join(comps.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
    new = cut(moved.unionByName(comps.join(before.select(F.col("comp").alias("node")).distinct(), "node", "left_anti")), "comps", before.count() + comps.count())
    release(comps)
    return new


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """doc_id, mark, class_id, class_size, n_verified (links that were aligned; copies count once), comp."""
    rows = cut(sketched(docs, id_col, text_col), "sketches")
    whole = cut(rows.groupBy("h1", "h2").agg(F.min("row_id").alias("node"), F.min("doc_id").alias("least_id"), F.count("*").alias("copies")), "whole", rows.count())
    n_nodes = whole.count()
    nodes = rows.join(if_small(whole.select(F.col("node").alias("row_id")), n_nodes), "row_id", "left_semi").withColumnRenamed("row_id", "node")
    buckets = nodes.select("node", "n", F.explode("keys").alias("key"))
    several = cut(buckets.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "several", n_nodes * SKETCHES // 2)
    n_keys = several.count()
    held = cut(buckets.join(if_small(several, n_keys), "key"), "held", n_nodes * SKETCHES)  # buckets of at least two nodes
    release(several)
    support = held.groupBy("node").agg(F.sum("size").alias("support"))
    ranked = held.join(support, "node").withColumn("rank", _rank(F.col("support"), F.col("node"))).drop("support")
    first = ranked.groupBy("key").agg(F.max("rank").alias("best")).select("key", _node_of(F.col("best")).alias("first"))
    shared = cut(held.join(if_small(first, n_keys), "key"), "shared", held.count())
    release(held)
    n_shared = shared.count()
    sequences = cut(nodes.select("node", "seq", "keys").join(if_small(shared.select("node").distinct(), n_shared), "node", "left_semi"), "sequences")
    stars = shared.filter("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b")).distinct()
    links = cut(aligned(stars, sequences, least), "links")
    comps = component_table(links)
    to = if_small(comps, comps.count())
    placed = shared.join(to, "node", "left").join(to.select(F.col("node").alias("first"), F.col("comp").alias("c0")), "first", "left")
    placed = placed.select("key", "node", "n", F.coalesce("comp", "node").alias("comp"), F.coalesce("c0", "first").alias("c0"))
    several = if_small(placed.filter("comp <> c0").select("key").distinct(), n_keys)  # buckets of several components
    mixed = cut(placed.join(several, "key", "left_semi").withColumn("inside", F.col("comp") == F.col("c0")).drop("c0"), "mixed", n_shared)
    more = across(mixed, sequences, least)
    if not more.isEmpty():
        a, b = (to.select(F.col("node").alias(x), F.col("comp").alias(f"to_{x}")) for x in "ab")
        old = comps
        comps = component_table(more.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("to_a", "a").alias("a"), F.coalesce("to_b", "b").alias("b")), comps)
        release(old)
    parts = [links, more]
    links = links.unionByName(more)

    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_verified"))
    placed = whole.join(comps, "node", "left").join(degree, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    classes = placed.groupBy("comp").agg(F.min("least_id").alias("class_id"), F.sum("copies").alias("class_size"))
    of = placed.join(classes, "comp").select("h1", "h2", "comp", "class_id", "class_size", F.coalesce("n_verified", F.lit(0)).alias("n_verified"))
    out = cut(rows.select("doc_id", "mark", "h1", "h2").join(of, ["h1", "h2"]).drop("h1", "h2"), "classes")
    for done in (rows, whole, shared, sequences, mixed, comps, *parts):
        release(done)
    return out


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "n_verified")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each class: that of the least id (null ids last).

    Of several rows with that id, one with the text of least hash stays. Names of columns
    that the operator adds are new ones, so columns of any name pass through.
    """
    classes = near_classes(docs, id_col, text_col, least)
    several = classes.filter("class_size > 1").select("comp", "class_id", "doc_id", "mark")
    best = several.filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("comp").agg(F.min("mark").alias("best"))
    fate = several.join(best, "comp").groupBy("doc_id", "mark").agg(
        F.max((F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("mark") == F.col("best"))).cast("int")).alias("stays"), F.count("*").alias("rows")
    )
    fate = cut(fate.filter("stays = 0 or rows > 1"), "fates", several.count())
    release(classes)
    id_, mark, of_id, of_mark, stays, place = new_names(docs.columns, 6)
    fate = if_small(fate.select(F.col("doc_id").alias(of_id), F.col("mark").alias(of_mark), F.col("stays").alias(stays)), fate.count())
    named = docs.select("*", F.col(f"`{id_col}`").cast("bigint").alias(id_), text_mark(F.col(f"`{text_col}`")).alias(mark))
    marked = named.join(fate, F.col(id_).eqNullSafe(F.col(of_id)) & (F.col(mark) == F.col(of_mark)), "left")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    once = Window.partitionBy(id_, mark).orderBy(F.lit(0))
    repeated = marked.filter(F.col(stays) == 1).withColumn(place, F.row_number().over(once)).filter(F.col(place) == 1)
    return marked.filter(F.col(stays).isNull()).select(*columns).unionByName(repeated.select(*columns))
