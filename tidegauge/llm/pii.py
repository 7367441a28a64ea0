"""Operator 6: personal data, by fixed patterns and a linear-chain conditional random field.

Four fixed patterns give the base spans. A conditional random field over word shapes adds
spans that they miss (numbers without a plus sign, addresses written out, card numbers that
are split oddly). It is trained on a small labelled table, which is part of this module: sentences with
marked spans, filled from a seeded generator. A word's features are its shape attributes
and its neighbours'; sentences are decoded by Viterbi, all those of one length in a batch.

Defined results: null text counts as empty and has no spans; spans are in code points, end
exclusive; an added span that overlaps a base span, or fails what can be checked (the number
of digits, a card's check digit, parts of an address), is left out; a sentence ends at
closing punctuation, a text's end or, from SENTENCE_WORDS words on, between two plain words, so
that no number or address is cut; a row's result depends on
its own text only, so ties, repeated rows, null ids and extra columns change nothing; an
empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.shared import in_arrow, slices, table

KINDS = ("email", "ip", "card", "phone")
SENTENCE_WORDS = 64
#: Bytes of text whose words are scored at once: about 50 bytes for each.
PII_BYTES = 1_000_000

# ---- base spans -------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """The local part is the whole run before an ``@`` that follows the last match."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > done and text[a - 1] in _LOCAL:
            a -= 1
        if a < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((a, m.end()))
            done = m.end()
        at = text.find("@", max(done, at + 1))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    """Four parts at a time of each dotted run of numbers."""
    out = []
    for m in _DOTTED.finditer(text):
        if m.group().count(".") < 3:
            continue
        parts, at = m.group().split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k:k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                out.append((at, end))
            at = end + 1
    return out


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def cards(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _CARD.finditer(text) if m.end() - m.start() >= 12 and 12 <= len(d := digits_of(m.group())) <= 19 and luhn(d)]


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= len(digits_of(m.group())) <= 15]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), sorted."""
    found = [(a, k, b) for k, of in enumerate((emails, ips, cards, phones)) for a, b in of(text)]
    return sorted(found)


# ---- word shapes ------------------------------------------------------------------------

_END = r"[.,;:!?\"')\]]*$"
#: Attributes of words that aren't plain letters, as RE2 patterns, and of any word (the last).
SHAPES = (
    r"@", r"^[\[({<](at|dot)[\])}>]$", r"^[\pL\d-]+(\.[\pL\d-]+)+" + _END, r"^[\pL\d_%+-]+[._][\pL\d._%+-]+" + _END,
    r"^\D*(\d\D*){1,2}$", r"^\D*(\d\D*){3}$", r"^\D*(\d\D*){4}$", r"^\D*(\d\D*){5,6}$", r"^\D*(\d\D*){7,11}$", r"^\D*(\d\D*){12,19}$", r"^\D*(\d\D*){20,}$",
    r"^\d+" + _END, r"^\d{3}[-.]\d{4}" + _END, r"^\(?\d{2,4}\)?[-.]\d{3}[-.]\d{3,4}" + _END, r"^\(\d{2,4}\)$", r"^\+", r"^\d{1,3}(\.\d{1,3}){3}([:/]\d+)?" + _END,
    r"^\d{4}([-/]\d{4}){2,3}" + _END, r"\pL.*\d|\d.*\pL", r"^[^\pL\d]+$", r"[=<>{}|$%&*#]", r"^\d{1,2}[:.]\d{2}" + _END, r"^\d{2,4}[-/]\d{1,2}[-/]\d{1,4}" + _END,
)
CUES = r"(?i)^(call|phone|tel|telephone|fax|mobile|cell|mail|email|e-mail|contact|card|visa|mastercard|ip|server|host|reach|dial|write|number|address)[:.,]?$"
PLAIN = r"^[\pL'’]+" + _END
CLOSES = r"[.!?]+[\"')\]]*$"
N_ATTRIBUTES = len(SHAPES) + 5  # and: cue, plain, capital, upper, always


def attributes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bit masks, whether a word closes a sentence) of distinct words."""
    is_ = lambda p, w: pc.match_substring_regex(w, p).to_numpy(zero_copy_only=False)
    plain = is_(PLAIN, words)
    mask = np.full(len(words), 1 << (N_ATTRIBUTES - 1), np.int64)
    upper = is_(r"^\p{Lu}{2,}", words)
    for k, bits in enumerate((is_(CUES, words), plain, is_(r"^\p{Lu}", words) & ~upper, upper)):
        mask |= bits.astype(np.int64) << (len(SHAPES) + k)
    odd = np.flatnonzero(~plain)
    some = words.take(pa.array(odd))
    for k, shape in enumerate(SHAPES):
        mask[odd] |= is_(shape, some).astype(np.int64) << k
    return mask, is_(CLOSES, words)


def bits_of(masks: np.ndarray) -> np.ndarray:
    return ((masks[:, None] >> np.arange(N_ATTRIBUTES)) & 1).astype(np.float64)


# ---- the field --------------------------------------------------------------------------


class Crf:
    """Labels 0 (none) and 1.. (KINDS); weights of a word's and its neighbours' attributes."""

    def __init__(self, emit: np.ndarray, step: np.ndarray, start: np.ndarray):
        self.emit, self.step, self.start = emit, step, start  # 3 x attributes x labels, labels x labels, labels

    def scores(self, masks: np.ndarray, seq: np.ndarray) -> np.ndarray:
        """Emission scores of words; seq: the sentence each belongs to."""
        distinct, at = np.unique(masks, return_inverse=True)
        own, before, after = (bits_of(distinct) @ w for w in self.emit)
        out = own[at]
        same = seq[1:] == seq[:-1]
        out[1:] += before[at[:-1]] * same[:, None]
        out[:-1] += after[at[1:]] * same[:, None]
        return out

    def decode(self, masks: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best labels of consecutive sentences, by Viterbi over all sentences of a length."""
        labels = np.zeros(len(masks), np.int8)
        scores = self.scores(masks, np.repeat(np.arange(len(lengths)), lengths))
        first = np.append(0, np.cumsum(lengths))[:-1]
        for n in np.unique(lengths):
            starts = first[lengths == n]
            at = starts[:, None] + np.arange(n)
            best, back = self.start + scores[at[:, 0]], np.zeros((n, len(starts), len(self.start)), np.int8)
            for t in range(1, n):
                options = best[:, :, None] + self.step[None]
                back[t] = options.argmax(axis=1)
                best = options.max(axis=1) + scores[at[:, t]]
            now = best.argmax(axis=1)
            for t in range(n - 1, -1, -1):
                labels[at[:, t]] = now
                now = back[t][np.arange(len(starts)), now]
        return labels


    def log_partition(self, masks: np.ndarray) -> float:
        """The logarithm of the summed weights of all labellings of one sentence."""
        e = self.scores(masks, np.zeros(len(masks), int))
        f = self.start + e[0]
        for row in e[1:]:
            f = log_sum(f[:, None] + self.step, 0) + row
        return float(log_sum(f, 0))


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def train(sentences: list[tuple[list[str], list[int]]], rounds: int = 250, rate: float = 0.08, decay: float = 0.01) -> Crf:
    """Maximum likelihood with an L2 penalty: gradients from forward-backward, steps by Adam."""
    k, n, longest = len(KINDS) + 1, len(sentences), max(len(w) for w, _ in sentences)
    words = pa.array([w for ws, _ in sentences for w in ws], pa.string()).dictionary_encode()
    masks = attributes(words.dictionary)[0][words.indices.to_numpy()]
    length = np.array([len(w) for w, _ in sentences])
    there = np.arange(longest) < length[:, None]
    x = np.zeros((3, n, longest, N_ATTRIBUTES))
    x[0][there] = bits_of(masks)
    x[1][:, 1:], x[2][:, :-1] = x[0][:, :-1], x[0][:, 1:]
    x *= there[None, :, :, None]
    y = np.zeros((n, longest), int)
    y[there] = [label for _, ls in sentences for label in ls]
    gold = np.eye(k)[y] * there[:, :, None]
    pair = there[:, 1:]
    gold_step = np.einsum("nti,ntj->ij", gold[:, :-1] * pair[:, :, None], gold[:, 1:])
    parts = [np.zeros((3, N_ATTRIBUTES, k)), np.zeros((k, k)), np.zeros(k)]
    m, v = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    for t in range(1, rounds + 1):
        emit, step, start = parts
        e = np.einsum("cnta,cak->ntk", x, emit)
        f, b = np.zeros((n, longest, k)), np.zeros((n, longest, k))
        f[:, 0] = start + e[:, 0]
        for s in range(1, longest):
            f[:, s] = np.where(there[:, s, None], log_sum(f[:, s - 1, :, None] + step, 1) + e[:, s], f[:, s - 1])
        for s in range(longest - 2, -1, -1):
            b[:, s] = np.where(there[:, s + 1, None], log_sum(step + (e[:, s + 1] + b[:, s + 1])[:, None, :], 2), 0.0)
        total = log_sum(f[:, -1], 1)
        p = np.exp(f + b - total[:, None, None]) * there[:, :, None]
        q = np.exp(f[:, :-1, :, None] + step + (e + b)[:, 1:, None, :] - total[:, None, None, None]) * pair[:, :, None, None]
        grads = [np.einsum("cnta,ntk->cak", x, p - gold), q.sum(axis=(0, 1)) - gold_step, (p - gold)[:, 0].sum(axis=0)]
        for j, g in enumerate(grads):
            g = g / n + decay * parts[j] / n
            m[j], v[j] = 0.9 * m[j] + 0.1 * g, 0.999 * v[j] + 0.001 * g * g
            parts[j] = parts[j] - rate * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-9)
    return Crf(*parts)


# ---- the labelled table -----------------------------------------------------------------

#: Sentences with marked spans {kind:form}; a form names a generator below.
MARKED = (
    "please call {phone:bare} before noon", "our office number is {phone:bare} , ask for the desk", "tel {phone:bare}", "phone: {phone:dashed} or come by",
    "fax {phone:dashed} anytime", "reach the team at {phone:split} on weekdays", "dial {phone:split}", "mobile {phone:plus} works too", "ring {phone:plus} now",
    "contact {email:plain} for details", "mail me: {email:plain}", "write to {email:spoken} with questions", "{email:spoken} is my address", "email {email:spoken}",
    "the server {ip:quad} went down", "ssh into {ip:port} first", "host {ip:quad} answered", "logs from {ip:port} and {ip:quad} differ",
    "my card {card:grouped} expires soon", "charge visa {card:grouped} today", "card number {card:dashed} was declined", "paid with {card:whole} yesterday", "{card:whole} is the card",
    "the call was long", "please mail the card to our office", "my phone number changed last year", "we met at {o:time} on {o:date}", "it costs {o:money} plus {o:small} percent",
    "see page {o:small} of volume {o:small}", "licensed under version {o:version} of the terms", "in {o:year} they sold {o:big} units", "order {o:code} shipped on {o:date}",
    "rooms {o:small} and {o:small} are free at {o:time}", "the total was {o:big} in {o:year} .", "token = {o:hex} is set", "a | b | c | d", "so*** it%%% goes### on&&&", "STOP!! NOW!! PLEASE!!",
    "chapter {o:version} covers {o:small} topics", "at {o:year} the dot is small", "born {o:date} in the north", "the key {o:hex} and id {o:code} match", "score {o:small} to {o:small} at {o:time}",
    "the host said the server is an old one", "write the address on the card", "isbn {o:isbn} sold {o:big} copies", "section {o:version} , line {o:small} ;", "und die zahl {o:big} ist hoch", "en el año {o:year} hubo {o:small}",
)


def _form(kind: str, r: random.Random) -> str:
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    name = lambda: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(3, 8)))
    host = f"{name()}{r.choice(['', d(1)])}.{r.choice(['example', name()])}.{r.choice(['com', 'org', 'net'])}"
    return {
        "bare": lambda: f"({d(3)}) {d(3)}-{d(4)}", "dashed": lambda: r.choice([f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}"]), "split": lambda: f"({d(2)}) {d(4)} {d(4)}", "plus": lambda: f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}",
        "plain": lambda: f"{name()}.{d(2)}@{host}", "spoken": lambda: f"{r.choice([name(), name() + '.' + name(), name() + d(2)])} {r.choice(['(at)', '[at]'])} {r.choice([host, name() + ' (dot) com', name() + ' [dot] org'])}",
        "quad": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)), "port": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)) + r.choice([":", "/"]) + d(2),
        "grouped": lambda: " ".join(d(4) for _ in range(4)), "dashed_card": lambda: "-".join(d(4) for _ in range(4)), "whole": lambda: d(16),
        "time": lambda: f"{r.randint(1, 12)}:{d(1)}0", "date": lambda: r.choice([f"20{d(2)}-0{r.randint(1, 9)}-1{d(1)}", f"{r.randint(1, 28)}/{r.randint(1, 12)}/20{d(2)}"]), "money": lambda: r.choice([f"${d(2)}", f"{d(1)},{d(3)}", f"{d(2)}.{d(2)}"]),
        "small": lambda: d(r.randint(1, 3)), "year": lambda: f"{r.choice(['19', '20'])}{d(2)}", "big": lambda: d(r.randint(5, 9)), "version": lambda: f"{d(1)}.{d(1)}" + r.choice(["", f".{d(1)}"]), "code": lambda: f"{name()[:2].upper()}{d(6)}",
        "hex": lambda: '"' + "".join(r.choice("0123456789abcdef") for _ in range(40)) + '"', "isbn": lambda: f"978-{d(1)}-{d(3)}-{d(5)}-{d(1)}",
    }[kind]()


def labelled_table(copies: int = 6, seed: int = 11) -> list[tuple[list[str], list[int]]]:
    """(words, labels) of MARKED, each filled ``copies`` times."""
    r, out = random.Random(seed), []
    for sentence in MARKED * copies:
        words, labels = [], []
        for part in re.split(r"(\{\w+:\w+\})", sentence):
            if m := re.fullmatch(r"\{(\w+):(\w+)\}", part):
                kind, form = m.groups()
                own = _form("dashed_card" if (kind, form) == ("card", "dashed") else form, r).split()
                label = KINDS.index(kind) + 1 if kind in KINDS else 0
            else:
                own, label = part.split(), 0
            words += own
            labels += [label] * len(own)
        if r.random() < 0.4:
            words[-1] += "."
        out.append((words, labels))
    return out


@functools.cache
def default_model() -> Crf:
    return train(labelled_table())


def plausible(kind: int, text: str) -> bool:
    """What can be checked of an added span: digits in number, a card's check digit, parts."""
    digits = digits_of(text)
    if KINDS[kind] == "email":
        return re.search(r"@|(?<![^\W_])at(?![^\W_])", text, re.IGNORECASE) is not None
    if KINDS[kind] == "ip":
        parts = re.findall(r"[0-9]+", text)
        return len(parts) >= 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts[:4])
    if KINDS[kind] == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 7 <= len(digits) <= 15


# ---- the operator -----------------------------------------------------------------------

def cuts(starts: np.ndarray, n: int, plain: np.ndarray) -> np.ndarray:
    """Sentence starts, with those of the parts of long ones: cut between two plain words."""
    ends = np.append(starts[1:], n)
    if not len(starts) or (ends - starts).max() <= SENTENCE_WORDS:
        return starts
    between = np.flatnonzero(plain[1:] & plain[:-1]) + 1
    more = []
    for a, b in zip(starts[ends - starts > SENTENCE_WORDS].tolist(), ends[ends - starts > SENTENCE_WORDS].tolist(), strict=True):
        while b - a > SENTENCE_WORDS:
            at = np.searchsorted(between, a + SENTENCE_WORDS)
            if at == len(between) or between[at] >= b:
                break
            a = int(between[at])
            more.append(a)
    return np.sort(np.concatenate([starts, np.array(more, np.int64)]))


def places_of(text: str, words: list[str]) -> list[tuple[int, int]]:
    """Where the words of a text stand, one after another."""
    out, at = [], 0
    for w in words:
        at = text.index(w, at)
        out.append((at, at + len(w)))
        at += len(w)
    return out


def added_spans(texts: pa.Array, model: Crf) -> dict[int, list[tuple[int, int, int]]]:
    """row -> (start, kind number, end) that the field finds, before base spans are looked at."""
    split = pc.utf8_split_whitespace(texts)
    rows = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    words = split.flatten()
    full = pc.binary_length(words).to_numpy() > 0
    if not full.all():
        words, rows = words.filter(pa.array(full)), rows[full]
    if not len(words):
        return {}
    coded = words.dictionary_encode()
    masks, closes = attributes(coded.dictionary)
    at = coded.indices.to_numpy()
    masks, closes = masks[at], closes[at]
    starts = np.append(True, closes[:-1] | (rows[1:] != rows[:-1]))
    where = np.flatnonzero(starts)
    cut = cuts(where, len(rows), (masks >> (len(SHAPES) + 1)) & 1 == 1)
    labels = model.decode(masks, np.diff(np.append(cut, len(rows))))
    hits = np.flatnonzero(labels)
    out: dict[int, list[tuple[int, int, int]]] = {}
    if not len(hits):
        return out
    row_first = np.searchsorted(rows, rows[hits])
    sentence = np.searchsorted(cut, hits, "right")
    for row in np.unique(rows[hits]):
        own = rows[hits] == row
        text = texts[int(row)].as_py()
        places = places_of(text, [w for w in split[int(row)].as_py() if w])
        run: list[tuple[int, int, int]] = []  # word, label, sentence
        for w, s in [*zip((hits - row_first)[own].tolist(), sentence[own].tolist(), strict=True), (-9, -9)]:
            label = int(labels[row_first[own][0] + w]) if w >= 0 else 0
            if run and (w != run[-1][0] + 1 or label != run[-1][1] or s != run[-1][2]):
                a, b = places[run[0][0]][0], places[run[-1][0]][1]
                while a < b and text[a] in "\"'<[{,;:":
                    a += 1
                while b > a and text[b - 1] in ".,;:!?\"'>]}|":
                    b -= 1
                kind = run[0][1] - 1
                if plausible(kind, text[a:b]):
                    out.setdefault(int(row), []).append((a, kind, b))
                elif len(run) > 1:  # several numbers in a row
                    out.setdefault(int(row), []).extend((p, kind, q) for p, q in (places[x[0]] for x in run) if plausible(kind, text[p:q]))
                run = []
            run.append((w, label, s))
    return out


def all_spans(texts: pa.Array, model: Crf) -> list[tuple[list, list]]:
    """(base spans, base and added spans) of each text, as sorted (start, kind number, end)."""
    texts = pc.fill_null(texts, "")
    maybe = pc.match_substring_regex(texts, r"@|\d\.\d+\.\d|\d(?:[ -]?\d){11}|\+\d").to_numpy(zero_copy_only=False)
    added, out = added_spans(texts, model), []
    for k in range(len(texts)):
        base = base_spans(texts[k].as_py()) if maybe[k] else []
        more = [s for s in added.get(k, ()) if not any(s[0] < b and a < s[2] for a, _, b in base)]
        out.append((base, sorted(base + more)))
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Crf | None = None) -> DataFrame:
    """id, ``spans`` (array of kind, start, end, base) of every row."""
    model = model or default_model()
    small = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias(id_col))
    kind = small.schema[id_col].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text=0, size=PII_BYTES):
            found = [[{"kind": KINDS[k], "start": a, "end": b, "base": (a, k, b) in base} for a, k, b in every] for base, every in all_spans(batch.column(0), model)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, span)], names=[id_col, "spans"])

    return in_arrow(small, run, f"`{id_col}` {kind}, spans array<struct<kind:string,start:int,end:int,base:boolean>>")


def redact(docs: DataFrame, text_col: str = "text", model: Crf | None = None) -> DataFrame:
    """``docs`` with every span of its text replaced by its kind in brackets; null stays null."""
    model = model or default_model()
    order = [text_col, *(c for c in docs.columns if c != text_col)]
    at = docs.select(*(F.col(f"`{c}`") for c in order))
    schema = at.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text=0, size=PII_BYTES):
            out = []
            for text, (_, every) in zip(batch.column(0).to_pylist(), all_spans(batch.column(0), model), strict=True):
                parts, done = [], 0
                for a, k, b in every:
                    if b > done:
                        parts += [text[done:max(a, done)], f"[{KINDS[k].upper()}]"]
                        done = b
                out.append("".join([*parts, text[done:]]) if parts else text)
            yield pa.RecordBatch.from_arrays([pa.array(out, batch.column(0).type), *batch.columns[1:]], names=batch.schema.names)

    return in_arrow(at, run, schema).select(*(F.col(f"`{c}`") for c in docs.columns))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    text = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["base"])
    n = lambda kind: F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == kind))).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *map(n, KINDS), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
