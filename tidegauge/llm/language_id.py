"""Operator 4: language identification by multinomial naive Bayes over hashed n-grams.

A text becomes code points, lower-cased, with everything but letters as spaces. Its 1-, 2-
and 3-grams that hold a letter are hashed into buckets. Training counts buckets per
language over a bounded sample of labelled rows (a documented parameter); the smoothed
log-probability matrix, buckets x languages, is a broadcast variable (128 KB a language; any
number of languages). Scoring gathers the rows of the n-grams that occur and sums them by
text, for a batch of texts and some languages at once, in numpy.

Defined results: null text, empty text and text without letters give ``und`` with score 0;
the same where nothing could be learned; a null id counts as not held out; a row's result
depends on its own text only, so ties, repeated rows and extra columns change nothing; an
empty table gives an empty result. Equal scores go to the language that sorts first.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tidegauge.llm.shared import in_arrow, slices, table

BUCKET_BITS = 15
#: Training rows a language has, about, at most; and languages that are scored at once.
ROWS_PER_LANGUAGE, LANGUAGES_AT_ONCE = 3000, 8
SMOOTHING = 0.5
#: Bytes of text whose n-grams are arrays at once: about 60 bytes for each.
GRAM_BYTES = 1_000_000


@functools.cache
def letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(texts: list[str], bits: int = BUCKET_BITS) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(1-, 2-, 3-gram buckets at each code point, row starts, rows with letters).

    The bucket 2**bits stands for "no letter in it".
    """
    joined = "  ".join([*(t.lower() for t in texts), ""])
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.append(0, np.cumsum([len(t.lower()) + 2 for t in texts]))[:-1].astype(np.int64)
    letter = letter_table()[code]
    code = np.where(letter, code, np.uint32(32))
    none = np.uint32(1 << bits)
    shift = np.uint32(32 - bits)
    a = code * np.uint32(0x9E3779B1)
    b, c = np.append(code[1:], np.uint32(32)), np.append(code[2:], [np.uint32(32)] * min(2, len(code)))[:len(code)]
    any2 = letter | np.append(letter[1:], False)
    any3 = any2 | np.append(letter[2:], [False] * min(2, len(letter)))[:len(letter)]
    own = np.ones(len(code), bool)  # what starts between two texts is of neither
    own[starts[1:] - 1] = own[starts[1:] - 2] = own[-2:] = False
    two = a * np.uint32(0x85EBCA6B) + b * np.uint32(0xC2B2AE35)
    three = two * np.uint32(0x27D4EB2F) + c * np.uint32(0x165667B1) + np.uint32(0x9E3779B9)
    out = []
    for h, ok in ((a, letter), (two, any2), (three, any3)):
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        out.append(np.where(ok & own, h >> shift, none))
    has = np.add.reduceat(letter, starts, dtype=np.int64) > 0 if len(starts) else np.zeros(0, bool)
    return out, starts, has


def log_probabilities(counts: np.ndarray) -> np.ndarray:
    """Smoothed, over the last axis."""
    smooth = counts + SMOOTHING
    return np.log(smooth / smooth.sum(axis=-1, keepdims=True)).astype(np.float32)


class LanguageModel:
    def __init__(self, languages: list[str], logs: np.ndarray, documents: np.ndarray):
        """logs: languages x buckets; documents: of each language."""
        self.languages = languages
        self.matrix = np.vstack([logs.T, np.zeros((1, len(languages)), np.float32)]).astype(np.float32)
        self.prior = np.log((documents + 1) / (documents + 1).sum()) if len(languages) else np.zeros(0)

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages log-probabilities, which texts have letters)."""
        hashed, starts, has = grams(texts)
        out = np.tile(self.prior, (len(texts), 1))
        for a in range(0, len(self.languages), LANGUAGES_AT_ONCE):
            part = np.ascontiguousarray(self.matrix[:, a:a + LANGUAGES_AT_ONCE])
            for h in hashed:
                rows = part[h]
                for k in range(part.shape[1]):
                    out[:, a + k] += np.add.reduceat(rows[:, k], starts, dtype=np.float64)
        return out, has

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.languages or not texts:
            return ["und"] * len(texts), np.zeros(len(texts))
        score, has = self.scores(texts)
        best = score.argmax(axis=1)
        top = 1 / np.exp(score - score.max(axis=1, keepdims=True)).sum(axis=1)
        return [self.languages[k] if ok else "und" for k, ok in zip(best, has, strict=True)], np.where(has, top, 0.0)


def train_language_model(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_language: int = ROWS_PER_LANGUAGE) -> LanguageModel:
    """Counts over about ``per_language`` rows of each language, chosen by a hash of the row."""
    spark = rows.sparkSession
    known = rows.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.col(id_col).alias("id")).filter("lang is not null and text is not null")
    totals = known.groupBy("lang").agg(F.count("*").alias("n")).collect()  # one row a language
    if not totals:
        return LanguageModel([], np.zeros((0, 1 << BUCKET_BITS), np.float32), np.zeros(0))
    share = spark.createDataFrame([(r["lang"], min(1.0, per_language / r["n"])) for r in totals], "lang string, share double")
    place = F.pmod(F.xxhash64("id", F.crc32("text")), F.lit(1 << 30)) / float(1 << 30)
    sample = known.join(F.broadcast(share), "lang").filter(place < F.col("share")).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches, size=GRAM_BYTES):
            langs = batch.column(0).to_pylist()
            texts = batch.column(1).to_pylist()
            for lang in set(langs):
                hashed, _, _ = grams([t for t, x in zip(texts, langs, strict=True) if x == lang])
                own = sums.setdefault(lang, np.zeros((1 << BUCKET_BITS) + 1, np.int64))
                for h in hashed:
                    own += np.bincount(h, minlength=len(own))
        for lang, own in sums.items():
            at = np.flatnonzero(own[:-1])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(own[at])], names=["lang", "bucket", "n"])

    def logs(lang: pa.Table) -> pa.Table:
        own = np.zeros(1 << BUCKET_BITS)
        own[lang.column("bucket").to_numpy()] = lang.column("n").to_numpy()
        return pa.table({"lang": lang.column("lang")[:1], "logs": pa.array([log_probabilities(own).tobytes()], pa.binary())})

    counts = in_arrow(sample, run, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = {r["lang"]: np.frombuffer(r["logs"], np.float32) for r in counts.groupBy("lang").applyInArrow(logs, "lang string, logs binary").collect()}  # 128 KB a language
    languages = sorted(r["lang"] for r in totals)
    n = {r["lang"]: r["n"] for r in totals}
    none = log_probabilities(np.zeros(1 << BUCKET_BITS))
    return LanguageModel(languages, np.stack([found.get(x, none) for x in languages]), np.array([n[x] for x in languages], float))


def predict_languages(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """``keep`` columns of docs (all, if None) and two more called ``names``: language and score."""
    keep = docs.columns if keep is None else keep
    used = keep if text_col in keep else [*keep, text_col]
    small, at = docs.select(*(F.col(f"`{c}`") for c in used)), used.index(text_col)
    schema = StructType([*(docs.schema[c] for c in keep), StructField(names[0], StringType()), StructField(names[1], DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text=at, size=GRAM_BYTES):
            lang, score = shared.value.predict([t or "" for t in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*keep, *names])

    return in_arrow(small, run, schema)


def held_out(id_col: F.Column, mod: int, rest: int) -> F.Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % mod == rest, F.lit(False))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train_language_model(docs.filter(~held_out(F.col("doc_id"), 3, 1)))
    out = predict_languages(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
