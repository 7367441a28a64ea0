"""Operator 3: quality classifier by positive-unlabelled learning.

Trusted positives are rows labelled 1; unlabelled rows are documents drawn without looking
at labels. The class prior is the share of positives among the labelled rows of the
training folds (Laplace-smoothed), where those hold negatives too: labels are then a sample of
the documents. Where only positives are labelled it is estimated from them and the unlabelled
rows: a first model is fitted to one half of both, and on the other half the prior is the least
ratio, over thresholds, of the shares of unlabelled and of positive rows above it. The model is additive over binned text statistics and
minimises the non-negative unbiased risk
    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))
with logistic loss, so a sigmoid of the model estimates P(good | text). It is fitted on
bounded samples (documented parameters); every document is scored, on its whole text.

Defined results: null text counts as empty; an empty text has the statistics zero and is
scored by them; without a positive row every score is one half; a null id counts
as not held out; a row's score depends on its own text only, so ties, repeated rows and
extra columns change nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.language_id import held_out
from tidegauge.llm.shared import in_arrow, slices, table

#: Rows of each kind that the model is fitted on, at most.
MAX_POSITIVES, MAX_UNLABELLED = 6000, 12000
BINS, STEPS, RATE, DECAY, SEED = 12, 500, 0.1, 2e-5, 7
KEEP_AT = 0.7
FEATURES = (
    "log_chars", "letters", "upper", "digits", "spaces", "stops", "exclaims", "symbols", "other",
    "word_chars", "long_words", "distinct_words", "top_word", "runs", "lines", "distinct_lines", "symbol_words", "upper_words", "ends", "entropy",
)

_KIND = np.zeros(256, np.int8)  # 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 stop, 6 exclamation, 7 symbol
for _c in range(256):
    _ch = chr(_c)
    _KIND[_c] = 6 if _ch == "!" else 1 if _ch.islower() else 2 if _ch.isupper() else 3 if _ch.isdigit() else 4 if _ch.isspace() else 5 if _ch in ".,;:?'\"-" else 7 if _c < 127 and _c > 32 else 0


def statistics(text: str) -> list[float]:
    """The values of FEATURES for one text."""
    if not text:
        return [0.0] * len(FEATURES)
    raw = np.frombuffer(text.encode("latin-1", "replace"), np.uint8)
    seen = np.bincount(raw, minlength=256)
    kinds = np.bincount(_KIND, weights=seen, minlength=8)
    n, words, lines = len(text), text.split(), [x for x in text.split("\n") if x]
    m = max(1, len(words))
    common = Counter(words)
    p = seen[seen > 0] / n
    letters = kinds[1] + kinds[2]
    return [
        math.log1p(n), letters / n, kinds[2] / max(1, letters), kinds[3] / n, kinds[4] / n, kinds[5] / n, kinds[6] / n, kinds[7] / n, kinds[0] / n,
        n / m, sum(len(w) > 25 for w in common) / m, len(common) / math.sqrt(m), max(common.values(), default=0) / m,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / m, len(lines) / m, len(set(lines)) / max(1, len(lines)),
        sum(c for w, c in common.items() if not w[-1].isalnum() and w[-1] not in ".,;:?'\"") / m, sum(c for w, c in common.items() if w.isupper() and len(w) > 1) / m,
        (text.count(". ") + text.count(".\n")) / m, float(-(p * np.log2(p)).sum()),
    ]


class QualityModel:
    def __init__(self, edges: np.ndarray, weights: np.ndarray, bias: float):
        self.edges, self.weights, self.bias = edges, weights, bias

    @staticmethod
    def one_hot(edges: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Bin numbers, rows x features, shifted so that each (feature, bin) has its own."""
        bins = np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(edges)], axis=1)
        return bins + np.arange(len(edges)) * (edges.shape[1] + 1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        g = self.weights[self.one_hot(self.edges, x)].sum(axis=1) + self.bias
        return 1 / (1 + np.exp(-np.clip(g, -30, 30)))


def fit(positives: np.ndarray, unlabelled: np.ndarray, prior: float) -> QualityModel:
    """Minimise the non-negative risk by Adam over all rows."""
    x = np.vstack([positives, unlabelled])
    edges = np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    edges = np.concatenate([edges, np.quantile(x, [0.005, 0.02, 0.04, 0.96, 0.98, 0.995], axis=0).T], axis=1)
    edges.sort(axis=1)
    start = math.log(prior / (1 - prior))
    d = edges.shape[0] * (edges.shape[1] + 1)
    if not len(positives) or not len(unlabelled):
        return QualityModel(edges, np.zeros(d), start)
    at_p, at_u = QualityModel.one_hot(edges, positives), QualityModel.one_hot(edges, unlabelled)
    w, b = np.zeros(d), start
    m, v = np.zeros(d + 1), np.zeros(d + 1)
    for step in range(1, STEPS + 1):
        _, grad = risk(at_p, at_u, prior, w, b)
        grad[:-1] += DECAY * w / len(FEATURES)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return QualityModel(edges, w, b)


def risk(at_p: np.ndarray, at_u: np.ndarray, prior: float, w: np.ndarray, b: float) -> tuple[float, np.ndarray]:
    """(non-negative risk, its step for weights and bias): where the estimate of the negatives'
    risk is below zero, the step goes back from it instead."""
    add = lambda at, g: np.bincount(at.ravel(), weights=np.repeat(g, at.shape[1]), minlength=len(w))
    s_p, s_u = (1 / (1 + np.exp(-(w[at].sum(axis=1) + b))) for at in (at_p, at_u))
    positive = -prior * np.log(s_p + 1e-12).mean()
    negative = -np.log1p(-s_u + 1e-12).mean() + prior * np.log1p(-s_p + 1e-12).mean()
    g_pos, g_neg_p, g_neg_u = prior * (s_p - 1) / len(s_p), -prior * s_p / len(s_p), s_u / len(s_u)
    g_p, g_u = (g_pos + g_neg_p, g_neg_u) if negative >= 0 else (-g_neg_p, -g_neg_u)
    return positive + max(0.0, negative), np.append(add(at_p, g_p) + add(at_u, g_u), g_p.sum() + g_u.sum())


def estimated_prior(positives: np.ndarray, unlabelled: np.ndarray, confidence: float = 0.1) -> float:
    """The share of positives among unlabelled rows, from scores of both."""
    cuts = np.unique(positives)
    above = lambda x: 1 - np.searchsorted(np.sort(x), cuts, "left") / len(x)
    p, u = above(positives), above(unlabelled)
    slack = math.sqrt(math.log(4 / confidence) / 2) * (1 / math.sqrt(len(positives)) + 1 / math.sqrt(len(unlabelled)))
    best = np.argmin((u + slack) / p)
    return float(np.clip(u[best] / p[best], 0.01, 0.99))


def prior_of_halves(positives: np.ndarray, unlabelled: np.ndarray) -> float:
    """The prior by a model of every other row, on the rows between; 0.5 for too few rows."""
    if len(positives) < 4 or len(unlabelled) < 4:
        return 0.5
    first = fit(positives[::2], unlabelled[::2], 0.5)
    return estimated_prior(first.scores(positives[1::2]), first.scores(unlabelled[1::2]))


def text_statistics(rows: DataFrame) -> DataFrame:
    """Columns of ``rows`` after the first (the text), and ``stats``."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[1:]), "stats array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text=0):
            stats = [statistics(t or "") for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(stats, pa.list_(pa.float64()))], names=[*batch.schema.names[1:], "stats"])

    return in_arrow(rows, run, schema)


def train_quality_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_positives: int = MAX_POSITIVES, max_unlabelled: int = MAX_UNLABELLED) -> QualityModel:
    """docs and labels: of the training folds only."""
    ids = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).filter("id is not null and label is not null")
    seen = ids.agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("label") == 1).cast("long")), F.lit(0)).alias("good")).first()
    trusted = ids.filter("label = 1").select("id").distinct()
    place = lambda c: F.pmod(F.xxhash64(c, F.lit(SEED)), F.lit(1 << 30)) / float(1 << 30)
    share = min(1.0, 0.95 * max_positives / max(1, trusted.count()))
    trusted = trusted.filter(place(F.col("id")) < share)  # about max_positives ids at most
    rows = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    numbered = F.xxhash64("text")
    share = min(1.0, 0.95 * max_unlabelled / max(1, rows.count()))
    drawn = F.pmod(F.xxhash64("id", F.lit(SEED + 1)), F.lit(1 << 30)) / float(1 << 30) < share
    sample = rows.join(F.broadcast(trusted.withColumn("trusted", F.lit(True))), "id", "left").select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"), F.coalesce(drawn, F.lit(False)).alias("drawn"), "id", numbered.alias("place"))
    picked = text_statistics(sample.filter("trusted or drawn")).dropDuplicates(["id", "place"])  # a row that repeats counts once
    got = picked.toPandas().sort_values(["place", "id"], kind="stable")  # halves don't depend on partitions
    x = np.array(got["stats"].tolist(), float).reshape(len(got), len(FEATURES))
    if not len(x):
        return QualityModel(np.zeros((len(FEATURES), 1)), np.zeros(2 * len(FEATURES)), 0.0)
    positives, unlabelled = x[got["trusted"].to_numpy(bool)], x[got["drawn"].to_numpy(bool)]
    prior = (seen["good"] + 1) / (seen["n"] + 2) if seen["good"] < seen["n"] else prior_of_halves(positives, unlabelled)
    return fit(positives, unlabelled, prior)


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """id, score and predicted of every row."""
    small = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias(id_col))
    kind = small.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text=0):
            x = np.array([statistics(t or "") for t in batch.column(0).to_pylist()], float).reshape(batch.num_rows, len(FEATURES))
            score = model.scores(x)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(score), pa.array((score >= keep_at).astype(np.int32))], names=[id_col, "score", "predicted"])

    return in_arrow(small, run, f"`{id_col}` {kind}, score double, predicted int")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    out = F.col("doc_id")
    model = train_quality_model(docs.filter(~held_out(out, 4, 2)), labels.filter(~held_out(out, 4, 2)))
    return score_quality(docs, model).select("doc_id", held_out(out, 4, 2).alias("held_out"), "score", "predicted")
