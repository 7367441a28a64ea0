"""Topic classifiers: one-vs-rest logistic models, out-of-fold scores, thresholds."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Tokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegauge.operators.versions import latest

#: Salted groups of a class, and classes up to which their counts are broadcast.
SALTS, CLASSES = 64, 1000
GRID = [round(0.2 + 0.025 * k, 3) for k in range(25)]


def folded(rows: DataFrame, label: str, key: str, folds: int = 5) -> DataFrame:
    """``fold`` 0..folds-1, dealt evenly within each class.

    A class may hold most rows, so rows are numbered within salted groups of it, by a hash of the
    key, and the counts of the groups before (SALTS a class) are added.
    """
    salted = rows.withColumn("fold_salt", F.pmod(F.xxhash64(key), F.lit(SALTS)))
    before = Window.partitionBy(label).orderBy("fold_salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = salted.groupBy(label, "fold_salt").agg(F.count("*").alias("n")).select(label, "fold_salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("fold_before"))
    own = salted.withColumn("fold_n", F.row_number().over(Window.partitionBy(label, "fold_salt").orderBy(F.xxhash64(key, F.lit(1)), key)))
    placed = own.join(F.broadcast(counts) if rows.select(label).distinct().count() <= CLASSES else counts, [label, "fold_salt"])
    return placed.withColumn("fold", F.pmod(F.col("fold_before") + F.col("fold_n") - 1, F.lit(folds)).cast("int")).select(*rows.columns, "fold")


def weighted(rows: DataFrame, label: str) -> DataFrame:
    """``weight``: rows / (2 * rows of the class)."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n_class"))
    total = counts.agg(F.sum("n_class").alias("n_all"))
    return rows.join(F.broadcast(counts.crossJoin(total)), label).withColumn("weight", F.col("n_all") / (2.0 * F.col("n_class"))).drop("n_class", "n_all")  # two classes


def pipeline(text: str, label: str, c: float = 2.0, features: int = 4096) -> Pipeline:
    return Pipeline(stages=[Tokenizer(inputCol=text, outputCol="__words"), HashingTF(inputCol="__words", outputCol="__tf", numFeatures=features), LogisticRegression(featuresCol="__tf", labelCol=label, weightCol="weight", regParam=1 / c / 100, maxIter=30)])


def scored(model, rows: DataFrame) -> DataFrame:
    return model.transform(rows).withColumn("prob", vector_to_array("probability")[1]).drop("__words", "__tf", "rawPrediction", "probability", "prediction")


def out_of_fold(rows: DataFrame, text: str, label: str, key: str, folds: int = 5) -> DataFrame:
    """``prob`` of every row from the model that didn't see it."""
    dealt = folded(rows, label, key, folds)
    out = None
    for k in range(folds):
        model = pipeline(text, label).fit(weighted(dealt.filter(F.col("fold") != k), label))
        part = scored(model, dealt.filter(F.col("fold") == k))
        out = part if out is None else out.unionByName(part)
    return out


def quality_at(rows: DataFrame, label: str, grid: list[float] = GRID) -> DataFrame:
    """Per threshold: precision, recall, F1 and distance from the true prevalence."""
    spread = rows.select(F.col(label).alias("y"), "prob", F.explode(F.array(*map(F.lit, grid))).alias("threshold"))
    hit = F.col("prob") >= F.col("threshold")
    s = spread.groupBy("threshold").agg(F.count_if(hit & (F.col("y") == 1)).alias("tp"), F.count_if(hit & (F.col("y") == 0)).alias("fp"), F.count_if(~hit & (F.col("y") == 1)).alias("fn"), F.count("*").alias("n"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return s.select("threshold", F.when(tp + fp > 0, tp / (tp + fp)).alias("precision"), F.when(tp + fn > 0, tp / (tp + fn)).alias("recall"), F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).alias("f1"), F.abs(fp - fn) .alias("gap"))


def pick_threshold(rows: DataFrame, label: str, by: str = "prevalence") -> DataFrame:
    """The threshold nearest the true prevalence (ties: higher F1), or of the highest F1."""
    order = [F.asc("gap"), F.desc_nulls_last("f1"), F.asc("threshold")] if by == "prevalence" else [F.desc_nulls_last("f1"), F.asc("threshold")]
    return latest(quality_at(rows, label).withColumn("one", F.lit(1)), ["one"], order).drop("one")


def majority(votes: DataFrame, key: str, vote: str) -> DataFrame:
    """1 where at least half of the annotators say so."""
    return votes.groupBy(key).agg((F.avg(vote) >= 0.5).cast("int").alias("label"))


def to_rows(scores: DataFrame, key: list[str], columns: dict[str, int], thresholds: dict[str, float]) -> DataFrame:
    """Long form: a row per topic whose probability reaches its threshold."""
    pairs = F.array(*(F.when(F.col(c) >= thresholds[c], F.struct(F.lit(t).alias("topic_id"), F.col(c).cast("float").alias("score"))) for c, t in columns.items()))
    return scores.select(*key, F.explode(F.array_compact(pairs)).alias("t")).select(*key, "t.*")


def micro_f1(rows: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Precision, recall and F1 over all (truth, prediction) column pairs together."""
    n = lambda y, p: sum((F.count_if((F.col(a) == y) & (F.col(b) == p)) for a, b in pairs[1:]), F.count_if((F.col(pairs[0][0]) == y) & (F.col(pairs[0][1]) == p)))
    s = rows.agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(1, 0).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return s.select("tp", "fp", "fn", F.when(tp + fp > 0, tp / (tp + fp)).alias("precision"), F.when(tp + fn > 0, tp / (tp + fn)).alias("recall"), F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).alias("f1"))
