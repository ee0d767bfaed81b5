"""Scoring vectors against labels: standardised features, a multinomial logistic model, rank scores per class, and simple baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of scores in which ranks are counted, so that no task sorts all scores.
RANGES = 256


def class_aucs(rows: DataFrame, name: str, score: str, positive: str) -> DataFrame:
    """name, auc, n_positive: per class the chance that a positive row scores above a negative one, ties half; null without both. Null scores and flags are left out."""
    by = rows.dropna(subset=[score, positive]).groupBy(name, F.col(score).cast("double").alias("s"))
    by = by.agg(F.sum(F.col(positive).cast("bigint")).alias("p"), F.sum(1 - F.col(positive).cast("bigint")).alias("n"))
    ends = by.groupBy(name).agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    by = by.join(ends, name).withColumn("r", F.floor((F.col("s") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-300)) * (RANGES - 1)))
    ranges = by.groupBy(name, "r").agg(F.sum("n").alias("rn"))
    before = ranges.select(name, "r", (F.sum("rn").over(Window.partitionBy(name).orderBy("r")) - F.col("rn")).alias("before"))  # RANGES rows a class
    below = F.sum("n").over(Window.partitionBy(name, "r").orderBy("s")) - F.col("n") + F.col("before")
    ranked = by.join(before, [name, "r"]).select(name, (F.col("p") * (below + F.col("n") / 2)).alias("w"), "p", "n")
    return ranked.groupBy(name).agg((F.sum("w") / F.nullif(F.sum("p") * F.sum("n"), F.lit(0))).alias("auc"), F.sum("p").alias("n_positive"))


def macro_auc(rows: DataFrame, name: str, score: str, positive: str) -> DataFrame:
    """One row: auc (mean over the classes that have both kinds of rows), n_classes."""
    return class_aucs(rows, name, score, positive).agg(F.avg("auc").alias("auc"), F.count("auc").alias("n_classes"))


def majority_rate(rows: DataFrame, label: str) -> DataFrame:
    """One row: label (the most frequent; ties: the least), rate, n: what guessing it would reach."""
    counts = rows.dropna(subset=[label]).groupBy(label).agg(F.count(F.lit(1)).alias("c"))
    return counts.agg(F.min_by(label, F.struct(-F.col("c"), F.col(label))).alias("label"), (F.max("c") / F.sum("c")).alias("rate"), F.sum("c").alias("n"))


def logistic_scores(train: DataFrame, test: DataFrame, ident: str, vector: str, label: str) -> DataFrame:
    """One row: auc (macro, one class against the rest), accuracy, n_train, n_test, n_classes of a multinomial logistic model.

    Features are standardised by the training rows (a deviation of zero as one); the weight of the penalty is that of one over the number of rows; test rows of
    classes that training lacks are left out. vector: array of numbers of one length. The fit is Spark's own, distributed over the training rows.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    ready = lambda df: df.dropna(subset=[vector, label]).select(F.col(ident).alias("id"), F.col(label).cast("string").alias("label"), array_to_vector(F.col(vector).cast("array<double>")).alias("raw"))
    classes = train.dropna(subset=[vector, label]).select(F.col(label).cast("string").alias("label")).distinct()
    classes = classes.withColumn("code", (F.row_number().over(Window.orderBy("label")) - 1).cast("double"))  # classes are few
    fit_rows, test_rows = ready(train).join(classes, "label"), ready(test).join(classes, "label")
    n = fit_rows.count()
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True).fit(fit_rows)
    model = LogisticRegression(labelCol="code", family="multinomial", maxIter=200, regParam=1.0 / max(n, 1), standardization=False).fit(scaler.transform(fit_rows))
    scored = model.transform(scaler.transform(test_rows)).select("id", "code", "prediction", vector_to_array("probability").alias("p"))
    each = scored.select("code", F.posexplode("p").alias("k", "score")).select("k", "score", (F.col("k") == F.col("code")).alias("positive"))
    simple = scored.agg(F.avg((F.col("code") == F.col("prediction")).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n_test"))
    one = macro_auc(each, "k", "score", "positive").select("auc")
    return one.crossJoin(simple).select("auc", "accuracy", F.lit(n).alias("n_train"), "n_test", F.lit(model.numClasses).alias("n_classes"))  # one row each


def size_picks(cells: DataFrame, ident: str, radius: str, limit: float) -> DataFrame:
    """pick, ident, radius: the smallest, the median (lower), the largest within limit and the largest cell by radius (ties: ident), for showing a mask."""
    rows = cells.dropna(subset=[radius]).select(F.col(ident).alias("id"), F.col(radius).alias("r"))
    row = F.struct("r", "id")
    ends = rows.agg(F.min(row).alias("smallest"), F.max(row).alias("largest"), F.max(F.when(F.col("r") <= limit, row)).alias("largest_fitting"))
    from .batching import value_at_rank

    middle = value_at_rank(rows, "r", "id")
    picks = F.explode(F.array(*(F.struct(F.lit(k).alias("pick"), F.col(k).alias("x")) for k in ("smallest", "largest_fitting", "largest"))))
    out = ends.select(picks.alias("e")).select("e.pick", "e.x.id", "e.x.r").unionByName(middle.select(F.lit("median").alias("pick"), "id", "r"))
    return out.filter("id is not null").select("pick", F.col("id").alias(ident), F.col("r").alias(radius))
