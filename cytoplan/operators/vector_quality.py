"""How well vectors separate labels: separation, nearest-neighbour agreement, baselines and rank scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .batching import stratified_sample

#: Fixed value: most rows that are compared pairwise; larger sets are sampled by label first.
MOST_PAIRWISE = 6000


def centred_units(rows: DataFrame, ident: str, vector: str, width: int, keep: list[str]) -> DataFrame:
    """ident, keep and unit: vectors less the mean of all rows, at length one (zeros stay zero)."""
    mean = rows.agg(F.array(*(F.avg(F.col(vector)[k].cast("double")) for k in range(width))).alias("__m"))
    off = rows.crossJoin(F.broadcast(mean)).withColumn("__c", F.zip_with(vector, "__m", lambda a, b: a.cast("double") - b))  # one row
    norm = off.withColumn("__n", F.sqrt(F.aggregate("__c", F.lit(0.0), lambda s, e: s + e * e)))
    return norm.select(ident, *keep, F.transform("__c", lambda e: F.when(F.col("__n") > 0, e / F.col("__n")).otherwise(0.0)).alias("unit"))


def separation_report(units: DataFrame, ident: str, label: str, most: int = MOST_PAIRWISE) -> DataFrame:
    """One row: mean_same, mean_other (mean cosine of pairs of equal and of different labels), agreement (share whose nearest other row has the label; ties: least
    id), chance (1 / labels), n. Means are those of all rows and come from sums per label, so no pair is formed for them; nearest rows are looked for
    among all rows, or, of more than `most`, among a sample that takes the same number of each label. Labels are few.
    """
    rows = units.select(F.col(ident).alias("id"), F.col(label).alias("label"), "unit").dropna()
    width = rows.agg(F.max(F.size("unit")).alias("w")).collect()[0]["w"] or 0
    square = F.aggregate("unit", F.lit(0.0), lambda a, e: a + e * e)
    sums = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(square).alias("own"), F.array(*(F.sum(F.get("unit", F.lit(k))) for k in range(width))).alias("total")).collect()  # a row per label
    if not sums:
        return rows.sparkSession.createDataFrame([], "mean_same double, mean_other double, agreement double, chance double, n bigint")
    n, own, total = np.array([r["n"] for r in sums], float), sum(r["own"] for r in sums), np.array([r["total"] for r in sums], float)
    same, every = (total * total).sum() - own, (total.sum(axis=0) ** 2).sum() - own
    n_same, n_all = (n * (n - 1)).sum(), n.sum() * (n.sum() - 1)
    few = rows
    if n.sum() > most:
        hashed = rows.withColumn("__hash", F.pmod(F.xxhash64("id"), F.lit(1 << 32)))
        few = stratified_sample(hashed, "__hash", "label", max(1, most // len(sums)), least=1).drop("__hash")
    pdf = few.orderBy("id").toPandas()  # at most `most` rows
    shared = rows.sparkSession.sparkContext.broadcast((np.stack(pdf["unit"].to_numpy()), pdf["label"].to_numpy()))

    def hits(batches):
        x, labels = shared.value
        for b in batches:
            if len(b):
                s = np.round(x[b["at"].to_numpy()] @ x.T, 12)
                s[np.arange(len(s)), b["at"].to_numpy()] = -2
                yield pd.DataFrame({"hit": labels[s.argmax(axis=1)] == labels[b["at"].to_numpy()]})

    one = rows.sparkSession.range(len(pdf)).withColumnRenamed("id", "at").mapInPandas(hits, "hit boolean").agg(F.avg(F.col("hit").cast("double")).alias("agreement"))
    lit = lambda v: F.lit(v).cast("double")
    agreement = F.col("agreement") if len(pdf) > 1 else lit(None)
    return one.select(
        lit(float(same / n_same) if n_same else None).alias("mean_same"), lit(float((every - same) / (n_all - n_same)) if n_all > n_same else None).alias("mean_other"),
        agreement.alias("agreement"), lit(1 / len(sums)).alias("chance"), F.lit(int(n.sum())).cast("bigint").alias("n"),
    )


def rank_auc(rows: DataFrame, score: str, positive: str) -> DataFrame:
    """One row, auc: chance that a positive row scores above a negative one, ties half, by counts per score; null without both classes."""
    by = rows.dropna(subset=[score, positive]).groupBy(F.col(score).cast("double").alias("s")).agg(F.sum(F.col(positive).cast("bigint")).alias("p"), F.sum(1 - F.col(positive).cast("bigint")).alias("n"))
    # Scores are ranked within ranges of about equal width, so no task sorts all of them.
    ends = by.agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    by = by.crossJoin(F.broadcast(ends)).withColumn("r", F.floor((F.col("s") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-300)) * 255))
    ranges = by.groupBy("r").agg(F.sum("n").alias("rn")).select("r", (F.sum("rn").over(Window.orderBy("r")) - F.col("rn")).alias("before"))  # 256 rows
    below = F.sum("n").over(Window.partitionBy("r").orderBy("s")) - F.col("n") + F.col("before")
    return by.join(F.broadcast(ranges), "r").select((F.col("p") * (below + F.col("n") / 2)).alias("w"), "p", "n").agg((F.sum("w") / F.nullif(F.sum("p") * F.sum("n"), F.lit(0))).alias("auc"))


def densest_region(points: DataFrame, space: str, x: str, y: str, bins: int = 40) -> DataFrame:
    """space, bx, by, n: the fullest of bins x bins cells over each space's extent (ties: least bx, by)."""
    box = points.groupBy(space).agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    cell = lambda c, a, b: F.least(F.floor((F.col(c) - F.col(a)) / F.greatest(F.col(b) - F.col(a), F.lit(1e-9)) * bins), F.lit(bins - 1)).cast("int")
    counts = points.join(box, space).groupBy(space, cell(x, "x0", "x1").alias("bx"), cell(y, "y0", "y1").alias("by")).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(space).agg(F.max_by(F.struct("bx", "by", "n"), F.struct("n", -F.col("bx"), -F.col("by"))).alias("b")).select(space, "b.*")


def standardised(c: str, mean: Column, sd: Column) -> Column:
    """(c - mean) / sd, a standard deviation of zero read as one."""
    return (F.col(c) - mean) / F.when(sd == 0, 1.0).otherwise(sd)
