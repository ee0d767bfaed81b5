"""Items that appear together: pair counts and how far they exceed chance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items of a basket that one task pairs with as many others.
BLOCK = 256


def pair_counts(baskets: DataFrame, basket: str, item: str) -> DataFrame:
    """Baskets each unordered pair of different items shares: item_a < item_b, n_both.

    Items are made distinct within a basket; nulls in either column are dropped. A basket's items are cut into blocks of about BLOCK by
    hash, and each pair of blocks meets in its own task, so a basket of any size is spread and none is dropped or capped; counts
    combine before the shuffle. Empty input gives no rows.
    """
    rows = baskets.select(F.col(basket).alias("__b"), F.col(item).alias("__i")).dropna().distinct()
    sizes = rows.groupBy("__b").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("__blocks"))
    # Only baskets of several blocks need the join; there are at most rows / BLOCK of them.
    large = sizes.filter("__blocks > 1")
    small = rows.join(large, "__b", "left_anti").groupBy("__b").agg(F.sort_array(F.collect_list("__i")).alias("__s"))
    near = small.filter(F.size("__s") > 1).select(F.explode("__s").alias("item_a"), "__s").select("item_a", F.explode(F.filter("__s", lambda x: x > F.col("item_a"))).alias("item_b"))
    blocked = rows.join(large, "__b").withColumn("__k", F.pmod(F.xxhash64("__i"), F.col("__blocks").cast("bigint")).cast("int"))
    left = blocked.select("__b", F.col("__i").alias("item_a"), F.col("__k").alias("__ka"), F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)).alias("__kb"))
    right = blocked.select("__b", F.col("__i").alias("item_b"), F.col("__k").alias("__kb"), F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)).alias("__ka"))
    far = left.join(right, ["__b", "__ka", "__kb"]).filter(F.col("item_a") < F.col("item_b")).select("item_a", "item_b")
    return near.unionByName(far).groupBy("item_a", "item_b").agg(F.count(F.lit(1)).alias("n_both"))


def association(pairs: DataFrame, singles: DataFrame, total) -> DataFrame:
    """Lift and pointwise mutual information of counted pairs.

    pairs: item_a, item_b, n_both; singles: item, n (its marginal count); total: a number, or a one-row frame with a column total. Lift is
    n_both * total / (n_a * n_b), pmi its natural logarithm. Both sides are joined by item, so vocabularies of any size work.
    """
    a = singles.select(F.col("item").alias("item_a"), F.col("n").alias("n_a"))
    b = singles.select(F.col("item").alias("item_b"), F.col("n").alias("n_b"))
    out = pairs.join(a, "item_a").join(b, "item_b")
    out = out.crossJoin(F.broadcast(total.select("total"))) if isinstance(total, DataFrame) else out.withColumn("total", F.lit(total))
    lift = F.col("n_both").cast("double") * F.col("total") / (F.col("n_a").cast("double") * F.col("n_b"))
    return out.withColumn("lift", lift).withColumn("pmi", F.log("lift"))


def edge_label_pairs(edges: DataFrame, labels: DataFrame, a: tuple[str, ...], b: tuple[str, ...], key: tuple[str, ...], label: str) -> DataFrame:
    """Counts of unordered label pairs at the two ends of labelled edges: label_a <= label_b, n.

    Each edge is a basket of two items that may be equal. a and b name the columns of an end's key in edges, key those in labels, which holds
    one row per key. Edges with an unlabelled end are left out.
    """
    end = lambda cols, name: labels.select(*(F.col(k).alias(f"__{name}{n}") for n, k in enumerate(key)), F.col(label).alias(f"__label_{name}"))
    rows = edges.select(*(F.col(c).alias(f"__a{n}") for n, c in enumerate(a)), *(F.col(c).alias(f"__b{n}") for n, c in enumerate(b)))
    rows = rows.join(end(a, "a"), [f"__a{n}" for n in range(len(key))]).drop(*(f"__a{n}" for n in range(len(key))))
    rows = rows.join(end(b, "b"), [f"__b{n}" for n in range(len(key))])
    return rows.groupBy(F.least("__label_a", "__label_b").alias("label_a"), F.greatest("__label_a", "__label_b").alias("label_b")).agg(F.count(F.lit(1)).alias("n"))
