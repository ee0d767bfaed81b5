"""Exact percentiles per group of very large columns by distributed multi-select, and summaries that combine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import Scratch

#: Rows of a partition that are sorted into chunks at once.
CHUNK_ROWS = 1 << 20
#: What is left of a target's range is sorted when it holds at most so many values over all partitions; the last rounds would cost more than they discard.
SETTLE = 64


def is_measurement(c: str):
    """True for a finite number of at least zero: null, NaN, infinite and negative values are no measurements."""
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.col(c) >= 0) & (F.col(c) < float("inf"))


def _chunks(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row per group and piece of a partition: keys, arr (sorted values). Values aren't shuffled."""
    src = rows.select(*keys, F.col(value).cast("double").alias("__v"))
    schema = src.select(*keys, F.array("__v").alias("arr"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush():
            table = pa.Table.from_batches(held).combine_chunks()
            codes = np.zeros(len(table), np.int64)
            for k in keys:
                part = table[k].combine_chunks().dictionary_encode("encode")
                part = part.indices.to_numpy(zero_copy_only=False)
                codes = np.unique(codes * (int(part.max(initial=0)) + 1) + part, return_inverse=True)[1]
            v = table["__v"].to_numpy()
            order = np.lexsort((v, codes))
            at = np.flatnonzero(np.diff(codes[order], prepend=-1))
            arr = pa.ListArray.from_arrays(pa.array(np.append(at, len(v)).astype(np.int32)), pa.array(v[order]))
            first = pa.array(order[at])
            yield from pa.Table.from_arrays([*(table[k].take(first).combine_chunks() for k in keys), arr], names=[*keys, "arr"]).to_batches(max_chunksize=2000)

        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if n >= CHUNK_ROWS:
                yield from flush()
                held, n = [], 0
        if n:
            yield from flush()

    return src.mapInArrow(build, schema.schema)


_PART = "t int, lt bigint, eq bigint, lm double, lw bigint, rm double, rw bigint"


def _step(pdf: pd.DataFrame) -> tuple[list, list, list]:
    """Per chunk: what it counts and proposes for each target, the values still in some target's range, and those of ranges that are to be sorted, each once."""
    props, kept, last = [], [], []
    for arr, targets in zip(pdf["arr"], pdf["targets"]):
        out, keep, tail = [], np.zeros(len(arr), bool), np.zeros(len(arr), bool)
        for x in targets:
            i, j = np.searchsorted(arr, x["lo"], "right"), np.searchsorted(arr, x["hi"], "left")
            if x["settle"]:
                tail[i:j] = True
                continue
            a, b = np.searchsorted(arr[i:j], x["pivot"], "left") + i, np.searchsorted(arr[i:j], x["pivot"], "right") + i
            out.append({"t": x["t"], "lt": a - i, "eq": b - a, "lm": float(arr[(i + a) // 2]) if a > i else None, "lw": a - i, "rm": float(arr[(b + j) // 2]) if j > b else None, "rw": j - b})
            keep[i:j] = True
        props.append(out)
        kept.append(arr[keep])
        last.append(arr[tail])
    return props, kept, last


def _weighted_median(value: str, weight: str):
    """Aggregate: the least value up to which half of the weight lies; its input has a row per chunk."""
    pairs = F.sort_array(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"), F.col(weight).alias("w")))))
    half = F.aggregate(pairs, F.lit(0).cast("bigint"), lambda a, x: a + x["w"]) / 2
    return F.aggregate(pairs, F.struct(F.lit(0).cast("bigint").alias("s"), F.lit(None).cast("double").alias("p")), lambda a, x: F.struct((a["s"] + x["w"]).alias("s"), F.when(a["p"].isNull() & (a["s"] + x["w"] >= half), x["v"]).otherwise(a["p"]).alias("p")))["p"]


def percentiles(rows: DataFrame, keys: list[str], value: str, percents: list[int], rounds: list[tuple[int, int]] | None = None) -> DataFrame:
    """Exact percentiles per group: keys, n, percent, value; value is the ceil(n * percent / 100)-th smallest (the first at 0).

    Partitions sort their values per group once and propose the medians of what is left in each target's range; the weighted median of the
    proposals becomes the pivot, values below, at and above it are counted, ruled-out ranges are discarded, and so on until a target
    equals a pivot or its range holds no more than SETTLE values over all partitions, which are then sorted, once for all targets of the group. Only counts,
    medians and those few values are shuffled, so a group of any size loads no single task. What is left shrinks each round; rounds grow with the logarithm
    of the largest group. rounds: gets for each round how many targets were counted against a pivot and how many were sorted. Nulls in value are left out, null keys are a group, NaN and infinite values must be removed before; groups without
    values give no row, nor does an empty table. The result doesn't depend on how rows lie in partitions, and repeated rows count each time.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark)
    safe = [f"__g{n}" for n in range(len(keys))]
    src = rows.filter(F.col(value).isNotNull()).select(*(F.col(k).alias(s) for k, s in zip(keys, safe)), F.col(value))
    chunks = scratch.table(_chunks(src, safe, value), "chunks")
    middle = F.element_at("arr", (F.size("arr") / 2).cast("int") + 1)
    base = chunks.select(*safe, F.size("arr").cast("bigint").alias("w"), middle.alias("m"), F.col("arr")[0].alias("a"), F.element_at("arr", -1).alias("b"))
    whole = base.groupBy(*safe).agg(F.sum("w").alias("n"), _weighted_median("m", "w").alias("pivot"))
    ask = F.array(*(F.struct(F.lit(p).alias("t"), F.greatest(F.lit(1), F.floor((F.col("n") * p + 99) / 100)).cast("bigint").alias("rank")) for p in percents))
    state = whole.select(*safe, "n", "pivot", F.explode(ask).alias("x")).select(*safe, "n", "x.t", "x.rank", F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"), F.lit(0).cast("bigint").alias("below"), F.col("n").alias("left"), "pivot", F.lit(None).cast("double").alias("value"))
    state = scratch.table(state, "state0")
    done: list[DataFrame] = []
    key_types = dict(chunks.dtypes)
    out_schema = ", ".join(f"{s} {key_types[s]}" for s in safe) + f", arr array<double>, last array<double>, props array<struct<{_PART.replace(' ', ':').replace(',:', ',')}>>"

    def pass_over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            props, kept, last = _step(pdf)
            yield pdf[safe].assign(arr=kept, last=last, props=props)

    same = lambda a, b, c: [a[k].eqNullSafe(b[k]) for k in c]
    turn = 0
    while True:
        turn += 1
        open_ = state.filter("value is null")
        if rounds is not None:
            settled_now = open_.filter(F.col("left") <= SETTLE).count()
            rounds.append((open_.count() - settled_now, settled_now))
        grouped = open_.groupBy(*safe).agg(F.collect_list(F.struct("t", "lo", "hi", "pivot", (F.col("left") <= SETTLE).alias("settle"))).alias("targets"))
        joined = chunks.join(grouped, [x for x in same(chunks, grouped, safe)] or F.lit(True)).select(*(chunks[s] for s in safe), "arr", "targets")
        passed = scratch.table(joined.mapInPandas(pass_over, out_schema), f"pass{turn}")
        votes = passed.select(*safe, F.explode("props").alias("p")).select(*safe, "p.*")
        votes = votes.groupBy(*safe, "t").agg(F.sum("lt").alias("lt"), F.sum("eq").alias("eq"), _weighted_median("lm", "lw").alias("lm"), _weighted_median("rm", "rw").alias("rm"))
        tails = passed.filter(F.size("last") > 0).groupBy(*safe).agg(F.sort_array(F.flatten(F.collect_list("last"))).alias("last"))  # SETTLE values a target at most
        s, v, e = open_.alias("s"), votes.alias("v"), tails.alias("e")
        on = [F.col(f"s.{k}").eqNullSafe(F.col(f"v.{k}")) for k in [*safe, "t"]]
        to = [F.col(f"s.{k}").eqNullSafe(F.col(f"e.{k}")) for k in safe] or [F.lit(True)]
        settled = F.col("s.left") <= SETTLE
        own = F.filter("last", lambda x: (x > F.col("s.lo")) & (x < F.col("s.hi")))
        low = F.col("rank") <= F.col("below") + F.col("lt")
        at = ~low & (F.col("rank") <= F.col("below") + F.col("lt") + F.col("eq"))
        found = F.when(settled, F.get(own, (F.col("rank") - F.col("below") - 1).cast("int"))).when(at, F.col("pivot"))
        new = s.join(v, on, "left").join(e, to, "left").select(
            *(F.col(f"s.{k}") for k in [*safe, "n", "t", "rank"]),
            F.when(low, F.col("lo")).otherwise(F.col("pivot")).alias("lo"),
            F.when(low, F.col("pivot")).otherwise(F.col("hi")).alias("hi"),
            F.when(low, F.col("below")).otherwise(F.col("below") + F.col("lt") + F.col("eq")).alias("below"),
            F.when(low, F.col("lt")).otherwise(F.col("left") - F.col("lt") - F.col("eq")).alias("left"),
            F.when(low, F.col("lm")).otherwise(F.col("rm")).alias("pivot"),
            found.alias("value"),
        )
        state = scratch.table(new, f"state{turn}")
        chunks = passed.select(*safe, "arr").filter(F.size("arr") > 0)
        done.append(state.filter("value is not null").select(*safe, "n", "t", "value"))
        if turn > 1:
            scratch.drop(f"pass{turn - 1}")
        else:
            scratch.drop("chunks")
        if state.filter("value is null").limit(1).count() == 0:
            break
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    scratch.drop(f"pass{turn}")
    return out.select(*(F.col(s).alias(k) for s, k in zip(safe, keys)), "n", F.col("t").alias("percent"), "value")


def combine(summaries: DataFrame, keys: list[str], percents: list[int]) -> DataFrame:
    """Percentiles of coarser groups from finer ones' percentiles at a grid of percents, without the values.

    summaries: any finer keys, n, percent, value, as percentiles() gives for a grid 0, s, 2s, ..., 100 with one step s. A summary's value at
    percent p stands for the n * s / 100 values up to it (the one at 0 for none), so each part, and so the whole, is off by at most s percent of its
    ranks, plus one per part: rank_error gives that bound as a share of n. Summaries of days, partitions or engines combine in any order.
    """
    grid = summaries.withColumn("__w", F.when(F.col("percent") == 0, F.lit(0.0)).otherwise(F.col("n").cast("double")))
    totals = grid.filter("percent = 100").groupBy(*keys).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts"))
    steps = grid.filter("__w > 0").groupBy(*keys, "value").agg(F.sum("__w").alias("__w"))
    run = steps.withColumn("__c", F.sum("__w").over(Window.partitionBy(*keys).orderBy("value")))
    width = grid.agg((F.count_distinct("percent") - 1).alias("__m"))
    a, b = run.alias("a"), totals.alias("b")
    joined = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]).crossJoin(F.broadcast(width))
    joined = joined.select(*(F.col(f"a.{k}").alias(k) for k in keys), F.col("value"), F.col("n"), (F.col("__c") / F.col("__m")).alias("__c"), (F.lit(1.0) / F.col("__m") + F.col("parts") / F.col("n")).alias("rank_error"))
    asked = joined.withColumn("percent", F.explode(F.array(*(F.lit(p) for p in percents)))).filter(F.col("__c") >= F.col("n") * F.col("percent") / 100 - 1e-6)
    return asked.groupBy(*keys, "n", "rank_error", "percent").agg(F.min("value").alias("value"))
