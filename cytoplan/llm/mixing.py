"""Mixing sources to target weights under repetition caps, by min-cost flow over membership patterns."""

from __future__ import annotations

import math
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Texts longer than this many characters are tokenised piece by piece, cut at white space, so that none needs much memory.
PIECE_CHARS = 100_000


@lru_cache(maxsize=4)
def _encoder(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def _pieces(text: str) -> list[str]:
    out, at = [], 0
    while len(text) - at > PIECE_CHARS:
        end = text.rfind(" ", at + 1, at + PIECE_CHARS)
        end = end if end > at else at + PIECE_CHARS
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


def token_counts(docs: DataFrame, text: str, path: str = TOKENIZER, name: str = "n_tokens") -> DataFrame:
    """docs with the number of tokens of text under the public tokenizer at path; null and empty texts have none. text is dropped."""
    keep = [c for c in docs.columns if c != text]

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _encoder(path)
        for texts in batches:
            parts = [_pieces(t) if t else [] for t in texts]
            flat = [len(e.ids) for e in encoder.encode_batch([p for ps in parts for p in ps], add_special_tokens=False)]
            at, out = 0, []
            for ps in parts:
                out.append(sum(flat[at : at + len(ps)]))
                at += len(ps)
            yield pd.Series(out, dtype="int64")

    return docs.select(*keep, count(F.col(text)).alias(name))


def min_cost_flow(n: int, arcs: list[tuple[int, int, int, float]], start: int, end: int) -> list[int]:
    """Flow of least cost among those of most volume, by shortest augmenting paths; arcs are (from, to, capacity, cost); returns each arc's flow."""
    to, cap, cost, out = [], [], [], [[] for _ in range(n)]
    for u, v, c, w in arcs:
        for a, b, k, x in ((u, v, c, w), (v, u, 0, -w)):
            out[a].append(len(to))
            to.append(b)
            cap.append(k)
            cost.append(x)
    while True:
        dist, via = [float("inf")] * n, [-1] * n
        dist[start], queue, queued = 0.0, [start], {start}
        while queue:
            u = queue.pop(0)
            queued.discard(u)
            for e in out[u]:
                if cap[e] > 0 and dist[u] + cost[e] < dist[to[e]] - 1e-9:
                    dist[to[e]], via[to[e]] = dist[u] + cost[e], e
                    if to[e] not in queued:
                        queue.append(to[e])
                        queued.add(to[e])
        if via[end] < 0:
            break
        step, v = float("inf"), end
        while v != start:
            step, v = min(step, cap[via[v]]), to[via[v] ^ 1]
        v = end
        while v != start:
            cap[via[v]] -= step
            cap[via[v] ^ 1] += step
            v = to[via[v] ^ 1]
    return [cap[2 * k + 1] for k in range(len(arcs))]


def plan(patterns: list[tuple[tuple[str, ...], int]], targets: dict[str, tuple[float, int]], total: int) -> dict[tuple[tuple[str, ...], str], int]:
    """Tokens, repeats included, that each pattern gives to each source.

    patterns: (sources, tokens); targets: source -> (share, most uses); total: tokens of the wanted mixture. A use costs one more than
    the one before, so repeats are spread and come last. A text of several sources may be used max_repeats times of the source it is
    counted for, and over all sources no more often than the largest of theirs.
    """
    names = sorted(targets)
    patterns = [(tuple(s for s in p if s in targets), t) for p, t in patterns]
    patterns = [(p, t) for p, t in patterns if p and t > 0]
    n = 2 + len(names)
    arcs, meaning = [], []
    for p, t in patterns:
        most = max(targets[s][1] for s in p)
        node = n
        n += 1
        for use in range(most):
            arcs.append((0, node, t, float(use)))
            meaning.append(None)
        for s in p:
            arcs.append((node, 2 + names.index(s), t * targets[s][1], 0.0))
            meaning.append((p, s))
    for s in names:
        arcs.append((2 + names.index(s), 1, math.ceil(targets[s][0] * total), 0.0))
        meaning.append(None)
    flows = min_cost_flow(n, arcs, 0, 1)
    got: dict[tuple[tuple[str, ...], str], int] = {}
    for f, m in zip(flows, meaning):
        if m and f:
            got[m] = got.get(m, 0) + f
    return got


#: Buckets of the seeded order in which a pattern's texts are taken; the last one may overshoot by its share of the pattern.
BUCKETS = 1 << 16


def mix(docs: DataFrame, targets: DataFrame, key: str, copy_key: str, source: str, tokens: str, seed: int = 0, overlap: bool = True) -> tuple[DataFrame, DataFrame]:
    """Chooses texts so that each source reaches its share of the tokens of all docs, or as near as its repeats allow.

    docs: one row per document; copy_key is equal for exact copies, source its cleaned source (null: counts in the total only). targets:
    source, target_share, max_repeats. With overlap, copies of a text in several sources are one text that any of them may use;
    without, each source has its own. Returns the chosen texts (copy_key, key of its first document, source, uses) and the report per source
    (source, target_share, max_repeats, tokens, wanted, planned, used, share). Only patterns of sources reach the driver, of which there are at
    most 2 ** sources; texts are taken in a seeded order by bucket sums, without a sort. Empty docs give a report of zeros; null texts
    have no tokens and are never chosen; ties in the order share a bucket.
    """
    wanted = {r["source"]: (float(r["target_share"]), int(r["max_repeats"])) for r in targets.select("source", "target_share", "max_repeats").collect()}
    total = int(docs.agg(F.coalesce(F.sum(tokens), F.lit(0)).alias("t")).collect()[0]["t"])
    in_targets = docs.filter(F.col(source).isin(list(wanted)) & (F.col(tokens) > 0))
    by = [copy_key] if overlap else [copy_key, source]
    texts = in_targets.groupBy(*by).agg(F.sort_array(F.collect_set(source)).alias("__pattern"), F.first(tokens).alias("__n") if overlap else F.sum(tokens).alias("__n"), F.min(key).alias(key))
    texts = texts.drop(source) if not overlap else texts
    texts = texts.withColumn("__bucket", F.pmod(F.xxhash64(copy_key, F.lit(seed)), F.lit(BUCKETS)))
    sums = texts.groupBy("__pattern").agg(F.sum("__n").alias("n")).collect()
    patterns = [(tuple(r["__pattern"]), int(r["n"])) for r in sums]
    flows = plan(patterns, wanted, total)
    spark, size = docs.sparkSession, dict(patterns)
    rows, at = [], dict.fromkeys(size, 0)
    for (p, s), f in sorted(flows.items()):
        rows.append((list(p), s, at[p], at[p] + f, size[p]))
        at[p] += f
    spans = spark.createDataFrame(rows, "__pattern array<string>, source string, __lo bigint, __hi bigint, __size bigint")
    from pyspark.sql import Window

    buckets = texts.groupBy("__pattern", "__bucket").agg(F.sum("__n").alias("__b"))
    place = buckets.withColumn("__at", F.sum("__b").over(Window.partitionBy("__pattern").orderBy("__bucket")) - F.col("__b")).drop("__b")
    chosen = texts.join(place, ["__pattern", "__bucket"]).join(F.broadcast(spans), "__pattern")
    # The text at place a is used in pass u if lo <= u * size + a < hi.
    passes = lambda x: F.ceil((F.col(x) - F.col("__at")) / F.col("__size"))
    chosen = chosen.withColumn("uses", F.greatest(passes("__hi") - F.greatest(passes("__lo"), F.lit(0)), F.lit(0)).cast("int")).filter("uses > 0")
    used = chosen.groupBy("source").agg(F.sum(F.col("__n") * F.col("uses")).alias("used"))
    own = in_targets.groupBy(F.col(source).alias("source")).agg(F.sum(tokens).alias("tokens"))
    planned = {s: 0 for s in wanted}
    for (_, s), f in flows.items():
        planned[s] += f
    goal = spark.createDataFrame([(s, w, k, w * total, planned[s]) for s, (w, k) in wanted.items()], "source string, target_share double, max_repeats int, wanted double, planned bigint")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    report = goal.join(own, "source", "left").join(used, "source", "left").select("source", "target_share", "max_repeats", zero("tokens"), "wanted", "planned", zero("used"))
    all_used = report.agg(F.greatest(F.sum("used"), F.lit(1)).alias("__all"))
    report = report.crossJoin(F.broadcast(all_used)).withColumn("share", F.col("used") / F.col("__all")).drop("__all")
    return chosen.select(copy_key, key, "source", "uses"), report


def short_sources(report: DataFrame) -> DataFrame:
    """Sources whose flow falls short of what they need; a flow of min(capacity, the wanted tokens rounded up) is below it only then."""
    return report.filter(F.col("planned") < F.col("wanted")).select("source")
