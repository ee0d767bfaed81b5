"""Most similar vectors by cross-polytope hashing: pseudo-rotations, multiprobe tables and exact reranking."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import Scratch, hot_keys, salted

#: Rows of a bucket that one task compares with as many others; larger buckets are cut into blocks whose pairs are spread.
BLOCK = 16384
#: Rows that share a bucket, about: it decides the number of functions.
MATES = 2048
#: Candidates a row of a bucket may have beyond k on average because similarities of rounded vectors don't tell them apart; other buckets are compared again in full.
SPARE = 8
#: From this least similarity on, half of the entries bound it well enough to look at those first.
LEAST_BOUNDED = 0.5
#: Bytes of vectors gathered before whole buckets are solved, and rows of a bucket compared with its columns at once.
BYTES_AT_ONCE, ROWS_COMPARED = 8_000_000, 256
#: Pairs drawn to find out how often a table brings two vectors together, and the least similarity for which that is asked.
DRAWN, LEAST_AIM = 2000, 0.6


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast orthonormal Hadamard transform of each row; the width is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        pairs = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.float32(np.sqrt(d))


@lru_cache(maxsize=64)
def rotation(width: int, seed: int) -> np.ndarray:
    """Three rounds of random signs and Hadamard transform as one matrix; vectors of hundreds of entries are turned faster by it than step by step."""
    size = 1 << max(1, (width - 1).bit_length())
    rng = np.random.default_rng(seed)
    y = np.eye(size, dtype=np.float32)
    for _ in range(3):
        y = hadamard(y * rng.choice(np.array([-1, 1], np.float32), size))
    return y[:width]


def cross_polytope(x: np.ndarray, seed: int, best: int) -> tuple[np.ndarray, np.ndarray]:
    """The `best` nearest signed axes of each row after the pseudo-rotation, and their coordinates, falling. The axis against the sign is never among them."""
    y = x @ rotation(x.shape[1], seed)
    size = np.abs(y)
    best = min(best, size.shape[1])
    top = np.argpartition(-size, best - 1, axis=1)[:, :best] if best > 1 else size.argmax(axis=1)[:, None]
    value = np.take_along_axis(size, top, 1)
    order = np.argsort(-value, axis=1, kind="stable")
    top = np.take_along_axis(top, order, 1)
    return top + size.shape[1] * (np.take_along_axis(y, top, 1) < 0), np.take_along_axis(value, order, 1)


def buckets(x: np.ndarray, table: int, functions: int, probes: int) -> np.ndarray:
    """Bucket keys of each row in one table: its home, then the probes - 1 next by the loss of coordinates when one axis is exchanged."""
    per = max(2, min(probes, 32))
    axes, values = zip(*(cross_polytope(x, 1000 * table + f, per) for f in range(functions)))
    base = 2 << max(1, (x.shape[1] - 1).bit_length())
    home = sum(a[:, 0].astype(np.int64) * base**f for f, a in enumerate(axes))
    if probes > 1:
        loss = np.concatenate([v[:, :1] - v[:, 1:] for v in values], axis=1)
        other = np.concatenate([home[:, None] + (a[:, 1:].astype(np.int64) - a[:, :1]) * base**f for f, a in enumerate(axes)], axis=1)
        order = np.argsort(loss, axis=1, kind="stable")[:, : probes - 1]
        home = np.concatenate([home[:, None], np.take_along_axis(other, order, 1)], axis=1)
    return home.reshape(len(x), -1) + table * base**functions


@lru_cache(maxsize=64)
def tables_for(width: int, n: int, aim: float, recall: float, share: float) -> tuple[int, int, int]:
    """(tables, functions, probes) by which two of n vectors of cosine aim meet with probability recall, of those the ones that shuffle least.

    Functions grow with the logarithm of n, so that about MATES vectors share a bucket whatever n is. How often one table brings a pair together is measured
    on DRAWN random pairs. share: the part of the vectors that search; at 1 both of a pair do.
    """
    base = 2 << max(1, (width - 1).bit_length())
    functions = max(1, ceil(log(max(n / MATES, 1.0 + 1e-9)) / log(base)))
    rng = np.random.default_rng(5)
    x, z = rng.standard_normal((2, DRAWN, width)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = aim * x + np.sqrt(max(0.0, 1 - aim * aim)) * z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
    best = None
    for probes in (1, 2, 3, 4, 6, 8, 12, 16, 24, 32):
        hits = []
        for t in range(3):
            p, q = buckets(x, 500 + t, functions, probes), buckets(y, 500 + t, functions, probes)
            hit = (p == q[:, :1]).any(axis=1)
            hits.append((hit | (q == p[:, :1]).any(axis=1) if share == 1 else hit).mean())
        miss = min(max(1 - float(np.mean(hits)), 1e-3), 1 - 1e-3)
        tables = max(1, ceil(log(1 - recall) / log(miss)))
        cost = tables * (1 + (probes if share < 1 else probes - 1) * share)
        if best is None or cost < best[0]:
            best = cost, tables, probes
    return best[1], functions, best[2]


def usable_vectors(rows: DataFrame, ident: str, vector: str, found: str | None, latest: list[str], keep: list[str] | None = None, width: int = 64) -> DataFrame:
    """id, unit (array<double> of length one) and keep: each ident's last usable vector by the columns in latest.

    Null idents, and vectors that are null, of another length than width, all zero, hold a null, NaN or infinite entry or have found = false, are left out.
    """
    src = rows.filter(F.col(ident).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) == width))
    src = src.filter(F.col(found).isNull() | F.col(found)) if found else src
    src = src.select(F.col(ident).alias("id"), F.col(vector).alias("v"), *(F.col(c).alias(f"__k{n}") for n, c in enumerate(keep or [])), F.struct(*latest).alias("__last"))

    def firm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(_lengths(b.column("v"))[0] > 0))

    last = src.mapInArrow(firm, src.schema).groupBy("id").agg(F.max_by(F.struct("v", *(f"__k{n}" for n in range(len(keep or [])))), "__last").alias("x"))
    last = last.select("id", F.col("x.v").alias("v"), *(F.col(f"x.__k{n}").alias(c) for n, c in enumerate(keep or [])))
    schema = last.select("id", F.col("v").cast("array<double>").alias("unit"), *(keep or [])).schema

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                norm, values, at = _lengths(b.column("v"))
                unit = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values / np.repeat(norm, np.diff(at))))
                yield pa.RecordBatch.from_arrays([b.column("id"), unit, *(b.column(c) for c in keep or [])], names=schema.names)

    return last.mapInArrow(scale, schema)


def _lengths(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Euclidean length of each list (0 where an entry is null, NaN or infinite, or the length isn't finite), all values, and the lists' offsets in them."""
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    with np.errstate(all="ignore"):
        norm = np.sqrt(np.add.reduceat(np.append(values * values, 0.0), at[:-1]))
    return np.where(np.isfinite(norm), norm, 0.0), values, at


def copies(units: DataFrame, id_type: str) -> DataFrame:
    """id, class: the vectors that equal another to five digits (which tell no similarity apart, whatever their length was); the class is the least id of them.

    They are recognised by 128 bits of hash, so that none is ever taken for another.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.round(_matrix(b.column("unit")), 5) + 0.0
                yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(prints(x, seed)) for seed in (11, 12))], names=["id", "h1", "h2"])

    keyed = units.select("id", "unit").mapInArrow(run, f"id {id_type}, h1 bigint, h2 bigint")
    several = keyed.groupBy("h1", "h2").agg(F.min("id").alias("class"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return keyed.join(several, ["h1", "h2"]).select("id", "class")


def prints(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit fingerprint of each row, equal for equal rows."""
    odd = np.random.default_rng(seed).integers(1, 1 << 62, x.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    bits = np.ascontiguousarray(x, np.float64).view(np.uint64)
    with np.errstate(over="ignore"):
        mixed = (bits ^ (bits >> np.uint64(29))) * odd
        h = (mixed ^ (mixed >> np.uint64(32))).sum(axis=1, dtype=np.uint64)
    return h.view(np.int64)


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def _rounded(x: np.ndarray) -> np.ndarray:
    """Each row as bytes: its entries in eight bits, their unit, and the length of what rounding took from the vector."""
    unit = np.maximum(np.abs(x).max(axis=1), 1e-9) / 127
    q = np.round(x / unit[:, None]).astype(np.int8)
    lost = np.linalg.norm(x - q * unit[:, None], axis=1)
    return np.concatenate([q.view(np.uint8), np.stack([unit, lost], axis=1).astype(np.float32).view(np.uint8)], axis=1)


def _restored(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors, and the length of what each lost."""
    tail = np.ascontiguousarray(raw[:, -8:]).view(np.float32)
    return raw[:, :-8].view(np.int8).astype(np.float32) * tail[:, :1], tail[:, 1]


def _hashed(units: DataFrame, tables: int, functions: int, probes: int, everyone: bool, id_type: str) -> DataFrame:
    """bucket, role (0: row and column, 1: row, 3: probing column), id, vec: each vector in its homes and those that ask in their other probes (or all, unless everyone asks)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column("unit")).astype(np.float32)
            raw = _rounded(x)
            ask = np.flatnonzero(b.column("ask").to_numpy(zero_copy_only=False))
            for t in range(tables):
                home = buckets(x, t, functions, probes if everyone else 1)
                other = home[:, 1:] if everyone else buckets(x[ask], t, functions, probes)
                who = np.concatenate([np.arange(len(x)), np.repeat(ask, other.shape[1])])
                role = np.concatenate([np.full(len(x), 0 if everyone else 1, np.int8), np.full(other.size, 3, np.int8)])
                key = np.concatenate([home[:, 0], other.ravel()])
                vec = pa.FixedSizeBinaryArray.from_buffers(pa.binary(raw.shape[1]), len(who), [None, pa.py_buffer(np.ascontiguousarray(raw[who]))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(role), b.column("id").take(pa.array(who)), vec], names=["bucket", "role", "id", "vec"])

    return units.select("id", "unit", "ask").mapInArrow(run, f"bucket bigint, role tinyint, id {id_type}, vec binary")


def _blocked(hashed: DataFrame, everyone: bool, scratch: Scratch, name: str) -> DataFrame:
    """hashed sorted by bucket within partitions; buckets of over BLOCK rows or columns are cut into blocks, each pair of which is a bucket of its own."""
    blocks = lambda role: F.ceil(F.sum(F.col("role").isin(*role).cast("int")) / BLOCK).cast("int")
    sizes = hashed.groupBy("bucket").agg(blocks((0, 1)).alias("R"), blocks((0, 3) if everyone else (3,)).alias("C"))
    large = scratch.table(sizes.filter("R > 1 or C > 1").select("bucket", F.greatest("R", F.lit(1)).alias("R"), F.greatest("C", F.lit(1)).alias("C")), name)
    if large.limit(1).count():
        piece = lambda n: F.pmod(F.xxhash64("id"), F.col(n).cast("bigint")).cast("int")
        every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
        place = lambda r, c, role: F.struct(r.alias("r"), c.alias("c"), role.cast("tinyint").alias("role"))
        row = F.transform(every("C"), lambda c: place(piece("R"), c, F.lit(1)))
        column = F.transform(every("R"), lambda r: place(r, piece("C"), F.when(F.col("role") == 0, F.lit(2)).otherwise(F.lit(3))))
        where = F.when(F.col("R").isNull(), F.array(place(F.lit(0), F.lit(0), F.col("role")))).when(F.col("role") == 0, F.concat(row, column)).when(F.col("role") == 1, row).otherwise(column)
        spread = hashed.join(large, "bucket", "left").select("bucket", F.explode(where).alias("x"), "id", "vec")
        hashed = spread.select(F.when((F.col("x.r") == 0) & (F.col("x.c") == 0), F.col("bucket")).otherwise(F.xxhash64("bucket", "x.r", "x.c")).alias("bucket"), "x.role", "id", "vec")
    return hashed.repartition("bucket").sortWithinPartitions("bucket")


def _pairs(vecs: np.ndarray, lost: np.ndarray, role: np.ndarray, who: np.ndarray, k: int, least: float, everyone: bool, spare: int | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Places (row, column) of a bucket's candidates: among the k best of the row (if everyone asks) or of a probing column, or too near them to tell; None if those are over spare each."""
    rows, cols = np.flatnonzero(role <= 1), np.flatnonzero((role == 0) | (role >= 2))
    if not len(rows) or not len(cols):
        return np.empty(0, int), np.empty(0, int)
    other, asks, blur = vecs[cols].T, role[cols] == 3, 2 * float(lost.max()) + 1e-12
    found = [np.empty(0, int), np.empty(0, int), np.empty(0, vecs.dtype)]
    lead = _leading(vecs) if least >= LEAST_BOUNDED and spare is not None else None
    other_lead = lead[cols].T if lead is not None else None
    for at in range(0, len(rows), ROWS_COMPARED):
        part = rows[at : at + ROWS_COMPARED]
        if lead is not None:  # a bound from half of the entries rules out nearly all
            may = np.flatnonzero(lead[part] @ other_lead >= least - blur - 1e-5)
            if len(may) <= (k + SPARE) * (len(part) + len(cols)):
                r, c = np.divmod(may, len(cols))
                s = np.einsum("ij,ij->i", vecs[part[r]], vecs[cols[c]])
                ok = (s >= least - blur) & (who[part[r]] != who[cols[c]])
                found = [np.append(x, y) for x, y in zip(found, (part[r[ok]], c[ok], s[ok]))]
                continue
        sims = vecs[part] @ other
        near = sims >= least - blur
        if np.count_nonzero(near) > (k + SPARE) * (len(part) + len(cols)):
            sims[who[part][:, None] == who[cols][None, :]] = -2
            near &= sims > -2
            best = np.zeros_like(near)
            if everyone:
                best |= sims >= _kth(sims, k, 1) - blur
            best[:, asks] |= sims[:, asks] >= _kth(sims[:, asks], k, 0) - blur
            near &= best
        r, c = np.divmod(np.flatnonzero(near), len(cols))
        other_one = who[part[r]] != who[cols[c]]
        r, c = r[other_one], c[other_one]
        found = [np.append(x, y) for x, y in zip(found, (part[r], c, sims[r, c]))]
        if len(found[0]) > 2 * (k + SPARE) * (len(rows) + len(cols)):  # what is no longer among the best of its row or column goes
            keep = _among_best(found[0], found[2], k, blur) if everyone else np.zeros(len(found[0]), bool)
            probing = asks[found[1]]
            keep[probing] |= _among_best(found[1][probing], found[2][probing], k, blur)
            found = [x[keep] for x in found]
            if spare is not None and len(found[0]) > (k + spare) * (len(rows) + len(cols)):
                return None
    return found[0], cols[found[1]]


def _leading(vecs: np.ndarray) -> np.ndarray:
    """The first half of each vector's entries and the length of the rest: products of these are never below those of the vectors."""
    half = vecs.shape[1] // 2
    return np.concatenate([vecs[:, :half], np.linalg.norm(vecs[:, half:], axis=1, keepdims=True)], axis=1)


def _kth(sims: np.ndarray, k: int, axis: int) -> np.ndarray:
    """The k-th largest entry along an axis, the least one where there are fewer."""
    at = max(0, sims.shape[axis] - k)
    return np.take(np.partition(sims, at, axis=axis), [at], axis=axis)


def _among_best(group: np.ndarray, value: np.ndarray, k: int, blur: float) -> np.ndarray:
    """Whether each value is at least the k-th largest of its group less blur."""
    order = np.lexsort((-value, group))
    g, v = group[order], value[order]
    first = np.flatnonzero(np.diff(g, prepend=-1))
    size = np.diff(np.append(first, len(g)))
    kth = v[np.minimum(first + k, first + size) - 1]
    kth = np.where(size < k, -2.0, kth)
    out = np.zeros(len(group), bool)
    out[order] = v >= np.repeat(kth, size) - blur
    return out


def _solved(rows: DataFrame, id_type: str, k: int, least: float, everyone: bool, full: bool) -> DataFrame:
    """a, b: candidates of the buckets in rows; a null b with the bucket's key in place: a bucket whose rounded vectors don't tell the best apart."""

    def solve(t: pa.Table) -> pa.RecordBatch:
        bucket, role = t["bucket"].to_numpy(), t["role"].to_numpy()
        ids = t["id"].combine_chunks().dictionary_encode()
        ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
        who = ids.indices.to_numpy(zero_copy_only=False)
        data = _bytes_of(t["vec"])
        if full:
            vecs = data.view(np.float64).reshape(len(who), -1)
            lost = np.zeros(len(who))
        else:
            vecs, lost = _restored(data.reshape(len(who), -1))
        at = np.flatnonzero(np.diff(bucket, prepend=bucket[0] - 1))
        out, again = [], []
        for i, j in zip(at.tolist(), np.append(at[1:], len(who)).tolist()):
            if j - i > 1:
                got = _pairs(vecs[i:j], lost[i:j], role[i:j], who[i:j], k, least, everyone, None if full else SPARE)
                if got is None:
                    again.append(bucket[i])
                elif len(got[0]):
                    out.append(np.stack([who[i + got[0]], who[i + got[1]]]))
        pairs = np.concatenate(out, axis=1) if out else np.empty((2, 0), np.int64)
        n = len(ids.dictionary)
        pairs = np.unique(pairs.min(axis=0).astype(np.int64) * n + pairs.max(axis=0))
        none = pa.nulls(len(again), ids.dictionary.type)
        take = lambda x: pa.concat_arrays([ids.dictionary.take(pa.array(x)), none])
        return pa.RecordBatch.from_arrays([take(pairs // n), take(pairs % n), pa.concat_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(again, pa.int64())])], names=["a", "b", "again"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            n += b.column("vec").nbytes
            if n < BYTES_AT_ONCE:
                continue
            joined = pa.Table.from_batches(held)
            whole = int(np.searchsorted(joined["bucket"].to_numpy(), joined["bucket"][-1].as_py(), "left"))
            if whole:
                yield solve(joined.slice(0, whole))
            held = joined.slice(whole).combine_chunks().to_batches()
            n = 0 if whole else n // 2  # a bucket that goes on is not gathered again with every batch
        if held:
            yield solve(pa.Table.from_batches(held))

    return rows.mapInArrow(run, f"a {id_type}, b {id_type}, again bigint")


def _candidates(units: DataFrame, plan: tuple[int, int, int], k: int, least: float, everyone: bool, scratch: Scratch) -> DataFrame:
    """Distinct candidates (a, b), a < b, from units: id, unit, ask (whether it searches). everyone: all search, so home rows are compared as well."""
    id_type = dict(units.dtypes)["id"]
    hashed = scratch.table(_hashed(units, *plan, everyone, id_type), "hashed")
    blocked = _blocked(hashed, everyone, scratch, "large")
    found = scratch.table(_solved(blocked, id_type, k, least, everyone, False), "found")
    pairs = found.filter("again is null").select("a", "b")
    again = found.filter("again is not null").select(F.col("again").alias("bucket")).distinct()
    if again.limit(1).count():  # buckets of vectors that rounding makes alike
        exact = units.select("id", "unit").mapInArrow(_as_bytes, f"id {id_type}, full binary")
        crowded = blocked.join(again, "bucket", "left_semi").drop("vec").join(exact.withColumnRenamed("full", "vec"), "id")
        pairs = pairs.unionByName(_solved(crowded.select("bucket", "role", "id", "vec").repartition("bucket").sortWithinPartitions("bucket"), id_type, k, least, everyone, True).select("a", "b"))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _bytes_of(column: pa.ChunkedArray) -> np.ndarray:
    """The values of a binary column behind each other, without an object for each."""
    out = []
    for c in column.chunks:
        at = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]
        out.append(np.frombuffer(c.buffers()[2], np.uint8)[at[0] : at[-1]] if len(c) else np.empty(0, np.uint8))
    return np.concatenate(out)


def _as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            x = np.ascontiguousarray(_matrix(b.column("unit")))
            raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(x.shape[1] * 8), len(x), [None, pa.py_buffer(x)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("id"), raw], names=["id", "full"])


def nearest(rows: DataFrame, k: int, least: float = -1.0, queries: DataFrame | None = None, recall: float = 0.995, plan: tuple[int, int, int] | None = None) -> DataFrame:
    """The k most similar other vectors of each, or of those whose ids are in queries (a frame with a column id): id, other, similarity, rank.

    rows: id, unit, as from usable_vectors. Only pairs of cosine similarity >= least count. Copies are one class, hashed once; a class
    stands for its k + 1 least ids, which are the first in rank order (similarity falling, then id), so ties lose nothing. Buckets over BLOCK
    are compared block by block in separate tasks; none is cut. The loss is that of the hashing only: a pair of similarity least (or LEAST_AIM, if that is more) is
    missed with probability 1 - recall, a more similar one more rarely. plan: (tables, functions, probes) to use instead of tables_for. In buckets, vectors
    are rounded to eight bits; what that leaves undecided is kept, or compared again in full. Similarities are computed again from the full vectors.
    """
    scratch = Scratch(rows.sparkSession)
    units = scratch.table(rows.select("id", "unit"), "units")
    id_type = dict(units.dtypes)["id"]
    head = units.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("unit")).alias("w")).collect()[0]
    copy = scratch.table(copies(units, id_type), "copies")
    reps = units.join(copy.filter(F.col("id") != F.col("class")), "id", "left_anti")
    share = 1.0
    if queries is not None:
        wanted = queries.select("id").distinct()
        asks = wanted.join(copy, "id", "left").select(F.coalesce("class", "id").alias("id"), F.lit(True).alias("ask")).distinct()
        reps, share = reps.join(asks, "id", "left").na.fill(False, ["ask"]), 0.02
    else:
        reps = reps.withColumn("ask", F.lit(True))
    width = int(head["w"] or 1)
    plan = plan or tables_for(width, int(head["n"]), max(least, LEAST_AIM), recall, share)
    pairs = scratch.table(_candidates(reps, plan, k, least, queries is None, scratch), "pairs")
    left = units.select(F.col("id").alias("a"), F.col("unit").alias("ua"))
    right = units.select(F.col("id").alias("b"), F.col("unit").alias("ub"))
    dot = F.aggregate(F.zip_with("ua", "ub", lambda x, y: x * y), F.lit(0.0), lambda s, e: s + e)
    scored = scratch.table(pairs.join(left, "a").join(right, "b").select("a", "b", dot.alias("similarity")).filter(F.col("similarity") >= least), "scored")
    scored = scored.unionByName(scored.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))  # what one side found holds for the other
    if queries is not None:
        scored = scored.join(asks.select(F.col("id").alias("a")), "a", "left_semi")
    scored = scored.withColumn("__r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("similarity"), "b"))).filter(F.col("__r") <= k).drop("__r")
    shown = _least_ids(copy, k + 1).withColumnRenamed("id", "copy")
    other = scored.join(shown.withColumnRenamed("class", "b"), "b", "left").select("a", F.coalesce("copy", "b").alias("other"), "similarity")
    other = other.unionByName(shown.select(F.col("class").alias("a"), F.col("copy").alias("other"), F.lit(1.0).alias("similarity")))
    # All members of a class have the same list but for themselves, so it is ranked once per class.
    lists = other.withColumn("__r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("similarity"), "other"))).filter(F.col("__r") <= k + 1).drop("__r")
    lists = lists.withColumnRenamed("a", "class")
    member, parts = salted(copy, lists, ["class"], hot_keys(copy, ["class"]), ["id"])
    out = lists.join(copy.select("class").distinct(), "class", "left_anti").select(F.col("class").alias("id"), "other", "similarity")
    out = out.unionByName(member.join(parts, ["class", "__salt"]).select("id", "other", "similarity")).filter(F.col("id") != F.col("other"))
    out = out if queries is None else out.join(wanted, "id", "left_semi")
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "other"))).filter(F.col("rank") <= k)
    return out.select("id", "other", "similarity", "rank")


#: Asked vectors compared with all others at once.
ASKED_AT_ONCE = 4096


def exact_nearest(rows: DataFrame, k: int, queries: DataFrame) -> DataFrame:
    """id, other, similarity, rank: the k most similar other vectors of those in queries by comparing them with all, ASKED_AT_ONCE at once: what nearest() is measured against."""
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession)
    units = scratch.table(rows.select("id", "unit"), "units")
    id_type = dict(units.dtypes)["id"]
    asked = units.join(queries.select("id").distinct(), "id", "left_semi").orderBy("id")
    parts: list[DataFrame] = []

    def against(ids: list, vectors: list) -> DataFrame:
        shared = spark.sparkContext.broadcast((pa.array(ids), np.array(vectors, float)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, x = shared.value
            for b in batches:
                if not b.num_rows:
                    continue
                sims = x @ _matrix(b.column("unit")).T
                at = np.argpartition(-sims, min(k, sims.shape[1] - 1), axis=1)[:, : k + 1]  # the vector itself may be among them
                row = np.repeat(np.arange(len(x)), at.shape[1])
                yield pa.RecordBatch.from_arrays([names.take(pa.array(row)), b.column("id").take(pa.array(at.ravel())), pa.array(sims[row, at.ravel()])], names=["id", "other", "similarity"])

        return units.mapInArrow(run, f"id {id_type}, other {id_type}, similarity double")

    ids, vectors = [], []
    for r in asked.toLocalIterator():
        ids.append(r["id"])
        vectors.append(r["unit"])
        if len(ids) == ASKED_AT_ONCE:
            parts.append(against(ids, vectors))
            ids, vectors = [], []
    if ids:
        parts.append(against(ids, vectors))
    found = spark.createDataFrame([], f"id {id_type}, other {id_type}, similarity double")
    for p in parts:
        found = found.unionByName(p)
    found = found.filter(F.col("id") != F.col("other"))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "other"))).filter(F.col("rank") <= k)


def _least_ids(member: DataFrame, n: int) -> DataFrame:
    """class, id: the n least ids of each class; rows of a hot class are thinned in pieces first."""
    piece = member.withColumn("__p", F.pmod(F.xxhash64("id"), F.lit(64)))
    first = piece.withColumn("__r", F.row_number().over(Window.partitionBy("class", "__p").orderBy("id"))).filter(F.col("__r") <= n).drop("__r", "__p")
    return first.withColumn("__r", F.row_number().over(Window.partitionBy("class").orderBy("id"))).filter(F.col("__r") <= n).drop("__r")
