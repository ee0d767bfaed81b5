"""Evaluation passages in training text: latent semantic retrieval of passages, then longest-common-subsequence and answer checks."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..runtime import Scratch

#: Words of a window, of passages and of documents; and the step between windows of a document.
WINDOW, STEP = 12, 3
#: Latent dimensions (fewer where they keep ENERGY of the windows' squares), oversampling and power iterations of the randomised SVD.
RANK, ENERGY, OVERSAMPLE, POWERS = 256, 0.95, 16, 2
#: Least cosine of a window of a document and one of a passage in latent space, and least share of the document's window that lies in that space.
LEAST_COSINE, LEAST_KEPT = 0.5, 0.25
#: A window of a document is looked up if so many of its words are words of passages.
LEAST_KNOWN = 8
#: Windows compared at once, words of documents looked up at once, and words of a document aligned at once.
WINDOWS_AT_ONCE, WORDS_AT_ONCE, RANGE_WORDS = 4096, 200_000, 2000
#: Passages and ranges aligned at once, and flags of their words held at once.
PAIRS_AT_ONCE, MARKS_AT_ONCE = 256, 20_000_000
#: Words of passages in a block; further ones in further blocks over the same documents. It bounds the index that is broadcast.
BLOCK_WORDS = 50_000
#: A stretch is a leak from so many words of the passage on end, of which that share is equal in the document: one word in four may be changed.
LEAST_SPAN, LEAST_SHARE = 12, 0.75
#: Share of a stretch's answers, by weight, that the document must hold.
LEAST_ANSWERS = 0.6
#: A word's answer weight is the information in it for who knows the words up to REACH before and after it in other passages; a word is shared wording if they
#: tell it for sure. Weights end at -log(LEAST_CHANCE), and SHARED_RUN such words on end don't count as words of the passage.
REACH, LEAST_CHANCE, SHARED_RUN = 4, 0.01, 8
#: A stretch with fewer equal words is not looked at; its ends may then be extended over a changed word.
LEAST_CORE = 7

#: Cyrillic and Greek letters that look like Latin ones.
_LOOKALIKES = str.maketrans("аеорсухікѕјԁһӏвнмтαορνικτυχ", "aeopcyxiksjdhlbhmtaopviktux")
_INVISIBLE = re.compile("[­؜᠎​-‏‪-‮⁠-⁯﻿￹-￻]")
_MARKS = re.compile(r"</?[A-Za-z][^<>\n]{0,60}>|&[a-z]+;|[*`~]+")
_QUOTED = re.compile(r"\n[ \t]*(?:>[ \t]?)+")
_BROKEN = re.compile(r"[-‐‑](?<=[^\W\d_][-‐‑])[ \t]*\r?\n[ \t>]*(?=[^\W\d_])")
_JOINED = re.compile(r"[-‐‑.,'’](?<=[^\W_][-‐‑.,'’])(?=[^\W_])")
_ACCENTS = re.compile("[̀-ͯ҃-҉᪰-᫿᷀-᷿⃐-⃿︠-︯]")
_HAN = re.compile("[㐀-鿿豈-﫿\U00020000-\U0003ffff]")
#: Stands between texts; it is a word of its own.
_BETWEEN = "\x1e"
_TOKEN = re.compile(rf"[^\W_]+|{_BETWEEN}")
#: Words whose numbers are remembered, besides the vocabulary.
WORDS_KEPT = 200_000


def _words(texts: list[str | None]) -> list[str]:
    """Words of all texts, with _BETWEEN between texts: without layout, letter case, marks, punctuation, accents and invisible characters; each Han character is a word."""
    text = "\n" + f"\n{_BETWEEN}\n".join((t or "").replace(_BETWEEN, " ") for t in texts)
    text = _QUOTED.sub("\n", _MARKS.sub("", text))
    plain = text.isascii()
    text = _BROKEN.sub("", text if plain else _INVISIBLE.sub("", text))
    if not plain:
        text = _HAN.sub(r" \g<0> ", _ACCENTS.sub("", unicodedata.normalize("NFKD", text)))
    return _TOKEN.findall(_JOINED.sub("", text.lower()))


def _plain(word: str) -> str:
    """A word that mixes Latin with letters that look like them is Latin."""
    if not word.isascii() and any("a" <= c <= "z" for c in word):
        return word.translate(_LOOKALIKES)
    return word


def plain_words(text: str | None) -> list[str]:
    """Words of a text as they are compared."""
    return [_plain(w) for w in _words([text])]


class Codes(dict):
    """Numbers of words: those of a vocabulary, its size for every other word, -1 between texts."""

    def __init__(self, vocabulary: dict[str, int]) -> None:
        super().__init__(vocabulary)
        self.vocabulary = vocabulary
        self[_BETWEEN] = -1

    def __missing__(self, word: str) -> int:
        got = self.vocabulary.get(_plain(word), len(self.vocabulary))
        if len(self) < len(self.vocabulary) + WORDS_KEPT:
            self[word] = got
        return got

    def of_texts(self, texts: list[str | None]) -> list[np.ndarray]:
        words = _words(texts)
        ids = np.fromiter(map(self.__getitem__, words), np.int32, len(words))
        at = np.flatnonzero(ids < 0)
        return [ids[i:j] for i, j in zip(np.append(0, at + 1), np.append(at, len(ids)))] if texts else []


def windows_of(n: int, step: int) -> np.ndarray:
    """Starts of the windows over n words; texts of up to WINDOW words have one of their own length."""
    if n <= WINDOW:
        return np.zeros(min(n, 1), np.int64)
    starts = np.arange(0, n - WINDOW + 1, step)
    return starts if starts[-1] == n - WINDOW else np.append(starts, n - WINDOW)


def randomised_svd(rows: DataFrame, width: int, rank: int, expand=lambda idx, val: [(idx, val)], seed: int = 0) -> tuple[np.ndarray, np.ndarray, float]:
    """Right singular vectors (width x rank), singular values and the sum of squares of the sparse matrix in rows (idx array<int>, val array<double>).

    Partitions send their part of A'(A X) for a random block X, the driver sums and orthonormalises it, POWERS + 1 times; width and rank
    are bounded by the caller, the number of rows is not. expand: the matrix's rows (idx, val) for one row of the frame.
    """
    x = np.random.default_rng(seed).standard_normal((width, rank))

    def gram(basis: np.ndarray) -> tuple[np.ndarray, float]:
        shared = rows.sparkSession.sparkContext.broadcast(basis)

        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            b, total, squares = shared.value, None, 0.0
            for pdf in batches:
                total = np.zeros_like(b) if total is None else total
                for row in zip(pdf["idx"], pdf["val"]):
                    for idx, val in expand(*row):
                        total[idx] += np.outer(val, val @ b[idx])
                        squares += float(val @ val)
            if total is not None:
                at = np.flatnonzero(np.abs(total).sum(axis=1))
                yield pd.DataFrame({"at": [at.astype(np.int32).tobytes()], "m": [total[at].tobytes()], "squares": [squares]})

        total, squares = np.zeros_like(basis), 0.0
        for r in rows.mapInPandas(part, "at binary, m binary, squares double").toLocalIterator():
            at = np.frombuffer(r["at"], np.int32)
            total[at] += np.frombuffer(r["m"], float).reshape(len(at), -1)
            squares += r["squares"]
        shared.unpersist()
        return total, squares

    for _ in range(POWERS + 1):
        x = np.linalg.qr(gram(x)[0])[0]
    product, squares = gram(x)
    small = x.T @ product
    values, turn = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-values)
    return x @ turn[:, order], np.sqrt(np.maximum(values[order], 0)), squares


def align(a: list[np.ndarray], b: list[np.ndarray]) -> list[tuple[int, int, int, int, np.ndarray]]:
    """Best local alignment of each a (word ids of a passage) with its b: (start, end) in a, (start, end) in b, places in a of the equal words; a match counts 1, any other step -1.

    Pairs are padded and solved together, a row of all their tables at a time; ids must not be negative in a, and match nothing where they are in b.
    """
    count, n, m = len(a), max(map(len, a)), max(map(len, b))
    x, y = np.full((count, n), -2, np.int32), np.full((count, m), -3, np.int32)
    for k, (p, q) in enumerate(zip(a, b)):
        x[k, : len(p)], y[k, : len(q)] = p, q
    score = np.zeros((n + 1, count, m + 1), np.int16)
    ramp = np.arange(m + 1, dtype=np.int16)
    for i in range(1, n + 1):
        row, last = score[i], score[i - 1]
        step = np.where(y == x[:, i - 1, None], np.int16(1), np.int16(-1))
        np.maximum(last[:, :-1] + step, last[:, 1:] - 1, out=row[:, 1:])
        np.maximum(row, 0, out=row)
        row += ramp
        np.maximum.accumulate(row, axis=1, out=row)
        row -= ramp
    top = score.transpose(1, 0, 2).reshape(count, -1).argmax(axis=1)
    i, j = top // (m + 1), top % (m + 1)
    end_i, end_j, equal, each = i.copy(), j.copy(), np.zeros((count, n), bool), np.arange(count)
    while True:
        here = score[i, each, j]
        go = (here > 0) & (i > 0) & (j > 0)
        if not go.any():
            break
        up, left = np.maximum(i - 1, 0), np.maximum(j - 1, 0)
        cross = score[up, each, left]
        same = go & (x[each, up] == y[each, left]) & (here == cross + 1)
        slant = same | (go & (here == cross - 1))
        down = go & ~slant & (here == score[up, each, j] - 1)
        equal[each[same], up[same]] = True
        i, j = np.where(slant | down, up, i), np.where(slant | (go & ~down), left, j)
    return [(int(i[k]), int(end_i[k]), int(j[k]), int(end_j[k]), np.flatnonzero(equal[k])) for k in range(count)]


def extend(a: np.ndarray, b: np.ndarray, found: tuple[int, int, int, int, np.ndarray]) -> tuple[int, int, np.ndarray]:
    """(start, end, equal places) in a of the alignment found, carried on at both ends over single changed words behind which the next words are equal again; there its score stood still."""
    i, end_i, j, end_j, equal = found
    more = []
    while i >= 2 and j >= 2 and a[i - 2] == b[j - 2]:
        i, j = i - 2, j - 2
        more.append(i)
    while end_i + 2 <= len(a) and end_j + 2 <= len(b) and a[end_i + 1] == b[end_j + 1]:
        more.append(end_i + 1)
        end_i, end_j = end_i + 2, end_j + 2
    return i, end_i, np.append(equal, np.array(more, int))


class Index:
    """Latent vectors of words and of the windows of passages, and the passages' words with their answer weights."""

    def __init__(self, items: list, ids: list[np.ndarray], weights: list[np.ndarray], idf: np.ndarray, unknown: float, basis: np.ndarray) -> None:
        """items: their keys; ids: of each the numbers of its words; weights: of each word; idf of the vocabulary, and of an unknown word; basis: words x latent axes."""
        self.items, self.ids, self.weights, self.size = items, ids, weights, len(idf)
        self.idf = np.append(idf, unknown).astype(np.float32)
        self.word = np.concatenate([basis * idf[:, None], np.zeros((1, basis.shape[1]))]).astype(np.float32)
        self.shared = [self._runs(w <= 0) for w in weights]
        self.length = np.array([len(x) for x in ids], int)
        rows, first = [], []
        for own in ids:
            first.append(len(rows))
            rows += [self.word[own[i : i + WINDOW]].sum(axis=0) for i in windows_of(len(own), 1)]
        window = np.array(rows, np.float32).reshape(-1, basis.shape[1])
        self.window, self.first = window / np.maximum(np.linalg.norm(window, axis=1, keepdims=True), 1e-9), np.array(first, int)

    @staticmethod
    def _runs(flags: np.ndarray) -> np.ndarray:
        """Places in runs of SHARED_RUN flagged words or more."""
        ends = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
        out = np.zeros(len(flags), bool)
        for i, j in zip(ends[::2], ends[1::2]):
            out[i:j] = j - i >= SHARED_RUN
        return out

    def candidates(self, texts: list[np.ndarray]) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, start, end): ranges of texts in and around which windows reach LEAST_COSINE with one of the item's.

        A range reaches as far as the passage is long to both sides; ranges that meet are one, and one over RANGE_WORDS is cut into pieces that overlap by two
        passages, which no stretch exceeds, so a text of any length is aligned piece by piece.
        """
        if not len(self.items) or not texts:
            return
        sizes = np.array([len(t) for t in texts])
        base = np.concatenate([[0], sizes.cumsum()[:-1]])
        ids = np.concatenate([*texts, np.full(WINDOW, self.size)])  # words behind the end count as unknown and weigh nothing
        starts = [windows_of(n, STEP) + b for n, b in zip(sizes.tolist(), base.tolist())]
        text = np.repeat(np.arange(len(texts)), [len(s) for s in starts])
        starts = np.concatenate(starts)
        length = np.minimum(WINDOW, sizes[text])
        known = np.concatenate([[0], (ids < self.size).cumsum()])
        near = known[starts + length] - known[starts] >= np.minimum(LEAST_KNOWN, length)
        text, starts, length = text[near], starts[near], length[near]
        square = self.idf.astype(float) ** 2
        total = np.concatenate([[0], square[ids].cumsum()])
        hits: list[np.ndarray] = []
        for at in range(0, len(starts), WINDOWS_AT_ONCE):
            s, n = starts[at : at + WINDOWS_AT_ONCE], length[at : at + WINDOWS_AT_ONCE]
            z = np.zeros((len(s), self.word.shape[1]), np.float32)
            for k in range(WINDOW):
                z += self.word[np.where(k < n, ids[s + k], self.size)]
            norm = np.linalg.norm(z, axis=1)
            ok = np.flatnonzero((norm >= LEAST_KEPT * np.sqrt(total[s + n] - total[s])) & (norm > 0))
            sims = np.maximum.reduceat((z[ok] / norm[ok, None]) @ self.window.T, self.first, axis=1) if len(ok) else np.empty((0, len(self.items)))
            w, k = np.nonzero(sims >= LEAST_COSINE)
            hits.append(np.stack([text[at + ok[w]], k, s[ok[w]], s[ok[w]] + n[ok[w]]], axis=1))
        if not hits:
            return
        found = np.concatenate(hits)
        found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
        reach = self.length[found[:, 1]]
        low = np.maximum(found[:, 2] - reach, base[found[:, 0]])
        high = np.minimum(found[:, 3] + reach, base[found[:, 0]] + sizes[found[:, 0]])
        cut = np.flatnonzero((np.diff(found[:, 0], prepend=-1) != 0) | (np.diff(found[:, 1], prepend=-1) != 0) | (low > np.concatenate([[-1], high[:-1]])))
        for c, d in zip(cut.tolist(), np.append(cut[1:], len(found)).tolist()):
            t, k = int(found[c, 0]), int(found[c, 1])
            i, j, r = int(low[c] - base[t]), int(high[d - 1] - base[t]), len(self.ids[k])
            step = max(RANGE_WORDS - 2 * r, r)
            for s in range(i, max(i + 1, j - 2 * r), step):
                yield t, k, s, min(j, s + step + 2 * r)

    def _may_hold(self, k: np.ndarray, there: list[np.ndarray]) -> np.ndarray:
        """Of items k and ranges there: whether LEAST_SPAN words of the passage on end have enough equal words, in any order, and most of the answers they need."""
        out = np.zeros(len(k), bool)
        step = max(1, MARKS_AT_ONCE // (self.size + 1))
        for at in range(0, len(k), step):
            part, words = k[at : at + step], there[at : at + step]
            mark = np.zeros((len(part), self.size + 1), bool)
            flat = np.concatenate(words)
            mark[np.repeat(np.arange(len(part)), [len(w) for w in words])[flat >= 0], flat[flat >= 0]] = True
            sizes = self.length[part]
            first = np.concatenate([[0], sizes.cumsum()[:-1]])
            own = np.concatenate([self.ids[x] for x in part])
            weight = np.concatenate([self.weights[x] for x in part])
            here = mark[np.repeat(np.arange(len(part)), sizes), own]
            runs = np.concatenate([np.zeros((1, 3)), np.cumsum(np.stack([here, here * weight, weight], axis=1), axis=0)])
            n = np.minimum(LEAST_SPAN, sizes)
            owner = np.repeat(np.arange(len(part)), sizes - n + 1)
            start = np.arange(len(owner)) - np.repeat(np.concatenate([[0], (sizes - n + 1).cumsum()[:-1]]), sizes - n + 1) + first[owner]
            count, have, all_ = (runs[start + n[owner]] - runs[start]).T
            # The words at the ends may be changed ones, and a longer stretch may hold its answers elsewhere.
            ok = (count >= LEAST_SHARE * n[owner] - 1) & (have >= 0.75 * LEAST_ANSWERS * all_)
            out[at + np.unique(owner[ok])] = True
        return out

    def leaks(self, texts: list[np.ndarray]) -> list[tuple[int, int, int, int, float]]:
        """(text, item, span, equal, answers) for each aligned stretch of the texts, several to an item.

        span: the stretch's words outside shared wording; equal: those of them that the text has in that order; answers: their share by weight (0: no word weighs anything).
        """
        out: list[tuple[int, int, int, int, float]] = []
        todo = []
        for t, k, i, j in self.candidates(texts):
            there = texts[t][i:j].copy()
            there[there == self.size] = -1
            todo.append((t, k, there))
        while todo:  # a lesser stretch may be the leak where a longer one only shares a pattern, so what is aligned is taken out and the rest looked at again
            ok = self._may_hold(np.array([x[1] for x in todo]), [x[2] for x in todo])
            todo = sorted((x for x, good in zip(todo, ok.tolist()) if good), key=lambda x: len(x[2]))
            again = []
            for at in range(0, len(todo), PAIRS_AT_ONCE):
                part = todo[at : at + PAIRS_AT_ONCE]
                for (t, k, there), found in zip(part, align([self.ids[x[1]] for x in part], [x[2] for x in part])):
                    if len(found[4]) >= LEAST_CORE:
                        out.append((t, k, *self._judged(k, there, found)))
                        there[found[2] : found[3]] = -1
                        again.append((t, k, there))
            todo = again
        return out

    def _judged(self, k: int, there: np.ndarray, found: tuple[int, int, int, int, np.ndarray]) -> tuple[int, int, float]:
        own, weight, shared = self.ids[k], self.weights[k], self.shared[k]
        a0, a1, equal = extend(own, there, found)
        span, room = int((~shared[a0:a1]).sum()), int(a0 > 0) + int(a1 < len(own))
        if span < LEAST_SPAN <= span + room:  # the words at its ends may be changed ones
            span = LEAST_SPAN
        total = float(weight[a0:a1].sum())
        return span, int((~shared[equal]).sum()), float(weight[equal].sum()) / total if total else 0.0


def answer_weights(items: DataFrame, item: str, words: str) -> DataFrame:
    """item, words and weights (array<double>): the information in each word of a passage for who knows other passages.

    For the words up to REACH before and after it, the share of the other passages holding that word which have this one at the same distance is
    taken; of the greatest share the negative logarithm is the weight, at most -log(LEAST_CHANCE). So a word that other passages tell for sure weighs
    nothing, and one that stands in all passages of a pattern little. Equal passages are one. Counts cover all items.
    """
    texts = items.select(F.col(words).alias("w")).distinct().withColumn("p", F.xxhash64(F.concat_ws(" ", "w")))
    places = texts.select("p", F.posexplode("w").alias("at", "word"), "w")
    near = F.explode(F.array(*(F.struct(F.lit(d).alias("d"), F.get("w", F.col("at") + d).alias("other")) for d in range(-REACH, REACH + 1) if d)))
    pairs = places.select("p", "at", "word", near.alias("x")).filter("x.other is not null").select("p", "at", "word", "x.d", "x.other")
    both = pairs.groupBy("d", "other", "word").agg(F.count_distinct("p").alias("n_both"))
    context = pairs.groupBy("d", "other").agg(F.count_distinct("p").alias("n"))
    share = F.when(F.col("n") > 1, (F.col("n_both") - 1) / (F.col("n") - 1)).otherwise(0.0)
    told = pairs.join(both, ["d", "other", "word"]).join(context, ["d", "other"]).groupBy("p", "at").agg(F.max(share).alias("told"))
    weighed = places.select("p", "at").join(told, ["p", "at"], "left").select("p", "at", (-F.log(F.greatest(F.coalesce("told", F.lit(0.0)), F.lit(LEAST_CHANCE)))).alias("weight"))
    lists = weighed.groupBy("p").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "weight"))), lambda x: x["weight"]).alias("weights"))
    keyed = items.select(F.col(item).alias("item"), F.col(words).alias("words")).withColumn("p", F.xxhash64(F.concat_ws(" ", "words")))
    return keyed.join(lists, "p").select("item", "words", "weights")


def _coded(docs: DataFrame, vocabulary: dict[str, int], kind: str) -> DataFrame:
    """id, words: the documents' words as numbers, each text cut into words once; those without LEAST_KNOWN words of the vocabulary are left out.

    Each task adds a row without id: numbers of words and in how many of its documents they occur, in turn, with that of all documents under the vocabulary's size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, size = Codes(shared.value), len(shared.value)
        seen, no_id = np.zeros(size + 1, np.int64), None
        for b in batches:
            texts, no_id = b.column("text").to_pylist(), pa.nulls(1, b.schema.field("id").type)
            for i, j in portions(texts):
                ids = codes.of_texts(texts[i:j])
                owner = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
                flat = np.concatenate(ids).astype(np.int64)
                known = flat < size
                seen += np.bincount(np.unique(owner[known] * (size + 1) + flat[known]) % (size + 1), minlength=size + 1)
                seen[size] += j - i
                keep = np.flatnonzero(np.bincount(owner[known], minlength=len(ids)) >= LEAST_KNOWN)
                lists = [ids[k] for k in keep]
                at = np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(keep + i)), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([*lists, np.empty(0, np.int32)])))], names=["id", "words"])
        if no_id is not None:
            at = np.flatnonzero(seen)
            flat = np.stack([at, seen[at]], axis=1).ravel().astype(np.int32)
            yield pa.RecordBatch.from_arrays([no_id, pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), pa.array(flat))], names=["id", "words"])

    return docs.mapInArrow(run, f"id {kind}, words array<int>")


def portions(texts: list[str | None], chars: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many characters; a longer text is one of its own."""
    at, n = 0, 0
    for k, t in enumerate(texts):
        if n and n + len(t or "") > chars:
            yield at, k
            at, n = k, 0
        n += len(t or "")
    if at < len(texts):
        yield at, len(texts)


def build_index(coded: DataFrame, items: list[tuple], vocabulary: dict[str, int]) -> Index:
    """The index of a block of items (key, words, weights): idf over all documents, a basis by the randomised SVD of the TF-IDF windows."""
    spark = coded.sparkSession
    pair = F.explode(F.transform(F.sequence(F.lit(0), (F.size("words") / 2 - 1).cast("int")), lambda k: F.struct(F.get("words", (2 * k).cast("int")).alias("w"), F.get("words", (2 * k + 1).cast("int")).alias("n"))))
    counts = np.zeros(len(vocabulary) + 1)
    for r in coded.filter("id is null").select(pair.alias("x")).groupBy("x.w").agg(F.sum("x.n").alias("n")).collect():  # at most the vocabulary
        counts[r["w"]] = r["n"]
    idf = np.maximum(np.log((counts[-1] + 1) / (counts[:-1] + 0.5)), 0.05)
    ids = [np.array([vocabulary[w] for w in ws], np.int32) for _, ws, _ in items]

    def windows(own: np.ndarray, val: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for i in windows_of(len(own), STEP):
            at, times = np.unique(own[i : i + WINDOW], return_counts=True)
            yield at, times * idf[at]

    frame = spark.createDataFrame(pd.DataFrame({"idx": [x.tolist() for x in ids], "val": [[]] * len(ids)}), "idx array<int>, val array<double>")
    rank = min(RANK + OVERSAMPLE, len(vocabulary), sum(len(windows_of(len(x), STEP)) for x in ids))
    basis, values, squares = randomised_svd(frame.repartition(max(1, min(64, sum(map(len, ids)) // 5000))), len(vocabulary), rank, windows)
    enough = int(np.searchsorted(np.cumsum(values**2), ENERGY * squares)) + 1
    return Index([i for i, _, _ in items], ids, [np.array(w) for _, _, w in items], idf, float(np.median(idf)), basis[:, : min(enough, RANK, rank)])


def is_leak():
    """The condition on leaked_items' columns that makes a stretch a leak."""
    return (F.col("span") >= LEAST_SPAN) & (F.col("equal") >= LEAST_SHARE * F.col("span")) & (F.col("answers") >= LEAST_ANSWERS)


def leaked_items(docs: DataFrame, ident: str, text: str, items: DataFrame, item: str, passage: str) -> DataFrame:
    """ident, item, span, equal, answers: documents that hold a stretch of an item's passage, and how much of it.

    span: words of the passage in the best aligned stretch, without runs of wording that other passages share; equal: those the document has in that order (the
    stretch's longest common subsequence); answers: the share of the stretch's answers it holds, words by the information in them (answer_weights). Stretches of
    candidates are returned; is_leak() picks those that are leaks.
    Documents are cut into words once for BLOCK_WORDS words of passages; windows of theirs that hold enough words of passages are compared with the
    passages' windows in latent space. Documents are never joined or shuffled. Null texts, null passages and passages under LEAST_SPAN words leak nowhere; equal
    passages are all reported; repeated rows count once.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    types = dict(docs.dtypes)[ident], dict(items.dtypes)[item]
    schema = f"{ident} {types[0]}, {item} {types[1]}, span int, equal int, answers double"
    rows = docs.select(F.col(ident).alias("id"), F.col(text).alias("text")).filter("id is not null and text is not null")

    @F.pandas_udf("array<string>")
    def cut(passages: pd.Series) -> pd.Series:
        return passages.map(plain_words)

    known = items.select(F.col(item).alias("item"), F.col(passage).alias("p")).dropna().distinct().select("item", cut("p").alias("words")).filter(F.size("words") >= LEAST_SPAN)
    weighed = scratch.table(answer_weights(scratch.table(known, "items"), "item", "words"), "weighed")
    item_type = to_arrow_type(weighed.schema["item"].dataType)
    parts, block, held = [], [], 0

    def matched(block: list[tuple]) -> DataFrame:
        name = f"words{len(parts)}"
        vocabulary = {w: k for k, w in enumerate(sorted({w for _, ws, _ in block for w in ws}))}
        coded = scratch.table(_coded(rows, vocabulary, types[0]), name)
        shared = spark.sparkContext.broadcast(build_index(coded, block, vocabulary))  # BLOCK_WORDS bounds it

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
            index = shared.value
            for b in batches:
                at = np.asarray(b.column("words").offsets)
                flat = np.asarray(b.column("words").values)
                ids, first = b.column("id"), 0
                while first < len(ids):
                    last = max(first + 1, int(np.searchsorted(at, at[first] + WORDS_AT_ONCE, "right")) - 1)
                    got = index.leaks([flat[at[k] : at[k + 1]] for k in range(first, last)])
                    if got:
                        t, k, span, equal, answers = zip(*got)
                        yield pa.RecordBatch.from_arrays(
                            [ids.take(pa.array([first + x for x in t])), pa.array([index.items[x] for x in k], item_type), pa.array(span, pa.int32()), pa.array(equal, pa.int32()), pa.array(answers, pa.float64())], names=[ident, item, "span", "equal", "answers"]
                        )
                    first = last

        return coded.filter("id is not null").mapInArrow(run, schema)

    for r in weighed.orderBy("item").toLocalIterator():
        block.append((r["item"], r["words"], r["weights"]))
        held += len(r["words"])
        if held >= BLOCK_WORDS:
            parts.append(matched(block))
            block, held = [], 0
    if block:
        parts.append(matched(block))
    found = reduce(DataFrame.unionByName, parts, spark.createDataFrame([], schema))
    return found.groupBy(ident, item).agg(F.max_by(F.struct("span", "equal", "answers"), F.struct(is_leak(), "equal")).alias("x")).select(ident, item, "x.*")
