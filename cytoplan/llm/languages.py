"""Languages of documents and of their segments: words first, then shorter and shorter character n-grams."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import Scratch

#: Language codes with the spellings that labels use for them (ISO 639-1, 639-2/3, English and own names).
SPELLINGS = {
    "en": ("en", "eng", "english"),
    "de": ("de", "deu", "ger", "german", "deutsch"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais"),
    "es": ("es", "spa", "spanish", "español", "espanol", "castellano"),
    "pt": ("pt", "por", "portuguese", "português", "portugues"),
    "it": ("it", "ita", "italian", "italiano"),
    "nl": ("nl", "nld", "dut", "dutch", "nederlands"),
    "ru": ("ru", "rus", "russian", "русский"),
    "zh": ("zh", "zho", "chi", "cmn", "chinese", "中文", "汉语"),
}

#: Further labels of two or three letters are languages of their own from this share of the labelled documents; these name none (fixed values).
LEAST_SUPPORT, NO_LANGUAGE = 0.005, ("und", "mul", "zxx", "mis", "unk", "na", "nan", "xx", "xxx")
#: Labelled documents the model is fitted on, about; the sample is drawn by a hash of the id. Everything else reads all documents.
FIT_DOCUMENTS = 20_000
#: Entries kept per language and length of n-gram (and for words), the most frequent ones of the sample.
FIT_ENTRIES = 30_000
#: Longest character n-gram.
LONGEST = 5
#: Least words (of letters) in a whole sentence, or least Han characters.
LEAST_WORDS, LEAST_HAN = 4, 6
#: Weight, in words or n-grams, of the frequency over all languages in that of each; a language with little text stays near it.
PRIOR = 300.0
#: Least confidence at which a sentence has a language.
LEAST_CONFIDENCE = 0.9
#: Characters of texts that are cut into segments at once, and tokens whose scores are remembered.
CHARS_AT_ONCE, TOKENS_KEPT = 1_000_000, 300_000
#: Most words in a field of a table's row.
FIELD_WORDS = 4

_WORD = regex.compile(r"\p{Han}|[\p{L}\p{M}]+")
_HAN = re.compile("[㐀-鿿]")
_INVISIBLE = re.compile("[­​-‍⁠﻿]")
_MARKUP = re.compile(r"<[^<>\n]{1,40}>|\*\*")
_LOG = re.compile(r"(?<!\S)(?:\S+=\S+[ \t]*){2,}[^\n]*")
_LINE = re.compile(r"^(?:\[[^\]\n]*\d[^\]\n]*\][^\n]*=|[ \t]*#+[ \t]|[ \t]*\|[^\n]*\|[ \t]*\r?$)[^\n]*", re.MULTILINE)
_TABBED = re.compile(r"^[^\n\t]*\t[^\n\t]*\t[^\n]*(?:\n[^\n\t]*\t[^\n\t]*\t[^\n]*)+", re.MULTILINE)
_STOP = re.compile(r"[.!?…]['\"»”’)\]]*(?=\s)|[。！？]['\"»”’)\]]*")
_BREAK = re.compile(r"\n[ \t>\r]*\n")
_QUOTES, _STOPS = "'\"»”’)]", tuple(".!?…。！？")
_BETWEEN = "\n\n"


def label_language(c: str | Column, further: Sequence[str] | None = ()) -> Column:
    """The language a label names, null if it names none: letter case, blanks and regions after - or _ don't matter.

    further: codes that are languages besides those of SPELLINGS; None: every code of two or three letters that NO_LANGUAGE lacks.
    """
    c = F.col(c) if isinstance(c, str) else c
    base = F.split(F.lower(F.trim(c)), "[-_]")[0]
    if further is None:
        out = F.when(base.rlike("^[a-z]{2,3}$") & ~base.isin(*NO_LANGUAGE), base)
    else:
        out = F.when(base.isin(*further), base) if further else F.lit(None).cast("string")
    for lang, names in SPELLINGS.items():
        out = F.when(base.isin(*names), F.lit(lang)).otherwise(out)
    return out


def words_of(token: str) -> list[str]:
    """Lower-case words of a token (a text without blanks): none if it holds a digit (a code or number) and no Han character, each of which is a word."""
    if token.isalpha() and token.isascii():
        return [token.lower()]
    if not token.isascii():
        token = _INVISIBLE.sub("", token)
        if _HAN.search(token):
            return _WORD.findall(token.lower())
    return [] if any(map(str.isdigit, token)) else _WORD.findall(token.lower())


def _tables(text: str) -> Iterator[tuple[int, int]]:
    """Spans of tables: neighbouring lines of as many tabs each, whose fields have few words and end no sentence. Other tabs are uneven layout."""
    for m in _TABBED.finditer(text):
        lines = m[0].split("\n")
        tabs = [x.count("\t") for x in lines]
        small = [all(len(f.split()) <= FIELD_WORDS for f in x.split("\t")) and x.rstrip()[-1:] not in _STOPS for x in lines]
        at = m.start()
        for k, x in enumerate(lines):
            if small[k] and any(0 <= o < len(lines) and small[o] and tabs[o] == tabs[k] for o in (k - 1, k + 1)):
                yield at, at + len(x)
            at += len(x) + 1


class Pieces(NamedTuple):
    """Segments of some texts: number of the text, start in it, length, and the tokens of all of them with their number in each."""

    text: np.ndarray
    start: np.ndarray
    length: np.ndarray
    ends: np.ndarray
    tokens: list[str]
    sizes: np.ndarray


def pieces_of(texts: list[str | None]) -> Pieces:
    """The segments of texts: sentences and what is left between them; log lines, headings and tables belong to none.

    ends: whether a segment ends as a sentence does. The texts are searched as one string, as long ones, so that few calls do most of the work.
    """
    texts = [t or "" for t in texts]
    joined = _BETWEEN.join(texts)
    whole = _MARKUP.sub(lambda m: " " * len(m[0]), joined)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.concatenate([[0], (sizes + len(_BETWEEN)).cumsum()[:-1]]) if len(texts) else np.empty(0, np.int64)
    out = [m.span() for m in _LOG.finditer(whole)] if "=" in whole else []
    out += [m.span() for m in _LINE.finditer(whole)]
    out += _tables(whole) if "\t" in whole else []
    cuts = [m.end() for m in _STOP.finditer(whole)]
    for m in _BREAK.finditer(whole):
        cuts += m.span()
    spans = np.array(out, np.int64).reshape(-1, 2)
    cuts = np.unique(np.concatenate([np.array(cuts, np.int64), spans.ravel(), begin, begin + sizes]))
    inside = np.zeros(len(cuts) + 1, np.int64)  # how many spans lie over the segment behind each cut
    np.add.at(inside, np.searchsorted(cuts, spans[:, 0]), 1)
    np.add.at(inside, np.searchsorted(cuts, spans[:, 1]), -1)
    free = inside[:-1].cumsum()[:-1] == 0
    starts, length, ends, tokens, count = [], [], [], [], []
    for i, j in zip(cuts[:-1][free].tolist(), cuts[1:][free].tolist()):
        part = whole[i:j]
        words = part.split()
        if words:
            clean = part.rstrip()
            starts.append(j - len(part.lstrip()))
            length.append(i + len(clean) - starts[-1])
            ends.append(clean.endswith(_STOPS) or clean.rstrip(_QUOTES).endswith(_STOPS))
            tokens += words
            count.append(len(words))
    at = np.array(starts, np.int64)
    owner = np.searchsorted(begin, at, "right") - 1
    return Pieces(owner, at - begin[owner] if len(at) else at, np.array(length, np.int64), np.array(ends, bool), tokens, np.array(count, np.int64))


def _portions(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHARS_AT_ONCE characters; a longer text is one of its own."""
    at, n = 0, 0
    for k, t in enumerate(texts):
        if n and n + len(t or "") > CHARS_AT_ONCE:
            yield at, k
            at, n = k, 0
        n += len(t or "")
    if at < len(texts):
        yield at, len(texts)


def _grams(word: str, n: int) -> list[str]:
    padded = f"^{word}$"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


class Backoff:
    """Log frequencies by language: of known words, and of n-grams of each length for the others."""

    def __init__(self, counts: dict[tuple[int, str], dict[str, int]], languages: list[str], further: list[str] | None = None) -> None:
        self.languages, self.further = languages, further or []
        totals: dict[int, np.ndarray] = {}
        where = {x: k for k, x in enumerate(languages)}
        table: dict[tuple[int, str], np.ndarray] = {}
        for (n, gram), by in counts.items():
            row = table[n, gram] = np.zeros(len(languages))
            for lang, c in by.items():
                row[where[lang]] += c
            totals[n] = totals.get(n, 0) + row
        self.tables: dict[int, dict[str, np.ndarray]] = {n: {} for n in range(LONGEST + 1)}
        for (n, gram), row in table.items():
            common = row.sum() / totals[n].sum()
            self.tables[n][gram] = np.log((row + PRIOR * common) / (totals[n] + PRIOR)).astype(np.float32)

    def word(self, w: str) -> np.ndarray | None:
        """Scores of a word: its own, else the mean over its known n-grams of the greatest length that has any; None if nothing is known."""
        got = self.tables[0].get(w)
        if got is not None:
            return got
        for n in range(min(LONGEST, len(w) + 2), 0, -1):
            known = [self.tables[n][g] for g in _grams(w, n) if g in self.tables[n]]
            if known:
                return np.mean(known, axis=0)
        return None


class Scorer:
    """Scores segments by a model: the tokens that texts share are cleaned and looked up once."""

    def __init__(self, model: Backoff) -> None:
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.rows: list[np.ndarray] = []
        self.counts: list[tuple[int, int, bool]] = []

    def _learn(self, token: str) -> int:
        words = words_of(token)
        han = sum(len(w) == 1 and _HAN.match(w) is not None for w in words)
        scores = [s for s in map(self.model.word, words) if s is not None]
        # One word speaks for a language by six at most, so that no single one decides a sentence.
        total = np.clip(np.array(scores) - np.max(scores, axis=1, keepdims=True), -6, 0).sum(axis=0) if scores else np.zeros(len(self.model.languages))
        self.known[token] = k = len(self.rows)
        self.rows.append(total.astype(np.float32))
        self.counts.append((len(words) - han, han, bool(scores)))
        return k

    def score(self, p: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each segment: number of the best language (-1: no word says anything), its confidence, and whether it is a whole sentence."""
        if not len(p.sizes):
            return np.empty(0, np.int64), np.empty(0), np.empty(0, bool)
        if len(self.known) > TOKENS_KEPT:
            self.clear()
        for token in set(p.tokens).difference(self.known):
            self._learn(token)
        ids = np.fromiter(map(self.known.__getitem__, p.tokens), np.int64, len(p.tokens))
        first = np.concatenate([[0], p.sizes.cumsum()[:-1]])
        total = np.add.reduceat(np.array(self.rows)[ids], first).astype(np.float64)
        words, han, says = np.add.reduceat(np.array(self.counts, np.int64)[ids], first).T
        like = np.exp(total - total.max(axis=1, keepdims=True))
        best = like.argmax(axis=1)
        sure = like.max(axis=1) / like.sum(axis=1)
        return np.where(says > 0, best, -1), np.where(says > 0, sure, 0.0), p.ends & ((words >= LEAST_WORDS) | (han >= LEAST_HAN))


def _count(rows: DataFrame, model: Backoff | None) -> dict[tuple[int, str], dict[str, int]]:
    """Counts of words (length 0) and n-grams by language, of texts by their label, or of sentences by the model's verdict: in how many documents, however long.

    rows: text, lang. n-grams are counted on the distinct words, not on the texts.
    """

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model or Backoff({}, [""]))
        clean: dict[str, list[str]] = {}
        seen: Counter = Counter()
        for pdf in batches:
            texts, labels = pdf["text"].tolist(), pdf["lang"].tolist()
            for i, j in _portions(texts):
                p = pieces_of(texts[i:j])
                best, sure, whole = scorer.score(p)
                ok = whole & (sure >= LEAST_CONFIDENCE) if model else whole
                own: dict[tuple[int, str], set[str]] = {}
                last = p.sizes.cumsum()
                for k in np.flatnonzero(ok).tolist():
                    lang = model.languages[best[k]] if model else labels[i + p.text[k]]
                    own.setdefault((int(p.text[k]), lang), set()).update(p.tokens[last[k] - p.sizes[k] : last[k]])
                for (_, lang), tokens in own.items():
                    for t in tokens.difference(clean):
                        clean[t] = words_of(t)
                    seen.update((lang, w) for w in {w for t in tokens for w in clean[t]})
                if len(clean) > TOKENS_KEPT:
                    clean.clear()
        yield pd.DataFrame([(x, w, c) for (x, w), c in seen.items()], columns=["lang", "gram", "c"])

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: Counter = Counter()
            for x, w, c in zip(pdf["lang"].tolist(), pdf["gram"].tolist(), pdf["c"].tolist()):
                out[x, 0, w] += c
                for n in range(1, min(LONGEST, len(w) + 2) + 1):
                    for g in _grams(w, n):
                        out[x, n, g] += c
            yield pd.DataFrame([(x, n, g, c) for (x, n, g), c in out.items()], columns=["lang", "n", "gram", "c"])

    by_word = rows.mapInPandas(words, "lang string, gram string, c bigint").groupBy("lang", "gram").agg(F.sum("c").alias("c"))
    all_ = by_word.mapInPandas(grams, "lang string, n int, gram string, c bigint").groupBy("lang", "n", "gram").agg(F.sum("c").alias("c"))
    top = all_.withColumn("__r", F.row_number().over(Window.partitionBy("lang", "n").orderBy(F.desc("c"), "gram"))).filter(F.col("__r") <= FIT_ENTRIES).drop("__r")
    got = top.toArrow()  # at most languages x (LONGEST + 1) x FIT_ENTRIES rows, of a bounded sample
    counts: dict[tuple[int, str], dict[str, int]] = {}
    for lang, n, gram, c in zip(*(got[k].to_pylist() for k in ("lang", "n", "gram", "c"))):
        counts.setdefault((n, gram), {})[lang] = c
    return counts


def fit(docs: DataFrame, ident: str, text: str, label: str, documents: int = FIT_DOCUMENTS) -> Backoff | None:
    """The model of a hash sample of about `documents` labelled rows; None if no row is labelled.

    Languages are those of SPELLINGS that labels name, and every other code that LEAST_SUPPORT of the labelled rows bear. Labels may be wrong and texts mixed, so
    the first model (by the labels) only sorts the sample's sentences into languages; the second is counted on those. The sample is read and cut once.
    """
    named = docs.select(F.col(ident).alias("id"), F.col(text).alias("text"), label_language(label, None).alias("lang")).filter("lang is not null")
    shares = {r["lang"]: r["n"] for r in named.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most all codes of three letters
    n = sum(shares.values())
    further = sorted(x for x, c in shares.items() if x not in SPELLINGS and c >= LEAST_SUPPORT * n)
    part = named.filter(F.col("lang").isin(*SPELLINGS, *further) & F.col("text").isNotNull())
    part = part.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < F.lit(max(1, min(1_000_003, math.ceil(1_000_003 * documents / max(n, 1))))))
    part = Scratch(docs.sparkSession).table(part.select("text", "lang"), "sample")
    first = _count(part, None) if n else {}
    languages = sorted({x for by in first.values() for x in by})
    if not languages:
        return None
    second = _count(part, Backoff(first, languages))
    return Backoff(second or first, languages, further)


def language_segments(docs: DataFrame, ident: str, text: str, model: Backoff | None) -> DataFrame:
    """ident, segment (from 0), start, length (characters), lang, confidence, whole: the segments of each text; neighbours are not merged.

    lang is null where no word says anything. Null and empty texts have no segments; texts of any length are read whole. Without a model there are no rows.
    """
    kind = dict(docs.dtypes)[ident]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most (languages + 1) x (LONGEST + 1) x FIT_ENTRIES numbers
    names = ["id", "segment", "start", "length", "lang", "confidence", "whole"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if shared.value is None:
            return
        scorer = Scorer(shared.value)
        languages = pa.array([*shared.value.languages, None], pa.string())
        for b in batches:
            texts = b.column("text").to_pylist()
            for i, j in _portions(texts):
                p = pieces_of(texts[i:j])
                best, sure, whole = scorer.score(p)
                number = np.arange(len(p.text)) - np.searchsorted(p.text, p.text)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").take(pa.array(p.text + i)), pa.array(number.astype(np.int32)), pa.array(p.start.astype(np.int32)), pa.array(p.length.astype(np.int32)), languages.take(pa.array(best % len(languages))), pa.array(sure), pa.array(whole)],
                    names=names,
                )

    rows = docs.select(F.col(ident).alias("id"), F.col(text).alias("text")).filter("id is not null and text is not null")
    return rows.mapInArrow(run, f"id {kind}, segment int, start int, length int, lang string, confidence double, whole boolean").withColumnRenamed("id", ident)


def document_languages(segments: DataFrame, ident: str) -> DataFrame:
    """ident, lang, n_sentences, share (of the characters in sentences), confidence (mean by length): the languages with a whole sentence, of at least LEAST_CONFIDENCE."""
    sure = segments.filter(F.col("whole") & F.col("lang").isNotNull() & (F.col("confidence") >= LEAST_CONFIDENCE))
    by = sure.groupBy(ident, "lang").agg(F.count(F.lit(1)).alias("n_sentences"), F.sum("length").alias("__n"), (F.sum(F.col("confidence") * F.col("length")) / F.sum("length")).alias("confidence"))
    total = F.sum("__n").over(Window.partitionBy(ident))  # a row per language
    return by.select(ident, "lang", "n_sentences", (F.col("__n") / total).alias("share"), "confidence")


def label_problems(docs: DataFrame, found: DataFrame, ident: str, label: str, further: list[str] | None = None) -> DataFrame:
    """ident, lang: of documents whose label is absent or names no language found, or that have several, each language found."""
    have = found.groupBy(ident).agg(F.collect_set("lang").alias("__langs"))
    named = docs.select(ident, label_language(label, further or ()).alias("__label"))
    wrong = named.join(have, ident).filter((F.size("__langs") > 1) | F.col("__label").isNull() | ~F.array_contains("__langs", F.col("__label")))
    return wrong.select(ident, F.explode("__langs").alias("lang")).distinct()
