"""Language identification: known words first, then ever shorter character n-grams.

A word seen in training scores its log relative frequency in each language. An unseen word
backs off to the longest n-grams of its marked form ``^word$`` that were seen, from
``LONGEST`` characters down to one, each with a fixed discount a step. The language with the
highest sum wins. Counts come from all training texts; the model keeps the most frequent words and n-grams of
each language, ``WORDS`` and ``GRAMS`` at most, which bounds what is broadcast.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stormlake.llm.words import chunks

#: model size: most words and most n-grams of each length kept for a language
WORDS = 30_000
GRAMS = 10_000
#: most languages that a model tells apart, those with the most words
LANGUAGES = 500
LONGEST = 4
#: added to each count, and log penalty for each step to shorter n-grams
SMOOTH = 0.5
STEP_DOWN = 0.5
UNKNOWN = "und"
_CHUNK = 2 << 20
#: runs of letters of any script
_LETTERS = re.compile(r"[^\W\d_]+")
#: words longer than this are counted and scored by their n-grams only
_LONG = 64


def _words(text: str) -> Counter:
    return Counter(_LETTERS.findall(text.lower()))


def _grams(word: str, n: int) -> list[str]:
    marked = f"^{word}$"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def count_words(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """``lang, word, n`` over all rows with a text and a language, summed in each task first."""

    def counted(batches):
        for batch in chunks(batches, "_text", _CHUNK):
            held: dict[str, Counter] = {}
            for words, name in zip(batch.column("_text").to_pylist(), batch.column("_lang").to_pylist()):
                held.setdefault(name, Counter()).update(_LETTERS.findall(words.lower()))
            for name, counts in held.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(counts), pa.string()), pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
                    names=["lang", "word", "n"],
                )

    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    return (
        rows.select(F.col(text).alias("_text"), F.col(lang).alias("_lang"))
        .mapInArrow(counted, "lang string, word string, n bigint")
        .groupBy("lang", "word")
        .agg(F.sum("n").alias("n"))
    )


def count_grams(words: DataFrame, longest: int = LONGEST) -> DataFrame:
    """``lang, size, gram, n`` of the marked forms of all counted words."""

    def counted(batches):
        for batch in batches:
            held: dict[tuple[str, int], Counter] = {}
            for name, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "n"))):
                for size in range(1, longest + 1):
                    counts = held.setdefault((name, size), Counter())
                    for gram in _grams(word, size):
                        counts[gram] += n
            for (name, size), counts in held.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(counts), pa.string()), pa.array([size] * len(counts), pa.int32()), pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
                    names=["lang", "size", "gram", "n"],
                )

    return (
        words.mapInArrow(counted, "lang string, size int, gram string, n bigint")
        .groupBy("lang", "size", "gram")
        .agg(F.sum("n").alias("n"))
    )


class LanguageModel:
    """Log frequencies by language: a table of words and one of the n-grams of each length, each
    a dictionary into the rows of a matrix with a column for every language."""

    def __init__(self, langs: list[str], words: tuple[dict, np.ndarray], grams: list[tuple[dict, np.ndarray]]):
        self.langs, self.words, self.grams = langs, words, grams

    def word_scores(self, words: list[str]) -> np.ndarray:
        """A row for each word: its own log frequencies if known, else the mean of those of its longest
        known n-grams less ``STEP_DOWN`` a step; zeros where nothing is known."""
        at, table = self.words
        number = np.array([at.get(w, -1) for w in words], dtype=np.int64)
        out = np.zeros((len(words), len(self.langs)))
        out[number >= 0] = table[number[number >= 0]]
        left = np.flatnonzero(number < 0)
        for size in range(len(self.grams), 0, -1):
            if not len(left):
                break
            at, table = self.grams[size - 1]
            found = [[at[g] for g in _grams(words[i], size) if g in at] for i in left.tolist()]
            sizes = np.array([len(f) for f in found])
            seen = np.flatnonzero(sizes)
            if len(seen):
                flat = np.fromiter((g for i in seen.tolist() for g in found[i]), dtype=np.int64, count=int(sizes.sum()))
                starts = np.cumsum(sizes[seen]) - sizes[seen]
                means = np.add.reduceat(table[flat], starts, axis=0) / sizes[seen][:, None]
                out[left[seen]] = means - STEP_DOWN * (len(self.grams) - size + 1)
            left = left[sizes == 0]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language of each text and its share of the posterior under equal priors; ties to the first
        name. ``und`` and 0 for a null text, one without letters, or an untrained model."""
        number: dict[str, int] = {}
        flat, counts, sizes = [], [], []
        for text in texts:
            own = _words(text) if text else {}
            flat.extend([number.setdefault(w, len(number)) for w in own])
            counts.extend(own.values())
            sizes.append(len(own))
        if not self.langs or not flat:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        scores = self.word_scores(list(number))
        owner = np.repeat(np.arange(len(texts)), sizes)
        flat, counts = np.array(flat), np.array(counts, dtype=np.float64)
        total = np.stack([np.bincount(owner, counts * scores[flat, i], len(texts)) for i in range(len(self.langs))], axis=1)
        best = total.argmax(axis=1)
        share = 1 / np.exp(np.clip(total - total.max(axis=1, keepdims=True), -700, 0)).sum(axis=1)
        known = np.array(sizes) > 0
        return [self.langs[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist())], np.where(known, share, 0.0).tolist()


def _log_table(rows: list[tuple[str, str, int]], langs: list[str], totals: dict[str, int]) -> tuple[dict, np.ndarray]:
    """Log relative frequencies with smoothing; what a language lacks counts ``SMOOTH``."""
    sizes = np.array([totals.get(name, 0) for name in langs], dtype=np.float64) + 1
    column = {name: i for i, name in enumerate(langs)}
    at: dict[str, int] = {}
    places = [(at.setdefault(key, len(at)), column[name], n) for name, key, n in rows]
    counts = np.zeros((len(at), len(langs)))
    for row, i, n in places:
        counts[row, i] = n
    return at, np.log((counts + SMOOTH) / sizes)


def fit_language(docs: DataFrame, text: str = "text", lang: str = "lang", words: int = WORDS, grams: int = GRAMS) -> LanguageModel:
    """Count words and n-grams of all given texts; keep the most frequent of each language.

    Rows with a null text or language teach nothing. Ties in frequency go to the smaller
    word. The word counts are written once to the shared folder, since totals, words and n-grams read them.
    """
    from stormlake.session import stage

    counted = stage(count_words(docs, text, lang).where(F.length("word") <= _LONG), "language-words")
    largest = counted.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    totals = {r["lang"]: r["n"] for r in largest.collect()}
    langs = sorted(totals)
    counted = counted.where(F.col("lang").isin(langs))
    top = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    rows = counted.withColumn("_at", F.row_number().over(top)).where(F.col("_at") <= words).drop("_at").collect()
    table = _log_table([(r["lang"], r["word"], r["n"]) for r in rows], langs, totals)
    by_size = stage(count_grams(counted), "language-grams")
    top = Window.partitionBy("lang", "size").orderBy(F.desc("n"), "gram")
    kept = by_size.withColumn("_at", F.row_number().over(top)).where(F.col("_at") <= grams).drop("_at").collect()
    gram_totals = by_size.groupBy("lang", "size").agg(F.sum("n").alias("n")).collect()
    tables = []
    for size in range(1, LONGEST + 1):
        own = {r["lang"]: r["n"] for r in gram_totals if r["size"] == size}
        tables.append(_log_table([(r["lang"], r["gram"], r["n"]) for r in kept if r["size"] == size], langs, own))
    return LanguageModel(langs, table, tables)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``lang_pred`` and ``score`` for every row, in one pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.words, model.grams))
    kept_schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def predicted(batches):
        local = LanguageModel(*shared.value)
        for batch in chunks(batches, "_text", _CHUNK):
            names, shares = local.predict(batch.column("_text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(names, pa.string()), pa.array(shares, pa.float64())],
                names=[*keep, "lang_pred", "score"],
            )

    rows = docs.select(*keep, F.col(text).alias("_text"))
    return rows.mapInArrow(predicted, f"{kept_schema}, lang_pred string, score double")
