"""Operator 1: language identification with word-first backoff.

A model holds, for each language, the log10 relative frequency of its words
and of the character n-grams (orders 1 to ``ORDER``) of its words, spaces
around a word included.  A known word is scored by word frequency.  An unseen
word falls back to its n-grams of the longest order of which any is known,
then to shorter ones, scored by the mean over its known n-grams.  What a
language lacks scores ``PENALTY``.  A text's score per language is the mean
over its words (after HeLI, Jauhiainen et al.).

The model is fitted on at most about ``max_docs`` labelled rows per language
(a share chosen by hash; all rows where there are fewer) and keeps the most
frequent ``max_words`` words and ``max_grams`` n-grams per language and order.
So its size is bounded, and it is broadcast.  Words are runs of letters in
lower case.

Predictions: a text that is null or has no letter, or a model without any
language, gives ``und`` with score 0.  Ties go to the first language in order.
The score is the share of the language in the softmax of the mean scores.
Labels that are null do not train.  Null and repeated ids are kept (a null
counts as the empty text for the fold).  Other columns are ignored."""

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import built, id_crc, share

ORDER = 5
PENALTY = -7.0
_RUN = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _RUN.findall(text.lower())


def letters_only(run: str) -> list[str]:
    """A run of word characters cut to its runs of letters."""
    if run.isalpha():
        return [run]
    return "".join(c if c.isalpha() else " " for c in run).split()


def grams(word: str, n: int) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def fit(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id",
    max_docs: int = 5_000, max_words: int = 20_000, max_grams: int = 10_000,
):
    """The broadcast rows of a ``Model``, fitted on rows with a text and a label."""
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(key_col).alias("h")
    )
    shares = rows.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(max_docs) / F.count("*")).alias("share"))
    # One row a language is broadcast, so no text moves before the sample is taken.
    sample = rows.join(F.broadcast(shares), "lang").where(F.pmod("h", F.lit(1 << 20)) < F.col("share") * (1 << 20))
    schema = pa.schema([("lang", pa.string()), ("n", pa.int32()), ("item", pa.string()), ("c", pa.int64())])

    def run(batches):
        counts: dict[str, Counter] = {}
        for b in batches:
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist()):
                own = counts.setdefault(lang, Counter())
                own.update(w for r in words_of(text) for w in letters_only(r))
            if sum(map(len, counts.values())) > 400_000:
                yield from listed(counts)
                counts = {}
        yield from listed(counts)

    def listed(counts):
        for lang, words in counts.items():
            yield from rows_of(lang, 0, words)
            for n in range(1, ORDER + 1):
                one = Counter()
                for w, c in words.items():
                    for g in grams(w, n):
                        one[g] += c
                yield from rows_of(lang, n, one)

    def rows_of(lang, n, counter):
        if counter:
            k = len(counter)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * k), pa.array([n] * k, pa.int32()), pa.array(list(counter)), pa.array(list(counter.values()), pa.int64())],
                schema=schema,
            )

    counts = sample.select("text", "lang").mapInArrow(run, "lang string, n int, item string, c long")
    counts = counts.groupBy("lang", "n", "item").agg(F.sum("c").alias("c"))
    by = Window.partitionBy("lang", "n")
    kept = counts.withColumn("total", F.sum("c").over(by)).withColumn(
        "rank", F.row_number().over(by.orderBy(F.desc("c"), "item"))
    )
    kept = kept.where(F.col("rank") <= F.when(F.col("n") == 0, max_words).otherwise(max_grams))
    return share(kept.select("lang", "n", "item", F.log10(F.col("c") / F.col("total")).alias("v")))


class Model:
    """Score vectors (one place per language) of words and n-grams."""

    def __init__(self, table: pa.Table):
        columns = [table.column(x).to_pylist() for x in ("lang", "n", "item", "v")]
        self.langs = sorted(set(columns[0]))
        place = {x: i for i, x in enumerate(self.langs)}
        self.levels: list[dict[str, np.ndarray]] = [{} for _ in range(ORDER + 1)]
        for lang, n, item, v in zip(*columns):
            vector = self.levels[n].get(item)
            if vector is None:
                vector = self.levels[n][item] = np.full(len(self.langs), PENALTY)
            vector[place[lang]] = v

    def word(self, word: str) -> np.ndarray:
        found = self.levels[0].get(word)
        if found is not None:
            return found
        for n in range(ORDER, 0, -1):
            level = self.levels[n]
            some = [v for g in grams(word, n) if (v := level.get(g)) is not None]
            if some:
                return sum(some) / len(some)
        return np.full(len(self.langs), PENALTY)


class WordScores(dict):
    """Rows of a growing matrix by word; the row of a run without letters is
    zero and not counted."""

    LIMIT = 400_000

    def __init__(self, model: Model):
        self.model = model
        self.rows = np.zeros((1 << 12, len(model.langs) + 1))
        self.n = 0

    def __missing__(self, run: str) -> int:
        words = letters_only(run)
        if self.n == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        for w in words:
            self.rows[self.n, :-1] += self.model.word(w)
        self.rows[self.n, -1] = len(words)
        self[run] = self.n
        self.n += 1
        return self.n - 1


def predict(docs: DataFrame, shared, text_col: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` by a model that ``fit`` returned."""
    kind = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])

    def one(text, scores):
        runs = words_of(text) if text else []
        if not runs or not scores.model.langs:
            return "und", 0.0
        if len(scores) > scores.LIMIT:
            scores.clear()
            scores.n = 0
            scores.rows[:] = 0
        idx = np.fromiter(map(scores.__getitem__, runs), np.int64, len(runs))
        total = scores.rows[idx].sum(0)
        if not total[-1]:
            return "und", 0.0
        mean = total[:-1] / total[-1]
        best = int(np.argmax(mean))
        return scores.model.langs[best], float(1 / np.exp((mean - mean[best]) * np.log(10)).sum())

    @F.pandas_udf(kind)
    def guess(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scores = WordScores(built(shared, Model))
        for texts in batches:
            yield pd.DataFrame([one(t, scores) for t in texts], columns=["lang", "score"])

    out = docs.withColumn("__guess", guess(F.col(text_col)))
    return out.select(*docs.columns, F.col("__guess.lang").alias("lang_pred"), F.col("__guess.score").alias("score"))


def identify(docs: DataFrame, id_col: str = "doc_id", folds: int = 3, held: int = 1) -> DataFrame:
    """(id_col, held_out, lang_pred, score): the model learns from rows whose
    fold (crc32 of the id's text mod ``folds``) is not ``held``."""
    rows = docs.select(id_col, "text", "lang", (id_crc(id_col) % folds == held).alias("held_out"))
    model = fit(rows.where(~F.col("held_out")), key_col=id_col)
    return predict(rows.select(id_col, "held_out", "text"), model).select(id_col, "held_out", "lang_pred", "score")
