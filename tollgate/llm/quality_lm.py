"""Operator 5: quality classifier by a modified Kneser-Ney n-gram model.

Per language, a character n-gram model (order ``ORDER``) is trained on trusted
text, read as one stream of words with single spaces, so that grams run from a
word into the next.  Counts are summed by Spark, lower
orders count distinct left extensions, and the three discounts of each order
come from its counts of counts (Chen and Goodman).  Each order's counts are
joined with their contexts' totals and with the next lower order's
probabilities; all joins are keyed, and so sharded, by language and n-gram.
The result is one interpolated probability per seen n-gram and one backoff
weight per seen context.

That table is hash-sharded by language and by the context's last character,
so that an n-gram, its context and all its shorter forms are in one shard, and
joined with the documents shard by shard: each pass holds one broadcast shard
of at most about ``SHARD_ROWS`` rows and adds its part of every document's log
probability.  Counts and thresholds come from all trusted rows; the number of
shards grows with their distinct n-grams.
Texts are counted and scored as arrays of characters, with 64-bit codes for
the four-character grams (about n^2 / 2^65 chance collisions).

Perplexity is per character.  A fifth of the trusted rows is held out of the
counts; a document is rejected above the language's upper quantile of the
held-out texts, widened by ``margin``.  Such a model takes one probable word
said over and over for good text, so a document is also rejected whose evenness
(entropy of its own words over the log of their number: 1 if all differ, 0 if
all are one) is below the trusted texts' lower quantile, divided by
``even_margin``.  Short texts are drawn to their language's means by ``PRIOR``
characters and ``EVEN_PRIOR`` words.  A language without
enough trusted rows (or a null one) takes the model and threshold of all
trusted rows together.

A null or blank text has no characters: its perplexity is null and it is
rejected.  Without trusted rows nothing else is rejected.  Ties at the
threshold are kept.  Null and repeated ids and any other columns stay, whatever
their names; ``classify`` replaces columns called perplexity, threshold or kept,
``accepted`` keeps them."""

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import built, fresh, pieces, share, stored, trim, trimmed
from .ngram_join import mix

ORDER = 4
END = " "
SHARD_ROWS = 1_000_000
HELD_WORDS = 200_000  # distinct grams of a language that a task holds
STEP_CHARS = 1 << 17  # bounds the arrays of one step
_ODD = np.uint64(0x9E3779B97F4A7C15)
BROADCAST_IDS = 200_000
PRIOR = 200.0
EVEN_PRIOR = 40.0
LEAST_TRUSTED = 50
LEAST_HELD = 20
ALL = "*"  # the language of the common model


def streams(texts: list[list[str]]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """The streams of the texts' words in a row: characters, their code points,
    each one's text and its place there.  A text without words has none."""
    one = "".join(END + END.join(words) + END if words else "" for words in texts)
    n = np.fromiter((sum(map(len, words)) + len(words) + 1 if words else 0 for words in texts), np.int64, len(texts))
    points = np.frombuffer(one.encode("utf-32-le"), np.uint32)
    place = np.arange(len(points)) - np.repeat(np.cumsum(n) - n, n)
    return one, points, np.repeat(np.arange(len(texts), dtype=np.int32), n), place.astype(np.int32)


def gram_keys(points: np.ndarray) -> list[np.ndarray]:
    """Keys of the grams of 1 .. ``ORDER`` characters that end at each place
    (those that reach back before the first are void).  Up to three characters
    have keys of their own, longer grams a 64-bit code."""
    c = points.astype(np.uint64)
    keys, packed = [], c
    for k in range(1, ORDER + 1):
        if k > 1:
            back = np.zeros(len(c), np.uint64)
            back[k - 1 :] = c[: len(c) - k + 1]
            if k <= 3:
                packed = packed | back << np.uint64(21 * (k - 1))
        keys.append(mix(packed) if k <= 3 else keys[-1] + (back + np.uint64(1)) * _ODD)
    return keys


def ranges(n: int) -> Iterator[tuple[int, int, int]]:
    """(from, lo, hi) of steps over n places: lo .. hi with what their grams
    reach back to."""
    for lo in range(0, n, STEP_CHARS):
        yield max(0, lo - ORDER + 1), lo, min(n, lo + STEP_CHARS)


def gram_counts(texts: list[list[str]]) -> Counter:
    """Counts of grams of the full order (shorter ones at a text's start)."""
    grams: Counter = Counter()
    one, points, _, place = streams(texts)
    for at, lo, hi in ranges(len(points)):
        full = np.flatnonzero(place[lo:hi] >= ORDER - 1) + lo
        keys = gram_keys(points[at:hi])[-1][full - at]
        order = np.argsort(keys)
        first = np.flatnonzero(np.diff(keys[order], prepend=~keys[order[:1]]))
        for i, c in zip(full[order[first]].tolist(), np.diff(np.append(first, len(order))).tolist()):
            grams[one[i - ORDER + 1 : i + 1]] += c
    for start in np.flatnonzero(place == 0).tolist():
        for k in range(2, ORDER):
            grams[one[start : start + k]] += 1
    return grams


def word_counts(sample: DataFrame) -> DataFrame:
    """(lang, gram of the full order, count) of trusted texts."""
    schema = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("c", pa.int64())])

    def run(batches):
        counts: dict[str, Counter] = {}
        for b in batches:
            texts: dict[str, list[list[str]]] = {}
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                texts.setdefault(lang, []).append(text.split())
            for lang, some in texts.items():
                own = counts.setdefault(lang, Counter())
                own.update(gram_counts(some))
                if len(own) > HELD_WORDS:
                    yield grams_of(lang, counts.pop(lang))
        for lang, own in counts.items():
            yield grams_of(lang, own)

    def grams_of(lang: str, grams: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(grams)), pa.array(list(grams)), pa.array(list(grams.values()), pa.int64())], schema=schema
        )

    grams = sample.select("lang", "text").mapInArrow(trimmed(run), "lang string, gram string, c long")
    return grams.groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def fit(sample: DataFrame) -> DataFrame:
    """(lang, gram, logp, backoff): log10 interpolated probability of the
    gram's last character after the others, and the backoff weight (log10) of
    the gram as a context; either may be null.

    Grams below the full order count by distinct left extensions; one that
    starts a text (its first character is the start mark) counts as often as it
    does so, if that is more."""
    full = stored(word_counts(sample))
    n = F.length("gram")
    starts = full.where(F.col("gram").startswith(END))
    levels, below = {}, None
    for k in range(ORDER, 0, -1):
        if k == ORDER:
            counted = full.where(n == k)
        else:  # continuation counts from the next order's counts, raw ones at a word's start
            counted = levels[k + 1].select("lang", F.expr("substring(gram, 2)").alias("gram")).groupBy("lang", "gram").agg(
                F.count("*").alias("c")
            ).unionByName(starts.where(n == k)).groupBy("lang", "gram").agg(F.max("c").alias("c"))
        levels[k] = stored(counted)
    table = None
    for k in range(1, ORDER + 1):
        own = levels[k].select("lang", "gram", "c", F.expr(f"substring(gram, 1, {k - 1})").alias("context"))
        of = own.groupBy("lang").agg(*(F.sum((F.col("c") == i).cast("double")).alias(f"t{i}") for i in (1, 2, 3, 4)))
        y = F.col("t1") / F.greatest(F.col("t1") + 2 * F.col("t2"), F.lit(1.0))
        ratio = lambda i: F.coalesce(F.try_divide(F.col(f"t{i + 1}"), F.col(f"t{i}")), F.lit(0.0))
        of = of.select("lang", *(
            F.greatest(F.lit(0.05), F.least(F.lit(i - 0.05), i - (i + 1) * y * ratio(i))).alias(f"d{i}") for i in (1, 2, 3)
        ))
        discount = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        own = own.join(F.broadcast(of), "lang").withColumn("d", discount)  # one row for each language
        sums = own.groupBy("lang", "context").agg(F.sum("c").alias("total"), F.sum("d").alias("mass"))
        joined = own.join(sums, ["lang", "context"])
        if k == 1:  # the lowest order is interpolated with a uniform distribution
            lower = F.lit(1.0 / 4096)
        else:
            joined = joined.withColumn("shorter", F.expr("substring(gram, 2)")).join(
                below.select("lang", F.col("gram").alias("shorter"), F.col("p").alias("lower")), ["lang", "shorter"], "left"
            )
            lower = F.coalesce("lower", F.lit(1e-6))
        p = (F.col("c") - F.col("d")) / F.col("total") + F.col("mass") / F.col("total") * lower
        below = stored(joined.select("lang", "gram", p.alias("p")))
        rows = below.select("lang", "gram", F.log10("p").alias("logp"), F.lit(None).cast("double").alias("backoff")).unionByName(
            sums.select("lang", F.col("context").alias("gram"), F.lit(None).cast("double").alias("logp"),
                        F.log10(F.col("mass") / F.col("total")).alias("backoff"))
        )
        table = rows if table is None else table.unionByName(rows)
    return stored(table.groupBy("lang", "gram").agg(F.max("logp").alias("logp"), F.max("backoff").alias("backoff")))


def shard_of(lang: str, last: str, n_shards: int) -> int:
    return xxhash.xxh3_64_intdigest(f"{lang}\0{last}") % n_shards


class Lookup:
    """Values by 64-bit key, open-addressed, so that many are looked up at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        size = 1 << (2 * len(keys)).bit_length()
        self.mask = np.uint64(size - 1)
        self.keys, self.values = np.zeros(size, np.uint64), np.full(size, np.nan)
        slot, left = keys & self.mask, np.arange(len(keys))
        while len(left):
            free = left[np.isnan(self.values[slot[left]])]
            self.keys[slot[free]] = keys[free]  # one of those that meet stays
            won = free[self.keys[slot[free]] == keys[free]]
            self.values[slot[won]] = values[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            slot[left] = (slot[left] + np.uint64(1)) & self.mask

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Each key's value, NaN where it has none."""
        slot = keys & self.mask
        out = self.values[slot]
        other = np.flatnonzero((self.keys[slot] != keys) & ~np.isnan(out))
        while len(other):
            slot[other] = now = (slot[other] + np.uint64(1)) & self.mask
            out[other] = self.values[now]
            other = other[(self.keys[now] != keys[other]) & ~np.isnan(out[other])]
        return out


class Shard:
    """One shard of the table: log probabilities and backoffs by language and
    the gram's length."""

    def __init__(self, rows: pa.Table, number: int, n_shards: int):
        self.number, self.n_shards = number, n_shards
        self.mine: dict[str, np.ndarray] = {}  # by code point: 1 in this shard, 0 not, -1 unknown
        self.langs = set(pc.unique(rows.column("lang")).to_pylist())
        self.logp, self.backoff, self.least = {}, {}, {}
        for lang in self.langs | {ALL}:
            own = rows.filter(pc.equal(rows.column("lang"), lang))
            size = pc.utf8_length(own.column("gram"))
            for name, held in (("logp", self.logp), ("backoff", self.backoff)):
                held[lang] = [
                    self.lookup(own.filter(pc.and_(pc.equal(size, k), pc.is_valid(own.column(name)))), name, k)
                    for k in range(1, ORDER + 1)
                ]
            root = own.filter(pc.equal(size, 0)).column("backoff").drop_null().to_pylist()
            self.least[lang] = (root[0] if root else 0.0) - 3.612  # 1 / 4096

    @staticmethod
    def lookup(rows: pa.Table, name: str, k: int) -> Lookup:
        points = np.frombuffer("".join(rows.column("gram").to_pylist()).encode("utf-32-le"), np.uint32)
        return Lookup(gram_keys(points)[k - 1][k - 1 :: k], rows.column(name).to_numpy())

    def of_shard(self, lang: str, points: np.ndarray) -> np.ndarray:
        """Whether contexts that end in these characters are in this shard."""
        mine = self.mine.setdefault(lang, np.full(0x110000, -1, np.int8))
        for p in np.unique(points[mine[points] < 0]).tolist():
            mine[p] = shard_of(lang, chr(p), self.n_shards) == self.number
        return mine[points] == 1

    def parts(self, lang: str, texts: list[list[str]]) -> np.ndarray:
        """The shard's part of the log10 probability of each text's words."""
        out = np.zeros(len(texts))
        logp, backoff = self.logp[lang], self.backoff[lang]
        _, points, of, place = streams(texts)
        for at, lo, hi in ranges(len(points)):
            keys = gram_keys(points[at:hi])
            todo = np.flatnonzero(place[lo:hi] > 0) + lo
            if self.n_shards > 1:
                todo = todo[self.of_shard(lang, points[todo - 1])]
            total = np.zeros(hi - lo)
            for k in range(ORDER, 0, -1):
                long = place[todo] >= k - 1
                now, todo = todo[long], todo[~long]
                found = logp[k - 1].get(keys[k - 1][now - at])
                miss = np.isnan(found)
                total[now[~miss] - lo] += found[~miss]
                now = now[miss]
                total[now - lo] += np.nan_to_num(backoff[k - 2].get(keys[k - 2][now - at - 1])) if k > 1 else self.least[lang]
                todo = np.concatenate([todo, now])
            out += np.bincount(of[lo:hi], total, len(texts))
        return out


def evenness(words: list[str]) -> float:
    """Entropy of a text's words over the log of their number (1 for one word)."""
    n = len(words)
    if n < 2:
        return 1.0
    c = np.fromiter(Counter(words).values(), np.float64)
    return 1.0 - float((c * np.log(c)).sum()) / (n * math.log(n))


def shards(table: DataFrame) -> list:
    """The table's shards as broadcast rows.  A gram goes by its context's
    last character, a context by its last; orders without context go
    everywhere."""
    n_shards = pieces(table.count(), SHARD_ROWS)
    if n_shards == 1:
        return [share(table.select("lang", "gram", "logp", "backoff"))]

    @F.pandas_udf(T.IntegerType())
    def number(lang: pd.Series, gram: pd.Series) -> pd.Series:
        return pd.Series([shard_of(x, g, n_shards) for x, g in zip(lang, gram)], dtype="int32")

    out = []
    for i in range(n_shards):
        as_gram = table.where("logp is not null").where(
            (F.length("gram") < 2) | (number("lang", F.expr("substring(gram, -2, 1)")) == i)
        ).select("lang", "gram", "logp", F.lit(None).cast("double").alias("backoff"))
        as_context = table.where("backoff is not null").where(
            (F.length("gram") < 1) | (number("lang", F.expr("substring(gram, -1, 1)")) == i)
        ).select("lang", "gram", F.lit(None).cast("double").alias("logp"), "backoff")
        out.append(share(as_gram.unionByName(as_context)))
    return out


def _part_of(shared, number: int, n_shards: int):
    """The function that adds up one broadcast shard's part of each text."""
    kind = T.StructType([T.StructField("logp", T.DoubleType()), T.StructField("chars", T.LongType()),
                         T.StructField("words", T.LongType()), T.StructField("even", T.DoubleType())])

    @F.pandas_udf(kind)
    def part(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        one = built(shared, lambda rows: Shard(rows, number, n_shards))
        for texts, langs in batches:
            words = [text.split() if text else [] for text in texts]
            rows: dict[str, list[int]] = {}
            for i, lang in enumerate(langs):
                rows.setdefault(lang if lang in one.langs else ALL, []).append(i)
            logp = np.zeros(len(words))
            for lang, some in rows.items():
                logp[some] = one.parts(lang, [words[i] for i in some])
            yield pd.DataFrame({
                "logp": logp, "chars": [sum(map(len, w)) + len(w) for w in words], "words": [len(w) for w in words],
                "even": [evenness(w) if number == 0 else 0.0 for w in words],
            })
        del one
        trim()

    return part


def log_probability(docs: DataFrame, model: list, name: str, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Add a struct column ``name``: logp (log10, summed over the shards),
    chars, words and even."""
    out, logp, parts = docs, None, []
    for i, shard in enumerate(model):
        parts.append(fresh(docs.columns, f"part{i}"))
        out = out.withColumn(parts[i], _part_of(shard, i, len(model))(F.col(text_col), F.col(lang_col)))
        own = F.col(f"{parts[i]}.logp")
        logp = own if logp is None else logp + own
    rest = (F.col(f"{parts[0]}.{x}").alias(x) for x in ("chars", "words", "even"))
    return out.select(*docs.columns, F.struct(logp.alias("logp"), *rest).alias(name))


def trusted_sample(docs: DataFrame, labels: DataFrame, id_col: str, max_docs: int | None = None) -> DataFrame:
    """(lang, text, held) of all rows labelled good and not toxic, once under their
    language (where it has enough) and once under ``ALL``; held rows are kept
    from the counts.  ``max_docs`` draws about so many rows of a language."""
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0").select(F.col("doc_id").alias("__label")).distinct()
    ids = docs.where(F.col("text").isNotNull()).select(F.col(id_col).alias("__id"), F.col("lang"))
    ids = ids.join(good, F.col("__id") == F.col("__label"), "left_semi")
    kept = ids.groupBy("lang").agg(F.count("*").alias("rows"))
    chosen = ids.join(F.broadcast(kept), ids["lang"].eqNullSafe(kept["lang"]))  # one row for each language
    if max_docs is not None:
        chosen = chosen.where(
            F.pmod(F.xxhash64("__id"), F.lit(1 << 20)) < F.least(F.lit(1.0), F.lit(max_docs) / F.col("rows")) * (1 << 20)
        )
    chosen = stored(chosen.select("__id", "rows").distinct())
    chosen = F.broadcast(chosen) if chosen.count() <= BROADCAST_IDS else chosen
    texts = docs.select(F.col(id_col).alias("__id"), "text", "lang").join(chosen, "__id")
    texts = texts.withColumn("held", F.pmod(F.xxhash64(F.lit("held"), "__id"), F.lit(5)) == 0)
    own = texts.where((F.col("rows") >= LEAST_TRUSTED) & F.col("lang").isNotNull()).select("lang", "text", "held")
    return stored(own.unionByName(texts.select(F.lit(ALL).alias("lang"), "text", "held")))


def judged(
    docs: DataFrame, labels: DataFrame, names: tuple[str, str, str], id_col: str = "doc_id",
    max_docs: int | None = None, quantile: float = 0.995, margin: float = 1.1, even_margin: float = 1.25,
) -> DataFrame:
    """``docs`` (columns id_col, text, lang and any others but ``names``) with
    perplexity, threshold and verdict under the three ``names``."""
    sample = trusted_sample(docs.select(id_col, "text", "lang"), labels, id_col, max_docs)
    table = fit(sample.where("not held"))
    if not table.take(1):
        blank = F.length(F.trim(F.coalesce("text", F.lit("")))) == 0
        return docs.select("*", F.lit(None).cast("double").alias(names[0]), F.lit(None).cast("double").alias(names[1]),
                           (~blank).alias(names[2]))
    model = shards(table)
    own = stored(log_probability(sample, model, "s").where("s.chars > 0").select("lang", "held", "s.*"))
    level = fresh([*docs.columns, *names], "level")
    at = lambda x: F.col(f"{level}.{x}")
    mean = own.groupBy("lang").agg(F.struct(
        (F.sum("logp") / F.sum("chars")).alias("mean"), F.avg("even").alias("even")
    ).alias(level))
    # Both drawn to the language's means; s is the struct of a document's sums.
    rate = lambda s: -(s("logp") + PRIOR * at("mean")) / (s("chars") + PRIOR)
    even = lambda s: (s("even") * s("words") + EVEN_PRIOR * at("even")) / (s("words") + EVEN_PRIOR)
    placed = own.join(F.broadcast(mean), "lang").select("lang", "held", level, rate(F.col).alias("r"), even(F.col).alias("e"))
    quantiles = lambda rows: F.struct(
        F.percentile(F.when(rows, F.col("r")), F.lit(quantile)).alias("limit"),
        F.percentile(F.when(rows, F.col("e")), F.lit(1 - quantile)).alias("floor"),
    )
    enough = F.sum(F.col("held").cast("int")) >= LEAST_HELD  # too few held-out texts: all of the sample
    levels = placed.groupBy("lang", level).agg(
        F.when(enough, quantiles(F.col("held"))).otherwise(quantiles(F.lit(True))).alias("q")
    )
    use = fresh([*docs.columns, *names], "use")
    levels = stored(levels.select(F.col("lang").alias(use), F.struct(at("mean").alias("mean"), at("even").alias("even"), "q.*").alias(level)))
    langs = [r[0] for r in levels.select(use).collect()]  # one row for each language with a model
    sums = fresh([*docs.columns, *names], "sums")
    scored = log_probability(docs, model, sums).withColumn(use, F.when(F.col("lang").isin(langs), F.col("lang")).otherwise(F.lit(ALL)))
    scored = scored.join(F.broadcast(levels), use, "left")
    of = lambda x: F.col(f"{sums}.{x}")
    threshold = F.pow(F.lit(10.0), at("limit")) * margin
    kept = (of("chars") > 0) & (F.pow(F.lit(10.0), rate(of)) <= threshold) & (even(of) >= at("floor") / even_margin)
    return scored.select(
        *docs.columns, F.when(of("chars") > 0, F.pow(F.lit(10.0), -of("logp") / of("chars"))).alias(names[0]),
        threshold.alias(names[1]), F.coalesce(kept, F.lit(False)).alias(names[2]),
    )


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """``docs`` with perplexity, threshold and kept."""
    names = ("perplexity", "threshold", "kept")
    return judged(docs.select(*(c for c in docs.columns if c.lower() not in names)), labels, names, id_col, **how)


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, in all their columns."""
    names = tuple(fresh(docs.columns, n) for n in ("perplexity", "threshold", "kept"))
    return judged(docs, labels, names, id_col, **how).where(F.col(names[2])).select(*docs.columns)
