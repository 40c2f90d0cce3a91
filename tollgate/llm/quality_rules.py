"""Operator 8: quality rules by tokeniser fertility.

Public vocabularies measure every document: characters per token (byte-level
BPE), the share of byte-fallback tokens (a byte-fallback BPE) and the entropy
of its tokens in bits.  Words are tokenised once per task and their token
lists added up, so whole texts count.  Rejection bands per language come from
trusted documents (quality 1, ``MIN_WORDS`` words or more): the extreme
quantiles of each measure, widened by ``slack`` of their distance from the
median.  A language with fewer than ``LEAST_TRUSTED`` trusted documents, or a
null one, takes the bands of the text's script (that of most of its letters),
and of all trusted documents
where the script has too few; without any trusted document nothing is
rejected by band.

Words are ``[^\\x20\\x09-\\x0D]+``.  Null text has no words and fails the base
rules, as do empty ones.  Null and repeated ids are kept; other columns are
ignored."""

import re
import string
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

SPACE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
#: Words whose tokens a task remembers.
MOST_WORDS = 500_000
LEAST_TRUSTED = 50
MEASURES = ("chars_per_token", "fallback_share", "token_entropy")

LETTERS = string.ascii_letters.encode()
ASCII = re.compile("[\x00-\x7f]+")
#: First words of Unicode names that tell a form, and those that need the next.
FORMS = {"fullwidth", "halfwidth", "modifier", "letter", "small", "capital", "mathematical", "feminine", "masculine"}
TWO_WORDS = {"old", "new", "tai", "linear", "ol", "inscriptional", "psalter", "imperial", "meroitic", "phags-pa"}

_LOADED: dict[str, object] = {}


def fallback_bpe(path: str):
    """(encoder, first and last id of the byte pieces) of a vocabulary file."""
    if path not in _LOADED:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        of = [i for i in range(p.get_piece_size()) if p.is_byte(i)]
        _LOADED[path] = (p, min(of), max(of))
    return _LOADED[path]


def byte_bpe(path: str):
    if path not in _LOADED:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path] = tiktoken.Encoding(
            "public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
    return _LOADED[path]


def repeated_words(w: np.ndarray) -> int:
    """Words in 3-word windows found twice or more, each word once, of a text
    given by its words' numbers."""
    n = len(w)
    if n < 4:
        return 0
    m = int(w.max()) + 1
    if m < 2_000_000:  # three word numbers fit in 63 bits
        key = (w[:-2] * m + w[1:-1]) * m + w[2:]
    else:
        _, pair = np.unique(w[:-1] * m + w[1:], return_inverse=True)
        key = pair[:-1] * m + w[2:]
    order = np.argsort(key)
    same = np.diff(key[order]) == 0
    if not same.any():
        return 0
    again = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[again + k] = True
    return int(hit.sum())


def base_counts(text: str | None, raw: bytes) -> tuple[int, int, int]:
    """word_chars, n_symbols and n_dup_lines of a text and its UTF-8 form."""
    spaces = len(raw) - len(raw.translate(None, SPACE))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip(SPACE)]
    return len(text or "") - spaces, symbols, len(lines) - len(set(lines))


class Words:
    """Numbers of words, with their tokens in both vocabularies; emptied
    between batches when it holds ``MOST_WORDS`` or more."""

    def __init__(self, bpe_path: str, fallback_path: str):
        self.bpe, (self.pieces, self.low, self.high) = byte_bpe(bpe_path), fallback_bpe(fallback_path)
        self.clear()

    def clear(self):
        self.number: dict[bytes, int] = {}
        self.bpe_tokens = self.start = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)  # the fallback vocabulary's tokens, word after word

    def add(self, texts: list[list[bytes]]) -> None:
        if len(self.number) >= MOST_WORDS:
            self.clear()
        new = list(dict.fromkeys(w for words in texts for w in words if w not in self.number))
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
        bpe, flat, length = [], [], []
        for at in range(0, len(new), 5000):
            some = [w.decode() for w in new[at : at + 5000]]
            ids = self.pieces.encode(some, num_threads=1)
            length += map(len, ids)
            flat.append(np.fromiter(chain.from_iterable(ids), np.int32))
            bpe += [len(self.bpe.encode_ordinary(" " + w)) for w in some]
        end = len(self.flat) + np.cumsum(np.array(length, np.int64))
        self.start = np.concatenate([self.start[:-1], [len(self.flat)], end]).astype(np.int64)
        self.flat = np.concatenate([self.flat, *flat])
        self.bpe_tokens = np.concatenate([self.bpe_tokens, np.array(bpe, np.int64)])

    def measures(self, w: np.ndarray, chars: int) -> tuple[float, float, float]:
        """The three measures of a text's word numbers."""
        once, times = np.unique(w, return_counts=True)
        length = self.start[once + 1] - self.start[once]
        before = np.cumsum(length) - length
        ids = self.flat[np.arange(length.sum()) + np.repeat(self.start[once] - before, length)]
        hits = np.bincount(ids, np.repeat(times, length))
        total = hits.sum()
        p = hits[hits > 0] / max(total, 1)
        of_bytes = hits[self.low : self.high + 1].sum()
        return chars / max(self.bpe_tokens[w].sum(), 1), of_bytes / max(total, 1), float(-(p * np.log2(p)).sum())


class Scripts(dict):
    """Scripts of characters by their Unicode names, null for other than letters."""

    def __missing__(self, c: str) -> str | None:
        words = unicodedata.name(c, "").lower().split() if c.isalpha() else []
        while words[1:] and words[0] in FORMS:
            del words[0]
        n = 2 if words and words[0] in TWO_WORDS else 1
        self[c] = found = " ".join(words[:n]) or None
        return found


_SCRIPTS = Scripts()


def script_of(text: str | None, raw: bytes) -> str:
    """The script of most letters of a text, given with its UTF-8 form."""
    counts = Counter(latin=len(raw) - len(raw.translate(None, LETTERS)))
    if len(raw) > len(text or ""):
        for c, n in Counter(ASCII.sub("", text)).items():
            if script := _SCRIPTS[c]:
                counts[script] += n
    best = min(counts, key=lambda x: (-counts[x], x))
    return best if counts[best] else "none"


def measure(docs: DataFrame, bpe_path: str, fallback_path: str) -> DataFrame:
    """Add the base counts, the script and the three measures to (…, text)."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    kind = T.StructType(
        [T.StructField(x, T.LongType()) for x in names] + [T.StructField("script", T.StringType())]
        + [T.StructField(x, T.DoubleType()) for x in MEASURES]
    )

    @F.pandas_udf(kind)
    def all_of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = Words(bpe_path, fallback_path)
        for texts in batches:
            raw = [(t or "").encode() for t in texts]
            words_of = [x.split() for x in raw]
            known.add(words_of)
            rows = []
            for text, own, words in zip(texts, raw, words_of):
                base = base_counts(text, own)
                w = np.fromiter(map(known.number.__getitem__, words), np.int64, len(words))
                values = known.measures(w, base[0]) if words else (None, None, None)
                rows.append((len(words), *base, repeated_words(w), script_of(text, own), *values))
            yield pd.DataFrame(rows, columns=[*names, "script", *MEASURES])

    return docs.withColumn("__m", all_of("text")).select(*docs.columns, "__m.*")


def exact_quantiles(values: DataFrame, by: list[str], x: str, shares: tuple[float, ...]) -> DataFrame:
    """(by, n, q): the number of values and their interpolated percentiles, as
    ``F.percentile`` gives them.  Equal values are counted first, then ranked
    within range partitions, so no task holds all values of a group."""
    counts = values.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count("*").alias("c"))
    dealt = stored(counts.repartitionByRange(*by, x).withColumn("part", F.spark_partition_id()))
    # One row for each partition and group.
    sums = dealt.groupBy("part", *by).agg(F.sum("c").alias("own"))
    sums = sums.withColumn("before", F.sum("own").over(Window.partitionBy(*by).orderBy("part")) - F.col("own"))
    sums = sums.withColumn("n", F.sum("own").over(Window.partitionBy(*by))).drop("own")
    ranked = dealt.join(sums, ["part", *by])
    ranked = ranked.withColumn("end", F.col("before") + F.sum("c").over(Window.partitionBy("part", *by).orderBy(x)))
    picked, q = [], []
    for i, share in enumerate(shares):
        at = (F.col("n") - 1) * F.lit(share)
        for name, rank in ((f"lo{i}", F.floor(at)), (f"hi{i}", F.ceil(at))):
            here = (rank < F.col("end")) & (rank >= F.col("end") - F.col("c"))
            picked.append(F.max(F.when(here, F.col(x))).alias(name))
        lo, hi = F.col(f"lo{i}"), F.col(f"hi{i}")
        q.append(F.when(lo == hi, lo).otherwise((F.ceil(at) - at) * lo + (at - F.floor(at)) * hi))
    return ranked.groupBy(*by, "n").agg(*picked).select(*by, "n", F.array(*q).alias("q"))


def bands(measured: DataFrame, tail: float, slack: float) -> DataFrame:
    """(level, value, lo_/hi_ of each measure) from trusted measured rows."""
    places = F.array(
        F.struct(F.lit("lang").alias("level"), F.col("lang").alias("value")),
        F.struct(F.lit("script").alias("level"), F.col("script").alias("value")),
        F.struct(F.lit("all").alias("level"), F.lit("").alias("value")),
    )
    each = measured.select(F.explode(places).alias("place"), *MEASURES).where("place.value is not null")
    each = each.select("place.level", "place.value", F.explode(F.array(
        *(F.struct(F.lit(m).alias("measure"), F.col(m).alias("x")) for m in MEASURES)
    )).alias("m")).select("level", "value", "m.measure", "m.x")
    found = exact_quantiles(each, ["level", "value", "measure"], "x", (tail, 0.5, 1 - tail))
    grouped = found.where(F.col("n") >= LEAST_TRUSTED).groupBy("level", "value").agg(
        *(F.max(F.when(F.col("measure") == m, F.col("q"))).alias(m) for m in MEASURES)
    )
    limits = []
    for m in MEASURES:
        lo, mid, hi = (F.col(m)[i] for i in range(3))
        room = F.greatest(slack * (hi - lo), 0.02 * F.abs(mid), F.lit(0.01))
        limits += [(lo - room).alias(f"lo_{m}"), (hi + room).alias(f"hi_{m}")]
    return grouped.select("level", "value", *limits)


def judge(
    docs: DataFrame, labels: DataFrame, bpe_path: str, fallback_path: str, id_col: str = "doc_id",
    tail: float = 0.002, slack: float = 0.5,
) -> DataFrame:
    """(id_col, counts, measures, base_failed, kept) of every row."""
    measured = stored(
        measure(docs.select(F.col(id_col).alias("id"), "text", F.col("lang").cast("string").alias("lang")), bpe_path, fallback_path).drop("text")
    )
    good = labels.where("quality = 1").select(F.col("doc_id").alias("good")).distinct()
    trusted = measured.where(F.col("n_words") >= MIN_WORDS).join(good, F.col("id") == F.col("good"), "left_semi")
    found = stored(bands(trusted, tail, slack))
    out = measured
    for level, value in (("lang", F.col("lang")), ("script", F.col("script")), ("all", F.lit(""))):
        own = found.where(F.col("level") == level).select(
            F.col("value").alias(f"{level}_v"),
            F.struct(*(F.col(f"{e}_{m}") for m in MEASURES for e in ("lo", "hi"))).alias(f"{level}_band"),
        )
        # Bands exist for values with trusted rows in the sample of labels only.
        out = out.join(own, value == F.col(f"{level}_v"), "left").drop(f"{level}_v")
    band = F.coalesce("lang_band", "script_band", "all_band")
    inside = F.lit(True)
    for m in MEASURES:
        inside = inside & F.coalesce(F.col(m).between(band[f"lo_{m}"], band[f"hi_{m}"]), F.lit(True))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *MEASURES,
        failed.alias("base_failed"), (~failed & inside).alias("kept"),
    )
