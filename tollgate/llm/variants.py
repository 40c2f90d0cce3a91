"""Spelling variants of a word list by permuterm rotations.

Every word is closed by a terminator and rotated to each of its places.  Words
that differ in one replaced letter have, with that letter turned to the end,
rotations that agree in all before it; a word with one letter less is itself
that shared beginning.  With the edited letter skipped, each such range of the
sorted rotations is one key:

    words  p c s   ->  key  s$p  skipping c     (one row per letter)
    words  p s     ->  key  s$p  skipping none  (one row per cut)

Spark shuffles and sorts the rotations by key; a scan over each key counts the
near words and finds the best of them.  A key holds one word per letter of the
alphabet and the shorter word, so no group grows with the input, and no pair is
written: a word's links over all its keys meet in one partial aggregation.  An
insertion into a run of one letter has a key at each place of the run; it
counts only where the letter before differs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Closes a word; letters never equal it.
END = "\x00"
RUNS = "[A-Za-z\\u00C0-\\u00FF]{%d,}"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_slips(doc_id: Column, run: Column) -> Column:
    """The run, or, where 31 divides the crc32 of ``<doc_id>:<run>``, the run
    without its code point crc32 % length (from 0).  A null id is empty."""
    crc = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(crc, F.length(run)).cast("int")
    return F.when(
        crc % 31 == 0, F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2, F.length(run)))
    ).otherwise(run)


def word_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 7, least_n: int = 2
) -> DataFrame:
    """(word, n): letter runs of whole texts with planted slips, of at least
    ``least_length`` code points and ``least_n`` occurrences.

    Shorter runs cannot give a word (slips only shorten), so the pattern leaves
    them out.  Counting is pre-aggregated in every task.  Null and empty texts
    hold no word."""
    runs = docs.select(
        F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(RUNS % least_length), F.lit(0))).alias("run")
    ).select("id", F.translate("run", UPPER, LOWER).alias("run"))
    words = runs.select(with_slips(F.col("id"), F.col("run")).alias("word"))
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


def rotations(words: DataFrame) -> DataFrame:
    """(key, skipped, n): for a word of L letters, L + 1 whole rotations
    (nothing skipped) and L with the last letter skipped."""
    length, at = F.length("word"), F.col("at")
    whole = at <= length
    cut = F.when(whole, at).otherwise(at - length - 1)
    rows = words.select("word", "n", F.explode(F.sequence(F.lit(0), 2 * length)).alias("at"))
    return rows.select(
        F.concat(
            F.substr("word", F.when(whole, cut + 1).otherwise(cut + 2), length), F.lit(END), F.substr("word", F.lit(1), cut)
        ).alias("key"),
        F.when(whole, F.lit("")).otherwise(F.substr("word", cut + 1, F.lit(1))).alias("skipped"),
        "n",
    )


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, best struct<less, word>) for every word with a near word
    and key: sums and least structs over a word's rows give its whole result.

    ``less`` is minus the count, so the least struct is the most frequent near
    word, ties by code point."""
    sorted_by_key = rotations(words).repartition("key")
    before = F.substring_index("key", END, -1)
    members = sorted_by_key.select(
        "key", "skipped", "n",
        F.concat(before, "skipped", F.substring_index("key", END, 1)).alias("word"),
        F.substring(before, -1, 1).alias("run"),  # the letter before the edit
    )
    ranked = Window.partitionBy("key").orderBy(F.desc("n"), "word")
    key = ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    entry = F.struct((-F.col("n")).alias("less"), "word", "skipped")
    seen = members.select(
        "*", F.count("*").over(key).alias("m"),
        *(F.nth_value(entry, k).over(key).alias(f"top{k}") for k in (1, 2, 3)),
        F.max(F.col("skipped") == "").over(key).alias("has_whole"),
        F.max((F.col("skipped") == F.col("run")) & (F.col("run") != "")).over(key).alias("has_run"),
    ).where("m > 1")
    # The one pair of a key that another key counts: the shorter word and the
    # word whose skipped letter repeats the letter before it.
    repeats = (F.col("run") != "") & (F.col("skipped") == F.col("run"))
    apart = F.col("has_whole") & F.col("has_run") & ((F.col("skipped") == "") | repeats)
    other = F.when(F.col("skipped") == "", F.col("run")).when(repeats, F.lit(""))

    def counts(k: int) -> Column:
        top = F.col(f"top{k}")
        return top.isNotNull() & (top["skipped"] != F.col("skipped")) & ~(apart & (top["skipped"] == other))

    best = F.when(counts(1), F.col("top1")).when(counts(2), F.col("top2")).when(counts(3), F.col("top3"))
    return seen.select(
        "word", (F.col("m") - 1 - apart.cast("int")).alias("n_near"), F.struct(best["less"].alias("less"), best["word"].alias("word")).alias("best")
    ).where("n_near > 0")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form) links by doubling: every round follows
    twice as many.  A form is at least ten times as frequent, so there are no
    cycles, and rounds grow with the logarithm of the digits of the counts."""
    now = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = stored(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        now = step.select("word", "root")
        if not step.where("moved").limit(1).count():
            return now


def group_variants(words: DataFrame, factor: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a (word, n) list.

    Near words differ by exactly one inserted, deleted or replaced code point.
    ``form`` is the near word of largest n (ties: smallest in code-point order)
    if that n is at least ``factor`` times the word's, else null; ``root``
    follows forms to the last (the word itself if none).  Repeated words count
    as one with the sum of their n; null words are left out; words that hold
    the terminator have no near words; an empty list gives an empty result.
    Other columns of ``words`` play no part."""
    listed = stored(words.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").cast("long").alias("n")))
    none = F.lit(None).cast("struct<less:bigint,word:string>")
    links = neighbours(listed.where(~F.contains("word", F.lit(END)))).unionByName(listed.select("word", F.lit(0).alias("n_near"), none.alias("best")))
    near = links.groupBy("word").agg(F.sum("n_near").cast("long").alias("n_near"), F.min("best").alias("best"))
    has_form = -F.col("best.less") >= factor * F.col("n")
    formed = stored(near.join(listed, "word").select(
        "word", F.when(has_form, F.col("best.word")).alias("form"), "n", "n_near", F.when(has_form, -F.col("best.less")).alias("form_n"),
    ))
    last = roots(formed.where("form IS NOT NULL"))
    return formed.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
