"""The quality classifier: probabilities against a plain model, shards, order
and repetition of words, and odd columns."""

import math
import random
import time
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from tollgate.llm import quality_lm
from tollgate.llm.common import prepare

ORDER = 4


class Plain:
    """Modified Kneser-Ney over the characters of texts, by its definition."""

    def __init__(self, texts):
        seen = Counter()
        for t in texts:
            s = f" {' '.join(t.split())} "
            seen.update(s[max(0, i - ORDER + 1) : i + 1] for i in range(1, len(s)) if t.split())
        level = {ORDER: {g: c for g, c in seen.items() if len(g) == ORDER}}
        for k in range(ORDER - 1, 0, -1):
            left = defaultdict(set)
            for g in level[k + 1]:
                left[g[1:]].add(g[0])
            level[k] = {g: len(x) for g, x in left.items()}
            for g, c in seen.items():
                if len(g) == k:
                    level[k][g] = max(c, level[k].get(g, 0))
        self.p, self.weight = {}, {}
        for k in range(1, ORDER + 1):
            times = Counter(level[k].values())
            y = times[1] / max(1, times[1] + 2 * times[2])
            d = {i: min(i - 0.05, max(0.05, i - (i + 1) * y * (times[i + 1] / times[i] if times[i] else 0))) for i in (1, 2, 3)}
            total, mass = Counter(), Counter()
            for g, c in level[k].items():
                total[g[:-1]] += c
                mass[g[:-1]] += d[min(c, 3)]
            for g, c in level[k].items():
                rest = 1 / 4096 if k == 1 else self.p[g[1:]]
                self.p[g] = (c - d[min(c, 3)]) / total[g[:-1]] + mass[g[:-1]] / total[g[:-1]] * rest
            self.weight.update({x: mass[x] / total[x] for x in total})

    def logp(self, text):
        s, out = f" {' '.join(text.split())} ", 0.0
        for i in range(1, len(s) if text.split() else 0):
            gram = s[max(0, i - ORDER + 1) : i + 1]
            while gram and gram not in self.p:
                out += math.log10(self.weight.get(gram[:-1], 1.0))
                gram = gram[1:]
            out += math.log10(self.p[gram]) if gram else -3.612
        return out


def _texts(n, seed, words="the of and to in that house river stone light morning ähre x I".split()):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        own = []
        for _ in range(rnd.randint(1, 12)):  # sentences whose words stand in one order
            own += [*sorted(rnd.choices(words, k=rnd.randint(2, 7))), "."]
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("shard_rows", [1_000_000, 60])
def test_probabilities_equal_the_plain_model(spark, monkeypatch, shard_rows):
    prepare(spark)
    monkeypatch.setattr(quality_lm, "SHARD_ROWS", shard_rows)
    train, test = _texts(80, 1), [*_texts(40, 2), "", "  ", "q", "zz Ж!", "a\nb\tc", "the" * 40, *_texts(3, 1)]
    sample = spark.createDataFrame([("en", t) for t in train], "lang string, text string")
    model = quality_lm.shards(quality_lm.fit(sample))
    assert (len(model) > 1) == (shard_rows < 100)
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(test)], "i int, text string, lang string")
    plain = Plain(train)
    for r in quality_lm.log_probability(docs, model, "s").collect():
        assert math.isclose(r["s"]["logp"], plain.logp(test[r["i"]]), rel_tol=1e-9, abs_tol=1e-9)
        words = test[r["i"]].split()
        assert (r["s"]["words"], r["s"]["chars"]) == (len(words), sum(map(len, words)) + len(words))


def test_order_and_repetition_of_words(spark):
    prepare(spark)
    good = _texts(300, 3)
    long = [" ".join(good[i : i + 4]) for i in range(0, 80, 4)]
    rnd = random.Random(4)
    rows = [(i, t, "en") for i, t in enumerate(good)] + [(1000 + i, t, "en") for i, t in enumerate(long)]
    for i, t in enumerate(long):
        words = t.split()
        rnd.shuffle(words)
        rows += [(2000 + i, " ".join(words), "en"), (3000 + i, " ".join([words[0]] * 300), "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(300)], "doc_id long, quality int, toxic int")
    kept = Counter(r["doc_id"] // 1000 for r in quality_lm.classify(docs, labels).where("kept").collect())
    assert kept[0] >= 295 and kept[1] == 20 and kept[2] <= 2 and kept[3] == 0


def test_columns_of_any_name_ties_and_nulls(spark):
    prepare(spark)
    schema = "kept string, mean int, limit int, doc_id long, text string, lang string, threshold string, s int, held int, __level int, use int"
    texts = _texts(120, 5)
    rows = [("k", 1, 2, i, t, "en", "t", 3, 4, 5, 6) for i, t in enumerate(texts)]
    rows += [rows[0], ("k", 1, 2, None, None, None, "t", 3, 4, 5, 6), ("k", 1, 2, 999, "", "xx", "t", 3, 4, 5, 6)]
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(120)], "doc_id long, quality int, toxic int")
    stay = quality_lm.accepted(docs, labels)
    assert stay.columns == docs.columns
    got = Counter(r["doc_id"] for r in stay.collect())
    assert got[0] == 2 and None not in got and 999 not in got and len(got) >= 115
    out = quality_lm.classify(docs, labels)
    assert out.where("kept").count() == sum(got.values()) and out.count() == len(rows)
    assert quality_lm.accepted(docs.limit(0), labels).count() == 0
    untrained = quality_lm.accepted(docs, labels.limit(0))
    assert untrained.count() == 121 and untrained.columns == docs.columns


def test_counts_and_thresholds_come_from_all_trusted_rows(spark, monkeypatch):
    n = 2_300
    docs = spark.createDataFrame([(i, f"some good words {i}", "en") for i in range(n)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(n)], "doc_id long, quality int, toxic int")
    seen, real = [], quality_lm.trusted_sample
    monkeypatch.setattr(quality_lm, "trusted_sample", lambda *a: seen.append(real(*a)) or seen[-1])
    quality_lm.judged(docs, labels, ("perplexity", "threshold", "kept"))
    assert {r.lang: r["count"] for r in seen[0].groupBy("lang").count().collect()} == {"en": n, quality_lm.ALL: n}
    # A task's bounded counters and the shuffled form give the same counts.
    whole = {(r.lang, r.gram, r.c) for r in quality_lm.word_counts(seen[0]).collect()}
    monkeypatch.setattr(quality_lm, "HELD_WORDS", 50)
    monkeypatch.setattr(quality_lm, "BROADCAST_IDS", 10)
    again = real(docs, labels, "doc_id")
    assert {(r.lang, r.gram, r.c) for r in quality_lm.word_counts(again).collect()} == whole


def test_new_words_cost_no_python_per_character(monkeypatch):
    rnd = random.Random(6)
    texts = [["".join(rnd.choices("abcdefghijklmnopqrstuvwxyzäЖ\0𝄞", k=8)) for _ in range(20)] for _ in range(1_000)]
    plain = Plain([" ".join(x) for x in texts])
    grams = {g: (math.log10(p), None) for g, p in plain.p.items()}
    for g, w in plain.weight.items():
        grams[g] = grams.get(g, (None, None))[0], math.log10(w)
    rows = pa.table({"lang": ["en"] * len(grams), "gram": list(grams), "logp": [x[0] for x in grams.values()], "backoff": [x[1] for x in grams.values()]})
    other = [["".join(rnd.choices("abcdefghijklmnopqrstuvwxyzäЖ\0𝄞q", k=9)) for _ in range(20)] for _ in range(1_000)]
    start = time.process_time()
    want = [plain.logp(" ".join(x)) for x in other]
    by_character = time.process_time() - start
    shard = quality_lm.Shard(rows, 0, 1)
    start = time.process_time()
    got = shard.parts("en", other)
    assert time.process_time() - start < by_character / 3
    assert got == pytest.approx(want, rel=1e-9)
    monkeypatch.setattr(quality_lm, "STEP_CHARS", 1000)  # grams across the steps' ends
    assert shard.parts("en", other) == pytest.approx(want, rel=1e-9)
    few = texts[:50]
    seen = Counter()
    for x in few:
        s = f" {' '.join(x)} "
        seen.update(s[max(0, i - ORDER + 1) : i + 1] for i in range(1, len(s)))
    assert quality_lm.gram_counts([*few, []]) == seen
