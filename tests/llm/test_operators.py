"""The training-data operators against brute force on small fixtures, with
nulls, empty and blank texts, ties, repeated rows, clashing columns and empty
tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from tollgate.llm import bpe, embed_join, langid, lm_mixing, mixing, ngram_join, pii, quality_lm, quality_rules, warc
from tollgate.llm.common import connected_components, prepare
from tollgate.llm.queries import PUBLIC_KEY, vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string, block int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _corpus():
    rnd = random.Random(5)
    vocabulary_ = {"en": "the of and to in that house river stone light morning".split(),
                   "de": "der und die das nicht haus fluss stein licht morgen ähre".split()}
    rows = []
    for i in range(120):
        lang = ("en", "de")[i % 2]
        words = [rnd.choice(vocabulary_[lang]) + rnd.choice(["", "", "s", "er"]) for _ in range(rnd.randint(3, 120))]
        rows.append([i, " ".join(words) + ".\nEnd.", lang, f"s{i % 3}"])
    base = rows[7][1].split(" ")
    for k in range(6):  # near copies, then exact ones, then repeated rows
        rows.append([200 + k, " ".join(base[:-2] + [f"tail{k}"] + base[-1:]), "de", "s0"])
        rows.append([300 + k, rows[8][1], "en", "s0"])
    rows += [rows[9], [400, None, None, None], [401, "", "en", "s1"], [402, " \n\t ", None, "s1"], [None, rows[10][1], "en", None],
             [403, "one two", "en", "s2"], [404, "漢字 <|endoftext|> é x  y", None, "s2"], [405, "x" * 30_000, "en", "s2"]]
    return [(*r, None if r[1] is None else len(r[1]), "clash", "clash", 1) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    prepare(spark)
    return spark.createDataFrame(_corpus(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    prepare(spark)
    return spark.createDataFrame([], DOCS)


def _tokens(text):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return WORD.findall((text or "").translate(lower))


def _components(n, links):
    root = list(range(n))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[max(top(a), top(b))] = min(top(a), top(b))
    return [top(x) for x in range(n)]


def test_components_of_a_path_and_a_star(spark):
    prepare(spark)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect())
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}}


def test_near_duplicates_equal_all_pairs(spark, docs, none):
    rows = [(r[0], r[1]) for r in _corpus()]
    sets = []
    for _, t in rows:
        w = _tokens(t)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    part = _components(len(rows), links)
    least = {p: min((rows[i][0] for i in range(len(rows)) if part[i] == p and rows[i][0] is not None), default=None) for p in part}
    want = collections.Counter((r[0], len(s), least[p] if s else r[0]) for r, s, p in zip(rows, sets, part))
    got = collections.Counter(tuple(r) for r in ngram_join.near_duplicates(docs).collect())
    assert got == want
    assert ngram_join.near_duplicates(none).count() == 0
    kept = [r["doc_id"] for r in ngram_join.deduplicated(docs).select("doc_id").collect()]
    assert {400, 401, 402, 403} <= set(kept) and kept.count(9) == 1 and not {301, 302} & set(kept)


def test_linked_sets_share_a_segment():
    rnd = np.random.default_rng(1)
    for _ in range(400):
        u = np.unique(rnd.integers(0, 2**63, int(rnd.integers(6, 300))).astype(np.uint64) * np.uint64(2))
        gone = rnd.permutation(len(u))[: len(u) // 5]
        k = int(rnd.integers(0, len(gone) + 1))
        a, b = np.delete(u, gone[:k]), np.delete(u, gone[k:])
        if min(len(a), len(b)) >= ngram_join.SMALLEST and not np.array_equal(a, b):
            assert len(np.intersect1d(ngram_join.segment_keys(a), ngram_join.segment_keys(b)))


def test_bpe_equals_the_library(docs, none):
    path = vocabulary("byte_bpe_50k.json")
    t = bpe.tokenizer(path)
    got = collections.Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in bpe.decode(bpe.encode(docs, path), path).collect())
    ids = lambda x: t.encode(x or "", add_special_tokens=False).ids
    want = collections.Counter((r[0], tuple(ids(r[1])), t.decode(ids(r[1]), skip_special_tokens=False)) for r in _corpus())
    assert got == want
    assert bpe.encode(none, path).count() == 0


def test_lm_base_counts_and_gain(docs, none):
    rows = [(r[0], _tokens(r[1])) for r in _corpus()]
    crc = lambda i: zlib.crc32(("" if i is None else str(i)).encode())
    c = collections.Counter(w for i, t in rows if crc(i) % 10 for w in [*t, None])
    n, v = sum(c.values()), len(c)
    got = lm_mixing.score(docs).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    for i, t in rows:
        r, t = by_id[i], [*t, None]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (crc(i) % 10 == 0, len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), rel_tol=1e-9)
        assert r["score"] < 0
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)
    assert lm_mixing.score(none).count() == 0


def test_language_id(docs, none):
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    rows = {r[0]: r for r in _corpus()}
    assert all(got[i]["lang_pred"] == rows[i][2] for i in range(120))
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (400, 401, 402))
    assert langid.identify(none).count() == 0


def test_quality_classifier(spark, docs, none):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(120)], "doc_id long, quality int, toxic int")
    junk = spark.createDataFrame([(900, "Qx$$$ zzgk### vvv%%% &&&q xxq*** " * 20, "en", "s", 1, "", "", 1)], DOCS)
    out = quality_lm.classify(docs.select("doc_id", "text", "lang").unionByName(junk.select("doc_id", "text", "lang")), labels)
    got = {r["doc_id"]: r for r in out.collect()}
    assert sum(not got[i]["kept"] for i in range(120)) <= 2
    assert not got[900]["kept"] and not got[400]["kept"] and got[402]["perplexity"] is None
    assert quality_lm.classify(none.select("doc_id", "text", "lang"), labels).count() == 0


def test_quality_rules_base_counts(spark, docs):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(120)], "doc_id long, quality int, toxic int")
    out = quality_rules.judge(docs, labels, vocabulary("byte_bpe_multi_50k.tiktoken"), vocabulary("piece_bpe_32k.model"))
    got = {r["doc_id"]: r for r in out.collect()}
    for i, text, *_ in _corpus():
        w = WORD.findall(text or "")
        windows = collections.Counter(zip(w, w[1:], w[2:]))
        hit = {k + d for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for d in range(3)}
        seen, dup = set(), 0
        for line in (text or "").split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), dup, len(hit))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(hit) > 50 * len(w))
        assert not (r["base_failed"] and r["kept"])


def test_embeddings_equal_all_pairs(spark):
    prepare(spark)
    rnd = np.random.default_rng(2)
    base = rnd.normal(size=(12, 8))
    rows = [(i, (base[i % 12] + rnd.normal(size=8) * 0.25).tolist()) for i in range(150)]
    rows += [(200 + i, rows[0][1]) for i in range(5)] + [(300, None), (301, [0.0] * 8), (302, [float("nan")] + [1.0] * 7), (303, [1.0, 2.0]), (304, [])]
    x = {i: np.array(v) for i, v in rows if v and len(v) == 8 and np.isfinite(v).all() and any(v)}
    ids = sorted(x)
    links = [(a, b) for a in range(len(ids)) for b in range(a)
             if x[ids[a]] @ x[ids[b]] / (np.linalg.norm(x[ids[a]]) * np.linalg.norm(x[ids[b]])) >= 0.9]
    part, count = _components(len(ids), links), collections.Counter(k for p in links for k in p)
    want = {i: (count[k], ids[part[k]]) for k, i in enumerate(ids)} | {i: (0, i) for i, _ in rows if i not in x}
    old, embed_join.TILE = embed_join.TILE, 40
    try:
        out = embed_join.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    finally:
        embed_join.TILE = old
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in out} == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out)


def test_surrogates(spark, docs):
    text = "Mrs Anna Keller <nt.26@mail7.example.com>, +1 (017) 555-7713, 4111-1111-1111-1111, 64.147.79.24; Mrs Keller. NT.26@MAIL7.EXAMPLE.COM"
    rows = [(1, text, "en", "s", 1, "", "", 1), (2, "mail nt.26@mail7.example.com", "en", "s", 1, "", "", 1), (3, None, None, None, None, None, None, 1),
            (4, "nothing here, 1 2 3", "en", "s", 1, "", "", 1)]
    got = {r["doc_id"]: r for r in pii.replace(spark.createDataFrame(rows, DOCS), PUBLIC_KEY).collect()}
    new = got[1]["text"]
    for secret in ("Anna", "Keller", "nt.26", "555-7713", "4111-1111", "64.147.79.24", "NT.26"):
        assert secret not in new
    assert got[3]["text"] is None and got[4]["text"] == rows[3][1] and got[4]["n_entities"] == 0
    mail = got[2]["text"].split()[1]
    assert mail in new and mail.upper() in new and got[1]["n_chars"] == len(new)
    surname = re.search(r"Mrs (\w+) (\w+) <", new)
    assert surname and f"Mrs {surname[2]}." in new and surname[1] in pii.GIVEN["f", "latin"]
    assert pii.luhn(re.sub(r"\D", "", re.search(r"\d{4}-\d{4}-\d{4}-\d{4}", new)[0]))
    assert pii.replace(docs, PUBLIC_KEY).count() == len(_corpus())


def test_mixing_uses_every_document_and_the_quota(docs, none):
    out = mixing.schedule(docs, max_repeats=1.5).collect()
    assert {r["doc_id"] for r in out} == {r[0] for r in _corpus()}
    used, own = collections.Counter(), collections.Counter()
    for r in out:
        used[r["source"]] += r["tokens"]
    for _, text, _, source, *_ in _corpus():
        own[source] += max(1, len(WORD.findall(text or "")))
    assert all(own[s] <= used[s] <= 1.5 * own[s] + max(r["tokens"] for r in out) for s in own)
    assert mixing.schedule(none).count() == 0
    assert mixing.mixed(docs).columns == docs.columns


def test_revisits(spark):
    prepare(spark)
    old = [("ETag", '"a"'), ("Content-Length", "5"), ("Server", "x")]
    new = [("etag", 'W/"a"'), ("Cache-Control", "no-store"), ("Content-Length", "0"), ("Connection", "X-Hop"), ("X-Hop", "1")]
    rows = [
        (1, "response", "http://Ex.org:80/p?b=2&a=1#f", 10, 200, old, "body"), (2, "response", "http://ex.org/p?a=1&b=2", 20, 404, [], "gone"),
        (3, "revisit", "http://ex.org/p?a=1&b=2", 30, 304, new, None), (3, "revisit", "http://ex.org/p?a=1&b=2", 30, 304, new, None),
        (4, "revisit", "http://ex.org/p?a=1&b=2", 10, 304, new, None), (5, "revisit", "http://ex.org/p?a=1&b=2", 40, 304, [("ETag", '"z"')], None),
        (6, "revisit", "http://ex.org/p?a=1&b=2", 40, 304, None, None), (7, "revisit", None, 40, 304, new, None),
    ]
    schema = f"record_id long, kind string, uri string, ts long, status int, headers {warc.HEADERS}, payload string"
    got = sorted((r["record_id"], r["outcome"], r["payload"]) for r in warc.resolve(spark.createDataFrame(rows, schema)).collect())
    assert [(a, b) for a, b, _ in got] == [(3, "resolved"), (3, "resolved"), (4, "no_earlier_response"), (5, "validator_mismatch"),
                                           (6, "no_validator"), (7, "unplaced")]
    done = warc.resolve(spark.createDataFrame(rows, schema)).where("record_id = 3").first()
    assert done["payload"] == "body"
    assert [tuple(h) for h in done["headers"]] == [("Content-Length", "5"), ("Server", "x"), ("etag", 'W/"a"'), ("Cache-Control", "no-store")]
    assert warc.resolve(spark.createDataFrame([], schema)).count() == 0
