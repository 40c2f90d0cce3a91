"""Cases in which an operator once did less than its whole job."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tollgate.llm import mixing, ngram_join, pii, quality_rules, warc
from tollgate.llm.common import prepare, stored


@pytest.mark.parametrize("before, after", ["()", '""', "[]", "''", "«»", "-,", ":.", "_ ", "\n "])
@pytest.mark.parametrize("gap", [" ", "  ", "\n", "\t", " ", " \r\n "])
@pytest.mark.parametrize("start", ["Anna", "Mrs", "Dr.", "Г-жа", "Пётр", "Jean-Pierre", "Karl-Peter"])
def test_names_beside_marks_and_over_white_space(before, after, gap, start):
    text = f"seen by{before}{start}{gap}Zorn{gap}Adler{after} today"
    found = {text[a:b] for a, b, kind, _ in pii.entities(text) if kind == "name"}
    assert found == {"Zorn", "Adler"} | ({start} - pii.TITLES)


def test_no_names_inside_words():
    assert not pii.entities("Annabel Zorn, xMrs Zorn, Peter1 Zorn, Anna said, Mrs, Zorn")


def _drawn(spark, rows):
    out = pii.surrogates(spark.createDataFrame(rows, "kind string, entity string"), b"key").collect()
    got = {(r["kind"], r["entity"]): r["surrogate"] for r in out}
    assert set(got) == set(rows) and len(set(got.values())) == len(got) and not set(got.values()) & {e for _, e in rows}
    return got


def test_given_names_keep_their_gender_when_all_occur(spark):
    prepare(spark)
    groups = {n.casefold(): g for g, names in pii.LISTED.items() for n in names}
    own = {g: {n.casefold() for n in names} for g, names in pii.SURROGATES.items()}
    for seen in ([], [n for names in own.values() for n in names]):  # also with every stand-in taken
        got = _drawn(spark, [("name", n) for n in [*groups, *seen]])
        for name, group in groups.items():
            assert set(got["name", name].split("-")) <= own[group]
    assert not pii._STARTS & {n for names in pii.SURROGATES.values() for n in names}


def test_a_full_private_range_widens(spark):
    prepare(spark)
    rows = [("ipv4", f"192.168.{a}.{b}") for a in range(160) for b in range(256)]
    rows += [("ipv4", f"172.20.{a}.{b}") for a in range(160) for b in range(256)] + [("ipv4", "172.217.3.4"), ("ipv4", "8.8.8.8")]
    got = _drawn(spark, rows)
    private = ("192.168.", "10.", *(f"172.{b}." for b in range(16, 32)))
    assert all(new.startswith(private) for (_, old), new in got.items() if old.startswith(private))
    assert got["ipv4", "172.217.3.4"].startswith("172.217.")


def test_copies_spread_over_the_shards_with_one_sketch(spark):
    prepare(spark)
    text = " ".join(f"w{i}" for i in range(400))
    docs = spark.createDataFrame([(i, text) for i in range(600)], "id long, text string").coalesce(1)
    rows = ngram_join.dealt(docs, 6).where("n is not null").groupBy("shard").count().collect()
    assert sorted(r["count"] for r in rows) == [100] * 6
    assert ngram_join.dealt(docs, 6).where("sketch is not null").count() == 1
    out = ngram_join.near_duplicates(docs, "id").collect()
    assert len(out) == 600 and all(r["component_id"] == 0 for r in out)


def test_texts_that_share_an_id_stay(spark):
    prepare(spark)
    text = lambda k: " ".join(f"{k}{i}" for i in range(60))
    rows = [(1, text("a")), (5, text("b")), (5, text("c")), (5, text("c")), (5, text("c") + " more"), (5, text("a")), (5, None),
            (5, " "), (6, text("b")), (6, text("d")), (7, text("b")), (7, text("a")), (None, text("a")), (8, text("e"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, (r["text"] or "").strip()[:2]) for r in ngram_join.deduplicated(docs).collect())
    assert got == [(0, "a0"), (1, "a0"), (5, ""), (5, "b0"), (5, "c0"), (6, "d0"), (8, "e0")]


@pytest.mark.parametrize("text, script", [
    ("α is the first letter of it", "latin"), ("Москва: the city of the river", "latin"), ("x это простой текст", "cyrillic"),
    ("漢字一二三丁七万丈", "cjk"), ("한국어 문장 가나다", "hangul"), ("힣각 글", "hangul"), ("ＡＢＣ", "latin"), ("12 ?!", "none"), ("", "none"), (None, "none"),
])
def test_script_of_most_letters(text, script):
    assert quality_rules.script_of(text, (text or "").encode()) == script


def test_quantiles_equal_percentile(spark):
    prepare(spark)
    rnd = np.random.default_rng(4)
    rows = [(k, float(v)) for k, n in (("a", 400), ("b", 7), ("c", 1)) for v in rnd.normal(size=n).round(1 if k == "a" else 9)]
    df = spark.createDataFrame([*rows, ("a", None)], "k string, x double").repartition(5)
    got = {r["k"]: (r["n"], r["q"]) for r in quality_rules.exact_quantiles(df, ["k"], "x", (0.002, 0.5, 0.998)).collect()}
    for k in "abc":
        x = [v for key, v in rows if key == k]
        assert got[k][0] == len(x) and np.allclose(got[k][1], np.percentile(x, [0.2, 50, 99.8]), rtol=0, atol=1e-12)


def test_columns_of_any_name_stay(spark):
    prepare(spark)
    schema = ("id string, epochs int, __mark string, __id int, __hit int, key int, f1 int, row string, doc_id long, text string, "
              "source string, mark string, p int, __p int, component int")
    text = " ".join(f"w{i}" for i in range(60))
    rows = [("x", 1, "m", 2, 3, 4, 5, "r", i, text if i < 3 else f"{text} {i}" if i < 5 else f"{i} other words here {i}", "s", "k", 6, 7, 8)
            for i in range(8)] + [("x", 1, "m", 2, 3, 4, 5, "r", None, None, None, "k", 6, 7, 8)]
    docs = spark.createDataFrame(rows, schema)
    once = ngram_join.deduplicated(docs)
    assert once.columns == docs.columns
    assert sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in once.collect()) == [-1, 0, 5, 6, 7]
    assert all(tuple(r) in rows for r in once.collect())
    mix = mixing.mixed(docs, max_repeats=1.5)
    assert mix.columns == docs.columns and set(map(tuple, mix.collect())) == set(rows)


def test_responses_that_repeat_an_id(spark):
    prepare(spark)
    schema = f"record_id long, kind string, uri string, ts long, status int, headers {warc.HEADERS}, payload string, body string, ref_id int"
    tag = lambda x: [("ETag", f'"{x}"')]
    u, v = "http://e.org/p", "http://e.org/q"
    rows = [(1, "response", u, 10, 200, tag("a"), "old", "", 0), (1, "response", u, 20, 200, tag("b"), "new", "", 0),
            (1, "response", v, 20, 200, tag("b"), "other page", "", 0), (1, "response", u, 20, 200, tag("b"), "newer", "", 0),
            (2, "revisit", u, 30, 304, tag("b"), None, "", 0), (3, "revisit", u, 30, 304, tag("a"), None, "", 0),
            (4, "revisit", u, 20, 304, tag("a"), None, "", 0), (5, "response", v, 25, 200, tag("c"), "c", "", 0),
            (6, "response", v, 25, 200, tag("d"), "d", "", 0), (7, "revisit", v, 26, 304, tag("d"), None, "", 0)]
    for parts in (1, 5):
        got = {r["record_id"]: (r["outcome"], r["payload"]) for r in warc.resolve(spark.createDataFrame(rows, schema).repartition(parts)).collect()}
        assert got == {2: ("resolved", "new"), 3: ("validator_mismatch", None), 4: ("resolved", "old"), 7: ("resolved", "d")}


def test_bodies_are_shuffled_once(spark):
    prepare(spark)
    columns = "record_id long, kind string, uri string, ts long, status int, headers array<struct<name:string,value:string>>, payload string"
    tag, date = [("ETag", "a")], [("Last-Modified", "d")]
    rows = [
        (1, "response", "http://a/", 10, 200, tag, "one"),
        (2, "revisit", "http://a/", 20, 304, tag, None),
        (3, "response", "http://b/", 10, 200, date, "two"),  # a reference without an entity tag
        (4, "revisit", "http://b/", 20, 304, date, None),
        (None, "response", "http://c/", 10, 200, tag, "three"),
        (6, "revisit", "http://c/", 20, 304, tag, None),
    ]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        records = spark.createDataFrame(rows, columns).withColumn("ts", F.coalesce("ts", F.lit(0)))  # never null
        out = warc.resolve(records)
        assert sorted((r["record_id"], r["payload"]) for r in out.collect()) == [(2, "one"), (4, "two")]
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    shuffles = re.findall(r"Exchange hashpartitioning\(\w*", plan.split("Initial Plan")[0])
    assert [s for s in shuffles if s.endswith(("(at", "(body_of", "(ref_id", "(cast"))] == ["Exchange hashpartitioning(at"]


def test_rows_between_components_do_not_grow_with_pairs(spark):
    prepare(spark)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join([*base, f"x{k}"]) for k in range(40)]
    codes = [ngram_join.element_codes(t) for t in texts]
    f = [ngram_join.fingerprint(c) for c in codes]
    classes = spark.createDataFrame(
        [(i, x, len(c), bytearray(ngram_join.parity_sketch(c))) for i, (x, c) in enumerate(zip(f, codes))],
        "rep long, f1 long, n long, sketch binary",
    )
    live = spark.createDataFrame([(7, x) for x in f], "key long, set long")
    parts = spark.createDataFrame([(x, min(f[:20])) for x in f[:20]], "node long, component long")
    none = spark.createDataFrame([], "a long, b long")
    rows = ngram_join.between_components(live, parts, classes, none, 1).collect()
    assert 0 < len(rows) <= 21  # of 21 components, 590 pairs of sets
    assert {c for r in rows for c in (r.ca, r.cb)} - {None} == {min(f[:20]), *f[20:]}
    seen = set()
    while True:  # without what was rejected all pairs come in turn, each once
        gone = spark.createDataFrame(sorted(seen), "a long, b long")
        more = {(r.a, r.b) for r in ngram_join.between_components(live, parts, classes, gone, 200).collect()}
        if not more:
            break
        assert not more & seen
        seen |= more
    apart = {tuple(sorted((x, y))) for i, x in enumerate(f) for j, y in enumerate(f) if i < j and j >= 20}
    assert seen == apart


def test_groups_of_near_copies_give_few_rows_between_components(spark, monkeypatch):
    prepare(spark)
    rnd = random.Random(8)
    texts = []
    for _ in range(150):  # copies with some words replaced: most are linked, all meet in many groups
        words = [f"w{i}" for i in range(300)]
        for i in rnd.sample(range(300), rnd.randint(3, 9)):
            words[i] = f"x{rnd.random()}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    real, rows = ngram_join.between_components, []

    def counted(live, parts, classes, rejected, most):
        found = stored(real(live, parts, classes, rejected, most))
        rows.append(found.count())
        return found

    monkeypatch.setattr(ngram_join, "between_components", counted)
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(docs).collect()}
    sets = [set(ngram_join.element_codes(t).tolist()) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    assert got == dict(enumerate(root))
    assert sum(rows) <= 4 * len(texts), rows


def test_members_without_a_pair_leave_their_group(spark):
    prepare(spark)
    base = [f"w{i}" for i in range(200)]
    texts = [*(" ".join([*base, f"x{k}"]) for k in range(3)), " ".join(f"y{i}" for i in range(201))]
    codes = [ngram_join.element_codes(t) for t in texts]
    f = [ngram_join.fingerprint(c) for c in codes]
    classes = spark.createDataFrame(
        [(i, x, len(c), bytearray(ngram_join.parity_sketch(c))) for i, (x, c) in enumerate(zip(f, codes))],
        "rep long, f1 long, n long, sketch binary",
    )
    live = spark.createDataFrame([(7, x) for x in f], "key long, set long")
    parts = spark.createDataFrame([(x, min(f[:2])) for x in f[:2]], "node long, component long")
    none = spark.createDataFrame([], "a long, b long")
    rows = ngram_join.between_components(live, parts, classes, none, 1).collect()
    assert [set(r.tried) for r in rows if r.tried] == [set(f[:3])]  # all sets of a pair, taken or not
    gone = spark.createDataFrame([tuple(sorted((f[0], f[2])))], "a long, b long")
    rows = ngram_join.between_components(live, parts, classes, gone, 1).collect()
    assert [set(r.tried) for r in rows if r.tried] == [set(f[1:3])]
