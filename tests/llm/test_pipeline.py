"""The pipeline on a small corpus: which documents stay, what their texts
hold, and their tokens, against brute force."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from tollgate.llm.bpe import tokenizer
from tollgate.llm.queries import vocabulary


def test_pipeline(spark, tmp_path):
    rnd = random.Random(3)
    words = [a + b for a in "the and house river stone light morning garden".split() for b in ("", "s", "ing")]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(90)), "en", f"s{i % 3}") for i in range(90)]
    rows.append((500, rows[4][1] + " extra", "en", "s0"))  # near copies of 4 and 5
    rows.append((501, rows[5][1], "en", "s1"))
    rows.append((502, " ".join("Qz$$$ zgk### vvv%%%" for _ in range(40)), "en", "s2"))  # junk
    rows.append((503, rows[6][1][::-1].replace("g", "s") + " ask ann.7@mail1.example.com now", "en", "s1"))
    rows[8] = (8, rows[8][1] + " ask ann.7@mail1.example.com now", "en", "s2")
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(90)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) - {503} == set(range(90))  # 503 may be rejected; 500-502 must be
    t, text = tokenizer(vocabulary("byte_bpe_50k.json")), dict((r[0], r[1]) for r in rows)
    for i, r in out.items():
        assert r["ids"] == t.encode(r["decoded"], add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"])
        assert "ann.7@mail1.example.com" not in r["decoded"]
        if i not in (8, 503):
            assert r["decoded"] == text[i]
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality classifier"
    kept = corpus_pipeline.quality(spark, docs.limit(0), str(tmp_path))
    assert kept.columns == docs.columns and kept.agg(F.count("*")).first()[0] == 0
