"""Spelling variants, conversation repair and substring dedup against brute
force, with nulls, empty and repeated rows, ties, empty tables and clashing
columns."""

import collections
import hashlib
import heapq
import random
import re
import zlib

import pytest

from tollgate.llm import dialogue, substrings, variants
from tollgate.llm.common import prepare

CHAR = re.compile(r"[^\x20\x09-\x0D]")


def _near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _variants(counts, factor=10):
    near = {w: [v for v in counts if _near(w, v)] for w in counts}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= factor * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts.get(form[w])))
    return out


def test_variants_equal_brute_force(spark):
    prepare(spark)
    rnd, counts = random.Random(3), collections.Counter()
    for _ in range(700):  # runs of one letter, chains of forms, ties
        counts["".join(rnd.choice("aabcé") for _ in range(rnd.randint(1, 5)))] += rnd.choice([1, 1, 3, 30, 400])
    rows = [(w, n, "x") for w, n in counts.items()] + [(None, 9, "x"), ("abc", 4, "y")]
    counts["abc"] += 4
    words = spark.createDataFrame(rows, "word string, n long, key string")
    got = variants.group_variants(words).collect()
    assert len(got) == len(counts) and {tuple(r) for r in got} == _variants(counts)
    assert variants.group_variants(words.limit(0)).count() == 0


def test_words_of_texts(spark):
    prepare(spark)
    rnd = random.Random(4)
    vocabulary = ["".join(rnd.choice("aBcéÀz") for _ in range(rnd.randint(5, 10))) for _ in range(40)]
    rows = [(rnd.choice([i, None]), " ".join(rnd.choices(vocabulary, k=30)) + "1x") for i in range(60)] + [(99, None), (98, ""), (97, "a" * 50_000)]
    rows += rows[:3]
    expected = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            expected[run] += 1
    got = variants.word_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["word"]: r["n"] for r in got} == {w: n for w, n in expected.items() if len(w) >= 7 and n >= 2}


def _repaired(rows):
    """Cheapest scripts by a search over all edits, least letters first."""
    space = lambda v: " " if v is None else str(v)
    convs, out = {}, {}
    for conv, turn, role, text in rows:
        left, role, text = convs.setdefault(conv, []), space(role), space(text)
        way = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
        left += [(turn, "user" if way == 4 else role, text)] * (0 if way == 0 else 2 if way == 3 else 1)
    for conv, left in convs.items():
        left.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns, seen, faults = {t for t, _, _ in left if t is not None}, set(), []
        for _, role, text in left:
            chars = CHAR.findall(text)
            faults.append("b" if not chars else "d" if (role, text) in seen else "t" if chars[-1] not in ".!?" else "")
            seen.add((role, text))
        heap, done = [(0, "", 0, "", ())], set()
        while True:
            cost, audit, i, last, kept = heapq.heappop(heap)
            if (i, last) in done:
                continue
            done.add((i, last))
            if i == len(left) and last in ("", "a"):
                break
            new = "assistant" if last == "u" else "user"
            heapq.heappush(heap, (cost + 5, audit + "I", i, new[0], (*kept, f"{new}:")))
            if i < len(left):
                _, role, text = left[i]
                heapq.heappush(heap, (cost + 2, audit + "D", i + 1, last, kept))
                if faults[i] not in ("b", "d"):
                    more = cost + 5 * (faults[i] == "t")
                    heapq.heappush(heap, (more + 1, audit + "R", i + 1, new[0], (*kept, f"{new}:{text}")))
                    if role[:1] == new[0] or (role[:1] == "s" and last == ""):
                        heapq.heappush(heap, (more, audit + "K", i + 1, role[:1], (*kept, f"{role}:{text}")))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(left, left[1:]))
        out[conv] = (gaps, *map(faults.count, "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


CONVERSATIONS = "conv_id long, turn long, role string, text string, code int, start long"


@pytest.mark.parametrize("segment_bits, part_bytes", [(12, 32 << 20), (3, 2000)])
def test_repairs_equal_a_search_over_all_edits(spark, monkeypatch, segment_bits, part_bytes):
    prepare(spark)
    monkeypatch.setattr(dialogue, "SEGMENT_BITS", segment_bits)
    monkeypatch.setattr(dialogue, "PART_BYTES", part_bytes)
    rnd, rows = random.Random(2), []
    texts = ["a.", "b", "c!", "d?  \n", None, "  ", "é.", "e.", "f.", "x" * 3000]
    for conv in range(80):
        for turn in range(rnd.choice([1, 2, 5, 8, 30])):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "s"])
            rows.append((conv or None, rnd.choice([turn, turn, turn, None, turn + 3]), role, rnd.choice([*texts, f"{rnd.random()}."])))
    rows += [(500, t, rnd.choice(["user", "assistant", "system", "x"]), rnd.choice(["a.", "b", f"{t}."])) for t in range(600)]
    rows += [(501, 7, "user", "same.")] * 40  # one row over many sorted parts
    table = spark.createDataFrame([(*r, 1, 1) for r in rows], CONVERSATIONS).repartition(3)
    got = {r["conv_id"]: tuple(r)[1:] for r in dialogue.repaired_conversations(table).collect()}
    assert got == _repaired(rows)


def test_no_conversations(spark):
    prepare(spark)
    assert dialogue.repaired_conversations(spark.createDataFrame([], CONVERSATIONS)).count() == 0


def test_walk_with_checkpoints_equals_one_with_every_vector():
    rnd = random.Random(6)
    for n in (0, 1, 2, 15, 16, 17, 300):
        codes = bytes(rnd.randrange(12) for _ in range(n))
        vectors = [*dialogue.backward(codes, dialogue.END)][::-1]
        letters, _, state = dialogue.walk(codes, dialogue.END, dialogue.START, True)
        costs = dialogue.matrix(codes)
        assert min(costs[q] + dialogue.END[q] for q in range(4)) == vectors[0][dialogue.START]
        assert dialogue.END[state] == 0 and sum(c != "I" for c in letters) == n


def _cleaned(rows, span):
    least, words = {}, [(text or "").encode().split() for _, text in rows]
    for (doc_id, _), w in zip(rows, words):
        for i in range(len(w) - span + 1):
            if doc_id is not None:
                key = tuple(w[i : i + span])
                least[key] = min(doc_id, least.get(key, doc_id))
    out = []
    for (doc_id, _), w in zip(rows, words):
        gone = [False] * len(w)
        for i in range(len(w) - span + 1):
            if doc_id is not None and least[tuple(w[i : i + span])] < doc_id:
                gone[i : i + span] = [True] * span
        out.append((doc_id, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return out


@pytest.mark.parametrize("block_bytes, shard_bytes, span", [(8 << 20, 64 << 20, 13), (3000, 7000, 13), (1500, 4000, 7), (1500, 4000, 20)])
def test_substrings_equal_brute_force(spark, monkeypatch, block_bytes, shard_bytes, span):
    prepare(spark)
    monkeypatch.setattr(substrings, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(substrings, "SHARD_BYTES", shard_bytes)
    rnd = random.Random(1)
    vocabulary = [f"w{i}é" for i in range(200)]
    passages = [rnd.choices(vocabulary, k=rnd.randint(10, 40)) for _ in range(10)]
    rows = []
    for i in range(250):  # passages at unlike offsets, shared and null ids
        w = []
        for _ in range(rnd.randint(0, 6)):
            w += rnd.choice(passages)[rnd.randint(0, 5) :] if rnd.random() < 0.5 else rnd.choices(vocabulary, k=rnd.randint(0, 20))
        rows.append((rnd.choice([i, i, i, None, i // 3]), rnd.choice([" ", "\n", "  \t"]).join(w)))
    rows += [(1000, None), (1001, ""), (1002, " \n"), (5, "a " * 3000), (6, "a " * 12), (7, "a " * 13), (8, "a " * 14)] + rows[:4]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, block int, keys string").repartition(3)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    got = sorted(map(tuple, substrings.dedup(docs, span=span).collect()), key=key)
    assert got == sorted(_cleaned(rows, span), key=key)
    assert substrings.dedup(docs.limit(0)).count() == 0


def test_every_offset_pair_shares_an_anchor():
    for i in range(substrings.PERIOD):
        for j in range(substrings.PERIOD):
            assert any((i + d) % substrings.PERIOD in substrings.COVER and (j + d) % substrings.PERIOD in substrings.COVER for d in range(substrings.PERIOD))
