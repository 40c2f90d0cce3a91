"""Operator 3: n-gram Jaccard join by parity sketches.

A document's set holds its distinct word 5-grams.  A parity sketch flips one
bit for each element, so the Hamming distance of two sketches never exceeds
the symmetric difference of the sets.  With Jaccard >= 4/5 that difference is
at most (a + b) / 9 for sizes a and b.

Sizes fall into bands, each band's larger partners included.  A band with
difference bound D cuts its sketches into a few more than D + 1 segments, so
linked sets agree in at least one segment that holds an element (a set with
too few such segments enters its empty ones too).  A segment spans 2^64 parity
bits and is kept as the XOR of its elements' 64-bit codes, so equal segments
always meet.  Segments are joined by (band, place, value).  In order of place,
the first segment on which two linked sets agree is among the first D + 1 of
each that hold an element, since every earlier one differs: a set enters no
more than that, D being the bound for its own size.

Where many sets share a segment no pairs of the group are listed.  Each set is
first compared with one partner only, the smallest member of the group it
shares most segments with.  After joining those links to components, the
groups that still hold several components, one for each list of members, are compared block by block,
between components alone, through parity sketches of four bits or more for
each element.  A round gives each component's closest pair only (after
``CLOSEST_ROUNDS`` its closest 4, 16, ... of each comparison), without the
pairs that earlier rounds rejected, and joins the linked ones to components.
Near copies meet in many groups, each of which would give such a pair, so the
first rounds take a share of the groups (``KEY_SHARES``) and leave the others for
later, when there are fewer components; then all are taken, and
rounds end when no pair between components is left to try.  A member of a group
without one has none there in later rounds either, as components and rejected
pairs only grow, so it leaves the group.  Sets of pairs that pass are compared exactly (5-grams as 64-bit codes; equal sets are told
by a 64-bit code of the set, too).  Pairs inside one
component need no check: they cannot change it.

Equal sets are one class from the start, so copies never multiply.

Null or blank texts have an empty set and link with nothing; a document of
fewer than five words has its whole word sequence as its one element.  Null
ids are kept (a component is the smallest non-null id of its documents, null
without one), repeated rows stay rows, and an empty table gives an empty
result.  Only the id and text columns are read."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batch, by_group, connected_components, fresh, held, pack, pieces, stored, total_bytes, trimmed, unpack

WORDS = 5
#: A sketch has the next power of two over four bits for each element, within these.
SKETCH_BITS = (512, 65_536)
#: Rounds in which a component's closest pair alone is compared.
CLOSEST_ROUNDS = 3
#: The first rounds take one of so many groups, later ones all.
KEY_SHARES = (16, 4)
BAND_RATIO = 1.5
SMALLEST = 4  # smaller sets only link with equal ones
#: Text that gives about a million segments.
SHARD_BYTES = 14 << 20
#: Texts of a map task's turn.
FLUSH_BYTES = 24 << 20
#: Members of one comparison block.
BLOCK = 1024

_M = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordCodes(dict):
    """64-bit codes of words; emptied when it grows large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 65_536:
            self.clear()
        self[word] = code = xxhash.xxh3_64_intdigest(word)
        return code



def element_codes(text: str | None) -> np.ndarray:
    """The sorted 64-bit codes of a text's distinct elements."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    codes = held("shingles", "words", WordCodes)
    w = np.fromiter(map(codes.__getitem__, words), np.uint64, len(words))
    n = min(len(w), WORDS)
    h = np.full(len(w) - n + 1, n, np.uint64)
    for i in range(n):
        h = (h + w[i : len(w) - n + 1 + i]) * _M
        h ^= h >> np.uint64(29)
    return np.unique(mix(h))


def largest_difference(a: int, b: int) -> int:
    return (a + b) // 9


def bands():
    """(low, high, D, segments) of each band of set sizes."""
    out, low = [], SMALLEST
    while low < 1 << 40:
        high = max(low, int(low * BAND_RATIO) - 1)
        d = largest_difference(high, high * 5 // 4)
        out.append((low, high, d, d + 1 + -(-6 * (d + 1) // 100) + 2))
        low = high + 1
    return out


_BANDS = bands()
_LOWS = np.array([b[0] for b in _BANDS])


def segment_keys(codes: np.ndarray) -> np.ndarray:
    """The join keys of a set: its segments in its own band, and in the band
    below if it can be a larger partner there."""
    n = len(codes)
    if n < SMALLEST:
        return np.zeros(0, np.uint64)
    own = int(np.searchsorted(_LOWS, n, "right")) - 1
    keys = []
    for k in range(own, -1, -1):
        low, high, d, count = _BANDS[k]
        if n > high * 5 // 4:
            break
        most = largest_difference(n, n * 5 // 4 if k == own else high)
        place = ((codes >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)  # ascending, as the codes are
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        value, place = np.bitwise_xor.reduceat(codes, first), place[first]
        if len(place) < most + 1:
            full = np.zeros(count, np.uint64)
            full[place.astype(np.int64)] = value
            value, place = full, np.arange(count, dtype=np.uint64)
        else:
            value, place = value[: most + 1], place[: most + 1]
        keys.append(mix(value ^ mix(place + np.uint64(k << 40))))
    return np.concatenate(keys)


def parity_sketch(codes: np.ndarray) -> bytes:
    size = min(SKETCH_BITS[1], max(SKETCH_BITS[0], 1 << (4 * len(codes) - 1).bit_length()))
    bits = np.bincount((mix(codes) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """Sketches (last axis: 64-bit words) as the shorter sketches of the same
    sets: the parity of a place modulo the shorter length."""
    return np.bitwise_xor.reduce(sketch.reshape(*sketch.shape[:-1], -1, words), axis=-2)


def distance(x: np.ndarray, y: np.ndarray) -> int:
    """Hamming distance of two sketches at the shorter one's length."""
    words = min(len(x), len(y))
    return int(np.bitwise_count(folded(x, words) ^ folded(y, words)).sum())


def fingerprint(codes: np.ndarray) -> int:
    """The signed 64-bit code of the set."""
    a = np.bitwise_xor.reduce(codes) if len(codes) else np.uint64(0)
    b = codes.sum(dtype=np.uint64) + np.uint64(len(codes))
    return int(mix(np.array([a]) ^ (np.array([b]) * _M))[0].astype(np.int64))


_DEALT = pa.schema(
    [("shard", pa.int32()), ("keys", pa.binary()), ("sets", pa.binary()), ("id", pa.int64()), ("n", pa.int64()),
     ("f1", pa.int64()), ("sketch", pa.binary())]
)


def dealt(docs: DataFrame, n_shards: int) -> DataFrame:
    """One pass over the texts, giving two kinds of rows by shard: segments,
    packed, and a row for each document with its set's size and code.  Equal
    sets of a map task's turn enter once, and only the first one's row has the
    sketch.  The documents' rows go round the shards, so copies spread."""

    def flush(held):
        keys = np.concatenate([k for k, _ in held])
        sets = np.repeat(np.array([f for _, f in held], np.int64), [len(k) for k, _ in held])
        order = np.argsort(keys)
        keys, sets = keys[order], sets[order]
        shard = ((keys >> np.uint64(32)) * np.uint64(n_shards) >> np.uint64(32)).astype(np.int64)
        cuts = np.searchsorted(shard, np.arange(n_shards + 1))
        full = [s for s in range(n_shards) if cuts[s] < cuts[s + 1]]
        none = [None] * len(full)
        yield batch(
            _DEALT, full, [pack_sorted(keys[cuts[s] : cuts[s + 1]]) for s in full],
            [sets[cuts[s] : cuts[s + 1]].tobytes() for s in full], none, none, none, none,
        )

    def run(batches):
        seen: set[int] = set()
        held, size = [], 0
        at = TaskContext.get().partitionId()
        for b in batches:
            found = []
            for text in b.column("text").to_pylist():
                codes = element_codes(text)
                f = fingerprint(codes)
                size += len(text or "")
                new = len(codes) > 0 and f not in seen
                found.append((len(codes), f, parity_sketch(codes) if new else None))
                if new:
                    seen.add(f)
                    if len(codes) >= SMALLEST:
                        held.append((segment_keys(codes), f))
            n, f, sketch = zip(*found) if found else ((), (), ())
            none = [None] * len(n)
            yield batch(_DEALT, [(at + i) % n_shards for i in range(len(n))], none, none, b.column("id"), n, f, sketch)
            at += len(n)
            if size > FLUSH_BYTES:
                if held:
                    yield from flush(held)
                held, size = [], 0
                seen.clear()
        if held:
            yield from flush(held)

    return docs.mapInArrow(trimmed(run), "shard int, keys binary, sets binary, id long, n long, f1 long, sketch binary")


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted codes as byte planes of their differences."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return pack(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T))


def unpack_sorted(blob: bytes) -> np.ndarray:
    planes = unpack(blob, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def shared_segments(shards: DataFrame) -> DataFrame:
    """The documents' rows (id, n, f1, sketch), and the segments of two sets
    or more: (key, set, hub, shared), hub being the smallest set there.
    ``shared`` counts, on one row of each (set, hub) in a shard, the segments
    they share in it; other rows have 0."""
    names = ["id", "n", "f1", "sketch", "key", "set", "hub", "shared"]
    schema = pa.schema([(x, pa.binary() if x == "sketch" else pa.int64()) for x in names])

    def run(shard, held):
        packed = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for b in held:
            docs = b.filter(b.column("n").is_valid())
            if docs.num_rows:
                none = pa.nulls(docs.num_rows, pa.int64())
                yield batch(schema, *(docs.column(x) for x in names[:4]), none, none, none, none)
            for k, v in zip(b.column("keys").to_pylist(), b.column("sets").to_pylist()):
                if k is not None:
                    packed[0].append(unpack_sorted(k))
                    packed[1].append(np.frombuffer(v, np.int64))
        keys, sets = map(np.concatenate, packed)
        order = np.argsort(keys, kind="stable")
        keys, sets = keys[order], sets[order]
        same = keys[1:] == keys[:-1]
        live = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        keys, sets = keys[live], sets[live]
        order = np.lexsort((sets, keys))
        keys, sets = keys[order], sets[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (sets[1:] != sets[:-1])  # equal sets of several tasks
        keys, sets = keys[new], sets[new]
        first = np.ones(len(keys), bool)
        first[1:] = keys[1:] != keys[:-1]
        hub = sets[first][np.cumsum(first) - 1] if len(keys) else sets
        size = np.diff(np.append(np.flatnonzero(first), len(keys)))
        live = np.repeat(size > 1, size)
        keys, sets, hub = keys[live], sets[live], hub[live]
        shared = np.zeros(len(keys), np.int64)
        other = np.flatnonzero(sets != hub)
        if len(other):
            order = other[np.lexsort((hub[other], sets[other]))]
            s, h = sets[order], hub[order]
            start = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (h[1:] != h[:-1])]))
            shared[order[start]] = np.diff(np.append(start, len(order)))
        for at in range(0, len(keys), 100_000):
            part = slice(at, at + 100_000)
            none = [None] * len(keys[part])
            yield batch(schema, none, none, none, none, keys[part].view(np.int64), sets[part], hub[part], shared[part])

    return by_group(
        shards, "shard", run, "id long, n long, f1 long, sketch binary, key long, set long, hub long, shared long"
    )


@F.pandas_udf(T.BooleanType())
def _sketches_allow(n1: pd.Series, s1: pd.Series, n2: pd.Series, s2: pd.Series) -> pd.Series:
    words = lambda x: np.frombuffer(x, np.uint64)
    most = ((n1 + n2) // 9).tolist()
    return pd.Series([distance(words(x), words(y)) <= m for x, y, m in zip(s1, s2, most)], dtype=bool)


@F.pandas_udf(T.BooleanType())
def _linked(c1: pd.Series, c2: pd.Series) -> pd.Series:
    def one(x, y):
        x, y = unpack(x, np.uint64), unpack(y, np.uint64)
        both = len(np.intersect1d(x, y, assume_unique=True))
        return 100 * both >= 80 * (len(x) + len(y) - both)

    return pd.Series([one(x, y) for x, y in zip(c1, c2)], dtype=bool)


def marked(docs: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Add ``__hit``: false where a document's id is surely not among ``ids``
    (one column), so that few texts enter the join after.

    A bitmap of 2^23 hashed ids is broadcast: at most 131,072 rows of 64 bits,
    whatever the input.  Null ids hit."""
    place = lambda c: F.coalesce(F.pmod(F.xxhash64(c), F.lit(1 << 23)), F.lit(0))
    word, at_bit, own_bits = (fresh(docs.columns, n) for n in ("word", "p", "bits"))
    bits = ids.select(place(F.col(ids.columns[0]).cast("long")).alias("p")).groupBy(F.shiftright("p", 6).alias(word)).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias(own_bits)
    )
    at = docs.withColumn(at_bit, place(F.col(id_col).cast("long")))
    found = at.join(F.broadcast(bits), F.shiftright(at_bit, 6) == F.col(word), "left")
    hit = F.coalesce(F.expr(f"shiftright({own_bits}, cast({at_bit} & 63 as int)) & 1L = 1"), F.lit(False)) | F.col(id_col).isNull()
    return found.select(*docs.columns, hit.alias("__hit"))


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The (a, b) pairs of classes whose whole sets have Jaccard >= 4/5.

    docs: (id, text).  A class's text is fetched by the smallest id of its
    documents (null-safe, and again by the code of its set)."""
    schema = pa.schema([("set", pa.int64()), ("codes", pa.binary())])

    def run(batches):
        for b in batches:
            sets = [element_codes(t) for t in b.column("text").to_pylist()]
            yield batch(schema, [fingerprint(s) for s in sets], [pack(s) for s in sets])

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("f1")).distinct().join(classes.select("f1", "rep"), "f1")
    reps = wanted.select("rep").distinct()
    texts = marked(docs, reps).where("__hit").join(reps, F.col("id").eqNullSafe(F.col("rep")), "left_semi")
    sets = texts.select("text").mapInArrow(trimmed(run), "set long, codes binary")
    sets = sets.join(wanted, F.col("set") == F.col("f1"), "left_semi").groupBy("set").agg(F.first("codes").alias("codes"))
    sets = stored(sets)
    both = pairs.join(sets.select(F.col("set").alias("a"), F.col("codes").alias("c1")), "a").join(
        sets.select(F.col("set").alias("b"), F.col("codes").alias("c2")), "b"
    )
    return both.where(_linked("c1", "c2")).select("a", "b")


def with_sets(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    for x in ("a", "b"):
        pairs = pairs.join(
            classes.select(F.col("f1").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}")), x
        )
    return pairs


def allowed(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs whose sizes and sketches allow a link."""
    known = with_sets(pairs, classes)
    sized = known.where("greatest(n_a, n_b) * 4 <= least(n_a, n_b) * 5")
    return sized.where(_sketches_allow("n_a", "sketch_a", "n_b", "sketch_b")).select("a", "b")


def one_key_each(live: DataFrame) -> DataFrame:
    """(key, set) of one key for each list of members.  Near copies meet under
    hundreds of keys; lists are told apart by their length and 128 bits."""
    lists = live.groupBy("key").agg(
        F.count("*").alias("size"), F.bit_xor(F.xxhash64("set")).alias("m1"),
        F.bit_xor(F.xxhash64(F.lit("again"), "set")).alias("m2"),
    )
    keys = lists.groupBy("size", "m1", "m2").agg(F.min("key").alias("key")).select("key")
    return stored(live.select("key", "set").join(keys, "key", "left_semi"))


def between_components(
    live: DataFrame, parts: DataFrame, classes: DataFrame, rejected: DataFrame, most: int
) -> DataFrame:
    """(key, a, b, far, ca, cb, tried): pairs that share a segment, lie in different
    components, are not ``rejected`` and whose sizes and sketches allow a link.
    Each comparison gives the ``most`` closest of each component there; ca and
    cb are the components of a and b, null where the pair is not among their
    own.  The first row of a comparison has the sets of all such pairs there, taken
    or not, in ``tried``."""
    placed = live.select("key", F.col("set").alias("f1")).join(
        parts.select(F.col("node").alias("f1"), "component"), "f1", "left"
    ).withColumn("component", F.coalesce("component", "f1"))
    groups = placed.groupBy("key").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size")
    ).where("lo < hi").select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    out_of = rejected.groupBy(F.col("a").alias("f1")).agg(F.collect_list("b").alias("not"))
    known = classes.select("f1", "n", "sketch").join(out_of, "f1", "left")
    rows = placed.join(groups, "key").join(known, "f1")
    # A group of several blocks is dealt out as all pairs of its blocks.
    rows = rows.withColumn("own", F.pmod(F.xxhash64("f1"), F.col("blocks")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    )
    rows = rows.select(
        F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("tile"),
        (F.col("own") > F.col("other")).alias("right"), (F.col("own") == F.col("other")).alias("same"),
        "key", "f1", "component", "n", "sketch", "not",
    )
    kinds = {"far": pa.float64(), "tried": pa.list_(pa.int64())}
    schema = pa.schema([(x, kinds.get(x, pa.int64())) for x in ("key", "a", "b", "far", "ca", "cb", "tried")])

    def run(tile, held):
        col = lambda name: np.concatenate([b.column(name).to_numpy(zero_copy_only=False) for b in held])
        f, comp, n = col("f1"), col("component"), col("n")
        right, same = col("right").astype(bool), col("same").astype(bool)
        raw = [np.frombuffer(x, np.uint64) for b in held for x in b.column("sketch").to_pylist()]
        nots = [x for b in held for x in b.column("not").to_pylist()]
        gone = {(int(f[i]), x) for i, some in enumerate(nots) for x in some or ()}
        length = np.array([len(x) for x in raw])
        levels: dict[tuple[int, int], np.ndarray] = {}

        def level(size, words):
            """The sketches of one length, at a shorter one."""
            if (size, words) not in levels:
                levels[size, words] = folded(np.stack([raw[k] for k in np.flatnonzero(length == size)]), words)
            return levels[size, words]

        place = np.zeros(len(f), np.int64)
        for size in set(length.tolist()):
            place[length == size] = np.arange((length == size).sum())
        found = [], [], []
        for i in np.flatnonzero(~right):
            j = np.flatnonzero((right | same) & (comp != comp[i]))
            j = j[~(same[j] & same[i]) | (f[j] > f[i])]
            j = j[np.maximum(n[j], n[i]) * 4 <= np.minimum(n[j], n[i]) * 5]
            for size in set(length[j].tolist()):
                jj = j[length[j] == size]
                words = min(size, length[i])
                d = np.bitwise_count(level(size, words)[place[jj]] ^ folded(raw[i], words)).sum(1, dtype=np.int64)
                on = d <= (n[jj] + n[i]) // 9
                jj, d = jj[on], d[on]
                low = f[jj] < f[i]
                found[0].append(np.where(low, jj, i))
                found[1].append(np.where(low, i, jj))
                found[2].append(d / (n[jj] + n[i]))
        a, b, far = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)
        if gone:
            new = np.array([x not in gone for x in zip(f[a].tolist(), f[b].tolist())], bool)
            a, b, far = a[new], b[new], far[new]
        if not len(a):
            return
        tried = np.unique(np.concatenate([f[a], f[b]]))
        order = np.lexsort((f[b], f[a], far))
        a, b, far = a[order], b[order], far[order]
        # The first ``most`` pairs of each component, as either end.
        ends = np.stack([comp[a], comp[b]], 1).ravel()
        order = np.argsort(ends, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], ends[order][1:] != ends[order][:-1]]))
        rank = np.empty(len(ends), np.int64)
        rank[order] = np.arange(len(ends)) - np.repeat(first, np.diff(np.append(first, len(ends))))
        own = (rank < most).reshape(-1, 2)
        out = own.any(1)
        a, b, far, own = a[out], b[out], far[out], own[out]
        key = held[0].column("key")[0].as_py()
        yield batch(
            schema, [key] * len(a), f[a], f[b], far,
            pa.array(comp[a], pa.int64(), mask=~own[:, 0]), pa.array(comp[b], pa.int64(), mask=~own[:, 1]),
            [tried, *[None] * (len(a) - 1)],
        )

    return by_group(rows, "tile", run, "key long, a long, b long, far double, ca long, cb long, tried array<long>")


def closest(found: DataFrame) -> DataFrame:
    """Each component's closest pair of all comparisons: (a, b)."""
    ends = found.withColumn("c", F.explode(F.array("ca", "cb"))).where("c is not null")
    best = ends.groupBy("c").agg(F.min_by(F.struct("a", "b"), F.struct("far", "a", "b")).alias("pair"))
    return best.select("pair.*").distinct()


def grouped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, f1, component, component_id) of every row: its set's size and
    code, its group and the group's smallest id.  An empty set's group is its
    code, and its component_id its own id."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    n_shards = pieces(total_bytes(docs), SHARD_BYTES)
    both = stored(shared_segments(dealt(docs, n_shards)))
    rows = both.where("n is not null").select("id", "n", "f1", "sketch")
    live = both.where("key is not null").select("key", "set", "hub", "shared")
    classes = rows.where("n > 0").groupBy("f1").agg(
        F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sketch", ignorenulls=True).alias("sketch")
    )
    classes = stored(classes)

    hubs = live.where("shared > 0").groupBy("set", "hub").agg(F.sum("shared").alias("shared"))
    first = hubs.groupBy(F.col("set").alias("b")).agg(F.max_by("hub", F.struct("shared", "hub")).alias("a"))
    pairs = stored(allowed(first.select("a", "b"), classes))
    links = stored(verified(pairs, classes, docs))
    parts = connected_components(links, "a", "b")
    rejected = pairs.join(links, ["a", "b"], "left_anti")
    live = one_key_each(live)
    turn = 0
    while True:
        most = 1 if turn < CLOSEST_ROUNDS else 4 ** (turn - CLOSEST_ROUNDS + 1)
        share = KEY_SHARES[turn] if turn < len(KEY_SHARES) else 1
        taken = F.pmod(F.xxhash64(F.lit("share"), "key"), F.lit(share)) == 0
        found = stored(between_components(live.where(taken), parts, classes, rejected, most))
        if found.take(1):
            pairs = stored(closest(found) if most == 1 else found.select("a", "b").distinct())
            links = stored(verified(pairs, classes, docs))
            parts = connected_components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links), "a", "b")
            rejected = stored(rejected.unionByName(pairs.join(links, ["a", "b"], "left_anti")))
        elif share == 1:
            break
        tried = found.select("key", F.explode("tried").alias("set")).distinct()
        live = stored(live.where(~taken).unionByName(tried))
        turn += 1

    placed = classes.select("f1", "rep").join(parts.withColumnRenamed("node", "f1"), "f1", "left")
    placed = placed.withColumn("component", F.coalesce("component", "f1"))
    least = placed.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = placed.join(least, "component").select("f1", "component", "component_id")
    return rows.select("id", "n", "f1").join(named, "f1", "left").select(
        "id", "n", "f1", F.coalesce("component", "f1").alias("component"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id) of every row; see the module's text."""
    return grouped(docs, id_col, text_col).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id"
    )


@F.pandas_udf(T.LongType())
def _set_code(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(element_codes(t)) for t in texts], dtype="int64")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group, the one with its smallest id.

    Rows that share an id are told apart by their sets: each goes or stays
    with its own group, and one of several in the same group stays.  Documents
    without an id stay."""
    columns = docs.columns  # packed, so that no name of theirs clashes
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.struct(*map(F.col, columns)).alias("row"))
    found = grouped(docs, "id", "text").where("id is not null").withColumn("gone", F.col("component_id") != F.col("id"))
    special = found.groupBy(F.col("id").alias("__id")).agg(F.min("gone").alias("__gone"), F.count("*").alias("__rows"))
    special = stored(special.where("__gone or __rows > 1"))
    shared = special.where("__rows > 1 and not __gone").select(F.col("__id").alias("id"))
    chosen = stored(found.where("not gone").join(shared, "id", "left_semi").groupBy("id", "component").agg(F.min("f1").alias("f1")))
    flagged = marked(docs.select("id", "text", "row"), special.select("__id"))
    hit = flagged.where("__hit").join(special, F.col("id") == F.col("__id"), "left").where("coalesce(not __gone, true)")
    once = hit.where("coalesce(__rows, 1) = 1").select("row")
    several = hit.where("__rows > 1").select("id", "row", _set_code("text").alias("__f1"))
    several = several.join(
        chosen.select(F.col("id").alias("__id"), F.col("f1").alias("__kept")),
        (F.col("id") == F.col("__id")) & (F.col("__f1") == F.col("__kept")), "left_semi",
    ).dropDuplicates(["id", "__f1"]).select("row")
    return flagged.where("not __hit").select("row").unionByName(once).unionByName(several).select("row.*")
