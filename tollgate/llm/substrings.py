"""Substring dedup by difference-cover anchors.

A passage that two documents share lies at unlike places in them.  For the
places p with p mod 7 in {0, 1, 3} any two offsets i, j have a shift d < 7 that
puts both i + d and j + d on such places, since every remainder is a difference
of two of 0, 1, 3.  So the 7-word windows that start there, three of seven,
hold an aligned anchor of every shared passage of 7 + 7 - 1 = 13 words:

1. documents are dealt into blocks; each block lists the hashes of its anchors;
2. shards of the hash space mark the anchors that lie in two documents or more;
3. around its marked anchors each block extends: it lists the 13-word windows
   that hold one, with the smallest document of each;
4. shards find the smallest document of each window in the whole input;
5. each block drops the words under windows that a smaller document has.

A passage that very many documents share is one entry a block, so no shard
holds more of it than there are blocks; documents are shuffled once, and no
pair of documents is written.  Anchors are a filter, 32 bits of a shard each;
windows decide, by 96 bits beside the shard's, from 64 bits a word."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, by_group, pack, pieces, stored, total_bytes, unpack
from .dictionary import _zipped, to_blocks

#: A difference cover: each remainder of the period is a difference of two.
PERIOD, COVER = 7, (0, 1, 3)
BLOCK_BYTES = 8 << 20
SHARD_BYTES = 64 << 20
#: The key of the word hash, and the odd factors of the two window hashes.
KEY = "tollgate words a"
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def words_of(blob: bytes) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text in UTF-8."""
    return blob.split()


def hashes(words: list[bytes]) -> np.ndarray:
    objects = np.empty(len(words), object)
    objects[:] = words
    return pd.util.hash_array(objects, hash_key=KEY, categorize=False)


def windows(h: np.ndarray, starts: np.ndarray, width: int, which: int) -> np.ndarray:
    """64-bit hashes of the windows of ``width`` words at ``starts``."""
    if which:
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(29)
    out, factor = h[starts], np.uint64(FACTORS[which])
    for k in range(1, width):
        out *= factor
        out += h[starts + k]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def sharded(h: np.ndarray, n_shards: int) -> np.ndarray:
    """The shard in the upper half, 32 further bits of the hash below."""
    shard = ((h >> np.uint64(32)) * np.uint64(n_shards)) >> np.uint64(32)
    return (shard << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))


class Block:
    """A block's documents as one run of word hashes; texts are unpacked one at
    a time.  Documents without an id lie in no window."""

    def __init__(self, table: pa.Table, span: int, n_shards: int):
        self.blobs, self.span, self.n_shards = table.column("text"), span, n_shards
        self.ids = table.column("id").to_pylist()
        self.counts = np.zeros(len(self.ids), np.int64)
        parts, held = [], []
        for k, words in enumerate(self.texts()):
            self.counts[k] = len(words)
            held += words
            if len(held) >= 1 << 16:
                parts.append(hashes(held))
                held = []
        self.h = np.concatenate([*parts, hashes(held)])
        self.starts = np.cumsum(self.counts) - self.counts
        windows_each = np.where([i is not None for i in self.ids], np.maximum(self.counts - span + 1, 0), 0)
        self.last = self.starts + windows_each - 1  # of a document's windows
        of = np.repeat(np.arange(len(self.ids)), np.where(windows_each > 0, windows_each + PERIOD - 1, 0))
        place = np.arange(len(of)) - np.repeat(np.flatnonzero(np.diff(of, prepend=-1)), np.diff(np.flatnonzero(np.diff(of, prepend=-1, append=-1))))
        cover = np.isin(place % PERIOD, COVER)
        self.of = of[cover]
        self.spots = self.starts[self.of] + place[cover]
        self.keys = sharded(windows(self.h, self.spots, span - PERIOD + 1, 0), n_shards)

    def texts(self) -> Iterator[list[bytes]]:
        z = zstandard.ZstdDecompressor()
        for blob in self.blobs:
            yield words_of(z.decompress(blob.as_buffer()))

    def listed(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchors, and whether two documents of the block have them."""
        order = np.lexsort((self.of, self.keys))
        keys, of = self.keys[order], self.of[order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        firsts = np.flatnonzero(new)
        lasts = np.append(firsts[1:], len(keys)) - 1
        return keys[firsts], of[firsts] != of[lasts[: len(firsts)]]

    def extended(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the windows that hold an anchor in the sorted ``shared``,
        and the document of each."""
        if not len(shared) or not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        found = shared[np.minimum(np.searchsorted(shared, self.keys), len(shared) - 1)] == self.keys
        hit, of = self.spots[found], self.of[found]
        edges = np.zeros(len(self.h) + 1, np.int32)
        np.add.at(edges, np.maximum(hit - PERIOD + 1, self.starts[of]), 1)
        np.add.at(edges, np.minimum(hit, self.last[of]) + 1, -1)
        starts = np.flatnonzero(np.cumsum(edges[:-1]) > 0)
        return starts, np.searchsorted(self.starts, starts, side="right") - 1

    def candidates(self, shared: np.ndarray):
        """Starts and documents of the extended windows, their two keys, and
        the order that sorts them by key and document id."""
        starts, of = self.extended(shared)
        a, b = sharded(windows(self.h, starts, self.span, 0), self.n_shards), windows(self.h, starts, self.span, 1)
        ids = np.array([i or 0 for i in self.ids], np.int64)[of]
        return starts, ids, a, b


def least_ids(a, b, ids):
    """Distinct windows in order, the smallest document of each, and for every
    given window which of them it is."""
    order = np.lexsort((ids, b, a))
    a, b, ids = a[order], b[order], ids[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    which = np.empty(len(a), np.int64)
    which[order] = np.cumsum(new) - 1
    return a[new], b[new], ids[new], which


def by_shard(keys: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The shards of sorted keys and where each lies."""
    shards = (keys >> np.uint64(32)).astype(np.int64)
    edges = [0, *(np.flatnonzero(shards[1:] != shards[:-1]) + 1).tolist(), len(shards)]
    for lo, hi in zip(edges, edges[1:]):
        if lo < hi:
            yield int(shards[lo]), slice(lo, hi)


def low(keys: np.ndarray) -> np.ndarray:
    return (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def shared_of(keys: np.ndarray, packed: dict[int, bytes]) -> np.ndarray:
    """The block's anchors whose bit its shard has set."""
    bits = np.zeros(len(keys), bool)
    for shard, at in by_shard(keys):
        if shard in packed:
            bits[at] = np.unpackbits(unpack(packed[shard], np.uint8))[: at.stop - at.start].astype(bool)
    return keys[bits]


def dealt_docs(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int, int]:
    """(block, id, text), texts compressed; blocks are dealt by row number, so
    that equal rows and ids spread.  Every input row keeps its number: the
    shuffle is written once, and a lost part is made again in the same order."""
    n_bytes = total_bytes(docs, text_col)
    n_blocks, n_shards = pieces(n_bytes, BLOCK_BYTES), pieces(n_bytes, SHARD_BYTES)
    block = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_blocks)).cast("int")
    rows = docs.select(block.alias("block"), F.col(id_col).cast("long").alias("id"), _zipped(text_col).alias("text"))
    return rows.repartition(n_blocks, "block"), n_blocks, n_shards


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 13) -> DataFrame:
    """(id_col, n_words, n_removed, kept): each document without the words that
    lie under a window of ``span`` words (at least 7) whose words also start
    somewhere in a document with a smaller id.

    All rows are judged on the input, not on what is left.  Null and empty
    texts have no words; rows that share an id never clean each other; a row
    without id is kept whole and cleans none.  ``kept`` joins the kept words by
    one space.  An empty table gives an empty result; further columns play no
    part."""
    if span < PERIOD:
        raise ValueError("span must be at least the period of the cover")
    dealt, n_blocks, n_shards = dealt_docs(docs, id_col, text_col)

    anchors_schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("keys", pa.binary()), ("twice", pa.binary())])

    def list_anchors(block, held):
        keys, twice = Block(pa.Table.from_batches(held), span, n_shards).listed()
        for shard, at in by_shard(keys):
            yield batch(anchors_schema, [shard], [int(block)], [pack(low(keys[at]))], [pack(np.packbits(twice[at]))])

    bits_schema = pa.schema([("block", pa.int32()), ("shard", pa.int32()), ("kind", pa.int32()), ("values", pa.binary())])

    def mark_anchors(shard, held):
        rows = [(b, unpack(k, np.uint32), unpack(t, np.uint8)) for h in held for b, k, t in zip(*(h.column(c).to_pylist() for c in ("block", "keys", "twice")))]
        every, n = np.unique(np.concatenate([k for _, k, _ in rows]), return_counts=True)
        for _, keys, twice in rows:
            n[np.searchsorted(every, keys)] += np.unpackbits(twice)[: len(keys)]
        for block, keys, _ in rows:
            shared = n[np.searchsorted(every, keys)] > 1
            yield batch(bits_schema, [block], [int(shard)], [0], [pack(np.packbits(shared))])

    anchors = in_blocks(dealt, list_anchors, "shard int, block int, keys binary, twice binary")
    bits = stored(by_group(anchors, "shard", mark_anchors, "block int, shard int, kind int, values binary"))

    windows_schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("ids", pa.binary())])

    def list_windows(rows: pa.Table, values: pa.Table) -> pa.Table:
        block = Block(rows, span, n_shards)
        _, ids, a, b = block.candidates(shared_of(block.listed()[0], by_kind(values, 0)))
        a, b, ids, _ = least_ids(a, b, ids)
        number = rows.column("block")[0].as_py() if rows.num_rows else 0
        made = [batch(windows_schema, [s], [number], [pack(low(a[at]))], [pack(b[at])], [pack(ids[at])]) for s, at in by_shard(a)]
        return pa.Table.from_batches(made, windows_schema)

    def least_documents(shard, held):
        rows = [
            (n, unpack(a, np.uint32), unpack(b, np.uint64), unpack(i, np.int64))
            for h in held for n, a, b, i in zip(*(h.column(c).to_pylist() for c in ("block", "a", "b", "ids")))
        ]
        _, _, least, which = least_ids(*(np.concatenate([r[k] for r in rows]) for k in (1, 2, 3)))
        least = least[which]
        at = 0
        for block, keys, _, own in rows:
            yield batch(bits_schema, [block], [int(shard)], [1], [pack(own - least[at : at + len(keys)])])
            at += len(keys)

    listed = to_blocks(dealt, n_blocks, bits, list_windows, "shard int, block int, a binary, b binary, ids binary")
    least = by_group(listed, "shard", least_documents, "block int, shard int, kind int, values binary")

    out_schema = pa.schema([(id_col, pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def clean(rows: pa.Table, values: pa.Table) -> pa.Table:
        block = Block(rows, span, n_shards)
        starts, ids, a, b = block.candidates(shared_of(block.listed()[0], by_kind(values, 0)))
        keys, _, least, which = least_ids(a, b, ids)
        smaller = by_kind(values, 1)
        for shard, at in by_shard(keys):
            least[at] -= unpack(smaller[shard], np.int64)
        drop = starts[least[which] < ids]
        edges = np.zeros(len(block.h) + 1, np.int32)
        np.add.at(edges, drop, 1)
        np.add.at(edges, drop + span, -1)
        under = np.cumsum(edges[:-1]) > 0
        removed, kept = np.zeros(len(block.ids), np.int64), []
        for k, words in enumerate(block.texts()):
            gone = under[block.starts[k] : block.starts[k] + len(words)]
            removed[k] = gone.sum()
            kept.append(b" ".join(compress(words, (~gone).tolist()) if removed[k] else words))
        kept = pa.array(kept, pa.binary()).cast(pa.string())
        return pa.Table.from_arrays([pa.array(block.ids, pa.int64()), pa.array(block.counts), pa.array(removed), kept], schema=out_schema)

    return to_blocks(dealt, n_blocks, bits.unionByName(least), clean, f"`{id_col}` long, n_words long, n_removed long, kept string")


def by_kind(values: pa.Table, kind: int) -> dict[int, bytes]:
    rows = zip(values.column("kind").to_pylist(), values.column("shard").to_pylist(), values.column("values"))
    return {s: v.as_py() for k, s, v in rows if k == kind}


def in_blocks(dealt: DataFrame, func, schema: str) -> DataFrame:
    """``func(block, batches)`` for every block, without a further shuffle."""

    def run(batches):
        held, now = [], None
        for b in batches:
            k = b.column(0).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), b.num_rows]
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                if held and k[lo] != now:
                    yield from func(now, held)
                    held = []
                now = k[lo]
                held.append(b.slice(lo, hi - lo))
        if held:
            yield from func(now, held)

    return dealt.sortWithinPartitions("block").mapInArrow(run, schema)
