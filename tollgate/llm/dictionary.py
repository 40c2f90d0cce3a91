"""Distinct-word dictionaries joined back to whole documents.

A join of every word position with a table of distinct words would shuffle
many times the input.  Here documents are dealt into blocks by id, each block
lists its distinct words once, and those lists meet in word shards:

    documents --block--> distinct words of the block --shard--> one value per
    distinct word --block--> documents, whose positions look the values up

Only the lists travel between shards and blocks, packed and sorted, so both
sides can rebuild the order and values come back without their words.  Blocks
hold ``BLOCK_BYTES`` of text and shards as many list entries whatever the
input, since their numbers follow its size."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_group, pieces, total_bytes

BLOCK_BYTES = 8 << 20
SHARD_BYTES = 12 << 20


@F.pandas_udf(T.BinaryType())
def _zipped(texts: pd.Series) -> pd.Series:
    z = zstandard.ZstdCompressor(level=3)
    return texts.map(lambda t: z.compress((t or "").encode()))


def texts_of(table: pa.Table) -> Iterator[str]:
    """The texts of a block's documents, one at a time."""
    z = zstandard.ZstdDecompressor()
    for blob in table.column("text"):
        yield z.decompress(blob.as_buffer()).decode()


def pack_words(words: list[str]) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(json.dumps(words, ensure_ascii=False).encode())


def unpack_words(blob: bytes) -> list[str]:
    return json.loads(zstandard.ZstdDecompressor().decompress(blob))


def sharded(words, n_shards: int) -> list[list[str]]:
    """Distinct words by shard, each list sorted."""
    lists: list[list[str]] = [[] for _ in range(n_shards)]
    h = xxhash.xxh3_64_intdigest
    for w in words:
        lists[h(w) % n_shards].append(w)
    for one in lists:
        one.sort()
    return lists


def blocks_of(docs: DataFrame, id_col: str, text_col: str, *keep: str) -> tuple[DataFrame, int, int]:
    """Documents dealt into blocks, texts compressed, and the numbers of
    blocks and word shards."""
    n_bytes = total_bytes(docs, text_col)
    n_blocks, n_shards = pieces(n_bytes, BLOCK_BYTES), pieces(n_bytes, SHARD_BYTES)
    block = F.pmod(F.xxhash64(F.col(id_col), F.length(text_col)), F.lit(n_blocks)).cast("int")
    dealt = docs.select(block.alias("block"), F.col(id_col).alias("id"), _zipped(text_col).alias("text"), *keep)
    return dealt.repartition(n_blocks, "block"), n_blocks, n_shards


def block_words(
    dealt: DataFrame, n_shards: int, count: Callable[[pa.Table], dict[str, int]]
) -> DataFrame:
    """(shard, block, words, counts): each block's distinct words by shard.
    ``count`` maps a block's documents to its words and their counts."""

    schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("words", pa.binary()), ("counts", pa.binary())])

    def run(batches):
        held, now = [], None
        for b in batches:
            k = b.column(0).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), b.num_rows]
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                if held and k[lo] != now:
                    yield listed(now, held)
                    held = []
                now = k[lo]
                held.append(b.slice(lo, hi - lo))
        if held:
            yield listed(now, held)

    def listed(block, held):
        counts = count(pa.Table.from_batches(held))
        lists = sharded(counts, n_shards)
        full = [s for s in range(n_shards) if lists[s]]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(full, pa.int32()),
                pa.array([int(block)] * len(full), pa.int32()),
                pa.array([pack_words(lists[s]) for s in full], pa.binary()),
                pa.array(
                    [
                        zstandard.ZstdCompressor(level=1).compress(
                            np.fromiter((counts[w] for w in lists[s]), np.int64, len(lists[s])).tobytes()
                        )
                        for s in full
                    ],
                    pa.binary(),
                ),
            ],
            schema=schema,
        )

    return dealt.sortWithinPartitions("block").mapInArrow(
        run, "shard int, block int, words binary, counts binary"
    )


def shard_values(
    lists: DataFrame, value: Callable[..., Callable[[np.ndarray], bytes]], beside: DataFrame | None = None
) -> DataFrame:
    """(block, shard, values) from ``block_words`` rows.

    In each shard ``value(shard, words, counts)`` sees every distinct word of
    the corpus in that shard once, with its total count, and returns a
    function that packs the values of chosen words (by index).  With
    ``beside`` (shard, part, values) it also gets the shard's values by part."""
    schema = pa.schema([("block", pa.int32()), ("shard", pa.int32()), ("values", pa.binary())])
    given = beside is not None

    def run(shard, held):
        at: dict[str, int] = {}
        own, parts = [], {}
        totals = np.zeros(0, np.int64)
        for b in held:
            for block, words, counts in zip(
                b.column("block").to_pylist(), b.column("words").to_pylist(), b.column("counts").to_pylist()
            ):
                if words is None:
                    parts[block] = counts
                    continue
                idx = np.fromiter(
                    (at.setdefault(w, len(at)) for w in unpack_words(words)), np.int64
                )
                if len(at) > len(totals):
                    totals = np.concatenate([totals, np.zeros(max(len(at) - len(totals), len(totals)), np.int64)])
                totals[idx] += np.frombuffer(zstandard.ZstdDecompressor().decompress(counts), np.int64)
                own.append((block, idx))
        packed = value(int(shard), list(at), totals[: len(at)], *([parts] if given else []))
        for block, idx in own:
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int32()), pa.array([int(shard)], pa.int32()), pa.array([packed(idx)], pa.binary())],
                schema=schema,
            )

    rows = lists
    if given:
        rows = lists.unionByName(
            beside.select("shard", F.col("part").alias("block"), F.lit(None).cast("binary").alias("words"), F.col("values").alias("counts"))
        )
    return by_group(rows, "shard", run, "block int, shard int, values binary")


def to_blocks(dealt: DataFrame, n_blocks: int, values: DataFrame, func, schema: str) -> DataFrame:
    """Bring each block's values to its documents: ``func(docs, values)`` gets
    the block's rows of both sides as Arrow tables.  The documents keep their
    one shuffle; only values move."""
    return (
        dealt.groupBy("block")
        .cogroup(values.repartition(n_blocks, "block").groupBy("block"))
        .applyInArrow(func, schema)
    )
