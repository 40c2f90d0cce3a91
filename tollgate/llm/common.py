"""Helpers shared by the operators: stored tables, shard-wise processing and
connected components."""

from __future__ import annotations

import ctypes
import functools
import math
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, ship_package


def prepare(spark: SparkSession) -> None:
    """Make the package importable on executors and the checkpoint folder
    known.  Arrow batches hold whole texts here, so they get fewer rows than
    Spark's default of 10,000, and a bound in bytes for very long ones; that
    changes no result."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    ship_package(spark)
    ensure_checkpoint_dir(spark)


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` once as Parquet under the shared
    checkpoint folder and read it back.  Unlike ``checkpoint()`` the plan runs
    once, and a lost executor costs nothing that was already written."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(columns: Iterable[str], name: str) -> str:
    """A column name that none of ``columns`` has, in any case."""
    taken = {c.lower() for c in columns}
    name = f"__{name}"
    while name.lower() in taken:
        name += "_"
    return name


def total_bytes(df: DataFrame, text_col: str = "text") -> int:
    """UTF-8 bytes of a text column (one scalar reaches the driver)."""
    return int(df.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0])


def pieces(n_bytes: int, each: int, least: int = 1) -> int:
    """How many shards or blocks of about ``each`` bytes hold ``n_bytes``."""
    return max(least, math.ceil(n_bytes / each))


def id_crc(col: str) -> Column:
    """crc32 of an id's decimal text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def unpack(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype=dtype)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema
    )


def trim() -> None:
    """Give memory that this worker process has freed back to the system;
    Spark keeps its workers, and what they hold stays on the executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library returns memory by itself
        pass


def trimmed(func: Callable) -> Callable:
    """``func``, a generator over a task's batches, with ``trim`` at its end."""

    @functools.wraps(func)
    def run(batches):
        yield from func(batches)
        trim()

    return run


def by_group(
    df: DataFrame,
    key: str,
    func: Callable[[int, list[pa.RecordBatch]], Iterable[pa.RecordBatch]],
    schema: str,
    order: tuple[str, ...] = (),
    parts: int | None = None,
) -> DataFrame:
    """Shuffle by ``key`` and hand every group to ``func`` as Arrow batches.

    Spark sorts each partition by the key (spilling when it must), so a task
    holds one group at a time.  Callers keep groups bounded: a key is a shard
    or tile whose number follows the size of the input."""
    dealt = df.repartition(parts, key) if parts else df.repartition(key)
    at = df.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for b in batches:
            if not b.num_rows:
                continue
            k = b.column(at).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), b.num_rows]
            for lo, hi in zip(edges, edges[1:]):
                if held and k[lo] != now:
                    yield from func(now, held)
                    held = []
                now = k[lo]
                held.append(b.slice(lo, hi - lo))
        if held:
            yield from func(now, held)

    return dealt.sortWithinPartitions(key, *order).mapInArrow(trimmed(run), schema)


def share(df: DataFrame):
    """Broadcast a table of bounded size as compressed Arrow bytes, so the
    driver keeps no objects of its rows."""
    table, sink = df.toArrow(), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return df.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())


_HELD: dict[tuple, object] = {}


def held(group: str, key, make: Callable[[], object]):
    """What ``make`` returns, once per worker process.  Spark uses its Python
    workers again for later jobs, so a worker holds the objects of one group
    alone: the first call of another group lets them go."""
    if (group, key) not in _HELD:
        if any(g != group for g, _ in _HELD):
            _HELD.clear()
            trim()
        _HELD[group, key] = make()
    return _HELD[group, key]


def built(shared, make: Callable[[pa.Table], object]):
    """What ``make`` builds from a shared table, once per worker process; one
    model is held at a time."""
    key = xxhash.xxh3_64_intdigest(shared.value)
    return held(f"model {key}", key, lambda: make(pa.ipc.open_stream(shared.value).read_all()))


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of an undirected edge list; the
    component is its smallest node.

    Alternating large-star and small-star steps (Kiveris et al., 2014): each
    step is one partial aggregation and one join on the node, so a node with
    very many links costs no more than its rows, and Spark may split its join
    partition.  Every round is written to the shared folder; the driver only
    sees whether all components are stars."""

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both if large else both.where("v < u")
        least = near.groupBy("u").agg(F.min("v").alias("m"))
        linked = near.join(least, "u")
        if large:
            out = linked.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        else:
            out = linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
                least.select("u", F.col("m").alias("v"))
            )
        return out.distinct()

    def done(pairs: DataFrame) -> bool:
        """No node is at both ends of links or has two smaller ones: stars."""
        ends = pairs.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionByName(
            pairs.select(F.col("v").alias("node"), F.lit(0).alias("up"))
        )
        ends = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
        return not ends.where("ups > 1 or (ups = 1 and least = 0)").take(1)

    now = stored(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    )
    while not done(now):
        now = stored(star(star(now, True), False))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
