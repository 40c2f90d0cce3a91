"""Operator 2: embedding near-dedup by PCA-ordered tiled comparison.

Vectors are normalised and rotated onto the principal axes of all of them, the
leading axes first.  They are sorted along the first axis and cut into tiles
of about ``TILE`` vectors.  Two tiles are compared if their boxes on the
leading axes, and the largest suffix norms of their vectors, leave room for
the threshold.  Inside a pair of tiles the leading dimensions are multiplied
first; to each product the vectors' suffix norms add the most the rest can
give, and pairs that cannot reach the threshold stop there.  Survivors go on
to the next dimensions, and what remains is settled by the cosine of the
vectors as given, in double precision.

Equal vectors are one class from the start (told by a 64-bit code).  Tasks emit link counts and a
spanning forest of a tile pair's links, never its pairs.  Vectors that are
null, empty, zero or hold null or non-finite components link with nothing, and
neither do vectors of different lengths.  Null ids are kept; an id that
repeats counts as several vectors; an empty table gives an empty result; other
columns are ignored."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_group, connected_components, stored

TILE = 4096
LEAD = 16
SLACK = 1e-9


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a double matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def classes_of(vectors: DataFrame, id_col: str, vec_col: str):
    """(all rows with their class vector or null, one row for each class)."""
    v = F.col(vec_col).cast("array<double>")
    fine = (F.size(vec_col) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = fine & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(fine, F.transform(v, lambda x: x + 0.0)).alias("v"))
    kinds = rows.where("v is not null").groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    kinds = kinds.select("v", "rep", "copies", F.xxhash64("v").alias("node"), F.size("v").alias("dims"))
    return rows, kinds


def principal_axes(kinds: DataFrame) -> np.ndarray:
    """Rotation onto the principal axes: tasks add up their second moments,
    Spark sums them, and dims x dims numbers reach the driver."""
    dims = kinds.agg(F.max("dims")).first()[0] or 0

    def run(batches):
        total = np.zeros((dims, dims))
        for b in batches:
            for d in np.unique(b.column("dims").to_numpy()):
                x = matrix(b.filter(pa.compute.equal(b.column("dims"), int(d))).column("v"))
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                total[:d, :d] += x.T @ x
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(a.ravel()) for a in (i.astype(np.int32), j.astype(np.int32), total)], ["i", "j", "m"])

    out = np.zeros((dims, dims))
    for r in kinds.select("v", "dims").mapInArrow(run, "i int, j int, m double").groupBy("i", "j").agg(F.sum("m").alias("m")).collect():
        out[r.i, r.j] = r.m
    return np.linalg.eigh(out)[1][:, ::-1] if dims else out


def tiles(kinds: DataFrame, axes: np.ndarray) -> DataFrame:
    """(tile, node, copies, dims, v, r): r is the packed rotated unit vector."""
    rotation = kinds.sparkSession.sparkContext.broadcast(axes)

    def run(batches):
        for b in batches:
            for d in np.unique(b.column("dims").to_numpy()):
                own = b.filter(pa.compute.equal(b.column("dims"), int(d)))
                x = matrix(own.column("v"))
                r = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ rotation.value[:d]
                yield pa.RecordBatch.from_arrays(
                    [
                        own.column("node"), own.column("copies"), own.column("dims"), pa.array(r[:, 0]),
                        pa.array([y.tobytes() for y in x], pa.binary()), pa.array([y.tobytes() for y in r], pa.binary()),
                    ],
                    ["node", "copies", "dims", "first", "x", "r"],
                )

    turned = stored(
        kinds.select("node", "copies", "dims", "v").mapInArrow(
            run, "node long, copies long, dims int, first double, x binary, r binary"
        )
    )
    n = turned.count()
    cuts = max(1, -(-n // TILE))
    edges = turned.approxQuantile("first", [i / cuts for i in range(1, cuts)], 0.2 / cuts) if cuts > 1 else []
    at = kinds.sparkSession.sparkContext.broadcast(np.array(sorted(edges)))

    @F.pandas_udf(T.IntegerType())
    def tile_of(first: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(at.value, first.to_numpy()).astype(np.int32))

    return turned.withColumn("tile", tile_of("first")).select("tile", "node", "copies", "dims", "x", "r")


def tile_pairs(tiled: DataFrame, threshold: float) -> DataFrame:
    """(a, b, dims) of the tiles that may hold links, a <= b."""

    def run(key, held):
        r = np.concatenate([np.frombuffer(x, np.float64).reshape(1, -1) for b in held for x in b.column("r").to_pylist()])
        dims = int(held[0].column("dims")[0].as_py())
        tile = int(held[0].column("tile")[0].as_py())
        lead = r[:, :LEAD]
        rest = float(np.sqrt((r[:, LEAD:] ** 2).sum(1)).max(initial=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array([tile], pa.int32()), pa.array([dims], pa.int32()), pa.array([lead.min(0).tolist()]), pa.array([lead.max(0).tolist()]), pa.array([rest])],
            ["tile", "dims", "lo", "hi", "rest"],
        )

    boxes = by_group(
        tiled.select(F.xxhash64("tile", "dims").alias("key"), "tile", "dims", "r"), "key", run,
        "tile int, dims int, lo array<double>, hi array<double>, rest double",
    )
    boxes = stored(boxes)
    a = boxes.select("dims", *(F.col(x).alias(f"a_{x}") for x in ("tile", "lo", "hi", "rest")))
    b = boxes.select("dims", *(F.col(x).alias(f"b_{x}") for x in ("tile", "lo", "hi", "rest")))
    # The distance of unit vectors with cosine t is sqrt(2 - 2t): boxes further apart hold no link.
    gap = F.zip_with(
        F.arrays_zip("a_lo", "a_hi"), F.arrays_zip("b_lo", "b_hi"),
        lambda p, q: F.pow(F.greatest(p["a_lo"] - q["b_hi"], q["b_lo"] - p["a_hi"], F.lit(0.0)), F.lit(2.0)),
    )
    apart = F.aggregate(gap, F.lit(0.0), lambda acc, x: acc + x)
    pairs = a.join(b, "dims").where(F.col("a_tile") <= F.col("b_tile"))
    return pairs.where(apart <= 2 - 2 * threshold + SLACK).select(F.col("a_tile").alias("a"), F.col("b_tile").alias("b"), "dims")


def links_between(left, right, same: bool, threshold: float):
    """Links of two tiles given as (rotated, exact) matrices: index arrays."""
    (ra, xa), (rb, xb) = left, right
    lead = min(LEAD, ra.shape[1])
    cuts = sorted({lead, min(2 * lead, ra.shape[1]), ra.shape[1]})
    suffix = lambda r: {c: np.sqrt((r[:, c:] ** 2).sum(1)) for c in cuts}
    sa, sb = suffix(ra), suffix(rb)
    first = cuts[0]
    out_i, out_j = [], []
    for at in range(0, len(ra), 512):
        part = ra[at : at + 512]
        bound = part[:, :first] @ rb[:, :first].T
        bound += sa[first][at : at + 512, None] * sb[first][None, :]
        i, j = np.nonzero(bound >= threshold - SLACK)
        if same:
            keep = j > i + at
            i, j = i[keep], j[keep]
        i = i + at
        for lo in range(0, len(i), 200_000):
            ii, jj = i[lo : lo + 200_000], j[lo : lo + 200_000]
            total = (ra[ii, :first] * rb[jj, :first]).sum(1)
            for c, d in zip(cuts, cuts[1:]):
                total = total + (ra[ii, c:d] * rb[jj, c:d]).sum(1)
                on = total + sa[d][ii] * sb[d][jj] >= threshold - SLACK
                ii, jj, total = ii[on], jj[on], total[on]
            cosine = (xa[ii] * xb[jj]).sum(1) / (np.sqrt((xa[ii] ** 2).sum(1)) * np.sqrt((xb[jj] ** 2).sum(1)))
            on = cosine >= threshold
            out_i.append(ii[on])
            out_j.append(jj[on])
    return np.concatenate([*out_i, np.zeros(0, np.int64)]), np.concatenate([*out_j, np.zeros(0, np.int64)])


def forest(i: np.ndarray, j: np.ndarray) -> list[int]:
    """Positions of the links that join two trees."""
    root: dict[int, int] = {}

    def top(x):
        while (y := root.setdefault(x, x)) != x:
            root[x] = root[y] if y in root else y
            x = root[x]
        return x

    kept = []
    for k, (x, y) in enumerate(zip(i.tolist(), j.tolist())):
        x, y = top(x), top(y)
        if x != y:
            root[x] = y
            kept.append(k)
    return kept


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id_col, n_links, component_id, kept) of every row."""
    rows, kinds = classes_of(vectors, id_col, vec_col)
    kinds = stored(kinds)
    tiled = stored(tiles(kinds, principal_axes(kinds)))
    pairs = stored(tile_pairs(tiled, threshold))
    ends = pairs.select("a", "b", "dims", F.explode(F.array_distinct(F.array("a", "b"))).alias("tile"))
    members = tiled.join(ends, ["tile", "dims"]).select(
        F.xxhash64("a", "b", "dims").alias("job"), (F.col("tile") == F.col("a")).alias("left"),
        (F.col("a") == F.col("b")).alias("same"), "node", "copies", "x", "r",
    )
    schema = pa.schema([("u", pa.int64()), ("w", pa.int64()), ("links", pa.int64())])

    def run(job, held):
        col = lambda name: np.concatenate([b.column(name).to_numpy(zero_copy_only=False) for b in held])
        wide = lambda name: np.stack([np.frombuffer(x, np.float64) for b in held for x in b.column(name).to_pylist()])
        node, copies, left, same = col("node"), col("copies"), col("left").astype(bool), bool(held[0].column("same")[0].as_py())
        r, x = wide("r"), wide("x")
        a = np.flatnonzero(left)
        b = a if same else np.flatnonzero(~left)
        i, j = links_between((r[a], x[a]), (r[b], x[b]), same, threshold)
        i, j = a[i], b[j]
        if len(i):
            got = np.bincount(i, copies[j], len(node)) + np.bincount(j, copies[i], len(node))
            some = np.flatnonzero(got)
            none = pa.nulls(len(some), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(node[some]), none, pa.array(got[some].astype(np.int64))], schema=schema)
            k = forest(i, j)
            yield pa.RecordBatch.from_arrays([pa.array(node[i[k]]), pa.array(node[j[k]]), pa.nulls(len(k), pa.int64())], schema=schema)

    found = stored(by_group(members, "job", run, "u long, w long, links long"))
    parts = connected_components(found.where("w is not null"), "u", "w")
    counts = found.where("w is null").groupBy("u").agg(F.sum("links").alias("links"))
    placed = kinds.select("node", "rep", "copies", "v").join(parts, "node", "left").withColumn("part", F.coalesce("component", "node"))
    least = placed.groupBy("part").agg(F.min("rep").alias("component_id"))
    named = placed.join(least, "part").join(counts.withColumnRenamed("u", "node"), "node", "left").select(
        "v", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    out = rows.join(named, "v", "left")
    component = F.when(F.col("v").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"),
    )
