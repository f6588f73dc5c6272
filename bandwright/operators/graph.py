"""Similarity edges, connected triples and nearest entries over unit vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwright.session import cut

#: Rows of one block of the self-join; a block pair is one matrix product.
BLOCK = 2048


def _blocks(vectors: DataFrame, id_col: str, vec_col: str, block: int) -> DataFrame:
    """(x, y, xs, ys): each two blocks of (id, vec) rows, x <= y."""
    rows = vectors.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("vec"))
    n = rows.count()
    k = max(1, -(-n // block))
    packed = rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(k)).cast("int").alias("b")).agg(F.collect_list(F.struct("id", "vec")).alias("rows"))
    left, right = packed.select(F.col("b").alias("x"), F.col("rows").alias("xs")), packed.select(F.col("b").alias("y"), F.col("rows").alias("ys"))
    grid = packed.sparkSession.range(k).select(F.col("id").cast("int").alias("x"), F.explode(F.sequence(F.col("id").cast("int"), F.lit(k - 1))).alias("y")).repartition("x", "y")
    return grid.join(left, "x").join(right, "y").select("x", "y", "xs", "ys")


def _part(column: pa.Array, r: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a block."""
    cell = column[r].values
    ids = np.asarray(cell.field(0))
    return ids, np.asarray(cell.field(1).flatten()).astype(np.float64).reshape(len(ids), -1)


def edges(vectors: DataFrame, tau: float, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(i, j, sim), i < j: all pairs with a dot product above ``tau``, exactly.

    Vectors are packed into blocks by id; each pair of blocks is compared once, as a matrix product in a task, so no row
    pair below ``tau`` ever leaves it. The number of block pairs is (n / block)^2 / 2: exact joins are for sets of that
    size, larger ones take the forest of the neighbour search.
    """
    both = _blocks(vectors, id_col, vec_col, block)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                (a, xa), (b, xb) = _part(batch.column(2), r), _part(batch.column(3), r)
                s = xa @ xb.T
                i, j = np.nonzero(s > tau)
                keep = a[i] < b[j] if batch.column(0)[r] == batch.column(1)[r] else np.ones(len(i), bool)
                i, j = i[keep], j[keep]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a[i], b[j])), pa.array(np.maximum(a[i], b[j])), pa.array(s[i, j])], names=["i", "j", "sim"])

    return both.mapInArrow(scan, "i bigint, j bigint, sim double")


def transitivity(e: DataFrame) -> DataFrame:
    """One row: connected triples (paths a - b - c), those without the closing edge, and their share.

    A vertex of degree d is the middle of d (d - 1) / 2 triples, so these are counted, not made. The closed ones are three for
    each triangle; a triangle is met once, as each edge is turned from the vertex of fewer edges to the one of more, and
    then no vertex has more than sqrt(2 edges) of them, however many it has in all.
    """
    ends = e.select(F.col("i").alias("v")).unionByName(e.select(F.col("j").alias("v")))
    degrees = ends.groupBy("v").agg(F.count(F.lit(1)).alias("d"))
    of = lambda c: degrees.select(F.col("v").alias(c), F.col("d").alias(f"d{c}"))
    both = e.select("i", "j").join(of("i"), "i").join(of("j"), "j")
    less = F.struct("di", "i") < F.struct(F.col("dj").alias("di"), F.col("j").alias("i"))
    turned = cut(both.select(F.when(less, F.col("i")).otherwise(F.col("j")).alias("u"), F.when(less, F.col("j")).otherwise(F.col("i")).alias("v")))
    wedges = turned.join(turned.select("u", F.col("v").alias("w")), "u").filter("v < w")
    closing = e.select(F.least("i", "j").alias("v"), F.greatest("i", "j").alias("w"))
    triangles = wedges.join(closing, ["v", "w"]).agg(F.count(F.lit(1)).alias("closed"))
    paths = degrees.agg(F.coalesce(F.sum((F.col("d") * (F.col("d") - 1) / 2).cast("bigint")), F.lit(0)).alias("triples"))
    t = paths.crossJoin(triangles).select("triples", (F.col("triples") - 3 * F.col("closed")).alias("violations"))  # one row each
    return t.withColumn("share", F.try_divide("violations", "triples"))


def nearest(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(id, nearest, sim): the most similar other entry, ties to the smaller id; each pair of blocks gives one row per vector, the best there."""
    both = _blocks(vectors, id_col, vec_col, block)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def best(a, b, s):
            top = s.max(axis=1)
            other = np.where(s == top[:, None], b[None, :], np.iinfo(np.int64).max).min(axis=1)
            ok = top > -np.inf
            return pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(other[ok]), pa.array(top[ok])], names=["id", "o", "sim"])

        for batch in batches:
            for r in range(len(batch)):
                (a, xa), (b, xb) = _part(batch.column(2), r), _part(batch.column(3), r)
                s = xa @ xb.T
                s[a[:, None] == b[None, :]] = -np.inf
                yield best(a, b, s)
                if batch.column(0)[r] != batch.column(1)[r]:
                    yield best(b, a, s.T)

    rows = both.mapInArrow(scan, "id bigint, o bigint, sim double")
    most = rows.groupBy("id").agg(F.max(F.struct("sim", (-F.col("o")).alias("o"))).alias("m"))
    return most.select("id", (-F.col("m.o")).alias("nearest"), F.col("m.sim").alias("sim"))
