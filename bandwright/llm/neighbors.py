"""The k most similar vectors of every vector, by a hash-prefix forest.

Every tree gives each vector a long string of BITS signs on random orthogonal directions, and keeps the strings in one sorted
array. The entries that share a prefix with a vector are a stretch of the array around it; its longest match is where a descent
ends. All trees then ascend together, one level of prefix length at a time, until the stretches of a level hold ENOUGH
entries in all. Which level that is comes from the strings alone; the vectors travel once, with their level, and
are compared with every entry of their stretches (and of those of the entries beside them), in blocks; each tree gives on its k best; the k best of all trees are
ranked exactly (cosine in double precision, rounded, ties to the smaller id).

The arrays are cut into pieces by rank, PIECE entries with those next to them on either side (ENOUGH), whatever the number of
partitions. A vector with a stretch that reaches beyond is in a crowd of near-equal ones, and gets its exact answer from ``settle``.

Equal vectors are one entry: they are found by a digest, represented by the smallest id, and the answer of the
representative serves every copy; as many of the smallest ids as can be in an answer stand for the class in others'
answers. So a third of all rows being copies costs nothing and loses nothing.

Measured recall of the pairs is in the README; it is a property of TREES and ENOUGH, not of the number of rows sampled: all rows are
indexed and all are queries, and the directions are fixed by a seed.

Cases: null, all-zero and non-finite vectors, those with a null element and those whose length isn't ``dimension`` take no
part; lengths of vectors don't matter; a repeated id counts once (its smallest vector); null ids take no part; an empty table gives an
empty result; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bandwright.operators.skew import lookup_join, one_row_each
from bandwright.operators.windows import number_rows
from bandwright.session import cut

TREES = 12
BITS = 62
#: Entries, over all trees, at which the ascent ends.
ENOUGH = 6144
#: Entries of a piece of a sorted array; it sets the work's shape, not the result.
PIECE = 65536
DIGITS = 6
#: Crowded vectors compared as one block, the leaders taken in a round, and the rounds; they set the work, not the result.
BLOCK = 8192
LEADERS = 1024
ROUNDS = 8


def _directions(dimension: int, trees: int, bits: int, seed: int) -> np.ndarray:
    """(dimension, trees * bits): orthogonal directions, as far as the dimension allows, within each tree."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(trees):
        sets = [np.linalg.qr(rng.standard_normal((dimension, dimension)))[0] for _ in range(-(-bits // dimension))]
        out.append(np.concatenate(sets, axis=1)[:, :bits])
    return np.concatenate(out, axis=1)


def hashed(vectors: DataFrame, dimension: int, trees: int = TREES, bits: int = BITS, seed: int = 42) -> DataFrame:
    """(tree, hash, id) of (id, vec): one row per tree."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = _directions(dimension, trees, bits, seed)
        weights = 1 << np.arange(bits - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, dimension)
            codes = ((x @ planes > 0).reshape(n, trees, bits) * weights).sum(axis=2)
            ids = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(trees, dtype=np.int32), n)), pa.array(codes.ravel()), pa.array(np.repeat(ids, trees))], names=["tree", "hash", "id"])

    return vectors.select("id", "vec").mapInArrow(hashes, "tree int, hash bigint, id bigint")


def _pieces(entries: DataFrame, n: int, size: int, halo: int) -> DataFrame:
    """``entries`` (tree, rank, ...) once for each piece that holds them: their own (core) and those they are next to."""
    per = max(1, -(-n // size))
    own, at = F.floor(F.col("rank") / size).cast("int"), F.pmod("rank", F.lit(size))
    beside = F.array_compact(F.array(F.when((at < halo) & (own > 0), own - 1), F.when((at >= size - halo) & (own < per - 1), own + 1)))
    each = entries.withColumn("__p", F.explode(F.concat(F.array(own), beside)))
    return each.withColumn("core", F.col("__p") == own).withColumn("piece", F.col("tree") * per + F.col("__p")).drop("__p")


def _by_piece(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each piece together; the first column is the piece, batches are in order of it."""
    held, last = [], None
    for batch in batches:
        if not len(batch):
            continue
        piece = batch.column(0).to_numpy()
        ends = np.append(np.flatnonzero(piece[1:] != piece[:-1]) + 1, len(piece))
        s = 0
        for e in ends:
            if held and piece[s] != last:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            last = piece[s]
            held.append(batch.slice(s, e - s))
            s = e
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _stretches(h: np.ndarray, level: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 row of the entries that share the first ``level`` bits with each, in sorted ``h``."""
    key = h >> (bits - level)
    starts = np.append(0, np.flatnonzero(key[1:] != key[:-1]) + 1)
    sizes = np.diff(np.append(starts, len(key)))
    return np.repeat(starts, sizes), np.repeat(starts + sizes, sizes)


def levels(ranked: DataFrame, n: int, enough: int, size: int, bits: int) -> DataFrame:
    """(id, notes, at array<struct<tree, rank, hash>>) from (tree, hash, id, rank): of every tree each level's growth of the id's stretch, level and growth in one number, until the one tree has enough."""

    def growth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_piece(batches):
            h, core = rows["hash"].to_numpy(), rows["core"].to_numpy(zero_copy_only=False)
            was, at, notes = np.ones(len(h), np.int64), [], []
            for level in range(bits, -1, -1):
                lo, hi = _stretches(h, level, bits)
                more = hi - lo - was
                grown = np.flatnonzero(core & (more > 0) & (was <= enough))
                at.append(grown), notes.append((bits - level << 32) + more[grown])
                was = hi - lo
                if was.min() > enough:
                    break
            at, notes = np.concatenate(at), np.concatenate(notes)
            order = np.argsort(at, kind="stable")
            offsets = np.append(0, np.cumsum(np.bincount(at, minlength=len(h))[core]))
            keep = np.flatnonzero(core)
            out = rows.select(["id", "tree", "rank", "hash"]).take(pa.array(keep)).append_column("notes", pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(notes[order])))
            yield from out.combine_chunks().to_batches()

    dealt = _pieces(ranked, n, size, min(enough, size)).select("piece", "hash", "id", "tree", "rank", "core").repartition("piece").sortWithinPartitions("piece", "rank")
    noted = dealt.mapInArrow(growth, "id bigint, tree int, rank bigint, hash bigint, notes array<bigint>")
    return noted.groupBy("id").agg(F.flatten(F.collect_list("notes")).alias("notes"), F.collect_list(F.struct("tree", "rank", "hash")).alias("at"))


def ascended(notes: pa.Array, enough: int, bits: int) -> np.ndarray:
    """Of every row the longest prefix length at which the stretches of all trees hold ``enough`` others; 0 if none does."""
    counts = np.diff(notes.offsets.to_numpy())
    values, rows = notes.flatten().to_numpy(), np.repeat(np.arange(len(notes)), counts)
    order = np.lexsort((values, rows))
    values, run = values[order], np.cumsum((values[order] & ((1 << 32) - 1)))
    starts = np.cumsum(counts) - counts
    before = np.append(0, run)[starts]
    met = np.flatnonzero(run - np.repeat(before, counts) >= enough)
    level = np.zeros(len(notes), np.int32)
    level[rows[met[::-1]]] = (bits - (values[met[::-1]] >> 32)).astype(np.int32)  # the first that meets it is written last
    return level


def _best(x: np.ndarray, x32: np.ndarray, rows_at: np.ndarray, los: np.ndarray, his: np.ndarray, k: int, floor: float, digits: int):
    """Of the unit vectors ``x`` at ``rows_at``, those that can be of the k most similar among the rows of all their stretches los..his, as (row, other, sim)."""
    a, b = int(los.min()), int(his.max())
    s = x32[rows_at] @ x32[a:b].T
    s[np.arange(len(rows_at)), rows_at - a] = -2
    hits = np.flatnonzero(s.ravel() >= np.float32(floor - 1e-4))
    if not len(hits):
        return
    rows, cols = np.divmod(hits, b - a)
    count = np.bincount(rows, minlength=len(rows_at))
    crowded = np.flatnonzero(count > k)
    if len(crowded):  # nothing that is clearly below the k-th can be among the k best; ties stay
        least = np.full(len(rows_at), -2, np.float32)
        least[crowded] = np.partition(s[crowded], -k, axis=1)[:, -k] - np.float32(5e-6)
        keep = s.ravel()[hits] >= least[rows]
        rows, cols = rows[keep], cols[keep]
    for p in range(0, len(rows), 200_000):
        r, c = rows_at[rows[p : p + 200_000]], cols[p : p + 200_000] + a
        yield r, c, np.round(np.einsum("ij,ij->i", x[r], x[c]), digits)


def candidates(noted: DataFrame, vectors: DataFrame, n: int, dimension: int, k: int, floor: float, enough: int, size: int, bits: int, digits: int = DIGITS) -> DataFrame:
    """(id, other, sim) of (id, notes, at) and (id, vec): of every tree the k best at least ``floor``; ids with a stretch beyond the piece also have a row without other and sim."""
    names = ["id", "other", "sim"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_piece(batches):
            h, ids, level, rank = (rows[c].to_numpy() for c in ("hash", "id", "level", "rank"))
            core = np.flatnonzero(rows["core"].to_numpy(zero_copy_only=False))
            x = _units(rows["vec"].combine_chunks(), len(h), dimension)
            x32, lo, hi = x.astype(np.float32), np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
            for v in np.unique(level[core]):
                at = level == v
                los, his = _stretches(h, int(v), bits)
                lo[at], hi[at] = los[at], his[at]
            beyond = ((lo == 0) & (rank[0] > 0)) | ((hi == len(h)) & (rank[-1] < n - 1))
            cut_off = core[beyond[core]]
            if len(cut_off):
                yield pa.RecordBatch.from_arrays([pa.array(ids[cut_off]), pa.nulls(len(cut_off), pa.int64()), pa.nulls(len(cut_off), pa.float64())], names=names)
                near = np.arange(len(h))  # a bound for their exact answer is enough
                lo, hi = np.where(beyond, np.maximum(lo, near - 256), lo), np.where(beyond, np.minimum(hi, near + 256), hi)
            for p in range(0, len(core), 256):
                part = core[p : p + 256]
                found = list(_best(x, x32, part, lo[part], hi[part], k, floor, digits))
                if not found:
                    continue
                r, o, v = np.concatenate([f[0] for f in found]), ids[np.concatenate([f[1] for f in found])], np.concatenate([f[2] for f in found])
                r, o, v = r[v >= floor], o[v >= floor], v[v >= floor]
                at = np.lexsort((o, -v, r))
                r, o, v = r[at], o[at], v[at]
                first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]])) if len(r) else np.empty(0, int)
                keep = np.arange(len(r)) - np.repeat(first, np.diff(np.append(first, len(r)))) < k
                if keep.any():
                    yield pa.RecordBatch.from_arrays([pa.array(ids[r[keep]]), pa.array(o[keep]), pa.array(v[keep])], names=names)

    per, halo = max(1, -(-n // size)), min(enough, size)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            level, at = ascended(batch.column(1), enough, bits), batch.column(2)
            rows = np.repeat(np.arange(len(batch)), np.diff(at.offsets.to_numpy()))
            tree, rank, hash_ = (c.to_numpy() for c in at.flatten().flatten())
            own, inside = rank // size, rank % size
            back, on = np.flatnonzero((inside < halo) & (own > 0)), np.flatnonzero((inside >= size - halo) & (own < per - 1))
            which = np.concatenate([np.arange(len(rows)), back, on])
            piece = tree[which].astype(np.int64) * per + np.concatenate([own, own[back] - 1, own[on] + 1])
            for p in range(0, len(which), 10_000):
                w = which[p : p + 10_000]
                r = pa.array(rows[w])
                yield pa.RecordBatch.from_arrays([pa.array(piece[p : p + 10_000]), pa.array(hash_[w]), batch.column(0).take(r), pa.array(level[rows[w]]), pa.array(rank[w]), pa.array(np.arange(p, p + len(w)) < len(rows)), batch.column(3).take(r)], names=["piece", "hash", "id", "level", "rank", "core", "vec"])

    entries = noted.join(vectors.select("id", "vec"), "id").select("id", "notes", "at", "vec")
    dealt = entries.mapInArrow(spread, "piece bigint, hash bigint, id bigint, level int, rank bigint, core boolean, vec array<float>").repartition("piece").sortWithinPartitions("piece", "rank")
    return dealt.mapInArrow(scan, "id bigint, other bigint, sim double")


def _units(column: pa.Array, n: int, dimension: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, dimension)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _leaders(asked: DataFrame, dimension: int) -> np.ndarray:
    """Unit vectors such that most of ``asked`` have a cosine of 0.95 with one: greedy picks from samples of those that have none yet."""
    led = np.empty((0, dimension))
    for _ in range(ROUNDS):

        def alone(batches: Iterator[pa.RecordBatch], led=led) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    x = _units(batch.column(1), len(batch), dimension)
                    near = np.concatenate([(x[s : s + 1024] @ led.T).max(axis=1, initial=-1) for s in range(0, len(x), 1024)])
                    yield batch.filter(pa.array(near < 0.95))

        rest = asked.select("id", "vec").mapInArrow(alone, "id bigint, vec array<float>")
        sample = rest.orderBy(F.xxhash64("id"), "id").limit(LEADERS).select("vec").toArrow().column(0).combine_chunks()
        if not len(sample):
            break
        for v in _units(sample, len(sample), dimension):
            if not len(led) or (led @ v).max() < 0.95:
                led = np.concatenate([led, v[None]])
    return led


def settle(vectors: DataFrame, asked: DataFrame, dimension: int, k: int, floor: float, digits: int = DIGITS) -> DataFrame | None:
    """(id, other, sim): the exact answers over ``vectors`` (id, vec) of the vectors ``asked`` (id, vec, least: no more than the k-th similarity); None if none is asked.

    By the triangle inequality an answer is within the cell's radius plus the angle of its ``least`` from its leader.
    """
    led = _leaders(asked, dimension)
    if not len(led):
        return None

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, len(batch), 1024):
                part = batch.slice(s, 1024)
                near = _units(part.column(1), len(part), dimension) @ led.T
                cell = near.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), part.column(0), part.column(1), part.column(2), pa.array(near[np.arange(len(part)), cell])], names=["cell", "id", "vec", "least", "near"])

    seated = cut(asked.select("id", "vec", "least").mapInArrow(seat, "cell int, id bigint, vec array<float>, least double, near double"))
    stats = {r.cell: r for r in seated.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("near").alias("near"), F.min("least").alias("least")).collect()}  # at most ROUNDS * LEADERS rows
    used = sorted(stats)
    angle = lambda c: np.arccos(np.clip(c, -1, 1))
    reach = np.array([np.cos(min(np.pi, angle(stats[c].near) + angle(max(stats[c].least, floor) - 1e-6) + 1e-6)) for c in used])
    blocks = np.array([-(-stats[c].n // BLOCK) for c in used])
    start = np.concatenate([[0], np.cumsum(blocks)])
    centres = led[used]

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, len(batch), 1024):
                part = batch.slice(s, 1024)
                rows, cells = np.nonzero(_units(part.column(1), len(part), dimension) @ centres.T >= reach)
                times = blocks[cells]
                nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                key, at = np.repeat(start[cells], times) + nth, np.repeat(rows, times)
                for p in range(0, len(at), 10_000):
                    take = pa.array(at[p : p + 10_000])
                    yield pa.RecordBatch.from_arrays([pa.array(key[p : p + 10_000].astype(np.int64)), pa.array(np.ones(len(take), np.int32)), part.column(0).take(take), part.column(1).take(take)], names=["key", "side", "id", "vec"])

    shape = "key bigint, side int, id bigint, vec array<float>"
    spark = vectors.sparkSession
    places = spark.createDataFrame([(int(c), int(start[i]), int(blocks[i])) for i, c in enumerate(used)], "cell int, start long, blocks long")
    queries = seated.join(F.broadcast(places), "cell").select((F.col("start") + F.pmod(F.xxhash64("id"), F.col("blocks"))).alias("key"), F.lit(0).alias("side"), "id", "vec")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(int(start[-1]), 4096))
    dealt = queries.unionByName(vectors.select("id", "vec").mapInArrow(reached, shape)).repartition(n, "key").sortWithinPartitions("key", "side", "id")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, state, seen = None, [], None, 0  # state: ids and unit vectors of the block's queries, their best sims and others so far

        def result(state):
            ids, _, sims, others = state
            rows, cols = np.nonzero(sims >= floor)
            return pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(others[rows, cols]), pa.array(sims[rows, cols])], names=["id", "other", "sim"])

        for batch in batches:
            if not len(batch):
                continue
            groups = batch.column(0).to_numpy() * 2 + batch.column(1).to_numpy()
            ends = np.append(np.flatnonzero(groups[1:] != groups[:-1]) + 1, len(groups))
            ids, x = batch.column(2).to_numpy(), _units(batch.column(3), len(batch), dimension)
            s = 0
            for e in ends:
                block, side = divmod(int(groups[s]), 2)
                if block != key:
                    if state is not None:
                        yield result(state)
                    key, held, state, seen = block, [], None, 0
                if side == 0:
                    held.append((ids[s:e], x[s:e]))
                elif state is None and held:
                    q = np.concatenate([h[0] for h in held])
                    state = (q, np.concatenate([h[1] for h in held]), np.full((len(q), k), -np.inf), np.zeros((len(q), k), np.int64))
                while side and state is not None and s < e:
                    m = min(e, s + min(4096, max(16, 3 * seen)))  # small chunks first, so that few are better than the k-th so far
                    _improve(state, ids[s:m], x[s:m], floor, digits)
                    seen, s = seen + m - s, m
                s = e
        if state is not None:
            yield result(state)

    return dealt.mapInArrow(scan, "id bigint, other bigint, sim double")


def _improve(state: tuple, others: np.ndarray, y: np.ndarray, floor: float, digits: int) -> None:
    """Takes ``others``, larger than all met before, into the best of the block's queries."""
    ids, x, best, found = state
    k = best.shape[1]
    for lo in range(0, len(ids), 512):
        s = x[lo : lo + 512] @ y.T
        own = np.searchsorted(ids[lo : lo + 512], others)
        same = np.flatnonzero((own < len(s)) & (ids[lo + np.minimum(own, len(s) - 1)] == others))
        s[own[same], same] = -2
        least = best[lo : lo + 512, -1]
        rows, cols = np.nonzero(s > np.maximum(least + 0.4 * 10.0**-digits, floor - 0.6 * 10.0**-digits)[:, None])
        v = np.round(s[rows, cols], digits)
        ok = (v > least[rows]) & (v >= floor)  # an equal one has the larger id
        if not ok.any():
            continue
        rows, cols, v = rows[ok], cols[ok], v[ok]
        some = np.unique(rows)
        r, o, v = np.concatenate([np.repeat(some, k), rows]), np.concatenate([found[lo + some].ravel(), others[cols]]), np.concatenate([best[lo + some].ravel(), v])
        at = np.lexsort((o, -v, r))
        r, o, v = r[at], o[at], v[at]
        first = np.searchsorted(r, some)
        at = (first[:, None] + np.arange(k)).ravel()
        best[lo + some], found[lo + some] = v[at].reshape(-1, k), o[at].reshape(-1, k)


def classes(vectors: DataFrame, keep: int) -> tuple[DataFrame, DataFrame, int]:
    """Of (id, vec): the copies (id, rep) in classes of two or more, the ``keep`` smallest ids of each class as an array by rep, and the number of copies."""
    digests = vectors.select("id", F.struct(F.xxhash64("vec").alias("a"), F.xxhash64(F.lit(7), "vec").alias("b")).alias("digest"))
    sizes = cut(digests.groupBy("digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("w")).filter("w > 1"))
    total = sizes.agg(F.sum("w")).first()[0] or 0
    members = cut(lookup_join(digests, sizes, "digest", "w", total).select("id", "rep"))
    w = Window.partitionBy("rep").orderBy("id")
    first = members.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= keep).groupBy("rep").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return members, first, total


def nearest(vectors: DataFrame, k: int = 5, floor: float = 0.9, id_col: str = "vec_id", vec_col: str = "vec", dimension: int = 64, trees: int = TREES, enough: int = ENOUGH, piece: int = PIECE, seed: int = 42) -> DataFrame:
    """(id, other, sim): of every vector, those of its ``k`` most similar others whose similarity is at least ``floor``."""
    v = F.col(vec_col).cast("array<float>")
    finite = (F.size(v) == dimension) & ~F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists(v, lambda e: e != 0)
    valid = vectors.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).filter(finite)
    valid = one_row_each(cut(valid.select(F.col(id_col).cast("bigint").alias("id"), v.alias("vec"))), "id", "vec")
    members, first, total = classes(valid, k + 1)
    reps = valid.join(members.filter("id <> rep").select("id"), "id", "left_anti")
    ranked = number_rows(hashed(reps, dimension, trees, BITS, seed), [F.col("tree"), F.col("hash"), F.col("id")], "rank")
    n = reps.count()
    noted = levels(ranked.withColumn("rank", F.col("rank") - F.col("tree") * F.lit(n)), n, enough, piece, BITS)
    found = candidates(noted, reps, n, dimension, k, floor, enough, piece, BITS).distinct()
    w = Window.partitionBy("id").orderBy(F.desc_nulls_first("sim"), "other")
    best = cut(found.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k + 1).drop("r"))  # one more, as the row of a crowded one is first
    crowded = best.filter("other IS NULL").select("id")
    best = best.filter("other IS NOT NULL")
    bound = best.join(crowded, "id", "left_semi").groupBy("id").agg(F.when(F.count(F.lit(1)) >= k, F.min("sim")).alias("least"))
    asked = cut(reps.join(crowded, "id").join(bound, "id", "left").withColumn("least", F.coalesce("least", F.lit(floor))))
    settled = settle(reps, asked, dimension, k, floor)
    if settled is not None:
        best = best.join(crowded, "id", "left_anti").unionByName(cut(settled))
    # answers of representatives: their own copies, and the first ids of their neighbours' classes; at most (k + 1)^2 entries
    ids = lambda c: F.coalesce(F.col("ids"), F.array(c))
    others = best.join(first, best["other"] == first["rep"], "left").select("id", "sim", F.explode(ids("other")).alias("other"))
    own = first.select(F.col("rep").alias("id"), F.lit(1.0).alias("sim"), F.explode("ids").alias("other"))
    ranked = others.unionByName(own).groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("d"), F.col("other").alias("other")))).alias("answer"))
    ranked = cut(ranked.select("id", F.slice("answer", 1, k + 1).alias("answer")))
    single = ranked.join(members.select("id"), "id", "left_anti")
    weighed = ranked.join(members.groupBy(F.col("rep").alias("id")).agg(F.count(F.lit(1)).alias("w")), "id").withColumnRenamed("id", "rep")
    copied = lookup_join(members, weighed, "rep", "w", total).select("id", "answer")
    per = single.unionByName(copied).select("id", F.slice(F.filter("answer", lambda e: e["other"] != F.col("id")), 1, k).alias("answer"))
    return per.select("id", F.explode("answer").alias("e")).select("id", F.col("e.other").alias("other"), (-F.col("e.d")).alias("sim"))


def pairs(found: DataFrame) -> DataFrame:
    """(a, b): unordered pairs in which one is in the other's answer."""
    return found.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
