"""Near-duplicate rows by character shingles: MinHash-LSH with collision semantics, and exact Jaccard.

Shingles are the distinct trigrams of the lower-case text, held as numbers (three code points of 21 bits, so no two are alike); a
shorter text is a shingle of its own. They are made where they are needed, in Arrow batches, and never travel: texts do. Null
texts take no part: each such row is a class of its own. Both drop rows greedily in order of id: a row falls if it meets a smaller row that stays, and a row that fell drops none. The
order is total, so the greedy result is found in rounds over tables: rows that are the smallest still open at all
their keys stay, rows that share a key with one that stays fall, until none is open.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from bandwright.operators.skew import lookup_join
from bandwright.session import cut, release

PERMUTATIONS = 64
#: Bands and rows that the LSH parameter search gives for 64 permutations and threshold 0.9.
BANDS, ROWS = 3, 21
PRIME = (1 << 31) - 1


def _coefficients(n: int, seed: int = 1) -> list[tuple[int, int]]:
    out, x = [], seed
    for _ in range(n):
        pair = []
        for _ in range(2):
            x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
            pair.append((x >> 33) % (PRIME - 1) + 1)
        out.append(tuple(pair))
    return out


def _flat(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ..., of every stretch as many as ``lens`` says."""
    ends = np.cumsum(lens)
    return np.repeat(starts - ends + lens, lens) + np.arange(ends[-1] if len(ends) else 0)


def _sorted_within(values: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Sorts each of the stretches that ``values`` consists of: stretches of about one length as the rows of a matrix."""
    starts, order = np.cumsum(lens) - lens, np.argsort(lens, kind="stable")
    out, ranked, at = np.empty_like(values), lens[order], 0
    while at < len(order):
        to = min(int(np.searchsorted(ranked, ranked[at] * 5 // 4 + 4, side="right")), at + max(1, 4_000_000 // int(ranked[at] * 5 // 4 + 4)))
        rows, wide = order[at:to], int(ranked[to - 1])
        inside = np.arange(wide) < lens[rows][:, None]
        held, matrix = _flat(starts[rows], lens[rows]), np.full(inside.shape, np.iinfo(np.int64).max)
        matrix[inside] = values[held]
        matrix.sort(axis=1)
        out[held] = matrix[inside]
        at = to
    return out


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle) of the texts' distinct shingles, in order of both."""
    lens = np.array([len(t) for t in texts], dtype=np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    many = np.maximum(lens - 2, 1)
    row, found = np.repeat(np.arange(len(texts)), many), np.empty(many.sum(), np.int64)
    whole = (lens > 2)[row]
    at = _flat((np.cumsum(lens) - lens)[lens > 2], many[lens > 2])
    found[whole] = points[at] | points[at + 1] << 21 | points[at + 2] << 42
    found[~whole] = [-1 - sum(ord(c) + 1 << 21 * k for k, c in enumerate(texts[i])) for i in np.flatnonzero(lens < 3)]
    found = _sorted_within(found, many)
    new = np.append(True, (found[1:] != found[:-1]) | (row[1:] != row[:-1])) if len(row) else np.zeros(0, bool)
    return row[new], found[new]


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """64 well-mixed bits of each number."""
    h = x.astype(np.uint64) + np.uint64(salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019 & (1 << 64) - 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ h >> np.uint64(shift)) * np.uint64(factor)
    return h ^ h >> np.uint64(31)


def _texts(rows: DataFrame, id_col: str, text: str) -> DataFrame:
    return rows.select(F.col(id_col).alias("id"), F.lower(F.col(text)).alias("text")).filter("text IS NOT NULL")


def band_keys(rows: DataFrame, id_col: str, text: str, permutations: int = PERMUTATIONS, bands: int = BANDS, per: int = ROWS) -> DataFrame:
    """(id, key): the band keys of each row's MinHash signature, made row by row within the batch: nothing is shuffled."""
    source = _texts(rows, id_col, text)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            row, found = codes(batch.column(1).to_pylist())
            h = (_mixed(found, 0) % np.uint64(PRIME)).astype(np.int64)
            starts = np.searchsorted(row, np.arange(len(batch)))
            keys = [np.full(len(batch), k, np.uint64) for k in range(bands)]
            for i, (a, b) in enumerate(_coefficients(permutations)[: bands * per]):
                least = np.minimum.reduceat((h * a + b) % PRIME, starts)
                keys[i // per] = _mixed(keys[i // per] * np.uint64(31) + least.astype(np.uint64), 1)
            flat = pa.array(np.stack(keys, axis=1).ravel().view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, bands * len(batch) + 1, bands, dtype=np.int32)), flat)], names=["id", "keys"])

    signed = source.mapInArrow(sign, StructType([source.schema["id"], *StructType.fromDDL("keys array<bigint>").fields]))
    return signed.select("id", F.explode("keys").alias("key"))


def greedy(keys: DataFrame) -> DataFrame:
    """(id, keeper) of rows that fall, from (id, key) incidences; keeper is the smallest row that stays and shares a key.

    Keys of one row only can't decide anything and are dropped first. A key's rows are only ever aggregated (their minimum), never paired.
    """
    shared = keys.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a < b").select("key")
    whole = open_ = cut(keys.join(shared, "key").distinct())
    staying = whole.select("id").limit(0)
    while not open_.isEmpty():
        least = open_.groupBy("key").agg(F.min("id").alias("first"))
        stay = cut(open_.join(least, "key").groupBy("id").agg(F.bool_and(F.col("first") == F.col("id")).alias("s")).filter("s").select("id"))
        taken = open_.join(stay, "id").select("key").distinct()
        gone = open_.join(taken, "key").select("id").distinct()  # those that stay and those that fall
        before, open_ = open_, cut(open_.join(gone, "id", "left_anti"))
        if before is not whole:
            release(before)
        staying = staying.unionByName(stay)
    holders = whole.join(staying, "id").select("key", F.col("id").alias("keeper"))  # one per key at most
    met = whole.join(staying, "id", "left_anti").join(holders, "key").filter("keeper < id")
    return met.groupBy("id").agg(F.min("keeper").alias("keeper"))


def classes(rows: DataFrame, id_col: str, fallen: DataFrame) -> DataFrame:
    """(id, class_id): a row that stays is its own class, one that fell has its keeper's."""
    return rows.select(F.col(id_col).alias("id")).join(fallen, "id", "left").select("id", F.coalesce("keeper", "id").alias("class_id"))


def lsh(rows: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, class_id) under LSH: sharing a band key is enough, similarity isn't verified."""
    return classes(rows, id_col, greedy(cut(band_keys(rows, id_col, text))))


#: Rows of one key that one task compares; more are split into blocks, and each two blocks are compared apart.
SPLIT = 4096
#: Bytes that a task reads before it compares rows of equal keys, and pairs that it looks at together.
BYTES_AT_ONCE, PAIRS_AT_ONCE = 2_000_000, 100_000


def classes_of_sets(rows: DataFrame, id_col: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(id, rep) of every row with a text, rows with equal shingle sets sharing the smallest id as rep, and (id, text, w) of the reps with the number of their rows."""
    source = _texts(rows, id_col, text)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                row, found = codes(batch.column(1).to_pylist())
                starts = np.searchsorted(row, np.arange(len(batch)))
                sums = [np.add.reduceat(_mixed(found, salt), starts).view(np.int64) for salt in (3, 4)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, sums), batch.column(1)], names=["id", "x", "y", "text"])

    marked = source.mapInArrow(digest, StructType([source.schema["id"], *StructType.fromDDL("x bigint, y bigint, text string").fields]))
    keyed = cut(marked.select("id", F.struct("x", "y").alias("digest"), "text"))
    sets = cut(keyed.groupBy("digest").agg(F.min(F.struct("id", "text")).alias("first"), F.count(F.lit(1)).alias("w")))
    members = lookup_join(keyed.select("id", "digest"), sets.select("digest", F.col("first.id").alias("rep"), "w"), "digest", "w", keyed.count())
    return cut(members.select("id", "rep")), cut(sets.select("first.id", "first.text", "w"))


class Parts:
    """Parts of all shingles, so many that two similar sets must be equal in one.

    Sets of sizes a and b that are similar differ in at most (a + b)(1 - threshold) / (1 + threshold) shingles, so of more parts than that one
    holds none of these. A pair goes by the number of parts that its larger set takes; numbers are coarse, so most sizes need one only.
    """

    def __init__(self, threshold: float) -> None:
        self.threshold, self.numbers = threshold, [1]

    def apart(self, both: np.ndarray) -> np.ndarray:
        """The shingles, of one set only, that similar sets have at most, by the sum of their sizes."""
        return np.floor(both * (1 - self.threshold) / (1 + self.threshold) + 1e-6).astype(np.int64)

    def of(self, n: np.ndarray) -> np.ndarray:
        """The place among ``numbers`` of the number of parts that sets of ``n`` shingles take."""
        least = self.apart(2 * n) + 1
        while self.numbers[-1] < least.max(initial=1):
            self.numbers.append(self.numbers[-1] + max(1, self.numbers[-1] // 3))
        return np.searchsorted(self.numbers, least)

    def taken(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places that sets of ``n`` shingles take for themselves, and the last that a larger similar set may take."""
        return self.of(n), self.of(np.floor(n / self.threshold + 1e-6).astype(np.int64))

    def keys(self, place: int, row: np.ndarray, mixed: np.ndarray, rows: int) -> np.ndarray:
        """(rows, parts): a number for the shingles that each row has in each part."""
        m = self.numbers[place]
        at = row * m + ((mixed >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        low, high = (np.bincount(at, half.astype(np.float64), rows * m).astype(np.uint64) for half in (mixed & np.uint64(0xFFFFFFFF), mixed >> np.uint64(32)))
        return _mixed((low + (high << np.uint64(32))).reshape(rows, m) + np.arange(m, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), m)


def postings(reps: DataFrame, threshold: float) -> tuple[DataFrame, Parts]:
    """(t, x, y, b, id, text, w) of the rows that share a key t with another, a key being what a row has in one part, and the parts.

    Keys that many rows have come once for each two blocks (x, y) of these rows; b is the row's own block.
    """
    parts = Parts(threshold)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            row, found = codes(batch.column(0).to_pylist())
            n, mixed = np.bincount(row, minlength=len(batch)), _mixed(found, 5)
            first, last = parts.taken(n)
            who, keys = [], []
            for place in range(int(first.min()), int(last.max()) + 1):
                some = (first <= place) & (place <= last)
                of = some[row]
                made = parts.keys(place, (np.cumsum(some) - 1)[row[of]], mixed[of], int(some.sum()))
                who.append(np.repeat(np.flatnonzero(some), made.shape[1]))
                keys.append(made.ravel())
            who, keys = np.concatenate(who), np.concatenate(keys)
            order = np.argsort(who, kind="stable")
            ends = np.append(0, np.cumsum(np.bincount(who, minlength=len(batch)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[order].view(np.int64))), *batch.columns], names=["keys", *batch.schema.names])

    plain = reps.select("text", "id", "w")
    signed = cut(plain.mapInArrow(sign, StructType([*StructType.fromDDL("keys array<bigint>").fields, *plain.schema.fields])).withColumn("keys", F.array_distinct("keys")))
    per = cut(signed.select(F.explode("keys").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"))
    total = per.agg(F.sum("c")).first()[0] or 0
    split = lookup_join(signed.select(F.explode("keys").alias("t"), "id"), per.withColumn("blocks", F.ceil(F.col("c") / SPLIT).cast("int")), "t", "c", total)
    split = split.withColumn("b", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    each = split.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    places = each.select("id", F.struct("t", F.least("b", "o").alias("x"), F.greatest("b", "o").alias("y"), "b").alias("at"))
    out = cut(places.join(signed.select("id", "text", "w"), "id").select("at.*", "id", "text", "w"))
    release(signed, per)
    return out, parts


def similar_within(texts: list[str], key: np.ndarray, group: np.ndarray, own: np.ndarray, parts: Parts, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of rows of one group whose sets are similar and have no earlier key in common (there they meet as well); of two ``own`` blocks where
    these aren't negative. ``group`` rises; sketches (256 parities of shingles) tell nearly all others apart before sets are compared."""
    row, found = codes(texts)
    size = np.bincount(row, minlength=len(texts))
    order = np.lexsort((size, group))
    n, g, u, t = size[order], group[order], own[order], key[order]
    mixed, starts = _mixed(found, 5), np.cumsum(size) - size
    bit, word = np.uint64(1) << (mixed & np.uint64(63)), mixed >> np.uint64(6) & np.uint64(3)
    sketch = [np.bitwise_xor.reduceat(np.where(word == np.uint64(k), bit, np.uint64(0)), starts)[order] for k in range(4)]
    place, last = parts.taken(n)
    keys = {}  # of each place that occurs as a pair's, and where the rows that take it have theirs: made when a pair comes this far
    wide = int(n.max()) + int(n.max() / parts.threshold) + 2
    to = np.searchsorted(g * wide + n, g * wide + np.floor(n / parts.threshold + 1e-6).astype(np.int64), side="right")
    per, bound = to - np.arange(len(n)) - 1, parts.apart(n + np.floor(n / parts.threshold + 1e-6).astype(np.int64))
    run = np.cumsum(per)
    lo = 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(run, (run[lo - 1] if lo else 0) + PAIRS_AT_ONCE, side="right")))
        j, many = _flat(np.arange(lo, hi) + 1, per[lo:hi]), per[lo:hi]
        near = np.flatnonzero(np.bitwise_count(np.repeat(sketch[0][lo:hi], many) ^ sketch[0][j]) <= np.repeat(bound[lo:hi], many))
        i, j = np.repeat(np.arange(lo, hi), many)[near], j[near]
        lo = hi
        if not len(i):
            continue
        most, apart = parts.apart(n[i] + n[j]), 0
        for s in sketch:
            apart = apart + np.bitwise_count(s[i] ^ s[j])
            near = apart <= most
            i, j, most, apart = i[near], j[near], most[near], apart[near]
        cross = (u[i] < 0) | (u[i] != u[j])
        i, j = i[cross], j[cross]
        first = np.zeros(len(i), bool)
        for k in np.unique(place[j]):  # j is the larger
            if k not in keys:
                takes = np.zeros(len(n), bool)
                takes[order] = (place <= k) & (k <= last)
                of, at = takes[row], np.cumsum(takes) - 1
                keys[k] = parts.keys(int(k), at[row[of]], mixed[of], int(takes.sum())), at[order]
            of, (made, at) = np.flatnonzero(place[j] == k), keys[k]
            a, b = made[at[i[of]]], made[at[j[of]]]
            at = (a == b).argmax(axis=1)
            first[of] = (a[np.arange(len(of)), at] == t[i[of]]) & (b[np.arange(len(of)), at] == t[i[of]])
        i, j = i[first], j[first]
        if len(i):
            lens = n[i] + n[j]
            held = _flat(np.stack([starts[order[i]], starts[order[j]]], axis=1).ravel(), np.stack([n[i], n[j]], axis=1).ravel())
            merged = _sorted_within(found[held], lens)
            ends = np.cumsum(lens)
            twice = np.append(merged[1:] == merged[:-1], False)
            twice[ends - 1] = False
            both = np.add.reduceat(twice.astype(np.int64), ends - lens)
            exact = both >= (lens - both) * threshold - 1e-9
            yield order[i[exact]], order[j[exact]]


def _meetings(posted: DataFrame, parts: Parts, threshold: float, each, out: StructType) -> DataFrame:
    """What ``each`` gives of rows and their similar pairs, (i, j) by (i, j), many keys at a time; ``posted`` has a column ``side``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(rows: pa.Table, group: np.ndarray):
            own = np.where(rows["x"].to_numpy() == rows["y"].to_numpy(), -1, rows["b"].to_numpy())
            yield from each(rows, similar_within(rows["text"].to_pylist(), rows["t"].to_numpy().view(np.uint64), group, own, parts, threshold))

        def whole(last: bool):
            """Compares the keys that are complete; rows of the last one stay, as more may come."""
            rows = pa.Table.from_batches(held).combine_chunks()
            keys = [rows[k].to_numpy() for k in ("t", "x", "y")]
            change = np.zeros(max(0, len(rows) - 1), bool)
            for k in keys:
                change |= k[1:] != k[:-1]
            group = np.append(0, np.cumsum(change))
            stop = len(rows) if last else int(np.searchsorted(group, group[-1]))
            alone = np.bincount(group[:stop])[group[:stop]] < 2 if stop else np.zeros(0, bool)
            some = np.flatnonzero(~alone)
            held[:] = rows.slice(stop).to_batches()
            if len(some):
                yield from done(rows.take(pa.array(some)).combine_chunks(), group[some])

        n = 0
        for batch in batches:
            if len(batch):
                held.append(batch)
                n += batch.nbytes
            if n >= BYTES_AT_ONCE:
                yield from whole(False)
                n = 0
        if held:
            yield from whole(True)

    n = int(posted.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # much work for few bytes: partitions aren't to be merged for their size
    ordered = posted.select("t", "x", "y", "b", "id", "text", "w", "side").repartition(n, "t", "x", "y").sortWithinPartitions("t", "x", "y")
    return ordered.mapInArrow(scan, out)


def _met(posted: DataFrame, parts: Parts, threshold: float) -> DataFrame:
    """The rows of ``posted`` that are similar to another at their key, with the number of rows they are similar to there and the smallest of their ids."""
    kind, names = posted.schema["id"], ["t", "x", "y", "b", "id", "text", "w"]

    def each(rows, pairs):
        ids, w = rows["id"].to_numpy(zero_copy_only=False), rows["w"].to_numpy()
        order = np.argsort(ids, kind="stable")
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        links, least = np.zeros(len(ids), np.int64), np.full(len(ids), len(ids))
        for i, j in pairs:
            for a, b in ((i, j), (j, i)):
                np.add.at(links, a, w[b])
                np.minimum.at(least, a, rank[b])
        at = np.flatnonzero(links)
        if len(at):
            some = rows.select(names).take(pa.array(at)).combine_chunks().to_batches()[0]
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(links[at]), rows["id"].combine_chunks().take(pa.array(order[least[at]]))], names=[*names, "links", "least"])

    out = StructType([*posted.select(*names).schema.fields, StructField("links", LongType()), StructField("least", kind.dataType)])
    return _meetings(posted.withColumn("side", F.lit(0)), parts, threshold, each, out)


def _by_id(met: DataFrame) -> DataFrame:
    return met.groupBy("id").agg(F.sum("links").alias("links"), F.min("least").alias("least"))


def _open(posted: DataFrame, parts: Parts, threshold: float) -> DataFrame:
    """(id, links, least): of every row that is similar to another of ``posted``, the rows that it is similar to and the smallest of their ids."""
    return _by_id(_met(posted, parts, threshold))


def _kept(posted: DataFrame, parts: Parts, threshold: float) -> DataFrame:
    """(id, keeper): of every row of side 0 that is similar to a smaller one of side 1, the smallest of these."""
    kind = posted.schema["id"]

    def each(rows, pairs):
        ids, side = rows["id"].to_numpy(zero_copy_only=False), rows["side"].to_numpy()
        for i, j in pairs:
            a, b = np.where(side[i] == 0, i, j), np.where(side[i] == 0, j, i)
            ok = (side[a] == 0) & (side[b] == 1) & (ids[b] < ids[a])
            a, b = a[ok], b[ok]
            if len(a):
                order = np.lexsort((ids[b], a))
                a, b = a[order], b[order]
                first = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
                yield pa.RecordBatch.from_arrays([pa.array(ids[a[first]]), pa.array(ids[b[first]])], names=["id", "keeper"])

    return _meetings(posted, parts, threshold, each, StructType([kind, StructField("keeper", kind.dataType)])).groupBy("id").agg(F.min("keeper").alias("keeper"))


def jaccard(rows: DataFrame, id_col: str, text: str, threshold: float = 0.9) -> DataFrame:
    """(id, class_id, links): greedy classes under true Jaccard, and how many other rows each row is similar to.

    Pairs are met where a part is equal, and only rows with counts and smallest neighbours, and keepers leave the task, never the pairs, so a
    family of m near-copies gives m rows at a key. A round settles the rows that have no smaller open neighbour (they stay) and their neighbours (they fall).
    """
    members, reps = classes_of_sets(rows, id_col, text)
    posted, parts = postings(reps, threshold)
    whole, posted = posted, cut(_met(posted, parts, threshold))  # rows at the keys where they met a similar one: what the rounds are about
    release(whole)
    met = cut(_by_id(posted))
    posted = posted.drop("links", "least")
    open_, near, left = met.select("id"), met, posted
    staying = None
    while not open_.isEmpty():
        stay = cut(open_.join(near.select("id", "least"), "id", "left").filter("least IS NULL OR least > id").select("id"))
        staying = stay if staying is None else staying.unionByName(stay)
        rest = open_.join(stay, "id", "left_anti")
        sides = stay.withColumn("side", F.lit(1)).unionByName(rest.withColumn("side", F.lit(0)))
        fall = _kept(left.join(sides, "id"), parts, threshold).select("id")
        last, open_ = (open_, near, left), cut(rest.join(fall, "id", "left_anti"))
        left = cut(left.join(open_, "id"))
        near = cut(_open(left, parts, threshold))
        release(*[t for t in last if t is not met and t is not posted])
    if staying is None:
        keeper = met.select("id", F.col("least").alias("keeper"))
    else:
        sides = met.select("id").join(staying, "id", "left_anti").withColumn("side", F.lit(0)).unionByName(staying.withColumn("side", F.lit(1)))
        keeper = cut(_kept(posted.join(sides, "id"), parts, threshold))
    facts = reps.select(F.col("id").alias("rep"), "w").join(met.select(F.col("id").alias("rep"), "links"), "rep", "left").join(keeper.withColumnRenamed("id", "rep"), "rep", "left")
    out = lookup_join(members, facts.withColumn("size", F.col("w")), "rep", "w", members.count())
    some_text = out.select("id", F.coalesce("keeper", "rep").alias("class_id"), (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    none = rows.filter(F.col(text).isNull()).select(F.col(id_col).alias("id"), F.col(id_col).alias("class_id"), F.lit(0).cast("bigint").alias("links"))
    return some_text.unionByName(none)
