"""Stretches of text that stand verbatim in more than one record.

Every record is a reference for every other. Records are indexed by blocks: BLOCK-grams whose hash is the least in some
window of ``length`` - BLOCK + 1 grams, so any stretch of ``length`` characters has at least one block, and two records
that share the stretch have the same one there. Against each reference block that another record has too, the match is taken
to the right and, as the left boundary is checked, to the left. Only the ``length`` - BLOCK characters on either side
of a block matter to decide whether a stretch of ``length`` is there, so only these travel, and equal surroundings
are one class however many records have them. Classes are compared character for character; where more than CROWD
classes share a block, every ``length``-gram over the block is a class of its own, and equal grams are met by a grouping
instead of by comparing pairs. A record is then parsed from left to right: from where it stands, the match that reaches
furthest is its next factor, and it goes on from that factor's end; a match that begins inside the factor before is checked back, so
nothing is lost at a border. A greedy parse alone keeps one source per position; which records share a stretch needs all, so
the operator's output is sets of records with the same stretch and links between sets, and only ``pairs`` expands them.

Cases: null texts and texts shorter than ``length`` share nothing; equal texts of at least ``length`` characters share
all; a stretch repeated within one record only isn't shared; characters are code points, compared without any
normalisation; texts of any length are read whole, in pieces that overlap by ``length`` - 1; rows with a null id are left out, a repeated
id counts as one record with the smallest of its texts; an empty table gives empty results; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bandwright.operators.skew import lookup_join, one_row_each
from bandwright.session import cut

LENGTH = 200
BLOCK = 80
CROWD = 64
#: Records of a set that meet those of another at once.
PART = 1024
PIECE = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i mod 2**64, i < n."""
    up, down = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def blocks_of(codes: np.ndarray, ends: np.ndarray, length: int, block: int, powers) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the blocks of the texts that end at ``ends`` in ``codes``."""
    n, wide = len(codes), length - block + 1
    if n < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    up, down = powers
    c = codes.astype(np.uint64) + np.uint64(0x51ED27)
    c *= np.uint64(0xFF51AFD7ED558CCD)
    c ^= c >> np.uint64(29)
    c *= up[:n]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(c, out=sums[1:])
    h = (sums[block:] - sums[:-block]) * down[: n - block + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    place = np.uint64(21)  # positions in a piece fit 21 bits; the leftmost of equal hashes wins
    key = (h >> place << place) | np.arange(len(h), dtype=np.uint64)
    least, span = key, 1
    while span * 2 <= wide:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < wide:
        least = np.minimum(least[: len(least) - (wide - span)], least[wide - span :])
    whole = np.ones(len(least), bool)  # windows within one text
    for e in ends[:-1]:
        whole[max(0, e - length + 1) : e] = False
    at = least[whole]
    at = (at[np.concatenate([[True], at[1:] != at[:-1]])] & np.uint64((1 << 21) - 1)).astype(np.int64)
    return at, h[at]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


def index(records: DataFrame, length: int, block: int) -> DataFrame:
    """(h, id, pos) of the blocks of (id, text)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _powers(2 * PIECE)
        held: list = []
        size = 0

        def out():
            ends = np.cumsum([len(c) for _, _, c in held])
            at, h = blocks_of(np.concatenate([c for _, _, c in held]), ends, length, block, powers)
            which = np.searchsorted(ends, at, side="right")
            ids, offsets = np.array([i for i, _, _ in held]), np.array([o for _, o, _ in held])
            pos = at - (ends - np.array([len(c) for _, _, c in held]))[which] + offsets[which]
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ids[which], pa.int64()), pa.array(pos, pa.int64())], names=["h", "id", "pos"])

        for batch in batches:
            for i, text in zip(batch.column(0), batch.column(1), strict=True):
                codes = _codes(text.as_py())
                for o in range(0, max(1, len(codes) - length + 1), PIECE - length + 1):
                    held.append((i.as_py(), o, codes[o : o + PIECE]))
                    size += len(held[-1][2])
                    if size >= PIECE:
                        yield out()
                        held, size = [], 0
        if held:
            yield out()

    return records.mapInArrow(scan, "h bigint, id bigint, pos bigint")


def surroundings(records: DataFrame, length: int, block: int) -> DataFrame:
    """(h, id, pos, off, around) of (id, text, at array<struct<h, pos>>): the block's text with what matters on either side."""
    side = length - block

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hs, ids, ps, offs, texts = [], [], [], [], []
            for i, text, at in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                i, text = i.as_py(), text.as_py()
                for b in at.as_py():
                    p = b["pos"]
                    hs.append(b["h"]), ids.append(i), ps.append(p), offs.append(min(p, side)), texts.append(text[max(0, p - side) : p + length])
                if len(hs) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), pa.array(ids, pa.int64()), pa.array(ps, pa.int64()), pa.array(offs, pa.int32()), pa.array(texts, pa.string())], names=["h", "id", "pos", "off", "around"])
                    hs, ids, ps, offs, texts = [], [], [], [], []
            yield pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), pa.array(ids, pa.int64()), pa.array(ps, pa.int64()), pa.array(offs, pa.int32()), pa.array(texts, pa.string())], names=["h", "id", "pos", "off", "around"])

    return records.mapInArrow(scan, "h bigint, id bigint, pos bigint, off int, around string")


def common(a: str, b: str) -> int:
    """Length of the longest common beginning, by halving: slices compare at C speed."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def factor(a: str, a_off: int, b: str, b_off: int) -> tuple[int, int]:
    """How far the match at the block goes back, and how far from it to the right."""
    return common(a[:a_off][::-1], b[:b_off][::-1]), common(a[a_off:], b[b_off:])


def factors(classes: DataFrame, length: int, crowd: int) -> DataFrame:
    """(one, other, back, forth) of classes (h, cls, off, around) that share a stretch over their block; classes of a block are at most ``crowd``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None

        def out(group):
            found = []
            for (c, co, ct), (d, do, dt) in combinations(group, 2):
                back, forth = factor(ct, co, dt, do)
                if back + forth >= length:
                    found.append((c, d, back, forth))
            return found

        def batch_of(found):
            cols = list(zip(*found, strict=True)) if found else [[], [], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.int32()), strict=True)], names=["one", "other", "back", "forth"])

        for batch in batches:
            found = []
            for h, c, o, t in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                if h != last and held:
                    found += out(held)
                    held = []
                last = h
                held.append((c, o, t))
            yield batch_of(found)
        yield batch_of(out(held))

    ordered = classes.select("h", "cls", "off", "around").repartition("h").sortWithinPartitions("h")
    return ordered.mapInArrow(scan, "one string, other string, back int, forth int")


class Shared:
    """Tables of one run: ``places`` (cls, id, pos, off), classes of equal stretches, and ``links`` between classes."""

    def __init__(self, records: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, block: int = BLOCK, crowd: int = CROWD) -> None:
        self.length, side = length, length - block
        texts = records.filter(F.col(id_col).isNotNull() & (F.length(text_col) >= length)).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
        texts = one_row_each(texts, "id", "text")
        grams = cut(index(texts, length, block))
        known = cut(grams.groupBy("h").agg(F.count(F.lit(1)).alias("w"), F.min("id").alias("a"), F.max("id").alias("b")).filter("a < b").select("h", "w"))
        total = known.agg(F.sum("w")).first()[0] or 0
        at = lookup_join(grams, known, "h", "w", total).distinct().groupBy("id").agg(F.collect_list(F.struct("h", "pos")).alias("at"))
        around = surroundings(texts.join(at, "id").select("id", "text", "at"), length, block)
        around = cut(around.withColumn("cls", F.md5(F.concat_ws("|", F.hex("h"), F.col("off").cast("string"), "around"))))
        classes = cut(around.groupBy("cls").agg(F.first("h").alias("h"), F.first("off").alias("off"), F.first("around").alias("around")))
        counts = cut(classes.groupBy("h").agg(F.count(F.lit(1)).alias("w")).filter("w > 1"))
        few = classes.join(counts.filter(F.col("w") <= crowd).select("h"), "h")
        self.links = cut(factors(few, length, crowd))
        # crowded blocks: every gram of the stretch's length over the block is a class
        many = counts.filter(F.col("w") > crowd)
        crowded = lookup_join(classes, many, "h", "w", many.agg(F.sum("w")).first()[0] or 0).select("cls", "off", "around")
        starts = F.sequence(F.lit(0), F.length("around") - length)
        grams = crowded.filter(F.length("around") >= length).select("cls", "off", "around", F.explode(starts).alias("s")).filter(f"s <= off AND s >= off - {side}")
        grams = grams.select("cls", "off", "s", F.md5(F.substring(F.col("around"), F.col("s") + 1, F.lit(length))).alias("gram"))
        shared = cut(grams)
        sizes = shared.groupBy("gram").agg(F.count(F.lit(1)).alias("w"), F.min("cls").alias("a"), F.max("cls").alias("b")).filter("a < b").select("gram", "w")
        self.crowded = cut(lookup_join(shared, cut(sizes), "gram", "w", shared.count()))
        self.places = around.select("cls", "id", "pos", "off", F.length("around").alias("size"))

    def sets(self) -> tuple[DataFrame, DataFrame]:
        """(members: set, id) and (links: one, other) of sets of records: equal sets of several classes are one."""
        own = self.places.select("cls", "id").distinct()
        over = self.crowded.select("gram", "cls").join(own, "cls").select(F.concat(F.lit("g"), "gram").alias("cls"), "id").distinct()
        members = cut(own.unionByName(over))
        marks = members.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), "id")).alias("y"))
        marks = cut(marks.select("cls", F.concat_ws(":", "n", "x", "y").alias("set"), "n"))
        kept = marks.groupBy("set").agg(F.min("cls").alias("cls"), F.first("n").alias("n"))
        kept = kept.withColumn("w", F.col("n"))
        members = lookup_join(members, kept, "cls", "w", members.count()).select("set", "id", "n")
        name = lambda c: marks.select(F.col("cls").alias(c), F.col("set").alias(f"{c}_set"))
        links = self.links.select("one", "other").join(name("one"), "one").join(name("other"), "other").select("one_set", "other_set").distinct()
        return cut(members), links

    def pairs(self) -> DataFrame:
        """(a, b): pairs of records that share a stretch.

        Sets are cut into parts of some PART records, and each two parts of linked sets (and of a set itself) meet apart, so a set with a
        third of all records is spread over many tasks.
        """
        members, links = self.sets()
        sized = members.filter("n > 1").select("set", "n").distinct()
        linked = links.unionByName(sized.select(F.col("set").alias("one_set"), F.col("set").alias("other_set")))
        parts = members.select("set", F.ceil(F.col("n") / PART).cast("int").alias("parts")).distinct()
        of = lambda c: parts.select(F.col("set").alias(f"{c}_set"), F.col("parts").alias(f"{c}_parts"))
        each = linked.join(of("one"), "one_set").join(of("other"), "other_set")
        for c in ("one", "other"):
            each = each.withColumn(f"{c}_part", F.explode(F.sequence(F.lit(0), F.col(f"{c}_parts") - 1)))
        each = each.filter("one_set <> other_set OR one_part <= other_part").select("one_set", "one_part", "other_set", "other_part").distinct()
        part = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / PART)).cast("int")
        rows = cut(members.select("set", part.alias("part"), "id"))
        side = lambda c, x: rows.select(F.col("set").alias(f"{c}_set"), F.col("part").alias(f"{c}_part"), F.col("id").alias(x))
        both = each.join(side("one", "x"), ["one_set", "one_part"]).join(side("other", "y"), ["other_set", "other_part"])
        inside = (F.col("one_set") == F.col("other_set")) & (F.col("one_part") == F.col("other_part"))
        both = both.filter((F.col("x") < F.col("y")) | (~inside & (F.col("x") > F.col("y"))))
        return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    def matches(self) -> DataFrame:
        """(id, lo, hi): stretches of records, end exclusive, that stand in another record too; of those with one beginning the longest.

        What a class shares is counted from its block and made once; its records look it up, with heavy classes apart.
        """
        length = self.length
        owners = cut(self.places.groupBy("cls").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count(F.lit(1)).alias("w"), F.first("off").alias("off"), F.first("size").alias("size")))
        both = self.links.select(F.col("one").alias("cls"), F.col("other").alias("with"), "back", "forth").unionByName(self.links.select(F.col("other").alias("cls"), F.col("one").alias("with"), "back", "forth"))
        rival = both.join(owners.select(F.col("cls").alias("with"), "a", "b"), "with").groupBy("cls", (-F.col("back")).alias("lo"), F.col("forth").alias("hi")).agg(F.min("a").alias("a"), F.max("b").alias("b"))
        equal = owners.filter("a < b").select("cls", (-F.col("off")).alias("lo"), (F.col("size") - F.col("off")).alias("hi"), "a", "b")
        grams = self.crowded.join(owners.select("cls", "a", "b"), "cls")
        shared = grams.groupBy("gram").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.count(F.lit(1)).alias("w")).filter("a < b")
        crowd = lookup_join(cut(grams.select("cls", "gram", (F.col("s") - F.col("off")).alias("lo"))), cut(shared), "gram", "w", self.crowded.count())
        crowd = crowd.select("cls", "lo", (F.col("lo") + length).alias("hi"), "a", "b")
        spans = rival.unionByName(equal).unionByName(crowd).groupBy("cls").agg(F.collect_list(F.struct("lo", "hi", "a", "b")).alias("spans"))  # at most CROWD, or a gram for each beginning
        total = owners.agg(F.sum("w")).first()[0] or 0
        met = lookup_join(self.places.select("cls", "id", "pos"), cut(spans.join(owners.select("cls", "w"), "cls")), "cls", "w", total)
        each = met.select("id", "pos", F.inline("spans")).filter("a <> id OR b <> id")
        return each.groupBy("id", (F.col("pos") + F.col("lo")).alias("lo")).agg(F.max(F.col("pos") + F.col("hi")).alias("hi"))


def parse(matches: DataFrame) -> DataFrame:
    """(id, lo, hi, new): the factors of each record, from left to right; ``new`` is how many of its characters the factor before doesn't have.

    From where the record stands, the match that reaches furthest is next; if none goes on from there, the next one to begin is.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, end, best = None, 0, None  # record, where its last factor ends, and the match that reaches furthest from there

        def batch_of(found):
            cols = list(zip(*found, strict=True)) if found else [[], [], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["id", "lo", "hi", "new"])

        for batch in batches:
            found = []

            def take():
                nonlocal end, best
                if best is not None:
                    found.append((at, *best, best[1] - max(end, best[0])))
                    end, best = best[1], None

            for i, lo, hi in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if i != at:
                    take()
                    at, end = i, 0
                if best is not None and lo > end and (best[0] <= end or lo > best[0]):
                    take()
                if hi > end and (best is None or hi > best[1]):
                    best = (lo, hi)
            yield batch_of(found)
        if best is not None:
            yield batch_of([(at, *best, best[1] - max(end, best[0]))])

    return matches.select("id", "lo", "hi").repartition("id").sortWithinPartitions("id", "lo").mapInArrow(scan, "id bigint, lo bigint, hi bigint, new bigint")


def coverage(factors: DataFrame, records: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chars, shared_chars, share) of every record; the share of an empty text is null."""
    sums = factors.groupBy("id").agg(F.sum("new").alias("shared_chars"))
    all_ = records.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("bigint").alias("id")).agg(F.max(F.coalesce(F.length(text_col), F.lit(0))).cast("bigint").alias("chars"))
    joined = all_.join(sums, "id", "left").withColumn("shared_chars", F.coalesce("shared_chars", F.lit(0)))
    return joined.select("id", "chars", "shared_chars", F.try_divide("shared_chars", "chars").alias("share"))
