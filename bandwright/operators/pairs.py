"""The pair relation: a cached question, a new question, and whether one answer serves both."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from bandwright.functions.taxonomy import derived, language
from bandwright.functions.text import fold, strip


def pair_relation(final: DataFrame) -> DataFrame:
    """Pairs of known axes with derived label and group, folded domain and language; ``hit`` is 1 for HIT."""
    rows = derived(final).withColumn("domain", fold(F.col("domain"))).withColumn("hit", (F.col("expected_label") == "HIT").cast("int"))
    return rows.withColumn("lang", language(F.col("domain")))


def _signed(grams: DataFrame, *keep: str) -> DataFrame:
    """(keep, bucket, sign) of trigrams ``g``: of the md5, hex digits 15 and 16 are the bucket (kept as text) and an odd 14th digit is a plus."""
    hashed = grams.withColumn("h", F.md5("g"))
    sign = F.when(F.substring("h", 14, 1).isin(*"13579bdf"), 1).otherwise(-1)
    return hashed.select(*keep, F.substring("h", 15, 2).alias("bucket"), sign.alias("sign"))


def _padded(c: str):
    return F.concat(F.lit("  "), strip(F.lower(F.coalesce(F.col(c), F.lit("")))), F.lit("  "))


def embed(texts: DataFrame, text: str = "text") -> DataFrame:
    """(text, bucket, v): the sparse 256-dimensional vector of each distinct text, before normalising; zeros are absent."""
    rows = texts.select(text).distinct().withColumn("__p", _padded(text))
    each = rows.select(text, "__p", F.explode(F.sequence(F.lit(1), F.length("__p") - 2)).alias("i"))
    grams = _signed(each.select(text, F.substring(F.col("__p"), F.col("i"), F.lit(3)).alias("g")), text)
    return grams.groupBy(text, "bucket").agg(F.sum("sign").alias("v")).filter("v <> 0")


class _Signs:
    """Bucket and sign of trigrams, each hashed once a task; as a vocabulary has few trigrams, that is next to nothing."""

    def __init__(self) -> None:
        self.codes, self.at, self.sign = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

    def of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        some, back = np.unique(codes, return_inverse=True)
        new = np.setdiff1d(some, self.codes, assume_unique=True)
        if len(new):
            hashes = [hashlib.md5("".join(chr(c >> 21 * k & 0x1FFFFF) for k in range(3)).encode("utf-8", "surrogatepass")).hexdigest() for c in new.tolist()]
            codes_ = np.concatenate([self.codes, new])
            order = np.argsort(codes_)
            self.at = np.concatenate([self.at, [int(h[14:16], 16) for h in hashes]])[order]
            self.sign = np.concatenate([self.sign, [1 if int(h[13], 16) % 2 else -1 for h in hashes]])[order]
            self.codes = codes_[order]
        place = np.searchsorted(self.codes, some)[back]
        return self.at[place], self.sign[place]


def _vectors(texts: list[str], signs: _Signs) -> np.ndarray:
    """Vectors of padded texts, all of three or more characters."""
    lens = np.array([len(t) for t in texts], dtype=np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(texts)), lens)
    at = np.flatnonzero(np.arange(len(points)) < (np.cumsum(lens) - 2)[row])
    bucket, sign = signs.of(points[at] | points[at + 1] << 21 | points[at + 2] << 42)
    return np.bincount(row[at] * 256 + bucket, weights=sign, minlength=256 * len(texts)).reshape(len(texts), 256)


def pair_cosine(pairs: DataFrame, a: str = "seed_question", b: str = "variation", key: str = "id") -> DataFrame:
    """(key, sim): cosine of the trigram vectors of two texts. Sums are whole numbers, so the result is the same on every engine; a null text counts as empty; a zero vector gives 0.

    Row by row within Arrow batches, a few thousand texts at once as arrays of code points: nothing is exploded or shuffled.
    """
    rows = pairs.select(key, _padded(a).alias("a"), _padded(b).alias("b"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs = _Signs()
        for batch in batches:
            for s in range(0, len(batch), 2048):
                part = batch.slice(s, 2048)
                x, y = (_vectors(part.column(c).to_pylist(), signs) for c in (1, 2))
                xy, xx, yy = (np.einsum("ij,ij->i", p, q) for p, q in ((x, y), (x, x), (y, y)))
                length = np.sqrt(xx * yy)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.where(length == 0, 0.0, xy / np.where(length == 0, 1.0, length)))], names=[key, "sim"])

    return rows.mapInArrow(compare, StructType([rows.schema[key], StructField("sim", DoubleType())]))
