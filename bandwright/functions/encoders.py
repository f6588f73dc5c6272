"""Pluggable encoders and pair scorers: a model is a function of a batch of texts, run in Arrow batches.

No model comes with the engine; the hashed trigram vectors (operators.pairs) are its own encoder, in Spark expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Prefixes that families of models want before a text; fixed values.
PREFIXES = {"e5": "query: ", "nomic": "search_query: "}


def encode(texts: DataFrame, text: str, load: Callable[[], Callable[[list[str]], list[list[float]]]], prefix: str = "", batch: int = 64) -> DataFrame:
    """(text, vec) of each distinct text; ``load`` makes the model once a task, vectors are normalised."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np

        model = load()
        for part in parts:
            out = []
            for at in range(0, len(part), batch):
                x = np.asarray(model([prefix + (t or "") for t in part[at : at + batch]]), dtype=np.float64)
                n = np.linalg.norm(x, axis=1, keepdims=True)
                out += (x / np.where(n == 0, 1, n)).astype(np.float32).tolist()
            yield pd.Series(out)

    return texts.select(text).distinct().withColumn("vec", run(F.col(text)))


def score(a: Column, b: Column, load: Callable[[], Callable[[list[tuple[str, str]]], list[float]]]) -> Column:
    """A cross scorer's value of two texts; ``load`` makes the model once a task."""

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for x, y in parts:
            yield pd.Series(model([(p or "", q or "") for p, q in zip(x, y, strict=True)]), dtype="float64")

    return run(a, b)
