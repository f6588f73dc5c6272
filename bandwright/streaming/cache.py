"""The cache simulation online: arrivals of a stream, one cache per cache key, entries kept in the state store.

Within a micro-batch the arrivals of a key are taken in order of ``pos``. An entry is stored on a miss and served to later
arrivals more similar than tau, as in the batch simulation, so both give the same rows for the same order. Beyond
``capacity`` the entry stored first (fifo) or used longest ago (lru) goes, and the state has no more entries than that;
without a capacity it grows with what is stored, and new entries are appended to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

OUT = "cache string, pos int, item int, stored int, sim double"
ENTRY = StructType([StructField("item", IntegerType()), StructField("vec", ArrayType(DoubleType())), StructField("used", LongType())])


class _Held:
    """Entries in the order they were stored, their vectors in one matrix that doubles when it is full."""

    def __init__(self, entries: list[tuple]) -> None:
        self.items = [e[0] for e in entries]
        self.used = [e[2] for e in entries]
        self.matrix = np.array([e[1] for e in entries], dtype=np.float64) if entries else None

    def add(self, item: int, x: np.ndarray, clock: int) -> None:
        n = len(self.items)
        if self.matrix is None:
            self.matrix = np.empty((16, len(x)))
        elif n == len(self.matrix):
            self.matrix = np.concatenate([self.matrix, np.empty_like(self.matrix)])
        self.matrix[n] = x
        self.items.append(item)
        self.used.append(clock)

    def drop(self, k: int) -> None:
        n = len(self.items)
        self.matrix[k : n - 1] = self.matrix[k + 1 : n]
        del self.items[k], self.used[k]

    def best(self, x: np.ndarray) -> tuple[int, float]:
        """The most similar entry, of equal ones the first stored."""
        sims = self.matrix[: len(self.items)] @ x
        k = int(np.argmax(sims))
        return k, float(sims[k])


class OnlineCache(StatefulProcessor):
    def __init__(self, tau: float, policy: str = "none", capacity: int = 0) -> None:
        self.tau, self.policy, self.capacity = tau, policy, capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getListState("entries", ENTRY)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        arrivals = pd.concat(list(rows)).sort_values("pos", kind="stable")
        held = _Held(list(self.entries.get()) if self.entries.exists() else [])
        inside, clock = set(held.items), max(held.used, default=-1) + 1
        out, new = [], []
        for r in arrivals.itertuples(index=False):
            x = np.asarray(r.vec, dtype=np.float64)
            n = np.sqrt(x @ x)
            x = x / n if n else x
            served, best, item = None, -1.0, int(r.item)
            if held.items:
                k, best = held.best(x)
                if best > self.tau:
                    served, held.used[k] = held.items[k], clock
            if served is None and item not in inside:
                held.add(item, x, clock)
                inside.add(item)
                new.append((item, x.tolist(), clock))
                if self.capacity and len(held.items) > self.capacity:
                    k = int(np.argmin(held.used)) if self.policy == "lru" else 0
                    inside.discard(held.items[k])
                    held.drop(k)
            clock += 1
            out.append((key[0], int(r.pos), item, served, best))
        if self.capacity:
            self.entries.put([(i, held.matrix[k].tolist(), u) for k, (i, u) in enumerate(zip(held.items, held.used, strict=True))])
        elif new:
            self.entries.appendList(new)
        yield pd.DataFrame(out, columns=["cache", "pos", "item", "stored", "sim"]).astype({"stored": "Int32"})

    def close(self) -> None:
        pass


def online(arrivals: DataFrame, tau: float, policy: str = "none", capacity: int = 0) -> DataFrame:
    """Rows of OUT for a stream of (cache string, pos int, item int, vec); needs the RocksDB state store."""
    return arrivals.groupBy("cache").transformWithStateInPandas(statefulProcessor=OnlineCache(tau, policy, capacity), outputStructType=OUT, outputMode="Append", timeMode="None")
