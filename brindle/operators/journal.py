"""What an engine notes about itself: the slowest statements, and the last mutations."""

from __future__ import annotations

import heapq
import time
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Slow:
    seq: int
    sql: str
    took_ms: float
    rows: int


class SlowLog:
    """The `most` slowest statements of at least least_ms; of equal ones those that came first stay."""

    def __init__(self, most: int = 32, least_ms: float = 10.0):
        self.most, self.least_ms, self.seq = most, least_ms, 0
        self._heap: list[tuple[float, int, Slow]] = []

    def note(self, sql: str, took_ms: float, rows: int) -> None:
        self.seq += 1
        if took_ms < self.least_ms:
            return
        entry = (took_ms, -self.seq, Slow(self.seq, sql, float(took_ms), rows))
        if len(self._heap) < self.most:
            heapq.heappush(self._heap, entry)
        elif took_ms > self._heap[0][0]:
            heapq.heapreplace(self._heap, entry)

    def entries(self) -> list[Slow]:
        """Slowest first."""
        return [e[2] for e in sorted(self._heap, reverse=True)]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(e.seq, e.sql, e.took_ms, e.rows) for e in self.entries()], "seq bigint, sql string, took_ms double, rows bigint")


class AuditRing:
    """The last `most` mutations, newest first."""

    def __init__(self, most: int = 1024, clock: Callable[[], float] = time.time):
        self.clock, self.seq = clock, 0
        self._ring: deque[tuple[int, float, str, str, str | None]] = deque(maxlen=most)

    def note(self, op: str, bucket: str, key: str | None) -> None:
        self.seq += 1
        self._ring.append((self.seq, self.clock(), op, bucket, key))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(reversed(self._ring)), "seq bigint, at double, op string, bucket string, id string")
