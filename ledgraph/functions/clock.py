"""Hybrid logical clocks: (physical ms, logical, id); of equal times the lower id wins."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LOGICAL = (1 << 31) - 1


@dataclass(frozen=True)
class HybridClock:
    id: str
    physical_ms: int = 0
    logical: int = 0

    def tick(self, now_ms: int | None = None) -> HybridClock:
        now = int(time.time() * 1000) if now_ms is None else now_ms
        if now > self.physical_ms:
            return HybridClock(self.id, now, 0)
        return HybridClock(self.id, self.physical_ms, min(self.logical + 1, MAX_LOGICAL))

    def merge(self, other: HybridClock, now_ms: int | None = None) -> HybridClock:
        now = int(time.time() * 1000) if now_ms is None else now_ms
        physical = max(now, self.physical_ms, other.physical_ms)
        seen = [c.logical for c in (self, other) if c.physical_ms == physical]
        return HybridClock(self.id, physical, min(max(seen) + 1, MAX_LOGICAL) if seen else 0)

    def as_tuple(self) -> tuple[int, int]:
        return self.physical_ms, self.logical

    def wins_over(self, other: HybridClock) -> bool:
        if self.as_tuple() != other.as_tuple():
            return self.as_tuple() > other.as_tuple()
        return self.id < other.id


def descending(text: Column) -> Column:
    """A string whose ascending order is the descending order of the text."""
    return F.concat(F.translate(F.hex(text), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("~"))


def clock(prefix: str = "") -> Column:
    """Comparable clock of an entry: the greater one wins."""
    return F.struct(F.col(f"{prefix}physical_ms").alias("physical_ms"), F.col(f"{prefix}logical").alias("logical"), descending(F.col(f"{prefix}clock_id")).alias("id"))
