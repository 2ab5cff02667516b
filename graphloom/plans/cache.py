"""Results that are kept for a while, and until what they were made from changes."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def key(subject: str | None, limit: int) -> str:
    """Name of a subject's graph data."""
    return f"data:{subject or 'default'}:{limit}"


def fingerprint(df: DataFrame, column: str) -> int:
    """A number that changes with the set of a column's values."""
    return df.select(F.xxhash64(column).alias("h")).distinct().agg(F.coalesce(F.bit_xor("h"), F.lit(0)).alias("h")).first().h


@dataclass
class Cache:
    """Persisted tables by name, for ttl seconds; executors hold them, and make them again if they are lost."""

    ttl: float = 300.0
    clock: Callable[[], float] = time.monotonic
    _held: dict[str, tuple[float, int | None, DataFrame]] = field(default_factory=dict)

    def get(self, name: str, make: Callable[[], DataFrame], mark: int | None = None) -> DataFrame:
        """The table kept under a name, or a new one if there is none, its time is over or its mark is another."""
        held = self._held.get(name)
        if held and self.clock() - held[0] < self.ttl and held[1] == mark:
            return held[2]
        self.drop(name)
        df = make().persist()
        self._held[name] = (self.clock(), mark, df)
        return df

    def drop(self, name: str | None = None) -> None:
        """Forgets one table, or all."""
        for n in [name] if name is not None else list(self._held):
            if (held := self._held.pop(n, None)) is not None:
                held[2].unpersist()
