"""Search results kept between calls: whole results by query and parameters, cut per call."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import DataFrame

# Entries and their life.
MAX_ENTRIES, TTL_SECONDS = 1000, 3600


class SearchSession:
    """Persists result frames; the oldest go first, and their storage is given back."""

    def __init__(self, search: Callable[..., DataFrame], most: int = MAX_ENTRIES, ttl: float = TTL_SECONDS, clock: Callable[[], float] = time.monotonic):
        self.search, self.most, self.ttl, self.clock = search, most, ttl, clock
        self.kept: OrderedDict[tuple, tuple[float, DataFrame]] = OrderedDict()
        self.hits = self.misses = 0

    def results(self, query: str, limit: int, **params: object) -> DataFrame:
        key = (query, *sorted((k, repr(v)) for k, v in params.items()))
        entry = self.kept.get(key)
        if entry and self.clock() - entry[0] < self.ttl:
            self.hits += 1
        else:
            self.misses += 1
            if entry:
                self.kept.pop(key)[1].unpersist()
            while len(self.kept) >= self.most:
                self.kept.popitem(last=False)[1][1].unpersist()
            entry = self.kept[key] = (self.clock(), self.search(query, **params).persist())
        return entry[1].orderBy("rank").limit(limit)

    def hit_rate(self) -> float:
        return round(100 * self.hits / max(1, self.hits + self.misses), 2)
