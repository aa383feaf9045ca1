"""Caches with a capacity and a time to live, as the state of a stream of requests."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "cache string, event_id long, key string, outcome string, evicted array<string>"


class Entries:
    """The entries of a cache in the order of their last use: key -> when it was stored."""

    def __init__(self, entries: dict[str, int], capacity: int, ttl_ms: int):
        self.entries, self.capacity, self.ttl_ms = entries, capacity, ttl_ms

    def expired(self, now: int) -> list[str]:
        """Drop what has lived its time at `now`."""
        gone = [k for k, at in self.entries.items() if now - at >= self.ttl_ms]
        for k in gone:
            del self.entries[k]
        return gone

    def request(self, key: str, now: int) -> tuple[str, list[str]]:
        """(hit, miss or expired, keys that had to go). Use does not lengthen a life; what wasn't there is stored."""
        stored = self.entries.pop(key, None)
        if stored is not None and now - stored < self.ttl_ms:
            self.entries[key] = stored
            return "hit", []
        self.entries[key] = now
        gone = []
        while len(self.entries) > self.capacity:
            gone.append(next(iter(self.entries)))
            del self.entries[gone[-1]]
        return ("miss" if stored is None else "expired"), gone


class CacheProcessor(StatefulProcessor):
    """State of a cache: its entries by key with the order of use, and the time of its latest request. A timer on event time
    takes out what has lived its time, so that a cache nobody asks any more takes no room."""

    def __init__(self, capacity: int, ttl_ms: int):
        self.capacity, self.ttl_ms = capacity, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stored = handle.getMapState("entries", "key string", "at long, used long")
        self.clock = handle.getValueState("clock", "now long, used long, timer long")

    def _load(self) -> tuple[Entries, dict[str, tuple[int, int]]]:
        found = {k[0]: (v[0], v[1]) for k, v in self.stored.iterator()}
        return Entries({k: at for k, (at, _) in sorted(found.items(), key=lambda e: e[1][1])}, self.capacity, self.ttl_ms), found

    def _save(self, cache: Entries, before: dict[str, tuple[int, int]], now: int, used: int, timer: int, asked: set[str]) -> None:
        """Write what changed; those asked for are the last in the order of use."""
        for key in before.keys() - cache.entries.keys():
            self.stored.removeKey((key,))
        for key, at in cache.entries.items():
            if key in asked:
                used += 1
                self.stored.updateValue((key,), (at, used))
        first = min(cache.entries.values(), default=None)
        due = -1 if first is None else first + self.ttl_ms
        if timer != due:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            if due >= 0:
                self.handle.registerTimer(due)
        self.clock.update((now, used, due))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        cache, before = self._load()
        now, used, timer = self.clock.get() if self.clock.exists() else (0, 0, -1)
        asked: set[str] = set()
        for at, event, name in sorted((r.ms, r.event_id, r.key) for r in rows):
            # A request that comes after later ones is taken for as late as these.
            now = max(now, at)
            outcome, gone = cache.request(name, now)
            asked.add(name)
            yield Row(cache=key[0], event_id=event, key=name, outcome=outcome, evicted=gone)
        self._save(cache, before, now, used, timer, asked)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        cache, before = self._load()
        now, used, timer = self.clock.get()
        gone = cache.expired(expiredTimerInfo.getExpiryTimeInMs())
        self._save(cache, before, now, used, -1 if timer == expiredTimerInfo.getExpiryTimeInMs() else timer, set())
        if gone:
            yield Row(cache=key[0], event_id=None, key=None, outcome="swept", evicted=sorted(gone))

    def close(self) -> None:
        pass


def lru_cache(requests: DataFrame, cache: str, key: str, at: str = "ts", ident: str = "event_id", capacity: int = 100, ttl_ms: int = 600_000, late: str = "10 minutes") -> DataFrame:
    """OUTPUT of a stream of requests: hit, miss, or expired if the entry had lived `ttl_ms` since it was stored, and the keys,
    least recently used first, that went because a cache holds `capacity` entries; rows swept name those that a timer
    took out. Requests of a batch are taken in order of time, then id; of each cache a batch's requests and `capacity` entries
    are held. Requests older than the watermark are left out; null caches and keys are empty ones.
    """
    time = F.col(at).cast("timestamp")
    rows = requests.select(F.coalesce(F.col(cache).cast("string"), F.lit("")).alias("cache"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(ident).cast("long").alias("event_id"), time.alias("time"), F.unix_millis(time).alias("ms"))
    return rows.withWatermark("time", late).groupBy("cache").transformWithState(CacheProcessor(capacity, ttl_ms), OUTPUT, "append", "eventTime")
