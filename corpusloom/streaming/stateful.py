"""Stateful operators over time-stamped events: batch forms and their streaming twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PER_CLIENT, GLOBAL, WINDOW_SECONDS, RING, RECENT = 12, 120, 60, 256, 5


def windowed_limits(events: DataFrame, per_client: int = PER_CLIENT, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """(client, start, requests, rejected) of fixed windows: what is over the limit in a window is rejected."""
    start = F.floor(F.unix_timestamp("ts") / seconds) * seconds
    counted = events.groupBy("client", start.cast("long").alias("start")).agg(F.count(F.lit(1)).alias("requests"))
    return counted.withColumn("rejected", F.greatest(F.lit(0), F.col("requests") - per_client))


def windowed_counts(events: DataFrame, minutes: int = 60, late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n): counts a window; the same plan for a batch and for a stream with late rows."""
    seen = events.withWatermark("ts", late) if events.isStreaming else events
    out = seen.groupBy(F.window("ts", f"{minutes} minutes").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.unix_timestamp(F.col("w.start")).alias("start"), "event_type", "n")


def drained(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over what is there now and writes it to ``path``; started again, it goes on from its checkpoint."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest(events: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """The last value of each key."""
    return events.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def recent_distinct(events: DataFrame, user: str, what: str, order: list[str], cap: int = RECENT) -> DataFrame:
    """(user, what, place): each user's last ``cap`` different entries, newest first."""
    last = events.groupBy(user, what).agg(F.max(F.struct(*order)).alias("_at"))
    place = F.row_number().over(Window.partitionBy(user).orderBy(F.desc("_at"), what))
    return last.withColumn("place", place).filter(F.col("place") <= cap).drop("_at")


def ring(events: DataFrame, key: str, order: list[str], size: int = RING) -> DataFrame:
    """The last ``size`` rows of each key."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    return events.withColumn("_p", place).filter(F.col("_p") <= size).drop("_p")


def stale(rows: DataFrame, store: DataFrame, key: str, digest: str) -> DataFrame:
    """Rows whose (key, digest) the store lacks: what has to be made anew."""
    return rows.join(store.select(key, digest), [key, digest], "left_anti")


class RateLimiter:
    """Fixed windows for each client and for all, clients bounded by least recent use; replays exactly."""

    def __init__(self, per_client: int = PER_CLIENT, overall: int = GLOBAL, window_ms: int = WINDOW_SECONDS * 1000, most_clients: int = 10_000):
        from collections import OrderedDict

        self.per_client, self.overall, self.window, self.most = per_client, overall, window_ms, most_clients
        self.clients: OrderedDict[str, list[int]] = OrderedDict()
        self.all = [0, 0]  # count, reset

    def ask(self, client: str, now: int) -> tuple[bool, int]:
        """(allowed, seconds to wait)."""
        if now >= self.all[1]:
            self.all = [0, now + self.window]
        own = self.clients.pop(client, None)
        if own is None or now >= own[1]:
            own = [0, now + self.window]
        self.clients[client] = own
        while len(self.clients) > self.most:
            self.clients.popitem(last=False)
        over = [b[1] for b, limit in ((own, self.per_client), (self.all, self.overall)) if b[0] >= limit]
        if over:
            return False, max(1, -(-(max(over) - now) // 1000))
        own[0] += 1
        self.all[0] += 1
        return True, 0


def client_limiter(events: DataFrame, per_client: int = PER_CLIENT, window_ms: int = WINDOW_SECONDS * 1000) -> DataFrame:
    """(client, at_ms, allowed): windows that start with a client's first request, kept as state, a row a client.

    For a stream of (client, at_ms); rows of a micro-batch are taken in time order.
    """

    def work(key, frames, state):
        import pandas as pd

        count, reset = state.get if state.exists else (0, 0)
        rows = pd.concat(list(frames)).sort_values("at_ms", kind="stable")
        allowed = []
        for at in rows["at_ms"]:
            if at >= reset:
                count, reset = 0, int(at) + window_ms
            allowed.append(count < per_client)
            count += allowed[-1]
        state.update((int(count), int(reset)))
        yield pd.DataFrame({"client": key[0], "at_ms": rows["at_ms"], "allowed": allowed})

    return events.groupBy("client").applyInPandasWithState(work, "client long, at_ms long, allowed boolean", "n long, reset long", "append", "NoTimeout")


class ExpiringCache:
    """Least-recently-used cache with a time to live; values under way are made once."""

    def __init__(self, size: int, ttl_ms: int):
        from collections import OrderedDict

        self.size, self.ttl, self.rows = size, ttl_ms, OrderedDict()

    def get(self, key, now: int, make):
        row = self.rows.pop(key, None)
        if row is None or now >= row[1]:
            row = (make(), now + self.ttl)
        self.rows[key] = row
        while len(self.rows) > self.size:
            self.rows.popitem(last=False)
        return row[0]
