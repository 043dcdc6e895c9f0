"""Stateful streams."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lexispark.operators.folds import sorted_fold

SEEN = "session string, library string, id bigint, at_ms bigint, fresh boolean, seen_count int"
REQUESTS = "session string, at_ms bigint, alive boolean, expires_ms bigint"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state_on_disk(spark: SparkSession) -> None:
    """State of several kinds, with timers, needs the store that keeps it on disk."""
    spark.conf.set(STORE, ROCKSDB)


class _Expires(StatefulProcessor):
    """A session's state, which goes as a whole when its time is over: ``expires`` is when, in milliseconds."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.expires = handle.getValueState("expires", "at bigint")

    def until(self) -> int | None:
        held = self.expires.get()  # each call is a trip to the JVM
        return held[0] if held else None

    def renew(self, at: int, before: int | None) -> None:
        """Live until ``at`` and no longer until ``before``: one timer a session, a millisecond later, as the last one
        still belongs to it."""
        if at == before:
            return
        if before is not None:
            self.handle.deleteTimer(before + 1)
        self.handle.registerTimer(at + 1)
        self.expires.update((at,))

    def clear(self) -> None:
        self.expires.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        until = self.until()
        if until is not None and until < expiredTimerInfo.getExpiryTimeInMs():
            self.clear()
        return iter(())

    def close(self) -> None:
        pass


class _Seen(_Expires):
    """What a session has seen of each library, oldest ids first; any request renews the whole session."""

    def __init__(self, ttl_ms: int, most: int):
        self.ttl_ms, self.most = ttl_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.libraries = handle.getMapState("libraries", "library string", "ids array<bigint>")

    def clear(self) -> None:
        super().clear()
        self.libraries.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        until = before = self.until()
        known, stored = {}, until is not None  # a session without an end has nothing stored
        for r in sorted(rows, key=lambda r: (r["at_ms"], r["library"], r["id"])):
            if until is not None and r["at_ms"] > until:  # idle for too long: all libraries are forgotten
                if stored:
                    self.libraries.clear()
                known, stored = {}, False
            lib = r["library"]
            if lib not in known:
                held = self.libraries.getValue((lib,)) if stored and self.libraries.containsKey((lib,)) else ([],)
                known[lib] = dict.fromkeys(held[0])
            seen = known[lib]
            fresh = r["id"] not in seen
            seen.setdefault(r["id"])
            while len(seen) > self.most:
                del seen[next(iter(seen))]
            until = max(until or 0, r["at_ms"] + self.ttl_ms)
            yield Row(session=key[0], library=lib, id=r["id"], at_ms=r["at_ms"], fresh=fresh, seen_count=len(seen))
        for lib, seen in known.items():
            self.libraries.updateValue((lib,), (list(seen),))
        if until is not None:
            self.renew(until, before)


def _stateful(rows: DataFrame, processor: StatefulProcessor, schema: str) -> DataFrame:
    keep_state_on_disk(rows.sparkSession)
    return rows.groupBy("session").transformWithState(processor, schema, "append", "eventTime")


def stream_seen(events: DataFrame, ttl_ms: int = 3_600_000, most: int = 500) -> DataFrame:
    """Mark each retrieved chunk (session, library, id, ts) as fresh or already seen in its session.

    A session has one time to live: any of its requests, of whatever library, renews it, and when it was idle for more
    than ``ttl_ms`` of event time all that it has seen is forgotten. Of each library it keeps at most ``most`` ids, those
    seen first go first; seeing one again doesn't renew it. Libraries count in any case. Rows without a session, library,
    id or time have no place in a session and are left out.
    """
    rows = events.select(
        "session", F.lower("library").alias("library"), F.col("id").cast("bigint").alias("id"),
        F.col("ts").cast("timestamp").alias("ts")
    ).na.drop().withColumn("at_ms", F.unix_millis("ts")).withWatermark("ts", f"{ttl_ms} milliseconds")
    return _stateful(rows, _Seen(ttl_ms, most), SEEN)


def session_counts(events: DataFrame, gap: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Sessions (session, ts) with a sliding time to live: start, end, events."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    w = rows.groupBy("session", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"))
    return w.select("session", F.col("w.start").alias("starts"), F.col("w.end").alias("ends"), "events")


def protocol_session(
    expires_ms: int | None, now_ms: int, ttl_ms: int = 7 * 86_400_000, renew_below_ms: int = 86_400_000
) -> tuple[int | None, bool]:
    """A protocol session's expiry after a request, and whether it was alive: renewed only when little is left."""
    if expires_ms is None or expires_ms <= now_ms:
        return None, False
    return (now_ms + ttl_ms, True) if expires_ms - now_ms < renew_below_ms else (expires_ms, True)


class _Protocol(_Expires):
    """A protocol session's expiry over its requests; its timer ends it."""

    def __init__(self, ttl_ms: int, renew_below_ms: int):
        self.rule = ttl_ms, renew_below_ms

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = before = self.until()
        for r in sorted(rows, key=lambda r: r["at_ms"]):
            now, alive = protocol_session(now, r["at_ms"], *self.rule)
            if not alive:  # a request without a living session opens one
                now = r["at_ms"] + self.rule[0]
            yield Row(session=key[0], at_ms=r["at_ms"], alive=alive, expires_ms=now)
        if now is not None and now != before:
            self.renew(now, before)


def stream_protocol(
    requests: DataFrame, ttl_ms: int = 7 * 86_400_000, renew_below_ms: int = 86_400_000
) -> DataFrame:
    """``protocol_sessions`` of a stream of requests (session, ts), with the expiry of each session as its state.

    Rows without a session or a time are left out.
    """
    rows = requests.select("session", F.col("ts").cast("timestamp").alias("ts")).na.drop().withColumn(
        "at_ms", F.unix_millis("ts")
    ).withWatermark("ts", f"{ttl_ms} milliseconds")
    return _stateful(rows, _Protocol(ttl_ms, renew_below_ms), REQUESTS)


class _ProtocolFold:
    """A protocol session's expiry over a batch of its requests."""

    def __init__(self, ttl_ms: int, renew_below_ms: int):
        self.rule, self.expires = (ttl_ms, renew_below_ms), None

    def many(self, rows: pa.RecordBatch) -> list[pa.Array]:
        alive, expires = [], []
        for now in rows.column("at_ms").to_pylist():
            self.expires, was = protocol_session(self.expires, now, *self.rule)
            if not was:  # a request without a living session opens one
                self.expires = now + self.rule[0]
            alive.append(was)
            expires.append(self.expires)
        return [pa.array(alive, pa.bool_()), pa.array(expires, pa.int64())]


def protocol_sessions(
    requests: DataFrame, key: str, ttl_ms: int = 7 * 86_400_000, renew_below_ms: int = 86_400_000
) -> DataFrame:
    """Requests (key, at_ms, ...) with alive, whether their session was, and expires_ms after them.

    A session opens with a request that finds none alive, and is renewed only when little is left of it.
    """
    return sorted_fold(
        requests, [key], ["at_ms"], lambda: _ProtocolFold(ttl_ms, renew_below_ms), "alive boolean, expires_ms bigint"
    )


def last_outcome(events: DataFrame, key: str, line: str) -> DataFrame:
    """The last complete or error event of each request, by its place in the stream; requests without one have no row."""
    ends = events.where(F.col("type").isin("complete", "error"))
    own = F.struct(*[c for c in events.columns if c != key])
    return ends.groupBy(key).agg(F.max_by(own, line).alias("e")).select(key, "e.*")


def parse_lines(
    lines: DataFrame, schema: str = "type string, content string, error string", needs: str = "type"
) -> DataFrame:
    """Events of JSON lines (value) with the lines' other columns; malformed lines are left out, and those without the
    field that an event needs."""
    others = [c for c in lines.columns if c != "value"]
    return lines.select(*others, F.from_json("value", schema).alias("e")).where(f"e.{needs} IS NOT NULL").select(
        *others, "e.*"
    )


def single_flight(requests: DataFrame, key: str = "library", ts: str = "ts", within: str = "10 minutes") -> DataFrame:
    """The first of several requests for a library in any case, within a stretch of event time."""
    rows = requests.withColumn(ts, F.col(ts).cast("timestamp")).withColumn("flight", F.lower(key))
    return rows.withWatermark(ts, within).dropDuplicatesWithinWatermark(["flight"]).drop("flight")
