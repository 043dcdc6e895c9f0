"""Session state machines, as streams, against plain loops."""

import datetime as dt
import random

import pytest

from lexispark.streaming import sessions

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


def run(spark, tmp_path, batches, schema, make):
    """What a stream gives, in micro-batches of one file each."""
    src, out, at = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    src.mkdir()
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.json(str(tmp_path / f"b{n}"))
        part = next((tmp_path / f"b{n}").glob("part-*"))
        part.rename(src / f"{n}.json")
        make(rows).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(at)).trigger(
            availableNow=True
        ).start().awaitTermination()
    return spark.read.parquet(str(out)).collect()


def seen_by_rule(events, ttl, most):
    """Rows (session, library, id, at_ms, fresh): one time to live a session, of each library the newest ids."""
    out, state = [], {}
    for s, lib, i, t in events:
        touched, libs = state.get(s, (None, {}))
        if touched is not None and t - touched > ttl:
            libs = {}
        own = libs.setdefault(lib.lower(), [])
        fresh = i not in own
        if fresh:
            own.append(i)
        libs[lib.lower()] = own[-most:]
        state[s] = (t, libs)
        out.append((s, lib.lower(), i, t, fresh))
    return out


@pytest.mark.parametrize("batches", [1, 3])
def test_seen_over_libraries(spark, tmp_path, batches):
    rng, t, events = random.Random(batches), 0, []
    for _ in range(150):
        t += rng.choice([1, 2000, 9000, 31_000])
        events.append((rng.choice("xy"), rng.choice(["/A/b", "/a/B", "/c/d"]), rng.randrange(9), t))
    schema = "session string, library string, id bigint, ts timestamp"
    rows = [(s, lib, i, T0 + dt.timedelta(milliseconds=t)) for s, lib, i, t in events]
    size = -(-len(rows) // batches)
    got = run(
        spark, tmp_path, [rows[k : k + size] for k in range(0, len(rows), size)], schema,
        lambda df: sessions.stream_seen(df, ttl_ms=30_000, most=4)
    )
    base = int(T0.timestamp() * 1000)
    assert sorted((r["session"], r["library"], r["id"], r["at_ms"] - base, r["fresh"]) for r in got) == sorted(
        seen_by_rule(events, 30_000, 4)
    )
    assert max(r["seen_count"] for r in got) <= 4


def test_another_library_keeps_a_session_alive(spark, tmp_path):
    """What was seen of one library stays as long as anything of the session is asked for."""
    at = lambda s: T0 + dt.timedelta(seconds=s)
    rows = [("s", "/a/a", 1, at(0))] + [("s", "/b/b", k, at(1000 * k)) for k in range(1, 8)] + [("s", "/a/a", 1, at(7001))]
    rows += [(None, "/a/a", 1, at(1)), ("s", None, 1, at(1))]
    got = run(spark, tmp_path, [rows], "session string, library string, id bigint, ts timestamp", sessions.stream_seen)
    assert [r["fresh"] for r in got if r["library"] == "/a/a" and r["at_ms"] > T0.timestamp() * 1000] == [False]


def test_protocol_sessions_over_batches(spark, tmp_path):
    rng, t, events = random.Random(5), 0, []
    for _ in range(80):
        t += rng.choice([100, 5000, 40_000])
        events.append((rng.choice("xy"), t))
    want, state = [], {}
    for s, now in events:
        until = state.get(s)
        alive = until is not None and until > now
        until = now + 60_000 if not alive or until - now < 20_000 else until
        state[s] = until
        want.append((s, now, alive, until))
    rows = [(s, T0 + dt.timedelta(milliseconds=t)) for s, t in events]
    base = int(T0.timestamp() * 1000)
    got = run(
        spark, tmp_path, [rows[:40], rows[40:]], "session string, ts timestamp",
        lambda df: sessions.stream_protocol(df, 60_000, 20_000)
    )
    assert sorted((r["session"], r["at_ms"] - base, r["alive"], r["expires_ms"] - base) for r in got) == sorted(want)


class Store:
    """State and timers of one session in plain Python, which count the calls to them."""

    def __init__(self):
        self.value, self.held, self.timers, self.calls = None, {}, set(), []

    def __getattr__(self, name):
        does = {
            "get": lambda: self.value, "exists": lambda: self.value is not None, "update": lambda v: setattr(self, "value", v),
            "containsKey": lambda k: k in self.held, "getValue": lambda k: self.held[k], "updateValue": lambda k, v: self.held.update({k: v}),
            "clear": lambda: self.held.clear(), "registerTimer": lambda t: self.timers.add(t), "listTimers": lambda: iter(self.timers),
            "deleteTimer": lambda t: self.timers.remove(t), "getValueState": lambda *_: self, "getMapState": lambda *_: self
        }[name]
        return lambda *a: (self.calls.append(name), does(*a))[1]


def test_few_calls_to_the_state():
    """A new session asks for nothing but its end, and a renewed one replaces its only timer."""
    store, own = Store(), sessions._Seen(1000, 3)
    own.init(store)
    row = lambda t, lib, i: {"at_ms": t, "library": lib, "id": i}
    store.calls.clear()
    assert [r["fresh"] for r in own.handleInputRows(("s",), [row(5, "a", 1), row(6, "b", 1), row(7, "a", 1)], None)] == [True, True, False]
    assert sorted(store.calls) == ["get", "registerTimer", "update", "updateValue", "updateValue"] and store.timers == {1008}
    assert [r["fresh"] for r in own.handleInputRows(("s",), [row(900, "a", 1), row(901, "a", 2)], None)] == [False, True]
    assert store.timers == {1902} and "listTimers" not in store.calls
    store.calls.clear()
    assert [r["fresh"] for r in own.handleInputRows(("s",), [row(1900, "b", 1), row(5000, "b", 1), row(5001, "a", 1)], None)] == [False, True, True]
    assert store.timers == {6002} and set(store.held) == {("a",), ("b",)} and store.held["a",] == ([1],)
