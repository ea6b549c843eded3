"""Session state over several batches with late rows, against a plain ordered dictionary."""

import os
import random
from collections import OrderedDict
from datetime import datetime, timedelta, timezone

import pandas as pd

from scholia.streaming import practice as P
from scholia.streaming import runs


def plain(batches, ttl, most):
    stores, out = {}, {}
    for batch in batches:
        for store in {r[0] for r in batch}:
            clock, live = stores.setdefault(store, [datetime.min.replace(tzinfo=timezone.utc), OrderedDict()])
            for _, number, session, at, creates in sorted((r for r in batch if r[0] == store), key=lambda r: (r[3], r[1])):
                clock = max(clock, at)
                for s in [s for s, made in live.items() if clock - made > timedelta(seconds=ttl)]:
                    del live[s]
                if creates:
                    live.pop(session, None)
                    live[session] = clock
                    while len(live) > most:
                        live.popitem(last=False)
                    outcome = "created"
                else:
                    outcome = "used" if session in live else "unknown"
                    if session in live:
                        live.move_to_end(session)
                out[number] = (store, session, outcome, len(live))
            stores[store][0] = clock
    return out


def test_batches_with_late_rows(spark, tmp_path):
    r = random.Random(6)
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    batches, number = [], 0
    for b in range(4):
        batch = []
        for _ in range(150):
            at = start + timedelta(minutes=60 * b + r.randrange(-40 if b else 0, 60), seconds=r.randrange(60))
            batch.append((f"s{r.randrange(3)}", number, f"p{r.randrange(9)}", at, r.random() < 0.4))
            number += 1
        batches.append(batch)
    folder = tmp_path / "in"
    schema = "store string, id long, session string, at timestamp, creates boolean"
    seen: set[str] = set()
    for n, batch in enumerate(batches):  # files are read in the order of their times
        spark.createDataFrame([*batch, (None, -1, "p", start, True), ("s1", -2, "p", None, True)], schema).coalesce(1).write.mode("append").parquet(str(folder))
        for name in set(os.listdir(folder)) - seen:
            os.utime(folder / name, (1_700_000_000 + n * 100,) * 2)
            seen.add(name)
    out = runs.caught_up(runs.stateful(spark), str(folder), lambda s: P.sessions(s, ttl_s=1800, most=4, delay="3 hours"), files=1)
    got = {x["id"]: (x["store"], x["session"], x["outcome"], x["alive"]) for x in out.collect()}
    assert got == plain(batches, 1800, 4)
    assert {x[2] for x in got.values()} == {"created", "used", "unknown"} and max(x[3] for x in got.values()) == 4


class State:
    """A value state that counts the calls to it."""

    def __init__(self):
        self.value, self.calls = None, 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def clear(self):
        self.calls, self.value = self.calls + 1, None

    def registerTimer(self, at):
        self.calls, self.timer = self.calls + 1, at

    def getExpiryTimeInMs(self):
        return self.timer


def test_few_calls_to_the_state():
    """A batch of a store costs three calls to the state, however many sessions it has; an expired store leaves nothing."""
    state = State()
    p = P.Sessions(1000, 3)
    p.init(state)
    for batch in range(2):
        rows = pd.DataFrame({"at_ms": [100 * batch + n for n in range(8)], "id": range(8), "session": [f"p{n % 5}" for n in range(8)], "creates": [n != 6 for n in range(8)]})
        (out,) = p.handleInputRows(("s",), iter([rows[4:], rows[:4]]), None)
        assert state.calls == 3 and out["id"].tolist() == list(range(8)) and out["alive"].max() == 3
        assert out["outcome"].tolist() == ["created"] * 6 + ["unknown", "created"]
        state.calls = 0
    assert state.value == (107, 16, ["p4", "p0", "p2"], [104, 105, 107], [13, 14, 16])
    state.timer = 1105
    assert not list(p.handleExpiredTimer(("s",), None, state)) and state.value[2] == ["p0", "p2"]
    state.timer = 1108
    assert not list(p.handleExpiredTimer(("s",), None, state)) and state.value is None
