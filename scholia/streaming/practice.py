"""Sessions of stores as keyed state: a limited time to live, a limited number, the least recently used given up first."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "store string, id long, session string, outcome string, alive int"


class Sessions(StatefulProcessor):
    """State of a store: its clock and sessions (when made, when last used), as one value. At most ``most`` sessions, so state is bounded.

    One value, as each call to the state goes to the engine and back: a batch of a store takes one to read it, one to write it, one for the timer.
    """

    def __init__(self, ttl_ms: int, most: int):
        self.ttl, self.most = ttl_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "at long, turn long, sessions array<string>, made array<long>, used array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at, turn, *held = self.state.get() or (-(1 << 62), 0, [], [], [])
        live = {s: (made, used) for s, made, used in zip(*held, strict=True)}
        requests = [r for batch in rows for r in zip(*[batch[c].tolist() for c in ("at_ms", "id", "session", "creates")], strict=True)]
        requests.sort(key=lambda r: r[:2])
        sessions_, outcomes, alive = [], [], []
        for time, _, session, creates in requests:
            at, turn = max(at, time), turn + 1  # a late row comes at the store's clock: time does not run backwards
            for s in [s for s, v in live.items() if at - v[0] > self.ttl]:
                del live[s]
            if creates:
                live[session] = (at, turn)
                outcome = "created"
                while len(live) > self.most:
                    del live[min(live, key=lambda s: live[s][1])]
            elif session in live:
                live[session] = (live[session][0], turn)
                outcome = "used"
            else:
                outcome = "unknown"
            sessions_.append(session)
            outcomes.append(outcome)
            alive.append(len(live))
        self.state.update((at, turn, list(live), [v[0] for v in live.values()], [v[1] for v in live.values()]))
        if live:  # once all that live now must be over, an idle store's state goes
            self.handle.registerTimer(max(v[0] for v in live.values()) + self.ttl + 1)
        yield pd.DataFrame({"store": [key[0]] * len(alive), "id": [r[1] for r in requests], "session": sessions_, "outcome": outcomes, "alive": alive})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        at, turn, *held = self.state.get() or (0, 0, [], [], [])
        left = [x for x in zip(*held, strict=True) if now - x[1] <= self.ttl]
        if not left:
            self.state.clear()
        elif len(left) < len(held[0]):
            self.state.update((at, turn, *map(list, zip(*left, strict=True))))
        return iter(())

    def close(self) -> None:
        pass


def sessions(requests: DataFrame, ttl_s: int = 3600, most: int = 50, delay: str = "1 hour") -> DataFrame:
    """What becomes of each request of a stream (store, id, session, at, creates): created, used or unknown, and the store's live sessions then.

    A session lives ``ttl_s`` from its making. A store's requests are taken in the order of time and id within a micro-batch; one older
    than the store's clock comes at that clock, one older than the watermark not at all. Requests without a store, session or time
    are unknown to every store and left out. A store's requests of one micro-batch are held by one task: the trigger bounds them.
    """
    whole = requests.where("store IS NOT NULL AND session IS NOT NULL AND at IS NOT NULL").withWatermark("at", delay)
    rows = whole.select(F.col("store").cast("string").alias("store"), F.col("id").cast("long").alias("id"), F.col("session").cast("string").alias("session"), F.unix_millis("at").alias("at_ms"), F.coalesce("creates", F.lit(False)).alias("creates"), "at")
    return rows.groupBy("store").transformWithStateInPandas(Sessions(ttl_s * 1000, most), OUT, "Append", "EventTime")
