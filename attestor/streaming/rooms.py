"""Sessions in rooms of limited size, as keyed state of a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Sessions of a room; seconds after which one is over, at rest and at work.
SESSIONS, AT_REST, AT_WORK = 256, 3600, 300
OUTCOMES = "room string, session string, at timestamp, outcome string"
KEPT = "names array<string>, seen array<long>, working array<boolean>, newest long"
Held = dict[str, tuple[int, bool]]  # when each session was last seen, in milliseconds, and whether it is at work


def _over(held: Held, now: int, at_rest: int, at_work: int) -> list[tuple[int, str, str]]:
    """Takes out the sessions whose time is over by now."""
    ends = sorted((seen + (at_work if working else at_rest), name) for name, (seen, working) in held.items())
    out = [(end, name, "over") for end, name in ends if end <= now]
    for _, name, _ in out:
        del held[name]
    return out


def admitted(events: list[tuple[int, str, str]], held: Held, most: int, at_rest: int, at_work: int) -> list[tuple[int, str, str]]:
    """(time, session, outcome) of a room's events (time, session, kind), in order; `held` is what is there before, and after.

    A session that is not there is opened if there is room, or if one at rest can go: the one not seen for the longest, then by
    name. Otherwise it is refused. 'begin' puts a session to work, 'end' to rest; any event keeps it. Those whose time is over
    go first, whoever asks.
    """
    out = []
    for now, name, kind in events:
        out += _over(held, now, at_rest, at_work)
        if name not in held:
            if len(held) >= most:
                resting = [(seen, other) for other, (seen, working) in held.items() if not working]
                if not resting:
                    out.append((now, name, "refused"))
                    continue
                other = min(resting)[1]
                del held[other]
                out.append((now, other, "made room"))
            out.append((now, name, "opened"))
        working = kind == "begin" or kind != "end" and held.get(name, (0, False))[1]
        held[name] = now, working
    return out


def rooms(events: DataFrame, most: int = SESSIONS, at_rest: int = AT_REST, at_work: int = AT_WORK, late: str = "1 minute") -> DataFrame:
    """(room, session, at, outcome) of a stream of events (room, session, kind, at): 'opened', 'over', 'made room' or 'refused'.

    One state a room, of `most` sessions at most. A micro-batch's events go by time, then session and kind; one that comes
    later than others of its room counts as of the newest time there, and one behind the watermark is dropped. When the
    watermark passes the end of a session it is over without another event.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names, seen, working, newest = state.get if state.exists else ([], [], [], 0)
        held = {n: (int(s), bool(w)) for n, s, w in zip(names, seen, working, strict=True)}
        if state.hasTimedOut:
            newest = max(newest, state.getCurrentWatermarkMs())
            out = _over(held, newest, at_rest * 1000, at_work * 1000)
        else:
            rows = sorted((int(t.value // 10**6), s, k) for f in frames for t, s, k in zip(f["at"], f["session"], f["kind"], strict=True))
            events = []
            for t, s, k in rows:
                newest = max(newest, t)
                events.append((newest, s, k))
            out = admitted(events, held, most, at_rest * 1000, at_work * 1000)
        yield pd.DataFrame({"room": key[0], "session": [n for _, n, _ in out], "at": pd.to_datetime([t for t, _, _ in out], unit="ms", utc=True), "outcome": [o for _, _, o in out]})
        if not held:
            state.remove()
            return
        state.update((list(held), [s for s, _ in held.values()], [w for _, w in held.values()], newest))
        ends = min(s + (at_work if w else at_rest) * 1000 for s, w in held.values())
        state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))

    rows = events.select("room", "session", "kind", F.col("at").cast("timestamp").alias("at")).withWatermark("at", late)
    return rows.groupBy("room").applyInPandasWithState(step, OUTCOMES, KEPT, "append", GroupStateTimeout.EventTimeTimeout)
