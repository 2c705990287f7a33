"""Control-loop state as pure transitions, for batch replay and for a stateful stream.

A deployment waits for its content: polls say whether it is live; a failed or stalled
attempt is retried up to MOST times; after GRACE seconds a status of failure counts at once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

POLL_S, STATUS_S, GRACE_S, DEADLINE_S, MOST = 2.5, 12, 45, 150, 10


def step(state: dict, at: float, kind: str) -> dict:
    """The state after an event: ``live``, ``failed``, ``dismiss`` or anything else (a poll)."""
    if state["phase"] != "waiting":
        return state
    if kind == "live":
        return state | {"phase": "ready"}
    if kind == "dismiss":
        return state | {"phase": "dismissed"}
    waited = at - state["since"]
    if waited > DEADLINE_S or (kind == "failed" and waited > GRACE_S):
        if state["tries"] >= MOST:
            return state | {"phase": "failed"}
        return state | {"tries": state["tries"] + 1, "since": at}
    return state


def start(at: float) -> dict:
    return {"phase": "waiting", "tries": 0, "since": at}


def replay(events: Iterable[tuple[float, str]]) -> dict:
    state = None
    for at, kind in events:
        state = step(state or start(at), at, kind)
    return state or start(0.0)


def replay_all(events: DataFrame, key: str, at: str, kind: str) -> DataFrame:
    """(key, phase, tries) after all events of each key, in order of time.

    Transitions depend on the state before, so a key's events run in order in one task; they are
    narrow (time and kind), read batch by batch, and only the state is kept.
    """
    rows = events.select(F.col(key).alias("key"), F.col(at).cast("double").alias("at"), F.col(kind).alias("kind"))
    width = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [key, "phase", "tries"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, state = None, None
        for batch in batches:
            done = []
            for k, when, what in zip(batch["key"], batch["at"], batch["kind"]):
                if state is not None and k != held:
                    done.append((held, state["phase"], state["tries"]))
                    state = None
                held, state = k, step(state or start(when), when, what)
            yield pd.DataFrame(done, columns=names)
        if state is not None:
            yield pd.DataFrame([(held, state["phase"], state["tries"])], columns=names)

    dealt = rows.repartition(width, "key").sortWithinPartitions("key", "at", "kind")
    return dealt.mapInPandas(run, f"{key} {events.schema[key].dataType.simpleString()}, phase string, tries long")


def batch_step(state: dict, outcome: str, now: float, reset: float | None = None) -> dict:
    """The runner's state after an item: ok and fail are counted, a limit sleeps until the reset and
    a minute and keeps the item, fatal stops, and MOST items in a row without progress stall it."""
    if state["phase"] in ("stopped", "stalled"):
        return state
    if outcome == "fatal":
        return state | {"phase": "stopped"}
    if outcome == "limit":
        return state | {"phase": "sleeping", "until": (reset if reset is not None else now + 5 * 3600) + 60}
    stall = 0 if outcome == "ok" else state["stall"] + 1
    return state | {"phase": "stalled" if stall >= MOST else "running", "stall": stall, outcome: state.get(outcome, 0) + 1}


def run_batches(items: DataFrame, key: str, order: str, outcome: str) -> DataFrame:
    """(key, ok, failed, phase) of the runner over each key's items in their order: narrow rows, a key's in one task,
    read batch by batch with the state alone kept."""
    rows = items.select(F.col(key).alias("key"), F.col(order).alias("at"), F.col(outcome).alias("outcome"))
    width = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, state = None, None
        for batch in batches:
            done = []
            for k, what in zip(batch["key"], batch["outcome"]):
                if k != held and state is not None:
                    done.append((held, state.get("ok", 0), state.get("fail", 0), state["phase"]))
                if k != held or state is None:
                    held, state = k, {"phase": "running", "stall": 0}
                state = batch_step(state, what, 0.0)
            yield pd.DataFrame(done, columns=names)
        if state is not None:
            yield pd.DataFrame([(held, state.get("ok", 0), state.get("fail", 0), state["phase"])], columns=names)

    names = [key, "ok", "failed", "phase"]
    dealt = rows.repartition(width, "key").sortWithinPartitions("key", "at")
    return dealt.mapInPandas(run, f"{key} {items.schema[key].dataType.simpleString()}, ok long, failed long, phase string")


def state_stream(events: DataFrame, key: str, at: str, kind: str) -> DataFrame:
    """(key, phase, tries) after each micro-batch in which a key has events, as an update stream.

    The state of a key is its phase, tries and the start of its attempt; it lives in the state store and
    survives restarts with the query's checkpoint.  A batch's events are taken in order of time.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    key_type = events.schema[key].dataType.simpleString()
    rows = events.select(F.col(key).alias("key"), F.col(at).cast("double").alias("at"), F.col(kind).alias("kind"))

    def run(k: tuple, batches: Iterator[pd.DataFrame], store) -> Iterator[pd.DataFrame]:
        state = dict(zip(("phase", "tries", "since"), store.get)) if store.exists else None
        got = pd.concat(list(batches)).sort_values(["at", "kind"])
        for when, what in zip(got["at"], got["kind"]):
            state = step(state or start(when), when, what)
        store.update((state["phase"], int(state["tries"]), float(state["since"])))
        yield pd.DataFrame({key: [k[0]], "phase": [state["phase"]], "tries": [state["tries"]]})

    return rows.groupBy("key").applyInPandasWithState(run, f"{key} {key_type}, phase string, tries long", "phase string, tries long, since double", "update", GroupStateTimeout.NoTimeout)
