"""Stateful behaviour: selection sessions, single flight, resume by unit."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pedshade.config import MODES

AWAITING_START, AWAITING_DESTINATION, ROUTE_READY = "awaiting-start", "awaiting-destination", "route-ready"
SELECTING_START, SELECTING_DESTINATION = "selecting-start", "selecting-destination"

INITIAL = {"phase": AWAITING_START, "start": None, "destination": None, "route": None, "selected_mode": "balanced", "error": None}

#: Where each event is heard, the phase it leads to (None: the same), and the fields it takes over.
TRANSITIONS = {
    "START_COMMITTED": ({AWAITING_START}, AWAITING_DESTINATION, ("start",)),
    "DESTINATION_AND_ROUTE_COMMITTED": ({AWAITING_DESTINATION, SELECTING_DESTINATION}, ROUTE_READY, ("destination", "route")),
    "START_AND_ROUTE_COMMITTED": ({SELECTING_START}, ROUTE_READY, ("start", "route")),
    "ROUTE_RECALCULATED": ({ROUTE_READY}, None, ("route",)),
    "SELECT_START_REQUESTED": ({ROUTE_READY}, SELECTING_START, ()),
    "SELECT_DESTINATION_REQUESTED": ({ROUTE_READY}, SELECTING_DESTINATION, ()),
}


def step(state: dict, event: dict) -> dict:
    """The state after one event; an event that the phase does not hear changes nothing."""
    kind = event.get("action")
    if kind == "RESET":
        return dict(INITIAL)
    if kind == "CANDIDATE_REJECTED":
        return state | {"error": event.get("error") or "rejected"}
    if kind == "ROUTE_MODE_SELECTED":
        return state | {"selected_mode": event["mode"], "error": None} if event.get("mode") in MODES else state
    if kind == "MAP_CLICK":  # a click commits whatever the phase is waiting for
        at = str(event.get("event_id"))
        kind = {
            AWAITING_START: "START_COMMITTED",
            AWAITING_DESTINATION: "DESTINATION_AND_ROUTE_COMMITTED",
            SELECTING_START: "START_AND_ROUTE_COMMITTED",
            SELECTING_DESTINATION: "DESTINATION_AND_ROUTE_COMMITTED",
        }.get(state["phase"])
        event = {"start": at, "destination": at, "route": f"route-{at}"}
    heard, to, takes = TRANSITIONS.get(kind, (set(), None, ()))
    if state["phase"] not in heard:
        return state
    if kind and kind.startswith("SELECT_") and not (state["start"] and state["destination"]):
        return state
    return state | {f: event.get(f) for f in takes} | {"phase": to or state["phase"], "error": None}


_FIELDS = list(INITIAL)
_SCHEMA = "session_id long, " + ", ".join(f"{f} string" for f in _FIELDS) + ", n_events long"


def _fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Folds rows sorted by session and time; one state is held at a time, whatever the session's length."""
    session, state, n = None, dict(INITIAL), 0
    for pdf in parts:
        out = []
        for e in pdf.to_dict("records"):
            if session is not None and e["session_id"] != session:
                out.append((session, *(state[f] for f in _FIELDS), n))
                state, n = dict(INITIAL), 0
            session, state, n = e["session_id"], step(state, e), n + 1
        if out:
            yield pd.DataFrame(out, columns=["session_id", *_FIELDS, "n_events"])
    if session is not None:
        yield pd.DataFrame([(session, *(state[f] for f in _FIELDS), n)], columns=["session_id", *_FIELDS, "n_events"])


def fold_sessions(events: DataFrame) -> DataFrame:
    """The final state of each session, its events in (ts, event_id) order; a batch table."""
    rows = events.select(F.col("session_id").cast("long").alias("session_id"), F.col("event_id").cast("long").alias("event_id"), "ts", "action", "mode")
    return rows.repartition("session_id").sortWithinPartitions("session_id", "ts", "event_id").drop("ts").mapInPandas(_fold, _SCHEMA)


def stream_sessions(events: DataFrame) -> DataFrame:
    """The same fold over a stream: emits each session's state after every micro-batch that touched it.

    Within a micro-batch events go by (ts, event_id); across batches in order
    of arrival.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def update(key, frames, held: GroupState):
        state = dict(zip([*_FIELDS, "n_events"], held.get, strict=True)) if held.exists else INITIAL | {"n_events": 0}
        n = int(state.pop("n_events"))
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"], kind="stable")
        for e in rows.to_dict("records"):
            state, n = step(state, e), n + 1
        held.update((*(state[f] for f in _FIELDS), n))
        yield pd.DataFrame([(key[0], *(state[f] for f in _FIELDS), n)], columns=["session_id", *_FIELDS, "n_events"])

    kept = ", ".join(f"{f} string" for f in _FIELDS) + ", n_events long"
    return events.groupBy("session_id").applyInPandasWithState(update, _SCHEMA, kept, "update", GroupStateTimeout.NoTimeout)


def latest(requests: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last request of each key; what answers an older one is stale."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return requests.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def single_flight(requests: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A stream of requests without repeated request ids."""
    return requests.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["request_id"])


def recalculate(selections: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Committed selections joined with the scenario now chosen: what to route again."""
    return selections.filter("start is not null and destination is not null").join(scenarios, "session_id")


#: A selection or a scenario of a session; the fields of the other kind are null.
CHANGES = "session_id long, event_id long, ts timestamp, start string, destination string, scenario string"
_HELD = "start string, destination string, picked long, picked_id long, scenario string, chosen long, chosen_id long"
_REQUEST = "session_id long, start string, destination string, scenario string, asked long"


def _changed(held: dict, row: dict | Row) -> dict:
    """What a session holds after a change; one that is older than what is held is stale and changes nothing."""
    at = (int(row["at"]), int(row["event_id"]))
    if row["scenario"] is None:
        if held["picked"] is None or at > (held["picked"], held["picked_id"]):
            return held | {"start": row["start"], "destination": row["destination"], "picked": at[0], "picked_id": at[1]}
    elif held["chosen"] is None or at > (held["chosen"], held["chosen_id"]):
        return held | {"scenario": row["scenario"], "chosen": at[0], "chosen_id": at[1]}
    return held


def _request(held: dict) -> tuple | None:
    """What to route: ends, scenario, and when the newer of both came."""
    if held["start"] is None or held["destination"] is None or held["scenario"] is None:
        return None
    return held["start"], held["destination"], held["scenario"], max(held["picked"], held["chosen"])


class ScenarioChanges(StatefulProcessor):
    """Joins a session's selection with its newest scenario, whichever comes last; what idles is forgotten."""

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", _HELD)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        names = [c.split()[0] for c in _HELD.split(", ")]
        before = dict(zip(names, self.held.get(), strict=True)) if self.held.exists() else dict.fromkeys(names)
        held = before
        for row in rows:
            held = _changed(held, row)
        if held == before:
            return
        self.held.update(tuple(held[n] for n in names))
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(max(held["picked"] or 0, held["chosen"] or 0) // 1000 + self.idle_ms)
        asked = _request(held)
        if asked and asked != _request(before):
            yield Row(**dict(zip([c.split()[0] for c in _REQUEST.split(", ")], (key[0], *asked), strict=True)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_recalculations(changes: DataFrame, idle: str | None = None) -> DataFrame:
    """``(session_id, start, destination, scenario, asked)``: what to route again as selections and scenarios (``CHANGES``) change.

    A micro-batch gives each session's newest request only, and none where it
    stays the same; ``asked`` is when its newer part came, in microseconds.
    Changes may come in any order.  A session without a change for ``idle`` of
    event time ("10 minutes") is forgotten, so that a later scenario routes
    nothing.  Needs the RocksDB state store, which this sets for the session.
    """
    spark = changes.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = changes if idle is None else changes.withWatermark("ts", "0 seconds")
    ms = None if idle is None else int(pd.Timedelta(idle).total_seconds() * 1000)
    rows = rows.withColumn("at", F.unix_micros("ts"))
    return rows.groupBy("session_id").transformWithState(ScenarioChanges(ms), _REQUEST, "Update", "None" if idle is None else "EventTime")


def recalculations(changes: DataFrame) -> DataFrame:
    """Each session's last request of a batch of ``CHANGES``; what the stream has given last, if nothing was forgotten."""
    at = F.struct("ts", "event_id")
    last = lambda of, kind: F.max_by(F.when(kind, of), F.when(kind, at))
    scenario = F.col("scenario").isNotNull()
    ends = F.struct("start", "destination")
    held = changes.groupBy("session_id").agg(
        last(ends, ~scenario).alias("ends"), last(F.col("scenario"), scenario).alias("scenario"),
        F.greatest(F.max(F.when(scenario, F.unix_micros("ts"))), F.max(F.when(~scenario, F.unix_micros("ts")))).alias("asked"),
    )
    held = held.select("session_id", "ends.start", "ends.destination", "scenario", "asked")
    return held.filter("start is not null and destination is not null and scenario is not null")


def pending_units(units: DataFrame, progress: DataFrame, shards: DataFrame) -> DataFrame:
    """``(unit_id, status)`` still to do: a unit is done only with a completed record and its shard."""
    done = progress.filter("status = 'completed'").select("unit_id").join(shards.select("unit_id").distinct(), "unit_id", "left_semi")
    failed = progress.filter("status = 'failed'").select("unit_id", F.lit("failed").alias("status")).dropDuplicates(["unit_id"])
    return units.select("unit_id").distinct().join(done, "unit_id", "left_anti").join(failed, "unit_id", "left").select("unit_id", F.coalesce("status", F.lit("new")).alias("status"))


def tumbling_counts(events: DataFrame, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Events by type and time window with a watermark; an addition for streams, not part of the routing model."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", "event_type", "n")
