"""Delivery of checkpoints: at most one live continuation per session, moved by channel, as a batch fold and as a stream; claims of staged records.

A step is an event that may move a continuation, in order of its id (arrival). A checkpoint is PENDING until a channel writes it out: a
session start after compaction or on resume, a tool call later than the checkpoint, or a prompt. Written, it is ATTACHED; only what the prompt
channel wrote is written again, by a prompt, three times at most. The first tool call, failed call or stop later than the last writing
makes it CONFIRMED. A newer checkpoint makes it SUPERSEDED; a clear or logout, the cap or its age make it EXPIRED.

Late (spooled) rows deliver nothing: their evidence is seen by the next direct step, and a late checkpoint counts only if no checkpoint or clear
of the session is as new. Age is seven days from the checkpoint. A PENDING one then expires even if nothing more happens, dated at
that moment, whoever notices: the batch fold by ``as_of``, the stream by a timer. A timer's verdict stands until an event of before that moment
arrives after all, which goes on from the state before; the latest version of a checkpoint's row holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

WEEK_MS = 7 * 86_400_000
MOST_ATTACHES = 3
STATE = "session_id string, checkpoint_id bigint, state string, attach_count int, attached_ms bigint, attached_channel string, confirmed_ms bigint, confirm_event_id bigint, updated_ms bigint"
#: A changed continuation: version (the id of the last step) and by_timer say which of a checkpoint's rows is the latest.
CHANGE = STATE + ", version bigint, by_timer boolean"
STEP = "id bigint, ts_ms bigint, op string, late boolean"
EVIDENCE = ("post_tool", "failure", "stop")
#: What a session's fold holds between steps: its live continuation, the evidence that it has seen since, and its newest checkpoint and clear.
HELD = (
    "checkpoint_id bigint, state string, attach_count int, attached_ms bigint, attached_channel string, created_ms bigint, updated_ms bigint, "
    "seen_ms bigint, seen_id bigint, newest_ms bigint, cleared_ms bigint, version bigint"
)
HELD_NAMES = [f.split(" ")[0] for f in HELD.split(", ")]
CHANGE_NAMES = [f.split(" ")[0] for f in CHANGE.split(", ")]
LIVE = ("checkpoint_id", "state", "attach_count", "attached_ms", "attached_channel", "created_ms", "updated_ms", "seen_ms", "seen_id")


class Fold:
    """One session's continuations, step by step; changes are (checkpoint_id, state, ...) dicts."""

    def __init__(self, held: dict | None = None) -> None:
        self.h = dict.fromkeys(HELD_NAMES) | (held or {})

    def due(self) -> int | None:
        """When the live continuation expires if nothing happens."""
        return self.h["created_ms"] + WEEK_MS + 1 if self.h["state"] == "PENDING" else None

    def change(self, **more) -> dict:
        h = self.h
        return {n: h[n] for n in ("checkpoint_id", "state", "attach_count", "attached_ms", "attached_channel", "updated_ms", "version")} | {"confirmed_ms": None, "confirm_event_id": None, "by_timer": False} | more

    def end(self, state: str, ts: int, **more) -> list[dict]:
        out = self.change(state=state, updated_ms=ts, **more)
        self.h |= dict.fromkeys(LIVE)
        return [out]

    def step(self, event: int, ts: int, op: str, late: bool) -> list[dict]:
        h = self.h
        h["version"] = event
        newer = lambda n: h[n] is None or ts > h[n]
        if op == "checkpoint":
            if late and not (newer("newest_ms") and newer("cleared_ms")):
                return []
            out = self.end("SUPERSEDED", ts) if h["state"] else []
            h["newest_ms"] = ts if newer("newest_ms") else h["newest_ms"]
            h |= {"checkpoint_id": event, "state": "PENDING", "attach_count": 0, "created_ms": ts, "updated_ms": ts}
            return [*out, self.change()]
        if op == "expire":
            h["cleared_ms"] = ts if newer("cleared_ms") else h["cleared_ms"]
            return self.end("EXPIRED", ts) if h["state"] and not late else []
        if not h["state"]:
            return []
        if op in EVIDENCE and h["state"] == "ATTACHED" and ts > h["attached_ms"] and (h["seen_ms"] is None or (ts, event) < (h["seen_ms"], h["seen_id"])):
            h |= {"seen_ms": ts, "seen_id": event}
        if late:
            return []
        old = ts - h["created_ms"] > WEEK_MS
        if h["state"] == "PENDING":
            if old:
                return self.end("EXPIRED", self.due())
            if op not in ("session_start", "post_tool", "user_prompt") or op == "post_tool" and ts <= h["created_ms"]:
                return []
            h |= {"state": "ATTACHED", "attach_count": 1, "attached_ms": ts, "attached_channel": op, "updated_ms": ts}
            return [self.change()]
        if h["seen_ms"] is not None:
            return self.end("CONFIRMED", h["seen_ms"], confirmed_ms=h["seen_ms"], confirm_event_id=h["seen_id"])
        if op not in ("session_start", "user_prompt"):
            return []
        if old:
            return self.end("EXPIRED", ts)
        if op != "user_prompt" or h["attached_channel"] != "user_prompt":
            return []
        if h["attach_count"] >= MOST_ATTACHES:
            return self.end("EXPIRED", ts)
        h |= {"attach_count": h["attach_count"] + 1, "attached_ms": ts, "updated_ms": ts}
        return [self.change()]


def frame(session: list[str], rows: list[dict], names: list[str]) -> pd.DataFrame:
    made = pd.DataFrame(rows, columns=[n for n in names if n != "session_id"], dtype=object)
    made.insert(0, "session_id", pd.Series(session, dtype=object))
    whole = {"checkpoint_id", "attach_count", "attached_ms", "confirmed_ms", "confirm_event_id", "updated_ms", "version"} & set(names)
    return made.astype(dict.fromkeys(whole, "Int64") | ({"by_timer": bool} if "by_timer" in names else {}))


def continuations(steps: DataFrame, as_of: int | None = None) -> DataFrame:
    """The last state of every continuation. steps: session_id and STEP. as_of: the time (ms) by which PENDING ones are too old or not; else only steps tell.

    Sessions are dealt by key and come sorted by id; a task streams them and holds one session's fold at a time.
    """
    names = [f.split(" ")[0] for f in STATE.split(", ")]
    read = ["session_id", "id", "ts_ms", "op", "late"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, fold, last, session, rows = None, Fold(), None, [], []

        def keep(row: dict) -> None:
            session.append(key)
            rows.append(row)

        def close() -> None:
            if fold.h["state"]:
                due = fold.due()
                keep(fold.end("EXPIRED", due)[0] if as_of is not None and due is not None and as_of >= due else fold.change())

        for part in frames:
            for s, event, ts, op, late in zip(*(part[c].tolist() for c in read), strict=True):
                if s != key:
                    close()
                    if len(rows) > 50_000:
                        yield frame(session, rows, names)
                        session, rows = [], []
                    key, fold = s, Fold()
                last = fold.step(event, ts, op, late)
                for c in last:
                    if c["state"] not in ("PENDING", "ATTACHED"):
                        keep(c)
        close()
        if rows:
            yield frame(session, rows, names)

    return steps.select(*read).repartition("session_id").sortWithinPartitions("session_id", "id").mapInPandas(run, STATE)


class Delivery(StatefulProcessor):
    """The fold as a stateful operator: a value state of some hundred bytes per session, and a timer while a continuation is PENDING."""

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", HELD)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fold = Fold(dict(zip(HELD_NAMES, self.held.get(), strict=True)) if self.held.exists() else None)
        steps = pd.concat(list(rows)).sort_values("id")  # one session's rows of one micro-batch
        out = [c for r in zip(*(steps[c].tolist() for c in ("id", "ts_ms", "op", "late")), strict=True) for c in fold.step(*r)]
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if fold.due() is not None:
            self.handle.registerTimer(fold.due())
        self.held.update(tuple(fold.h[n] for n in HELD_NAMES))
        yield frame([key[0]] * len(out), out, CHANGE_NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        fold = Fold(dict(zip(HELD_NAMES, self.held.get(), strict=True)))
        out = [fold.change(state="EXPIRED", updated_ms=fold.due(), by_timer=True)] if fold.due() is not None else []
        yield frame([key[0]] * len(out), out, CHANGE_NAMES)

    def close(self) -> None:
        pass


def streamed(steps: DataFrame) -> DataFrame:
    """CHANGE rows of a stream of steps. Needs the RocksDB state store; timers follow the wall clock, so that no late event is dropped."""
    return steps.groupBy("session_id").transformWithStateInPandas(Delivery(), CHANGE, "Append", "ProcessingTime")


def latest(changes: DataFrame) -> DataFrame:
    """The row of each continuation that holds, from all changes that a stream has written."""
    names = [f.split(" ")[0] for f in STATE.split(", ")]
    newest = F.max_by(F.struct(*names), F.struct("version", "by_timer")).alias("c")
    return changes.groupBy("session_id", "checkpoint_id").agg(newest).select("c.*")


def steps_of(events: DataFrame) -> DataFrame:
    """The steps of parsed events: session_id and STEP."""
    hook = F.col("hook_event")
    op = (
        F.when(hook == "PreCompact", "checkpoint")
        .when((hook == "SessionStart") & (F.col("source") == "clear"), "expire")
        .when((hook == "SessionStart") & F.col("source").isin("compact", "resume"), "session_start")
        .when((hook == "SessionEnd") & F.col("reason").isin("clear", "logout"), "expire")
        .when(hook == "UserPromptSubmit", "user_prompt")
        .when(hook == "PostToolUse", "post_tool")
        .when(hook == "PostToolUseFailure", "failure")
        .when(hook == "Stop", "stop")
    )
    return events.select("session_id", "id", "ts_ms", op.alias("op"), F.col("spooled").alias("late")).where("op is not null")


def claim_outcome(staged: str, now_ms: Column) -> Column:
    """What a session start may do with a staged record (a struct column): the first rule that fails, else CLAIM."""
    c = lambda n: F.col(f"{staged}.{n}")
    return (
        F.when(F.col(staged).isNull(), "NOTHING").when(~F.array_contains(c("deliver_on"), F.col("source")), "NOT_FOR_SOURCE").when(c("claimed"), "ALREADY_CLAIMED")
        .when(c("content_hash") != F.substring(F.sha2(c("capsule"), 256), 1, 32), "DAMAGED").when(c("workspace_id") != F.col("workspace_id"), "OTHER_WORKSPACE")
        .when(now_ms - c("created_ms") > WEEK_MS, "TOO_OLD").otherwise("CLAIM")
    )


def newest_staged(staged: DataFrame) -> DataFrame:
    """The record of the highest generation per workspace."""
    order = Window.partitionBy("workspace_id").orderBy(F.desc("generation"))
    return staged.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")
