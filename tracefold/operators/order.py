"""Logical order, logical time and epochs of a session's events."""

from __future__ import annotations

from array import array
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Anchors:
    """The direct events of one session, in id order, that may still be an anchor: ids and clocks both rise from one to the next.

    A direct event with a clock not above its own takes an earlier one's place for every late event to come. 16 bytes each.
    """

    def __init__(self) -> None:
        self.ids, self.clocks = array("q"), array("q")

    def direct(self, event: int, ts: int) -> None:
        keep = bisect_right(self.clocks, ts - 1)
        del self.ids[keep:], self.clocks[keep:]
        self.ids.append(event)
        self.clocks.append(ts)

    def of(self, ts: int) -> int:
        """The last direct event so far that is not later by the clock; -1 if none is."""
        at = bisect_right(self.clocks, ts)
        return self.ids[at - 1] if at else -1


def anchors(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
    """Anchors of (session_id, id, ts_ms, spooled) in that order, session after session."""
    session, held = None, Anchors()
    for columns in batches:
        out = []
        for s, event, ts, late in zip(*(c.tolist() for c in columns), strict=True):
            if s != session:
                session, held = s, Anchors()
            if late:
                out.append(held.of(ts))
            else:
                held.direct(event, ts)
                out.append(event)
        yield pd.Series(out, dtype="int64")


def logical_order(events: DataFrame) -> DataFrame:
    """events with anchor and position (from 1).

    Direct events keep their id order. A spooled event follows the last direct event of smaller id that is not later by the clock;
    spooled events of one anchor order by clock, then id. Sessions are dealt once by key; a task streams them in id order and holds
    one session's anchors, whether its clock runs back or not. Events without a session or clock do not occur in a ledger.
    """
    told = F.pandas_udf(anchors, "bigint").asNondeterministic()  # it depends on the rows' order
    dealt = events.repartition("session_id").sortWithinPartitions("session_id", "id")
    out = dealt.withColumn("anchor", told("session_id", "id", "ts_ms", "spooled"))
    order = Window.partitionBy("session_id").orderBy("anchor", "spooled", F.when(F.col("spooled"), F.col("ts_ms")), "id")
    return out.withColumn("position", F.row_number().over(order))


def prompt_text(prompt: Column) -> Column:
    return F.trim(F.coalesce(prompt, F.lit("")))


def is_turn() -> Column:
    return (F.col("hook_event") == "UserPromptSubmit") & (prompt_text(F.col("prompt")) != "")


def opens_epoch() -> Column:
    clear = (F.col("hook_event") == "SessionStart") & (F.col("source") == "clear")
    task = (F.col("hook_event") == "UserPromptSubmit") & F.lower(prompt_text(F.col("prompt"))).startswith("task:")
    return F.coalesce(clear | task, F.lit(False))


def timeline(events: DataFrame) -> DataFrame:
    """Parsed events with position, logical_ms (running maximum of the clock), epoch (from 1) and prompt_ordinal (turns before)."""
    so_far = Window.partitionBy("session_id").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("session_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    return logical_order(events).withColumns({
        "logical_ms": F.max("ts_ms").over(so_far),
        "epoch": (F.sum(opens_epoch().cast("int")).over(so_far) + 1).cast("int"),
        "prompt_ordinal": F.coalesce(F.sum(is_turn().cast("int")).over(before), F.lit(0)).cast("int"),
    })
