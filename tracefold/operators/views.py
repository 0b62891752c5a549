"""Sections as of a time: statuses with the time in which they hold, so that any time is a range filter.

Each table is made once from the whole timeline. Its rows hold from ``from_ms`` (included) until ``until_ms`` (not included; null: still), in
logical time; what ``as_of`` keeps is what the folds would say of the events up to then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_outside
from . import edits as life
from .ranking import working_score


def as_of(intervals: DataFrame, ms: int | Column) -> DataFrame:
    at = F.lit(ms) if isinstance(ms, int) else ms
    return intervals.where((F.col("from_ms") <= at) & (F.col("until_ms").isNull() | (at < F.col("until_ms"))))


def edit_statuses(observed: DataFrame) -> DataFrame:
    """(session_id, path, event_id, status, mechanism) over time, from the observations of operators.edits."""
    return life.histories(observed).where("event_id is not null").drop("dead_end_id", "edit_ids")


def dead_end_statuses(observed: DataFrame) -> DataFrame:
    """(session_id, path, id, edit_ids, mechanism, reapplied) over time."""
    rows = life.histories(observed).where("dead_end_id is not null")
    return rows.select("session_id", "path", F.col("dead_end_id").alias("id"), "edit_ids", "mechanism", (F.col("status") == "REAPPLIED").alias("reapplied"), "from_ms", "until_ms")


def failure_statuses(runs: DataFrame) -> DataFrame:
    """Failed commands over time: open until the first later pass of their signature in the epoch, settled from then on."""
    order = Window.partitionBy("session_id", "epoch", "signature").orderBy(F.desc("ts_ms"), F.desc("event_id")).rowsBetween(Window.unboundedPreceding, -1)
    passed = F.min(F.when(F.col("outcome") == "PASS", F.struct("ts_ms", "event_id"))).over(order)
    failed = runs.withColumn("__p", passed).where("outcome = 'FAIL'")
    states = F.array(
        F.struct(F.lit("OPEN").alias("status"), F.lit(None).cast("bigint").alias("resolved_by"), F.col("ts_ms").alias("from_ms"), F.col("__p.ts_ms").alias("until_ms")),
        F.struct(F.lit("RESOLVED").alias("status"), F.col("__p.event_id").alias("resolved_by"), F.col("__p.ts_ms").alias("from_ms"), F.lit(None).cast("bigint").alias("until_ms")),
    )
    kept = F.when(F.col("__p").isNull(), F.slice(states, 1, 1)).otherwise(states)
    return failed.select("session_id", "epoch", "event_id", "kind", "signature", "command_text", "excerpt", F.inline(kept))


def file_activity(timeline: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """What was known of each (session, epoch, path) over time: counts that grow with every touch, and the score that ranks working files."""
    from .folds import EDIT_TOOLS

    touch = timeline.where((F.col("hook_event") == "PostToolUse") & F.col("path").isNotNull() & (F.col("tool_name").isin(*EDIT_TOOLS) | (F.col("tool_name") == "Read")))
    one = touch.select(
        "session_id", "epoch", "path", (F.col("tool_name") == "Read").cast("int").alias("r"), (F.col("tool_name") != "Read").cast("int").alias("e"), F.lit(False).alias("f"), F.col("logical_ms").alias("from_ms"),
    )
    if runs is not None:
        one = one.unionByName(runs.where("mentioned is not null").select("session_id", "epoch", F.explode("mentioned.path").alias("path"), F.lit(0).alias("r"), F.lit(0).alias("e"), F.lit(True).alias("f"), F.col("ts_ms").alias("from_ms")))
    # touches of one moment count together
    at = one.groupBy("session_id", "epoch", "path", "from_ms").agg(F.sum("r").alias("r"), F.sum("e").alias("e"), F.max("f").alias("f"))
    keys = Window.partitionBy("session_id", "epoch", "path").orderBy("from_ms")
    upto = keys.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    grown = at.select(
        "session_id", "epoch", "path", F.sum("e").over(upto).alias("edits"), F.sum("r").over(upto).alias("reads"), F.max("f").over(upto).alias("in_failure"), F.min("from_ms").over(upto).alias("first_touch_ms"),
        F.col("from_ms").alias("last_touch_ms"), "from_ms", F.lead("from_ms").over(keys).alias("until_ms"),
    )
    score = working_score(F.lit(False), F.col("in_failure"), F.col("edits"), F.col("reads"))
    return grown.withColumns({"outside": is_outside(F.col("path")), "score": score})
