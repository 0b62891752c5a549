"""Projections that follow from a timeline by windows and sums: sessions, intents, constraints, commands, edits, files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import commands as cmd
from ..functions.text import collapse_whitespace
from ..sources.ledger import EDIT_TOOLS, SHELL_TOOLS
from .order import is_turn, prompt_text

#: A prompt that begins with ``/`` and a word is a sentence, not a command, if one of these follows.
PREDICATES = (
    "is isn't are aren't was wasn't were weren't has hasn't have haven't had does doesn't did didn't do don't can can't cannot could couldn't will won't would "
    "wouldn't should shouldn't must may might keeps kept seems looks appears returns returned fails failed throws threw crashes crashed breaks broke hangs hung "
    "gives gave shows showed contains points redirects responds responded leaks exists still no not never gets got needs lacks times serves loads"
).split()


def sessions(timeline: DataFrame) -> DataFrame:
    """A row per session: bounds, last known transcript, epoch, events, end."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("position")))
    ended = F.col("hook_event") == "SessionEnd"
    return timeline.groupBy("session_id").agg(
        F.min_by("project_id", "position").alias("project_id"), F.min("ts_ms").alias("started_ms"), F.max("logical_ms").alias("last_event_ms"),
        last("transcript_path").alias("transcript_path"), F.max("epoch").alias("epoch"), F.count("*").alias("events"),
        F.max_by("logical_ms", F.when(ended, F.col("position"))).alias("ended_ms"), F.max_by("reason", F.when(ended, F.col("position"))).alias("end_reason"),
    )


def is_slash_command(text: Column) -> Column:
    words = F.split(F.lower(text), " ")
    sentence = F.size(F.array_intersect(F.slice(words, 2, 3), F.array(*[F.lit(w) for w in PREDICATES]))) > 0
    return text.rlike(r"^/[A-Za-z][A-Za-z0-9_:-]*( |$)") & ~sentence


def intents(timeline: DataFrame) -> DataFrame:
    """What each prompt asked: the first long one of an epoch (or ``task:``) is its ROOT, ``subtask:`` a SUBTASK, others LATEST.

    A SUBTASK or LATEST ends with the next of its level in the epoch; a ROOT lasts.
    """
    text = collapse_whitespace(F.col("prompt"))
    low = F.lower(text)
    rest = lambda n: F.trim(F.substring(text, n, 1 << 30))
    level = (
        F.when(is_slash_command(text), None)
        .when(low.startswith("task:"), F.when(rest(6) != "", "TASK"))
        .when(low.startswith("subtask:"), F.when(rest(9) != "", "SUBTASK"))
        .when(F.char_length(text) >= 3, "PLAIN")
    )
    body = F.when(low.startswith("task:"), rest(6)).when(low.startswith("subtask:"), rest(9)).otherwise(text)
    said = timeline.where(is_turn()).select("session_id", "epoch", "position", "id", F.col("logical_ms").alias("created_ms"), level.alias("kind"), body.alias("text")).where("kind is not null")
    can = (F.col("kind") == "TASK") | ((F.col("kind") == "PLAIN") & (F.char_length("text") >= 20))
    first = F.min(F.when(can, F.col("position"))).over(Window.partitionBy("session_id", "epoch"))
    ranked = said.withColumn("level", F.when(F.col("position") == first, "ROOT").when(F.col("kind") == "SUBTASK", "SUBTASK").otherwise("LATEST"))
    order = Window.partitionBy("session_id", "epoch", "level").orderBy("position")
    after = F.when(F.col("level") != "ROOT", F.lead("created_ms").over(order))
    by = F.when(F.col("level") != "ROOT", F.lead("id").over(order))
    return ranked.select("session_id", "epoch", "position", "level", "text", F.col("id").alias("source_event_id"), "created_ms", after.alias("superseded_ms"), by.alias("superseded_by"))


def commands(timeline: DataFrame) -> DataFrame:
    """A row per shell command with kind, outcome, excerpt and, for failed runs, the files it names."""
    shell = timeline.where(F.col("tool_name").isin(*SHELL_TOOLS) & F.col("hook_event").isin("PostToolUse", "PostToolUseFailure") & (F.trim("command") != ""))
    told = shell if "kind" in timeline.columns else shell.withColumn("__d", cmd.described("command")).withColumns({"kind": F.col("__d.kind"), "signature": F.col("__d.signature")})
    failed = F.col("hook_event") == "PostToolUseFailure"
    code = F.coalesce(F.col("exit_code"), cmd.exit_code_prefix(F.col("error")))
    output = F.when(F.col("error").isNotNull(), F.regexp_replace("error", r"^Exit code -?\d+\n?", "")).otherwise(F.concat_ws("\n", F.nullif("stdout_tail", F.lit("")), F.nullif("stderr_tail", F.lit(""))))
    ended = cmd.outcome(F.col("kind"), failed, code, F.col("interrupted"), output)
    wide = told.withColumns({"__output": output, "outcome": ended, "__code": code})
    bad = (F.col("outcome") == "FAIL") & F.col("kind").isin(*cmd.RUNNERS)
    return wide.select(
        "session_id", "epoch", "position", F.col("id").alias("event_id"), "kind", "signature", F.col("command").alias("command_text"), "outcome", F.col("__code").alias("exit_code"),
        F.when(F.col("outcome") == "FAIL", F.array_join(cmd.failure_excerpt(F.col("__output")), "\n")).alias("excerpt"), F.when(bad, F.col("mentioned")).alias("mentioned"), F.col("logical_ms").alias("ts_ms"),
    )


def edits(timeline: DataFrame) -> DataFrame:
    """A row per edit of a file, as recorded; its fate is operators.edits."""
    done = timeline.where(F.col("tool_name").isin(*EDIT_TOOLS) & (F.col("hook_event") == "PostToolUse") & F.col("path").isNotNull())
    return done.select("session_id", "epoch", "position", F.col("id").alias("event_id"), "agent_id", "path", "tool_name", "pre_hash", "post_hash", "lines_added", "lines_removed", "excerpt", F.col("logical_ms").alias("ts_ms"))


def file_stats(timeline: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Reads, edits, failure mentions and touches per (session, epoch, path)."""
    touch = timeline.where((F.col("hook_event") == "PostToolUse") & F.col("path").isNotNull() & (F.col("tool_name").isin(*EDIT_TOOLS) | (F.col("tool_name") == "Read")))
    rows = touch.select(
        "session_id", "epoch", "path", (F.col("tool_name") == "Read").cast("int").alias("reads"), (F.col("tool_name") != "Read").cast("int").alias("edits"), F.lit(False).alias("in_failure"), F.col("logical_ms").alias("ts"),
    )
    if runs is not None:
        named = runs.where("mentioned is not null").select("session_id", "epoch", F.explode("mentioned.path").alias("path"), F.lit(0).alias("reads"), F.lit(0).alias("edits"), F.lit(True).alias("in_failure"), F.col("ts_ms").alias("ts"))
        rows = rows.unionByName(named)
    return rows.groupBy("session_id", "epoch", "path").agg(
        F.sum("reads").alias("reads"), F.sum("edits").alias("edits"), F.max("in_failure").alias("in_failure"), F.max("ts").alias("last_touch_ms"), F.min("ts").alias("first_touch_ms"),
    )


def recent_edit_paths(timeline: DataFrame, n: int) -> DataFrame:
    """The n last edited paths of each session."""
    last = edits(timeline).groupBy("session_id", "path").agg(F.max("event_id").alias("last_id"))
    order = Window.partitionBy("session_id").orderBy(F.desc("last_id"))
    return last.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def constraints(timeline: DataFrame) -> DataFrame:
    """Rules that prompts state, the first statement of each per (session, epoch)."""
    from ..functions.prompts import stated_rules

    said = timeline.where(is_turn()).select("session_id", "epoch", "position", "prompt_ordinal", F.col("id").alias("source_event_id"), F.col("logical_ms").alias("created_ms"), F.posexplode(stated_rules(prompt_text(F.col("prompt")))).alias("n", "r"))
    order = Window.partitionBy("session_id", "epoch", "r.text").orderBy("position", "n")
    one = said.withColumn("__k", F.row_number().over(order)).where("__k = 1")
    return one.select("session_id", "epoch", "position", "n", "prompt_ordinal", "source_event_id", "created_ms", "r.text", "r.cue", "r.kind")
