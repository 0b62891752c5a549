"""As-of, anti- and interval lookups over the projections; every join has the session among its keys.

Ties and order: commands and edits compare by (ts_ms, event_id). What comes later is a frame that grows over the reversed order: Spark adds a
row to it, where a frame that shrinks is summed up anew for every row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.commands import RUNNERS


def open_failures(runs: DataFrame) -> DataFrame:
    """Failed runner commands that no later run of the same signature in the epoch has passed; one window, no self-join."""
    mine = runs.where(F.col("kind").isin(*RUNNERS))
    order = Window.partitionBy("session_id", "epoch", "signature").orderBy(F.desc("ts_ms"), F.desc("event_id")).rowsBetween(Window.unboundedPreceding, -1)
    later = F.max((F.col("outcome") == "PASS").cast("int")).over(order)
    return mine.withColumn("__p", F.coalesce(later, F.lit(0))).where("outcome = 'FAIL' and __p = 0").drop("__p")


def resolved_by(runs: DataFrame) -> DataFrame:
    """Failed runs with the first later passing run of their signature (null while open)."""
    order = Window.partitionBy("session_id", "epoch", "signature").orderBy(F.desc("ts_ms"), F.desc("event_id")).rowsBetween(Window.unboundedPreceding, -1)
    hit = F.min(F.when(F.col("outcome") == "PASS", F.struct("ts_ms", "event_id"))).over(order)
    return runs.withColumn("resolved_by", hit["event_id"]).where("outcome = 'FAIL'")


def latest_live_edit(edits: DataFrame) -> DataFrame:
    """The last edit of each path that still stands."""
    order = Window.partitionBy("session_id", "epoch", "path").orderBy(F.desc("event_id"))
    return edits.where("status = 'ACTIVE'").withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


def later_edit(edits: DataFrame) -> DataFrame:
    """Each edit with the last later edit of the same file, if any."""
    order = Window.partitionBy("session_id", "epoch", "path").orderBy(F.desc("event_id")).rowsBetween(Window.unboundedPreceding, -1)
    return edits.withColumn("superseded_by", F.max("event_id").over(order))


def afterward(edits: DataFrame, runs: DataFrame) -> DataFrame:
    """Edits with the first test or build command after them: a forward as-of lookup over one merged timeline."""
    marks = runs.where(F.col("kind").isin("test", "build")).select("session_id", "epoch", "ts_ms", F.col("event_id").alias("cmd"), F.lit(None).cast("bigint").alias("edit"))
    rows = edits.select("session_id", "epoch", "ts_ms", F.lit(None).cast("bigint").alias("cmd"), F.col("event_id").alias("edit")).unionByName(marks)
    later = Window.partitionBy("session_id", "epoch").orderBy(F.desc("ts_ms")).rangeBetween(Window.unboundedPreceding, -1)
    first = F.min(F.when(F.col("cmd").isNotNull(), F.struct("ts_ms", "cmd"))).over(later)
    return rows.withColumn("afterward", first["cmd"]).where("edit is not null").select("session_id", "epoch", F.col("edit").alias("event_id"), "ts_ms", "afterward")


def observed_between(spans: DataFrame, runs: DataFrame) -> DataFrame:
    """spans (session_id, span_id, from_ms, to_ms) with the first test or build command inside: the first one not before from_ms, if it is not after to_ms."""
    marks = runs.where(F.col("kind").isin("test", "build")).select("session_id", F.col("ts_ms").alias("from_ms"), F.col("event_id").alias("cmd"))
    both = spans.select("session_id", "span_id", "from_ms", "to_ms", F.lit(False).alias("__mark")).unionByName(marks.withColumn("__mark", F.lit(True)), allowMissingColumns=True)
    later = Window.partitionBy("session_id").orderBy(F.desc("from_ms")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.min(F.when(F.col("__mark"), F.struct("from_ms", "cmd"))).over(later)
    met = both.withColumn("__first", first).where("not __mark")
    return met.select("session_id", "span_id", "from_ms", "to_ms", F.when(F.col("__first.from_ms") <= F.col("to_ms"), F.col("__first.cmd")).alias("observed_after"))


def first_evidence(marks: DataFrame, events: DataFrame) -> DataFrame:
    """marks (session_id, mark_id, at_ms) with the first tool result or stop after each: confirmation of a delivery."""
    kinds = ("PostToolUse", "PostToolUseFailure", "Stop")
    rows = events.where(F.col("hook_event").isin(*kinds)).select("session_id", F.col("ts_ms").alias("at_ms"), F.col("id").alias("event"), F.lit(None).cast("bigint").alias("mark_id"))
    both = rows.unionByName(marks.select("session_id", "at_ms", F.lit(None).cast("bigint").alias("event"), "mark_id"))
    later = Window.partitionBy("session_id").orderBy(F.desc("at_ms")).rangeBetween(Window.unboundedPreceding, -1)
    first = F.min(F.when(F.col("event").isNotNull(), F.struct("at_ms", "event"))).over(later)
    return both.withColumn("evidence", first["event"]).where("mark_id is not null").select("session_id", "mark_id", "at_ms", "evidence")


def started_in(events: DataFrame) -> DataFrame:
    """Finished tool calls with the directory that the first PreToolUse of the call recorded."""
    pre = events.where("hook_event = 'PreToolUse' and tool_use_id is not null").groupBy("session_id", "tool_use_id").agg(F.min_by("cwd", "id").alias("start_cwd"), F.min("id").alias("pre_id"))
    post = events.where(F.col("hook_event").isin("PostToolUse", "PostToolUseFailure"))
    return post.join(pre, ["session_id", "tool_use_id"], "left")


def live_continuations(continuations: DataFrame, checkpoints: DataFrame) -> DataFrame:
    return continuations.where(F.col("state").isin("PENDING", "ATTACHED")).join(checkpoints.select("checkpoint_id", "created_ms"), "checkpoint_id")


def session_list(sessions: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Sessions with their number of checkpoints, and the last one by (created_ms, checkpoint_id)."""
    of = checkpoints.groupBy("session_id").agg(F.count("*").alias("checkpoints"), F.max(F.struct("created_ms", "checkpoint_id"))["checkpoint_id"].alias("last_checkpoint"))
    return sessions.join(of, "session_id", "left").withColumn("checkpoints", F.coalesce("checkpoints", F.lit(0)))


def restore_picker(sessions: DataFrame, transcripts: DataFrame, n: int = 20) -> DataFrame:
    """Sessions known to the ledger, to transcripts, or both; the n of latest activity."""
    both = sessions.alias("s").join(transcripts.alias("t"), F.expr("s.session_id = t.session_id"), "full_outer")
    rows = both.select(
        F.coalesce("s.session_id", "t.session_id").alias("session_id"), F.col("t.title").alias("title"), F.coalesce(F.greatest("s.last_event_ms", "t.modified_ms"), F.lit(0)).alias("last_ms"),
        F.when(F.col("s.session_id").isNull(), "transcript").when(F.col("t.session_id").isNull(), "ledger").otherwise("both").alias("known_to"),
    )
    return rows.orderBy(F.desc("last_ms"), "session_id").limit(n)


def resolve_prefix(sessions: DataFrame, events: DataFrame, prefix: str) -> DataFrame:
    """Up to three sessions whose id begins with prefix: none, one, or ambiguous."""
    starts = F.substring("session_id", 1, len(prefix)) == prefix
    found = sessions.where(starts).select("session_id").union(events.where(starts).select("session_id")).distinct()
    return found.orderBy("session_id").limit(3)


#: Fixed value: a shorter prefix names no session.
SHORTEST_PREFIX = 8


def resolve_prefixes(prefixes: DataFrame, sessions: DataFrame, events: DataFrame) -> DataFrame:
    """(prefix, outcome, session_id): each prefix names NONE, ONE (then which) or AMBIGUOUS sessions of either table; one of fewer than eight characters is TOO_SHORT.

    Ids meet prefixes on their first eight characters, so no prefix is held against every id. Case counts, and no character is a wildcard.
    """
    asked = prefixes.select("prefix").where("prefix is not null").distinct().withColumn("__head", F.when(F.char_length("prefix") >= SHORTEST_PREFIX, F.substring("prefix", 1, SHORTEST_PREFIX)))
    known = sessions.select("session_id").union(events.select("session_id")).where("session_id is not null").distinct().withColumn("__head", F.substring("session_id", 1, SHORTEST_PREFIX))
    met = asked.join(known, "__head").where(F.col("session_id").startswith(F.col("prefix"))).groupBy("prefix").agg(F.count("*").alias("n"), F.min("session_id").alias("first"))
    out = asked.join(met, "prefix", "left")
    outcome = F.when(F.col("__head").isNull(), "TOO_SHORT").when(F.col("n").isNull(), "NONE").when(F.col("n") == 1, "ONE").otherwise("AMBIGUOUS")
    return out.select("prefix", outcome.alias("outcome"), F.when(F.col("n") == 1, F.col("first")).alias("session_id"))


def latest_sessions(sessions: DataFrame) -> DataFrame:
    """(project_id, session_id, last_event_ms, latest_of_all): the session of latest activity of every workspace, and whether it is the latest of all."""
    newest = F.max(F.struct("last_event_ms", "session_id"))
    by = sessions.groupBy("project_id").agg(newest.alias("n"))
    top = sessions.agg(newest.alias("n")).first()["n"]  # one row
    return by.select("project_id", "n.session_id", "n.last_event_ms", (F.col("n.session_id") == F.lit(top["session_id"] if top else None)).alias("latest_of_all"))


def backlog(events: DataFrame, cursor: int) -> DataFrame:
    """One row of counts over the ledger and what lies beyond the cursor."""
    return events.agg(F.count("*").alias("events"), F.countDistinct("session_id").alias("sessions"), F.sum((F.col("id") > cursor).cast("int")).alias("backlog"), F.max("ts_ms").alias("last_ms"))


def test_coverage(runs: DataFrame) -> DataFrame:
    """Each failing test of a test run with the first later passing run that covers it: same signature, or a run of the whole suite.

    A run covers the whole suite if its words name no file or test; runner equality is the join key.
    """
    words = F.slice(F.split(F.substring_index("signature", ":", -1), " "), 2, 1 << 20)
    named = F.filter(words, lambda w: ~w.startswith("-") & (w.contains("/") | w.contains("::") | w.rlike(r"\.[a-z]{1,4}$")))
    tests = runs.where("kind = 'test'").withColumns({"runner": F.split(F.substring_index("signature", ":", -1), " ")[0], "named": named})
    failed = tests.where("outcome = 'FAIL'").select("session_id", "epoch", "runner", F.col("event_id").alias("fail_id"), F.col("ts_ms").alias("fail_ms"), "signature", "test_id") if "test_id" in runs.columns else tests.where("outcome = 'FAIL'").select("session_id", "epoch", "runner", F.col("event_id").alias("fail_id"), F.col("ts_ms").alias("fail_ms"), "signature", F.col("signature").alias("test_id"))
    passed = tests.where("outcome = 'PASS'").select("session_id", "epoch", "runner", F.col("event_id").alias("pass_id"), F.col("ts_ms").alias("pass_ms"), F.col("signature").alias("pass_signature"), F.col("named").alias("pass_named"))
    later = failed.join(passed, ["session_id", "epoch", "runner"], "left").where("pass_id is null or pass_ms > fail_ms or (pass_ms = fail_ms and pass_id > fail_id)")
    covers = (F.col("signature") == F.col("pass_signature")) | (F.size("pass_named") == 0) | F.exists("pass_named", lambda p: F.col("test_id").startswith(p))
    hit = later.where(covers).groupBy("session_id", "epoch", "fail_id", "test_id").agg(F.min(F.struct("pass_ms", "pass_id"))["pass_id"].alias("covered_by"))
    return failed.select("session_id", "epoch", "fail_id", "fail_ms", "test_id").join(hit, ["session_id", "epoch", "fail_id", "test_id"], "left")
