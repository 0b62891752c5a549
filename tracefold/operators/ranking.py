"""Deterministic selections per session: total orders cut to the first k by window, which Spark prunes before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_incidental, is_outside, names_identifier


def top(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows per keys, with rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def working_score(pinned: Column, in_failure: Column, edits: Column, reads: Column) -> Column:
    """0 to 24; every term saturates."""
    three = F.lit(3)
    return 6 * pinned.cast("int") + 4 * in_failure.cast("int") + 3 * F.least(edits, three) + 2 * (reads >= 2).cast("int") + F.least(reads, three)


def working_files(stats: DataFrame, k: int = 8, pinned: DataFrame | None = None) -> DataFrame:
    """The files that a session works on: own before foreign ones, then by score.

    pinned (session_id, epoch, path): files that the record already names, as dead ends, attempts or failure locations.
    """
    if pinned is None:
        stats = stats.withColumn("pinned", F.lit(False))
    else:
        named = pinned.select("session_id", "epoch", "path").distinct().withColumn("pinned", F.lit(True))
        stats = stats.join(named, ["session_id", "epoch", "path"], "left").withColumn("pinned", F.coalesce("pinned", F.lit(False)))
    score = working_score(F.col("pinned"), F.col("in_failure"), F.col("edits"), F.col("reads"))
    wide = stats.withColumns({"outside": is_outside(F.col("path")), "incidental": is_incidental(F.col("path")), "score": score})
    order = [F.asc("outside"), F.asc("incidental"), F.desc("score"), F.desc("edits"), F.desc("reads"), F.asc("first_touch_ms"), F.asc("path")]
    return top(wide, ["session_id", "epoch"], order, k)


def dead_end_slots(dead: DataFrame, k: int = 4) -> DataFrame:
    """Recent dead ends, one of each path before a second of any; shown by recency."""
    newest = [F.desc("resolved_ms"), F.desc("id")]
    nth = F.row_number().over(Window.partitionBy("session_id", "epoch", "path").orderBy(*newest))
    picked = top(dead.withColumn("__n", nth), ["session_id", "epoch"], [F.asc(F.col("__n") > 1), *newest], k)
    return picked.withColumn("rank", F.row_number().over(Window.partitionBy("session_id", "epoch").orderBy(*newest))).drop("__n")


def attempts(edits: DataFrame, dead: DataFrame, k: int = 4) -> DataFrame:
    """The last live edit of each path that no dead end names; own before foreign files, then by recency. edits: with status."""
    last = edits.where("status = 'ACTIVE'").groupBy("session_id", "epoch", "path").agg(F.max(F.struct("event_id", "ts_ms"))["event_id"].alias("event_id"), F.max_by("ts_ms", "event_id").alias("ts_ms"))
    loose = last.join(dead.select("session_id", "epoch", "path").distinct(), ["session_id", "epoch", "path"], "left_anti")
    return top(loose, ["session_id", "epoch"], [is_outside(F.col("path")).asc(), is_incidental(F.col("path")).asc(), F.desc("ts_ms"), F.desc("event_id")], k)


def next_target(failures: DataFrame, edits: DataFrame) -> DataFrame:
    """(session_id, epoch, rule, target, source): the first place that the newest open failure's excerpt shows, else the last live edit.

    failures: open ones with mentioned (path, line, raw) and excerpt; edits: with status.
    """
    newest = top(failures, ["session_id", "epoch"], [F.desc("ts_ms"), F.desc("event_id")], 1)
    shown = lambda m: m["path"].isNotNull() & m["line"].isNotNull() & F.col("excerpt").contains(F.coalesce(m["raw"], m["path"]))
    place = F.get(F.filter(F.coalesce("mentioned", F.array().cast("array<struct<path:string,line:int,raw:string>>")), shown), F.lit(0))
    by_failure = newest.withColumn("__m", place).where("__m is not null").select(
        "session_id", "epoch", F.concat_ws(":", "__m.path", F.col("__m.line").cast("string")).alias("f_target"), F.concat(F.lit("commands:"), "event_id").alias("f_source")
    )
    live = top(edits.where("status = 'ACTIVE'"), ["session_id", "epoch"], [is_outside(F.col("path")).asc(), is_incidental(F.col("path")).asc(), F.desc("ts_ms"), F.desc("event_id")], 1)
    by_edit = live.select("session_id", "epoch", F.col("path").alias("e_target"), F.concat(F.lit("edits:"), "event_id").alias("e_source"))
    both = by_failure.join(by_edit, ["session_id", "epoch"], "full_outer")
    failed = F.col("f_target").isNotNull()
    return both.select(
        "session_id", "epoch", F.when(failed, "failure-location").otherwise("last-active-edit").alias("rule"), F.coalesce("f_target", "e_target").alias("target"), F.coalesce("f_source", "e_source").alias("source")
    )


def picked_rules(rules: DataFrame, k: int = 3) -> DataFrame:
    """Rules once per wording (case and blanks apart), labelled first, then prohibitions, each in the order stated."""
    same = F.lower(F.regexp_replace(F.trim("text"), r"\s+", " "))
    once = rules.withColumn("__s", same).withColumn("__r", F.row_number().over(Window.partitionBy("session_id", "epoch", "__s").orderBy("ordinal"))).where("__r = 1")
    rank = F.when(F.col("kind") == "labelled", 0).when(F.col("kind") == "prohibition", 1).otherwise(2)
    return top(once, ["session_id", "epoch"], [rank.asc(), F.asc("ordinal")], k).drop("__s", "__r")


def objective(intents: DataFrame) -> DataFrame:
    """Per (session, epoch): the root, or the earliest text of 20 characters; the last LATEST; the live SUBTASK."""
    long_one = F.when(F.char_length("text") >= 20, F.col("position"))
    return intents.groupBy("session_id", "epoch").agg(
        F.coalesce(F.min_by("text", F.when(F.col("level") == "ROOT", F.col("position"))), F.min_by("text", long_one)).alias("objective"),
        F.max_by("text", F.when(F.col("level") == "LATEST", F.col("position"))).alias("latest"),
        F.max_by("text", F.when((F.col("level") == "SUBTASK") & F.col("superseded_ms").isNull(), F.col("position"))).alias("subtask"),
    )


def earlier_code_message(intents: DataFrame, within: int = 12) -> DataFrame:
    """The newest of the last superseded messages that names code."""
    past = intents.where("level in ('LATEST', 'SUBTASK') and superseded_ms is not null")
    last = top(past, ["session_id", "epoch"], [F.desc("position")], within)
    code = F.exists(F.split("text", " "), names_identifier)
    return top(last.drop("rank").where(code), ["session_id", "epoch"], [F.desc("position")], 1)
