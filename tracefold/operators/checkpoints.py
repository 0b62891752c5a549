"""Checkpoints: which requests still count, what is frozen, what was delivered; and the state of tests that a record shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let
from .ranking import top

BOUNDARIES = ("PreCompact", "CheckpointRequest")


def current_requests(requests: DataFrame, checkpoints: DataFrame, timeline: DataFrame) -> DataFrame:
    """The requests (session_id, id, ts_ms) that no checkpoint has settled and nothing later in logical order overtakes.

    Settled: a checkpoint of the session made from that event (watermark), or at or after its time (created_ms). Overtaken: by a compaction or
    request of a later time, or by a start or end that clears the session. timeline: session_id, id, position, ts_ms, hook_event, source,
    reason. One window over the session; no request meets another event in a join.
    """
    later = Window.partitionBy("session_id").orderBy(F.desc("position")).rowsBetween(Window.unboundedPreceding, -1)
    boundary = F.max(F.when(F.col("hook_event").isin(*BOUNDARIES), F.col("ts_ms"))).over(later)
    clears = ((F.col("hook_event") == "SessionStart") & (F.col("source") == "clear")) | ((F.col("hook_event") == "SessionEnd") & F.col("reason").isin("clear", "logout"))
    cleared = F.max(F.coalesce(clears, F.lit(False)).cast("int")).over(later)
    overtaken = timeline.select("session_id", "id", (F.coalesce(boundary > F.col("ts_ms"), F.lit(False)) | (F.coalesce(cleared, F.lit(0)) == 1)).alias("__overtaken"))
    newest = checkpoints.groupBy("session_id").agg(F.max("created_ms").alias("__newest"))
    made = checkpoints.select("session_id", F.col("watermark").alias("id")).distinct()
    open_ones = requests.join(made, ["session_id", "id"], "left_anti").join(newest, "session_id", "left").where("__newest is null or __newest < ts_ms")
    return open_ones.join(overtaken, ["session_id", "id"], "left").where(~F.coalesce("__overtaken", F.lit(False))).drop("__newest", "__overtaken")


def freeze(records: DataFrame, live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(checkpoints, continuations) of new records (session_id, checkpoint_id, created_ms, text): rows to append and states to write.

    A record is stored with its digest and never made again. It waits for delivery, and ends the live continuation of its session (live:
    session_id, checkpoint_id), which is SUPERSEDED; of several records of a session only the newest waits.
    """
    frozen = records.withColumns({"digest": F.sha2(F.coalesce("text", F.lit("")), 256), "bytes": F.coalesce(F.octet_length("text"), F.lit(0))})
    newest = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("created_ms"), F.desc("checkpoint_id")))
    new = records.select("session_id", "checkpoint_id", F.when(newest == 1, "PENDING").otherwise("SUPERSEDED").alias("state"))
    ended = live.join(records.select("session_id").distinct(), "session_id", "left_semi").select("session_id", "checkpoint_id", F.lit("SUPERSEDED").alias("state"))
    return frozen, new.unionByName(ended)


def delivery_key(hook_event: Column, session_id: Column, discriminator: Column) -> Column:
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.substring(F.sha2(F.concat_ws("|", text(hook_event), text(session_id), text(discriminator)), 256), 1, 32)


def undelivered(deliveries: DataFrame, injections: DataFrame) -> DataFrame:
    """The deliveries (delivery_key, id, ...) to emit now: the first of each key that the injections do not hold. The caller emits, then appends them."""
    first = F.row_number().over(Window.partitionBy("delivery_key").orderBy("id"))
    return deliveries.join(injections.select("delivery_key").distinct(), "delivery_key", "left_anti").withColumn("__r", first).where("__r = 1").drop("__r")


def deliver_batch(emit, injections_path: str):
    """A function for foreachBatch: emits what no earlier batch did, then records its keys. A batch that runs again after a loss in between is emitted again, never lost."""

    def run(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            known = spark.read.schema("delivery_key string").parquet(injections_path)
            known.limit(1).count()
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            known = spark.createDataFrame([], "delivery_key string")
        due = undelivered(batch, known).persist()
        emit(due)
        due.select("delivery_key").write.mode("append").parquet(injections_path)
        due.unpersist()

    return run


def has_state(epochs: DataFrame, intents: DataFrame, constraints: DataFrame, commands: DataFrame, edits: DataFrame) -> DataFrame:
    """epochs (session_id, epoch) with whether there is a root, a rule that stands, a command or an edit to restore."""
    keys = ["session_id", "epoch"]
    standing = [intents.where("level = 'ROOT' and superseded_ms is null"), constraints.where("superseded_ms is null"), commands, edits]
    some = standing[0].select(*keys)
    for other in standing[1:]:
        some = some.unionByName(other.select(*keys))
    return epochs.join(some.distinct().withColumn("has_state", F.lit(True)), keys, "left").withColumn("has_state", F.coalesce("has_state", F.lit(False)))


def in_workspace(sessions: DataFrame, project_id: str, session_id: str | None = None) -> DataFrame:
    """Sessions that the ledger holds for a workspace: a session of another one is none of its own, whoever asks."""
    own = sessions.where(F.col("project_id") == project_id)
    return own if session_id is None else own.where(F.col("session_id") == session_id)


def ordering_tail(events: DataFrame) -> DataFrame:
    """(session_id, last_direct_ts, max_spooled_ts_since): what decides whether the next event comes last in logical order."""
    direct = F.max(F.when(~F.col("spooled"), F.col("id"))).over(Window.partitionBy("session_id"))
    return events.withColumn("__d", direct).groupBy("session_id").agg(
        F.max(F.when(F.col("id") == F.col("__d"), F.col("ts_ms"))).alias("last_direct_ts"),
        F.max(F.when(F.col("spooled") & (F.col("__d").isNull() | (F.col("id") > F.col("__d"))), F.col("ts_ms"))).alias("max_spooled_ts_since"),
    )


def comes_last(tail: DataFrame, spooled: Column, ts_ms: Column) -> Column:
    """Whether an event after a tail is last in logical order."""
    fits = lambda c: F.coalesce(tail[c] <= ts_ms, F.lit(True))
    return ~spooled | (fits("last_direct_ts") & fits("max_spooled_ts_since"))


def selectors(test_id: Column) -> Column:
    """All that may name a test on a command line: nothing, its directories, its file, its node ids from outside in."""
    upto = lambda mark, parts: F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat_ws(mark, F.slice(parts, F.lit(1), i)))
    file = F.substring_index(test_id, "::", 1)
    return F.array_distinct(F.concat(F.array(F.lit("")), upto("/", F.split(file, "/")), upto("::", F.split(test_id, "::"))))


def asked(names: Column) -> Column:
    """What a run asks for, as structs (name, close). Not close: names that lie in no other one, or nothing for the whole suite. Close: names that are
    no node of another one. A test meets at most one name of either list, by way of its directories and file, and by its file or node."""
    inside = lambda a, b, *marks: F.exists(F.array(*[F.concat(b, F.lit(m)) for m in marks]), lambda x: a.startswith(x))
    only = lambda xs, *marks: F.filter(xs, lambda a: ~F.exists(xs, lambda b: inside(a, b, *marks)))
    told = lambda xs, close: F.transform(xs, lambda n: F.struct(n.alias("name"), F.lit(close).alias("close")))
    known = F.coalesce(names, F.array().cast("array<string>"))
    some = F.when(F.size(known) > 0, F.array_distinct(known)).otherwise(F.array(F.lit("")))
    return let(some, lambda xs: F.concat(told(only(xs, "/", "::"), False), told(only(xs, "::"), True)))


def test_statuses(runs: DataFrame, k: int = 6) -> DataFrame:
    """The k tests of each (session, epoch) that the work is about, with their state.

    runs: session_id, epoch, event_id, ts_ms, runner, outcome, names (what the command names), failed (array of ids, for runs that failed).
    A run that names a test by its file or closer weighs two, one that covers it by a directory or the whole suite one; passes count from
    the first failure on. A test fails until a later run covers and passes it. Order: weight, failing first, latest failure, first seen.

    Passes and tests meet on equal selectors in one window, so the work grows with runs plus tests and not with their product.
    """
    keys = ["session_id", "epoch", "test_id"]
    at = F.struct("ts_ms", "event_id")
    file = F.substring_index("test_id", "::", 1)
    closely = lambda name: (name != "") & (F.char_length(name) >= F.char_length(file))
    hit = runs.where("outcome = 'FAIL'").select("session_id", "epoch", "event_id", "ts_ms", "runner", "names", F.posexplode("failed").alias("nth", "test_id"))
    names_it = F.exists("names", lambda n: closely(n) & ((F.col("test_id") == n) | (file == n) | F.col("test_id").startswith(F.concat(n, F.lit("::")))))
    tests = hit.groupBy(*keys).agg(
        F.sum(F.when(names_it, 2).otherwise(1)).alias("failures"), F.min(F.struct("ts_ms", "event_id", "nth")).alias("seen"), F.max(at).alias("last_fail"), F.max_by("runner", at).alias("runner")
    )
    marks = F.array(
        F.struct(F.lit(True).alias("first"), F.col("seen.ts_ms").alias("ts_ms"), F.col("seen.event_id").alias("event_id")),
        F.struct(F.lit(False).alias("first"), F.col("last_fail.ts_ms").alias("ts_ms"), F.col("last_fail.event_id").alias("event_id")),
    )
    each = tests.select(*keys, "runner", F.explode(marks).alias("mark")).select(*keys, "runner", "mark.*", F.explode(selectors(F.col("test_id"))).alias("name"))
    each = each.select("*", F.explode(F.when(closely(F.col("name")), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("close"))
    passes = runs.where("outcome = 'PASS'").select("session_id", "epoch", F.lit(None).cast("string").alias("test_id"), "runner", F.lit(None).cast("boolean").alias("first"), "ts_ms", "event_id", F.inline(asked(F.col("names"))))
    later = Window.partitionBy("session_id", "epoch", "runner", "name", "close").orderBy(F.desc("ts_ms"), F.desc("event_id")).rowsBetween(Window.unboundedPreceding, -1)
    passed = F.when(F.col("test_id").isNull(), at)
    both = each.unionByName(passes).withColumns({"n": F.count(passed).over(later), "last": F.max(passed).over(later)}).where("test_id is not null")
    met = both.groupBy(*keys).agg(
        F.sum(F.when(F.col("first"), F.col("n")).otherwise(0)).alias("passes"), F.max(F.when(~F.col("first"), F.col("last")))["event_id"].alias("passed_by")
    )
    full = tests.join(met, keys).withColumns({"focus": F.col("failures") + F.col("passes"), "failing": F.col("passed_by").isNull(), "last_fail_id": F.col("last_fail.event_id"), "last_fail_ms": F.col("last_fail.ts_ms")})
    order = [F.desc("focus"), F.desc("failing"), F.desc("last_fail_ms"), F.asc("seen"), F.asc("test_id")]
    return top(full, ["session_id", "epoch"], order, k).select(*keys, "rank", "focus", "failing", "last_fail_id", "last_fail_ms", "passed_by")
