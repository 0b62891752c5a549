"""The record of a session's last epoch: what every section says, as lines for the budget ladder; and what a restore stages of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import commands as cmd
from ..functions.prompts import REJECTIONS
from ..functions.quotes import quote_rejection, through_code_sentence
from ..functions.redact import redact
from ..functions.text import is_incidental, is_outside, let, rfc3339, token_estimate, truncate_chars
from ..sources.tables import written
from . import checkpoints as ck
from . import edits as life
from . import folds, ladder, lookups, ranking

KEYS = ["session_id", "epoch"]
LENGTHS = {s: {c for _, t, _, _, c, _ in ladder.limits() if t == s} for s in ("REJECTED_APPROACHES", "EARLIER")}


def test_runs(timeline: DataFrame, runs: DataFrame) -> DataFrame:
    """Test commands with runner, the names that they ask for, and the tests that their output says failed."""
    output = timeline.select("session_id", F.col("id").alias("event_id"), F.concat_ws("\n", F.col("error"), F.col("stdout_tail"), F.col("stderr_tail")).alias("output"))
    words = F.split(F.trim("command_text"), r"\s+")
    names = F.transform(F.filter(cmd.path_tokens(F.col("command_text")), lambda p: p["path"].contains("/")), lambda p: p["path"])
    both = runs.where("kind = 'test'").join(output, ["session_id", "event_id"])
    return both.withColumns({"runner": words[0], "names": names, "failed": F.when(F.col("outcome") == "FAIL", cmd.failing_tests(F.col("output"))).otherwise(F.array().cast("array<string>"))}).drop("output")


def located(path: Column) -> Column:
    """A path, with a word on what it is if it is no file of the workspace."""
    return F.concat(path, F.when(is_outside(path), " (outside workspace)").when(is_incidental(path), " (dependency or build output)").otherwise(""))


def lines(timeline: DataFrame) -> DataFrame:
    """Lines (ladder.LINE) of every session's last epoch, in fifteen sections; text is redacted. timeline: written, or cheap to read several times."""
    last = timeline.groupBy("session_id").agg(F.max("epoch").alias("epoch"))
    of_last = lambda df: df.join(last, KEYS, "left_semi")
    now = written(of_last(timeline))
    runs = written(folds.commands(now))
    open_ones = lookups.open_failures(runs)
    intents = written(folds.intents(now))
    said = ranking.objective(intents)
    # edits with their fates, from the whole session: an earlier epoch's content may be what a file returns to
    seen = life.observations(timeline)
    both = written(life.folded(seen))
    fates = both.where("event_id is not null").select("session_id", "event_id", "status")
    edits = written(folds.edits(now).join(fates, ["session_id", "event_id"]))
    at = now.select("session_id", F.col("id"), "epoch")
    dead = both.where("id is not null and not reapplied").select("session_id", "path", "id", "edit_ids", "mechanism", "from_ms", "resolved_ms").join(at, ["session_id", "id"])
    slots = written(ranking.dead_end_slots(dead).withColumn("group", F.concat_ws("|", "path", F.col("id").cast("string"))))
    stats = folds.file_stats(now, runs)
    target = ranking.next_target(open_ones, edits)
    attempts = written(ranking.attempts(edits, dead))
    newest = ranking.top(open_ones, KEYS, [F.desc("ts_ms"), F.desc("event_id")], 1).drop("rank")
    pinned = dead.select(*KEYS, "path").unionByName(attempts.select(*KEYS, "path")).unionByName(newest.select(*KEYS, F.explode("mentioned.path").alias("path")))
    above = slots.select(*KEYS, "path").unionByName(attempts.select(*KEYS, "path")).distinct().withColumn("above", F.lit(True))
    files = ranking.working_files(stats, 8, pinned).join(above, [*KEYS, "path"], "left")
    rules = written(folds.constraints(now).withColumn("ordinal", F.struct("position", "n")))
    stated = rules.where("kind <> 'rejection'")
    picked = ranking.picked_rules(stated)
    rejected = ranking.top(rules.where("kind = 'rejection'"), KEYS, [F.desc("ordinal")], 4)
    more = stated.groupBy(*KEYS).agg(F.count("*").alias("all")).join(picked.groupBy(*KEYS).agg(F.count("*").alias("shown")), KEYS).where(F.col("all") > F.col("shown"))
    tests = ck.test_statuses(test_runs(now, runs))

    # dead ends: what was replaced and tried, and what ran between the first edit and the return
    excerpts = folds.edits(timeline).select("session_id", "event_id", "excerpt")
    member = slots.select("session_id", "group", F.posexplode("edit_ids").alias("n", "event_id")).join(excerpts, ["session_id", "event_id"])
    side = lambda mark: F.nullif(F.regexp_extract("excerpt", rf"(?m)^{mark} (.*)$", 1), F.lit(""))
    shown = life.evidence(member.select("session_id", F.col("group").alias("id"), "n", "event_id", side("-").alias("removed"), side(r"\+").alias("added")))
    spans = slots.select("session_id", F.col("group").alias("span_id"), "from_ms", F.col("resolved_ms").alias("to_ms"))
    ran = lookups.observed_between(spans, runs).where("observed_after is not null").join(runs.select("session_id", F.col("event_id").alias("observed_after"), "command_text", "outcome"), ["session_id", "observed_after"])

    def some(df: DataFrame, section: str, text: Column, n: Column | int = 1, part: str = "") -> DataFrame:
        n = F.lit(n) if isinstance(n, int) else n
        return df.select("session_id", F.lit(section).alias("section"), F.lit(part).alias("part"), n.cast("long").alias("n"), let(text, redact).alias("text"))

    rank = F.col("rank")
    place = slots.select("session_id", F.col("group").alias("id"), "rank")
    proof = shown.join(place, ["session_id", "id"])
    out = [
        some(said, "FIRST_MESSAGE", F.col("objective")), some(said, "LATEST", F.col("latest")), some(said, "SUBTASK", F.col("subtask")), some(ranking.earlier_code_message(intents), "EARLIER", F.col("text")),
        some(picked, "STATED_CONSTRAINTS", F.col("text"), rank), some(more, "STATED_CONSTRAINTS", F.concat((F.col("all") - F.col("shown")).cast("string"), F.lit(" more not listed")), 1, "omitted"),
        some(rejected, "REJECTED_APPROACHES", F.col("text"), rank),
        some(tests, "TEST_STATUS", F.concat_ws(" ", "test_id", F.when(F.col("failing"), "FAILING").otherwise("PASSED")), rank), some(tests, "TEST_STATUS", F.concat(F.lit("named in "), F.col("focus").cast("string"), F.lit(" runs")), rank, "detail"),
        some(newest, "TEST_RESULT", F.concat_ws(" ", "command_text", "outcome"), 1, "command"),
        some(newest.select(*KEYS, F.posexplode(F.split("excerpt", "\n")).alias("n", "line")), "TEST_RESULT", F.col("line"), F.col("n") + 1),
        some(slots, "REVERTED_EDITS", F.concat_ws(" ", located(F.col("path")), F.col("mechanism")), rank), some(proof, "REVERTED_EDITS", F.concat(F.lit("replaced "), F.col("removed")), rank, "replaced"),
        some(proof, "REVERTED_EDITS", F.concat(F.lit("tried "), F.col("added")), rank, "attempted"),
        some(ran.join(place.withColumnRenamed("id", "span_id"), ["session_id", "span_id"]), "REVERTED_EDITS", F.concat(F.lit("seen then: "), F.concat_ws(" ", "command_text", "outcome")), rank, "observed"),
        some(attempts, "RECENT_EDITS", located(F.col("path")), rank),
        some(files.where("above is null"), "FILE_ACTIVITY", activity(), rank), some(files.where("above"), "FILE_ACTIVITY", activity(), rank, "named"),
        some(target.where("rule = 'failure-location'"), "FAILURE_LOCATION", F.col("target")), some(target.where("rule <> 'failure-location'"), "NEXT_TARGET", F.col("target")),
        some(now.groupBy(*KEYS).agg(F.max("project_id").alias("p"), F.count("*").alias("n"), F.max("logical_ms").alias("ms")), "WORKSPACE_STATE", F.concat_ws(" ", F.lit("workspace"), "p", F.lit("until"), rfc3339(F.col("ms")))),
        some(now.groupBy(*KEYS).agg(F.count("*").alias("n"), F.max("id").alias("id")), "RECORD_DETAIL", F.concat_ws(" ", F.lit("epoch"), F.col("epoch").cast("string"), F.lit("of"), F.col("n").cast("string"), F.lit("events to"), F.col("id").cast("string"))),
    ]
    every = out[0]
    for other in out[1:]:
        every = every.unionByName(other)
    return every.where("text is not null and trim(text) <> ''")


def activity() -> Column:
    return F.concat_ws(" ", located(F.col("path")), F.format_string("(%d edits, %d reads)", "edits", "reads"), F.when(F.col("in_failure"), "in failure output"))


def shortened(section: Column, text: Column, cap: int) -> Column:
    """A line in at most cap characters: a rejection keeps the approach and the clause that rejects it, an earlier message its sentence that names code.

    Only at lengths that some rung gives such a section; at others nothing stands.
    """
    out = F.when(F.char_length(text) <= cap, text)
    if cap in LENGTHS["REJECTED_APPROACHES"]:
        low = F.lower(text)
        cue = F.coalesce(*[F.when(low.contains(c), F.lit(c)) for c in REJECTIONS])
        out = out.when((section == "REJECTED_APPROACHES") & cue.isNotNull(), quote_rejection(text, cue, cap))
    if cap in LENGTHS["EARLIER"]:
        out = out.when(section == "EARLIER", truncate_chars(through_code_sentence(text), cap))
    return out.otherwise(truncate_chars(text, cap))


def records(timeline: DataFrame, budget: int = ladder.DEFAULT_BUDGET) -> DataFrame:
    return ladder.render(written(lines(timeline)), budget, shortened)


def restored(requests: DataFrame, sessions: DataFrame, texts: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """What each request (request_id, workspace_id, session_id, now_ms) stages: outcome, and for STAGED ones the record once more redacted, its tokens, hash and source.

    UNKNOWN_SESSION: none of that id in the workspace, whoever asks. NO_STATE: nothing to carry over. sessions: session_id, project_id, has_state;
    texts: session_id, capsule, tokens; checkpoints: session_id, checkpoint_id, created_ms, of which the newest is named.
    """
    newest = checkpoints.groupBy("session_id").agg(F.max_by("checkpoint_id", F.struct("created_ms", "checkpoint_id")).alias("source_checkpoint_id"))
    own = sessions.select("session_id", F.col("project_id").alias("workspace_id"), "has_state").withColumn("known", F.lit(True))
    both = requests.join(own, ["session_id", "workspace_id"], "left").join(texts.select("session_id", "capsule", "tokens"), "session_id", "left").join(newest, "session_id", "left")
    outcome = F.when(F.col("known").isNull(), "UNKNOWN_SESSION").when(~F.coalesce("has_state", F.lit(False)) | F.col("capsule").isNull(), "NO_STATE").otherwise("STAGED")
    told = both.withColumns({"outcome": outcome, "clean": let(F.col("capsule"), redact)})
    staged = F.col("outcome") == "STAGED"
    return told.select(
        "request_id", "session_id", "workspace_id", "outcome", F.when(staged, F.col("clean")).alias("capsule"), F.when(staged, F.least(token_estimate(F.col("clean")), F.col("tokens"))).alias("tokens"),
        F.when(staged, F.substring(F.sha2("clean", 256), 1, 32)).alias("content_hash"), F.when(staged, F.array(F.lit("startup"))).alias("deliver_on"),
        F.when(staged, F.col("source_checkpoint_id")).alias("source_checkpoint_id"), F.when(staged, F.col("now_ms")).alias("created_ms"),
    )
