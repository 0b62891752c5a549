"""Queries over the driver's tables by name, and DuckDB SQL for each that SQL can express.

Each runs the library's own operators, over whole tables, through the adapter where they need a ledger.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import commands as cmd
from ..functions import ingest, quotes
from ..functions import text as tx
from ..functions.authored import authored
from ..functions.git import reached, restore_targets
from ..functions.redact import redact
from ..operators import analytics as an
from ..operators import checkpoints as ck
from ..operators import delivery, folds, ladder, lineage, lookups, order, ranking, record, views
from ..operators import edits as life
from ..sources import ledger
from ..sources.tables import written
from .adapter import CMDS, EDITS, LED, TL, events, flat, told, told_once

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
FLAGSHIP = "working_files_top8"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def docs(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- the ledger


@query(f"with {LED} select id, session_id, hook_event from led")
def ledger_dedupe(spark, sf_dir):
    """Every third event delivered twice, a few ms apart where a tool call names it; one row of each stays."""
    once = events(spark, sf_dir)
    again = once.where("id % 3 = 0").withColumns({"id": F.col("id") + 1_000_000_000, "ts_ms": F.when(F.col("tool_use_id").isNotNull(), F.col("ts_ms") + 3).otherwise(F.col("ts_ms"))})
    key = ledger.dedupe_key(F.col("hook_event"), F.col("session_id"), F.col("tool_use_id"), F.lit(None), F.col("ts_ms"), F.lit(None))
    return ledger.first_of_each(once.unionByName(again).withColumn("dedupe_key", key)).select("id", "session_id", "hook_event")


@query(f"with {LED} select id, session_id from led where id % 5 <> 0")
def ledger_append(spark, sf_dir):
    """What a ledger that holds every fifth event still lacks."""
    rows = events(spark, sf_dir)
    return ledger.append(rows.where("id % 5 = 0"), rows).select("id", "session_id")


@query(f"with {TL} select id, session_id, anchor, position from tl")
def logical_order(spark, sf_dir):
    return order.logical_order(flat(spark, sf_dir)).select("id", "session_id", "anchor", F.col("position").cast("long").alias("position"))


@query(f"with {TL} select id, logical_ms, epoch from tl")
def logical_time_epoch(spark, sf_dir):
    return told(spark, sf_dir).select("id", "logical_ms", "epoch")


@query(f"with {TL} select id, prompt_ordinal from tl where prompt is not null")
def prompt_ordinal(spark, sf_dir):
    return told(spark, sf_dir).where(order.is_turn()).select("id", "prompt_ordinal")


INTENTS = (
    TL + ", said as (select session_id, epoch, position, id, logical_ms as created_ms, case when prompt like '/%' then null when prompt like 'task:%' then 'TASK' when prompt like 'subtask:%' then 'SUBTASK' else 'PLAIN' end as kind,"
    " case when prompt like 'task:%' then trim(substr(prompt, 6)) when prompt like 'subtask:%' then trim(substr(prompt, 9)) else prompt end as text from tl where prompt is not null)"
    ", firsts as (select *, min(case when kind = 'TASK' or (kind = 'PLAIN' and length(text) >= 20) then position end) over (partition by session_id, epoch) as f from said where kind is not null)"
    ", lev as (select *, case when position = f then 'ROOT' when kind = 'SUBTASK' then 'SUBTASK' else 'LATEST' end as level from firsts)"
    ", ints as (select session_id, epoch, position, level, text, id as source_event_id, created_ms, case when level <> 'ROOT' then lead(created_ms) over w end as superseded_ms, case when level <> 'ROOT' then lead(id) over w end as superseded_by"
    " from lev window w as (partition by session_id, epoch, level order by position))"
)


@query(f"with {INTENTS} select session_id, epoch, level, text, source_event_id, created_ms, superseded_ms, superseded_by from ints")
def intents(spark, sf_dir):
    return folds.intents(told(spark, sf_dir)).drop("position")


@query(
    f"with {INTENTS} select session_id, epoch, coalesce(min_by(text, case when level = 'ROOT' then position end), min_by(text, case when length(text) >= 20 then position end)) as objective,"
    " max_by(text, case when level = 'LATEST' then position end) as latest, max_by(text, case when level = 'SUBTASK' and superseded_ms is null then position end) as subtask from ints group by 1, 2"
)
def objectives(spark, sf_dir):
    return ranking.objective(folds.intents(told(spark, sf_dir)))


@query(
    f"with {TL} select session_id, min_by(project_id, position) as project_id, min(ts_ms) as started_ms, max(logical_ms) as last_event_ms, max(epoch) as epoch, count(*) as events from tl group by 1"
)
def session_rollup(spark, sf_dir):
    return folds.sessions(told(spark, sf_dir)).select("session_id", "project_id", "started_ms", "last_event_ms", "epoch", "events")


@query(f"with {LED} select count(*) as events, count(distinct session_id) as sessions, cast(sum(case when id > 500 then 1 else 0 end) as bigint) as backlog, max(ts_ms) as last_ms from led")
def backlog_counts(spark, sf_dir):
    return lookups.backlog(events(spark, sf_dir), 500)


@query(f"with {EDITS}, g as (select session_id, path, max(event_id) as last_id from eds group by 1, 2) select session_id, path, last_id from g qualify row_number() over (partition by session_id order by last_id desc) <= 5")
def recent_edit_paths(spark, sf_dir):
    return folds.recent_edit_paths(told(spark, sf_dir), 5).select("session_id", "path", "last_id")


STATS = (
    CMDS + ", touch as (select session_id, epoch, path, case when tool_name = 'Read' then 1 else 0 end as reads, case when tool_name = 'Read' then 0 else 1 end as edits, false as in_failure, logical_ms as ts from tl where path is not null"
    " union all select session_id, epoch, m_path, 0, 0, true, ts_ms from cmds where outcome = 'FAIL' and kind <> 'other')"
    ", stats as (select session_id, epoch, path, cast(sum(reads) as bigint) as reads, cast(sum(edits) as bigint) as edits, bool_or(in_failure) as in_failure, max(ts) as last_touch_ms, min(ts) as first_touch_ms from touch group by 1, 2, 3)"
)


def stats_of(spark, sf_dir) -> DataFrame:
    timeline = told_once(spark, sf_dir)
    return folds.file_stats(timeline, folds.commands(timeline))


@query(f"with {STATS} select * from stats")
def file_stats(spark, sf_dir):
    return stats_of(spark, sf_dir)


@query(
    f"with {STATS} select session_id, epoch, path, cast(row_number() over (partition by session_id, epoch order by path like '../%', path like 'node_modules/%', case when exists (select 1 from tl d where d.session_id = stats.session_id and d.epoch = stats.epoch and d.path = stats.path and d.post_hash is not null and d.id % 29 = 0) then 6 else 0 end"
    " + 4 * cast(in_failure as integer) + 3 * least(edits, 3) + case when reads >= 2 then 2 else 0 end + least(reads, 3) desc, edits desc, reads desc, first_touch_ms, path) as integer) as rank from stats qualify rank <= 8"
)
def working_files_top8(spark, sf_dir):
    """Paths of every 29th edit stand for those that dead ends name."""
    timeline = told_once(spark, sf_dir)
    named = folds.edits(timeline).where("event_id % 29 = 0")
    return ranking.working_files(folds.file_stats(timeline, folds.commands(timeline)), 8, named).select("session_id", "epoch", "path", "rank")


@query(f"with {CMDS} select session_id, epoch, event_id, kind, signature, command_text, outcome, ts_ms from cmds")
def commands(spark, sf_dir):
    return folds.commands(told(spark, sf_dir)).select("session_id", "epoch", "event_id", "kind", "signature", "command_text", "outcome", "ts_ms")


@query(
    f"with {CMDS} select c.event_id, c.signature from cmds c where kind in ('test', 'build', 'lint') and outcome = 'FAIL' and not exists (select 1 from cmds d where d.session_id = c.session_id and d.epoch = c.epoch and d.signature = c.signature and d.outcome = 'PASS' and (d.ts_ms > c.ts_ms or (d.ts_ms = c.ts_ms and d.event_id > c.event_id)))"
)
def open_failures(spark, sf_dir):
    return lookups.open_failures(folds.commands(told(spark, sf_dir))).select("event_id", "signature")


@query(
    f"with {CMDS} select c.event_id, (select min_by(d.event_id, (d.ts_ms, d.event_id)) from cmds d where d.session_id = c.session_id and d.epoch = c.epoch and d.signature = c.signature and d.outcome = 'PASS' and (d.ts_ms > c.ts_ms or (d.ts_ms = c.ts_ms and d.event_id > c.event_id))) as resolved_by from cmds c where outcome = 'FAIL'"
)
def resolved_by(spark, sf_dir):
    return lookups.resolved_by(folds.commands(told(spark, sf_dir))).select("event_id", "resolved_by")


def live(spark, sf_dir) -> DataFrame:
    return folds.edits(told(spark, sf_dir)).withColumn("status", F.lit("ACTIVE"))


@query(f"with {EDITS} select session_id, epoch, path, max(event_id) as event_id from eds group by 1, 2, 3")
def latest_live_edit(spark, sf_dir):
    return lookups.latest_live_edit(live(spark, sf_dir)).select("session_id", "epoch", "path", "event_id")


@query(f"with {EDITS} select event_id, max(event_id) over (partition by session_id, epoch, path order by event_id rows between 1 following and unbounded following) as superseded_by from eds")
def later_edit(spark, sf_dir):
    return lookups.later_edit(live(spark, sf_dir)).select("event_id", "superseded_by")


CMDS_EDITS = CMDS + ", eds as (select session_id, epoch, position, id as event_id, path, post_hash, logical_ms as ts_ms from tl where post_hash is not null)"


@query(
    f"with {CMDS_EDITS} select e.event_id, (select min_by(c.event_id, (c.ts_ms, c.event_id)) from cmds c where c.session_id = e.session_id and c.epoch = e.epoch and c.kind in ('test', 'build') and c.ts_ms > e.ts_ms) as afterward from eds e"
)
def afterward_command(spark, sf_dir):
    timeline = told_once(spark, sf_dir)
    return lookups.afterward(folds.edits(timeline), folds.commands(timeline)).select("event_id", "afterward")


@query(
    f"with {CMDS_EDITS}, sp as (select session_id, event_id as span_id, ts_ms as from_ms, ts_ms + 7200000 as to_ms from eds) select span_id, (select min_by(c.event_id, (c.ts_ms, c.event_id)) from cmds c where c.session_id = s.session_id and c.kind in ('test', 'build') and c.ts_ms between s.from_ms and s.to_ms) as observed_after from sp s"
)
def observed_between(spark, sf_dir):
    timeline = told_once(spark, sf_dir)
    spans = folds.edits(timeline).select("session_id", F.col("event_id").alias("span_id"), F.col("ts_ms").alias("from_ms"), (F.col("ts_ms") + 7_200_000).alias("to_ms"))
    return lookups.observed_between(spans, folds.commands(timeline)).select("span_id", "observed_after")


@query(
    f"with {LED}, m as (select session_id, id as mark_id, ts_ms as at_ms from led where hook_event = 'SessionStart') select mark_id, (select min_by(e.id, (e.ts_ms, e.id)) from led e where e.session_id = m.session_id and e.ts_ms > m.at_ms and e.hook_event in ('PostToolUse', 'PostToolUseFailure', 'Stop')) as evidence from m"
)
def confirmation_event(spark, sf_dir):
    rows = flat(spark, sf_dir)
    marks = rows.where("hook_event = 'SessionStart'").select("session_id", F.col("id").alias("mark_id"), F.col("ts_ms").alias("at_ms"))
    return lookups.first_evidence(marks, rows).select("mark_id", "evidence")


@query(
    f"with {LED}, pre as (select session_id, concat('t', cast(id + 2 as varchar)) as tool_use_id, min(id) as pre_id from led where hook_event = 'SessionStart' group by 1, 2)"
    " select l.id, p.pre_id from led l left join pre p using (session_id, tool_use_id) where l.hook_event in ('PostToolUse', 'PostToolUseFailure')"
)
def pre_post_pairing(spark, sf_dir):
    rows = flat(spark, sf_dir)
    pre = rows.where("hook_event = 'SessionStart'").withColumns({"hook_event": F.lit("PreToolUse"), "tool_use_id": F.concat(F.lit("t"), (F.col("id") + 2).cast("string"))})
    return lookups.started_in(rows.unionByName(pre)).select("id", "pre_id")


CKPT = TL + ", ck as (select session_id, id as checkpoint_id, logical_ms as created_ms from tl where hook_event = 'PreCompact')"


def checkpoints(timeline: DataFrame) -> DataFrame:
    return timeline.where("hook_event = 'PreCompact'").select("session_id", F.col("id").alias("checkpoint_id"), F.col("logical_ms").alias("created_ms"))


@query(f"with {CKPT}, s as (select distinct session_id from tl) select session_id, count(checkpoint_id) as checkpoints, max_by(checkpoint_id, (created_ms, checkpoint_id)) as last_checkpoint from s left join ck using (session_id) group by 1")
def session_list(spark, sf_dir):
    timeline = told_once(spark, sf_dir)
    return lookups.session_list(folds.sessions(timeline), checkpoints(timeline)).select("session_id", "checkpoints", "last_checkpoint")


@query(
    f"with {TL}, s as (select session_id, max(logical_ms) as last_event_ms from tl group by 1), t as (select concat('s', cast(conv_id as varchar)) as session_id, min_by(text, turn) as title, 1700000000000 + conv_id * 1000 as modified_ms from conversations group by conv_id)"
    " select coalesce(s.session_id, t.session_id) as session_id, title, coalesce(greatest(last_event_ms, modified_ms), 0) as last_ms, case when s.session_id is null then 'transcript' when t.session_id is null then 'ledger' else 'both' end as known_to from s full join t on s.session_id = t.session_id order by last_ms desc, 1 limit 20"
)
def restore_picker(spark, sf_dir):
    """A report of the twenty sessions of latest activity."""
    files = docs(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("title"))
    files = files.select(F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("session_id"), "title", (F.lit(1_700_000_000_000) + F.col("conv_id") * 1000).alias("modified_ms"))
    return lookups.restore_picker(folds.sessions(told(spark, sf_dir)), files, 20)


@query(f"with {LED} select distinct session_id from led where substr(session_id, 1, 3) = 's12' order by 1 limit 3")
def session_prefix(spark, sf_dir):
    rows = events(spark, sf_dir)
    return lookups.resolve_prefix(rows.select("session_id"), rows, "s12")


@query(f"with {CKPT}, co as (select *, case when checkpoint_id % 3 = 0 then 'PENDING' when checkpoint_id % 3 = 1 then 'ATTACHED' else 'CONFIRMED' end as state from ck) select session_id, checkpoint_id, state, created_ms from co where state in ('PENDING', 'ATTACHED')")
def live_continuation(spark, sf_dir):
    ck = checkpoints(told(spark, sf_dir))
    state = F.when(F.col("checkpoint_id") % 3 == 0, "PENDING").when(F.col("checkpoint_id") % 3 == 1, "ATTACHED").otherwise("CONFIRMED")
    return lookups.live_continuations(ck.select("session_id", "checkpoint_id", state.alias("state")), ck).select("session_id", "checkpoint_id", "state", "created_ms")


@query(
    f"with {EDITS}, n as (select *, row_number() over (partition by session_id, epoch, path order by ts_ms desc, event_id desc) as n from eds), p as (select * from n qualify row_number() over (partition by session_id, epoch order by n > 1, ts_ms desc, event_id desc) <= 4)"
    " select session_id, epoch, path, event_id as id, cast(row_number() over (partition by session_id, epoch order by ts_ms desc, event_id desc) as integer) as rank from p"
)
def dead_end_slots(spark, sf_dir):
    dead = live(spark, sf_dir).select("session_id", "epoch", "path", F.col("event_id").alias("id"), F.col("ts_ms").alias("resolved_ms"))
    return ranking.dead_end_slots(dead).select("session_id", "epoch", "path", "id", "rank")


@query(
    f"with {EDITS}, a as (select *, row_number() over (partition by session_id, epoch, path order by event_id desc) as n from eds), dead as (select distinct session_id, epoch, path from eds where event_id % 29 = 0)"
    " select session_id, epoch, path, event_id, cast(row_number() over (partition by session_id, epoch order by path like '../%', path like 'node_modules/%', ts_ms desc, event_id desc) as integer) as rank"
    " from a anti join dead using (session_id, epoch, path) where n = 1 qualify rank <= 4"
)
def attempts_top4(spark, sf_dir):
    """Paths of every 29th edit stand for those that dead ends name."""
    edits = live(spark, sf_dir)
    return ranking.attempts(edits, edits.where("event_id % 29 = 0")).select("session_id", "epoch", "path", "event_id", "rank")


@query(
    f"with {CMDS}{EDITS[len(TL):]}, open as (select c.* from cmds c where kind in ('test', 'build', 'lint') and outcome = 'FAIL' and not exists (select 1 from cmds d where d.session_id = c.session_id and d.epoch = c.epoch and d.signature = c.signature and d.outcome = 'PASS' and (d.ts_ms > c.ts_ms or (d.ts_ms = c.ts_ms and d.event_id > c.event_id))))"
    ", f as (select * from open qualify row_number() over (partition by session_id, epoch order by ts_ms desc, event_id desc) = 1), e as (select * from eds qualify row_number() over (partition by session_id, epoch order by path like '../%', path like 'node_modules/%', ts_ms desc, event_id desc) = 1)"
    ", g as (select * from f where event_id % 2 = 0) select session_id, epoch, case when g.event_id is not null then 'failure-location' else 'last-active-edit' end as rule,"
    " coalesce(g.m_path || ':' || cast(g.event_id % 90 as varchar), e.path) as target, case when g.event_id is not null then concat('commands:', cast(g.event_id as varchar)) else concat('edits:', cast(e.event_id as varchar)) end as source from g full join e using (session_id, epoch)"
)
def next_target(spark, sf_dir):
    """Every other failure shows the place that it mentions."""
    timeline = told_once(spark, sf_dir)
    shown = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("at "), F.element_at("mentioned", 1)["raw"])).otherwise(F.lit("x"))
    failures = lookups.open_failures(folds.commands(timeline)).withColumn("excerpt", shown)
    return ranking.next_target(failures, folds.edits(timeline).withColumn("status", F.lit("ACTIVE")))


@query(f"with {EDITS} select session_id, epoch, path, count(*) as edits, max(event_id) as last_id from eds where ts_ms <= 1704100000000 + 86400000 * 10 group by 1, 2, 3")
def edits_as_of(spark, sf_dir):
    """A section as of a time: what the log held then."""
    then = folds.edits(told(spark, sf_dir)).where(F.col("ts_ms") <= 1704100000000 + 86400000 * 10)
    return then.groupBy("session_id", "epoch", "path").agg(F.count("*").alias("edits"), F.max("event_id").alias("last_id"))


@query(
    f"with {EDITS}, d as (select *, lag(event_id) over (partition by session_id, path order by event_id) as before from eds), k as (select session_id, event_id as id, unnest([before, event_id]) as m from d where event_id % 5 = 0 and before is not null)"
    " select session_id, k.id, count(*) as members, string_agg(e.tool_name, ',' order by e.event_id) as tools from k join eds e using (session_id) where e.event_id = k.m group by 1, 2"
)
def dead_end_members(spark, sf_dir):
    """Every fifth edit and the one before it on the same file as a dead end whose members are looked up by id."""
    edits = folds.edits(told(spark, sf_dir)).withColumn("excerpt", F.col("tool_name"))
    before = F.lag("event_id").over(Window.partitionBy("session_id", "path").orderBy("event_id"))
    dead = edits.withColumn("before", before).where("event_id % 5 = 0 and before is not null").select("session_id", F.col("event_id").alias("id"), F.array("before", "event_id").alias("edit_ids"))
    return life.members(dead, edits).select("session_id", "id", "members", F.array_join("excerpts", ",").alias("tools"))


@query(
    "select doc_id, left(text, list_max(list_filter(range(0, 42), lambda k: strlen(left(text, k)) <= 41))) as head, right(text, list_max(list_filter(range(0, 42), lambda k: strlen(right(text, k)) <= 41))) as tail,"
    " case when length(text) <= 60 then text else concat(regexp_replace(left(text, 22), '\\s+$', ''), ' ... ', regexp_replace(case when regexp_matches(substr(text, length(text) - 33, 1), '\\S') and regexp_matches(left(right(text, 33), 1), '\\S') and regexp_matches(left(right(text, 33), 20), '\\s') then regexp_replace(right(text, 33), '^\\S+', '') else right(text, 33) end, '^\\s+', '')) end as middle from documents"
)
def byte_cuts(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", tx.prefix_bytes(F.col("text"), 41).alias("head"), tx.suffix_bytes(F.col("text"), 41).alias("tail"), tx.truncate_middle(F.col("text"), 60).alias("middle"))


@query(
    "with r as (select concat('c', cast(conv_id as varchar)) as session_id, 1 as epoch, turn as ordinal, text, case turn % 3 when 0 then 'requirement' when 1 then 'labelled' else 'prohibition' end as kind from conversations)"
    ", o as (select * from r qualify row_number() over (partition by session_id, lower(regexp_replace(trim(text), '\\s+', ' ', 'g')) order by ordinal) = 1)"
    " select session_id, ordinal, cast(row_number() over (partition by session_id order by case kind when 'labelled' then 0 when 'prohibition' then 1 else 2 end, ordinal) as integer) as rank from o qualify rank <= 3"
)
def rule_pick(spark, sf_dir):
    said = docs(spark, sf_dir, "conversations")
    kind = F.when(F.col("turn") % 3 == 0, "requirement").when(F.col("turn") % 3 == 1, "labelled").otherwise("prohibition")
    rules = said.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("session_id"), F.lit(1).alias("epoch"), F.col("turn").alias("ordinal"), "text", kind.alias("kind"))
    return ranking.picked_rules(rules).select("session_id", "ordinal", "rank")


@query(
    f"with {CMDS}, f as (select * from cmds where kind = 'test' and outcome = 'FAIL'), p as (select * from cmds where kind = 'test' and outcome = 'PASS')"
    " select f.event_id as fail_id, min_by(p.event_id, (p.ts_ms, p.event_id)) as covered_by from f left join p on f.session_id = p.session_id and f.epoch = p.epoch and (p.ts_ms > f.ts_ms or (p.ts_ms = f.ts_ms and p.event_id > f.event_id))"
    " and (p.signature = f.signature or starts_with(concat(substr(f.signature, 13), '::test_a'), substr(p.signature, 13))) group by 1"
)
def test_status(spark, sf_dir):
    runs = folds.commands(told(spark, sf_dir))
    ids = F.when(F.col("kind") == "test", F.concat(F.substring("signature", 13, 1000), F.lit("::test_a")))
    return lookups.test_coverage(runs.withColumn("test_id", ids)).select("fail_id", "covered_by")


# --- edit lifecycle and delivery: folds, held against plain restatements in the tests


@query()
def edit_lifecycle(spark, sf_dir):
    return life.lifecycle(life.observations(with_git(told(spark, sf_dir))))[0]


@query()
def dead_ends(spark, sf_dir):
    timeline = with_git(told_once(spark, sf_dir))
    dead = life.lifecycle(life.observations(timeline))[1]
    spans = dead.select("session_id", F.concat_ws("|", "path", F.col("id").cast("string")).alias("span_id"), "from_ms", F.col("resolved_ms").alias("to_ms"))
    seen = lookups.observed_between(spans, folds.commands(timeline)).select("session_id", "span_id", "observed_after")
    return dead.withColumn("span_id", F.concat_ws("|", "path", F.col("id").cast("string"))).join(seen, ["session_id", "span_id"], "left").drop("span_id")


def with_git(timeline: DataFrame) -> DataFrame:
    """Every eleventh command restores a file, a folder, another file or the tree, every thirteenth commits; then a file has its first content."""
    path = F.concat(F.lit("src/f"), (F.col("id") * 7 % 23).cast("string"), F.lit(".py"))
    files = F.array(F.struct(path.alias("path"), F.md5(F.concat(F.lit("f"), (F.col("id") * 7 % 23).cast("string"), F.lit("-0"))).alias("hash"), F.lit(1).cast("bigint").alias("size")))
    git = F.struct(F.when(F.col("id") % 11 == 0, "checkout").alias("restore"), (F.col("id") % 13 == 0).alias("commit"), files.alias("files"))
    restore = F.element_at(F.array(F.concat(F.lit("git checkout -- "), path), F.lit("git stash"), F.lit("git restore docs"), F.lit("cd src && git restore 'f1*.py'")), (F.col("id") % 4 + 1).cast("int"))
    command = F.concat_ws(" && ", F.when(F.col("id") % 13 == 0, "git commit -am part"), F.when(F.col("id") % 11 == 0, restore))
    called = F.col("command").isNotNull() & ((F.col("id") % 11 == 0) | (F.col("id") % 13 == 0))
    return timeline.withColumn("git", F.when(called, git)).withColumn("command", F.when(F.col("git").isNotNull(), command).otherwise(F.col("command")))


DELIVERY = f"""with recursive {LED}, ops as (
    select session_id, id, ts_ms, spooled as late, case when hook_event = 'PreCompact' then 'checkpoint' when source = 'clear' then 'expire' when source = 'compact' then 'session_start'
        when hook_event = 'UserPromptSubmit' then 'user_prompt' when hook_event = 'PostToolUse' then 'post_tool' when hook_event = 'PostToolUseFailure' then 'failure' end as op from led),
    steps as materialized (select *, row_number() over (partition by session_id order by id) as n from ops where op is not null),
    f as (
        select distinct session_id, 0::bigint as n, null::bigint as c, null::varchar as st, 0 as k, null::bigint as am, null::varchar as ch, null::bigint as cr, null::bigint as up, null::bigint as sm, null::bigint as si, 0::bigint as newest, 0::bigint as cleared,
            null::bigint as e_c, null::varchar as e_st, 0 as e_k, null::bigint as e_am, null::varchar as e_ch, null::bigint as e_up, null::bigint as e_cm, null::bigint as e_ce from steps
        union all
        select session_id, n, case when fresh then id when ends is null then c end, case when fresh then 'PENDING' when attach then 'ATTACHED' when ends is null then st end, case when fresh then 0 when attach then k + 1 else k end,
            case when fresh or ends is not null then null when attach then ts_ms else am end, case when fresh or ends is not null then null when attach then op else ch end, case when fresh then ts_ms when ends is null then cr end, case when fresh or attach then ts_ms when ends is null then up end,
            case when not fresh and not attach and ends is null then xm end, case when not fresh and not attach and ends is null then xi end, case when fresh then greatest(newest, ts_ms) else newest end, case when op = 'expire' then greatest(cleared, ts_ms) else cleared end,
            case when ends is not null then c end, ends, k, am, ch, case when ends = 'CONFIRMED' then xm when ends = 'EXPIRED' and st = 'PENDING' and op <> 'expire' then cr + 604800001 when ends is not null then ts_ms end, case when ends = 'CONFIRMED' then xm end, case when ends = 'CONFIRMED' then xi end
        from (
            select *, coalesce(not late and ends is null and ((st = 'PENDING' and (op in ('session_start', 'user_prompt') or (op = 'post_tool' and ts_ms > cr))) or (st = 'ATTACHED' and op = 'user_prompt' and ch = 'user_prompt')), false) as attach
            from (
                select *, case when st is null then null when fresh then 'SUPERSEDED' when late or op = 'checkpoint' then null when op = 'expire' then 'EXPIRED' when st = 'PENDING' then case when ts_ms - cr > 604800000 then 'EXPIRED' end
                    when xm is not null then 'CONFIRMED' when op in ('session_start', 'user_prompt') and ts_ms - cr > 604800000 then 'EXPIRED' when op = 'user_prompt' and ch = 'user_prompt' and k >= 3 then 'EXPIRED' end as ends
                from (
                    select s.*, f.c, f.st, f.k, f.am, f.ch, f.cr, f.up, f.newest, f.cleared, s.op = 'checkpoint' and (not s.late or (s.ts_ms > f.newest and s.ts_ms > f.cleared)) as fresh,
                        case when f.st = 'ATTACHED' and s.op in ('post_tool', 'failure') and s.ts_ms > f.am and (f.sm is null or (s.ts_ms, s.id) < (f.sm, f.si)) then s.ts_ms else f.sm end as xm,
                        case when f.st = 'ATTACHED' and s.op in ('post_tool', 'failure') and s.ts_ms > f.am and (f.sm is null or (s.ts_ms, s.id) < (f.sm, f.si)) then s.id else f.si end as xi
                    from f join steps s on s.session_id = f.session_id and s.n = f.n + 1)))),
    last as (select * from f qualify row_number() over (partition by session_id order by n desc) = 1)
    select session_id, e_c as checkpoint_id, e_st as state, e_k as attach_count, e_am as attached_ms, e_ch as attached_channel, e_cm as confirmed_ms, e_ce as confirm_event_id, e_up as updated_ms from f where e_st is not null
    union all select session_id, c, st, k, am, ch, null, null, up from last where st is not null"""


@query(DELIVERY)
def delivery_states(spark, sf_dir):
    return delivery.continuations(delivery.steps_of(flat(spark, sf_dir)))


@query(
    "select doc_id, case when doc_id % 2 <> 0 then 'NOT_FOR_SOURCE' when doc_id % 10 = 0 then 'ALREADY_CLAIMED' when doc_id % 6 = 0 then 'DAMAGED' when source = 'src0' then 'OTHER_WORKSPACE' when doc_id % 16 = 0 then 'TOO_OLD' else 'CLAIM' end as outcome from documents"
)
def staged_claim(spark, sf_dir):
    rows = docs(spark, sf_dir)
    good = F.substring(F.sha2("text", 256), 1, 32)
    staged = F.struct(
        F.array(F.when(F.col("doc_id") % 2 == 0, F.lit("startup")).otherwise(F.lit("resume"))).alias("deliver_on"), (F.col("doc_id") % 10 == 0).alias("claimed"), F.col("text").alias("capsule"),
        F.when(F.col("doc_id") % 6 == 0, F.lit("x")).otherwise(good).alias("content_hash"), F.col("source").alias("workspace_id"), F.when(F.col("doc_id") % 16 == 0, F.lit(0)).otherwise(F.lit(900_000_000)).cast("long").alias("created_ms"),
    )
    start = rows.select("doc_id", staged.alias("staged"), F.lit("startup").alias("source"), F.when(F.col("source") == "src0", F.lit("other")).otherwise(F.col("source")).alias("workspace_id"))
    return start.select("doc_id", delivery.claim_outcome("staged", F.lit(1_000_000_000)).alias("outcome"))


@query()
def capsules(spark, sf_dir):
    """The bounded record of every session's last epoch, all sections, default budget."""
    excerpt = F.when(F.col("post_hash").isNotNull(), F.concat(F.lit("- value = "), F.substring("post_hash", 3, 4), F.lit("\n+ value = "), F.substring("post_hash", 1, 4)))
    timeline = written(with_git(told(spark, sf_dir)).withColumn("excerpt", excerpt))
    return record.records(timeline)


@query(
    "with d as (select *, regexp_replace(regexp_replace(text, '(^|[^A-Za-z0-9_])AKIA[0-9A-Z]{16}($|[^0-9A-Z])', '\\1[REDACTED:aws_access_key]\\2', 'g'), '((?i:(?:api[_-]?key|secret|token|passw(?:or)?d|auth)[\"'']?\\s*[:=]\\s*[\"'']?))[^\\s\"'',;]{8,}', '\\1[REDACTED:generic_secret]', 'g') as clean from documents)"
    ", o as (select *, case when doc_id % 5 = 0 then 'UNKNOWN_SESSION' when doc_id % 7 = 0 or text is null then 'NO_STATE' else 'STAGED' end as outcome from d)"
    " select doc_id as request_id, outcome, case when outcome = 'STAGED' then left(sha256(clean), 32) end as content_hash, case when outcome = 'STAGED' and doc_id % 3 = 0 then doc_id + 2 when outcome = 'STAGED' then doc_id end as source_checkpoint_id, outcome = 'STAGED' and clean <> text as redacted_again from o"
)
def restore_requests(spark, sf_dir):
    """Documents as records that were rendered before: some asked for from another workspace, some of sessions without state."""
    rows = docs(spark, sf_dir).withColumn("session_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    k = F.col("doc_id")
    requests = rows.select(k.alias("request_id"), F.when(k % 5 == 0, "other").otherwise(F.col("source")).alias("workspace_id"), "session_id", F.lit(1).cast("long").alias("now_ms"))
    sessions = rows.select("session_id", F.col("source").alias("project_id"), (k % 7 != 0).alias("has_state"))
    made = rows.select("session_id", F.explode(F.when(k % 3 == 0, F.array(k, k + 2)).otherwise(F.array(k))).alias("checkpoint_id"), F.lit(5).cast("long").alias("created_ms"))
    texts = rows.select("session_id", F.col("text").alias("capsule"), F.lit(10_000_000).cast("long").alias("tokens"))
    out = record.restored(requests, sessions, texts, made).join(rows.select(k.alias("request_id"), "text"), "request_id")
    return out.select("request_id", "outcome", "content_hash", "source_checkpoint_id", F.coalesce((F.col("outcome") == "STAGED") & (F.col("capsule") != F.col("text")), F.lit(False)).alias("redacted_again"))


def units_sql(t: str) -> str:
    """The units of a text's token estimate, in DuckDB's words."""
    up = lambda found, k: f"coalesce(list_sum(list_transform({found}, lambda x: cast(ceil(length(x) / {k}.0) as bigint))), 0)"
    first = f"regexp_extract_all({t}, '(?:^|[ \\n\\r\\t])([A-Za-z]+)', 1)"
    left = lambda pattern: f"length({t}) - length(regexp_replace({t}, '{pattern}', '', 'g'))"
    return (
        f"({up(f"regexp_extract_all({t}, '  +')", 2)} + {left('[\\n\\r\\t]')} + {up(first, 3)} - {up(first, 2)} + {up(f"regexp_extract_all({t}, '[A-Za-z]+')", 2)} + {up(f"regexp_extract_all({t}, '[0-9]+')", 3)}"
        f" + 2 * ({left('[^\\x00-\\x7F]')}) + {left('[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F!-/:-@\\[-`{-\\x7F]')})"
    )


KINDS = [(s, p) for s, p, _, _ in ladder.FULL]
RUNG_BUDGET = 150


@query(
    "with k as (select unnest(range(0, " + str(len(KINDS)) + ")) as i, unnest([" + ", ".join(f"'{s}'" for s, _ in KINDS) + "]) as section, unnest([" + ", ".join(f"'{p}'" for _, p in KINDS) + "]) as part)"
    ", lines as (select concat('c', cast(conv_id as varchar)) as session_id, section, part, row_number() over (partition by conv_id, i order by turn, text) as n, text from (select *, unnest([0, 1, 2, 3]) as j from conversations) join k on (turn * 5 + j * 6 + conv_id) % " + str(len(KINDS)) + " = i)"
    ", lim(rung, section, part, entries, cap, oldest) as (values " + ", ".join(map(str, ladder.limits())) + ")"
    ", v as (select *, case when cap = 1073741824 or length(text) <= cap then concat('- ', text) else concat('- ', left(text, cap - 3), '...') end as line from lines join (select distinct section, part, cap from lim) using (section, part) where trim(text) <> '')"
    f", u as (select *, {units_sql('line')} as units, length(line) as chars from v)"
    ", w as (select a.session_id, a.section, a.part, a.n, a.cap, min((b.units, -b.cap, b.chars)) as best from u a join u b using (session_id, section, part, n) where b.cap >= a.cap group by all)"
    ", m as (select *, max(n) over (partition by session_id, section, part) as last from w)"
    ", t as (select session_id, rung, section, sum(best[1] + 1) as units, sum(best[3] + 1) as chars from m join lim using (section, part, cap) where n <= entries and last - n >= oldest group by all)"
    f", h as (select session_id, rung, sum(units + {units_sql("concat(lower(section), ':')")} + 1) - 1 as units, sum(chars + length(section) + 2) - 1 as chars from t group by all)"
    f", f as (select session_id, min((rung, units)) filter (units + ceil(units / 32.0) <= {RUNG_BUDGET} and chars <= 9500) as hit, max((rung, units)) as worst, max(rung) as seen from h group by all)"
    f" select session_id, cast(coalesce(hit[1], case when seen < {len(ladder.RUNGS)} then seen + 1 end, {len(ladder.RUNGS)}) as integer) as rung, cast(case when hit is null and seen < {len(ladder.RUNGS)} then 0 else coalesce(hit[2], worst[2]) + ceil(coalesce(hit[2], worst[2]) / 32.0) end as bigint) as tokens, hit is not null or seen < {len(ladder.RUNGS)} as fits from f"
)
def record_rungs(spark, sf_dir):
    """What each conversation says as lines of a record's sections: the rung at which they fit the budget."""
    said = docs(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.explode(F.array(*map(F.lit, range(4)))).alias("j"))
    kind = ((F.col("turn") * 5 + F.col("j") * 6 + F.col("conv_id")) % len(KINDS)).cast("int")
    of = lambda i: F.get(F.array(*[F.lit(k[i]) for k in KINDS]), F.col("i"))
    n = F.row_number().over(Window.partitionBy("conv_id", "i").orderBy("turn", "text")).cast("long")
    lines = said.withColumn("i", kind).withColumn("n", n).select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("session_id"), of(0).alias("section"), of(1).alias("part"), "n", "text")
    return ladder.chosen(ladder.weighed(spark, lines), RUNG_BUDGET, lines.where(F.trim("text") != "").select("session_id").distinct())


# --- stated rules and rejections

RULES = ("", "Rule: keep the parser stable. ", "You must not touch the lexer. ", "Always sort the output. ", "We tried a workaround with a lock. That workaround is a rejected approach. ", "If it fails it is a dead end. ", "Caching the key is a dead end. ", "That fix is a dead end. ", 'Never say "always". ')
#: What each of RULES states, as (text, kind).
RULED = {
    1: ("Rule: keep the parser stable.", "labelled"), 2: ("You must not touch the lexer.", "prohibition"), 3: ("Always sort the output.", "requirement"),
    4: ("We tried a workaround with a lock. That workaround is a rejected approach.", "rejection"), 6: ("Caching the key is a dead end.", "rejection"), 8: ('Never say "always".', "prohibition"),
}


@query(
    f"with {TL}, said as (select *, unnest([1, 2]) as n from tl where prompt is not null), k as (select *, cast(case when n = 1 then id % 9 else (id * 5 + 1) % 9 end as integer) as r from said)"
    ", t(r, text, kind) as (values " + ", ".join(f"({r}, '{t.replace(chr(39), chr(39) * 2)}', '{k}')" for r, (t, k) in RULED.items()) + ")"
    " select session_id, epoch, position, prompt_ordinal, id as source_event_id, text, kind from k join t using (r) qualify row_number() over (partition by session_id, epoch, text order by position, n) = 1"
)
def constraints(spark, sf_dir):
    """Two statements put after every prompt, in a paragraph of their own each."""
    rows = flat(spark, sf_dir)
    rule = lambda r: F.get(F.array(*[F.lit(x) for x in RULES]), r.cast("int"))
    more = F.concat(F.col("prompt"), F.lit("\n\n"), rule(F.col("id") % 9), F.lit("\n\n"), rule((F.col("id") * 5 + 1) % 9))
    timeline = order.timeline(rows.withColumn("prompt", more))
    return folds.constraints(timeline).select("session_id", "epoch", "position", "prompt_ordinal", "source_event_id", "text", "kind")


@query(
    f"with {LED}, s as (select distinct concat('session-', right(concat('000', substr(session_id, 2)), 3)) as id from led), p as (select unnest(['session', 'session-', 'session-0', 'session-012', 'session-1', 'session-100', 'Session-012', 'session-9%', 'session-999', 'sessi_n-012']) as prefix)"
    " select prefix, case when length(prefix) < 8 then 'TOO_SHORT' when count(id) = 0 then 'NONE' when count(id) = 1 then 'ONE' else 'AMBIGUOUS' end as outcome, case when length(prefix) >= 8 and count(id) = 1 then min(id) end as session_id from p left join s on starts_with(id, prefix) group by prefix"
)
def session_prefixes(spark, sf_dir):
    rows = events(spark, sf_dir).select(F.concat(F.lit("session-"), F.lpad(F.substring("session_id", 2, 9), 3, "0")).alias("session_id"))
    asked = ["session", "session-", "session-0", "session-012", "session-1", "session-100", "Session-012", "session-9%", "session-999", "sessi_n-012"]
    prefixes = rows.limit(1).select(F.explode(F.array(*[F.lit(x) for x in asked])).alias("prefix"))
    return lookups.resolve_prefixes(prefixes, rows.where("session_id < 'session-1'"), rows)


@query(
    f"with {TL}, s as (select session_id, min_by(project_id, position) as project_id, max(logical_ms) as last_event_ms from tl group by 1)"
    " select project_id, session_id, last_event_ms, session_id = (select max_by(session_id, (last_event_ms, session_id)) from s) as latest_of_all from s qualify row_number() over (partition by project_id order by last_event_ms desc, session_id desc) = 1"
)
def latest_sessions(spark, sf_dir):
    return lookups.latest_sessions(folds.sessions(told_once(spark, sf_dir)))


@query(
    "with g as (select o_custkey, o_orderstatus <> 'P' as finished, o_totalprice > 1000 as priced, case when o_orderkey % 9 <> 0 then o_orderkey % 4 <> 0 end as measured from orders)"
    ", f as (select o_custkey, unnest(case when finished then [] else ['cost', 'duration'] end || case when priced then [] else ['cost'] end || case when measured is true then [] else ['tokens'] end) as m from g)"
    ", r as (select o_custkey, count(*) filter (not finished or not priced or measured is not true) as runs_excluded from g group by 1)"
    " select o_custkey, coalesce((select string_agg(distinct m, ',' order by m) from f where f.o_custkey = r.o_custkey), '') as excluded, runs_excluded from r"
)
def excluded_measures(spark, sf_dir):
    k = F.col("o_orderkey")
    gates = {"finished": F.col("o_orderstatus") != "P", "priced": F.col("o_totalprice") > 1000, "measured": F.when(k % 9 != 0, k % 4 != 0)}
    out = an.excluded(docs(spark, sf_dir, "orders"), ["o_custkey"], gates, {"finished": ["cost", "duration"], "priced": ["cost"], "measured": ["tokens"]})
    return out.select("o_custkey", F.array_join("excluded", ",").alias("excluded"), "runs_excluded")


# --- what is quoted, what the user wrote, what a restore reaches

IDENTIFIER = "[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+|^[A-Za-z0-9_-]+\\.[A-Za-z]{1,5}$|[A-Za-z0-9]+_[A-Za-z0-9]+|[a-z]+[A-Z][A-Za-z0-9]*|::|[A-Za-z0-9_]+\\(\\)"
SAID = "concat(text, case turn % 3 when 0 then ' Is it so? See `a` or `b`! And more.' when 1 then ' Then run fix_it() now. Later, not yet.' else '' end)"
REJECTED = "That way is a Rejected Approach, so leave it alone."
QUOTED = 120


@query(
    f"with s as (select conv_id, turn, {SAID} as t from conversations), p as (select *, string_split(regexp_replace(t, '([.?!])(\\s)', '\\1' || chr(1) || '\\2', 'g'), chr(1)) as parts from s)"
    ", h as (select *, list_position(list_transform(parts, lambda x: length(x) - length(replace(x, '`', '')) >= 2 or len(list_filter(string_split_regex(x, '\\s+'), lambda w: regexp_matches(regexp_replace(regexp_replace(w, '^[`''\"(\\[{<,;:!?.]+', ''), '[`''\"\\]}>,;:!?.]+$', ''), '"
    + IDENTIFIER + "'))) > 0), true) as k from p) select conv_id, turn, md5(case when k > 0 then array_to_string(parts[1:k], '') else t end) as quoted from h"
)
def code_sentences(spark, sf_dir):
    """What is said up to the first sentence that names code; some turns get such a sentence."""
    return docs(spark, sf_dir, "conversations").withColumn("t", F.expr(SAID)).select("conv_id", "turn", F.md5(quotes.through_code_sentence(F.col("t"))).alias("quoted"))


@query(
    f"with s as (select conv_id, turn, concat(text, '. {REJECTED}') as t from conversations), c as (select *, trim(regexp_extract(t, '(?s)^(.*?[.?!])(\\s|$)', 1)) as first from s)"
    f" select conv_id, turn, case when length(t) <= {QUOTED} then t when length(first) + 40 <= {QUOTED} then concat(first, ' ... That way is a Rejected Approach ...') else concat(left(first, {QUOTED} - 43), '... That way is a Rejected Approach ...') end as quoted from c"
)
def rejection_quotes(spark, sf_dir):
    """Every message, rejected at its end, in 120 characters: how it begins, and the clause that rejects it."""
    t = F.concat("text", F.lit(f". {REJECTED}"))
    return docs(spark, sf_dir, "conversations").select("conv_id", "turn", quotes.quote_rejection(t, F.lit("rejected approach"), QUOTED).alias("quoted"))


LINE = "concat('- ', case when id % 4 = 0 then 'lib/' else '' end, path, case id % 3 when 0 then 'c' when 1 then '.' else ' | 1' end)"


@query(
    f"with {LED}, l as (select id, path, {LINE} as line, split_part(path, '/', -1) as tail from led where path is not null), n as (select *, unnest([path, tail]) as p, unnest([1, 2]) as k from l)"
    ", c as (select *, substr(line, position(p in line) - 1, 1) as before, substr(line, position(p in line) + length(p), 1) as after from n)"
    ", r as (select *, not regexp_matches(before, '[\\pL\\pN_/.\\\\-]') and not regexp_matches(after, '[\\pL\\pN_/-]') as ok from c)"
    " select id, line, bool_or(ok) filter (k = 1) as named, bool_or(ok) filter (k = 2) as tail_named from r group by all"
)
def path_mentions(spark, sf_dir):
    """Lines that print a path whole, as part of a longer one, or as its head."""
    rows = flat(spark, sf_dir).where("path is not null").select("id", "path", F.expr(LINE).alias("line"))
    return rows.select("id", "line", quotes.names_path(F.col("line"), F.col("path")).alias("named"), quotes.names_path(F.col("line"), F.substring_index("path", "/", -1)).alias("tail_named"))


#: Elements that clients put around prompts, as (before, after); the last one never ends and so stays.
AROUND = (
    ("", ""), ("<system-reminder>note</system-reminder>", ""), ("", "<ide_opened_file>x.py</ide_opened_file> "), ("<bash-input>a<bash-input>b</bash-input></bash-input> <command-name>/x</command-name>", "<Task-Notification a='1'>done</Task-Notification>"),
    ("<system-reminder>open ", ""),
)


@query(f"with {LED} select id, case when id % 5 = 4 then concat('<system-reminder>open ', prompt) else trim(prompt) end as authored from led where prompt is not null")
def authored_prompts(spark, sf_dir):
    """Prompts with what clients put around them, and what of it the user wrote."""
    side = lambda k: F.element_at(F.array(*[F.lit(a[k]) for a in AROUND]), (F.col("id") % 5 + 1).cast("int"))
    rows = flat(spark, sf_dir).where("prompt is not null")
    return rows.select("id", authored(F.concat(side(0), "prompt", side(1))).alias("authored"))


#: Commands, and in SQL whether each reaches a path.
RESTORING = (
    ("git checkout -- src", "path like 'src/%'"), ("cd src && git restore 'f1*.py'", "path like 'src/f1%.py'"), ("git stash", "path not like '../%'"), ("git restore --staged src", "false"),
    ("cd $D && git clean -f", "false"), ("git checkout -b src", "false"), ("git reset --hard HEAD~1; git clean -n", "path not like '../%'"), ("FOO=1 git -C node_modules checkout HEAD -- f3.py", "path = 'node_modules/f3.py'"),
)


@query(f"with {LED} select id, path, case " + " ".join(f"when id % {len(RESTORING)} = {i} then {ok}" for i, (_, ok) in enumerate(RESTORING)) + " end as reached from led where path is not null")
def restore_reach(spark, sf_dir):
    """Which touched files a restore of each kind would reach."""
    called = F.element_at(F.array(*[F.lit(c) for c, _ in RESTORING]), (F.col("id") % len(RESTORING) + 1).cast("int"))
    rows = flat(spark, sf_dir).where("path is not null").select("id", "path", restore_targets(called, F.lit("/w/p"), F.lit("/w/p")).alias("to"))
    return rows.select("id", "path", reached(F.col("to"), F.col("path"), F.lit("/w/p")).alias("reached"))


# --- sections as of a time

THEN = 1704100000000 + 86400000 * 3


@query()
def edits_section_as_of(spark, sf_dir):
    seen = life.observations(with_git(told(spark, sf_dir)))
    return views.as_of(views.edit_statuses(seen), THEN).select("session_id", "path", "event_id", "status", "mechanism")


@query()
def dead_ends_section_as_of(spark, sf_dir):
    seen = life.observations(with_git(told(spark, sf_dir)))
    return views.as_of(views.dead_end_statuses(seen), THEN).select("session_id", "path", "id", "mechanism", "reapplied", F.size("edit_ids").alias("edits"))


@query(
    f"with {CMDS}, c as (select * from cmds where ts_ms <= {THEN}) select f.event_id, f.signature, case when exists (select 1 from c p where p.session_id = f.session_id and p.epoch = f.epoch and p.signature = f.signature and p.outcome = 'PASS' and (p.ts_ms, p.event_id) > (f.ts_ms, f.event_id)) then 'RESOLVED' else 'OPEN' end as status from c f where f.outcome = 'FAIL'"
)
def failures_section_as_of(spark, sf_dir):
    return views.as_of(views.failure_statuses(folds.commands(told(spark, sf_dir))), THEN).select("event_id", "signature", "status")


@query(
    f"with {STATS.replace('from tl where path is not null', f'from tl where path is not null and logical_ms <= {THEN}').replace('from cmds where outcome', f'from cmds where ts_ms <= {THEN} and outcome')}"
    " select session_id, epoch, path, edits, reads, in_failure, first_touch_ms, last_touch_ms, cast(4 * cast(in_failure as integer) + 3 * least(edits, 3) + case when reads >= 2 then 2 else 0 end + least(reads, 3) as bigint) as score from stats"
)
def files_section_as_of(spark, sf_dir):
    timeline = told_once(spark, sf_dir)
    seen = views.as_of(views.file_activity(timeline, folds.commands(timeline)), THEN)
    return seen.select("session_id", "epoch", "path", "edits", "reads", "in_failure", "first_touch_ms", "last_touch_ms", "score")


# --- evidence and lineage


@query(
    f"with recursive {EDITS}, p as (select session_id, min(event_id) over (partition by session_id, path) as id, event_id as n, case when event_id % 7 <> 0 then concat('v', cast(event_id * 3 % 5 as varchar)) end as removed, case when event_id % 11 <> 0 then concat('v', cast(event_id % 5 as varchar)) end as added from eds)"
    ", q as (select * from p where removed is not null or added is not null), k as (select session_id, id, min(n) as n from q where added is null or not exists (select 1 from q l where l.session_id = q.session_id and l.id = q.id and l.n > q.n and l.removed = q.added) group by 1, 2)"
    ", w as (select q.session_id, q.id, q.n as event_id, q.n, q.removed, q.added, 0 as step from q join k using (session_id, id, n)"
    " union all select w.session_id, w.id, w.event_id, b.n, b.removed, w.added, step + 1 from w join q b on b.session_id = w.session_id and b.id = w.id and b.n = (select max(l.n) from q l where l.session_id = w.session_id and l.id = w.id and l.n < w.n and l.added = w.removed))"
    " select session_id, id, event_id, removed, added from w qualify row_number() over (partition by session_id, id order by step desc) = 1"
)
def dead_end_evidence(spark, sf_dir):
    """The edits of each file as one dead end, with lines that come and go."""
    edits = folds.edits(told(spark, sf_dir))
    line = lambda x, none: F.when(F.col("event_id") % none != 0, F.concat(F.lit("v"), (x % 5).cast("string")))
    group = Window.partitionBy("session_id", "path")
    parts = edits.select("session_id", F.min("event_id").over(group).alias("id"), F.col("event_id").alias("n"), "event_id", line(F.col("event_id") * 3, 7).alias("removed"), line(F.col("event_id"), 11).alias("added"))
    return life.evidence(parts)


TRACED = ("MODULE number 1", "src/f3.py", "src\\f11", "pytest tests/t1", "build part", "f2", "./", "nowhere", "please change module number 4")


@query(
    f"with {STATS}, ranked as ({SQL['working_files_top8'].removeprefix(f'with {STATS} ')}"
    + "), texts as (select session_id, 0 as ordinal, concat_ws(' ', path, command, prompt) as text from tl union all select session_id, 1, command_text from cmds union all select session_id, 1, path from stats union all select session_id, 2, path from ranked)"
    ", m as (select distinct session_id, unnest([" + ", ".join(f"'{x}'" for x in TRACED) + "]) as marker from led)"
    ", g as (select *, unnest([0, 1, 2, 3]) as ordinal from m), k as (select distinct session_id, ordinal from texts)"
    ", h as (select session_id, marker, ordinal, count(*) as n from m join texts using (session_id) where contains(lower(text), lower(replace(marker, chr(92), '/'))) group by all)"
    ", f as (select g.session_id, g.marker, g.ordinal, case when k.ordinal is not null then coalesce(h.n, 0) > 0 end as present from g left join k using (session_id, ordinal) left join h using (session_id, marker, ordinal))"
    ", b as (select *, last_value(present ignore nulls) over (partition by session_id, marker order by ordinal rows between unbounded preceding and 1 preceding) as before from f)"
    " select session_id, marker, ['events', 'ledger', 'snapshot', 'staged'][min(case when not present and before then ordinal end) + 1] as lost_at, bool_or(coalesce(present, false)) as ever_present from b group by 1, 2"
)
def lineage_trace(spark, sf_dir):
    """Paths and phrases from the events through the projections to what the record would select; nothing is staged."""
    timeline = told_once(spark, sf_dir)
    runs = folds.commands(timeline)
    stats = folds.file_stats(timeline, runs)
    named = folds.edits(timeline).where("event_id % 29 = 0")
    of = lambda df, layer, text: df.select("session_id", F.lit(layer).alias("layer"), F.concat_ws(":", F.lit(layer), text).alias("row"), text.alias("text"))
    texts = (
        of(timeline, "events", F.concat_ws(" ", "path", "command", "prompt")).unionByName(of(runs, "ledger", F.col("command_text"))).unionByName(of(stats, "ledger", F.col("path")))
        .unionByName(of(ranking.working_files(stats, 8, named), "snapshot", F.col("path")))
    )
    markers = timeline.select("session_id").distinct().select("session_id", F.explode(F.array(*[F.lit(x) for x in TRACED])).alias("marker"))
    return lineage.trace(texts, markers, {k: lineage.REASONS[k] for k in ("events", "ledger", "snapshot", "staged")}).select("session_id", "marker", "lost_at", "ever_present")


# --- what a session did first

ACTS = LED + ", acts as (select session_id, id as index, tool_name as tool, path as target from led where path is not null)"


def actions(spark, sf_dir) -> DataFrame:
    return flat(spark, sf_dir).where("path is not null").select("session_id", F.col("id").alias("index"), F.col("tool_name").alias("tool"), F.col("path").alias("target"))


@query(
    f"with {ACTS}, m as (select *, tool in ('Edit', 'Write') and target like '%f7.py' as hit, target like 'node_modules/%' as bad from acts), f as (select session_id, min(index) filter (hit) as pos from m group by 1)"
    " select m.session_id, pos is not null as found, case when pos is not null then count(*) filter (index < pos) end as steps, pos as position, max(tool) filter (index = pos) as tool, max(target) filter (index = pos) as target, coalesce(bool_or(bad and (pos is null or index < pos)), false) as forbidden_first from m join f using (session_id) group by 1, pos"
)
def first_correct_action(spark, sf_dir):
    """The first edit of a file named f7.py; dependencies are not to be touched before it."""
    right = F.col("tool").isin("Edit", "Write") & F.col("target").endswith("f7.py")
    return an.first_match(actions(spark, sf_dir), ["session_id"], right, F.col("target").startswith("node_modules/"))


@query(
    f"with {ACTS}, f as (select session_id, min(index) filter (tool <> 'Read') as pos from acts group by 1)"
    ", r as (select a.*, pos, exists (select 1 from acts b where b.session_id = a.session_id and b.target = a.target and b.tool = 'Read' and b.index < a.index) as again from acts a join f using (session_id))"
    " select session_id, count(*) filter (tool = 'Read' and (pos is null or index < pos)) as reads, count(*) filter (tool = 'Read' and again and (pos is null or index < pos)) as rereads,"
    " count(*) filter (tool = 'Read' and again and target like 'src/%' and (pos is null or index < pos)) as own_rereads, max(target) filter (index = pos) as first_edit from r group by 1"
)
def reads_before_first_edit(spark, sf_dir):
    read = F.col("tool") == "Read"
    return an.before_first_edit(actions(spark, sf_dir), ["session_id"], ~read, read, F.col("target").startswith("src/"))


@query(
    f"with {ACTS}, ck as (select session_id, max(id) as checkpoint_id from led where hook_event = 'PreCompact' group by 1), facts as (select distinct session_id, unnest(['src/f1.py', 'src/f2.py', 'src/f20.py']) as fact from led)"
    " select f.session_id, f.fact, c.checkpoint_id, count(a.index) > 0 as captured, count(a.index) as rows from facts f left join ck c using (session_id) left join acts a on a.session_id = f.session_id and a.target = f.fact and a.tool <> 'Read' and a.index <= c.checkpoint_id group by all"
)
def captured_by_checkpoint(spark, sf_dir):
    """Edits of three files as facts: did the ledger hold one by the last checkpoint?"""
    rows = flat(spark, sf_dir)
    facts = rows.select("session_id").distinct().select("session_id", F.explode(F.array(*[F.lit(f"src/f{k}.py") for k in (1, 2, 20)])).alias("fact"))
    made = rows.where("hook_event = 'PreCompact'").select("session_id", F.col("id").alias("checkpoint_id"), F.col("id").alias("watermark"))
    held = rows.where("path is not null and tool_name <> 'Read'").select("session_id", F.col("path").alias("fact"), F.col("id").alias("event_id"))
    return an.captured(facts, held, made)


# --- text


@query(
    "with s as (select doc_id, coalesce(text, '') as t from documents), r as (select doc_id, list_sum(list_transform(regexp_extract_all(t, '  +'), lambda x: cast(ceil(length(x) / 2.0) as bigint))) as a, length(t) - length(regexp_replace(t, '[\\n\\r\\t]', '', 'g')) as b,"
    " list_sum(list_transform(regexp_extract_all(t, '(?:^|[ \\n\\r\\t])([A-Za-z]+)', 1), lambda x: cast(ceil(length(x) / 3.0) - ceil(length(x) / 2.0) as bigint))) as c, list_sum(list_transform(regexp_extract_all(t, '[A-Za-z]+'), lambda x: cast(ceil(length(x) / 2.0) as bigint))) as d,"
    " list_sum(list_transform(regexp_extract_all(t, '[0-9]+'), lambda x: cast(ceil(length(x) / 3.0) as bigint))) as e, length(t) - length(regexp_replace(t, '[^\\x00-\\x7F]', '', 'g')) as f, length(t) - length(regexp_replace(t, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F!-/:-@\\[-`{-\\x7F]', '', 'g')) as g from s)"
    ", w as (select doc_id, coalesce(a, 0) + b + coalesce(c, 0) + coalesce(d, 0) + coalesce(e, 0) + 2 * f + g as raw from r) select doc_id, cast(raw + ceil(raw / 32.0) as bigint) as tokens from w"
)
def token_estimate(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", tx.token_estimate(F.coalesce("text", F.lit(""))).alias("tokens"))


@query(
    "select doc_id, case when length(text) <= 60 then text else concat(substr(text, 1, 57), '...') end as head, case when length(text) <= 60 then text else concat('...', right(text, 57)) end as tail,"
    " cast(case when text = '' then 0 else length(text) - length(replace(text, chr(10), '')) + case when text like concat('%', chr(10)) then 0 else 1 end end as integer) as lines from documents"
)
def text_cuts(spark, sf_dir):
    t = F.col("text")
    return docs(spark, sf_dir).select("doc_id", tx.truncate_chars(t, 60).alias("head"), tx.truncate_front(t, 60).alias("tail"), tx.line_count(t).alias("lines"))


@query("select doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as collapsed from documents")
def collapse_whitespace(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(tx.collapse_whitespace(F.col("text"))).alias("collapsed"))


@query(
    "select doc_id, md5(regexp_replace(text, '((?i:(?:api[_-]?key|secret|token|passw(?:or)?d|auth)[\"'']?\\s*[:=]\\s*[\"'']?))[^\\s\"'',;]{8,}', '\\1[REDACTED:generic_secret]', 'g')) as clean from "
    "(select doc_id, regexp_replace(text, '(^|[^A-Za-z0-9_])AKIA[0-9A-Z]{16}($|[^0-9A-Z])', '\\1[REDACTED:aws_access_key]\\2', 'g') as text from documents)"
)
def redact_documents(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(redact(F.col("text"))).alias("clean"))


@query(
    f"with {LED} select id, strftime(make_timestamp((ts_ms - ts_ms % 1000) * 1000), '%Y-%m-%dT%H:%M:%SZ') as rfc3339, strftime(make_timestamp((ts_ms - ts_ms % 1000) * 1000), '%Y%m%dT%H%M%SZ') as compact,"
    " case when id < 60 then concat(cast(id as varchar), 's') when id < 3600 then concat(cast(id // 60 as varchar), 'm') when id < 86400 then concat(cast(id // 3600 as varchar), 'h') else concat(cast(id // 86400 as varchar), 'd') end as age from led"
)
def time_formats(spark, sf_dir):
    return events(spark, sf_dir).select("id", tx.rfc3339(F.col("ts_ms")).alias("rfc3339"), tx.compact_utc(F.col("ts_ms")).alias("compact"), tx.human_age(F.col("id") * 1000).alias("age"))


#: A place for the name of each page's file among directories of all kinds.
PLACES = (
    "src/{}", "node_modules/x/{}", "a/Bower_Components/{}", "lib/site-packages/{}", "lib/dist-packages/{}", "__pycache__/{}", ".tox/py3/{}", "x\\.git\\{}", "vendor/{}", "dist/{}", "build/{}", ".venv/lib/{}", ".Venv/{}",
    "target/debug/{}", "src/target/{}", "target/doc", ".env", ".env.local", "a/.envrc", "b/.ENV", "keys/{}.pem", "k/id_rsa", "k/id_ed25519.pub", ".npmrc", ".pypirc", "home/.netrc", ".pgpass", "my_Credentials_{}", "x/secrets/{}", "a/secret-{}",
    "u/.ssh/{}", "u/.aws/config", ".ssh", "/abs/{}", "../up/{}", "C:\\w\\{}", "server.key/", "a/b/",
)
#: What the rules say of each place, in their order: third-party, incidental, sensitive, outside.
PLACE_RULES = "".join((
    "0000 1100 1100 1100 1100 1100 1100 1100 0000 0000 0000 0100 0000 ", "0100 0000 0100 0010 0010 0000 0010 0010 0010 0010 0010 0010 0010 0000 0010 0000 0010 ", "0010 0010 0000 0001 0001 0001 0010 0000",
)).split()


PLACES_SQL = "[" + ", ".join(f"'{x}'" for x in PLACES) + "]"


@query(
    "with f as (select page_id, coalesce(nullif(regexp_extract(url, '([A-Za-z0-9_-]+\\.html)', 1), ''), 'x.html') as f, cast(page_id % " + str(len(PLACES)) + " as integer) + 1 as k from pages)"
    + ", p as (select page_id, replace(" + PLACES_SQL + "[k], '{}', f) as path, " + str(list(PLACE_RULES)) + "[k] as r from f)"
    + " select page_id, path, r[1] = '1' as third_party, r[2] = '1' as incidental, r[3] = '1' as sensitive, r[4] = '1' as outside from p"
)
def path_predicates(spark, sf_dir):
    """Paths of all kinds, made of the pages' file names, under the four rules on paths."""
    name = F.coalesce(F.nullif(F.regexp_extract("url", r"([A-Za-z0-9_-]+\.html)", 1), F.lit("")), F.lit("x.html"))
    place = F.element_at(F.array(*[F.lit(x) for x in PLACES]), (F.col("page_id") % len(PLACES)).cast("int") + 1)
    pages = docs(spark, sf_dir, "pages").select("page_id", F.replace(place, F.lit("{}"), name).alias("path"))
    p = F.col("path")
    return pages.select("page_id", "path", tx.is_third_party(p).alias("third_party"), tx.is_incidental(p).alias("incidental"), tx.is_sensitive(p).alias("sensitive"), tx.is_outside(p).alias("outside"))


@query(
    f"with {LED} select id, case when id % 5 = 0 then 'INTERRUPTED' when hook_event = 'PostToolUseFailure' then 'FAIL' when id % 4 = 3 then 'UNKNOWN' when id % 2 = 0 then 'PASS' else 'FAIL' end as outcome from led where command is not null"
)
def command_outcome(spark, sf_dir):
    rows = flat(spark, sf_dir).where("command is not null").withColumn("d", cmd.described("command"))
    ended = cmd.outcome(F.col("d.kind"), F.col("hook_event") == "PostToolUseFailure", F.col("exit_code"), F.col("id") % 5 == 0, F.col("stdout_tail"))
    return rows.select("id", ended.alias("outcome"))


@query(f"with {LED} select id, concat('E   assert ', cast(id % 90 as varchar), ' == 0') as excerpt from led where hook_event = 'PostToolUseFailure'")
def failure_excerpt(spark, sf_dir):
    rows = flat(spark, sf_dir).where("hook_event = 'PostToolUseFailure'")
    return rows.select("id", F.array_join(cmd.failure_excerpt(F.col("error")), "\n").alias("excerpt"))


@query(f"with {LED} select id, concat('tests/t', cast(id % 5 as varchar), '.py::test_', cast(id % 9 as varchar)) as first, 2 as n from led where command is not null")
def failing_tests(spark, sf_dir):
    rows = flat(spark, sf_dir).where("command is not null")
    name = F.concat(F.lit("tests/t"), (F.col("id") % 5).cast("string"), F.lit(".py::test_"), (F.col("id") % 9).cast("string"))
    report = F.concat(F.lit("FAILED "), name, F.lit(" - assert 1\nok\n--- FAIL: TestGo (0.00s)\nFAILED "), name)
    found = cmd.failing_tests(report)
    return rows.select("id", found[0].alias("first"), F.size(found).alias("n"))


# --- evaluation


@query(
    "with s as (select d.source, count(case when quality = 1 and toxic = 0 then 1 end) as a, count(case when quality = 1 and toxic = 1 then 1 end) as b, count(case when quality = 0 and toxic = 0 then 1 end) as c, count(case when quality = 0 and toxic = 1 then 1 end) as d from labels l join documents d using (doc_id) group by 1)"
    ", e as (select *, a + b as r, a + c as k, a + b + c + d as n from s), x as (select *, unnest(range(a, least(r, k) + 1)) as i from e)"
    ", p as (select source, a, sum(exp(lgamma(r + 1) - lgamma(i + 1) - lgamma(r - i + 1) + lgamma(n - r + 1) - lgamma(k - i + 1) - lgamma(n - r - k + i + 1) - lgamma(n + 1) + lgamma(k + 1) + lgamma(n - k + 1))) as p from x group by 1, 2)"
    " select source, a, round(least(p, 1.0), 8) as p from p"
)
def fisher_exact(spark, sf_dir):
    both = docs(spark, sf_dir, "labels").join(docs(spark, sf_dir).select("doc_id", "source"), "doc_id")
    cell = lambda q, t: F.count(F.when((F.col("quality") == q) & (F.col("toxic") == t), 1))
    tables = both.groupBy("source").agg(cell(1, 0).alias("a"), cell(1, 1).alias("b"), cell(0, 0).alias("c"), cell(0, 1).alias("d"))
    return tables.select("source", "a", F.round(an.fisher_one_sided(F.col("a"), F.col("b"), F.col("c"), F.col("d")), 8).alias("p"))


@query(
    "with r as (select event_type, value, row_number() over (partition by event_type order by value) as k, count(*) over (partition by event_type) as n from events)"
    " select event_type, max(case when k = cast(round_even((n - 1) * 0.95, 0) as bigint) + 1 then value end) as p95, max(case when k = cast(round_even((n - 1) * 0.5, 0) as bigint) + 1 then value end) as p50 from r group by 1"
)
def percentiles_nearest_rank(spark, sf_dir):
    return an.nearest_ranks(docs(spark, sf_dir, "events"), ["event_type"], "value", {"p95": 95, "p50": 50})


@query(
    "with l as (select l_returnflag, date_diff('day', cast(o_orderdate as date), cast(l_shipdate as date)) as latency from lineitem left join orders on l_orderkey = o_orderkey)"
    ", r as (select *, row_number() over (partition by l_returnflag order by latency) as k, count(*) over (partition by l_returnflag) as n from l where latency is not null)"
    " select l_returnflag, max(case when k = cast(round_even((n - 1) * 0.5, 0) as bigint) + 1 then latency end) as p50, max(case when k = cast(round_even((n - 1) * 0.95, 0) as bigint) + 1 then latency end) as p95 from r group by 1"
)
def class_latency(spark, sf_dir):
    """Starts (orders) and responses (their lines) paired by key; percentiles of the days between, per class of response."""
    day = lambda c: F.datediff(F.col(c).cast("date"), F.lit("1970-01-01"))
    starts = docs(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), day("o_orderdate").alias("at"))
    responses = docs(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), "l_returnflag", day("l_shipdate").alias("at"))
    ranks = an.nearest_ranks(an.paired_latency(starts, responses, "key", "at"), ["l_returnflag"], "latency", {"p50": 50, "p95": 95})
    return ranks.select("l_returnflag", F.col("p50").cast("long").alias("p50"), F.col("p95").cast("long").alias("p95"))


@query(
    "with r as (select l_returnflag, case when l_linenumber <> 3 then l_quantity end as quantity, l_discount as discount, case when l_returnflag <> 'A' or l_linenumber < 7 then l_extendedprice end as price from lineitem)"
    " select l_returnflag, count(*) as runs, round(avg(quantity), 6) as mean_quantity, count(quantity) as n_quantity, round(avg(discount), 6) as mean_discount, count(discount) as n_discount, case when count(price) = count(*) then round(sum(price), 2) end as cost from r group by 1"
)
def run_summary(spark, sf_dir):
    """Means of what is known, and a cost that stands only where every row has one."""
    rows = docs(spark, sf_dir, "lineitem").select("l_returnflag", F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("quantity"), F.col("l_discount").alias("discount"), F.when((F.col("l_returnflag") != "A") | (F.col("l_linenumber") < 7), F.col("l_extendedprice")).alias("price"))
    out = an.summary(rows, ["l_returnflag"], ["quantity", "discount"], F.col("price"))
    return out.select("l_returnflag", "runs", F.round("mean_quantity", 6).alias("mean_quantity"), "n_quantity", F.round("mean_discount", 6).alias("mean_discount"), "n_discount", F.round("cost", 2).alias("cost"))


@query(
    "select o_orderkey, o_orderstatus <> 'P' and o_totalprice > 1000 and (case when o_orderkey % 9 <> 0 then o_orderkey % 4 <> 0 end) is true as valid,"
    " concat_ws(',', case when o_orderstatus = 'P' then 'finished' end, case when not o_totalprice > 1000 then 'priced' end, case when (case when o_orderkey % 9 <> 0 then o_orderkey % 4 <> 0 end) is not true then 'measured' end) as failed_gates from orders"
)
def validity_gates(spark, sf_dir):
    k = F.col("o_orderkey")
    gates = an.validity({"finished": F.col("o_orderstatus") != "P", "priced": F.col("o_totalprice") > 1000, "measured": F.when(k % 9 != 0, k % 4 != 0)})
    return docs(spark, sf_dir, "orders").select("o_orderkey", *[c.alias(n) for n, c in gates.items()])


@query("select o_orderpriority, round(median(o_totalprice), 4) as median_price from orders group by 1")
def median_price(spark, sf_dir):
    return docs(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.round(an.median("o_totalprice"), 4).alias("median_price"))


@query("select l_orderkey, case when count(case when l_linenumber <> 6 then l_quantity end) = count(*) then round(sum(l_quantity), 2) end as quantity from lineitem group by 1")
def all_or_nothing_sum(spark, sf_dir):
    rows = docs(spark, sf_dir, "lineitem").withColumn("q", F.when(F.col("l_linenumber") != 6, F.col("l_quantity")))
    return rows.groupBy("l_orderkey").agg(F.round(an.all_or_nothing_sum("q"), 2).alias("quantity"))


@query(
    "with c as (select o_custkey, sum(case when o_orderstatus = 'F' then o_totalprice end) as b, sum(case when o_orderstatus = 'O' then o_totalprice end) as t from orders group by 1) select o_custkey, round(t - b, 2) as diff, round(case when b <> 0 then (t - b) / b * 100 end, 4) as pct from c"
)
def percent_change(spark, sf_dir):
    part = lambda s: F.sum(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice")))
    sums = docs(spark, sf_dir, "orders").groupBy("o_custkey").agg(part("F").alias("b"), part("O").alias("t"))
    return sums.select("o_custkey", F.round(an.difference(F.col("t"), F.col("b")), 2).alias("diff"), F.round(an.percent_change(F.col("t"), F.col("b")), 4).alias("pct"))


@query(
    "select o_custkey, o_orderkey, o_orderpriority from (select *, rank() over (partition by o_custkey order by case o_orderpriority when '1-URGENT' then 1 when '2-HIGH' then 2 when '3-MEDIUM' then 3 end) as r from orders where o_orderpriority in ('1-URGENT', '2-HIGH', '3-MEDIUM')) where r = 1"
)
def class_priority(spark, sf_dir):
    return an.best_class(docs(spark, sf_dir, "orders"), ["o_custkey"], "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM"]).select("o_custkey", "o_orderkey", "o_orderpriority")


PAIRS = "with b as (select o_custkey as k, count(*) as value, max(o_orderpriority) as g from orders where o_orderkey % 2 = 0 group by 1), t as (select o_custkey as k, count(*) as value, max(o_orderpriority) as g from orders where o_orderkey % 2 = 1 group by 1) "


@query(
    PAIRS + "select coalesce(b.k, t.k) as k, case when b.k is null then 'no baseline' when t.k is null then 'no treatment' when b.g is distinct from t.g then 'g differs' else '' end as dropped, case when b.k is not null and t.k is not null and b.g is not distinct from t.g then t.value - b.value end as delta from b full join t on b.k = t.k"
)
def matched_pairs(spark, sf_dir):
    rows = docs(spark, sf_dir, "orders")
    half = lambda r: rows.where(F.col("o_orderkey") % 2 == r).groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("value"), F.max("o_orderpriority").alias("g"))
    return an.matched_pairs(half(0), half(1), "k", ["g"], "value").select("k", F.array_join("dropped", ",").alias("dropped"), "delta")


@query(
    "with s as (select l_orderkey, l_linenumber as ordinal, concat('stage', cast(l_linenumber as varchar)) as stage, l_returnflag <> 'R' as ok from lineitem) select l_orderkey, min_by(stage, case when not ok then ordinal end) as failed_stage, coalesce(min(case when not ok then ordinal end), max(ordinal) + 1) as reached from s group by 1"
)
def funnel(spark, sf_dir):
    rows = docs(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("ordinal"), F.concat(F.lit("stage"), F.col("l_linenumber").cast("string")).alias("stage"), (F.col("l_returnflag") != "R").alias("ok"))
    return an.first_failed_stage(rows, ["l_orderkey"])


@query(
    "with g as (select l_orderkey, list_distinct(list(l_returnflag)) as f from (select l_orderkey, l_returnflag as l_returnflag from lineitem) group by 1) select l_orderkey, len(list_intersect(['A', 'N', 'R'], f)) as hits, round(len(list_intersect(['A', 'N', 'R'], f)) / 3.0, 6) as ratio, len(list_intersect(['A', 'N', 'R'], f)) = 3 as all_found from g"
)
def coverage(spark, sf_dir):
    found = docs(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("f"))
    c = an.coverage(F.col("f"), F.array(*[F.lit(x) for x in "ANR"]))
    return found.select("l_orderkey", F.size(c["hits"]).cast("long").alias("hits"), F.round(c["ratio"], 6).alias("ratio"), c["all_found"].alias("all_found"))


@query(
    "with g as (select conv_id, list_distinct(list(role)) as r from conversations group by 1) select conv_id, round(len(list_intersect(r, ['user', 'tool'])) / cast(len(r) as double), 6) as precision, round(len(list_intersect(['user', 'tool'], r)) / 2.0, 6) as recall from g"
)
def precision_recall(spark, sf_dir):
    seen = docs(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("r"))
    both = an.precision_recall(F.col("r"), F.array(F.lit("user"), F.lit("tool")))
    return seen.select("conv_id", F.round(both["precision"], 6).alias("precision"), F.round(both["recall"], 6).alias("recall"))


@query("select o_custkey, case when count(case when o_orderstatus <> 'P' then 1 end) > 0 then bool_and(o_orderstatus = 'F') filter (o_orderstatus <> 'P') end as correct from orders group by 1")
def three_valued_and(spark, sf_dir):
    rows = docs(spark, sf_dir, "orders").withColumn("c", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "F"))
    return rows.groupBy("o_custkey").agg(an.three_valued_and("c").alias("correct"))


@query(
    "select o_orderkey, case when o_orderkey % 11 = 0 then 'UNUSABLE' when o_orderkey % 7 = 0 then 'BASELINE_INVALID' when o_orderkey % 5 = 0 then 'TREATMENT_INVALID' when o_orderstatus = 'P' then 'CORRECTNESS_UNKNOWN' when o_orderstatus = 'F' and o_orderkey % 3 = 0 then 'WORSE' when o_orderstatus = 'O' and o_orderkey % 3 <> 0 then 'BETTER' when o_orderstatus = 'O' then 'BOTH_WRONG'"
    " when (o_totalprice - 100000) / 100000 * 100 <= -5 then 'BETTER' when (o_totalprice - 100000) / 100000 * 100 >= 5 then 'WORSE' else 'TIE' end as verdict from orders"
)
def verdicts(spark, sf_dir):
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    right = F.when(s != "P", s == "F")
    ruled = an.verdict(k % 11 != 0, k % 7 != 0, k % 5 != 0, right, F.when(s != "P", k % 3 != 0), F.lit(100000.0), F.col("o_totalprice"), 5.0)
    return docs(spark, sf_dir, "orders").select("o_orderkey", ruled.alias("verdict"))


@query("select lang, source, count(*) as n from documents group by 1, 2")
def status_histogram(spark, sf_dir):
    return docs(spark, sf_dir).groupBy("lang", "source").agg(F.count("*").alias("n"))


@query(
    "with l as (select doc_id, o as ordinal, concat('layer', cast(o as varchar)) as layer, case when (doc_id + o) % 5 = 0 then null else doc_id % (o + 2) <> 0 end as present from documents, range(7) t(o))"
    ", p as (select *, last_value(present ignore nulls) over (partition by doc_id order by ordinal rows between unbounded preceding and 1 preceding) as before from l)"
    " select doc_id, min_by(layer, case when not present and coalesce(before, false) then ordinal end) as lost_at, bool_or(coalesce(present, false)) as ever_present from p group by 1"
)
def trace_first_loss(spark, sf_dir):
    o = F.explode(F.sequence(F.lit(0), F.lit(6)))
    rows = docs(spark, sf_dir).select("doc_id", o.alias("ordinal"))
    present = F.when((F.col("doc_id") + F.col("ordinal")) % 5 == 0, F.lit(None)).otherwise(F.col("doc_id") % (F.col("ordinal") + 2) != 0)
    return an.first_loss(rows.select("doc_id", "ordinal", F.concat(F.lit("layer"), F.col("ordinal").cast("string")).alias("layer"), present.alias("present")), ["doc_id"])


# --- checkpoints and what ingest keeps


@query(
    f"with {CKPT}, rq as (select session_id, id, logical_ms as ts_ms, position from tl where hook_event = 'PostToolUseFailure')"
    " select session_id, id from rq r where not exists (select 1 from ck c where c.session_id = r.session_id and (c.checkpoint_id = r.id or c.created_ms >= r.ts_ms))"
    " and not exists (select 1 from tl t where t.session_id = r.session_id and t.position > r.position and ((t.hook_event = 'PreCompact' and t.logical_ms > r.ts_ms) or (t.hook_event = 'SessionStart' and t.source = 'clear')))"
)
def current_requests(spark, sf_dir):
    """Requests at every failed command: which of them no checkpoint has settled and nothing later overtakes."""
    whole = told_once(spark, sf_dir)
    timeline = whole.drop("ts_ms").withColumnRenamed("logical_ms", "ts_ms")
    requests = timeline.where("hook_event = 'PostToolUseFailure'").select("session_id", "id", "ts_ms")
    made = checkpoints(whole).withColumn("watermark", F.col("checkpoint_id"))
    return ck.current_requests(requests, made, timeline).select("session_id", "id")


@query(
    f"with {CKPT} select session_id, checkpoint_id, case when row_number() over (partition by session_id order by created_ms desc, checkpoint_id desc) = 1 then 'PENDING' else 'SUPERSEDED' end as state from ck"
    " union all select session_id, 0 - min(id) as checkpoint_id, 'SUPERSEDED' as state from tl where session_id in (select session_id from ck) group by 1"
)
def checkpoint_freeze(spark, sf_dir):
    """States after all checkpoints of the ledger are frozen, where every session had a live continuation before."""
    timeline = told(spark, sf_dir)
    live = timeline.groupBy("session_id").agg((-F.min("id")).alias("checkpoint_id"))
    return ck.freeze(checkpoints(timeline).withColumn("text", F.col("session_id")), live)[1]


@query(
    f"with {CKPT} select checkpoint_id, sha256(session_id) as digest, cast(octet_length(encode(session_id)) as integer) as bytes from ck"
)
def checkpoint_records(spark, sf_dir):
    made = checkpoints(told(spark, sf_dir)).withColumn("text", F.col("session_id"))
    return ck.freeze(made, made.select("session_id", "checkpoint_id").where("false"))[0].select("checkpoint_id", "digest", "bytes")


@query(
    f"with {LED}, d as (select id, left(sha256(concat(hook_event, '|', session_id, '|d', cast(id % 5 as varchar))), 32) as delivery_key from led where hook_event in ('UserPromptSubmit', 'SessionStart'))"
    " select min(id) as id, delivery_key from d where delivery_key not in (select delivery_key from d where id % 3 = 0) group by 2"
)
def deliver_once(spark, sf_dir):
    """Every third delivery was made before; of the others the first of each key goes out."""
    due = flat(spark, sf_dir).where("hook_event in ('UserPromptSubmit', 'SessionStart')")
    due = due.select("id", ck.delivery_key(F.col("hook_event"), F.col("session_id"), F.concat(F.lit("d"), (F.col("id") % 5).cast("string"))).alias("delivery_key"))
    return ck.undelivered(due, due.where("id % 3 = 0")).select("id", "delivery_key")


@query(
    f"with {CMDS}, e as (select distinct session_id, epoch from tl), s as (select session_id, epoch from tl where prompt like 'task:%' union select session_id, epoch from cmds union select session_id, epoch from tl where post_hash is not null)"
    " select e.session_id, e.epoch, s.session_id is not null as has_state from e left join s on e.session_id = s.session_id and e.epoch = s.epoch"
)
def restorable_epochs(spark, sf_dir):
    """Epochs that a root, a command or an edit gives something to restore."""
    timeline = told_once(spark, sf_dir)
    intents = timeline.where("prompt like 'task:%'").select("session_id", "epoch", F.lit("ROOT").alias("level"), F.lit(None).cast("bigint").alias("superseded_ms"))
    none = intents.where("false")
    return ck.has_state(timeline.select("session_id", "epoch").distinct(), intents, none, folds.commands(timeline), folds.edits(timeline))


@query(f"with {LED} select project_id, session_id, max(ts_ms) as last_ms from led where project_id = 'p3' group by 1, 2")
def workspace_sessions(spark, sf_dir):
    """Sessions of one workspace: the lookup that a restore makes first."""
    sessions = flat(spark, sf_dir).groupBy("project_id", "session_id").agg(F.max("ts_ms").alias("last_ms"))
    return ck.in_workspace(sessions, "p3")


@query(
    f"with {LED}, d as (select *, max(case when not spooled then id end) over (partition by session_id) as d from led)"
    " select session_id, max(case when id = d then ts_ms end) as last_direct_ts, max(case when spooled and (d is null or id > d) then ts_ms end) as max_spooled_ts_since from d group by 1"
)
def ordering_tail(spark, sf_dir):
    return ck.ordering_tail(flat(spark, sf_dir))


@query(
    f"with {CMDS}, r as (select *, case event_id % 7 when 0 then '' when 1 then 'tests' else concat('tests/t', cast(event_id % 5 as varchar), '.py') end as name from cmds where kind = 'test')"
    ", fl as (select session_id, epoch, name, ts_ms, event_id, 0 as nth, concat('tests/t', cast(event_id % 5 as varchar), '.py::test_a') as test_id from r where outcome = 'FAIL'"
    " union all select session_id, epoch, name, ts_ms, event_id, 1, concat('tests/t', cast(event_id % 5 as varchar), '.py::test_', cast(event_id % 8 as varchar)) from r where outcome = 'FAIL')"
    ", t as (select session_id, epoch, test_id, sum(case when name like '%.py' then 2 else 1 end) as failures, min((ts_ms, event_id, nth)) as seen, min((ts_ms, event_id)) as seen_at, max((ts_ms, event_id)) as last_fail, arg_max(event_id, (ts_ms, event_id)) as last_fail_id, arg_max(ts_ms, (ts_ms, event_id)) as last_fail_ms from fl group by 1, 2, 3)"
    ", p as (select session_id, epoch, name, ts_ms, event_id, (ts_ms, event_id) as at from r where outcome = 'PASS')"
    ", j as (select t.session_id, t.epoch, t.test_id, failures, seen, last_fail_id, last_fail_ms, cast(failures + coalesce(sum(case when p.at > seen_at then case when p.name like '%.py' then 2 else 1 end end), 0) as bigint) as focus, arg_max(p.event_id, p.at) filter (where p.at > last_fail) as passed_by"
    " from t left join p on p.session_id = t.session_id and p.epoch = t.epoch and (p.name = '' or starts_with(t.test_id, concat(p.name, '/')) or starts_with(t.test_id, concat(p.name, '::'))) group by t.session_id, t.epoch, t.test_id, failures, seen, seen_at, last_fail, last_fail_id, last_fail_ms)"
    " select session_id, epoch, test_id, cast(row_number() over (partition by session_id, epoch order by focus desc, passed_by is null desc, last_fail_ms desc, seen, test_id) as integer) as rank, focus, passed_by is null as failing, last_fail_id, last_fail_ms, passed_by from j qualify rank <= 6"
)
def test_statuses_top6(spark, sf_dir):
    """Runs that name a file, a directory or nothing; two tests fail in each failing one."""
    runs = folds.commands(told(spark, sf_dir)).where("kind = 'test'")
    file = F.concat(F.lit("tests/t"), (F.col("event_id") % 5).cast("string"), F.lit(".py"))
    names = F.when(F.col("event_id") % 7 == 0, F.array().cast("array<string>")).when(F.col("event_id") % 7 == 1, F.array(F.lit("tests"))).otherwise(F.array(file))
    failed = F.array(F.concat(file, F.lit("::test_a")), F.concat(file, F.lit("::test_"), (F.col("event_id") % 8).cast("string")))
    return ck.test_statuses(runs.withColumns({"runner": F.lit("pytest"), "names": names, "failed": failed}))


@query(
    "with w as (select p_partkey, string_split(p_name, ' ') as o from part), n as (select p_partkey, o, case when p_partkey % 3 = 0 then o else list_concat(o[:p_partkey % 2 + 1], ['changed'], o[p_partkey % 2 + 3:]) end as n from w)"
    ", d as (select p_partkey, o, n, list_min(list_filter(range(1, greatest(len(o), len(n)) + 1), lambda i: o[i] is distinct from n[i])) as i from n)"
    " select p_partkey, case when i is not null then concat_ws(chr(10), '- ' || nullif(o[i], ''), '+ ' || n[i]) end as excerpt, nullif(o[i], '') as removed, n[i] as added from (select p_partkey, o, n, i from d where i is not null) union all select p_partkey, null, null, null from d where i is null"
)
def edit_excerpts(spark, sf_dir):
    """A changed word of each part's name, one word a line."""
    words = docs(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("o"))
    at = (F.col("p_partkey") % 2 + 1).cast("int")
    new = F.when(F.col("p_partkey") % 3 == 0, F.col("o")).otherwise(F.concat(F.slice("o", F.lit(1), at), F.array(F.lit("changed")), F.slice("o", at + 2, F.lit(1000))))
    joined = words.select("p_partkey", F.array_join("o", "\n").alias("old"), F.array_join(new, "\n").alias("new"))
    found = joined.withColumn("excerpt", ingest.first_difference(F.col("old"), F.col("new")))
    return found.select("p_partkey", "excerpt", *[c.alias(n) for n, c in ingest.split_excerpt(F.col("excerpt")).items()])


@query(
    "select p_partkey, case when p_partkey % 4 = 0 then null else concat(repeat('=', case when p_partkey % 7 >= 4 then 3 else p_partkey % 7 end), ' ', p_name, ' ', repeat('-', case when p_partkey % 5 >= 4 then 3 else p_partkey % 5 end)) end as x from part"
)
def compact_rules(spark, sf_dir):
    n = lambda mark, m: F.repeat(F.lit(mark), (F.col("p_partkey") % m).cast("int"))
    line = F.concat(n("=", 7), F.lit(" "), F.when(F.col("p_partkey") % 4 == 0, F.lit("__")).otherwise(F.col("p_name")), F.lit(" "), n("-", 5))
    return docs(spark, sf_dir, "part").select("p_partkey", tx.compact_rules(line).alias("x"))


@query(
    "with v as (select o_custkey % 10 as grp, case o_orderkey % 3 when 0 then 'BETTER' when 1 then 'WORSE' else 'TIE' end as verdict, o_orderkey % 4 <> 0 as comparable, o_totalprice as change from orders)"
    " select grp, count_if(verdict = 'BETTER') as better, count_if(verdict = 'WORSE') as worse, count_if(verdict = 'TIE') as tie, count_if(comparable) as comparable_pairs, round(median(change) filter (where comparable), 4) as median_change from v group by 1"
)
def pooled_verdicts(spark, sf_dir):
    o = docs(spark, sf_dir, "orders")
    verdict = F.when(F.col("o_orderkey") % 3 == 0, "BETTER").when(F.col("o_orderkey") % 3 == 1, "WORSE").otherwise("TIE")
    pairs = o.select((F.col("o_custkey") % 10).alias("grp"), verdict.alias("verdict"), (F.col("o_orderkey") % 4 != 0).alias("comparable"), F.col("o_totalprice").alias("change"))
    return an.pooled_verdicts(pairs, ["grp"], ["BETTER", "WORSE", "TIE"]).withColumn("median_change", F.round("median_change", 4))


@query(
    "with s as (select o_orderkey, o_orderkey % 6 as a, o_custkey % 6 as b from orders), n as (select *, greatest(case when a = 5 then 4 else a end, case when b = 5 then 4 else b end) as w from s)"
    " select o_orderkey, ['MEASURED', 'DERIVED', 'ESTIMATED', 'INCONCLUSIVE', 'UNAVAILABLE'][w + 1] as status from n"
)
def weakest_status(spark, sf_dir):
    """The status of a figure made from two others; an unknown one counts as unavailable."""
    of = lambda c: F.get(F.array(*[F.lit(x) for x in an.STATUSES]), (F.col(c) % 6).cast("int"))
    return docs(spark, sf_dir, "orders").select("o_orderkey", an.weakest_status(of("o_orderkey"), of("o_custkey")).alias("status"))


@query(
    f"with {TL}, m as (select session_id, epoch, position, id, prompt as text from tl where prompt is not null and id % 2 = 0), n as (select * from m qualify row_number() over (partition by session_id, epoch order by position desc) <= 12)"
    ", c as (select *, case when id % 3 = 0 then concat(text, ' in src/a.py') else text end as said from n)"
    " select session_id, epoch, id from c where id % 3 = 0 qualify row_number() over (partition by session_id, epoch order by position desc) = 1"
)
def earlier_code_message(spark, sf_dir):
    """Every second prompt counts as superseded, every third of these names a file."""
    said = told(spark, sf_dir).where("prompt is not null and id % 2 = 0")
    text = F.when(F.col("id") % 3 == 0, F.concat("prompt", F.lit(" in src/a.py"))).otherwise(F.col("prompt"))
    intents = said.select("session_id", "epoch", "position", "id", text.alias("text"), F.lit("LATEST").alias("level"), F.col("logical_ms").alias("superseded_ms"))
    return ranking.earlier_code_message(intents).select("session_id", "epoch", "id")
