"""A ledger made from the driver's events table by arithmetic that Spark and DuckDB share, so that queries exercise every branch.

Every seventh event is late (spooled, up to ten hours back), the clock of every tenth user runs backwards now and then, prompts open
epochs and subtasks, files return to earlier contents, commands fail and pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.order import timeline
from ..sources.ledger import dedupe_key, parsed
from ..sources.tables import written

#: Expressions both engines read alike; ``ms`` is the clock in milliseconds.
COLUMNS = {
    "id": "event_id",
    "session_id": "concat('s', cast(user_id as varchar(20)))",
    "project_id": "concat('p', cast(user_id % 7 as varchar(20)))",
    "spooled": "event_id % 7 = 3",
    "ts_ms": "ms - case when event_id % 7 = 3 then (event_id % 11) * 3600000 when user_id % 10 = 0 and event_id % 5 = 0 then 7200000 else 0 end",
    "hook_event": "case when event_type = 'purchase' then 'UserPromptSubmit' when event_type = 'error' and event_id % 3 = 0 then 'PostToolUseFailure' "
    "when event_type = 'signup' and event_id % 4 = 1 then 'PreCompact' when event_type = 'signup' then 'SessionStart' else 'PostToolUse' end",
    "tool_name": "case when event_type = 'click' and event_id % 3 = 0 then 'Write' when event_type = 'click' then 'Edit' when event_type = 'view' then 'Read' when event_type = 'error' then 'Bash' end",
    "tool_use_id": "case when event_type in ('click', 'view', 'error') then concat('t', cast(event_id as varchar(20))) end",
    "source": "case when event_type = 'signup' and event_id % 4 <> 1 then case when event_id % 13 = 0 then 'clear' when event_id % 13 < 4 then 'compact' else 'startup' end end",
    "path": "case when event_type in ('click', 'view') then concat(case when event_id % 17 = 0 then 'node_modules/' when event_id % 19 = 0 then '../' else 'src/' end, 'f', cast((event_id * 7) % 23 as varchar(20)), '.py') end",
    "post_hash": "case when event_type = 'click' then md5(concat('f', cast((event_id * 7) % 23 as varchar(20)), '-', cast(event_id % 3 as varchar(20)))) end",
    "command": "case when event_type = 'error' then case event_id % 4 when 0 then concat('pytest tests/t', cast(event_id % 5 as varchar(20)), '.py') when 1 then 'cargo build' when 2 then 'ruff check src' else 'ls -la' end end",
    "stdout_tail": "case when event_type = 'error' and event_id % 3 <> 0 then case when event_id % 2 = 0 then '3 passed in 0.2s' else '1 failed, 2 passed' end end",
    "error": "case when event_type = 'error' and event_id % 3 = 0 then concat('Exit code 1', chr(10), 'collected 3 items', chr(10), 'E   assert ', cast(event_id % 90 as varchar(20)), ' == 0') end",
    "m_path": "case when event_type = 'error' then concat('src/f', cast(event_id % 23 as varchar(20)), '.py') end",
    "prompt": "case when event_type = 'purchase' then case event_id % 6 when 0 then concat('task: build part ', cast(event_id % 50 as varchar(20))) when 1 then concat('subtask: check module ', cast(event_id % 50 as varchar(20))) "
    "when 2 then concat('short ', cast(event_id % 10 as varchar(20))) when 3 then '/help' else concat('please change module number ', cast(event_id % 50 as varchar(20)), ' today') end end",
}

LED = "led as (select " + ", ".join(f"{e} as {n}" for n, e in COLUMNS.items()) + " from (select *, epoch_us(ts) // 1000 as ms from events))"
TL = (
    LED + ", anch as (select e.*, case when not spooled then id else coalesce((select max(d.id) from led d where d.session_id = e.session_id and not d.spooled and d.id < e.id and d.ts_ms <= e.ts_ms), -1) end as anchor from led e)"
    ", pos as (select *, row_number() over (partition by session_id order by anchor, spooled, case when spooled then ts_ms end, id) as position from anch)"
    ", tl as (select *, max(ts_ms) over w as logical_ms, 1 + cast(sum(case when source = 'clear' or prompt like 'task:%' then 1 else 0 end) over w as integer) as epoch,"
    " cast(coalesce(sum(case when prompt is not null then 1 else 0 end) over (partition by session_id order by position rows between unbounded preceding and 1 preceding), 0) as integer) as prompt_ordinal"
    " from pos window w as (partition by session_id order by position rows between unbounded preceding and current row))"
)
CMDS = (
    TL + ", cmds as (select session_id, epoch, position, id as event_id, case id % 4 when 0 then 'test' when 1 then 'build' when 2 then 'lint' else 'other' end as kind,"
    " concat(case id % 4 when 0 then 'test:' when 1 then 'build:' when 2 then 'lint:' else 'other:' end, command) as signature, command as command_text,"
    " case when hook_event = 'PostToolUseFailure' then 'FAIL' when id % 4 = 3 then 'UNKNOWN' when id % 2 = 0 then 'PASS' else 'FAIL' end as outcome, logical_ms as ts_ms, m_path from tl where command is not null)"
)
EDITS = TL + ", eds as (select session_id, epoch, position, id as event_id, path, tool_name, post_hash, logical_ms as ts_ms from tl where post_hash is not null)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger rows (sources.ledger.EVENT) from the events table."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    wide = raw.select(*[F.expr(e).alias(n) for n, e in COLUMNS.items()])
    mentioned = F.when(F.col("m_path").isNotNull(), F.array(F.struct(F.col("m_path").alias("path"), (F.col("id") % 90).cast("int").alias("line"), F.col("m_path").alias("raw"))))
    payload = F.to_json(F.struct("spooled", "source", "path", "post_hash", "command", "stdout_tail", "error", "prompt", mentioned.alias("mentioned")))
    key = dedupe_key(F.col("hook_event"), F.col("session_id"), F.col("tool_use_id"), F.lit(None), F.col("ts_ms"), F.lit(None))
    return wide.select("id", key.alias("dedupe_key"), "session_id", "project_id", F.lit(None).cast("string").alias("agent_id"), "hook_event", "tool_name", "tool_use_id", "ts_ms", payload.alias("payload"))


def flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(events(spark, sf_dir))


def told(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline(flat(spark, sf_dir))


def told_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The timeline as a table, for queries that read it more than once."""
    return written(told(spark, sf_dir))
