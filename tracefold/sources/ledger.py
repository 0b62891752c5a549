"""The event ledger: its schema, raw payload readers, deduplicated append, spool and transcript sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ingest
from ..functions.authored import authored
from ..functions.redact import redact
from ..functions.text import let, truncate_chars
from .heads import read_heads

EVENT = "id bigint, dedupe_key string, session_id string, project_id string, agent_id string, hook_event string, tool_name string, tool_use_id string, ts_ms bigint, payload string"
OBSERVED = "array<struct<path:string,hash:string,size:bigint>>"
PAYLOAD = (
    "prompt string, prompt_id string, prompt_truncated boolean, spooled boolean, turn_scan " + OBSERVED + ", source string, model string, transcript_path string, reason string, "
    "trigger string, summary string, path string, pre_hash string, post_hash string, size bigint, lines_added int, lines_removed int, excerpt string, original_hash string, "
    "pattern string, command string, cwd string, exit_code bigint, interrupted boolean, stdout_tail string, stderr_tail string, error string, tool_name string, "
    f"git struct<restore:string,commit:boolean,files:{OBSERVED}>"
)
#: Read from their own JSON text, so that one that does not parse leaves the rest of the payload alone.
MENTIONED = "array<struct<path:string,line:int,raw:string>>"
EDIT_TOOLS = ("Edit", "Write", "MultiEdit", "NotebookEdit")
SHELL_TOOLS = ("Bash", "PowerShell")


def dedupe_key(hook_event: Column, session_id: Column, tool_use_id: Column, prompt_id: Column, ts_ms: Column, agent_id: Column) -> Column:
    """Identity of an observation; the clock counts only where no tool call names it."""
    known = F.coalesce(tool_use_id, F.lit("")) != ""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    when = F.when(known, F.lit("")).otherwise(text(ts_ms))
    return F.substring(F.sha2(F.concat_ws("|", text(hook_event), text(session_id), text(tool_use_id), text(prompt_id), when, text(agent_id)), 256), 1, 32)


def first_of_each(events: DataFrame) -> DataFrame:
    """One row per dedupe_key, that of the smallest id."""
    order = Window.partitionBy("dedupe_key").orderBy("id")
    return events.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


def append(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """The rows of incoming that the ledger does not hold yet; the caller writes them."""
    return first_of_each(incoming).join(existing.select("dedupe_key"), "dedupe_key", "left_anti")


def parsed(events: DataFrame) -> DataFrame:
    """events with payload fields as columns; a payload that is not JSON is an empty one, and a prompt is what the user wrote of it."""
    p = F.from_json("payload", PAYLOAD)
    mentioned = F.from_json(F.get_json_object("payload", "$.mentioned"), MENTIONED)
    wide = events.withColumns({"__p": p, "mentioned": mentioned})
    names = [f.split(" ")[0] for f in ("prompt,prompt_id,source,transcript_path,reason,trigger,summary,path,pre_hash,post_hash,size,lines_added,lines_removed,excerpt,command,cwd,exit_code,interrupted,stdout_tail,stderr_tail,error,git,turn_scan").split(",")]
    read = {n: F.col(f"__p.{n}") for n in names}
    return wide.withColumns(read | {"prompt": authored(read["prompt"]), "spooled": F.coalesce(F.col("__p.spooled"), F.lit(False))}).drop("__p")


def read_hooks(spark: SparkSession, path: str) -> DataFrame:
    """Hook payloads, a JSON object per line, as ledger rows without ids; what does not parse becomes a ``malformed`` event.

    Credentials are redacted before anything is cut or stored: prompts, commands, errors and summaries keep their beginning, output its end, edits the first
    lines that differ. A payload has at most 16 KiB (after a compaction 48). Session ids are salvaged from broken text. ``ts_ms`` is the payload's own,
    else null for the caller to fill.
    """
    raw = spark.read.text(path).select(F.regexp_replace("value", "^\\uFEFF", "").alias("raw")).where(F.trim("raw") != "")
    at = lambda *names: F.coalesce(*[F.get_json_object("raw", f"$.{n}") for n in names])
    whole = F.try_parse_json("raw").isNotNull() & F.trim("raw").startswith("{")
    salvaged = F.nullif(F.regexp_extract("raw", r'"session_id"\s*:\s*"([^"]*)"', 1), F.lit(""))
    error = at("error", "error_message")
    response = lambda n: at(f"tool_response.{n}", f"tool_output.{n}")
    fields = {
        "prompt": ingest.redact_head(authored(at("prompt")), ingest.PROMPT_BYTES), "prompt_id": at("prompt_id"), "source": at("source"), "model": at("model"), "transcript_path": at("transcript_path"),
        "reason": at("reason"), "trigger": at("trigger"), "summary": ingest.redact_head(at("compact_summary", "summary"), ingest.SUMMARY_BYTES),
        "path": at("tool_input.file_path", "tool_input.path", "tool_input.notebook_path"), "pattern": let(let(at("tool_input.pattern"), redact), lambda x: truncate_chars(x, ingest.PATTERN_CHARS)),
        "command": ingest.redact_head(at("tool_input.command"), ingest.COMMAND_BYTES), "cwd": at("cwd"), "error": ingest.redact_head(error, ingest.ERROR_BYTES),
        "exit_code": F.coalesce(at("exit_code", "exitCode", "tool_response.exit_code", "tool_response.exitCode").try_cast("bigint"), F.regexp_extract(error, r"^Exit code (-?\d+)", 1).try_cast("bigint")),
        "interrupted": response("interrupted").try_cast("boolean"), "stdout_tail": ingest.redact_tail(response("stdout"), ingest.TAIL_BYTES), "stderr_tail": ingest.redact_tail(response("stderr"), ingest.TAIL_BYTES),
        "excerpt": edit_excerpt(), **edit_lines(),
    }
    limit = F.when(at("hook_event_name") == "PostCompact", ingest.LATE_PAYLOAD_BYTES).otherwise(ingest.PAYLOAD_BYTES)
    payload = F.to_json(ingest.within_budget(fields, limit))
    return raw.select(
        F.when(whole, at("session_id")).otherwise(salvaged).alias("session_id"), at("cwd").alias("project_root"), at("agent_id").alias("agent_id"),
        F.when(whole, at("hook_event_name")).otherwise("malformed").alias("hook_event"), at("tool_name").alias("tool_name"), at("tool_use_id").alias("tool_use_id"),
        at("ts_ms").try_cast("bigint").alias("ts_ms"), F.when(whole, payload).otherwise("{}").alias("payload"),
    )


def edit_lines() -> dict[str, Column]:
    """Lines added and removed by an edit tool's input: whole contents only add, several edits sum."""
    from ..functions.text import line_count

    at = lambda n: F.get_json_object("raw", f"$.tool_input.{n}")
    n = lambda c: F.coalesce(line_count(c), F.lit(0))
    many = F.from_json(at("edits"), "array<struct<old_string:string,new_string:string>>")
    total = lambda part: F.aggregate(many, F.lit(0), lambda acc, x: acc + n(x[part]))
    whole = F.coalesce(at("content"), at("new_source"))
    return {
        "lines_added": F.when(many.isNotNull(), total("new_string")).when(whole.isNotNull(), n(whole)).when(at("new_string").isNotNull(), n(at("new_string"))),
        "lines_removed": F.when(many.isNotNull(), total("old_string")).when(whole.isNotNull(), F.lit(0)).when(at("new_string").isNotNull(), n(at("old_string"))),
    }


def edit_excerpt() -> Column:
    """The first lines that differ in an edit tool's input: of the first of several edits, none of whole contents."""
    at = lambda n: F.get_json_object("raw", f"$.tool_input.{n}")
    many = at("edits").isNotNull()
    old, new = F.when(many, at("edits[0].old_string")).otherwise(at("old_string")), F.when(many, at("edits[0].new_string")).otherwise(at("new_string"))
    whole = F.get_json_object("raw", "$.tool_name").isin("Write", "NotebookEdit")
    return F.when(old.isNotNull() & ~F.coalesce(whole, F.lit(False)), ingest.first_difference(old, F.coalesce(new, F.lit(""))))


#: Fixed value: how long a spooled file that does not parse may still be written to.
GRACE_MS = 5_000


def spooled(raw: DataFrame, now_ms: Column) -> DataFrame:
    """raw (file, modified, raw) with the ledger's fields, and fate: EVENT; WAIT, a young file that does not parse yet; QUARANTINE, one that never will.

    A whole record that is no event (no session, a payload that is no object) is quarantined at once.
    """
    body = F.get_json_object("raw", "$.payload")
    whole = F.try_parse_json("raw").isNotNull()
    good = whole & F.coalesce(body.startswith("{"), F.lit(False)) & F.get_json_object("raw", "$.session_id").isNotNull()
    young = now_ms - F.unix_millis("modified") <= GRACE_MS
    fate = F.when(good, "EVENT").when(~whole & young, "WAIT").otherwise("QUARANTINE")
    fields = [f.split(" ") for f in EVENT.split(", ") if not f.startswith(("id ", "payload "))]
    return raw.select("file", "raw", "modified", fate.alias("fate"), *[F.get_json_object("raw", f"$.{n}").try_cast(t).alias(n) for n, t in fields], body.alias("payload"))


def spool_files(reader, path: str | list[str]) -> DataFrame:
    """(file, modified, raw) of one-event files, by spark.read or spark.readStream."""
    return reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified"), F.trim("value").alias("raw"))


def read_spool(spark: SparkSession, path: str, now_ms: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(events, quarantined): spooled one-event files; what is no event goes to quarantine with its file, what may still be written to stays."""
    now = F.unix_millis(F.current_timestamp()) if now_ms is None else now_ms
    told = spooled(spool_files(spark.read, path), now).withColumn("file", F.regexp_extract("file", r"([^/]+)$", 1))
    names = [f.split(" ")[0] for f in EVENT.split(", ") if not f.startswith("id ")]
    return told.where("fate = 'EVENT'").select("file", *names), told.where("fate = 'QUARANTINE'").select("file", "raw")


def read_transcripts(spark: SparkSession, path: str, head: int = 256 * 1024) -> DataFrame:
    """(session_id, modified, bytes, title, cwd) of transcript files, read at their head only: its last, cut line does not count."""
    files = read_heads(spark, path, head, ".jsonl")
    text = F.decode("head", "UTF-8")
    whole = F.when(F.col("bytes") > head, F.regexp_replace(text, r"[^\n]*\z", "")).otherwise(text)
    lines = files.select(F.regexp_extract("path", r"([^/]+)\.jsonl$", 1).alias("session_id"), "modified", "bytes", F.posexplode_outer(F.split(whole, "\n")).alias("n", "line"))
    at = lambda n: F.get_json_object("line", f"$.{n}")
    said = F.coalesce(F.get_json_object("line", "$.message.content[0].text"), at("message.content"))
    own = (at("type") == "user") & (F.coalesce(at("isMeta"), F.lit("false")) != "true") & (F.coalesce(at("isSidechain"), F.lit("false")) != "true")
    by_line = lambda value, keep: F.min_by(value, F.when(keep & value.isNotNull(), F.col("n")))
    title = F.coalesce(by_line(at("aiTitle"), at("type") == "ai-title"), by_line(said, own))
    return lines.groupBy("session_id", "modified", "bytes").agg(F.trim(F.regexp_replace(title, r"\s+", " ")).alias("title"), by_line(at("cwd"), F.lit(True)).alias("cwd"))


def stream_spool(spark: SparkSession, path: str, out_dir: str, checkpoint_dir: str, files_per_trigger: int = 32, now_ms: Column | None = None):
    """A query that ingests spooled files as they come, so many in a batch, into events and quarantine; it stops when it has read what is there.

    A file stream reads a file once, so one that may still be written is noted down, and looked at again by every batch until it parses or
    is too old. Each batch writes folders of its own number by overwriting: one that runs again after a loss changes nothing. Files that were
    ingested are listed in ``events``; whoever owns the folder may delete these.
    """
    now = F.unix_millis(F.current_timestamp()) if now_ms is None else now_ms
    names = [f.split(" ")[0] for f in EVENT.split(", ") if not f.startswith("id ")]

    def run(batch: DataFrame, number: int) -> None:
        new = batch.withColumn("again", F.lit(False))
        waiting = []
        if number:
            before = spark.read.schema("file string").parquet(f"{out_dir}/waiting/batch={number - 1}")
            waiting = [r["file"] for r in before.collect()]  # files younger than GRACE_MS when the last batch ran
        if waiting:
            again = spool_files(spark.read.option("ignoreMissingFiles", "true"), waiting)
            new = new.unionByName(again.withColumn("again", F.lit(True)))
        told = spooled(new, now).persist()
        put = lambda df, name: df.write.mode("overwrite").parquet(f"{out_dir}/{name}/batch={number}")
        put(told.where("fate = 'EVENT'").select("file", *names), "events")
        put(told.where("fate = 'QUARANTINE'").select("file", "raw"), "quarantine")
        put(told.where("fate = 'WAIT'").select("file"), "waiting")
        told.unpersist()

    files = spool_files(spark.readStream.option("maxFilesPerTrigger", files_per_trigger), path)
    return files.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()


def write_spool(events: DataFrame, path: str) -> None:
    """Late events, a file each, marked as spooled; read_spool reads them back. A payload that is no object is written as an empty one."""
    object_only = F.when(F.ltrim("payload").startswith("{"), F.try_parse_json("payload")).cast("map<string,variant>")
    own = F.map_filter(F.coalesce(object_only, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>"))), lambda k, _: k != "spooled")
    body = F.to_json(F.map_concat(F.create_map(F.lit("spooled"), F.parse_json(F.lit("true"))), own))
    rest = F.to_json(F.struct(*[c for c in events.columns if c != "payload"]))
    line = F.concat(F.regexp_replace(rest, r"\}$", ""), F.lit(',"payload":'), body, F.lit("}"))
    events.select(line.alias("value")).write.option("maxRecordsPerFile", 1).mode("append").text(path)


def read_staged(spark: SparkSession, path: str) -> DataFrame:
    """(session_id, generation, record): the newest readable record of each session among files named <anything>-<generation>.json."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)\.json$", 1).try_cast("bigint").alias("generation"), F.trim("value").alias("record"))
    session = F.get_json_object("record", "$.session_id")
    good = raw.where(F.try_parse_json("record").isNotNull() & session.isNotNull() & F.col("generation").isNotNull())
    return good.groupBy(session.alias("session_id")).agg(F.max("generation").alias("generation"), F.max_by("record", "generation").alias("record"))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, malformed): a JSON object per line by schema; lines that do not parse come back whole with their file, blank ones not at all."""
    raw = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), "value").where(F.trim("value") != "")
    whole = F.try_parse_json("value").isNotNull() & F.ltrim("value").startswith("{")
    rows = raw.where(whole).select(F.from_json("value", schema).alias("r")).select("r.*")
    return rows, raw.where(~F.coalesce(whole, F.lit(False)))


def documents(df: DataFrame) -> DataFrame:
    """(value): a JSON document per row, absent fields as null, for a text sink."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def write_documents(df: DataFrame, path: str) -> None:
    documents(df).write.mode("errorifexists").text(path)
