"""The life of every edit: a fold over each file's observations in logical order.

All the state that a step reads belongs to one (session, path), so that is the group: a session's files fold in parallel.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.git import reached, restore_targets

SETTLED = frozenset(("post_edit", "git_post", "turn_scan"))
HISTORY = 256
DIGEST = re.compile(r"[0-9a-f]{32}")
FATES = "session_id string, path string, event_id bigint, status string, mechanism string, resolved_event_id bigint"
DEAD = "session_id string, path string, id bigint, edit_ids array<bigint>, mechanism string, from_ms bigint, resolved_ms bigint, reapplied boolean"
#: Statuses of edits and dead ends over time: what holds from from_ms on, until until_ms (null: still).
HISTORY_ROWS = "session_id string, path string, event_id bigint, dead_end_id bigint, edit_ids array<bigint>, status string, mechanism string, from_ms bigint, until_ms bigint"
BOTH = "session_id string, path string, event_id bigint, status string, mechanism string, resolved_event_id bigint, id bigint, edit_ids array<bigint>, from_ms bigint, resolved_ms bigint, reapplied boolean"


class FileFold:
    """The edits and dead ends of one file, observation by observation; a step costs what it changes, not what has been."""

    def __init__(self) -> None:
        self.versions: deque[tuple[str, str, int, int]] = deque(maxlen=HISTORY)  # hash, source, event, ts
        self.seen = 0
        self.last: dict[str, int] = {}  # hash: number of its last version
        self.edits: dict[int, dict] = {}
        self.active: dict[int, dict] = {}  # in order of the edits
        self.committed = -1  # number of the last committed edit
        self.dead: list[dict] = []
        self.undone: dict[str, list[dict]] = {}  # hash: dead ends that hold it and are not reapplied
        self.history: list[tuple[int, str, str | None, int]] = []  # edit, status, mechanism, since when

    def becomes(self, e: dict, ts: int, **more) -> None:
        e.update(more)
        self.history.append((e["event_id"], e["status"], e["mechanism"], ts))

    def resolve(self, these: list[dict], status: str, mechanism: str, event: int, ts: int) -> None:
        for e in these:
            self.becomes(e, ts, status=status, mechanism=mechanism, resolved_event_id=event)
            del self.active[e["event_id"]]
        end = {"id": event, "edit_ids": [e["event_id"] for e in these], "mechanism": mechanism, "from_ms": min(e["ts"] for e in these), "resolved_ms": ts, "reapplied": False, "reapplied_ms": None, "n": len(self.dead)}
        self.dead.append(end)
        for h in {e["hash"] for e in these}:
            self.undone.setdefault(h, []).append(end)

    def step(self, event: int, ts: int, raw: int, source: str, h: str, tool: str | None, restore: bool, commit: bool) -> None:
        if source == "git_post" and restore:
            loose = [e for e in self.active.values() if e["n"] > self.committed]
            if loose and h != loose[-1]["hash"]:
                self.resolve(loose, "DISCARDED", "git_command", event, ts)
        if source == "git_post" and commit:
            upto = max((e["n"] for e in self.active.values() if e["hash"] == h), default=-1)
            for e in [e for e in self.active.values() if e["n"] <= upto]:
                self.becomes(e, ts, status="COMMITTED", resolved_event_id=event)
                self.committed = max(self.committed, e["n"])
                del self.active[e["event_id"]]
        newest = self.versions[-1] if self.versions else None
        back = self.last.get(h, -1)
        between = list(self.versions)[back - self.seen + 1 :] if self.seen - HISTORY <= back < self.seen - 1 and back >= 0 else []
        known = back >= max(0, self.seen - HISTORY)
        self.versions.append((h, source, event, ts))
        self.last[h], self.seen = self.seen, self.seen + 1
        if len(self.last) > 4 * HISTORY:
            self.last = {k: v for k, v in self.last.items() if v >= self.seen - HISTORY}
        if source == "post_edit":
            self.edits[event] = self.active[event] = {"event_id": event, "hash": h, "ts": ts, "status": "ACTIVE", "mechanism": None, "resolved_event_id": None, "n": len(self.edits)}
            self.becomes(self.edits[event], ts)
        if newest is None or newest[0] == h:
            return
        if newest[3] > raw:  # logical times never fall: late knowledge must not undo what came after
            return
        if source in SETTLED and DIGEST.fullmatch(h):
            again = min((d for d in self.undone.get(h, ()) if not d["reapplied"] and ts >= d["resolved_ms"]), key=lambda d: d["n"], default=None)
            if again:
                again.update(reapplied=True, reapplied_ms=ts)
                self.undone[h].remove(again)
                for i in again["edit_ids"]:
                    self.becomes(self.edits[i], ts, status="REAPPLIED")
                    self.active.pop(i, None)
                return
        elif h != "absent":
            if not DIGEST.fullmatch(h):
                return
        if not known:
            return
        these = {v[2] for v in between if v[1] == "post_edit"}
        undone = [self.active[i] for i in sorted(these & self.active.keys(), key=lambda i: self.active[i]["n"]) if i != event]
        if undone:
            how = "git_command" if source == "git_post" and restore else "rewrite" if source == "post_edit" and tool == "Write" else "inverse_edit" if source == "post_edit" else "external"
            self.resolve(undone, "REVERTED", how, event, ts)


def fold_file(rows: list[dict]) -> tuple[list[dict], list[dict]]:
    """Edits and dead ends of one file. rows in order: event_id, ts_ms (logical), raw_ms, source, hash, tool, restore, commit."""
    fold = FileFold()
    for r in rows:
        fold.step(r["event_id"], r["ts_ms"], r["raw_ms"], r["source"], r["hash"], r["tool"], r["restore"], r["commit"])
    return list(fold.edits.values()), fold.dead


def observations(timeline: DataFrame, root: Column | None = None) -> DataFrame:
    """What each event says about a file's content: states before and after edits, after git commands, and at turn ends.

    A git command restores only the files that its words are sure to reach. root: the project's folder, by default the first working folder of the session.
    """
    base = ["session_id", "position", F.col("id").alias("event_id"), F.col("logical_ms").alias("ts_ms"), F.col("ts_ms").alias("raw_ms"), F.col("tool_name").alias("tool")]
    none = F.lit(False)
    one = lambda df, path, source, h, restore=none, commit=none, n=0: df.select(*base, path.alias("path"), F.lit(source).alias("source"), h.alias("hash"), restore.alias("restore"), commit.alias("commit"), F.lit(n).alias("n"))
    edit = timeline.where("path is not null")
    first = Window.partitionBy("session_id").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    calls = timeline.where("git is not null or cwd is not null").withColumn("__root", F.first("cwd", ignorenulls=True).over(first) if root is None else root).where("git is not null")
    calls = calls.withColumn("__to", F.when(F.col("git.restore").isNotNull(), restore_targets(F.col("command"), F.col("cwd"), F.col("__root"))))
    git = calls.withColumn("__f", F.explode("git.files")).withColumn("__reached", reached(F.col("__to"), F.col("__f.path"), F.col("__root")))
    scan = timeline.where("turn_scan is not null").withColumn("__f", F.explode("turn_scan"))
    parts = [
        one(edit.where("pre_hash is not null"), F.col("path"), "pre_edit", F.col("pre_hash")),
        one(edit.where("post_hash is not null"), F.col("path"), "post_edit", F.col("post_hash"), n=1),
        one(git, F.col("__f.path"), "git_post", F.col("__f.hash"), F.col("__reached"), F.coalesce(F.col("git.commit"), none), 2),
        one(scan, F.col("__f.path"), "turn_scan", F.col("__f.hash"), n=3),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("hash is not null and path is not null")


def fates_and_dead_ends(session: str, path: str, fold: FileFold) -> Iterator[tuple]:
    for e in fold.edits.values():
        yield session, path, e["event_id"], e["status"], e["mechanism"], e["resolved_event_id"], None, None, None, None, None
    for d in fold.dead:
        yield session, path, None, None, d["mechanism"], None, d["id"], d["edit_ids"], d["from_ms"], d["resolved_ms"], d["reapplied"]


def statuses_over_time(session: str, path: str, fold: FileFold) -> Iterator[tuple]:
    after: dict[int, int] = {}
    rows = []
    for event, status, mechanism, ts in reversed(fold.history):
        rows.append((session, path, event, None, None, status, mechanism, ts, after.get(event)))
        after[event] = ts
    yield from reversed(rows)
    for d in fold.dead:
        yield session, path, None, d["id"], d["edit_ids"], "UNDONE", d["mechanism"], d["resolved_ms"], d["reapplied_ms"]
        if d["reapplied"]:
            yield session, path, None, d["id"], d["edit_ids"], "REAPPLIED", d["mechanism"], d["reapplied_ms"], None


def folded(observed: DataFrame, rows_of=fates_and_dead_ends, schema: str = BOTH) -> DataFrame:
    """What rows_of makes of every file's fold. By default both results in one table: rows with event_id are fates of edits, rows with id dead ends.

    Files are dealt by (session, path) and come sorted; a task streams them and holds one file's fold at a time.
    """
    order = ["session_id", "path", "position", "n", "event_id"]
    columns = [f.split(" ")[0] for f in schema.split(", ")]
    whole = [f.split(" ")[0] for f in schema.split(", ") if f.endswith(" bigint")]
    read = [*order, "ts_ms", "raw_ms", "source", "hash", "tool", "restore", "commit"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, fold, out = None, FileFold(), []

        def frame(rows: list[tuple]) -> pd.DataFrame:
            made = pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in zip(columns, zip(*rows, strict=True), strict=True)})
            return made.astype(dict.fromkeys(whole, "Int64"))

        for part in frames:
            for session, path, _, _, event, ts, raw, source, h, tool, restore, commit in zip(*(part[c].tolist() for c in read), strict=True):
                if (session, path) != key:
                    if key is not None:
                        out += rows_of(*key, fold)
                    key, fold = (session, path), FileFold()
                    if len(out) > 50_000:
                        yield frame(out)
                        out = []
                fold.step(event, ts, raw, source, h, tool, restore, commit)
        if key is not None:
            out += rows_of(*key, fold)
        if out:
            yield frame(out)

    return observed.select(*read).repartition("session_id", "path").sortWithinPartitions(*order).mapInPandas(run, schema)


def histories(observed: DataFrame) -> DataFrame:
    """HISTORY_ROWS: every status that an edit or dead end ever had, with the time in which it held."""
    return folded(observed, statuses_over_time, HISTORY_ROWS)


def lifecycle(observed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fates of edits, dead ends) from observations."""
    both = folded(observed)
    fates = both.where("event_id is not null").select(*[f.split(" ")[0] for f in FATES.split(", ")])
    return fates, both.where("id is not null").select(*[f.split(" ")[0] for f in DEAD.split(", ")])


def members(dead: DataFrame, edits: DataFrame) -> DataFrame:
    """Dead ends with their edits looked up by id: any by a subagent, and the excerpts in order of the ids."""
    one = dead.select("session_id", "id", F.posexplode("edit_ids").alias("n", "event_id"))
    found = one.join(edits.select("session_id", "event_id", "agent_id", "excerpt"), ["session_id", "event_id"])
    return found.groupBy("session_id", "id").agg(
        F.count("*").alias("members"), F.max(F.col("agent_id").isNotNull()).alias("subagent"),
        F.transform(F.array_sort(F.collect_list(F.struct("n", "excerpt"))), lambda x: x["excerpt"]).alias("excerpts"),
    )


def evidence(parts: DataFrame) -> DataFrame:
    """(session_id, id, event_id, removed, added): the change that a dead end is shown with. parts: session_id, id, n, event_id, removed, added, in order of n.

    The change is the first whose added line no later one took out again; what it removed is followed back through the steps whose added line it was.
    Lines meet in windows over (dead end, line), and the way back is a walk over an array of pointers: linear in a dead end's edits.
    """
    some = parts.where("removed is not null or added is not null").select("session_id", "id", "n", "event_id", "removed", "added")
    # each part comes once for the line that it adds, once for the line that it removes
    sides = F.array(F.struct(F.lit(True).alias("adds"), F.col("added").alias("line")), F.struct(F.lit(False).alias("adds"), F.col("removed").alias("line")))
    each = some.select("session_id", "id", "n", F.explode(sides).alias("x")).select("session_id", "id", "n", "x.*").where("line is not null")
    whole = Window.partitionBy("session_id", "id", "line")
    before = whole.orderBy("n").rangeBetween(Window.unboundedPreceding, -1)
    told = each.withColumns({"taken": F.max(F.when(~F.col("adds"), F.col("n"))).over(whole), "from": F.max(F.when(F.col("adds"), F.col("n"))).over(before)})
    facts = told.groupBy("session_id", "id", "n").agg(F.max(F.when(F.col("adds"), F.col("taken") > F.col("n"))).alias("replaced"), F.max(F.when(~F.col("adds"), F.col("from"))).alias("from"))
    row = F.struct("n", "event_id", "removed", "added", F.coalesce("replaced", F.lit(False)).alias("replaced"), F.col("from"))
    dead = some.join(facts, ["session_id", "id", "n"], "left").groupBy("session_id", "id").agg(F.array_sort(F.collect_list(row)).alias("p"))
    first = F.get(F.filter("p", lambda x: ~x["replaced"]), F.lit(0))
    by_n = F.map_from_entries(F.transform("p", lambda x: F.struct(x["n"], x)))
    back = F.aggregate("p", F.col("k"), lambda at, _: F.coalesce(F.element_at("m", at["from"]), at))
    found = dead.withColumn("k", first).where("k is not null").withColumn("m", by_n).withColumn("o", back)
    return found.select("session_id", "id", "k.event_id", "o.removed", "k.added")
