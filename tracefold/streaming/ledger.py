"""The ledger as a stream: files of new events in; timeline and projections out, folded on from where each session was.

There is no watermark: no event is ever too late. Per session a keyed state holds what decides whether an event comes last in logical order (the
last direct event, the latest clock of spooled ones since) and what the fold has come to there (position, logical time, epoch, turns). An
event that comes last gets its place from that state, and only new rows are written. One that does not changes the order of what is
there: its session, and no other, is read again from the ledger, folded anew and replaced. The state needs no such reading: its totals
do not depend on the order, and what it knows of the end errs, if ids arrive out of turn, only towards folding anew.

Every table is appended to in folders by micro-batch (``version=<n>``), written by overwriting, so that a batch which runs again after a loss
changes nothing. A session's rows of versions before its last new fold are void. ``compact`` writes what holds as one version.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..operators import folds, order
from ..sources import ledger

EVENT_NAMES = [f.split(" ")[0] for f in ledger.EVENT.split(", ")]
PLACE = "anchor bigint, position bigint, logical_ms bigint, epoch int, prompt_ordinal int"
PLACE_NAMES = [f.split(" ")[0] for f in PLACE.split(", ")]
PLACED = f"{ledger.EVENT}, {PLACE}, refold boolean"
#: A session's end: the highest id so far, the last direct event, the latest clock of spooled ones since, and the totals there.
END = "last_id bigint, direct_id bigint, direct_ts bigint, spooled_ts bigint, position bigint, logical_ms bigint, epoch int, turns int"
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class End:
    """The end of one session's timeline, and the places of events that come last there."""

    def __init__(self, held: tuple | None = None) -> None:
        self.last_id, self.direct_id, self.direct_ts, self.spooled_ts, self.position, self.logical_ms, self.epoch, self.turns = held or (None, None, None, None, 0, None, 1, 0)

    def held(self) -> tuple:
        return self.last_id, self.direct_id, self.direct_ts, self.spooled_ts, self.position, self.logical_ms, self.epoch, self.turns

    def add(self, event: int, ts: int, spooled: bool, opens: bool, turn: bool) -> tuple | None:
        """The event's place (PLACE), or None if it does not come last."""
        fits = lambda t: t is None or t <= ts
        last = (self.last_id is None or event > self.last_id) and (not spooled or fits(self.direct_ts) and fits(self.spooled_ts))
        if spooled:
            self.spooled_ts = ts if fits(self.spooled_ts) else self.spooled_ts
        elif self.direct_id is None or event > self.direct_id:
            after = self.last_id is None or event > self.last_id  # else some spooled event may be after it: keep their clock
            self.direct_id, self.direct_ts, self.spooled_ts = event, ts, None if after else self.spooled_ts
        self.last_id = event if self.last_id is None else max(event, self.last_id)
        self.position += 1
        self.logical_ms = ts if fits(self.logical_ms) else self.logical_ms
        self.epoch += opens
        before, self.turns = self.turns, self.turns + turn
        return (-1 if self.direct_id is None else self.direct_id, self.position, self.logical_ms, self.epoch, before) if last else None


class Places(StatefulProcessor):
    """Gives every event of a micro-batch its place; a session with one that does not come last is marked to be folded anew."""

    def init(self, handle) -> None:
        self.end = handle.getValueState("end", END)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        end = End(tuple(self.end.get()) if self.end.exists() else None)
        new = pd.concat(list(rows)).sort_values("id")  # one session's rows of one micro-batch
        places = [end.add(*r) for r in zip(*(new[c].tolist() for c in ("id", "ts_ms", "spooled", "opens", "turn")), strict=True)]
        self.end.update(end.held())
        again = None in places
        where = pd.DataFrame([p or (None,) * len(PLACE_NAMES) for p in places], columns=PLACE_NAMES, index=new.index).astype("Int64")
        yield pd.concat([new[EVENT_NAMES], where], axis=1).assign(refold=again)

    def close(self) -> None:
        pass


def placed(events: DataFrame) -> DataFrame:
    """PLACED rows of a stream of ledger rows, each dedupe_key once. Needs the RocksDB state store."""
    parsed = ledger.parsed(events.dropDuplicates(["dedupe_key"]))
    marked = parsed.select(*EVENT_NAMES, "spooled", order.opens_epoch().alias("opens"), order.is_turn().alias("turn"))
    return marked.groupBy("session_id").transformWithStateInPandas(Places(), PLACED, "Append", "None")


def merges() -> dict[str, tuple]:
    """Projections that add up: how a batch's rows are made, the keys, and how the rows of several versions become one."""
    known = lambda c, by: F.max_by(c, F.when(F.col(by).isNotNull(), F.col("version")))
    sessions = {
        "project_id": F.min_by("project_id", "version"), "started_ms": F.min("started_ms"), "last_event_ms": F.max("last_event_ms"), "transcript_path": known("transcript_path", "transcript_path"),
        "epoch": F.max("epoch"), "events": F.sum("events"), "ended_ms": known("ended_ms", "ended_ms"), "end_reason": known("end_reason", "ended_ms"),
    }
    files = {"reads": F.sum("reads"), "edits": F.sum("edits"), "in_failure": F.max("in_failure"), "last_touch_ms": F.max("last_touch_ms"), "first_touch_ms": F.min("first_touch_ms")}
    return {"sessions": (folds.sessions, ["session_id"], sessions), "file_stats": (folds.file_stats, ["session_id", "epoch", "path"], files)}


def fold_batch(batch: DataFrame, version: int, out_dir: str) -> dict[str, int]:
    """Writes one micro-batch of PLACED rows; returns how many sessions it touched, and how many of them were folded anew."""
    spark = batch.sparkSession
    held = batch.persist()
    put = lambda df, name: df.write.mode("overwrite").parquet(f"{out_dir}/{name}/version={version}")
    put(held.select(*EVENT_NAMES), "ledger")
    again = held.where("refold").select("session_id").distinct().persist()
    counts = {"touched": held.select("session_id").distinct().count(), "refolded": again.count()}
    on = ledger.parsed(held.where("not refold").drop("refold"))
    if counts["refolded"]:
        events = read(spark, out_dir, "ledger", version).drop("version").join(again, "session_id", "left_semi")
        anew = order.timeline(ledger.parsed(events)).withColumn("position", F.col("position").cast("long"))
        on = on.unionByName(anew)
        put(again, "refolded")
    timeline = on.drop("dedupe_key", "payload")
    put(timeline, "timeline")
    written = read(spark, out_dir, "timeline").where(F.col("version") == version).drop("version")
    for name, (fold, _, _) in merges().items():
        put(fold(written), name)
    again.unpersist()
    held.unpersist()
    return counts


def read(spark: SparkSession, out_dir: str, name: str, upto: int | None = None) -> DataFrame:
    """Rows of a table with their version, of batches up to one."""
    df = spark.read.option("basePath", f"{out_dir}/{name}").option("mergeSchema", "true").parquet(f"{out_dir}/{name}").withColumn("version", F.col("version").cast("long"))
    return df if upto is None else df.where(F.col("version") <= upto)


def held_rows(spark: SparkSession, out_dir: str, name: str) -> DataFrame:
    """The rows that hold: of every session those since its last new fold."""
    rows = read(spark, out_dir, name)
    try:
        void = read(spark, out_dir, "refolded").groupBy("session_id").agg(F.max("version").alias("__since"))
    except Exception as e:  # no session was ever folded anew
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return rows
    return rows.join(void, "session_id", "left").where("__since is null or version >= __since").drop("__since")


def projection(spark: SparkSession, out_dir: str, name: str) -> DataFrame:
    """A projection as it stands: sessions, file_stats, or intents (from the turns of the timeline)."""
    if name == "intents":
        return folds.intents(held_rows(spark, out_dir, "timeline").drop("version"))
    _, keys, sums = merges()[name]
    return held_rows(spark, out_dir, name).groupBy(*keys).agg(*[c.alias(n) for n, c in sums.items()])


def compact(spark: SparkSession, out_dir: str, to_dir: str) -> None:
    """Writes the tables that hold as version 0 of another folder; the last version's number comes before all later ones there too."""
    for name in ("ledger", "timeline", *merges()):
        rows = read(spark, out_dir, name) if name == "ledger" else held_rows(spark, out_dir, name)
        if name in merges():
            rows = projection(spark, out_dir, name)
        rows.drop("version").write.mode("errorifexists").parquet(f"{to_dir}/{name}/version=0")


def start(spark: SparkSession, source_dir: str, out_dir: str, checkpoint_dir: str, files_per_trigger: int = 1000, seen=None) -> StreamingQuery:
    """Folds files of ledger rows (JSON lines) as they come; stops when it has read what is there. seen(version, counts) is told of every batch."""
    spark.conf.set(*STATE_STORE)
    source = spark.readStream.schema(ledger.EVENT).option("maxFilesPerTrigger", files_per_trigger).json(source_dir)

    def fold(batch: DataFrame, version: int) -> None:
        counts = fold_batch(batch, version + 1, out_dir)  # 0 is what compact writes
        if seen:
            seen(version, counts)

    return placed(source).writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()
