"""Markers through layers: where in the way from the raw events to the delivered record a path or phrase is still there, and where it is first lost.

A marker is in a text if it occurs anywhere in it, case and kind of slash aside. The markers of a session with up to FEW of them travel to its texts. More meet
them in an inverted index of short pieces: a marker is looked up by the piece of it that the fewest texts of its session hold, and only these are searched. A
marker with a piece that no text holds is nowhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import to_slash

#: Characters of a piece; a shorter marker is one piece.
PIECE = 3
#: Markers of a session that are looked for in each of its texts.
FEW = 64


def norm(text: Column) -> Column:
    return F.lower(to_slash(text))


def pieces(text: Column, size: int = PIECE) -> Column:
    """The distinct runs of so many characters; none in a shorter text."""
    upto = F.char_length(text) - size + 1
    return F.when(upto >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(upto, F.lit(1))), lambda i: F.substr(text, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def asked_for(markers: DataFrame) -> DataFrame:
    return markers.where("marker is not null and marker <> ''").select("session_id", "marker").distinct().withColumn("needle", norm(F.col("marker")))


def by_session(asked: DataFrame) -> DataFrame:
    """(session_id, ms) of the sessions with up to FEW markers."""
    return asked.groupBy("session_id").agg(F.collect_list(F.struct("marker", "needle")).alias("ms")).where(F.size("ms") <= FEW)


def some_have_many(asked: DataFrame) -> bool:
    return (asked.groupBy("session_id").count().agg(F.max("count")).first()[0] or 0) > FEW


def met(held: DataFrame, asked: DataFrame) -> DataFrame:
    """held (session_id, layer, row, hay) of the sessions with up to FEW markers, with marks: those that it holds. Texts stream past a table of markers, unsorted."""
    return held.join(by_session(asked).hint("shuffle_hash"), "session_id").withColumn("marks", F.transform(F.filter("ms", lambda m: F.col("hay").contains(m["needle"])), lambda m: m["marker"])).drop("ms")


def indexed(held: DataFrame, asked: DataFrame) -> DataFrame:
    """(session_id, marker, layer, row) by the inverted index, of the sessions with more than FEW markers."""
    many = asked.groupBy("session_id").count().where(F.col("count") > FEW).select("session_id")
    held, asked = held.join(many, "session_id", "left_semi"), asked.join(many, "session_id", "left_semi")
    short = F.char_length("needle") < PIECE
    wanted = asked.withColumn("piece", F.explode(F.when(short, F.array("needle")).otherwise(pieces(F.col("needle")))))
    lengths = wanted.select(F.char_length("piece").alias("k")).distinct().collect()  # PIECE numbers at most
    every = F.flatten(F.array(*[pieces(F.col("hay"), r["k"]) for r in lengths])) if lengths else F.array().cast("array<string>")
    index = held.withColumn("piece", F.explode(every)).join(wanted.select("session_id", "piece").distinct(), ["session_id", "piece"], "left_semi")
    counts = index.groupBy("session_id", "piece").agg(F.count("*").alias("df"))
    rare = Window.partitionBy("session_id", "marker").orderBy(F.coalesce("df", F.lit(0)), "piece")
    rarest = wanted.join(counts, ["session_id", "piece"], "left").withColumn("r", F.row_number().over(rare)).where("r = 1 and df is not null")
    hits = rarest.select("session_id", "marker", "needle", "piece").join(index, ["session_id", "piece"]).where(F.col("hay").contains(F.col("needle")))
    return hits.select("session_id", "marker", "layer", "row")


def presence(texts: DataFrame, markers: DataFrame, layers: list[str]) -> DataFrame:
    """(session_id, marker, layer, present, rows) for each marker and layer; present is null where the session has no text of the layer.

    texts: session_id, layer, row (a label), text. markers: session_id, marker; null and empty ones are left out, repeated ones count once.
    rows: the labels of the texts that hold the marker, sorted.
    """
    asked = asked_for(markers)
    held = texts.where("text is not null").select("session_id", "layer", "row", norm(F.col("text")).alias("hay"))
    hits = met(held, asked).select("session_id", F.explode("marks").alias("marker"), "layer", "row")
    if some_have_many(asked):
        hits = hits.unionByName(indexed(held, asked))
    found = hits.groupBy("session_id", "marker", "layer").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    known = held.select("session_id", "layer").distinct().withColumn("known", F.lit(True))
    grid = asked.select("session_id", "marker", F.posexplode(F.array(*[F.lit(x) for x in layers])).alias("ordinal", "layer"))
    full = grid.join(known, ["session_id", "layer"], "left").join(found, ["session_id", "marker", "layer"], "left")
    rows = F.coalesce("rows", F.array().cast("array<string>"))
    return full.select("session_id", "marker", "ordinal", "layer", F.when(F.col("known"), F.col("rows").isNotNull()).alias("present"), rows.alias("rows"))


def trace(texts: DataFrame, markers: DataFrame, reasons: dict[str, str]) -> DataFrame:
    """(session_id, marker, lost_at, ever_present, reason): the first layer at which a marker that was there is not, of the layers in order of reasons.

    Layers are bits, so texts are read once and nothing but a number is kept of them; a row without a marker says which layers a session has.
    """
    asked, layers, nothing = asked_for(markers), list(reasons), F.lit(None).cast("string")
    bit = F.coalesce(*[F.when(F.col("layer") == x, F.lit(1 << k).cast("long")) for k, x in enumerate(layers)])
    held = texts.where(F.col("text").isNotNull() & F.col("layer").isin(*layers)).select("session_id", "layer", F.lit("").alias("row"), norm(F.col("text")).alias("hay"))
    hits = met(held, asked).select("session_id", F.explode(F.concat(F.array(nothing), "marks")).alias("marker"), bit.alias("bit"))
    if some_have_many(asked):
        more = indexed(held, asked).select("session_id", "marker", bit.alias("bit"))
        hits = hits.unionByName(more).unionByName(held.select("session_id", nothing.alias("marker"), bit.alias("bit")))
    all_ = hits.unionByName(asked.select("session_id", "marker", F.lit(0).cast("long").alias("bit")))
    seen = all_.groupBy("session_id", "marker").agg(F.bit_or("bit").alias("seen"))
    known = F.coalesce(F.max(F.when(F.col("marker").isNull(), F.col("seen"))).over(Window.partitionBy("session_id")), F.lit(0))
    has = lambda c, k: F.col(c).bitwiseAND(F.lit(1 << k).cast("long")) != 0
    before, lost = F.lit(False), []
    for k, layer in enumerate(layers):
        lost.append(F.when(has("known", k) & ~has("seen", k) & before, F.lit(layer)))
        before = F.when(has("known", k), has("seen", k)).otherwise(before)
    why = F.create_map(*[F.lit(x) for k, v in reasons.items() for x in (k, v)])
    out = seen.withColumn("known", known).where("marker is not null").select("session_id", "marker", F.coalesce(*lost).alias("lost_at"), (F.col("seen") != 0).alias("ever_present"))
    return out.withColumn("reason", F.when(F.col("lost_at").isNotNull(), why[F.col("lost_at")]))


#: Why a marker is lost at a layer.
REASONS = {
    "transcript": "",
    "events": "not captured: no stored payload holds it",
    "ledger": "not extracted: only raw payloads hold it",
    "snapshot": "not selected: rows of the ledger hold it, no selected one does",
    "record": "budgeted out: selected, but no line of the record shows it",
    "restore": "redacted: the second redaction replaced it",
    "staged": "stale: what is staged is older than the ledger",
}
