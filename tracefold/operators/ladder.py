"""A record within a budget of estimated tokens: rungs that take detail away one by one, whole lines after that, one cut at last.

Lines are rows (session_id, section, part, n, text), n from 1 for the most important entry of its section. A rung changes limits: how
many entries a section shows, how long a part is, how many of the oldest entries lose a part. Every line has a variant per length that some rung
gives it, with its cost; a session's cost at a rung is a sum over the variants that stand there, so all rungs are weighed at once and
the first that fits is taken. Units of the estimate add up over lines, so that the sum is the estimate of the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import token_estimate, token_units, tokens_of, truncate_chars
from ..sources.tables import written
from .render import CEILING, DEFAULT_BUDGET, FLOOR, MOST_CHARS, SECTIONS

LINE = "session_id string, section string, part string, n bigint, text string"
WHOLE = 1 << 30
#: Fixed values: (section, part, entries shown, characters) at full detail.
FULL = (
    ("FIRST_MESSAGE", "", 1, 240), ("STATED_CONSTRAINTS", "", 3, 200), ("STATED_CONSTRAINTS", "omitted", WHOLE, WHOLE), ("REJECTED_APPROACHES", "", 4, 200), ("SUBTASK", "", 1, 200), ("EARLIER", "", 1, 200),
    ("LATEST", "", 1, 200), ("WORKSPACE_STATE", "", WHOLE, WHOLE), ("TEST_STATUS", "", 6, 200), ("TEST_STATUS", "detail", 6, 200), ("TEST_RESULT", "command", 1, 160), ("TEST_RESULT", "", 8, WHOLE),
    ("REVERTED_EDITS", "", 4, 200), ("REVERTED_EDITS", "replaced", 4, 160), ("REVERTED_EDITS", "attempted", 4, 160), ("REVERTED_EDITS", "observed", 4, 160), ("RECENT_EDITS", "", 4, 200), ("FILE_ACTIVITY", "", 8, 200),
    ("FILE_ACTIVITY", "named", 8, 200), ("FAILURE_LOCATION", "", 1, 200), ("NEXT_TARGET", "", 1, 200), ("RECORD_DETAIL", "", WHOLE, WHOLE),
)
PATHS = ("FILE_ACTIVITY", "RECENT_EDITS", "REVERTED_EDITS", "FAILURE_LOCATION", "NEXT_TARGET")
#: The rungs in order, as (section, part or * for all, what changes, to). ``entries`` and ``chars`` are new limits,
#: ``oldest`` says how many of the oldest entries show the part no more.
RUNGS = (
    [("FILE_ACTIVITY", "*", "entries", 4)], [("RECENT_EDITS", "*", "entries", 2)], [("TEST_RESULT", "", "entries", 3)], [("REVERTED_EDITS", "observed", "entries", 0)],
    *([("REVERTED_EDITS", "replaced", "oldest", k)] for k in (1, 2, 3, 4)),
    [("FILE_ACTIVITY", "named", "entries", 0)], [("FAILURE_LOCATION", "*", "entries", 0), ("NEXT_TARGET", "*", "entries", 0)], [("LATEST", "", "chars", 120)], [("TEST_RESULT", "", "entries", 0)],
    [("FILE_ACTIVITY", "", "entries", 2)], [("STATED_CONSTRAINTS", "", "chars", 140)], [("TEST_STATUS", "detail", "entries", 0)], [("RECENT_EDITS", "*", "entries", 0)], [("EARLIER", "", "chars", 120)],
    [("REVERTED_EDITS", "attempted", "chars", 80)], [("FIRST_MESSAGE", "", "chars", 160)], [("TEST_STATUS", "", "entries", 3)],
    [("SUBTASK", "", "chars", 80)], [(s, "", "chars", 60) for s in PATHS], [("TEST_RESULT", "command", "chars", 80)], [("FILE_ACTIVITY", "*", "entries", 0)], [("TEST_STATUS", "", "entries", 1)], [("STATED_CONSTRAINTS", "omitted", "entries", 0)],
    [("LATEST", "", "chars", 80)], [("EARLIER", "", "chars", 100)], [("REJECTED_APPROACHES", "", "chars", 140)], [("REJECTED_APPROACHES", "", "chars", 100)],
    *([("REVERTED_EDITS", "attempted", "oldest", k)] for k in (1, 2, 3, 4)),
    [("STATED_CONSTRAINTS", "", "entries", 2)], [("STATED_CONSTRAINTS", "", "chars", 100)], [("EARLIER", "*", "entries", 0)], [("LATEST", "*", "entries", 0)], [("REVERTED_EDITS", "*", "entries", 2)],
    [("REJECTED_APPROACHES", "", "entries", 2)], [("FIRST_MESSAGE", "", "chars", 100)], [("STATED_CONSTRAINTS", "", "entries", 1)], [("REJECTED_APPROACHES", "", "entries", 1)], [("SUBTASK", "*", "entries", 0)],
    [(s, "", "chars", 40) for s in PATHS], [("TEST_RESULT", "command", "chars", 40)], [("FIRST_MESSAGE", "", "chars", 60)], [("REVERTED_EDITS", "*", "entries", 1)],
)
#: Sections in the order in which their lines go when no rung is left; the others are the record's frame and stay.
DROPPED = ("FAILURE_LOCATION", "NEXT_TARGET", "RECENT_EDITS", "FILE_ACTIVITY", "TEST_RESULT", "SUBTASK", "EARLIER", "LATEST", "REVERTED_EDITS", "REJECTED_APPROACHES", "TEST_STATUS", "STATED_CONSTRAINTS")


def limits() -> list[tuple]:
    """(rung, section, part, entries, chars, oldest) for every rung from 0 (full detail) on."""
    now = {(s, p): {"entries": n, "chars": c, "oldest": 0} for s, p, n, c in FULL}
    out = [(0, *k, *v.values()) for k, v in now.items()]
    for i, changes in enumerate(RUNGS, 1):
        for section, part, what, to in changes:
            for s, p in now:
                if s == section and part in ("*", p):
                    now[s, p] = now[s, p] | {what: to}
        out += [(i, *k, *v.values()) for k, v in now.items()]
    return out


def cut_off(section: Column, text: Column, cap: int) -> Column:
    return truncate_chars(text, cap)


def weighed(spark: SparkSession, lines: DataFrame, shorten: Callable[[Column, Column, int], Column] = cut_off) -> DataFrame:
    """(session_id, rung, section, part, n, line, units, chars): the variants that stand at each rung; a longer variant that costs no more stays in its place.

    shorten: a line of a section in at most so many characters.
    """
    table = limits()
    lengths = spark.createDataFrame(sorted({(s, p, c) for _, s, p, _, c, _ in table}), "section string, part string, cap int")
    rungs = spark.createDataFrame([(r, s, p, n, c, o) for r, s, p, n, c, o in table], "rung int, section string, part string, entries int, cap int, oldest int")  # some thousand rows, as many whatever the input
    own = lines.where(F.col("text").isNotNull() & (F.trim("text") != "")).withColumn("last", F.max("n").over(Window.partitionBy("session_id", "section", "part")))
    shown = F.concat(F.lit("- "), F.coalesce(*[F.when(F.col("cap") == c, F.col("text") if c == WHOLE else shorten(F.col("section"), F.col("text"), c)) for c in sorted({x[4] for x in table})]))
    each = own.join(F.broadcast(lengths), ["section", "part"]).withColumn("line", shown)
    each = each.withColumns({"units": token_units(F.col("line")), "chars": F.char_length("line").cast("long")})
    longer = Window.partitionBy("session_id", "section", "part", "n").orderBy(F.desc("cap")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cheapest = F.min(F.struct(F.col("units"), -F.col("cap"), F.col("line"), F.col("chars"))).over(longer)
    each = each.withColumn("v", cheapest).withColumns({"line": F.col("v.line"), "units": F.col("v.units"), "chars": F.col("v.chars")}).drop("v")
    at = each.join(F.broadcast(rungs), ["section", "part", "cap"])
    return at.where((F.col("n") <= F.col("entries")) & (F.col("last") - F.col("n") >= F.col("oldest"))).select("session_id", "rung", "section", "part", "n", "line", "units", "chars")


def header(section: Column) -> Column:
    return F.concat(F.lower(section), F.lit(":"))


def chosen(standing: DataFrame, budget: int, sessions: DataFrame) -> DataFrame:
    """(session_id, rung, tokens, fits): the first rung whose text fits, else the last one."""
    by = standing.groupBy("session_id", "rung", "section").agg((F.sum(F.col("units") + 1) + token_units(header(F.col("section"))) + 1).alias("units"), (F.sum(F.col("chars") + 1) + F.char_length("section") + 2).alias("chars"))
    total = by.groupBy("session_id", "rung").agg((F.sum("units") - 1).alias("units"), (F.sum("chars") - 1).alias("chars"))  # no break after the last line
    fits = (tokens_of(F.col("units")) <= budget) & (F.col("chars") <= MOST_CHARS)
    first = total.groupBy("session_id").agg(F.min(F.when(fits, F.struct("rung", "units"))).alias("hit"), F.max("rung").alias("seen"), F.max(F.struct("rung", "units")).alias("end"))
    last = len(RUNGS)
    out = sessions.join(first, "session_id", "left")
    # a rung that leaves nothing has no rows and fits
    empty = F.col("hit").isNull() & (F.coalesce("seen", F.lit(-1)) < last)
    rung = F.coalesce("hit.rung", F.when(empty, F.coalesce("seen", F.lit(-1)) + 1), F.lit(last))
    return out.select("session_id", rung.cast("int").alias("rung"), tokens_of(F.coalesce("hit.units", F.when(empty, 0), F.col("end.units"))).alias("tokens"), (F.col("hit").isNotNull() | empty).alias("fits"))


def longest_that_fits(text: Column, budget: int) -> Column:
    """The longest beginning of a text that fits the budget, without blanks at its end; bisected."""
    def half(acc: Column, _: Column) -> Column:
        mid = F.ceil((acc["lo"] + acc["hi"]) / 2).cast("int")
        fits = token_estimate(F.substr(text, F.lit(1), mid)) <= budget
        return F.struct(F.when(fits, mid).otherwise(acc["lo"]).alias("lo"), F.when(fits, acc["hi"]).otherwise(F.greatest(mid - 1, acc["lo"])).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.least(F.char_length(text), F.lit(MOST_CHARS)).alias("hi"))
    return F.rtrim(F.substr(text, F.lit(1), F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, half)["lo"]))


def render(lines: DataFrame, budget: int = DEFAULT_BUDGET, shorten: Callable[[Column, Column, int], Column] = cut_off) -> DataFrame:
    """(session_id, rung, dropped, trimmed, capsule, tokens) of every session that has a line; tokens and characters never exceed their limits.

    dropped: lines that went after the last rung, by class of section, the last ones first; a header goes with its section's last line. trimmed: what is left,
    the frame, was still too long and was cut.
    """
    budget = max(FLOOR, min(budget, CEILING))
    spark = lines.sparkSession
    place = F.create_map(*[F.lit(x) for i, (s, _) in enumerate(SECTIONS) for x in (s, i)])
    order_of = F.create_map(*[F.lit(x) for i, s in enumerate(DROPPED) for x in (s, i)])
    part_of = F.create_map(*[F.lit(x) for i, p in enumerate(("command", "named", "", "replaced", "attempted", "detail", "observed", "omitted")) for x in (p, i)])
    standing = written(weighed(spark, lines, shorten))
    pick = chosen(standing, budget, lines.select("session_id").distinct())
    left = standing.join(pick, ["session_id", "rung"]).withColumns({"place": place[F.col("section")], "class": order_of[F.col("section")], "sub": part_of[F.col("part")]})
    # the hard stop: over the lines in the order in which they stay longest, a line goes if it and those before it do not fit
    section = Window.partitionBy("session_id", "section")
    first_shown = F.row_number().over(section.orderBy("n", "sub")) == 1
    own = F.col("units") + 1 + F.when(F.col("head"), token_units(header(F.col("section"))) + 1).otherwise(0)
    chars = F.col("chars") + 1 + F.when(F.col("head"), F.char_length("section") + 2).otherwise(0)
    sized = left.withColumn("head", first_shown).withColumns({"own": own, "size": chars})
    # a section's lines go from its end, so its first line takes the header along
    backwards = Window.partitionBy("session_id").orderBy(F.col("class").desc_nulls_first(), F.asc("place"), F.asc("n"), F.asc("sub")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = sized.withColumns({"upto": F.sum("own").over(backwards) - 1, "length": F.sum("size").over(backwards) - 1})
    over = (tokens_of(F.col("upto")) > budget) | (F.col("length") > MOST_CHARS)
    kept = held.withColumn("gone", ~F.col("fits") & F.col("class").isNotNull() & over)
    line = F.when(F.col("head"), F.concat(header(F.col("section")), F.lit("\n"), F.col("line"))).otherwise(F.col("line"))
    text = kept.groupBy("session_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("gone"), F.struct("place", "n", "sub", line.alias("line"))))), lambda x: x["line"]), "\n").alias("whole"), F.sum(F.col("gone").cast("long")).alias("dropped"),
    )
    full = pick.select("session_id", "rung").join(text, "session_id", "left").withColumns({"whole": F.coalesce("whole", F.lit("")), "dropped": F.coalesce("dropped", F.lit(0).cast("long"))})
    too_long = (token_estimate(F.col("whole")) > budget) | (F.char_length("whole") > MOST_CHARS)
    done = full.withColumn("trimmed", too_long).withColumn("capsule", F.when(F.col("trimmed"), longest_that_fits(F.col("whole"), budget)).otherwise(F.col("whole")))
    return done.select("session_id", "rung", "dropped", "trimmed", "capsule", token_estimate(F.col("capsule")).alias("tokens"))
