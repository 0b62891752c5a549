"""A bounded text record per session: lines of fixed sections, cut by priority to a budget of estimated tokens.

Set at a time: lines carry their cost, a running sum in order of priority decides which stay, and the text is what stays in order of
display. A section's header stays only with a line of its body.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.redact import redact
from ..functions.text import token_estimate, truncate_chars

#: Sections in order of display, with the priority in which they are kept.
SECTIONS = (
    ("FIRST_MESSAGE", 0), ("STATED_CONSTRAINTS", 1), ("REJECTED_APPROACHES", 3), ("SUBTASK", 2), ("EARLIER", 8), ("LATEST", 2), ("WORKSPACE_STATE", 6), ("TEST_STATUS", 4),
    ("TEST_RESULT", 5), ("REVERTED_EDITS", 4), ("RECENT_EDITS", 6), ("FILE_ACTIVITY", 7), ("FAILURE_LOCATION", 5), ("NEXT_TARGET", 5), ("RECORD_DETAIL", 9),
)
DEFAULT_BUDGET, FLOOR, CEILING, MOST_CHARS = 740, 64, 1000, 9500


def lines_of(df: DataFrame, section: str, text, order: str) -> DataFrame:
    """Lines of one section: session_id, section, n (order within it), text."""
    return df.select("session_id", F.lit(section).alias("section"), F.col(order).cast("long").alias("n"), redact(truncate_chars(text, 300)).alias("text"))


def render(lines: DataFrame, budget: int = DEFAULT_BUDGET) -> DataFrame:
    """(session_id, capsule, tokens, dropped): the kept lines under their headers; tokens never exceed the budget."""
    budget = max(FLOOR, min(budget, CEILING))
    place = F.create_map(*[F.lit(x) for i, (s, _) in enumerate(SECTIONS) for x in (s, i)])
    rank = F.create_map(*[F.lit(x) for s, p in SECTIONS for x in (s, p)])
    own = lines.where(F.col("text").isNotNull() & (F.trim("text") != "")).withColumns({"place": place[F.col("section")], "keep": rank[F.col("section")]})
    first = F.row_number().over(Window.partitionBy("session_id", "section").orderBy("n", "text"))
    # a line pays for itself and the break after it; the first of a section pays for its header too
    head = F.when(first == 1, token_estimate(F.concat(F.lower("section"), F.lit(":\n"))) + 1).otherwise(0)
    cost = own.withColumn("first", first).withColumn("cost", token_estimate(F.concat(F.lit("- "), F.col("text"), F.lit("\n"))) + 1 + head)
    order = Window.partitionBy("session_id").orderBy("keep", "place", "first").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spent = cost.withColumns({"spent": F.sum("cost").over(order), "chars": F.sum(F.char_length("text") + F.char_length("section") + 5).over(order)})
    kept = spent.withColumn("in", (F.col("spent") <= budget) & (F.col("chars") <= MOST_CHARS))
    line = F.when(F.col("first") == 1, F.concat(F.lower("section"), F.lit(":\n- "), F.col("text"))).otherwise(F.concat(F.lit("- "), F.col("text")))
    sections = kept.groupBy("session_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("in"), F.struct("place", "first", line.alias("line"))))).alias("x"), F.sum((~F.col("in")).cast("int")).alias("dropped"),
    )
    return sections.select("session_id", F.array_join("x.line", "\n").alias("capsule"), "dropped").withColumn("tokens", token_estimate(F.col("capsule")))
