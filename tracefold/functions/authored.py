"""The user's own words in a prompt: elements that a client put at its edges are peeled off, as a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: Names of elements that clients inject, and beginnings of such names. ``tracefold_`` is this repository's own.
NAMES = ("system-reminder", "task-notification", "user-prompt-submit-hook")
FAMILIES = ("ide_", "ide-", "command-", "local-command-", "bash-")
OWN = "tracefold_"
#: More elements at one edge, and nothing between the edges counts as the user's.
MOST = 1024
TAG = "(?:" + "|".join((*NAMES, *(f + "[A-Za-z0-9_.:-]*+" for f in (*FAMILIES, OWN)))) + ")"
OPEN = rf"<({TAG})(?:\s[^<>]*+)?(?<!/)>"
CLOSE = rf"</({TAG})>"


def peeled(parts: Column, begins: str, ends: str) -> Column:
    """struct<done, count>: how many of parts, from the first on, are whole elements with blanks between them, and how many elements these are.

    begins and ends: the fields of a part with the names of a tag at its near and at its far side ('' if none); an element ends where as many of its name
    were closed as opened.
    """

    def step(at: Column, p: Column) -> Column:
        outside = at["depth"] == 0
        near, far = p[begins], p[ends]
        opened = F.when(outside & (near != ""), 1).when(~outside & (near == at["name"]), at["depth"] + 1).otherwise(at["depth"])
        name = F.when(outside, near).otherwise(at["name"])
        closed = opened - F.when((opened > 0) & (far == name), 1).otherwise(0)
        whole = (opened > 0) & (closed == 0)
        blank = outside & (near == "") & p["text"].rlike(r"^\s*\z")
        stop = at["stop"] | (outside & (near == "") & ~blank)
        done = F.when(~stop & (whole | blank), at["n"] + 1).otherwise(at["done"])
        count = at["count"] + F.when(~stop & whole, 1).otherwise(0)
        return F.struct((at["n"] + 1).alias("n"), closed.cast("int").alias("depth"), name.alias("name"), stop.alias("stop"), done.cast("int").alias("done"), count.cast("int").alias("count"))

    zero = F.lit(0)
    start = F.struct(zero.alias("n"), zero.alias("depth"), F.lit("").alias("name"), F.lit(False).alias("stop"), zero.alias("done"), zero.alias("count"))
    return F.aggregate(parts, start, step)


def authored(prompt: Column) -> Column:
    """prompt without the injected elements at its edges, trimmed; an element that does not end, and any inside the text, stays. Null stays null."""
    marked = F.regexp_replace(F.regexp_replace(F.translate(prompt, "\u0001", " "), f"(?i)({OPEN})", "\u0001$1"), f"(?i)({CLOSE})", "$1\u0001")
    texts = F.filter(F.split(marked, "\u0001"), lambda x: x != "")
    parts = F.transform(texts, lambda x: F.struct(x.alias("text"), F.lower(F.regexp_extract(x, f"(?i)^{OPEN}", 1)).alias("opens"), F.lower(F.regexp_extract(x, rf"(?i){CLOSE}\z", 1)).alias("closes")))

    def inner(p: Column) -> Column:
        return let(peeled(p, "opens", "closes"), lambda front: let(F.slice(p, front["done"] + 1, F.size(p)), lambda left: rest(left, front)))

    def rest(left: Column, front: Column) -> Column:
        def cut(back: Column) -> Column:
            text = F.array_join(F.transform(F.slice(left, 1, F.size(left) - back["done"]), lambda x: x["text"]), "")
            return F.when((front["count"] > MOST) | (back["count"] > MOST), F.lit("")).otherwise(text)

        return let(peeled(F.reverse(left), "closes", "opens"), cut)

    some = prompt.rlike(rf"(?i)^\s*<{TAG}|</{TAG}>\s*\z")
    strip = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+\z", "")
    return strip(F.when(some, let(parts, inner)).otherwise(prompt))
