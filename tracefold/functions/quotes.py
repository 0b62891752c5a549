"""What a record quotes of a text, and whether a line already names a path: column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import identifiers, let, truncate_chars, truncate_middle

#: The shortest piece of the first sentence that is worth quoting before a rejection.
PIECE = 24
LETTER = r"\p{IsAlphabetic}\p{N}_\-/"


def names_code(s: Column) -> Column:
    """A pair of code marks, or an identifier among the words."""
    return (F.char_length(s) - F.char_length(F.replace(s, F.lit("`"), F.lit(""))) >= 2) | (F.size(identifiers(s)) > 0)


def through_code_sentence(s: Column) -> Column:
    """Up to and with the first sentence that names code; all of it if none does. A sentence ends in ``.``, ``?`` or ``!`` before white space."""

    def cut(parts: Column) -> Column:
        k = F.array_position(F.transform(parts, names_code), True).cast("int")
        return F.when(k > 0, F.array_join(F.slice(parts, 1, k), "")).otherwise(s)

    return F.when(s == "", s).otherwise(let(F.split(s, r"(?U)(?<=[.?!])(?=\s)"), cut))


def names_path(line: Column, path: Column) -> Column:
    """Whether line prints path whole: neither the tail of a longer path (``src/a.py`` for ``a.py``) nor the head of one (``a.pyc``)."""
    literal = F.concat(F.lit(r"\Q"), F.replace(path, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    pattern = F.concat(F.lit(rf"(?<![{LETTER}.\\])"), literal, F.lit(rf"(?![{LETTER}])"))
    return F.when(path == "", F.lit(False)).otherwise(F.rlike(line, pattern))


def quote_rejection(s: Column, cue: Column, n: int) -> Column:
    """A rejection in at most n characters of the user's own words: the first sentence, which names the approach, and the clause that holds the label.

    What is left out is ``...``. If both are too long the first sentence is shortened, and where that leaves less than ``PIECE`` characters of it, the
    whole is cut in its middle, as it is where no label occurs.
    """
    ascii_low = lambda x: F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    at = F.position(ascii_low(cue), ascii_low(s))
    before, label, after = F.substr(s, F.lit(1), at - 1), F.substr(s, at, F.char_length(cue)), F.substr(s, at + F.char_length(cue))
    told = F.regexp_extract(before, r"(?s)^.*[.?!](?=\s)", 0)  # the sentences before that of the label
    rest = F.regexp_extract(after, r"(?s)^[^,;]*?(?:[.?!](?=\s|\z)|(?=[,;])|\z)", 0)
    bare = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    parts = F.struct(
        bare(F.regexp_extract(s, r"(?s)^.*?[.?!](?=\s|\z)", 0)).alias("first"), told.alias("told"), bare(F.concat(F.substr(before, F.char_length(told) + 1), label, rest)).alias("clause"),
        F.when(F.char_length(rest) < F.char_length(after), " ...").otherwise("").alias("more"),
    )

    def shown(p: Column) -> Column:
        whole = F.concat(p["clause"], p["more"])
        both = F.concat(p["first"], F.lit(" ... "), whole)
        room = n - F.char_length(whole) - 5
        head = F.when(F.char_length(p["first"]) <= room, p["first"]).otherwise(F.concat(F.substr(p["first"], F.lit(1), room - 3), F.lit("...")))
        long = F.when(room >= PIECE, F.concat(head, F.lit(" "), whole)).otherwise(truncate_middle(both, n))
        return F.when(p["told"] == "", truncate_chars(whole, n)).when(F.char_length(both) <= n, both).otherwise(long)

    return F.when(F.char_length(s) <= n, s).when(F.coalesce(at, F.lit(0)) > 0, let(parts, shown)).otherwise(truncate_middle(s, n))
