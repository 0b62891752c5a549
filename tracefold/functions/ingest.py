"""What ingest keeps of long or secret text: first differences, redacted tails, payloads under a byte budget. Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .redact import redact
from .text import let, prefix_bytes, strip_ansi, suffix_bytes, truncate_chars

#: Limits of the ledger, and marks that no token holds.
EXCERPT_CHARS, TAIL_CONTEXT, PAYLOAD_BYTES, LATE_PAYLOAD_BYTES = 160, 4096, 16 * 1024, 48 * 1024
PROMPT_BYTES, COMMAND_BYTES, TAIL_BYTES, ERROR_BYTES, SUMMARY_BYTES, PATTERN_CHARS = 4 * 1024, 2 * 1024, 8 * 1024, 4 * 1024, 32 * 1024, 200
TOKEN_DELIMITERS = "\"',;{}[]()<>|&"
#: Payload fields that may be cut, the first of equally long ones first.
CUTTABLE = ("stdout_tail", "stderr_tail", "error", "summary", "prompt", "command")


def lines(s: Column) -> Column:
    """The lines of a text without their ends; none in the empty text."""
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(s, r"\r?\n\z", ""), r"\r?\n"))


def first_difference(old: Column, new: Column, clean: Callable[[Column], Column] = redact, cap: int = EXCERPT_CHARS) -> Column:
    """``- old`` and ``+ new`` of the first lines that differ, trimmed, cleaned, then cut; null where none does or both are blank."""
    pairs = F.filter(F.zip_with(lines(old), lines(new), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda p: ~p["a"].eqNullSafe(p["b"]))
    first = F.get(pairs, F.lit(0))

    def side(mark: str, c: Column) -> Column:
        bare = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
        return F.when(bare != "", F.concat(F.lit(mark), let(let(bare, clean), lambda x: truncate_chars(x, cap))))

    return let(first, lambda p: F.nullif(F.concat_ws("\n", side("- ", p["a"]), side("+ ", p["b"])), F.lit("")))


def split_excerpt(excerpt: Column) -> dict[str, Column]:
    """The first removed and the first added line of an excerpt."""
    of = lambda mark: F.get(F.transform(F.filter(lines(excerpt), lambda x: x.startswith(mark)), lambda x: F.substr(x, F.lit(3))), F.lit(0))
    return {"removed": of("- "), "added": of("+ ")}


def redact_tail(s: Column, limit: int, context: int = TAIL_CONTEXT) -> Column:
    """The last bytes of s, cleaned and redacted before the final cut.

    The text is first cut with some context, from which it starts at a line, else a blank, else a mark, so that no token loses its head.
    """
    marks = "".join("\\" + c for c in TOKEN_DELIMITERS)

    def start(window: Column) -> Column:
        before = F.substr(window, F.lit(1), F.char_length(window) - F.char_length(suffix_bytes(window, limit)))
        upto = lambda b, pattern: F.nullif(F.char_length(F.regexp_extract(b, pattern, 0)), F.lit(0))
        skip = let(before, lambda b: F.coalesce(upto(b, r"^[^\n]*\n"), upto(b, r"(?U)^\S*\s"), upto(b, f"^[^{marks}]*[{marks}]"), F.char_length(b)))
        return F.when(F.octet_length(window) < F.octet_length(s), F.substr(window, skip + 1)).otherwise(window)

    cleaned = let(let(let(suffix_bytes(s, limit + context), start), strip_ansi), redact)
    return let(cleaned, lambda x: suffix_bytes(x, limit))


def redact_head(s: Column, limit: int) -> Column:
    """The first bytes of s, redacted before the cut."""
    return let(let(s, redact), lambda x: prefix_bytes(x, limit))


def within_budget(fields: dict[str, Column], limit: int | Column = PAYLOAD_BYTES, passes: int = 24) -> Column:
    """A struct of fields whose JSON has at most limit bytes: pass by pass the longest of the cuttable ones loses its head, null once empty.

    A pass takes what is over, at least a quarter of the field and 64 bytes. Other fields are never cut.
    """
    names = list(fields)
    cut = [n for n in CUTTABLE if n in fields]
    state = F.struct(*[c.alias(n) for n, c in fields.items()])

    def one_pass(acc: Column, _: Column) -> Column:
        size = F.array(*[F.coalesce(F.octet_length(acc[n]), F.lit(-1)) for n in cut])
        plan = let(size, lambda z: F.struct(z.alias("size"), (F.array_position(z, F.array_max(z)) - 1).cast("int").alias("at"), (F.octet_length(F.to_json(acc)) - limit).alias("over")))

        def cut_down(p: Column) -> Column:
            longest = F.element_at(p["size"], p["at"] + 1)
            keep = F.greatest(longest - F.greatest(p["over"], F.floor(longest / 4).cast("int"), F.lit(64)), F.lit(0))
            new = lambda n, i: F.when((p["over"] > 0) & (p["at"] == i), F.nullif(suffix_bytes(acc[n], keep), F.lit(""))).otherwise(acc[n])
            return F.struct(*[(new(n, cut.index(n)) if n in cut else acc[n]).alias(n) for n in names])

        return let(plan, cut_down)

    return F.aggregate(F.sequence(F.lit(1), F.lit(passes)), state, one_pass)
