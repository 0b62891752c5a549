"""Text, time and path functions as column expressions (no UDF)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def truncate_chars(s: Column, n: int) -> Column:
    """At most n characters; a cut ends in ``...``, which counts."""
    if n <= 3:
        return F.substring(s, 1, n)
    return F.when(F.char_length(s) <= n, s).otherwise(F.concat(F.substring(s, 1, n - 3), F.lit("...")))


def truncate_front(s: Column, n: int) -> Column:
    """The last n characters; a cut begins with ``...``, which counts."""
    tail = (lambda k: F.expr("''") if k <= 0 else F.right(s, F.lit(k)))
    if n <= 3:
        return F.when(F.char_length(s) <= n, s).otherwise(tail(n))
    return F.when(F.char_length(s) <= n, s).otherwise(F.concat(F.lit("..."), tail(n - 3)))


def _continues(b: Column, at: Column) -> Column:
    """Whether the byte at a place (from 1) of a binary is inside a character."""
    return F.hex(F.substring(b, at, F.lit(1))).rlike("^[89AB]")


def prefix_bytes(s: Column, n: int) -> Column:
    """The longest prefix of at most n bytes of UTF-8."""
    b = F.encode(s, "UTF-8")
    at = F.coalesce(*[F.when(~_continues(b, F.lit(n - k + 1)), F.lit(n - k)) for k in range(min(n, 3) + 1)], F.lit(0))
    return F.when(F.octet_length(s) <= n, s).otherwise(F.decode(F.substring(b, F.lit(1), at), "UTF-8"))


def suffix_bytes(s: Column, n: int | Column) -> Column:
    """The longest suffix of at most n bytes of UTF-8."""
    n = F.lit(n) if isinstance(n, int) else n
    b, size = F.encode(s, "UTF-8"), F.octet_length(s)
    at = F.coalesce(*[F.when(~_continues(b, size - n + 1 + k), size - n + 1 + k) for k in range(4)])
    return F.when(size <= n, s).when(n <= 0, F.lit("")).otherwise(F.decode(F.substring(b, at, n), "UTF-8"))


def truncate_middle(s: Column, n: int, joint: str = " ... ") -> Column:
    """At most n characters that keep both ends; the end gets three fifths and begins with a word if one begins within 20 characters."""
    if n < 24:
        return truncate_chars(s, n)
    room = n - len(joint)
    end = room * 3 // 5
    tail = F.right(s, F.lit(end))
    inside = F.substr(s, F.char_length(s) - end, F.lit(1)).rlike(r"\S") & tail.rlike(r"^\S")
    tail = F.when(inside, F.coalesce(F.nullif(F.regexp_extract(tail, r"(?s)^\S{1,19}(\s.*)$", 1), F.lit("")), tail)).otherwise(tail)
    cut = F.concat(F.regexp_replace(F.substring(s, 1, room - end), r"\s+$", ""), F.lit(joint), F.regexp_replace(tail, r"^\s+", ""))
    return F.when(F.char_length(s) <= n, s).otherwise(cut)


def compact_rules(line: Column) -> Column:
    """Runs of four or more of one rule mark become three; a line of nothing but marks and blanks is null."""
    short = F.regexp_replace(line, r"([=\-_*#~])\1{3,}", "$1$1$1")
    return F.when(~short.rlike(r"(?U)^[\s=\-_*#~]*$"), short)


def collapse_whitespace(s: Column) -> Column:
    """Trimmed, every run of Unicode white space one blank."""
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def line_count(s: Column) -> Column:
    """Lines as an editor counts them: none in the empty text, one in ``a`` and in ``a\\n``."""
    breaks = F.char_length(s) - F.char_length(F.replace(s, F.lit("\n"), F.lit("")))
    return F.when(s == "", 0).otherwise(breaks + F.when(s.endswith("\n"), 0).otherwise(1)).cast("int")


def strip_ansi(s: Column) -> Column:
    """Without CSI, OSC and two-byte escapes; a carriage return inside a line drops what it overwrites."""
    plain = F.regexp_replace(s, "\\x1B\\[[0-?]*[ -/]*[@-~]|\\x1B\\][^\\x07\\x1B]*(?:\\x07|\\x1B\\\\)?|\\x1B[@-Z\\\\^_]", "")
    plain = F.regexp_replace(plain, "\\r+\\n", "\n")
    return F.regexp_replace(plain, "(?m)^[^\\n]*\\r(?=[^\\n\\r])", "")


def token_units(s: Column) -> Column:
    """Letters by word position, digits, blanks and marks each at a fixed rate. Adds up over lines: a break between two is one more."""
    letters, first = r"[A-Za-z]+", r"(?:^|[ \n\r\t])([A-Za-z]+)"

    def units(pattern: str, per: int, group: int = 0) -> Column:
        found = F.regexp_extract_all(s, F.lit(pattern), F.lit(group))
        return F.aggregate(found, F.lit(0).cast("long"), lambda acc, x: acc + F.ceil(F.char_length(x) / F.lit(float(per))))

    kept = lambda pattern: F.char_length(s) - F.char_length(F.regexp_replace(s, pattern, ""))
    return (
        units("  +", 2) + kept(r"[\n\r\t]") + units(first, 3, 1) + units(letters, 2) - units(first, 2, 1) + units("[0-9]+", 3)
        + 2 * kept(r"[^\x00-\x7F]") + kept(r"[\x00-\x08\x0B\x0C\x0E-\x1F!-/:-@\[-`{-\x7F]")
    )


def tokens_of(units: Column) -> Column:
    return (units + F.ceil(units / F.lit(32.0))).cast("long")


def token_estimate(s: Column) -> Column:
    """Estimated model tokens: the units of a text, plus a thirty-second."""
    return tokens_of(token_units(s))


def human_age(ms: Column) -> Column:
    """``3s``, ``5m``, ``2h`` or ``4d``; negative ages count as none."""
    s = F.floor(F.greatest(ms, F.lit(0)) / 1000)
    return (
        F.when(s < 60, F.concat(s.cast("string"), F.lit("s")))
        .when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit("m")))
        .when(s < 86400, F.concat(F.floor(s / 3600).cast("string"), F.lit("h")))
        .otherwise(F.concat(F.floor(s / 86400).cast("string"), F.lit("d")))
    )


def rfc3339(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(F.floor(ms / 1000) * 1000), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def compact_utc(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(F.floor(ms / 1000) * 1000), "yyyyMMdd'T'HHmmss'Z'")


def to_slash(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def display_path(path: Column, root: Column) -> Column:
    """Relative to the root inside it, else as it is; always with slashes."""
    p, r = to_slash(path), F.regexp_replace(to_slash(root), "/+$", "")
    return F.when(p == r, ".").when(p.startswith(F.concat(r, F.lit("/"))), F.substr(p, F.char_length(r) + 2)).otherwise(p)


def is_outside(path: Column) -> Column:
    """Absolute, or above the workspace."""
    return path.rlike(r"^(/|[A-Za-z]:|\.\.(/|$))")


#: Directories whose files are installed or generated, as they are spelled.
THIRD_PARTY = ("node_modules", "bower_components", "site-packages", "dist-packages", "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".tox", ".nox", ".gradle", ".git")
#: Directories below ``target`` that a build writes.
BUILD_OUTPUT = ("debug", "release", "doc", "tmp")


def is_third_party(path: Column) -> Column:
    """Some directory or file of the path is named like one of installed or generated files, in any case."""
    names = F.split(F.lower(to_slash(path)), "/")
    return F.arrays_overlap(names, F.array(*[F.lit(x) for x in THIRD_PARTY]))


def is_incidental(path: Column) -> Column:
    """Installed, generated or built files: looked up, not worked on."""
    return is_third_party(path) | to_slash(path).rlike(r"(^|/)(\.venv|target/(" + "|".join(BUILD_OUTPUT) + "))(/|$)")


def is_sensitive(path: Column) -> Column:
    """Files whose content is never quoted: keys, environments, credentials; in any case."""
    p = F.regexp_replace(F.lower(to_slash(path)), "/+$", "")
    name = F.regexp_extract(p, r"([^/]*)$", 1)
    by_name = name.rlike(r"^\.env($|\.)|\.(pem|key|p12|pfx|kdbx)$|^id_(rsa|ed25519)|^\.(npmrc|pypirc|netrc)$|credentials|secret")
    return by_name | p.rlike(r"(^|/)\.(ssh|aws)/")


def is_digest(h: Column) -> Column:
    return F.coalesce(h.rlike("^[0-9a-f]{32}$"), F.lit(False))


def names_identifier(word: Column) -> Column:
    """A path, file name, snake or camel case word, qualified name or call."""
    return word.rlike(r"[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+|^[A-Za-z0-9_-]+\.[A-Za-z]{1,5}$|[A-Za-z0-9]+_[A-Za-z0-9]+|[a-z]+[A-Z][A-Za-z0-9]*|::|[A-Za-z0-9_]+\(\)")


def identifiers(s: Column) -> Column:
    """Distinct identifier words in order, without the marks around them."""
    bare = F.transform(F.split(collapse_whitespace(s), " "), lambda w: F.regexp_replace(w, r"^[`'\"(\[{<,;:!?.]+|[`'\"\]}>,;:!?.]+$", ""))
    return F.array_distinct(F.filter(bare, names_identifier))
