"""What a shell command was and how it ended.

Outcomes, excerpts and test ids are column expressions; classification reads words in shell quoting and is one Arrow UDF.
"""

from __future__ import annotations

import re
import shlex
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import truncate_chars

RUNNERS = ("test", "build", "lint")
#: Marks of failed and passed runs.
STRONG_FAIL = ("FAILED", "--- FAIL", "test result: FAILED", "error[", "error TS", "Traceback", "✗", "✕")
WEAK_FAIL = ("FAIL ", "failed", "Error:", "ERRORS")
ZERO_COUNTS = (" 0 failed", " 0 failures", " 0 errors", " 0 error", "\t0 failed", "(0 failed", " 0 FAILED")
EXCERPT = ("FAIL", "Error", "error:", "Expected", "Received", "expected", "assert", "panicked", "AssertionError", "Traceback")


def any_of(s: Column, marks) -> Column:
    return s.rlike("|".join(re.escape(m).replace("/", "/") for m in marks))


def outcome(kind: Column, failure_event: Column, exit_code: Column, interrupted: Column, output: Column) -> Column:
    """INTERRUPTED, FAIL, PASS or UNKNOWN; counts of zero failures say nothing, and a pass summary outranks weak marks."""
    text = F.coalesce(output, F.lit(""))
    bare = F.regexp_replace(text, "|".join(re.escape(m) for m in ZERO_COUNTS), " ")
    bare = F.regexp_replace(bare, r"\A0 failed", "")
    lines = F.split(bare, "\n")
    strong = any_of(bare, STRONG_FAIL) | F.exists(lines, lambda x: x.contains(" failed") & x.rlike(r"(^|\s)0*[1-9][0-9]*(\s|$)"))
    summary = bare.contains("test result: ok") | F.exists(
        lines,
        lambda x: (F.trim(x).startswith("Tests:") & x.contains("passed") & ~x.contains("failed"))
        | (F.trim(x).contains(" passed") & ~x.contains("failed") & ~x.contains("error")),
    )
    exit_ok = F.coalesce(exit_code == 0, F.lit(False)) | ~F.coalesce(failure_event, F.lit(False))
    passed = text.contains("passed") | text.rlike(r"(?<![\p{Alnum}_])(PASS|ok)(?![\p{Alnum}_])") | text.contains("0 failed")
    return (
        F.when(F.coalesce(interrupted, F.lit(False)), "INTERRUPTED")
        .when(F.coalesce(failure_event, F.lit(False)) | F.coalesce(exit_code != 0, F.lit(False)), "FAIL")
        .when(~F.coalesce(kind.isin(*RUNNERS), F.lit(False)), "UNKNOWN")
        .when(strong | (any_of(bare, WEAK_FAIL) & ~(exit_ok & summary)), "FAIL")
        .when(passed | exit_ok, "PASS")
        .otherwise("UNKNOWN")
    )


def failure_excerpt(output: Column) -> Column:
    """The last eight lines that tell of a failure, else the last six that are not blank; each at most 200 characters."""
    lines = F.filter(F.transform(F.split(F.coalesce(output, F.lit("")), "\n"), F.rtrim), lambda x: F.trim(x) != "")
    told = F.filter(lines, lambda x: x.startswith("E  ") | any_of(x, EXCERPT))
    last = lambda a, n: F.slice(a, F.greatest(F.size(a) - (n - 1), F.lit(1)), n)
    return F.transform(F.when(F.size(told) > 0, last(told, 8)).otherwise(last(lines, 6)), lambda x: truncate_chars(F.trim(x), 200))


def exit_code_prefix(error: Column) -> Column:
    """The code of a text that begins with ``Exit code N``."""
    return F.regexp_extract(error, r"^Exit code (-?\d+)", 1).try_cast("int")


def path_tokens(text: Column) -> Column:
    """Distinct (path, line) of tokens that look like files, in order, at most sixteen of the first forty."""
    raw = F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(r"((?:[A-Za-z0-9_.-]+/)*[A-Za-z0-9_-]+\.[A-Za-z][A-Za-z0-9]{0,5}(?::\d+)?)"), F.lit(1))), 1, 40)
    parsed = F.transform(raw, lambda x: F.struct(F.regexp_replace(x, r":\d+$", "").alias("path"), F.regexp_extract(x, r":(\d+)$", 1).try_cast("int").alias("line"), x.alias("raw")))
    return F.slice(parsed, 1, 16)


def failing_tests(output: Column) -> Column:
    """Distinct ids of failing tests in order, by the report formats of the common runners."""
    def one(line: Column) -> Column:
        x = F.trim(line)
        grab = lambda p: F.nullif(F.regexp_extract(x, p, 1), F.lit(""))
        return F.coalesce(
            grab(r"^(?:FAILED|ERROR) ([^\s]*(?:::|/|\\|\.py)[^\s]*?)(?: - .*)?$"),
            grab(r"^(\S*::\S*) +FAILED"),
            grab(r"^test (\S+) \.\.\. FAILED$"),
            grab(r"^--- FAIL: (\S+)"),
            grab(r"^(?:FAIL|ERROR): \S+ \((\S+\.\S+)\)$"),
            grab(r"^(?:FAIL|ERROR): (\S+)$"),
            grab("^[✕×] *(.*?)(?: \\([^()]*m?s\\))?$"),
            grab(r"^rspec (?:\./)?(\S+:\d+)"),
            grab(r"^Failed (\S+\.\S+)(?: \[.*)?$"),
        )

    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(output, F.lit("")), "\n"), one), lambda x: x.isNotNull()))


#: Programs whose name alone says what they do.
ALONE = {
    "test": "pytest py.test jest vitest mocha rspec phpunit tox nox ctest".split(),
    "build": ["tsc"],
    "lint": "eslint ruff flake8 mypy pyright golangci-lint rubocop biome".split(),
    "git": ["git"],
}
#: Program, first argument, kind.
BY_ARGUMENT = {
    ("cargo", "test"): "test", ("cargo", "nextest"): "test", ("cargo", "build"): "build", ("cargo", "check"): "build", ("cargo", "clippy"): "lint",
    ("go", "test"): "test", ("go", "build"): "build", ("go", "vet"): "build", ("dotnet", "test"): "test", ("dotnet", "build"): "build",
    ("swift", "test"): "test", ("swift", "build"): "build", ("deno", "test"): "test", ("rails", "test"): "test", ("mix", "test"): "test",
}
#: Program, any argument, kind; the first that fits.
BY_ANY = (
    ("mvn", "test", "test"), ("mvn", "compile", "build"), ("mvn", "package", "build"), ("mvnw", "test", "test"), ("mvnw", "compile", "build"), ("mvnw", "package", "build"),
    ("gradle", "test", "test"), ("gradle", "build", "build"), ("gradlew", "test", "test"), ("gradlew", "build", "build"), ("node", "--test", "test"), ("prettier", "--check", "lint"),
)
WRAPPERS = frozenset("sudo env time npx bunx command exec nice nohup".split())
PRIORITY = ("test", "build", "lint", "git", "other")
ENVIRONMENT = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*=")


def subcommands(command: str) -> list[str]:
    """Parts between ``&&``, ``||``, ``;``, ``|`` and line ends that are not quoted."""
    out, part, quote, i = [], [], "", 0
    while i < len(command):
        c = command[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in ";|&\n":
            if command[i : i + 2] in ("&&", "||"):
                i += 1
            elif c == "&":
                part.append(c)
                i += 1
                continue
            out.append("".join(part).strip())
            part = []
            i += 1
            continue
        part.append(c)
        i += 1
    out.append("".join(part).strip())
    return [x for x in out if x]


def words_of(part: str) -> list[str]:
    try:
        words = shlex.split(part)
    except ValueError:
        words = part.split()
    while words and (ENVIRONMENT.match(words[0]) or words[0].rsplit("/", 1)[-1] in WRAPPERS):
        words = words[1:]
    return words[2:] if words[:2] in (["uv", "run"], ["bundle", "exec"], ["poetry", "run"]) else words


def kind_of(part: str) -> str:
    words = words_of(part)
    if not words:
        return "other"
    name, rest = words[0].replace("\\", "/").rsplit("/", 1)[-1].lower().removesuffix(".exe"), words[1:]
    first = rest[0] if rest else ""
    for kind, names in ALONE.items():
        if name in names:
            return kind
    if name in ("python", "python3", "py"):
        return "test" if first == "-m" and rest[1:2] and rest[1] in ("pytest", "unittest") else "other"
    if name in ("npm", "pnpm", "yarn", "bun"):
        script = rest[1] if first == "run" and len(rest) > 1 else first
        return "test" if script == "test" or (name == "npm" and first == "t") else "build" if script == "build" else "other"
    if name == "make":
        targets = [x for x in rest if not x.startswith("-") and not ENVIRONMENT.match(x)]
        return "test" if "test" in rest else "build" if all(t in ("all", "build") for t in targets) else "other"
    return BY_ARGUMENT.get((name, first)) or next((k for n, a, k in BY_ANY if n == name and a in rest), "other")


def classify(command: str | None) -> str | None:
    """The kind that comes first in PRIORITY among the parts of a command."""
    if command is None:
        return None
    return min((kind_of(p) for p in subcommands(command)), key=PRIORITY.index, default="other")


def signature(command: str | None) -> str | None:
    """Kind and words without the environment and what only changes the report."""
    if command is None:
        return None
    words = [w for p in subcommands(command) for w in words_of(p) if not re.match(r"--?(color|colour|reporter)", w)]
    return f"{classify(command)}:{' '.join(words)}"


def described(command: str | Column) -> Column:
    """struct<kind, signature> of a command."""

    def run(commands: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in commands:
            yield pd.DataFrame({"kind": [classify(x) for x in batch], "signature": [signature(x) for x in batch]}, dtype=object)

    return F.pandas_udf(run, "kind string, signature string")(command)
