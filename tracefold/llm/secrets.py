"""Secret scans: fixed patterns, and a battery of randomness tests on long tokens.

Everything is a Spark column expression on the text of one row, so a scan has no shuffle but the one that adds up a
histogram of a few hundred rows; nothing is collected but those counts.

The battery. A candidate is a maximal run of 20 or more of ``[A-Za-z0-9+/_=-]`` outside the base spans. Its alphabet is
inferred (hex of either case, with hyphens or without, base32, lower-case letters with digits, letters, base64). Then:

* likelihood ratio of the token as ordinary text and as random symbols of its alphabet. Text: letters at their mean
  rates in English, German, French and Spanish, digits at 0.1 each, signs at 1/3 each, and a change between
  upper case, lower case, digits and signs after a symbol with probability 0.25. Whatever text of that law holds, the
  ratio is a p-value (Markov's inequality), at every length;
* chi-squared statistic of its symbols against the uniform alphabet. Its law for ordinary text of the same length is
  a non-central chi-squared one with ``L * (k * coincidence - 1)`` as non-centrality; the lower tail gives a p-value
  of "this is text", which falls as the token gets longer. The smaller of the two p-values, doubled, counts;
* Wald-Wolfowitz runs test above and below the middle of the alphabet, and lag-1 serial correlation. A token that
  either rejects at 0.001 is not random, and its p-value counts as 1.

The Benjamini-Hochberg rule at ``fdr`` is then applied within each class of lengths, over the candidates of all rows:
long tokens do not pay for the many short words. P-values are binned by their decimal logarithm (steps of 0.05), so
the rule needs counts only.

Defined results: a null text is an empty text; no match gives an empty array; repeated rows each get their own result;
an empty table gives an empty table; other columns are not touched, but that scan calls input columns named ``spans`` or
``base_spans`` ``in_spans`` and ``in_base_spans``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import set_aside, table

ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
HEXED = r"^(?:[0-9a-f]+(?:-[0-9a-f]+)*|[0-9A-F]+(?:-[0-9A-F]+)*)$"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "random")
SPAN = "array<struct<start:int,kind:int,stop:int,value:string>>"
#: (name, symbols in order, their number, coincidence rate of ordinary text over them)
ALPHABETS = (
    ("hex", "0123456789abcdef", 16, 0.12),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 32, 0.066),
    ("lower", "abcdefghijklmnopqrstuvwxyz", 26, 0.066),
    ("alnum", "0123456789abcdefghijklmnopqrstuvwxyz", 36, 0.06),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 64, 0.058),
)
LENGTHS = (20, 28, 40, 64, 128, 512)
STEP, LOW = 0.05, -400.0
#: Letters a to z in ordinary text, per mille: means of English, German, French and Spanish, accents apart.
LETTERS = (85, 16, 32, 45, 140, 14, 19, 30, 68, 4, 6, 45, 28, 76, 61, 19, 6, 66, 74, 68, 40, 12, 11, 2, 8, 5)
CHANGE = 0.25


def spans_of(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Leftmost matches that do not overlap, as spans in code points; pieces between matches give the starts."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("hit"))
    if group:
        zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("hit"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part"))
    part = (lambda x: x["part"]) if group else (lambda x: x["hit"])
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + F.length(x["gap"])
        stop = at + F.coalesce(F.length(x["hit"]), F.lit(0))
        one = F.array(F.struct(at.alias("start"), F.lit(kind).alias("kind"), stop.alias("stop"), part(x).alias("value"))).cast(SPAN)
        keep = x["hit"].isNotNull() & (F.length(part(x)) >= least)
        return F.struct(stop.alias("at"), F.when(keep, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(zipped, start, step, lambda acc: acc["out"])).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    return F.array_sort(F.concat(spans_of(text, ASSIGN, 0, 1, 8), spans_of(text, ACCESS, 1), spans_of(text, HEX, 2)))


def log_tail(z: Column) -> Column:
    """Decimal logarithm of the normal distribution function, with the usual expansion in the far tail."""
    far = (-z * z / 2 - F.log(F.abs(z) * math.sqrt(2 * math.pi)) + F.log1p(-1 / (z * z))) / math.log(10)
    near = -F.log10(1 + F.exp(-(1.5976 * z + 0.07056 * z * z * z)))
    return F.when(z < -3, far).otherwise(near)


def log_text(body: Column, chars: Column) -> Column:
    """Decimal logarithm of the probability of body as ordinary text; see the module."""
    rates = [math.log10(x / sum(LETTERS)) for x in LETTERS] + [-1.0] * 10 + [math.log10(1 / 3)] * 3
    rate = F.array(*[F.lit(x) for x in rates])
    symbols = F.lit("abcdefghijklmnopqrstuvwxyz0123456789+/=")
    by_symbol = F.aggregate(chars, F.lit(0.0), lambda acc, c: acc + F.coalesce(F.get(rate, F.instr(symbols, F.lower(c)) - 1), F.lit(0.0)))
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(body, "[0-9]", "#"), "[A-Z]", "A"), "[a-z]", "b"), "[+/=]", "-")
    stretches = F.length(F.regexp_replace(kinds, r"(.)\1+", "$1"))
    changes = (stretches - 1).cast("double")
    return by_symbol + changes * math.log10(CHANGE / 3) + (F.length(body) - stretches) * math.log10(1 - CHANGE) - math.log10(4)


def text_score(token: Column) -> Column:
    """Decimal logarithm of the p-value of "this token is ordinary text"; null where not random at all."""
    encoding = (
        F.when(token.rlike(HEXED), 0)
        .when(token.rlike(r"^[A-Z2-7]+=*$"), 1)
        .when(token.rlike(r"^[a-z]+$"), 2)
        .when(token.rlike(r"^[0-9a-z]+$"), 3)
        .otherwise(4)
    )
    pick = lambda i: F.element_at(F.array(*[F.lit(a[i]) for a in ALPHABETS]), encoding + 1)
    body = F.translate(F.rtrim(F.regexp_replace(token, "=+$", "")), "-_", "+/")
    body = F.when(encoding == 0, F.lower(F.replace(body, F.lit("+"), F.lit("")))).otherwise(body)
    k, rate, symbols = pick(2).cast("double"), pick(3), pick(1)
    size = F.length(body).cast("double")
    chars = F.split(body, "")
    squares = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc + F.pow(size - F.length(F.replace(body, c, F.lit(""))), F.lit(2.0)))
    chi = k / size * squares - size
    beyond = size * (k * rate - 1)
    z = (chi - (k - 1 + beyond)) / F.sqrt(2 * (k - 1 + 2 * beyond))
    value = F.transform(chars, lambda c: F.instr(symbols, c).cast("double") - (k + 1) / 2)
    bits = F.array_join(F.transform(value, lambda v: F.when(v > 0, "1").otherwise("0")), "")
    above = F.length(F.replace(bits, F.lit("0"), F.lit(""))).cast("double")
    below = size - above
    runs = F.length(F.regexp_replace(F.regexp_replace(bits, "0+", "0"), "1+", "1")).cast("double")
    mean = 2 * above * below / size + 1
    spread = (mean - 1) * (mean - 2) / (size - 1)
    by_runs = F.when((above > 0) & (below > 0) & (spread > 0), F.abs((runs - mean) / F.sqrt(spread))).otherwise(F.lit(99.0))
    total = F.aggregate(value, F.lit(0.0), lambda acc, v: acc + v) / size
    power = F.aggregate(value, F.lit(0.0), lambda acc, v: acc + (v - total) * (v - total))
    lagged = F.aggregate(F.zip_with(value, F.slice(value, 2, F.greatest(F.size(value) - 1, F.lit(1))), lambda a, b: (a - total) * (b - total)), F.lit(0.0), lambda acc, v: acc + F.coalesce(v, F.lit(0.0)))
    by_lag = F.when(power > 0, F.abs(lagged / power) * F.sqrt(size)).otherwise(F.lit(99.0))
    ratio = log_text(body, chars) + size * F.log10(k)
    return F.when((size >= LENGTHS[0]) & (by_runs < 3.29) & (by_lag < 3.29), F.least(ratio, log_tail(z)) + math.log10(2))


def length_class(size: Column) -> Column:
    return sum(((size >= n).cast("int") for n in LENGTHS[1:]), F.lit(0))


def candidates(text: Column, base: Column) -> Column:
    """Spans of tokens outside the base spans, each with its score's bin and class of lengths."""
    free = F.filter(spans_of(text, CANDIDATE, 3), lambda s: ~F.exists(base, lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])))
    return F.transform(
        free,
        lambda s: F.struct(
            s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"), s["value"].alias("value"),
            F.floor((F.least(F.greatest(F.coalesce(text_score(s["value"]), F.lit(0.0)), F.lit(LOW)), F.lit(0.0)) - LOW) / STEP).cast("int").alias("bin"),
            length_class(s["stop"] - s["start"]).alias("cls"),
        ),
    )


def thresholds(df: DataFrame, text_col: str, fdr: float) -> dict[int, int]:
    """The largest bin that the Benjamini-Hochberg rule accepts in each class of lengths, from counts over all rows."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    one = df.where(F.col(text_col).rlike(CANDIDATE)).select(F.explode(candidates(text, base_spans(text))).alias("c"))
    counts: dict[int, dict[int, int]] = {}
    for r in one.groupBy(F.col("c.cls").alias("cls"), F.col("c.bin").alias("bin")).count().collect():  # classes x bins rows at most
        counts.setdefault(r["cls"], {})[r["bin"]] = r["count"]
    best = {}
    for cls, bins in counts.items():
        total, seen = sum(bins.values()), 0
        for b in sorted(bins):
            seen += bins[b]
            if 10 ** (LOW + (b + 1) * STEP) <= fdr * seen / total:
                best[cls] = b
    return best


def marked(df: DataFrame, text_col: str, fdr: float) -> DataFrame:
    """df with __base and __spans."""
    best = thresholds(df, text_col, fdr)
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = df.withColumn("__base", base_spans(text))

    def accepted(c: Column) -> Column:
        rule = F.lit(False)
        for cls, b in best.items():
            rule = rule | ((c["cls"] == cls) & (c["bin"] <= b))
        return rule

    found = F.filter(candidates(text, F.col("__base")), accepted)
    slim = F.transform(found, lambda c: F.struct(c["start"], c["kind"], c["stop"], c["value"])).cast(SPAN)
    added = F.when(text.rlike(CANDIDATE), slim).otherwise(F.array().cast(SPAN)) if best else F.array().cast(SPAN)
    return base.withColumn("__spans", F.array_sort(F.concat(F.col("__base"), added)))


def scan(df: DataFrame, text_col: str = "text", fdr: float = 0.01) -> DataFrame:
    """Adds base_spans and spans (base and random ones) to the rows of df; see the module for the method."""
    found = marked(df.withColumn("__text", F.col(text_col)), "__text", fdr)
    return set_aside(found.drop("__text"), "base_spans", "spans").withColumnsRenamed({"__base": "base_spans", "__spans": "spans"})


def as_string(spans: Column) -> Column:
    kind = lambda s: F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redact(df: DataFrame, text_col: str = "text", fdr: float = 0.01) -> DataFrame:
    """df with each span's characters, merged where spans overlap, replaced by ``[SECRET]``; same columns, same rows."""
    found = marked(df.withColumnRenamed(text_col, "__text"), "__text", fdr)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col("__text"), acc["at"] + 1, s["start"] - acc["at"])
        fresh = F.struct(s["stop"].alias("at"), F.concat(acc["out"], gap, F.lit("[SECRET]")).alias("out"))
        inside = F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), acc["out"].alias("out"))
        return F.when((s["start"] < acc["at"]), inside).otherwise(fresh)

    clean = F.aggregate(F.col("__spans"), start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("__text"), acc["at"] + 1, F.length(F.col("__text")))))
    text = F.when(F.size("__spans") > 0, clean).otherwise(F.col("__text"))
    return found.select(*[text.alias(c) if c == text_col else F.col(c) for c in df.columns])


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs)
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(as_string(F.col("base_spans")), 256).alias("base_sha256"), as_string(F.col("spans")).alias("spans"),
    )
