"""Quality rules: statistics of whole texts, and an isolation forest over them.

Statistics. Words are runs of other characters than blanks; counted are their code points, symbols, lines that repeat an earlier one,
and the words inside three-word windows that occur at least twice. Two fixed rules reject a text: fewer than 50 words, or more than half of
them in repeated windows.

Forests. Ratios of these statistics, and of capitals, digits, other signs, word length and words per line, in six groups (``GROUPS``); each
group has a forest that splits its ratios at random places. A text that is isolated after few splits is unlike the others: its
score is 2^(-mean path length / that of a random tree). Ratios lean towards those of a usual text by ``USUAL`` words, so that a short text is
not odd by chance; length itself is no ratio, so a long one is not odd for being long. One forest over all ratios at once was
tried: texts with a date or a repeated line are isolated as fast as junk there (16 % of the bad found at a loss of 0.5 %).

Thresholds. All labelled rows, in bins of their scores. The group and cut of the largest gain (share of the bad found less share of the good
lost) come first, then those with the largest gain on what is left, while there is a gain; all cuts together lose at most ``LOSS`` of
the good; of cuts that do equally well the middle one. The trees are fitted on a bounded sample of the labelled rows (TREES x
SAMPLE, those of the smallest hash), the one bound here and a parameter.

Spark's part. Texts are read once; what is written of them is a row of numbers. Labels meet these rows on the id, counted per id first.

Defined results: a null or empty text has zeros and is rejected by the first rule; without labels of both kinds the rules alone decide;
a repeated document counts each time; an id with several labels is good by majority, bad on a tie; labels that are neither 0 nor 1, or
without an id, are ignored; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, listed, materialise, pieces, table

LEAST_WORDS, MOST_REPEATED = 50, 50
TREES, SAMPLE = 128, 256
BINS, LOSS = 4096, 0.005
#: Words of a usual text that every ratio is mixed with.
USUAL = 100
GROUPS = ("symbols", "signs", "repeats", "capitals", "digits", "shape")

BLANK = b"\t\n\x0b\x0c\r "
BLANKS = re.compile(b"[\x20\x09-\x0d]")
SYMBOLS = b"#*$%&|<>"
CAPITALS, SMALL, DIGITS = (bytes(range(a, b + 1)) for a, b in ((65, 90), (97, 122), (48, 57)))
#: The later bytes of a code point, which are no characters of their own.
LATER = bytes(range(0x80, 0xC0))
HIGH = bytes(range(0x80, 0x100))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Beside COUNTS, for the ratios.
MORE = ("n_lines", "n_capitals", "n_small", "n_digits", "n_signs")


def covered(ids: np.ndarray, kinds: int) -> int:
    """Words in three-word windows that occur at least twice."""
    if len(ids) < 4:
        return 0
    a = ids.astype(np.int64)
    pair = a[:-1] * kinds + a[1:]
    if kinds >= 1 << 20:  # else pair * kinds fits in 62 bits
        pair = np.unique(pair, return_inverse=True)[1]
    _, at, n = np.unique(pair[:-1] * kinds + a[2:], return_inverse=True, return_counts=True)
    twice = n[at] > 1
    mark = np.zeros(len(ids), bool)
    for k in range(3):
        mark[k : k + len(twice)] |= twice
    return int(mark.sum())


def statistics(data: bytes | None) -> tuple[int, ...]:
    """COUNTS, then MORE, of one text."""
    data = data or b""
    kinds: dict[bytes, int] = {}
    parts = [np.fromiter((kinds.setdefault(w, len(kinds)) for w in piece.split()), np.int64) for piece in pieces(data, BLANKS)]
    ids = np.concatenate(parts) if parts else np.empty(0, np.int64)
    lines = [x for x in data.split(b"\n") if x.strip()]
    gone = lambda which: len(data) - len(data.translate(None, which))
    plain = len(data.translate(None, LATER + BLANK))
    capitals, small, digits, high = gone(CAPITALS), gone(SMALL), gone(DIGITS), gone(HIGH) - gone(LATER)
    return (
        len(ids), plain, gone(SYMBOLS), len(lines) - len(set(lines)), covered(ids, len(kinds)),
        len(lines), capitals, small, digits, plain - capitals - small - digits - high,
    )


def ratios(x: np.ndarray) -> dict[str, np.ndarray]:
    """What the trees of each group split, from rows of COUNTS and MORE."""
    words, chars, symbols, twice, repeated, lines, capitals, small, digits, signs = np.asarray(x, np.float64).reshape(-1, len(COUNTS) + len(MORE)).T
    usual_chars, usual_lines = 5 * USUAL, USUAL / 8
    return {
        "symbols": np.stack([symbols / (chars + usual_chars)], axis=1),
        "signs": np.stack([symbols / (chars + usual_chars), signs / (chars + usual_chars)], axis=1),
        "repeats": np.stack([twice / (lines + usual_lines), repeated / (words + USUAL)], axis=1),
        "capitals": np.stack([capitals / (capitals + small + usual_chars)], axis=1),
        "digits": np.stack([digits / (chars + usual_chars)], axis=1),
        "shape": np.stack([(chars + usual_chars) / (words + USUAL), np.log((words + USUAL) / (lines + usual_lines))], axis=1),
    }


def path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search in a random tree of n rows."""
    n = np.asarray(n, np.float64)
    m = np.maximum(n, 2)
    return np.where(n > 2, 2 * (np.log(m - 1) + np.euler_gamma) - 2 * (m - 1) / m, np.where(n == 2, 1.0, 0.0))


class Forest:
    """Trees as arrays, node k's children at 2k + 1 and 2k + 2; some 9 kB each at SAMPLE rows."""

    def __init__(self, x: np.ndarray, trees: int = TREES, sample: int = SAMPLE, seed: int = 23) -> None:
        rng = np.random.Generator(np.random.Philox(key=seed))
        self.live = len(x) > 1
        if not self.live:
            return
        size = min(sample, len(x))
        self.depth, self.usual = int(np.ceil(np.log2(size))), float(path(size))
        nodes = (2 << self.depth) - 1
        self.which, self.cut, self.length = np.full((trees, nodes), -1, np.int8), np.zeros((trees, nodes)), np.zeros((trees, nodes))
        for t in range(trees):
            grow = [(0, 0, x[rng.choice(len(x), size, replace=False)])]
            while grow:
                node, level, rows = grow.pop()
                spread = np.flatnonzero(rows.max(axis=0) > rows.min(axis=0)) if len(rows) else []
                if level == self.depth or len(rows) < 2 or not len(spread):
                    self.length[t, node] = level + path(len(rows))
                    continue
                j = rng.choice(spread)
                cut = rng.uniform(rows[:, j].min(), rows[:, j].max())
                self.which[t, node], self.cut[t, node] = j, cut
                low = rows[:, j] <= cut
                grow += [(2 * node + 1, level + 1, rows[low]), (2 * node + 2, level + 1, rows[~low])]

    def score(self, x: np.ndarray) -> np.ndarray:
        """From 0 to 1; higher is odder."""
        if not self.live or not len(x):
            return np.zeros(len(x))
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for which, cut, length in zip(self.which, self.cut, self.length, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                j = which[node]
                inner = j >= 0
                node = np.where(inner, 2 * node + 1 + (x[rows, np.maximum(j, 0)] > cut[node]), node)
            total += length[node]
        return 2.0 ** (-total / len(self.which) / self.usual)


def threshold(good: np.ndarray, bad: np.ndarray, goods: int, bads: int, loss: float) -> tuple[float, int, float]:
    """(gain, bin, share of the good lost) of the best cut: scores in that bin or above are odd. good and bad count by bin the labelled rows that are left."""
    lost = np.append(good[::-1].cumsum()[::-1], 0) / goods
    found = np.append(bad[::-1].cumsum()[::-1], 0) / bads
    gain = np.where(lost <= loss, found - lost, -1)
    best = np.flatnonzero(gain == gain.max())
    at = int(best[len(best) // 2])
    return float(gain[at]), at, float(lost[at])


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the statistics of every row of docs."""
    names = COUNTS + MORE

    def run(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in series:
            yield pd.DataFrame(np.array([statistics(x) for x in texts], np.int64).reshape(len(texts), len(names)), columns=list(names))

    told = F.pandas_udf(run, ", ".join(f"{n} bigint" for n in names)).asNondeterministic()
    bounded(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), told(F.col(text_col).cast("binary")).alias("s"))
    return rows.select("doc_id", "s.*")


def scored(rows: DataFrame, forests: dict[str, Forest]) -> DataFrame:
    """rows with the bin of each group's score, in the order of GROUPS."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for part in parts:
            x = ratios(part[list(COUNTS + MORE)].to_numpy())
            score = np.stack([forests[g].score(x[g]) for g in GROUPS], axis=1)
            yield listed(np.minimum(score * BINS, BINS - 1).astype(np.int32).tolist())

    return rows.withColumn("bins", F.pandas_udf(run, "array<int>").asNondeterministic()(F.struct(*COUNTS, *MORE)))


def odd(cuts: dict[str, int]) -> Column:
    """The groups whose cut a row's bins reach, comma-joined; empty if none."""
    return F.concat_ws(",", *[F.when(F.col("bins")[GROUPS.index(g)] >= cut, F.lit(g)) for g, cut in cuts.items()])


def fit(rows: DataFrame, labels: DataFrame, label_col: str = "quality", loss: float = LOSS) -> tuple[dict[str, Forest], dict[str, int]]:
    """The forests, and the cuts by group, from measured rows and labels (doc_id, 1 good or 0 bad)."""
    one = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isin(0, 1)).groupBy("doc_id").agg((F.avg(F.col(label_col)) > 0.5).alias("good"))
    known = rows.where(~failed()).join(one, "doc_id")
    chosen = known.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id", *COUNTS, *MORE).limit(TREES * SAMPLE)
    x = ratios(chosen.select(*COUNTS, *MORE).toPandas().to_numpy())  # TREES x SAMPLE rows of ten numbers
    forests = {g: Forest(x[g]) for g in GROUPS}
    left = materialise(scored(known, forests).select("good", "bins"))
    n = {r["good"]: r["count"] for r in left.groupBy("good").count().collect()}
    cuts: dict[str, int] = {}
    while len(n) == 2 and len(cuts) < len(GROUPS):
        bins = left.select("good", F.posexplode("bins").alias("g", "b")).groupBy("good", "g", "b").count().collect()  # 2 x GROUPS x BINS at most
        count = np.zeros((2, len(GROUPS), BINS), np.int64)
        for r in bins:
            count[int(r["good"]), r["g"], r["b"]] = r["count"]
        best = [(threshold(count[1, i], count[0, i], n[True], n[False], loss), g) for i, g in enumerate(GROUPS) if g not in cuts]
        (gain, at, lost), g = max(best, key=lambda b: b[0][0])  # the first on ties
        if gain <= 0:
            break
        cuts[g], loss = at, loss - lost
        left = left.where(F.col("bins")[GROUPS.index(g)] < at)
    return forests, cuts


def failed() -> Column:
    """The fixed rules."""
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, the statistics, base_failed, kept and odd (the groups that find it odd)."""
    rows = materialise(measured(docs, id_col, text_col))
    forests, cuts = fit(rows, labels)
    told = scored(rows, forests).withColumn("base_failed", failed()).withColumn("odd", odd(cuts))
    return told.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & (F.col("odd") == "")).alias("kept"), "odd")


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
