"""Quality classifier: random-indexing word vectors pooled per document, then a small network with calibrated output.

Word vectors. Words and runs of punctuation are hashed into ``BUCKETS`` classes (an all-caps word is a class of its own
kind), each with a sparse random index vector. A class's vector sums the index vectors of its neighbours within two
places over every document; Spark adds the tasks' integer sums up, so the table has a fixed size (BUCKETS x DIM) and does
not depend on the order of tasks.

Features. Mean and deviation of the unit word vectors of a whole text, and the mean change from one word to the next.

Network. Two dense layers in numpy (tanh, then logistic), fitted by Adam on at most ``sample`` labelled rows (those of the
smallest hash of doc_id; the one bound here, a parameter), with a fifth of them held back to fit the temperature that
divides the logit.

Defined results: a null or empty text has zero features and gets the score that the network gives these; without labelled
rows of both classes every score is the share of label 1 (0.5 if there is none); several labels of a document all count; of
rows that share an id one teaches (that of the smallest features); an empty table gives an empty table; input columns named
``score`` or ``predicted`` come out as ``in_score`` and ``in_predicted``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, crc_mod, listed, set_aside, table

BUCKETS, DIM, NONZERO = 1 << 14, 32, 4
SAMPLE = 20_000
WORD = re.compile(r"\w+|[^\w\s]+")
CACHE, PIECE = 150_000, 1 << 16


class Hashed(dict):
    """Class of a token; starts afresh when it holds too many."""

    def __missing__(self, token: str) -> int:
        if len(self) > CACHE:
            self.clear()
        kind = "U" if len(token) > 1 and token.isupper() else ""
        self[token] = at = zlib.crc32((kind + token.lower()).encode("utf-8", "replace")) % BUCKETS
        return at


def tokens(text: str | None, seen: Hashed) -> np.ndarray:
    found = WORD.findall(text or "")
    return np.fromiter(map(seen.__getitem__, found), np.int32, len(found))


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.Philox(key=11))
    return rng.integers(0, DIM, (BUCKETS, NONZERO)).astype(np.int32), (rng.integers(0, 2, (BUCKETS, NONZERO)) * 2 - 1).astype(np.int8)


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Unit vectors of all classes, learnt from every row of docs."""
    bounded(docs.sparkSession)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, sign = index_vectors()
        seen, total = Hashed(), np.zeros(BUCKETS * DIM, np.int64)

        def add(chunk: list[np.ndarray]) -> None:
            gap = np.full(2, -1, np.int32)
            line = np.concatenate([x for part in chunk for x in (part, gap)])
            for step in (1, 2):
                a, b = line[:-step], line[step:]
                ok = (a >= 0) & (b >= 0)
                a, b = a[ok], b[ok]
                for word, near in ((a, b), (b, a)):
                    for j in range(NONZERO):
                        total[:] += np.bincount(word * DIM + place[near, j], weights=sign[near, j], minlength=BUCKETS * DIM).astype(np.int64)

        chunk, size = [], 0
        for frame in frames:
            for text in frame["t"]:
                chunk.append(tokens(text, seen))
                size += len(chunk[-1])
                if size > 500_000:
                    add(chunk)
                    chunk, size = [], 0
        if chunk:
            add(chunk)
        rows = total.reshape(BUCKETS, DIM)
        used = np.flatnonzero(rows.any(axis=1))
        yield pd.DataFrame({"b": used, "v": listed(x.tolist() for x in rows[used])})

    parts = docs.select(F.col(text_col).alias("t")).where(F.col("t").isNotNull()).mapInPandas(count, "b int, v array<bigint>")
    added = parts.groupBy("b").agg(*[F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(DIM)]).toPandas()  # BUCKETS rows at most
    out = np.zeros((BUCKETS, DIM), np.float32)
    if len(added):
        values = added[[f"v{i}" for i in range(DIM)]].to_numpy(np.float64)
        out[added["b"].to_numpy()] = values / np.maximum(np.linalg.norm(values, axis=1, keepdims=True), 1e-9)
    return out


def pooled(texts, vectors: np.ndarray, seen: Hashed) -> np.ndarray:
    out = np.zeros((len(texts), 3 * DIM), np.float32)
    for i, text in enumerate(texts):
        at = tokens(text, seen)
        if len(at):
            one, two, change = np.zeros(DIM), np.zeros(DIM), np.zeros(DIM)
            for lo in range(0, len(at), PIECE):  # a piece of a long text at a time
                v = vectors[at[lo : lo + PIECE + 1]]
                change += np.abs(v[1:] - v[:-1]).sum(axis=0)
                v = v[:PIECE]
                one += v.sum(axis=0)
                two += (v * v).sum(axis=0)
            mean = one / len(at)
            out[i, :DIM] = mean
            out[i, DIM : 2 * DIM] = np.sqrt(np.maximum(two / len(at) - mean * mean, 0))
            out[i, 2 * DIM :] = change / max(len(at) - 1, 1)
    return out


class Network:
    """Two layers and a temperature; plain arrays, some 30 kB."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 32, rounds: int = 60, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.prior = float(y.mean()) if len(y) else 0.5
        self.live = len(np.unique(y)) > 1
        if not self.live:
            return
        order = rng.permutation(len(y))
        cut = max(1, len(y) // 5)
        back, use = order[:cut], order[cut:]
        self.mean, self.sd = x[use].mean(axis=0), x[use].std(axis=0) + 1e-3
        z = (x - self.mean) / self.sd
        p = [rng.normal(0, 0.1, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.1, hidden), np.zeros(1)]
        m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for _ in range(rounds):
            for lo in range(0, len(use), 256):
                rows = use[lo : lo + 256]
                a = z[rows]
                h = np.tanh(a @ p[0] + p[1])
                d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3][0], -30, 30))) - y[rows]) / len(rows)
                back_h = np.outer(d, p[2]) * (1 - h * h)
                grads = [a.T @ back_h + 1e-4 * p[0], back_h.sum(axis=0), h.T @ d + 1e-4 * p[2], np.array([d.sum()])]
                t += 1
                for j, g in enumerate(grads):
                    m[j] = 0.9 * m[j] + 0.1 * g
                    v[j] = 0.999 * v[j] + 0.001 * g * g
                    p[j] = p[j] - 3e-3 * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)
        self.p = [a.astype(np.float64) for a in p]
        self.temperature = 1.0
        logit = self.logit(x[back])
        grid = np.exp(np.linspace(-1.5, 2.5, 81))
        loss = [np.mean(np.logaddexp(0, -np.where(y[back] > 0.5, 1, -1) * logit / g)) for g in grid]
        self.temperature = float(grid[int(np.argmin(loss))])

    def logit(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh(((x - self.mean) / self.sd) @ self.p[0] + self.p[1])
        return h @ self.p[2] + self.p[3][0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.live:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, sample: int = SAMPLE) -> Network:
    """docs: doc_id, text; labels: doc_id, quality, of the rows to learn from."""
    known = labels.where("quality is not null and doc_id is not null").select("doc_id", F.col("quality").cast("double").alias("y"))
    chosen = known.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id", "y").limit(sample).drop("h")
    rows = docs.select("doc_id", F.col("text").alias("t")).join(F.broadcast(chosen), "doc_id")  # at most `sample` rows of 24 bytes

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = Hashed()
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "y": frame["y"], "x": listed(pooled(frame["t"].tolist(), vectors, seen))})

    one = rows.mapInPandas(run, "doc_id bigint, y double, x array<float>").groupBy("doc_id", "y").agg(F.min("x").alias("x"))
    got = one.toPandas()  # sample rows at most
    got = got.sort_values(["doc_id", "y"], kind="stable")
    x = np.array(got["x"].tolist(), np.float64).reshape(len(got), 3 * DIM)
    return Network(x, got["y"].to_numpy(np.float64))


def score(docs: DataFrame, vectors: np.ndarray, model: Network, text_col: str = "text") -> DataFrame:
    """docs with score and predicted."""

    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        seen = Hashed()
        for texts in series:
            out = [model.score(pooled(texts.iloc[lo : lo + 512].tolist(), vectors, seen).astype(np.float64)) for lo in range(0, len(texts), 512)]
            yield pd.Series(np.concatenate([np.empty(0), *out]))

    # not deterministic by declaration only: else a filter on the score would be pushed below and the text scored twice
    rated = F.pandas_udf(run, "double").asNondeterministic()
    wide = set_aside(docs.withColumn("__score", rated(F.col(text_col))), "score", "predicted")
    return wide.withColumnRenamed("__score", "score").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = crc_mod(F.col("doc_id"), 3) == 1
    vectors = word_vectors(docs)
    model = fit(docs, table(spark, sf_dir, "labels").where(~held), vectors)
    return score(docs, vectors, model).select("doc_id", held.alias("held_out"), "score", "predicted")
