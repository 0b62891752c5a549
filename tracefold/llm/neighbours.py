"""Approximate nearest neighbours: a forest of random-projection trees searched through one shared priority queue.

Fit. Each tree has a random direction per level; a node's threshold is the median projection of the sample points that reach
it (of all sample points where fewer than 8 do). The sample is bounded (``SAMPLE`` vectors of the smallest hash), the index
is not: every vector is put into its leaf of every tree. The number of levels follows the number of vectors.

Search. Per query one priority queue holds the branches of all trees, ordered by the largest margin crossed on the way; the
nearest leaves are taken until the visit budget is spent. The budget, a share of a tree's leaves, is the smallest that reaches
``TARGET`` recall on the sample, against brute force there. Candidates of the visited leaves are ranked by exact cosine. A
query that has met fewer than k others so searches again in every leaf.

Spark's part. Leaves are grouped into buckets of 64; vectors and queries meet per bucket (queries in chunks), each meeting
returns at most k rows per query. Equal vectors are one class that carries its k + 1 smallest ids, so a vector held by a
third of all rows is one vector here.

Defined results: vectors that are null, empty or zero, or hold null or non-finite components, take no part, neither as query nor
as candidate; nor do vectors of another length than the commonest (the shorter on ties); an id that occurs more than once
counts once, with its smallest vector; equal scores rank by smaller id; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

TREES, SAMPLE, LEAF, TARGET = 6, 8192, 80, 0.965
GRID = (0.02, 0.05, 0.1, 0.2, 0.3, 0.45, 0.6, 0.8, 1.0, 1.25, 1.6, 2.2, 3.0)
#: A reach (in leaves of one tree) that visits every leaf of every tree.
GRID_ALL = float(TREES)
BUCKET_BITS, QUERY_CHUNK = 6, 16_384


class Forest:
    """Directions and thresholds of all trees; its size depends on the sample only."""

    def __init__(self, unit: np.ndarray, levels: int, trees: int = TREES, seed: int = 17) -> None:
        rng = np.random.Generator(np.random.Philox(key=seed))
        self.trees, self.levels = trees, levels
        self.directions = rng.normal(size=(trees, unit.shape[1], max(levels, 1)))
        self.common = np.zeros((trees, max(levels, 1)))
        self.thresholds: list[list[np.ndarray]] = []
        deep = min(levels, max(0, int(math.log2(max(len(unit), 1) / 8))))
        for t in range(trees):
            side = unit @ self.directions[t]
            self.common[t] = np.median(side, axis=0)
            node, rows = np.zeros(len(unit), np.int64), []
            for level in range(deep):
                cut = np.full(1 << level, self.common[t, level])
                order = np.argsort(node, kind="stable")
                ends = np.searchsorted(node[order], np.arange((1 << level) + 1))
                for k in range(1 << level):
                    here = order[ends[k] : ends[k + 1]]
                    if len(here) >= 8:
                        cut[k] = np.median(side[here, level])
                rows.append(cut)
                node = node * 2 + (side[:, level] > cut[node])
            self.thresholds.append(rows)

    def cut(self, t: int, level: int, node):
        return self.thresholds[t][level][node] if level < len(self.thresholds[t]) else self.common[t, level]

    def leaves(self, unit: np.ndarray) -> np.ndarray:
        out = np.zeros((self.trees, len(unit)), np.int64)
        for t in range(self.trees):
            side = unit @ self.directions[t]
            for level in range(self.levels):
                out[t] = out[t] * 2 + (side[:, level] > self.cut(t, level, out[t]))
        return out

    def visits(self, unit: np.ndarray, share: float) -> list[tuple[int, int]]:
        """(tree, leaf) pairs of one query, nearest first."""
        side = np.einsum("tdl,d->tl", self.directions, unit)
        budget = min(self.trees << self.levels, max(self.trees, math.ceil(share * (1 << self.levels))))
        queue = [(0.0, t, 0, 0) for t in range(self.trees)]
        out = []
        while queue and len(out) < budget:
            worst, t, level, node = heapq.heappop(queue)
            while level < self.levels:
                margin = side[t, level] - self.cut(t, level, node)
                right = margin > 0
                heapq.heappush(queue, (max(worst, abs(margin)), t, level + 1, node * 2 + (not right)))
                node, level = node * 2 + bool(right), level + 1
            out.append((t, node))
        return out

    def calibrated(self, unit: np.ndarray, k: int, target: float = TARGET, queries: int = 120) -> float:
        """The smallest share of GRID whose recall on the sample reaches the target."""
        if len(unit) <= k + 1 or not self.levels:
            return GRID[-1]
        leaf = self.leaves(unit)
        ask = np.linspace(0, len(unit) - 1, min(queries, len(unit))).astype(int)
        score = unit[ask] @ unit.T
        score[np.arange(len(ask)), ask] = -2
        best = np.argpartition(-score, k, axis=1)[:, :k]
        first = np.zeros((len(ask), k))  # the visit that finds each true neighbour
        for i, q in enumerate(ask):
            order = {v: n for n, v in enumerate(self.visits(unit[q], GRID[-1]))}
            first[i] = [min(order.get((t, int(leaf[t, b])), 1 << 60) for t in range(self.trees)) for b in best[i]]
        return next((g for g in GRID if (first < max(self.trees, math.ceil(g * (1 << self.levels)))).mean() >= target), GRID[-1])


def usable(v: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, finite) & F.exists(v, lambda x: x != 0)


def normal(rows) -> np.ndarray:
    x = np.array(list(rows), np.float64)
    scaled = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)  # no overflow of squares
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def search(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 17) -> DataFrame:
    """The k nearest of each row of vectors that queries (a condition on id and v) holds for: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if size is None:
        return empty
    rows = rows.where(F.size("v") == size["n"]).groupBy("id").agg(F.min("v").alias("v"))
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= k + 1)
    classes = materialise(ranked.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    asked = materialise(rows.where(queries))
    n, many = classes.count(), asked.count()
    sample = normal(r["v"] for r in classes.select("v", F.xxhash64("v").alias("h")).orderBy("h").limit(SAMPLE).collect())
    levels = max(0, math.ceil(math.log2(max(n, 1) / LEAF)))
    forest = Forest(sample, levels, seed=seed)
    share = forest.calibrated(sample, k)
    shift, chunks = min(BUCKET_BITS, levels), max(1, math.ceil(many / QUERY_CHUNK))
    high = levels - shift

    def index(frames):
        for f in frames:
            if len(f):
                leaf = forest.leaves(normal(f["v"]))
                for t in range(forest.trees):
                    for c in range(chunks):
                        yield pd.DataFrame({"bucket": t << high | leaf[t] >> shift, "chunk": c, "leaf": leaf[t] & ((1 << shift) - 1), "ids": f["ids"], "v": f["v"]})

    def visit(reach: float):
        def run(frames):
            for f in frames:
                if not len(f):
                    continue
                out = []
                for qid, v, unit in zip(f["id"], f["v"], normal(f["v"]), strict=True):
                    masks: dict[int, int] = {}
                    for t, leaf in forest.visits(unit, reach):
                        b = t << high | leaf >> shift
                        masks[b] = masks.get(b, 0) | 1 << (leaf & ((1 << shift) - 1))
                    out += [(b, qid % chunks, qid, m - (m >> 63 << 64), v) for b, m in masks.items()]
                yield pd.DataFrame(out, columns=["bucket", "chunk", "qid", "mask", "v"])

        return run

    def rank(side: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})
        if not len(side) or not len(ask):
            return none
        unit, leaf, ids = normal(side["v"]), side["leaf"].to_numpy(), side["ids"].tolist()
        smallest = np.array([x[0] for x in ids])
        out = []
        for lo in range(0, len(ask), 256):
            part = ask.iloc[lo : lo + 256]
            score = normal(part["v"]) @ unit.T
            score[(part["mask"].to_numpy()[:, None] >> leaf[None, :] & 1) == 0] = -9
            for qid, line in zip(part["qid"].tolist(), score, strict=True):
                m = k + 1
                at = np.flatnonzero(line >= np.partition(line, -m)[-m]) if len(line) > m else np.arange(len(line))
                at = at[line[at] > -8]
                at = at[np.lexsort((smallest[at], -line[at]))][:m]
                found = sorted((-line[i], v) for i in at for v in ids[i] if v != qid)[:k]
                out += [(qid, v, -s) for s, v in found]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"}) if out else none

    def meet(ask: DataFrame, reach: float) -> DataFrame:
        left = classes.mapInPandas(index, "bucket bigint, chunk bigint, leaf bigint, ids array<bigint>, v array<double>")
        right = ask.repartition(max(1, spark.sparkContext.defaultParallelism), "id").mapInPandas(visit(reach), "bucket bigint, chunk bigint, qid bigint, mask bigint, v array<double>")
        return left.groupBy("bucket", "chunk").cogroup(right.groupBy("bucket", "chunk")).applyInPandas(rank, "query_id bigint, vec_id bigint, score double")

    met, wide = meet(asked, share), share < GRID_ALL
    best = materialise(met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")))
    if wide:  # queries whose leaves held fewer than k others search again, in every leaf
        full = best.groupBy("query_id").agg(F.count("*").alias("c")).where(F.col("c") >= k).select(F.col("query_id").alias("id"))
        few = asked.join(full, "id", "left_anti")
        if not few.isEmpty():
            best = best.unionByName(meet(few, GRID_ALL)).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)
