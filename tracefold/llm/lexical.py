"""Ranked lexical search as a blocked sparse matrix product.

Rows of the left matrix are item texts, its columns terms, its values how often the item holds the term. The right matrix has a row of
int64 impacts per term, with a column per document: weight(term) * ((10^9 * tf) div (1000 * tf + 12 * m)). Their product, taken row by row
(Gustavson: an item's row merges the rows of its terms into one accumulator), is every score; each block of documents reduces its
part of a row to the k best, and so do blocks of blocks.

Spark's part. Texts are split once per block of items: a document's counts of the block's terms are written as two small arrays beside
its length, and N, L and df are sums over that table. The product runs where these rows lie; a task returns at most k rows per item.
Items reach the tasks in blocks of some ``ENTRIES`` (item, term) entries, more than 30,000 items of usual length, so documents are read once
unless there are more. Equal texts are one item until the end.

Defined results: a null text, or one without a term, is no document, and as an item finds nothing; of equal scores the smaller doc_id
comes first, null last; rows with a repeated doc_id are documents of their own, rows with a repeated item_id items of their own;
empty tables give an empty table; other columns are not looked at. Scores are exact in 64 bits.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, listed, materialise, pieces, table

K, ENTRIES = 20, 1 << 20
#: Documents, and entries of the right matrix, in a block of it.
BLOCK, POSTINGS = 8192, 1 << 21
#: Partial lists of an item that are reduced together first.
SALTS = 64

#: A term's bytes are ASCII letters and digits, and all bytes of other characters.
GAP = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
FOLD = bytes(ord(" ") if GAP.match(bytes([b])) else b + 32 if 65 <= b <= 90 else b for b in range(256))


def counted(data: bytes | None) -> tuple[int, Counter[bytes]]:
    """How many terms a text has, and how often each."""
    n, out = 0, Counter()
    for piece in pieces(data or b"", GAP):
        found = piece.translate(FOLD).split()
        n += len(found)
        out.update(found)
    return n, out


def rows_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of the left matrix from (key, data)."""
    for f in frames:
        found = [counted(x)[1] for x in f["data"]]
        yield pd.DataFrame({"key": f["key"], "terms": listed(list(c) for c in found), "times": listed(list(c.values()) for c in found)})


class Product:
    """The left block with weights; multiplies blocks of the right matrix and keeps the k best documents of every row."""

    def __init__(self, items: list[tuple[np.ndarray, np.ndarray]], weight: np.ndarray, n: int, length: int, k: int) -> None:
        self.items, self.weight, self.n, self.length, self.k = items, weight, n, length, k
        self.best = [(np.empty(0, np.int64),) * 3 for _ in items]

    def add(self, ids: np.ndarray, null: np.ndarray, sizes: np.ndarray, at: list[np.ndarray], tf: list[np.ndarray]) -> None:
        lens = np.array([len(x) for x in at])
        doc = np.repeat(np.arange(len(ids)), lens)
        term, tf = np.concatenate(at).astype(np.int64), np.concatenate(tf).astype(np.int64)
        m = 75 + 25 * sizes * self.n // self.length
        impact = self.weight[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[doc]))
        order = np.argsort(term, kind="stable")
        doc, impact = doc[order], impact[order]
        ends = np.searchsorted(term[order], np.arange(len(self.weight) + 1))
        total = np.zeros(len(ids), np.int64)
        for q, (terms, times) in enumerate(self.items):
            total[:] = 0
            for t, x in zip(terms, times, strict=True):
                lo, hi = ends[t], ends[t + 1]
                if lo < hi:
                    total[doc[lo:hi]] += x * impact[lo:hi]
            self.keep(q, total, ids, null)

    def keep(self, q: int, total: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        score, gone, doc = self.best[q]
        found = np.flatnonzero(total >= max(1, score[-1] if len(score) == self.k else 1))
        if len(found) > self.k:
            value = total[found]
            found = found[value >= np.partition(value, -self.k)[-self.k]]
        if len(found):
            score, gone, doc = np.concatenate([score, total[found]]), np.concatenate([gone, null[found]]), np.concatenate([doc, ids[found]])
            order = np.lexsort((doc, gone, -score))[: self.k]
            self.best[q] = score[order], gone[order], doc[order]

    def rows(self) -> pd.DataFrame:
        q = np.repeat(np.arange(len(self.best)), [len(b[0]) for b in self.best])
        score, gone, doc = (np.concatenate([b[i] for b in self.best] or [np.empty(0, np.int64)]) for i in range(3))
        return pd.DataFrame({"q": q, "doc_id": pd.array(np.where(gone == 1, 0, doc), "Int64"), "score": score}).assign(doc_id=lambda f: f["doc_id"].mask(gone == 1))


def search(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The k documents of highest score above 0 of each row of items: item_id, rank, doc_id, score."""
    spark = bounded(docs.sparkSession)
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.sha2(F.col(item_text), 256).alias("key"), F.col(item_text).alias("t")).where("t is not null")
    left = asked.groupBy("key").agg(F.first("t").cast("binary").alias("data")).mapInPandas(rows_of, "key string, terms array<binary>, times array<bigint>")
    left = materialise(left.where(F.size("terms") > 0))
    entries = left.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = math.ceil(entries / ENTRIES)
    out = spark.createDataFrame([], "key string, rank int, doc_id bigint, score bigint")
    for b in range(blocks):
        rows = left.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == b).collect()  # some ENTRIES entries
        out = out.unionAll(block_best(spark, docs, rows, k, id_col, text_col))
    return asked.join(out, "key").select("item_id", "rank", "doc_id", "score")


def block_best(spark: SparkSession, docs: DataFrame, rows: list, k: int, id_col: str, text_col: str) -> DataFrame:
    vocabulary: dict[bytes, int] = {}
    items = [(np.array([vocabulary.setdefault(bytes(t), len(vocabulary)) for t in r["terms"]]), np.array(r["times"], np.int64)) for r in rows]

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = vocabulary.keys()
        for f in frames:
            n, at, tf = [], [], []
            for data in f["data"]:
                size, found = counted(data)
                held = found.keys() & known
                n.append(size)
                at.append([vocabulary[t] for t in held])
                tf.append([found[t] for t in held])
            yield pd.DataFrame({"doc_id": f["doc_id"], "n": n, "at": listed(at), "tf": listed(tf)})

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("data")).where("data is not null")
    right = materialise(texts.mapInPandas(count, "doc_id bigint, n bigint, at array<int>, tf array<bigint>").where("n > 0"))
    size = right.agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
    weight = np.zeros(len(vocabulary), np.int64)
    for r in right.select(F.explode("at").alias("t")).groupBy("t").count().collect():  # the block's terms
        weight[r["t"]] = math.floor(1000 * math.log(float(2 * size["n"] + 2) / float(2 * r["count"] + 1)))

    def multiply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        product, held, postings = Product(items, weight, size["n"], size["l"] or 1, k), [], 0

        def add() -> None:
            ids = [r[0] for r in held]
            null = np.array([i is None for i in ids], np.int64)
            product.add(np.array([0 if i is None else i for i in ids], np.int64), null, np.array([r[1] for r in held], np.int64), [r[2] for r in held], [r[3] for r in held])

        for f in frames:
            ids = [None if pd.isna(i) else int(i) for i in f["doc_id"]]
            for r in zip(ids, f["n"], f["at"], f["tf"], strict=True):
                held.append(r)
                postings += len(r[2])
                if len(held) >= BLOCK or postings >= POSTINGS:
                    add()
                    held.clear()
                    postings = 0
        if held:
            add()
        yield product.rows()

    # as text: a column of longs with a null would come as doubles
    told = right.where(F.size("at") > 0).select(F.col("doc_id").cast("string").alias("doc_id"), "n", "at", "tf")
    best = told.mapInPandas(multiply, "q int, doc_id bigint, score bigint")
    order = (F.desc("score"), F.col("doc_id").asc_nulls_last())
    first = Window.partitionBy("q", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).orderBy(*order)
    some = best.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k).drop("r")
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("rank") <= k)
    names = spark.createDataFrame([(q, r["key"]) for q, r in enumerate(rows)], "q int, key string")
    return ranked.join(F.broadcast(names), "q").select("key", "rank", "doc_id", "score")  # a key per item of the block


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
