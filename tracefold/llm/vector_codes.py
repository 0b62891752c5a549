"""Vector code compression: product codes of integer vectors, searched behind segment-mean lower bounds.

Every component x becomes floor(256 * x); a vector is cut into ``PARTS`` equal parts, each with a codebook of at most ``ENTRIES``
entries, which start as the parts of the smallest ids and move to floored means in ``ROUNDS`` rounds.

Search. For blocks of b components with sums S and the residual r (what of the norm the block means leave),
``|x - c|^2 >= sum((Sx - Sc)^2) / b + (rx - rc)^2``. One block first, then halves, quarters, ...: what a level's bound puts beyond the best
exact distance so far is out. Sums and norms are exact integers; the one root and the one division are rounded downwards by a
margin, so no entry that could win or tie is lost. Survivors get exact integer distances; ties go to the lower entry.

Spark's part. Rows stay where they are read; a task returns sums and counts per (part, entry), which have a fixed size whatever the
input, and Spark adds them up. The errors of equal labels are summed before they meet the rows again.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do empty ones, those whose length is no
multiple of PARTS, and those of another length than the commonest of the rest (the shorter on ties). With fewer than ENTRIES rows a
codebook has as many entries as there are rows. Repeated ids are rows of their own, ordered by their integers; null ids come last. An
empty table gives an empty table. Columns named like an added one come out as ``in_<name>``. Components so large that squared
distances pass 63 bits (2^21 and more in 64 dimensions) are an error, since no long can hold the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, listed, materialise, set_aside, table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Rows whose bounds are computed at once.
CHUNK = 4096
#: Labels up to which their sums are broadcast (a few MB); beyond, they are joined on (label, salt).
FEW, SALTS = 100_000, 16


def integers(rows) -> np.ndarray:
    """(rows, PARTS, width) of floor(SCALE * x)."""
    x = np.floor(np.array(list(rows), np.float64) * SCALE)
    most, dim = float(np.abs(x).max(initial=0)), x.shape[1]
    if 4 * max(dim, (dim // PARTS) ** 2) * most * most >= 2.0**63:
        raise ValueError("components are too large for squared distances in 64 bits")
    return x.astype(np.int64).reshape(len(x), PARTS, dim // PARTS)


def block_sizes(width: int) -> list[int]:
    """Sizes of a part's blocks, coarse to fine; blocks of one component are the exact distance."""
    out = []
    while width > 1:
        out.append(width)
        if width % 2:
            break
        width //= 2
    return out


def summary(x: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Block sums, and the norm of what the block means leave."""
    sums = x.reshape(len(x), -1, b).sum(axis=2)
    rest = b * (x * x).sum(axis=1) - (sums * sums).sum(axis=1)
    return sums, np.sqrt(rest / b)


def lower(gap2: np.ndarray, b: int, r: np.ndarray, s: np.ndarray) -> np.ndarray:
    """The bound from the squared gaps of block sums and two residuals, rounded downwards."""
    side = np.maximum(np.abs(r - s) - (r + s) * 2.0**-50, 0)
    return (gap2 / b + side * side) * (1 - 2.0**-48)


def distance(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the entry nearest to each row of x; ties to the lower index."""
    rows, best = np.arange(len(x)), np.full(len(x), np.iinfo(np.int64).max)
    r, e = np.repeat(rows, len(entries)), np.tile(np.arange(len(entries)), len(x))
    for level, b in enumerate(block_sizes(x.shape[1])):
        xs, xr = summary(x, b)
        cs, cr = summary(entries, b)
        if level:
            bound = lower(((xs[r] - cs[e]) ** 2).sum(axis=1), b, xr[r], cr[e])
            starts = np.searchsorted(r, rows)
            low = np.repeat(np.minimum.reduceat(bound, starts), np.diff(np.append(starts, len(r))))
            at = np.flatnonzero(bound == low)
            first = at[np.unique(r[at], return_index=True)[1]]
        else:
            gap2 = sum((xs[:, None, k] - cs[None, :, k]) ** 2 for k in range(xs.shape[1]))
            bound = lower(gap2, b, xr[:, None], cr[None, :])
            first = rows * len(entries) + bound.argmin(axis=1)
            bound = bound.ravel()
        best = np.minimum(best, distance(x, entries[e[first]]))
        keep = bound <= best[r]
        r, e = r[keep], e[keep]
    exact = distance(x[r], entries[e])
    starts = np.searchsorted(r, rows)
    best = np.minimum.reduceat(exact, starts)
    at = np.flatnonzero(exact == best[r])
    return e[at[np.unique(r[at], return_index=True)[1]]], best


def assigned(z: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, PARTS) entry indexes, and each row's error."""
    code, error = np.zeros(z.shape[:2], np.int64), np.zeros(len(z), np.int64)
    for lo in range(0, len(z), CHUNK):
        for s in range(PARTS):
            code[lo : lo + CHUNK, s], d = nearest(z[lo : lo + CHUNK, s], books[s])
            error[lo : lo + CHUNK] += d
    return code, error


def kept(vectors: DataFrame, vector_col: str) -> DataFrame | None:
    """The rows that take part, with their vector as __v; None if there are none."""
    v = F.col(vector_col).cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.withColumn("__v", v).where(F.col("__v").isNotNull() & (F.size("__v") > 0) & (F.size("__v") % PARTS == 0) & F.forall("__v", finite))
    size = rows.groupBy(F.size("__v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return None if size is None else rows.where(F.size("__v") == size["n"])


def fit(rows: DataFrame, id_col: str) -> np.ndarray:
    """Codebooks (PARTS, entries, width) of the rows that kept() gives."""
    whole = F.transform("__v", lambda x: F.floor(x * SCALE))
    first = rows.select(F.col(id_col).alias("i"), "__v").orderBy(F.col("i").asc_nulls_last(), whole).limit(ENTRIES).collect()
    books = integers(r["__v"] for r in first).transpose(1, 0, 2).copy()
    width = books.shape[2]
    for _ in range(ROUNDS):

        def run(frames: Iterator[pd.DataFrame], books=books) -> Iterator[pd.DataFrame]:
            n, total = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
            for f in frames:
                if len(f):
                    z = integers(f["__v"])
                    code, _ = assigned(z, books)
                    for s in range(PARTS):
                        n[s] += np.bincount(code[:, s], minlength=n.shape[1])
                        np.add.at(total[s], code[:, s], z[:, s])
            s, e = np.nonzero(n)
            yield pd.DataFrame({"s": s, "e": e, "n": n[s, e], "v": listed(x.tolist() for x in total[s, e])})

        parts = rows.select("__v").mapInPandas(run, "s int, e int, n bigint, v array<bigint>")
        added = parts.groupBy("s", "e").agg(F.sum("n").alias("n"), *[F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(width)])
        books = books.copy()
        for r in added.collect():  # PARTS x ENTRIES rows at most
            books[r["s"], r["e"]] = [r[f"v{i}"] // r["n"] for i in range(width)]
    return books


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """rows with code (two hex digits a part) and error (squared distances to the entries, summed over the parts)."""

    def run(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for v in series:
            if not len(v):
                yield pd.DataFrame({"code": listed([]), "error": np.empty(0, np.int64)})
                continue
            code, error = assigned(integers(v), books)
            yield pd.DataFrame({"code": listed(bytes(x.tolist()).hex() for x in code), "error": error})

    told = F.pandas_udf(run, "code string, error bigint").asNondeterministic()
    wide = set_aside(rows.withColumn("__told", told(F.col("__v"))), "code", "error")
    return wide.withColumns({"code": F.col("__told.code"), "error": F.col("__told.error")}).drop("__told", "__v")


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_sums(rows: DataFrame, key: Column, value: Column, name: str) -> DataFrame:
    """rows with the sum of value over the rows of an equal key; nulls are equal. One key may hold any share of the rows."""
    rows = rows.withColumn("__k", key)
    sums = rows.groupBy("__k").agg(F.sum(value).alias(name)).withColumnRenamed("__k", "__of")
    match = F.col("__k").eqNullSafe(F.col("__of"))
    if sums.limit(FEW + 1).count() <= FEW:
        return rows.join(F.broadcast(sums), match).drop("__k", "__of")
    salted = rows.withColumn("__s", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)))
    sums = sums.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(sums, match & (F.col("__s") == F.col("__salt"))).drop("__k", "__of", "__s", "__salt")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kept(table(bounded(spark), sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding"), "embedding")
    if rows is None:
        return spark.createDataFrame([], "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string")
    books = fit(rows, "vec_id")
    coded = materialise(encode(rows.select("vec_id", "label", "__v"), books))
    out = with_sums(coded, F.col("label"), F.col("error"), "label_error")
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
