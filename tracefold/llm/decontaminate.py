"""Benchmark decontamination by latent semantic retrieval.

Documents are tiled into passages of ``WINDOW`` words, ``STRIDE`` apart, all of them; benchmark items are cut into parts of at most
``WINDOW`` words, by which they are searched, and of at most ``CHUNK`` words, which are checked.

1. Words become columns of a term table: each term of the benchmark its own, all others one of ``HASHED`` classes. Texts are read once
   and written as columns (two bytes a word). Document counts over all documents give the IDF.
2. Latent space. The singular vectors of TF-IDF rows, by a randomised range finder whose sums Spark adds up over tasks. The rows
   are all passages of all documents and the parts, ``WEIGHT`` times where there are up to ``EVEN`` passages and in proportion where there
   are more. Directions are divided by their singular values, so what all texts of a language share counts little.
3. Search. Every passage of every document is projected, and held against every part by cosine, in blocks; what reaches ``LATENT`` is a
   candidate. Nothing else makes one.
4. Checks of a candidate on its words and ``AROUND`` more on either side: ``share``, the chunk's longest common subsequence, and
   ``mass``, the IDF share of its terms that occur. It counts with a share of ``SAME``; or where share and mass together reach
   ``0.75 + 1.75 / sqrt(words of the chunk)`` (short chunks meet more by chance) and neither is below ``EITHER``. Both rules want ``ANSWER`` of
   the answer's words in order, the answer being what follows the item's last question mark, colon or full stop before its end,
   or else its last words.

Benchmarks are read in blocks of some ``PARTS`` parts, so what travels to the tasks (columns x ``RANK`` numbers) has a bound; the work grows
with documents times blocks.

Defined results: null or empty texts, and items without a word, match nothing; a document that repeats returns its matches once per
distinct id; rows with a null id match nothing; an empty table on either side gives an empty table; other columns play no part.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import listed, materialise, pieces, table

WORD = re.compile(r"\w+")
STRIDE, WINDOW, CHUNK, AROUND = 16, 32, 64, 64
HASHED, RANK, EXTRA, WEIGHT, EVEN = 8192, 112, 16, 5.0, 60_000
PARTS, TERMS, SUMMED = 512, 50_000, 2_000_000
LATENT = 0.4
SAME, EITHER, ANSWER = 0.8, 0.35, 0.4
SCALE = float(1 << 24)
BATCH, LONG = 500_000, 64


#: What is no part of a word in Latin-1 becomes a blank.
BLANKED = bytes(k if WORD.match(chr(k)) else 32 for k in range(256))
#: The same, and what is one in lower case.
FOLDED = BLANKED.translate(bytes(ord(chr(k).lower()) for k in range(256)))
BLANK = re.compile(rb" ")
#: What a byte changes in a CRC-32.
CRC = np.array([~zlib.crc32(bytes([k]), 0xFFFFFFFF) & 0xFFFFFFFF for k in range(256)], np.uint32)


def words_of(text: str | None) -> list[str]:
    """The matches of WORD in lower case; by bytes where one holds a character, which is faster."""
    low = (text or "").lower()
    try:
        return low.encode("latin-1").translate(BLANKED).decode("latin-1").split()
    except UnicodeEncodeError:
        return WORD.findall(low)


def answer_of(text: str) -> list[str]:
    """Words after the last mark before the end, else the last quarter."""
    parts = [words_of(x) for x in re.split(r"[?:.](?=\s)", text.strip())]
    parts = [p for p in parts if p]
    words = words_of(text)
    return parts[-1] if len(parts) > 1 and len(parts[-1]) >= 2 else words[-max(1, len(words) // 4) :]


def cut(words: list, most: int) -> list[list]:
    """words in equal pieces of at most `most`."""
    n = -(-len(words) // most)
    ends = [len(words) * i // n for i in range(n + 1)] if n else [0]
    return [words[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    mask: dict = {}
    for i, w in enumerate(a):
        mask[w] = mask.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        m = mask.get(w)
        if m is not None:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def folded(text: str) -> bytes:
    """The words of text in UTF-8, with blanks between them."""
    try:
        return text.encode("latin-1").translate(FOLDED).decode("latin-1").encode()
    except UnicodeEncodeError:
        return " ".join(words_of(text)).encode("utf-8", "surrogatepass")


def word_crcs(data: bytes, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 of each word: the k-th bytes of all at once, words of more than LONG bytes one by one."""
    order = np.argsort(np.maximum(LONG + 1 - sizes, 0).astype(np.uint8), kind="stable")  # long ones first
    at, sizes, chars, state = at[order], sizes[order], np.frombuffer(data, np.uint8), np.full(len(at), 0xFFFFFFFF, np.uint32)
    n_long = int(np.count_nonzero(sizes > LONG))
    for k, m in enumerate(np.searchsorted(-sizes[n_long:], -np.arange(LONG)).tolist()):  # words of more than k bytes
        if m == 0:
            break
        some = state[n_long : n_long + m]
        some[:] = CRC[(some ^ chars[at[n_long : n_long + m] + k]) & 0xFF] ^ (some >> 8)
    out = np.empty_like(state)
    out[order] = ~state
    out[order[:n_long]] = [zlib.crc32(data[a : a + n]) for a, n in zip(at[:n_long].tolist(), sizes[:n_long].tolist(), strict=True)]
    return out


def columns_of(texts: list[str], known: pa.Array) -> list[np.ndarray]:
    """Columns of the words of each text: the benchmark's own terms (known, in UTF-8), then the classes of all others."""
    each = [folded(t) + b" " for t in texts]
    cols, ends, lo = [], [], 0
    for piece in pieces(b"".join(each), BLANK):
        inside = np.concatenate(([False], np.frombuffer(piece, np.uint8) != 32, [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        sizes, data = edges[1::2] - edges[::2], piece.translate(None, b" ")
        at = np.append(0, np.cumsum(sizes))
        words = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(at), pa.py_buffer(data)])
        col = pc.index_in(words, value_set=known).fill_null(-1).to_numpy()
        other = np.flatnonzero(col < 0)
        col = col.astype(np.uint16)
        col[other] = len(known) + word_crcs(data, at[other], sizes[other]) % HASHED
        cols.append(col)
        ends.append(edges[1::2] + lo)
        lo += len(piece)
    if not cols:
        return []
    return np.split(np.concatenate(cols), np.searchsorted(np.concatenate(ends), np.cumsum([len(x) for x in each]))[:-1])


class Chunk:
    """A checked piece of an item, in columns."""

    def __init__(self, item: int, terms: list[int], answer: list[int], idf: np.ndarray) -> None:
        self.item, self.terms, self.answer, self.set = item, terms, answer, frozenset(terms)
        self.weight = {t: float(idf[t]) for t in self.set}
        self.total = sum(self.weight.values())
        self.need = 0.75 + 1.75 / math.sqrt(len(terms))

    def check(self, around: list[int]) -> tuple[float, float] | None:
        """(share, mass) if the words around a passage count as this chunk."""
        mass = sum(map(self.weight.__getitem__, self.set.intersection(around))) / self.total
        if mass < EITHER:
            return None
        share = subsequence(self.terms, around) / len(self.terms)
        if share < SAME and (share < EITHER or share + mass < self.need):
            return None
        if self.answer and subsequence(self.answer, around) < ANSWER * len(self.answer):
            return None
        return share, mass


def column_table(docs: DataFrame, known: dict[str, int]) -> DataFrame:
    """(i, cols): every text as two bytes a word. docs: i, t."""
    terms = [w.encode("utf-8", "surrogatepass") for w in sorted(known, key=known.__getitem__)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = pa.array(terms, pa.large_binary())
        for frame in frames:
            for lo in range(0, len(frame), 500):
                part = frame.iloc[lo : lo + 500]
                cols = [x.tobytes() for x in columns_of(part["t"].tolist(), own)]
                yield pd.DataFrame({"i": part["i"].to_numpy(), "cols": listed(cols)})

    return materialise(docs.where("i is not null and t is not null").mapInPandas(run, "i bigint, cols binary"))


def document_counts(cols: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """The number of documents that hold each column, and the number of all passages."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, tiles, place = np.zeros(n, np.int64), 0, np.zeros(n, np.int64)
        for frame in frames:
            for b in frame["cols"]:
                x = np.frombuffer(b, np.uint16)
                at = np.arange(len(x))
                place[x] = at
                count[x[place[x] == at]] += 1  # one place of each column
                tiles += len(x) // STRIDE + 1
        used = np.flatnonzero(count)
        yield pd.DataFrame({"at": np.append(used, n), "c": np.append(count[used], tiles)})

    got = cols.select("cols").mapInPandas(run, "at bigint, c bigint").groupBy("at").agg(F.sum("c").alias("c")).toPandas()  # columns at most
    out = np.zeros(n + 1, np.int64)
    out[got["at"].to_numpy(np.int64)] = got["c"].to_numpy(np.int64)
    return out[:n], int(out[n])


def batches(frames: Iterator[pd.DataFrame], most: int) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Ids and columns of texts that hold a word, some `most` words at once, never across frames."""
    for frame in frames:
        ids, texts, size = [], [], 0
        for i, b in zip(frame["i"].tolist(), frame["cols"], strict=True):
            if len(b):
                ids.append(i)
                texts.append(np.frombuffer(b, np.uint16))
                size += len(b) // 2
            if size > most:
                yield ids, texts
                ids, texts, size = [], [], 0
        if texts:
            yield ids, texts


def tiled(texts: list[np.ndarray], pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The tiles of texts (tiles x STRIDE columns, the last of a text filled up with pad), which text each is of, its place there, and whether one follows.

    A tile and the one that follows are a passage; the last of a text is one by itself only where it is the first.
    """
    sizes = np.array([len(x) for x in texts])
    count = -(-sizes // STRIDE)
    first = np.cumsum(count) - count
    out = np.full(int(count.sum()) * STRIDE, pad, np.uint16)
    out[np.arange(int(sizes.sum())) + np.repeat(first * STRIDE - (np.cumsum(sizes) - sizes), sizes)] = np.concatenate(texts)
    of = np.repeat(np.arange(len(texts)), count)
    return out.reshape(-1, STRIDE), of, np.arange(len(of)) - first[of], np.append(of[1:] == of[:-1], False)


def tile_sums(tiles: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of rows (a zero one for the pad) over the columns of each tile."""
    out = np.empty((len(tiles), rows.shape[1]), np.float32)
    for lo in range(0, len(tiles), 256):
        np.take(rows, tiles[lo : lo + 256], axis=0, mode="clip").sum(axis=1, out=out[lo : lo + 256])
    return out


def padded(rows: np.ndarray) -> np.ndarray:
    """rows and a zero one, each in one stretch of memory: np.take copies the whole table first where they aren't (those of an SVD aren't)."""
    return np.concatenate((rows, np.zeros((1, *rows.shape[1:])))).astype(np.float32, order="C")


def range_sums(texts: list[np.ndarray], idf: np.ndarray, start: np.ndarray, total: np.ndarray) -> None:
    """Adds A'(A start), but for the IDF of A', to total (width x columns): A has a unit TF-IDF row for each passage of texts. idf, start: padded."""
    tiles, _, place, more = tiled(texts, len(idf) - 1)
    y = tile_sums(tiles, start * idf[:, None])
    y[:-1][more[:-1]] += y[1:][more[:-1]]
    both = np.full((len(tiles), 2 * STRIDE), len(idf) - 1, np.int32)  # numpy sorts these faster than shorter ones
    both[:, :STRIDE] = tiles
    both[:-1, STRIDE:][more[:-1]] = tiles[1:][more[:-1]]
    both = np.sort(both, axis=1).T
    nth, square = np.ones(len(tiles), np.float32), idf[both[0]] ** 2
    for before, now in zip(both, both[1:], strict=False):  # a word that occurs n times adds n * n in all: 1 + 3 + 5 ...
        nth = np.where(now == before, nth + 1, np.float32(1))
        square += (2 * nth - 1) * idf[now] ** 2
    y *= (np.where(more | (place == 0), 1, 0) / np.maximum(square, 1e-24)).astype(np.float32)[:, None]
    y[1:][more[:-1]] += y[:-1][more[:-1]].copy()
    order = np.argsort(tiles.ravel(), kind="stable")
    column = tiles.ravel()[order]
    words = int(np.searchsorted(column, len(idf) - 1))
    at, tile = np.flatnonzero(np.concatenate(([True], column[1:words] != column[: words - 1]))), order[:words] // STRIDE
    some, distinct = np.empty(words, np.float32), column[at]
    for j, of_tile in enumerate(np.ascontiguousarray(y.T)):
        np.take(of_tile, tile, mode="clip", out=some)
        total[j, distinct] += np.add.reduceat(some, at)


def latent_space(cols: DataFrame, passages: int, parts: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    """Columns x RANK: IDF times the right singular vectors over their singular values, by a randomised range finder (Nystroem form, one pass)."""
    n = len(idf)
    rng = np.random.Generator(np.random.Philox(key=23))
    start = rng.normal(size=(n, min(n, RANK + EXTRA))).astype(np.float32)
    width, weights, starts = start.shape[1], padded(idf), padded(start)

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, n))
        for _, texts in batches(frames, BATCH):
            range_sums(texts, weights, starts, total)
        whole = np.rint(total.T * idf[:, None] * SCALE).astype(np.int64)  # exact sums: the order of tasks changes nothing
        used = np.flatnonzero(whole.any(axis=1))
        for lo in range(0, len(used), 1024):
            some = used[lo : lo + 1024]
            yield pd.DataFrame({"r": some, "v": listed(whole[some])})

    tasks = max(cols.sparkSession.sparkContext.defaultParallelism, -(-passages // SUMMED))  # each returns columns x width numbers
    added = cols.coalesce(tasks).mapInPandas(sums, "r bigint, v array<bigint>").groupBy("r").agg(F.array(*[F.sum(F.col("v")[j]) for j in range(width)]).alias("v"))
    spanned = np.zeros(start.shape)
    for r in added.toLocalIterator():  # n rows at most
        spanned[r["r"]] = np.asarray(r["v"], np.float64) / SCALE
    of_parts = np.zeros((width, n))
    range_sums(parts, weights, starts, of_parts)
    spanned += WEIGHT**2 * max(1.0, passages / EVEN) * of_parts.T * idf[:, None]
    core = start.T.astype(np.float64) @ spanned
    values, turn = np.linalg.eigh((core + core.T) / 2)
    keep = values > max(values.max(), 1e-12) * 1e-7
    if not keep.any():
        return np.zeros((n, 1), np.float32)
    vectors, singular, _ = np.linalg.svd(spanned @ (turn[:, keep] / np.sqrt(values[keep])), full_matrices=False)
    live = singular[:RANK] > singular[0] * 1e-3
    return (idf[:, None] * (vectors[:, :RANK][:, live] / singular[:RANK][live])).astype(np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def passage_vectors(texts: list[np.ndarray], space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors of the passages of texts, which text each is of, and at which tile it begins. space: padded."""
    tiles, of, place, more = tiled(texts, len(space) - 1)
    sums = tile_sums(tiles, space)
    sums[:-1][more[:-1]] += sums[1:][more[:-1]]
    keep = more | (place == 0)  # the last tile of a text is in the passage before
    return unit(sums[keep]), of[keep], place[keep]


def blocks_of(items: list[tuple[int, str]]) -> Iterator[list[tuple[int, list[str], list[str]]]]:
    """Chunks (item, words, the answer's words where it ends the item) in blocks of at most TERMS different words."""
    block, terms = [], set()
    for item, text in items:
        pieces = cut(words_of(text), CHUNK)
        for k, words in enumerate(pieces):
            if len(terms.union(words)) > TERMS:
                yield block
                block, terms = [], set()
            block.append((item, words, answer_of(text)[-len(words) :] if k == len(pieces) - 1 else []))
            terms.update(words)
    if block:
        yield block


def matches(docs: DataFrame, cuts: list[tuple[int, list[str], list[str]]]) -> DataFrame:
    """(doc_id, item_id, lcs, mass) of a block of chunks. docs: i, t."""
    known = {w: k for k, w in enumerate(sorted({w for _, words, _ in cuts for w in words}))}
    n = len(known) + HASHED
    cols = column_table(docs, known)
    counts, passages = document_counts(cols, n)
    idf = np.log((docs.count() + 1) / (counts + 1.0)) + 0.05
    chunks = [Chunk(i, [known[w] for w in words], [known[w] for w in answer], idf) for i, words, answer in cuts]
    parts = [(c, np.array(piece)) for c, chunk in enumerate(chunks) for piece in cut(chunk.terms, WINDOW)]
    space = padded(latent_space(cols, passages, [p for _, p in parts], idf))
    asked, of_part = unit(np.array([space[p].sum(axis=0) for _, p in parts])).T, np.array([c for c, _ in parts])

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, batch in batches(frames, BATCH):
            best: dict[tuple[int, int], tuple[float, float]] = {}
            vectors, of, tile = passage_vectors(batch, space)
            for lo in range(0, len(vectors), 4096):
                row, part = np.divmod(np.flatnonzero(vectors[lo : lo + 4096] @ asked >= LATENT), len(of_part))
                for r, c in np.unique(np.stack((row + lo, of_part[part]), axis=1), axis=0).tolist():
                    at = int(tile[r]) * STRIDE
                    got = chunks[c].check(batch[of[r]][max(0, at - AROUND) : at + WINDOW + AROUND].tolist())
                    if got:
                        key = ids[of[r]], chunks[c].item
                        best[key] = max(best.get(key, (0.0, 0.0)), got)
            yield pd.DataFrame([(*k, *v) for k, v in best.items()], columns=["doc_id", "item_id", "lcs", "mass"])

    return cols.mapInPandas(search, "doc_id bigint, item_id bigint, lcs double, mass double")


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, lcs, mass): which documents hold, or closely paraphrase, which benchmark items."""
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    asked = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    words = F.size(F.split(F.coalesce("text", F.lit("")), r"(?U)\W+"))
    total = asked.agg(F.sum(F.ceil(words / WINDOW))).first()[0] or 0
    blocks = max(1, -(-int(total) // PARTS))
    found = [docs.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, lcs double, mass double")]
    for b in range(blocks):
        items = sorted((r["item_id"], r["text"] or "") for r in asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect())
        for cuts in blocks_of(items):
            found.append(matches(rows, cuts))
    return functools.reduce(DataFrame.unionByName, found).groupBy("doc_id", "item_id").agg(F.max("lcs").alias("lcs"), F.max("mass").alias("mass"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents that leaks() names; rows with a null id stay."""
    bad = materialise(leaks(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias("__leak")).distinct())
    small = bad.limit(BROADCAST_DOCS + 1).count() <= BROADCAST_DOCS
    return docs.join(F.broadcast(bad) if small else bad, docs[id_col] == bad["__leak"], "left_anti")


#: Ids that may be sent to every executor; more are joined by shuffle.
BROADCAST_DOCS = 500_000


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
