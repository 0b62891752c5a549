"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1 (seeded by its code point, so each executor makes the same one). A
trigram's vector binds its letters, each permuted by its place: ``roll(a, 2) * roll(b, 1) * c``. A text's vector bundles
(sums) those of its trigrams; runs of other characters count as one blank. A language's prototype bundles the unit
vectors of its training texts; the prediction is the prototype of the largest cosine.

Training sums are exact integers per (language, dimension), added up by Spark: the result does not depend on the order
or the number of tasks, and what reaches the driver is languages x dimensions.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is every text if there is nothing to learn
from; equal cosines go to the smaller language name; rows with a null language teach nothing; repeated rows count each; an
empty table gives an empty table; input columns named ``lang_pred`` or ``score`` come out as ``in_lang_pred`` and ``in_score``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, listed, set_aside, table

DIM = 1024
UNIT = 10_000
BLANK = 32
#: Trigram vectors that a worker keeps; it starts afresh beyond.
KEPT = 60_000


class Encoder:
    """Turns texts into bundled vectors; keeps the vectors of trigrams it has met."""

    def __init__(self, dim: int = DIM) -> None:
        self.dim = dim
        self.letter_class = np.full(0x110000, -1, np.int8)
        self.letters: dict[int, np.ndarray] = {}
        self.clear()

    def clear(self) -> None:
        self.row: dict[int, int] = {}
        self.known = np.zeros((1024, self.dim), np.int8)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            self.letters[code] = (np.random.Generator(np.random.Philox(key=code)).integers(0, 2, self.dim, dtype=np.int8) * 2 - 1).astype(np.int8)
        return self.letters[code]

    def trigrams(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct trigrams (three code points of 21 bits) and how often each occurs."""
        none = np.empty(0, np.int64), np.empty(0, np.int64)
        code = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
        if not len(code):
            return none
        kind = self.letter_class[code]
        if (kind < 0).any():
            for c in np.unique(code[kind < 0]):
                self.letter_class[c] = chr(c).isalpha()
            kind = self.letter_class[code]
        if not kind.any():
            return none
        code = np.where(kind == 1, code, BLANK)
        code = np.concatenate(([BLANK], code, [BLANK]))
        code = code[np.concatenate(([True], (code[1:] != BLANK) | (code[:-1] != BLANK)))]
        used, small = np.unique(code, return_inverse=True)
        k = len(used)
        key = (small[:-2] * k + small[1:-1]) * k + small[2:]
        if k**3 <= 1 << 18:
            count = np.bincount(key, minlength=1)
            key = np.flatnonzero(count)
            count = count[key]
        else:
            key, count = np.unique(key, return_counts=True)
        used = used.astype(np.int64)
        return used[key // (k * k)] << 42 | used[key // k % k] << 21 | used[key % k], count

    def rows(self, keys: np.ndarray) -> np.ndarray:
        if len(self.row) + len(keys) > KEPT:
            self.clear()
        out = np.empty(len(keys), np.int64)
        for i, key in enumerate(keys.tolist()):
            at = self.row.get(key)
            if at is None:
                at = self.row[key] = len(self.row)
                if at >= len(self.known):
                    self.known = np.concatenate((self.known, np.zeros_like(self.known)))
                a, b, c = key >> 42, key >> 21 & 0x1FFFFF, key & 0x1FFFFF
                self.known[at] = np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)
            out[i] = at
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Unit vectors of the texts, and which of them have a letter."""
        parts = [self.trigrams(t) for t in texts]
        sizes = np.array([len(k) for k, _ in parts], np.int64)
        out = np.zeros((len(texts), self.dim), np.float32)
        if sizes.sum():
            keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            doc = np.repeat(np.arange(len(texts)), sizes)
            count = np.concatenate([c for _, c in parts]).astype(np.float32)
            step = 8192
            for lo in range(0, len(keys), step):  # so many columns at a time
                here = (at >= lo) & (at < lo + step)
                dense = np.zeros((len(texts), min(step, len(keys) - lo)), np.float32)
                dense[doc[here], at[here] - lo] = count[here]
                rows = self.rows(keys[lo : lo + step])
                out += dense @ self.known[rows].astype(np.float32)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.maximum(norm, 1e-9), sizes > 0


def slices(frame: pd.DataFrame, n: int = 256) -> Iterator[pd.DataFrame]:
    for lo in range(0, len(frame), n):
        yield frame.iloc[lo : lo + n]


def fit(docs: DataFrame, text: Column, lang: Column, dim: int = DIM) -> dict[str, np.ndarray]:
    """Prototypes by language, from all rows of docs whose language is not null."""

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder, total = Encoder(dim), {}
        for frame in frames:
            for part in slices(frame):
                unit, has = coder.encode(part["t"].tolist())
                whole = np.rint(unit * UNIT).astype(np.int64)
                tongue = part["l"].to_numpy()
                for name in pd.unique(tongue[has]):
                    total[name] = total.get(name, 0) + whole[has & (tongue == name)].sum(axis=0)
        yield pd.DataFrame({"lang": listed(total), "v": listed(x.tolist() for x in total.values())})

    some = docs.select(text.alias("t"), lang.alias("l")).where(F.col("l").isNotNull() & F.col("t").isNotNull())
    added = some.mapInPandas(sums, "lang string, v array<bigint>").select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    out: dict[str, np.ndarray] = {}
    for r in added.collect():  # languages x dimensions
        out.setdefault(r["lang"], np.zeros(dim))[r["i"]] = r["x"]
    return {k: (v / max(np.linalg.norm(v), 1e-9)).astype(np.float32) for k, v in sorted(out.items())}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score."""
    names = list(prototypes)
    matrix = np.stack([prototypes[k] for k in names], axis=1) if names else None
    dim = len(matrix) if names else DIM

    def run(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coder = Encoder(dim)
        for texts in series:
            best, score = np.full(len(texts), "und", object), np.zeros(len(texts))
            for lo in range(0, len(texts) if names else 0, 256):
                unit, has = coder.encode(texts.iloc[lo : lo + 256].tolist())
                cosine = unit @ matrix
                top = cosine.argmax(axis=1)
                rows = np.flatnonzero(has)
                best[lo + rows] = [names[i] for i in top[rows]]
                score[lo + rows] = np.clip(cosine[rows, top[rows]], 0, 1)
            yield pd.DataFrame({"lang_pred": listed(best), "score": score})

    told = F.pandas_udf(run, "lang_pred string, score double").asNondeterministic()
    return set_aside(docs.withColumn("__told", told(F.col(text_col))), "lang_pred", "score").withColumns({"lang_pred": F.col("__told.lang_pred"), "score": F.col("__told.score")}).drop("__told")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = crc_mod(F.col("doc_id"), 4) == 2
    prototypes = fit(docs.where(~held), F.col("text"), F.col("lang"))
    return predict(docs.select("doc_id", held.alias("held_out"), "text"), prototypes).select("doc_id", "held_out", "lang_pred", "score")
