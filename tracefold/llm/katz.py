"""Language-model scores by a Katz back-off model.

Tokens are the words between ASCII white space, A-Z lower-cased, then one end. Every training word is in the model. The ``WORDS``
most frequent ones (whole classes of counts) have short ids, and their counts and weights travel to every task, which bounds what
travels; all others, the wide ones, are 63-bit hashes, and their counts, pairs and weights stay in tables partitioned by hash.
Where the line runs changes no score. A word that training does not have gets all that the unigrams leave.

Fit. Counts of words and of word pairs over all training texts. Good-Turing discounts for counts up to 5, from the counts of counts
of all types. Half a count is set aside for unseen followers in each context, and the back-off weight of a context is what its
discounted followers leave, divided by what the unigrams leave of the same followers: probabilities after each context add up
to one. Pair counts are stored in tables partitioned by context. The pairs that a wide word ends go to its partition too: they give
its count there, and their contexts get the sums of unigrams that weights need sent back.

Score. Recursively per token: the discounted pair if training has it, else the context's weight times the unigram. Texts are
read in blocks; a block sends its distinct pairs (with the documents that hold them) to the partitions of the table and gets a sum
per document back. The unigram of a wide word comes from the word's partition, whether its pair needs it from the context's; the two
meet where a block's sums are added. Neither the tables nor the texts of a group ever meet in one task whole.

Integer arrays travel packed: differences of sorted keys, byte planes, zstandard.

Defined results: a null text is an empty one, whose only token is the end; without training texts every word has count 0, and the
probability is halved between the end and the class; rows repeat as they are; a null id is kept; an empty table gives an empty table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, listed, materialise, table

WORDS = 1 << 18
DISCOUNTED = 5
BLOCK_TOKENS, BLOCK_DOCS = 2_000_000, 60_000
PAIRS, RARE, META, WIDE, BACK, SUMS, WEIGHT = range(7)
HASHED = 1 << 63  # set in the key of a word without a short id


def packed(*arrays: np.ndarray) -> bytes:
    """Integer or float arrays as bytes: per array its type, length and compressed byte planes."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        body = zstandard.compress(a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes(), 1)
        out.append(a.dtype.str.encode().ljust(4) + len(a).to_bytes(8, "little") + len(body).to_bytes(8, "little") + body)
    return b"".join(out)


def unpacked(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        kind = np.dtype(data[at : at + 4].decode().strip())
        n, size = (int.from_bytes(data[at + 4 + 8 * i : at + 12 + 8 * i], "little") for i in (0, 1))
        body = zstandard.decompress(data[at + 20 : at + 20 + size]) if size else b""
        out.append(np.ascontiguousarray(np.frombuffer(body, np.uint8).reshape(kind.itemsize, n).T).view(kind).reshape(n))
        at += 20 + size
    return out


def steps(sorted_keys: np.ndarray) -> np.ndarray:
    return np.diff(sorted_keys, prepend=sorted_keys.dtype.type(0))


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def part_of(key: np.ndarray, parts: int) -> np.ndarray:
    return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % parts


def runs(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination of keys begins; keys are sorted together."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.flatnonzero(new)


def summed(major: np.ndarray, minor: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs, sorted, with the sums of their counts."""
    order = np.lexsort((minor, major))
    major, minor, c = major[order], minor[order], c[order]
    at = runs(major, minor)
    return major[at], minor[at], np.add.reduceat(c, at) if len(at) else c


def discounts(n: list[int]) -> np.ndarray:
    """Good-Turing discount ratios for counts 0 to DISCOUNTED; n: the number of types with count 0, 1, ... DISCOUNTED + 1."""
    d = np.ones(DISCOUNTED + 1)
    for r in range(1, DISCOUNTED + 1):
        d[r] = (r - 0.5) / r
        if n[1] and n[r]:
            a = (DISCOUNTED + 1) * n[DISCOUNTED + 1] / n[1]
            if a < 1:
                x = ((r + 1) * n[r + 1] / (n[r] * r) - a) / (1 - a)
                if 0 < x < 1:
                    d[r] = x
    return d


class Model:
    """What travels to the tasks: words with short ids, their counts, unigrams and back-off weights, discounts; its size is bounded by WORDS."""

    def __init__(self, words: list[bytes], counts: np.ndarray, n_docs: int, rare_tokens: int, rare_types: int, by_count: list[int], least: int) -> None:
        k = len(words)
        self.words, self.k = words, k
        self.end, self.unk, self.start = k, k + 1, k + 2
        self.total = int(counts.sum()) + rare_tokens + n_docs
        self.types = k + rare_types + (n_docs > 0)
        self.count = np.concatenate((counts, [n_docs, 0])).astype(np.int64)
        self.first = d = discounts(by_count)
        mass = self.of_count(self.count)
        left = 1 - mass.sum() - (rare_tokens - sum(r * by_count[r] * (1 - d[r]) for r in range(1, min(least, DISCOUNTED + 1)))) / (self.total + 1)
        if n_docs:
            mass[self.unk] += left
        else:
            mass[[self.end, self.unk]] += left / 2
        self.unigram = mass
        self.context = np.concatenate((self.count, [n_docs])).astype(np.float64)  # how often each is followed
        self.context[self.end] = 0
        self.weight = np.ones(k + 3)
        self.discount = np.ones(DISCOUNTED + 1)

    def of_count(self, c: np.ndarray) -> np.ndarray:
        """Unigrams of words with these counts."""
        return less(c, self.first) / (self.total + 1)

    def ids(self, words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
        return np.fromiter((known[w] if w in known else xxhash.xxh3_64_intdigest(w) | HASHED for w in words), np.uint64, len(words))

    def line(self, words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
        return np.concatenate((np.array([self.start], np.uint64), self.ids(words, known), np.array([self.end], np.uint64)))


def less(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Discounted counts."""
    return c * np.where(c <= DISCOUNTED, d[np.minimum(c, DISCOUNTED)], 1.0)


def short_pairs(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return v.astype(np.int64) << 21 | w.astype(np.int64)


def word_counts(train: DataFrame) -> DataFrame:
    """(w, c) for every training word."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[bytes] = Counter()
        for frame in frames:
            for text in frame["t"]:
                seen.update(split_words(text))
                if len(seen) > 500_000:
                    yield pd.DataFrame({"w": listed(seen.keys()), "c": list(seen.values())})
                    seen = Counter()
        if seen:
            yield pd.DataFrame({"w": listed(seen.keys()), "c": list(seen.values())})

    return materialise(train.where(F.col("t").isNotNull()).mapInPandas(run, "w binary, c bigint").groupBy("w").agg(F.sum("c").alias("c")))


def pair_blocks(model: Model, parts: int):
    """A function for mapInPandas over texts: rows (part, kind, data) with a block's distinct pairs and their counts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = {w: i for i, w in enumerate(model.words)}
        lines: list[np.ndarray] = []
        size = 0

        def rows() -> pd.DataFrame:
            line = np.concatenate(lines)
            ok = line[:-1] != model.end
            v, w = line[:-1][ok], line[1:][ok]
            wide = (v | w) >= HASHED
            key, c = np.unique(short_pairs(v[~wide], w[~wide]), return_counts=True)
            out = by_part(PAIRS, part_of(key >> 21, parts), key, c)
            v, w, c = summed(v[wide], w[wide], np.ones(int(wide.sum()), np.int64))
            out += by_part(WIDE, part_of(v, parts), v, w, c)
            w, v, c = summed(*(x[w >= HASHED] for x in (w, v, c)))
            return pd.DataFrame(out + by_part(BACK, part_of(w, parts), w, v, c), columns=["part", "kind", "data"])

        for frame in frames:
            for text in frame["t"]:
                lines.append(model.line(split_words(text), known))
                size += len(lines[-1])
                if size > BLOCK_TOKENS:
                    yield rows()
                    lines, size = [], 0
        if lines:
            yield rows()

    return run


def by_part(kind: int, part: np.ndarray, key: np.ndarray, *more: np.ndarray) -> list[tuple]:
    """Rows (part, kind, data): sorted keys and their columns, packed per part."""
    order = np.argsort(part, kind="stable")
    part, key, more = part[order], key[order], [x[order] for x in more]
    ends = np.append(runs(part), len(part))
    return [(int(part[a]), kind, packed(steps(key[a:b]), *(x[a:b] for x in more))) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def joined(rows: pd.DataFrame, kind: int) -> list[np.ndarray]:
    """The columns of all rows of a kind, one below the other; none if there are no rows."""
    got = [(np.cumsum(x[0], dtype=x[0].dtype), *x[1:]) for x in map(unpacked, sorted(rows.loc[rows["kind"] == kind, "data"]))]
    return [np.concatenate(x) for x in zip(*got, strict=True)]


def merge(model: Model, parts: int):
    """A function for applyInPandas: one sorted table of each kind for a part, with the counts of counts; sums for the contexts of its wide words."""

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        part, out = int(rows["part"].iloc[0]), []
        often = lambda c: np.bincount(np.minimum(c, DISCOUNTED + 2), minlength=DISCOUNTED + 3)[: DISCOUNTED + 2].tolist()
        if got := joined(rows, PAIRS):
            key, at = np.unique(got[0], return_inverse=True)
            c = np.bincount(at, weights=got[1]).astype(np.int64)
            out.append((part, PAIRS, packed(steps(key), c), often(c)))
        if got := joined(rows, WIDE):
            v, w, c = summed(*got)
            out.append((part, WIDE, packed(steps(v), w, c), often(c)))
        if got := joined(rows, BACK):
            w, v, c = summed(*got)
            at = runs(w)
            count = np.add.reduceat(c, at)
            out.append((part, RARE, packed(steps(w[at]), count), []))
            ctx, to = np.unique(v, return_inverse=True)
            below = np.bincount(to, weights=np.repeat(model.of_count(count), np.diff(np.append(at, len(w)))))
            none = np.zeros(len(ctx))
            out += [(*x, []) for x in by_part(SUMS, part_of(ctx, parts), ctx, none, below, none)]
        return pd.DataFrame(out, columns=["part", "kind", "data", "often"])

    return merged


def fit(train: DataFrame, words: int = WORDS) -> tuple[Model, DataFrame]:
    """The model and its table (part, kind, data). train: t."""
    spark = train.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = word_counts(train)
    n_docs = train.count()
    often = {r["c"]: r["n"] for r in counts.where(F.col("c") <= DISCOUNTED + 1).groupBy("c").agg(F.count("*").alias("n")).collect()}
    classes = counts.groupBy(F.floor(F.log2(F.col("c").cast("double")) * 4).alias("b")).agg(F.count("*").alias("n"), F.sum("c").alias("s"), F.min("c").alias("c")).orderBy(F.desc("b")).collect()  # some 200 rows at most
    least, held, used = 1 << 62, 0, 0
    for r in classes:
        if held + r["n"] > words:
            break
        held, used, least = held + r["n"], used + 1, r["c"]
    rest = classes[used:]
    top = counts.where(F.col("c") >= least).toPandas()  # at most `words` rows
    pairs = sorted(zip((-top["c"]).tolist(), map(bytes, top["w"]), strict=True))
    model = Model([w for _, w in pairs], -np.array([c for c, _ in pairs], np.int64), n_docs, sum(r["s"] for r in rest), sum(r["n"] for r in rest), [0, *(often.get(r, 0) for r in range(1, DISCOUNTED + 2))], least if rest else 0)
    del top, pairs
    sent = train.mapInPandas(pair_blocks(model, parts), "part bigint, kind int, data binary")
    stored = materialise(sent.groupBy("part").applyInPandas(merge(model, parts), "part bigint, kind int, data binary, often array<bigint>"))
    all_counts = stored.where(F.col("kind").isin(PAIRS, WIDE)).agg(*[F.sum(F.col("often")[i]).alias(f"n{i}") for i in range(DISCOUNTED + 2)]).first()
    model.discount = discounts([0, *(all_counts[f"n{i}"] or 0 for i in range(1, DISCOUNTED + 2))])
    weighed = materialise(weights(model, stored))
    for r in weighed.where(F.col("kind") == PAIRS).select("data").toLocalIterator():  # a number per word with a short id
        ctx, w = unpacked(r["data"])
        model.weight[np.cumsum(ctx).astype(np.int64)] = w
    return model, stored.where(F.col("kind") != SUMS).select("part", "kind", "data").unionAll(weighed.where(F.col("kind") == WEIGHT))


def weights(model: Model, stored: DataFrame) -> DataFrame:
    """Back-off weights (part, kind, data): kind PAIRS holds contexts with short ids, WEIGHT hashed ones with how often they are followed."""

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for part, kind, data in zip(frame["part"], frame["kind"], frame["data"], strict=True):
                if kind == SUMS:
                    out.append((part, kind, data))
                    continue
                key, *more = unpacked(data)
                key = np.cumsum(key, dtype=key.dtype)
                v, w, c = (key, *more) if kind == WIDE else ((key >> 21).astype(np.uint64), (key & (1 << 21) - 1).astype(np.uint64), *more)
                ctx, at = np.unique(v, return_inverse=True)
                short = w < HASHED  # the others' unigrams come from their own partitions
                below = np.bincount(at[short], weights=model.unigram[w[short].astype(np.int64)], minlength=len(ctx))
                out.append((part, SUMS, packed(steps(ctx), np.bincount(at, weights=less(c, model.discount)), below, np.bincount(at, weights=c))))
            yield pd.DataFrame(out, columns=["part", "kind", "data"])

    def weigh(rows: pd.DataFrame) -> pd.DataFrame:
        v, *more = joined(rows, SUMS)
        ctx, at = np.unique(v, return_inverse=True)
        taken, below, times = (np.bincount(at, weights=x) for x in more)
        weight = np.maximum(1 - taken / (times + 0.5), 0) / np.maximum(1 - below, 1e-12)
        short, part = ctx < HASHED, int(rows["part"].iloc[0])
        out = [(part, PAIRS, packed(steps(ctx[short]), weight[short])), (part, WEIGHT, packed(steps(ctx[~short]), weight[~short], times[~short]))]
        return pd.DataFrame(out, columns=["part", "kind", "data"])

    shape = "part bigint, kind int, data binary"
    return stored.where(F.col("kind") != RARE).select("part", "kind", "data").mapInPandas(sums, shape).groupBy("part").applyInPandas(weigh, shape)


def doc_blocks(model: Model, parts: int):
    """A function for mapInPandas over texts: per block and part its pairs with postings, its wide words, and the block's own rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = {w: i for i, w in enumerate(model.words)}
        log_base = np.log10((model.count + 1) / (model.total + model.types + 1))
        log_base[model.unk] = -np.log10(model.total + model.types + 1)  # of a wide word, until its count is known
        base = TaskContext.get().partitionId() << 24
        serial = 0
        kept: list[str] = []
        lines: list[np.ndarray] = []
        size = 0

        def postings(kind: int, part: np.ndarray, doc: np.ndarray, *keys: np.ndarray) -> tuple[list[tuple], list[np.ndarray]]:
            """Rows by part, and the same in one: distinct keys ordered by part, how many documents hold each, these and their counts."""
            order = np.lexsort((doc, *keys[::-1], part))
            part, doc, keys = part[order], doc[order], [k[order] for k in keys]
            at = runs(*keys, doc)
            times = np.diff(np.append(at, len(doc))).astype(np.int32)
            part, doc, keys = part[at], doc[at].astype(np.uint16), [k[at] for k in keys]
            first = runs(*keys)
            held = np.diff(np.append(first, len(doc))).astype(np.int32)
            of, keys = part[first], [k[first] for k in keys]
            out = []
            for p in np.unique(of):
                a, b = of == p, part == p
                out.append((int(p), base + serial, kind, packed(steps(keys[0][a]), *(k[a] for k in keys[1:]), held[a], doc[b], times[b])))
            return out, [*keys, held, doc, times]

        def rows() -> pd.DataFrame:
            line, doc = np.concatenate(lines), np.repeat(np.arange(len(lines)), [len(x) for x in lines])
            ok = line[:-1] != model.end
            v, w, at = line[:-1][ok], line[1:][ok], doc[:-1][ok]
            wide, hashed = (v | w) >= HASHED, line >= HASHED
            short = short_pairs(v[~wide], w[~wide])
            out, _ = postings(PAIRS, part_of(short >> 21, parts), at[~wide], short)
            of_word, (word, *_) = postings(RARE, part_of(line[hashed], parts), doc[hashed], line[hashed])
            of_pair, (_, w, held, of_doc, times) = postings(WIDE, part_of(v[wide], parts), at[wide], v[wide], w[wide])
            out += of_word + of_pair
            asks = w >= HASHED  # pairs whose unigram, if they need one, is the answer to a word: which of the words, in the order of parts
            by_key = np.argsort(word)
            which = by_key[np.searchsorted(word[by_key], w[asks])].astype(np.int32)
            asked = np.repeat(asks, held)
            line = np.where(hashed, np.uint64(model.unk), line).astype(np.int64)
            token = line != model.start
            n = np.bincount(doc[token], minlength=len(lines))
            sure = np.bincount(doc[token & (line != model.unk)], minlength=len(lines)) - (model.count[model.end] == 0)
            score = np.bincount(doc[token], weights=log_base[line[token]], minlength=len(lines))
            out.append(((base + serial) % parts, base + serial, META, packed(n, sure, score, which, held[asks], of_doc[asked], times[asked])))
            return pd.DataFrame(out, columns=["part", "block", "kind", "data"]).assign(rows=listed([[]] * (len(out) - 1) + [kept]))

        for frame in frames:
            for lo in range(0, len(frame), 1000):
                some = frame.iloc[lo : lo + 1000]
                kept += some["row"].tolist()
                for text in some["t"]:
                    lines.append(model.line(split_words(text), known))
                    size += len(lines[-1])
                if size > BLOCK_TOKENS or len(lines) > BLOCK_DOCS:
                    yield rows()
                    serial, kept, lines, size = serial + 1, [], [], 0
        if lines:
            yield rows()

    return run


def score(docs: DataFrame, model: Model, stored: DataFrame, keep: list[str]) -> DataFrame:
    """The columns keep of docs with n_tokens, n_known, train_tokens, base_score, score. docs: keep and t."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shape = docs.select(*keep).schema

    def place(have: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where sorted keys are in a sorted table, and whether; place 0 where not."""
        at = np.searchsorted(have, key)
        there = at < len(have)
        there[there] = have[at[there]] == key[there]
        return np.where(there, at, 0), there

    def meet(tables: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        none, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        table_of = {kind: joined(tables, kind) for kind in (PAIRS, RARE, WIDE, WEIGHT)}
        pair, n_pair = table_of[PAIRS] or (none.astype(np.int64), counts)
        rare, n_rare = table_of[RARE] or (none, counts)
        v_of, w_of, n_wide = table_of[WIDE] or (none, none, counts)
        hashed, weight, times_of = table_of[WEIGHT] or (none, np.empty(0), np.empty(0))
        contexts, followers = np.unique(v_of), np.unique(w_of)
        wide = np.searchsorted(contexts, v_of) * len(followers) + np.searchsorted(followers, w_of)
        take = lambda column, at, there, other: np.where(there, np.append(column, other)[np.where(there, at, len(column))], other)
        out = []
        for row in asked.sort_values(["block", "kind"]).to_dict("records"):
            if row["kind"] == META:
                out.append({"block": row["block"], "part": -1, "kind": META, "data": row["data"], "rows": row["rows"]})
                continue
            key, *more, held_by, doc, times = unpacked(row["data"])
            key = np.cumsum(key, dtype=key.dtype)
            size = int(doc.max()) + 1
            sums = lambda value: np.bincount(doc, weights=np.repeat(value, held_by) * times, minlength=size)  # noqa: B023, E731
            if row["kind"] == RARE:
                n = take(n_rare, *place(rare, key), 0)
                answer = [sums(np.log10(n + 1.0)), sums(n > 0).astype(np.int64), n]
            elif row["kind"] == PAIRS:
                n = take(n_pair, *place(pair, key), 0)
                v, w = key >> 21, key & (1 << 21) - 1
                answer = [sums(np.log10(np.where(n > 0, less(n, model.discount) / (model.context[v] + 0.5), model.weight[v] * model.unigram[w])))]
            else:
                v, w = key, more[0]
                (i, has_v), (j, has_w) = place(contexts, v), place(followers, w)
                at, there = place(wide, i * len(followers) + j)
                n = take(n_wide, at, there & has_v & has_w, 0)
                where = place(hashed, v)
                v_short, w_short = v < HASHED, w < HASHED
                short_v, short_w = np.where(v_short, v, model.end).astype(np.int64), np.where(w_short, w, model.end).astype(np.int64)
                followed = np.where(v_short, model.context[short_v], take(times_of, *where, 0.0))
                back = np.where(v_short, model.weight[short_v], take(weight, *where, 1.0)) * np.where(w_short, model.unigram[short_w], 1.0)
                answer = [sums(np.log10(np.where(n > 0, less(n, model.discount) / (followed + 0.5), back))), (n == 0)[~w_short]]
            out.append({"block": row["block"], "part": int(row["part"]), "kind": row["kind"], "data": packed(*answer), "rows": []})
        return pd.DataFrame(out, columns=["block", "part", "kind", "data", "rows"])

    train_tokens, first, unseen = model.total, model.first, model.unigram[model.unk]

    def gather(rows: pd.DataFrame) -> pd.DataFrame:
        meta = rows[rows["kind"] == META].iloc[0]
        n, known, base, which, held, doc, times = unpacked(meta["data"])
        base, total, known = base.copy(), np.zeros(len(n)), known.astype(np.int64)
        counts, needs = [np.empty(0, np.int64)], [np.empty(0, bool)]
        for row in rows[rows["kind"] != META].sort_values(["kind", "part"]).itertuples():
            got = unpacked(row.data)
            size = len(got[0])
            if row.kind == RARE:
                base[:size] += got[0]
                known[:size] += got[1]
                counts.append(got[2])
                continue
            total[:size] += got[0]
            if row.kind == WIDE:
                needs.append(got[1])
        c = np.concatenate(counts)
        unigram = np.log10(np.where(c > 0, less(c, first) / (train_tokens + 1), unseen))
        value = np.where(np.concatenate(needs), unigram[which], 0.0)
        total += np.bincount(doc, weights=np.repeat(value, held) * times, minlength=len(n))
        out = pd.DataFrame({"row": listed(meta["rows"])})
        return out.assign(n_tokens=n.astype(np.int64), n_known=known, train_tokens=train_tokens, base_score=base, score=total)

    slim = docs.select(F.to_json(F.struct(*keep)).alias("row"), "t")
    sent = slim.mapInPandas(doc_blocks(model, parts), "part bigint, block bigint, kind int, data binary, rows array<string>")
    met = stored.groupBy("part").cogroup(sent.groupBy("part")).applyInPandas(meet, "block bigint, part bigint, kind int, data binary, rows array<string>")
    out = met.groupBy("block").applyInPandas(gather, "row string, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    return out.withColumn("row", F.from_json("row", shape)).select("row.*", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", held_out().alias("held_out"), F.col("text").alias("t"))
    model, stored = fit(docs.where(~F.col("held_out")).select("t"))
    return score(docs, model, stored, ["doc_id", "held_out"])


def held_out() -> Column:
    return crc_mod(F.col("doc_id"), 7) == 2
