"""N-gram Jaccard join: exact set similarity by an inverted index whose lists are skipped by set relations.

A document's set: the distinct n-word shingles of its whole text (words are what lies between ASCII white space, A-Z lower-
cased), as 64-bit hashes. Two sets link when ``den * intersection >= num * union``.

1. Order. Shingles are ordered by how many documents hold them, rare first, ties by hash. Counts are taken over all shingles
   of all documents: whole ones for the part of the hash space (``COUNTED``) that most of a prefix comes from, elsewhere a chunk of
   ``CHUNK_SHINGLES`` sends what it holds more than once. The ``HEAVIEST`` most frequent enter the order; that bounds what is broadcast. All
   this touches speed only: any order gives the same links.
2. Index. Every distinct set posts the shingles of its prefix (those that a partner must share one of) with its size and
   position; equal sets post once per task and count as one. Lists are read in blocks of equal size and position: a
   block whose length or remaining positions rule out the overlap is skipped whole.
3. Answers. What is left of a list is handed to the list's leader, the set with the largest share of frequent shingles.
   Sets under one leader are compared in cells of bounded size through their differences from the leader: the overlap of y and
   z follows from what each changes of the leader's set, so answers of highly similar sets are derived and not computed anew.
   A pair under several leaders counts under the smallest. Cells return a row per set, never pairs.
4. Classes. Connected components over the cells' stars. Where classes alone are asked for (``keep_first``), blocks of one
   leader meet through the leader's set, and only sets that this leaves outside its class meet the other blocks.

Defined results: a null text, or one without words, has an empty set and links with nothing; with fewer words than n the whole
sequence is the one shingle; rows with a null id are returned unlinked, with a null component; equal texts are each
other's links; the rows of a repeated id are nodes of their own where their texts differ, and each returns; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table
from .graph import components

COUNTED, HEAVIEST, CHUNK_SHINGLES = 0.2, 1 << 19, 1_000_000
#: Longer lists go to their leader whole, without a test of each pair.
LIST, HELD = 64, 20_000
#: Sets and shingles in a block of a leader's sets.
CELL, CELL_SHINGLES = 512, 1 << 20
#: Documents whose ids may be sent to every executor (some 200 bytes each); more are joined by shuffle.
BROADCAST_DOCS = 200_000
U = np.uint64


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes (uint64) of the n-word shingles of text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, U)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), U, len(words))
    width = min(n, len(h))
    out = np.full(len(h) - width + 1, width, U)
    for j in range(width):
        out = mixed(out * U(0x9E3779B97F4A7C15) + h[j : len(h) - width + 1 + j])
    return np.unique(out)


def set_key(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def least_overlap(a, b, num: int, den: int):
    return -(-(num * (a + b)) // (num + den))


def heavy_shingles(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles (sorted uint64), and their counts."""
    cut = U(int(COUNTED * 2**64))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, size = [], 0
        for frame in frames:
            for text in frame["t"]:
                parts.append(shingles(text, n))
                size += len(parts[-1])
                if size > CHUNK_SHINGLES:
                    yield counted(parts)
                    parts, size = [], 0
        if parts:
            yield counted(parts)

    def counted(parts: list[np.ndarray]) -> pd.DataFrame:
        tokens, c = np.unique(np.concatenate(parts), return_counts=True)
        sent = (tokens < cut) | (c > 1)
        tokens, c = tokens[sent], c[sent]
        return pd.DataFrame({"token": tokens.view(np.int64), "c": c})

    rows = docs.where(F.col("t").isNotNull()).mapInPandas(count, "token bigint, c bigint")
    often = materialise(rows.groupBy("token").agg(F.sum("c").alias("c")).where("c >= 3"))
    least, total = 3, 0
    for r in often.groupBy(F.floor(F.log2(F.col("c").cast("double")) * 4).alias("b")).agg(F.count("*").alias("n"), F.min("c").alias("c")).orderBy(F.desc("b")).collect():  # some 160 rows at most
        if total + r["n"] > HEAVIEST:
            break
        total += r["n"]
        least = r["c"]
    top = often.where(F.col("c") >= least)
    got = (top if total else top.limit(HEAVIEST)).toArrow()  # HEAVIEST rows at most, 16 bytes each; as Python objects some 500
    tokens, c = got["token"].to_numpy().view(U), got["c"].to_numpy()
    order = np.argsort(tokens)
    return tokens[order], c[order]


def prefix(tokens: np.ndarray, heavy: np.ndarray, count: np.ndarray, num: int, den: int) -> tuple[np.ndarray, int]:
    """The prefix of a set in the global order, and its share of frequent shingles in thousandths."""
    n = len(tokens)
    p = n - -(-num * n // den) + 1
    if not len(heavy) or not n:
        return tokens[:p], 0
    at = np.minimum(np.searchsorted(heavy, tokens), len(heavy) - 1)
    hit = heavy[at] == tokens
    share = int(1000 * hit.mean())
    light = tokens[~hit]
    if len(light) >= p:
        return light[:p], share
    frequent = tokens[hit][np.argsort(count[at[hit]], kind="stable")]
    return np.concatenate((light, frequent))[:p], share


def postings(docs: DataFrame, n: int, num: int, den: int, heavy: np.ndarray, count: np.ndarray) -> DataFrame:
    """(token, pack, key): per prefix shingle its set, with share << 50 | size << 25 | position; per document (id, -1 - size, key)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for frame in frames:
            out: list[tuple] = []
            size = 0
            for i, text in zip(frame["i"].tolist(), frame["t"], strict=True):
                s = shingles(text, n)
                key = set_key(s)
                out.append((np.array([i]), np.array([-1 - len(s)]), np.array([key])))
                if len(s) and key not in seen:
                    seen.add(key)
                    head, share = prefix(s, heavy, count, num, den)
                    pack = (share << 50) | (len(s) << 25) | np.arange(len(head), dtype=np.int64)
                    out.append((head.view(np.int64), pack, np.full(len(head), key)))
                    size += len(head)
                if size > 300_000:
                    yield pd.DataFrame(dict(zip(("token", "pack", "key"), map(np.concatenate, zip(*out, strict=True)), strict=True)))
                    out, size = [], 0
            if out:
                yield pd.DataFrame(dict(zip(("token", "pack", "key"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    return docs.where("i is not null").mapInPandas(run, "token bigint, pack bigint, key bigint")


def read_lists(num: int, den: int):
    """A function for mapInPandas over postings sorted by (token, pack descending, key): rows (kind, a, b, n).

    kind 0: document a has set b of size n; kind 1: set b is under leader a.
    """
    M25 = (1 << 25) - 1

    def under(leader: np.ndarray, key: np.ndarray) -> pd.DataFrame:
        both = np.unique(np.stack((leader, key), axis=1), axis=0) if len(key) else np.empty((0, 2), np.int64)
        return pd.DataFrame({"kind": np.ones(len(both), np.int32), "a": both[:, 0], "b": both[:, 1], "n": np.zeros(len(both), np.int64)})

    def fits(na, pa, nb, pb):
        room = 1 + np.minimum(na - pa, nb - pb) - 1
        return (den * np.minimum(na, nb) >= num * np.maximum(na, nb)) & (room >= least_overlap(na, nb, num, den))

    def process(token: np.ndarray, pack: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaders and members of whole lists."""
        fresh = np.ones(len(token), bool)
        fresh[1:] = (token[1:] != token[:-1]) | (key[1:] != key[:-1])
        token, pack, key = token[fresh], pack[fresh], key[fresh]
        start = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1]))) if len(token) else np.empty(0, np.int64)
        length = np.diff(np.append(start, len(token)))
        size, pos = pack >> 25 & M25, pack & M25
        leaders, members = [], []
        two = start[length == 2]
        ok = two[fits(size[two], pos[two], size[two + 1], pos[two + 1])]
        leaders += [key[ok], key[ok]]
        members += [key[ok], key[ok + 1]]
        for lo, m in zip(start[length > 2].tolist(), length[length > 2].tolist(), strict=True):
            k = key[lo : lo + m]
            if m <= LIST:
                # blocks of equal size and position stand or fall together
                block, of = np.unique(pack[lo : lo + m] & ((1 << 50) - 1), return_inverse=True)
                bn, bp = block >> 25, block & M25
                meet = fits(bn[:, None], bp[:, None], bn[None, :], bp[None, :])
                meet[np.diag_indices(len(block))] &= np.bincount(of) > 1
                k = k[meet.any(axis=1)[of]]
            if len(k) > 1:
                leaders.append(np.full(len(k), k[0]))
                members.append(k)
        return np.concatenate(leaders), np.concatenate(members)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = tuple(np.empty(0, np.int64) for _ in range(3))
        long_token, leader = None, 0
        for frame in frames:
            rows = tuple(frame[c].to_numpy() for c in ("token", "pack", "key"))
            doc = rows[1] < 0
            if doc.any():
                yield pd.DataFrame({"kind": np.zeros(doc.sum(), np.int32), "a": rows[0][doc], "b": rows[2][doc], "n": -1 - rows[1][doc]})
            token, pack, key = (np.concatenate((h, r[~doc])) for h, r in zip(held, rows, strict=True))
            if long_token is not None and len(token):
                more = token == long_token
                yield under(np.full(more.sum(), leader), key[more])
                token, pack, key = token[~more], pack[~more], key[~more]
                if len(token):
                    long_token = None
            if not len(token):
                held = token, pack, key
                continue
            cut = np.flatnonzero(token != token[-1])
            cut = cut[-1] + 1 if len(cut) else 0
            if cut:
                yield under(*process(token[:cut], pack[:cut], key[:cut]))
            held = token[cut:], pack[cut:], key[cut:]
            if len(held[0]) > HELD:
                long_token, leader = int(held[0][0]), int(held[2][0])
                yield under(np.full(len(held[2]), leader), held[2])
                held = tuple(np.empty(0, np.int64) for _ in range(3))
        if len(held[0]):
            yield under(*process(*held))

    return run


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Number of shared tokens of each pair of sets."""
    g = len(sets)
    token = np.concatenate(sets)
    member = np.repeat(np.arange(g), [len(s) for s in sets])
    order = np.argsort(token, kind="stable")
    token, member = token[order], member[order]
    start = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1]))) if len(token) else np.empty(0, np.int64)
    length = np.diff(np.append(start, len(token)))
    out = np.zeros((g, g), np.int32)
    two = start[length == 2]
    if len(two):
        flat = np.bincount(member[two] * g + member[two + 1], minlength=g * g).reshape(g, g)
        out += (flat + flat.T).astype(np.int32)
    for lo, m in zip(start[length > 2].tolist(), length[length > 2].tolist(), strict=True):
        at = member[lo : lo + m]
        out[np.ix_(at, at)] += 1
    out[np.diag_indices(g)] = [len(s) for s in sets]
    return out


def work(sets: list[np.ndarray]) -> float:
    c = np.unique(np.concatenate(sets), return_counts=True)[1].astype(float)
    return float((c * c).sum())


def overlaps(sets: list[np.ndarray], leader: np.ndarray) -> np.ndarray:
    """Intersection sizes of all pairs, derived from differences with the leader's set where these are the smaller job."""
    if len(sets) > 8:
        changed = [np.setxor1d(s, leader, assume_unique=True) for s in sets]
        if work(changed) < work(sets):
            shared = common_counts(changed)
            d, n = np.array([len(c) for c in changed]), np.array([len(s) for s in sets])
            apart = d[:, None] + d[None, :] - 2 * shared
            both = (n[:, None] + n[None, :] - apart) // 2
            both[np.diag_indices(len(n))] = n
            return both
    return common_counts(sets)


def roots_of(link: np.ndarray) -> np.ndarray:
    """The smallest index that each index of a symmetric matrix of links reaches."""
    root = np.full(len(link), -1)
    for i in range(len(link)):
        if root[i] >= 0:
            continue
        root[i], front = i, np.array([i])
        while len(front):
            front = np.flatnonzero(link[front].any(axis=0) & (root < 0))
            root[front] = i
    return root


def compare_cell(num: int, den: int, counts: bool = True):
    """A function for applyInPandas over (leader, bi, bj): rows (key, root, links) for the sets of the cell; links are 0 without counts."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("key").sort_values(["share", "key"], ascending=[False, True])
        leader, bi, bj = (int(rows[c].iloc[0]) for c in ("leader", "bi", "bj"))
        sets = [np.frombuffer(b, U) for b in rows["tokens"]]
        key, block, times = rows["key"].to_numpy(), rows["block"].to_numpy(), rows["times"].to_numpy()
        both = overlaps(sets, sets[0])
        n = np.array([len(s) for s in sets], np.int64)
        link = den * both.astype(np.int64) >= num * (n[:, None] + n[None, :] - both)
        if bi != bj:
            link &= block[:, None] != block[None, :]
        links = np.zeros(len(sets), np.int64)
        if counts:
            mine = np.ones(link.shape, bool)  # whether a pair counts under this leader
            many = [i for i, x in enumerate(rows["leaders"]) if len(x) > 1]
            sorted_leaders = [frozenset(rows["leaders"].iloc[i].tolist()) for i in many]
            for x, i in enumerate(many):
                for y, j in enumerate(many[:x]):
                    if link[i, j]:
                        mine[i, j] = mine[j, i] = min(sorted_leaders[x] & sorted_leaders[y]) == leader
            link_others = link & mine
            link_others[np.diag_indices(len(n))] = False
            links = link_others.astype(np.int64) @ times
        return pd.DataFrame({"key": key, "root": key[roots_of(link)], "links": links})

    return run


def compare_strays(num: int, den: int):
    """A function for applyInPandas over (leader, bi, bj): rows (key, root) for the links that strays (block 0) have."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["block", "key"]).drop_duplicates("key")
        sets, key = [np.frombuffer(b, U) for b in rows["tokens"]], rows["key"].to_numpy()
        both, n = overlaps(sets, sets[0]).astype(np.int64), np.array([len(s) for s in sets], np.int64)
        link = den * both >= num * (n[:, None] + n[None, :] - both)
        stray = rows["block"].to_numpy() == 0
        return pd.DataFrame({"key": key, "root": key[roots_of(link & (stray[:, None] | stray[None, :]))]})

    return run


class Lists:
    """The index read once: documents with their sets, sets with their smallest document, and the leaders that sets are under."""

    def __init__(self, docs: DataFrame, n: int, num: int, den: int, id_col: str, text_col: str) -> None:
        self.text = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
        self.n, self.num, self.den = n, num, den
        self.heavy, self.count = heavy_shingles(self.text, n)
        lists = postings(self.text, n, num, den, self.heavy, self.count).repartition("token").sortWithinPartitions("token", F.desc("pack"), "key")
        read = materialise(lists.mapInPandas(read_lists(num, den), "kind int, a bigint, b bigint, n bigint"))
        self.of_doc = read.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("key"), "n")
        self.keys = self.of_doc.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("rep"), F.countDistinct("doc_id").alias("times"), F.max("n").alias("n"))
        under = read.where("kind = 1").select(F.col("a").alias("leader"), F.col("b").alias("key")).distinct().join(self.keys.select("key", "n"), "key")
        sizes = under.groupBy("leader").agg(F.count("*").alias("g"), F.sum("n").alias("s")).where("g > 1")
        blocks = F.ceil(F.greatest(F.col("g") / CELL, F.col("s") / CELL_SHINGLES)).cast("int")
        self.under = materialise(under.join(sizes, "leader").select("key", "leader", blocks.alias("blocks")))

    def shipped(self, member: DataFrame, places) -> DataFrame:
        """Whole sets of the cells they are compared in. member: key, under; places: a set's rows (leader, bi, bj, block) for an entry of under."""
        n, heavy, count, num, den = self.n, self.heavy, self.count, self.num, self.den
        columns = ["leader", "bi", "bj", "block", "key", "times", "share", "leaders", "tokens"]
        ask = materialise(member.join(self.keys, "key").select("key", "rep", "times", "under"))
        small = ask.limit(BROADCAST_DOCS + 1).count() <= BROADCAST_DOCS
        fetch = self.text.join(F.broadcast(ask) if small else ask, self.text["i"] == ask["rep"]).select("key", "times", "under", "t")

        def ship(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                out: list[tuple] = []
                size = 0
                for key, times, under, t in zip(frame["key"].tolist(), frame["times"].tolist(), frame["under"], frame["t"], strict=True):
                    s = shingles(t, n)
                    if set_key(s) != key:  # another row of a repeated id
                        continue
                    share = prefix(s, heavy, count, num, den)[1]
                    leaders, tokens = [p["leader"] for p in under], s.tobytes()
                    for p in under:
                        for leader, bi, bj, block in places(key, p):
                            out.append((leader, bi, bj, block, key, times, share, leaders, tokens))
                            size += len(tokens) + 200
                            if size > 8_000_000:
                                yield pd.DataFrame(out, columns=columns)
                                out, size = [], 0
                if out:
                    yield pd.DataFrame(out, columns=columns)

        return fetch.mapInPandas(ship, "leader bigint, bi int, bj int, block int, key bigint, times bigint, share int, leaders array<bigint>, tokens binary")

    def classes(self, found: DataFrame) -> DataFrame:
        """(key, rep, times, component_id): found (node, root) turned into the smallest document of each class; sets without a link are their own."""
        known = self.keys.join(found.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
        return known.join(known.groupBy("root").agg(F.min("rep").alias("component_id")), "root").select("key", "rep", "times", "component_id")


def gathered(member: DataFrame, *fields: str) -> DataFrame:
    return member.groupBy("key").agg(F.collect_list(F.struct(*fields)).alias("under"))


def all_cells(key: int, p) -> list[tuple[int, int, int, int]]:
    mine = key % p["blocks"]
    return [(p["leader"], min(mine, j), max(mine, j), mine) for j in range(p["blocks"])]


def join(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links), a row per row of docs; see the module."""
    lists = Lists(docs, n, num, den, id_col, text_col)
    shipped = lists.shipped(gathered(lists.under, "leader", "blocks"), all_cells)
    cells = materialise(shipped.groupBy("leader", "bi", "bj").applyInPandas(compare_cell(num, den), "key bigint, root bigint, links bigint"))
    known = lists.classes(components(cells.select(F.col("key").alias("a"), F.col("root").alias("b"))))
    links = cells.groupBy("key").agg(F.sum("links").alias("links"))
    special = materialise(
        known.join(links, "key", "left").where("times > 1 or links > 0").select("key", "component_id", (F.col("times") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    )
    small = special.limit(BROADCAST_DOCS + 1).count() <= BROADCAST_DOCS
    out = lists.of_doc.join(F.broadcast(special) if small else special, "key", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(F.col("n") > 0, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
    )

    def sizes_only(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"n_shingles": [len(shingles(t, n)) for t in frame["t"]]}, dtype="int64")

    unlinked = lists.text.where("i is null").select("t").mapInPandas(sizes_only, "n_shingles bigint")
    return out.unionByName(unlinked.select(F.lit(None).cast("long").alias("doc_id"), "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(0).cast("long").alias("n_links")))


def connected(lists: Lists) -> DataFrame:
    """(node, root) of the classes alone, without the comparison of all blocks of a leader with each other.

    Star. Every block of a leader gets the leader's set besides its own, so a set goes to one cell per leader, and what is shipped
    grows with the sets. Rest. Whatever is in the leader's class by then needs no comparison with what else is; the others meet every block
    of their leader, and nothing else is shipped twice. No link that could join two classes goes unseen.
    """
    num, den = lists.num, lists.den

    def star(key: int, p) -> list[tuple[int, int, int, int]]:
        if key == p["leader"]:
            return [(key, j, j, 0) for j in range(p["blocks"])]
        mine = key % p["blocks"]
        return [(p["leader"], mine, mine, 0)]

    def rest(key: int, p) -> list[tuple[int, int, int, int]]:
        sides = [(p["leader"], r, key % p["blocks"], 1) for r in range(p["strays"])]
        return sides + ([(p["leader"], key % p["strays"], j, 0) for j in range(p["blocks"])] if p["stray"] else [])

    shape = "key bigint, root bigint, links bigint"
    first = lists.shipped(gathered(lists.under, "leader", "blocks"), star).groupBy("leader", "bi", "bj").applyInPandas(compare_cell(num, den, counts=False), shape)
    edges = materialise(first.select(F.col("key").alias("a"), F.col("root").alias("b")).where("a <> b").distinct())
    found = materialise(components(edges))
    wide = lists.under.where("blocks > 1")
    if wide.isEmpty():
        return found
    root = found.select(F.col("node").alias("key"), "root")
    wide = wide.join(root, "key", "left").withColumn("root", F.coalesce("root", "key"))
    home = root.select(F.col("key").alias("leader"), F.col("root").alias("home"))
    wide = wide.join(home, "leader", "left").withColumn("stray", F.col("root") != F.coalesce("home", "leader"))
    strays = wide.where("stray").groupBy("leader").agg(F.ceil(F.count("*") / CELL).cast("int").alias("strays"))
    again = materialise(wide.join(strays, "leader").select("key", "leader", "blocks", "strays", "stray"))
    if again.isEmpty():
        return found
    second = lists.shipped(gathered(again, "leader", "blocks", "strays", "stray"), rest).groupBy("leader", "bi", "bj").applyInPandas(compare_strays(num, den), "key bigint, root bigint")
    more = second.select(F.col("key").alias("a"), F.col("root").alias("b")).where("a <> b").distinct()
    return components(edges.unionByName(more))


def keep_first(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each class, that of the smallest id. Rows without a word or an id stay; of rows that share an id, those
    with different sets of different classes all stay, and of those in one class the longest text, the smallest of these."""
    lists = Lists(docs, n, num, den, id_col, text_col)
    known = lists.classes(connected(lists))
    found = lists.of_doc.where("n > 0").join(known.where("rep <> component_id or times > 1").select("key", "component_id"), "key", "left")
    drop = materialise(found.where("doc_id <> component_id").select(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).distinct())
    again = materialise(lists.of_doc.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__again")))
    small = drop.limit(BROADCAST_DOCS + 1).count() <= BROADCAST_DOCS
    ids = drop.select("__id").distinct()
    if again.isEmpty():
        return docs.join(F.broadcast(ids) if small else ids, F.col(id_col) == F.col("__id"), "left_anti")
    once = docs.join(again, F.col(id_col) == F.col("__again"), "left_anti")
    once = once.join(F.broadcast(ids) if small else ids, F.col(id_col) == F.col("__id"), "left_anti")

    def keyed(texts: pd.Series) -> pd.Series:
        sets = (shingles(t, n) for t in texts)
        return pd.Series([set_key(s) if len(s) else None for s in sets], dtype="Int64")

    twice = docs.join(again, F.col(id_col) == F.col("__again"), "left_semi").withColumn("__of", F.pandas_udf(keyed, "bigint").asNondeterministic()(F.col(text_col)))
    twice = twice.join(drop, (F.col(id_col) == F.col("__id")) & (F.col("__of") == F.col("__key")), "left_anti")
    twice = twice.join(known.select(F.col("key").alias("__known"), F.col("component_id").alias("__class")), F.col("__of") == F.col("__known"), "left")
    order = Window.partitionBy(id_col, "__class").orderBy(F.length(text_col).desc(), text_col)
    one = twice.where("__of is not null").withColumn("__r", F.row_number().over(order)).where("__r = 1")
    return once.unionByName(one.select(*docs.columns)).unionByName(twice.where("__of is null").select(*docs.columns))


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"), n=4, num=85, den=100)
