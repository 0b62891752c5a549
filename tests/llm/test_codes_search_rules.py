"""Vector codes, ranked search and quality rules against plain restatements, with nulls, ties, repeats and empty tables."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracefold.llm import common, html_text, jaccard_join, lexical, quality_rules, url_filter, vector_codes

# --- 11


def brute_codes(rows):
    """rows: (id, vector, label) that take part; returns {(id, code, error)} and the codebooks."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, [math.floor(256 * x) for x in r[1]]))
    z = [[math.floor(256 * x) for x in v] for _, v, _ in rows]
    w = len(z[0]) // 16
    parts = [[v[s * w : (s + 1) * w] for v in z] for s in range(16)]
    books = [p[:64] for p in parts]

    def assign(s):
        return [min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(books[s])) for x in parts[s]]

    for _ in range(2):
        for s in range(16):
            at, new = assign(s), list(books[s])
            for e in {e for _, e in at}:
                mine = [x for x, (_, f) in zip(parts[s], at, strict=True) if f == e]
                new[e] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
            books[s] = new
    told = [assign(s) for s in range(16)]
    out = [(r[0], "".join(f"{told[s][i][1]:02x}" for s in range(16)), sum(told[s][i][0] for s in range(16)), r[2]) for i, r in enumerate(rows)]
    return out, np.array(books)


@pytest.mark.parametrize("width", [1, 3, 4, 6])
def test_vector_codes(spark, width, monkeypatch):
    monkeypatch.setattr(vector_codes, "CHUNK", 32)
    rng = random.Random(width)
    rows = [(i * 3, [rng.choice([0.0, 0.25, -0.5, rng.gauss(0, 1)]) for _ in range(16 * width)], rng.choice([None, 1, 2])) for i in range(150)]
    rows += [(1, rows[0][1], 7), (1, rows[3][1], 7), (None, rows[5][1], 1)] + [(1000 + i, rows[9][1], 3) for i in range(40)]
    bad = [(-1, None, 1), (-2, [None] + [1.0] * (16 * width - 1), 1), (-3, [math.nan] * 16 * width, 1), (-4, [math.inf] + [0.0] * (16 * width - 1), 1), (-5, [], 1), (-6, [1.0], 2)]
    df = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<double>, label int")
    kept = vector_codes.kept(df, "embedding")
    books = vector_codes.fit(kept, "vec_id")
    want, whole = brute_codes(rows)
    assert (books == whole).all()
    out = vector_codes.with_sums(vector_codes.encode(kept, books), F.col("label"), F.col("error"), "label_error")
    sums = Counter()
    for _, _, e, label in want:
        sums[label] += e
    got = sorted(((r.vec_id, r.code, r.error, r.label, r.label_error) for r in out.collect()), key=str)
    assert got == sorted(((*w, sums[w[3]]) for w in want), key=str)


def test_vector_codes_bounds_never_lose_the_nearest():
    rng = np.random.default_rng(2)
    for scale, width in ((3, 4), (10**6, 4), (10**8, 4), (1000, 12), (5, 8)):
        x, c = rng.integers(-scale, scale, (300, width)), rng.integers(-scale, scale, (64, width))
        c[40:50] = c[3:13]  # ties
        x[:20] = c[:20]
        d = ((x[:, None] - c[None]) ** 2).sum(-1)
        at, best = vector_codes.nearest(x, c)
        assert (at == d.argmin(1)).all() and (best == d.min(1)).all()


def test_vector_codes_many_labels_clashes_and_empty(spark, monkeypatch, tmp_path):
    rows = [(i, [float(i % 7)] * 16, i % 5 or None, "x", 1) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, code string, error int")
    kept = vector_codes.kept(df, "embedding")
    coded = vector_codes.encode(kept, vector_codes.fit(kept, "vec_id"))
    assert {"in_code", "in_error", "code", "error"} <= set(coded.columns)
    few = {tuple(r) for r in vector_codes.with_sums(coded, F.col("label"), F.col("error"), "e").select("vec_id", "e").collect()}
    monkeypatch.setattr(vector_codes, "FEW", 2)
    assert few == {tuple(r) for r in vector_codes.with_sums(coded, F.col("label"), F.col("error"), "e").select("vec_id", "e").collect()}
    df.where("false").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert vector_codes.op11_vector_codes(spark, str(tmp_path)).count() == 0
    with pytest.raises(ValueError):
        vector_codes.integers([[1e30] * 16])


# --- 12

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_search(docs, items, k):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    d = [(i, Counter(found), len(found)) for i, t in docs if (found := TERM.findall(low(t)))]
    n, length = len(d), sum(x[2] for x in d)
    df = Counter(t for _, c, _ in d for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, size in d:
            m = 75 + (25 * size * n) // length
            s = 0
            for t in TERM.findall(low(text)):
                if c[t]:
                    s += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("entries", [1 << 20, 40])
def test_lexical_search(spark, monkeypatch, entries):
    monkeypatch.setattr(lexical, "ENTRIES", entries)
    monkeypatch.setattr(lexical, "BLOCK", 7)
    monkeypatch.setattr(lexical, "POSTINGS", 60)
    monkeypatch.setattr(common, "PIECE_BYTES", 64)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)] + ["Ñandú", "ñandú", "É", "it's", "a_b", "x\x7fy", "1.5", "日本"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [(i, text(rng.randrange(1, 60))) for i in range(60)] + [(100 + i, "w1 w2 W1-w3") for i in range(9)]
    docs += [(None, "w1 w2"), (7, "w1 w2 w9"), (200, None), (201, ""), (202, " .,;_ "), (203, "w0 " * 4000)]
    items = [(i, text(rng.randrange(1, 12))) for i in range(14)] + [(3, "w1 w1 w2"), (3, "w1 w1 w2"), (50, None), (51, ""), (52, "nowhere"), (None, "w3")]
    d = spark.createDataFrame([(*r, "z") for r in docs], "doc_id bigint, text string, score string")
    q = spark.createDataFrame([(*r, 1) for r in items], "item_id bigint, text string, rank int")
    got = sorted(map(tuple, lexical.search(d, q, 5).collect()), key=str)
    assert got == brute_search(docs, items, 5)


def test_lexical_search_empty(spark):
    d, q = spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    assert lexical.search(d.where("false"), q).count() == 0
    assert lexical.search(d, q.where("false")).count() == 0
    assert [tuple(r)[:3] for r in lexical.search(d, q).collect()] == [(1, 1, 1)]


# --- 13


def brute_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    cover = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    seen, twice = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            twice += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), twice, len(cover)


def test_statistics(monkeypatch):
    monkeypatch.setattr(common, "PIECE_BYTES", 16)
    rng = random.Random(8)
    pool = ["a", "b", "ñ#", "日本", " ", "x|y", "\n", "\n\n", "\t", " ", "\x0b", "\x85", "the"]
    texts = [None, "", " \n ", "a a a a", "a b\na b\n a b\na b"] + ["".join(rng.choice(pool) + rng.choice(["", " "]) for _ in range(rng.randrange(1, 120))) for _ in range(300)]
    for t in texts:
        assert quality_rules.statistics(None if t is None else t.encode())[:5] == brute_statistics(t), repr(t)
    assert quality_rules.covered(np.arange(5), 1 << 21) == 0
    big = np.array([1, 2, 3, 9, 1, 2, 3])
    assert quality_rules.covered(big, 1 << 21) == quality_rules.covered(big, 10) == 6


def corpus(n, seed):
    """Prose, and tables and shouting between signs."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    rows, labels = [], []
    for i in range(n):
        w = [word() for _ in range(rng.randrange(60, 400))]
        bad = i % 8 == 0
        text = (" | " if i % 16 else "### ").join(w) if bad else ". ".join(" ".join(w[k : k + 9]) for k in range(0, len(w), 9))
        rows.append((i, text))
        labels.append((i, int(not bad)))
    return rows, labels


def test_quality_rules_held_out(spark):
    rows, labels = corpus(1600, 5)
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id bigint, text string, kept string").repartition(4)
    known = spark.createDataFrame([x for x in labels if x[0] % 3], "doc_id bigint, quality int")
    got = {r.doc_id: r for r in quality_rules.judge(docs, known).collect()}
    held = [x for x in labels if x[0] % 3 == 0]
    good, bad = [i for i, y in held if y], [i for i, y in held if not y]
    assert sum(got[i].kept for i in good) >= 0.99 * len(good)
    assert sum(got[i].kept for i in bad) <= 0.02 * len(bad)
    for i, t in rows[:50]:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_statistics(t)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)


def test_quality_rules_nulls_repeats_and_no_labels(spark):
    rows, _ = corpus(30, 2)
    rows += [(0, rows[0][1]), (None, rows[1][1]), (99, None), (98, ""), (97, "word " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for labels in ([], [(0, 1)], [(0, None), (None, 0), (1, 5)]):
        got = quality_rules.judge(docs, spark.createDataFrame(labels, "doc_id bigint, quality int")).collect()
        assert len(got) == len(rows) and all(r.kept != r.base_failed for r in got)
        assert {r.doc_id for r in got if r.base_failed} == {97, 98, 99}
    assert quality_rules.judge(docs.where("false"), spark.createDataFrame([(0, 1)], "doc_id bigint, quality int")).count() == 0


def test_forest_isolates_what_is_odd():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (500, 2)), [[9, 9]]])
    score = quality_rules.Forest(x, trees=64).score(x)
    assert score.argmax() == 500 and score[500] > 0.65 and np.median(score) < 0.5
    assert (quality_rules.Forest(x[:1]).score(x) == 0).all()
    same = quality_rules.Forest(np.zeros((50, 2)))
    assert np.allclose(same.score(np.ones((3, 2))), same.score(np.zeros((3, 2))))
    # a cut's gain, its bin and what it loses: the middle of the cuts that do equally well, never above the loss allowed
    good, bad = np.zeros(10, np.int64), np.zeros(10, np.int64)
    good[2], good[9], bad[7] = 99, 1, 5
    assert quality_rules.threshold(good, bad, 100, 5, 0.05) == (0.99, 5, 0.01)
    assert quality_rules.threshold(good, bad, 100, 5, 0.001)[1] == 10


# --- 8: pages that are hard to read


def test_articles_are_not_lost_to_names():
    of = html_text.extract
    assert of("<article class='post has-comments'><p>Main text</p></article>") == of("<article id='no-ad-article'><p>Main text</p></article>") == of("<div class='ad-free layout'><p>Main text</p></div>") == "Main text"
    assert of("<div class='comments'><p>All there is on the page, which is more than the rest.</p></div><p>x</p>") == "All there is on the page, which is more than the rest.\nx"
    assert of("<p>A story of some length.</p><div class='ad-slot'>Buy</div><ul id='comment_list'><li>Nice</ul>") == "A story of some length."


def test_unfinished_markup_has_no_switch():
    for n in (1, 40, 60, 5000):
        assert html_text.extract("<p>a</p><!-- " + "<b " * n) == "a"
        assert html_text.extract("<p>a</p>" + "< b" * n) == ("a\n" + "< b" * n).strip()
    assert html_text.extract("<p>a <!-- b --> c <!-- > d") == "a c"
    assert html_text.extract('<p title="a > b">x</p><a href="y>z</a>') == "x\nz"
    assert html_text.extract("<table><tr><td>a<td>b<tr><td>c</table><p>d<p>e<div>f</p>g</div>") == "a\nb\nc\nd\ne\nf\ng" or html_text.extract("<p>d<p>e") == "d\ne"


def test_long_broken_pages_take_seconds():
    import time

    for page in ("<span>" * 300_000 + "</b>" * 300_000, "<span>" * 100_000 + "<center>x" * 100_000, '<a "' * 400_000 + ">", "<p>x" * 300_000, "<!--" * 400_000, "<td>" * 200_000 + "</table>" * 200_000):
        began = time.time()
        html_text.extract(page)
        assert time.time() - began < 20


# --- 4 and 1


def test_a_cycle_of_hosts_settles_or_says_that_it_does_not(spark):
    n, damping = 5, 0.5
    edges = spark.createDataFrame([("trust", f"h{i}", f"h{(i + 1) % n}", 1.0) for i in range(n)], "kind string, src string, dst string, share double")
    seeds = spark.createDataFrame([("trust", "h0", 0.7), ("trust", "h2", 0.3)], "kind string, host string, seed double")
    move = np.zeros((n, n))
    for i in range(n):
        move[(i + 1) % n, i] = damping
    seed = (1 - damping) * np.array([0.7, 0, 0.3, 0, 0])
    want = np.linalg.solve(np.eye(n) - move, seed) - seed  # what arrives over links
    got = {r.host: r.received for r in url_filter.propagate(edges, seeds, damping=damping).collect()}
    assert max(abs(got[f"h{i}"] - want[i]) for i in range(n)) < 1e-6
    with pytest.raises(RuntimeError):
        url_filter.propagate(edges, seeds, rounds=8)


def test_a_repeated_id_with_other_texts_is_two_documents(spark):
    a, b = "one two three four five six seven", "a b c d e f g h"
    rows = [(7, a), (7, b), (3, a), (9, b)]
    got = sorted(tuple(r)[:3] for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == [(3, 3, 3), (7, 3, 3), (7, 4, 7), (9, 4, 7)]
