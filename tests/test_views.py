"""Sections as of a time equal the folds of the events up to then; evidence of dead ends; markers through layers."""

import random

import pytest
from pyspark.sql import functions as F

from tracefold.operators import edits, folds, lineage, views
from tracefold.plans import adapter, catalogue

DATA = "/root/testdata/sf0.001"


def test_sections_equal_the_folds_of_what_was_known_then(spark):
    timeline = catalogue.with_git(adapter.told_once(spark, DATA))
    flat = lambda df, *names: sorted(map(str, df.select(*names).collect()))
    whole = edits.observations(timeline)
    times = timeline.select(F.percentile("logical_ms", F.array(F.lit(0.2), F.lit(0.6), F.lit(1.0)))).first()[0]
    some = 0
    for at in map(int, times):
        then = timeline.where(F.col("logical_ms") <= at)
        fates, dead = edits.lifecycle(edits.observations(then))
        assert flat(views.as_of(views.edit_statuses(whole), at), "session_id", "path", "event_id", "status", "mechanism") == flat(fates, "session_id", "path", "event_id", "status", "mechanism")
        names = ["session_id", "path", "id", "edit_ids", "mechanism", "reapplied"]
        assert flat(views.as_of(views.dead_end_statuses(whole), at), *names) == flat(dead, *names)
        stats = ["session_id", "epoch", "path", "edits", "reads", "in_failure", "first_touch_ms", "last_touch_ms"]
        assert flat(views.as_of(views.file_activity(timeline, folds.commands(timeline)), at), *stats) == flat(folds.file_stats(then, folds.commands(then)), *stats)
        some += dead.count()
    assert some


def test_statuses_over_time():
    fold = edits.FileFold()
    a, b = "a" * 32, "b" * 32
    for step in ((1, 1, 1, "pre_edit", a), (1, 1, 1, "post_edit", b), (2, 5, 5, "turn_scan", a), (3, 9, 9, "post_edit", b)):
        fold.step(*step, "Edit", False, False)
    rows = [r[2:4] + r[5:] for r in edits.statuses_over_time("s", "f", fold)]
    assert rows == [
        (1, None, "ACTIVE", None, 1, 5), (1, None, "REVERTED", "external", 5, 9), (3, None, "ACTIVE", None, 9, None), (1, None, "REAPPLIED", "external", 9, None), (None, 2, "UNDONE", "external", 5, 9), (None, 2, "REAPPLIED", "external", 9, None),
    ]


def plain_evidence(parts):
    parts = [p for p in parts if p[1] is not None or p[2] is not None]
    k = next((i for i, p in enumerate(parts) if p[2] is None or all(q[1] != p[2] for q in parts[i + 1 :])), None)
    if k is None:
        return None
    minus, at = parts[k][1], k
    while (j := next((j for j in range(at - 1, -1, -1) if parts[j][2] is not None and parts[j][2] == minus), None)) is not None:
        minus, at = parts[j][1], j
    return parts[k][0], minus, parts[k][2]


def test_evidence_of_dead_ends(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for d in range(80):
        parts = [(d * 100 + i, rng.choice([None, "a", "b", "c", "d"]), rng.choice([None, "a", "b", "c", "d"])) for i in range(rng.randrange(0, 9))]
        rows += [("s", d, n, *p) for n, p in enumerate(parts)]
        if plain_evidence(parts):
            want[d] = plain_evidence(parts)
    df = spark.createDataFrame(rows, "session_id string, id bigint, n int, event_id bigint, removed string, added string").withColumn("excerpt", F.lit("x"))
    got = {r.id: (r.event_id, r.removed, r.added) for r in edits.evidence(df).collect()}
    assert got == want


def test_markers_through_layers(spark):
    rng = random.Random(2)
    words = ["src/a.py", "src/ab.py", "parse_config", "Parse", "x", "é1", "tests\\t1.py", "run"]
    texts = [(f"s{s}", layer, f"{layer}{i}", " ".join(rng.choice(words) for _ in range(rng.randrange(1, 6)))) for s in range(4) for layer in ("a", "b", "c") if (s, layer) != (1, "b") for i in range(3)]
    markers = [(f"s{s}", m) for s in range(4) for m in ("SRC/A.py", "parse_", "config src", "x", "1", "é", "t1", "tests/t1.py", "never here")] + [("s0", None), ("s0", "")]
    t = spark.createDataFrame(texts, "session_id string, layer string, row string, text string")
    got = {(r.session_id, r.marker, r.layer): (r.present, r.rows) for r in lineage.presence(t, spark.createDataFrame(markers, "session_id string, marker string"), ["a", "b", "c", "d"]).collect()}
    norm = lambda x: x.replace("\\", "/").lower()
    for s, m in markers[:-2]:
        for layer in ("a", "b", "c", "d"):
            mine = [x for x in texts if x[:2] == (s, layer)]
            hit = sorted(x[2] for x in mine if norm(m) in norm(x[3]))
            assert got[s, m, layer] == ((bool(hit), hit) if mine else (None, [])), (s, m, layer)
    assert len(got) == 4 * 9 * 4
    traced = {(r.session_id, r.marker): (r.lost_at, r.reason) for r in lineage.trace(t, spark.createDataFrame(markers, "session_id string, marker string"), {"a": "r-a", "b": "r-b", "c": "r-c", "d": "r-d"}).collect()}
    for s, m in markers[:-2]:
        seen = [(layer, got[s, m, layer][0]) for layer in "abcd" if got[s, m, layer][0] is not None]
        lost = next((b[0] for a, b in zip(seen, seen[1:], strict=False) if a[1] and not b[1]), None)
        assert traced[s, m] == (lost, lost and f"r-{lost}")


@pytest.mark.parametrize("few", [2, 64])
def test_markers_are_traced_with_nothing_kept_of_texts(spark, monkeypatch, few):
    """Sessions with few and with many markers, some without a text; no text is sorted, joined twice or gathered for few ones."""
    monkeypatch.setattr(lineage, "FEW", few)
    rng = random.Random(3)
    words, layers = ["src/a.py", "Parse", "x", "\u00e91", "t\\1", "run", ""], ["a", "b", "c", "d"]
    texts = [(f"s{s}", rng.choice("abcde"), "r", rng.choice([None, " ".join(rng.choice(words) for _ in range(3))])) for s in range(40) for _ in range(rng.randrange(8))]
    markers = [(f"s{s}", m) for s in range(45) for m in rng.sample(["SRC/a", "parse", "x", "\u00c91", "t/1", "never", "n x", None, ""], rng.randrange(1, 9))]
    asked = spark.createDataFrame(markers + markers[:9], "session_id string, marker string")
    traced = lineage.trace(spark.createDataFrame(texts, "session_id string, layer string, row string, text string"), asked, {k: f"r-{k}" for k in layers})
    norm = lambda x: x.replace("\\", "/").lower()
    want = {}
    for s, m in markers:
        if m:
            by = [[norm(m) in norm(t) for s2, l2, _, t in texts if (s2, l2) == (s, layer) and t is not None] for layer in layers]
            seen = [(layer, any(x)) for layer, x in zip(layers, by, strict=True) if x]
            lost = next((b[0] for a, b in zip(seen, seen[1:], strict=False) if a[1] and not b[1]), None)
            want[s, m] = (lost, any(x for _, x in seen), lost and f"r-{lost}")
    rows = traced.collect()
    assert {(r.session_id, r.marker): (r.lost_at, r.ever_present, r.reason) for r in rows} == want and len(rows) == len(want)
    plan = traced._jdf.queryExecution().optimizedPlan().toString()
    assert few == 2 or ("substr" not in plan and "collect_list(row" not in plan and plan.count("Join") == 1)
