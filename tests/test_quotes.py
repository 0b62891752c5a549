"""What is quoted, what of a prompt is the user's, what a restore reaches; every edit of the test data against a plain restatement."""

import json
import re

from pyspark.sql import functions as F

from tracefold.functions import git, quotes
from tracefold.functions.authored import MOST, authored
from tracefold.operators import edits, record
from tracefold.operators.order import timeline
from tracefold.plans import adapter, catalogue
from tracefold.sources import ledger

DATA = "/root/testdata/sf0.001"
REJECTED = "We tried to cache the key in a map that lives as long as the process. Run the tests. That way is a Rejected Approach, so leave it! Then go on."


def column(spark, schema, rows, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_code_sentences_and_paths(spark):
    said = {
        "Right. Now check retry_backoff() please. Thanks!": "Right. Now check retry_backoff() please.", "no code here. none.": "no code here. none.", "src/a.py": "src/a.py", "": "", "Use `x` now. bye": "Use `x` now.",
        "v1.2 is out! See a_b? Yes.": "v1.2 is out! See a_b?", "one `mark. And a_b. c": "one `mark. And a_b.",
    }
    assert column(spark, "t string", [(t,) for t in [*said, None]], quotes.through_code_sentence(F.col("t"))) == [*said.values(), None]
    cases = [
        ("- FAIL tests/x.py::test_y", "tests/x.py", True), ("see src/a.py.", "src/a.py", True), ("- src/a.py | 1 edit", "a.py", False), ("src/a.pyc", "src/a.py", False), ("src/a.py/b", "src/a.py", False), ("any", "", False),
        ("in C:\\Env\\a.py now", "C:\\Env\\a.py", True), ("xa.py a.py", "a.py", True), ("éa.py", "a.py", False), ("a(b.py", "a(b.py", True), (None, "a", None),
    ]
    assert column(spark, "l string, p string", [c[:2] for c in cases], quotes.names_path(F.col("l"), F.col("p"))) == [c[2] for c in cases]


def test_rejections_keep_approach_and_clause(spark):
    whole = lambda n, t=REJECTED: column(spark, "t string", [(t,)], quotes.quote_rejection(F.col("t"), F.lit("rejected approach"), n))[0]
    assert whole(200) == REJECTED
    assert whole(110) == "We tried to cache the key in a map that lives as long as the process. ... That way is a Rejected Approach ..."
    assert whole(80) == "We tried to cache the key in a map th... That way is a Rejected Approach ..."
    sizes = range(24, 150, 7)
    cuts = spark.createDataFrame([(REJECTED,)], "t string").select(*[quotes.quote_rejection(F.col("t"), F.lit("rejected approach"), n).alias(f"c{n}") for n in sizes]).first()
    assert all(len(c) <= n for c, n in zip(cuts, sizes, strict=True))
    assert whole(60, "Caching is a rejected approach, because it was slow and it ate all of the memory.") == "Caching is a rejected approach ..."
    assert " ... " in whole(40, "no label at all in this text that is far too long to be shown whole")
    section, text = F.col("s"), F.col("t")
    rows = [("REJECTED_APPROACHES", REJECTED), ("EARLIER", "Right. See a_b now. " + "More of it. " * 9), ("LATEST", "x" * 110)]
    got = column(spark, "s string, t string", rows, record.shortened(section, text, 100))
    assert got == [whole(100), "Right. See a_b now.", "x" * 97 + "..."]


def test_prompts_without_what_clients_put_around_them(spark):
    note = "<system-reminder>n</system-reminder>"
    cases = {
        "hi": "hi", f"{note} do it <ide_sel f='x'>z</ide_sel>\n": "do it", "<bash-x>a<bash-x>b</bash-x>c</bash-x>rest": "rest", "<system-reminder>never ends": "<system-reminder>never ends", "see <b>x</b>": "see <b>x</b>", "<b>x</b>": "<b>x</b>",
        f" x {note} y": f"x {note} y", f"{note}\n\t{note.upper()}": "", "": "", "x</bash-a> y</bash-a>": "x</bash-a> y</bash-a>", f"a {note} b {note}": f"a {note} b", f"{note}<b>x</b>{note}": "<b>x</b>", "<command-name/>go": "<command-name/>go",
        note * MOST + "go": "go", note * (MOST + 1) + "go": "", note + "word " * 200_000 + "end": "word " * 200_000 + "end", None: None,
    }
    assert column(spark, "p string", [(p,) for p in cases], authored(F.col("p"))) == list(cases.values())
    stored = spark.createDataFrame([(1, "k", "s", "p", None, "UserPromptSubmit", None, None, 5, json.dumps({"prompt": f"{note} task: go"}))], ledger.EVENT)
    assert ledger.parsed(stored).first()["prompt"] == "task: go"


def test_what_restores_reach(spark):
    cases = [
        ("git checkout -- src/a.py", "src/a.py", True), ("git checkout -- src/a.py", "src/ab.py", False), ("git checkout main", "src/a.py", False), ("cd src && git restore 'a*.py'", "src/deep/a.py", False), ("cd src && git restore 'a*.py'", "src/a/b.py", True),
        ("git -C sub reset --hard", "src/a.py", True), ("git reset", "src/a.py", False), ("git -C /elsewhere stash", "src/a.py", False), ("git stash pop", "a", False), ("git stash push -m src b", "src", False), ("git clean -fd", "x", True), ("git clean -nfd", "x", False),
        ("git restore --staged x", "x", False), ("git restore -SW x", "x", True), ("git checkout -b x", "x", False), ("git checkout HEAD~1 -- .", "x", True), ("cd $X; git stash", "x", False), ("git restore \"$(ls)\" x", "x", False), ("git restore ../p/x", "x", True),
        ("echo git; git restore :/", "x", True), ("git restore -p x", "x", False), ("git restore", "x", False), ("git stash", "../x", False), ("git restore /w/p/x", "/w/p/x", True), ("git checkout 'a[b]'", "ab", False), (None, "x", False), ("git stash", None, False), ("git", "x", False),
    ]
    root = F.lit("/w/p")
    rows = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(cases)], "i int, c string, p string")
    got = rows.select("i", git.restore_targets(F.col("c"), root, root).alias("to"), "p").select("i", git.reached(F.col("to"), F.col("p"), root).alias("ok")).orderBy("i").collect()
    assert [(c, r["ok"]) for c, r in zip(cases, got, strict=True)] == [(c, c[2]) for c in cases]


def test_a_restore_discards_only_what_it_reaches(spark):
    a, b = "a" * 32, "b" * 32
    files = [{"path": p, "hash": b, "size": 1} for p in ("src/x.py", "docs/y.md")]
    made = [(1, {"path": "src/x.py", "post_hash": a, "cwd": "/w/p"}), (2, {"path": "docs/y.md", "post_hash": a}), (3, {"command": "git checkout -- .", "cwd": "/w/p/src", "git": {"restore": "git checkout -- .", "commit": False, "files": files}})]
    rows = [(i, str(i), "s", "p", None, "PostToolUse", "Edit", None, i, json.dumps(p)) for i, p in made]
    seen = edits.observations(timeline(ledger.parsed(spark.createDataFrame(rows, ledger.EVENT))))
    assert {r["path"]: r["status"] for r in edits.lifecycle(seen)[0].collect()} == {"src/x.py": "DISCARDED", "docs/y.md": "ACTIVE"}


def plain(rows):
    """Fates and dead ends of one file's observations, looking through all that came before at every step."""
    versions, made, dead = [], [], []
    digest = lambda h: re.fullmatch("[0-9a-f]{32}", h) is not None

    def resolve(these, status, how, r):
        for e in these:
            e.update(status=status, mechanism=how, at=r["event_id"])
        dead.append({"id": r["event_id"], "edits": [e["id"] for e in these], "hashes": {e["hash"] for e in these}, "how": how, "ms": r["ts_ms"], "again": False})

    for r in rows:
        h, git_post = r["hash"], r["source"] == "git_post"
        active = lambda: [e for e in made if e["status"] == "ACTIVE"]
        if git_post and r["restore"]:
            done = max((i for i, e in enumerate(made) if e["status"] == "COMMITTED"), default=-1)
            loose = [e for e in made[done + 1 :] if e["status"] == "ACTIVE"]
            if loose and loose[-1]["hash"] != h:
                resolve(loose, "DISCARDED", "git_command", r)
        if git_post and r["commit"]:
            same = [i for i, e in enumerate(made) if e["status"] == "ACTIVE" and e["hash"] == h]
            for e in made[: same[-1] + 1] if same else []:
                if e["status"] == "ACTIVE":
                    e.update(status="COMMITTED", at=r["event_id"])
        before = versions[-256:]
        versions.append((h, r["source"], r["event_id"], r["ts_ms"]))
        if r["source"] == "post_edit":
            made.append({"id": r["event_id"], "hash": h, "status": "ACTIVE", "mechanism": None, "at": None})
        if not before or before[-1][0] == h or before[-1][3] > r["raw_ms"] or not (digest(h) or h == "absent"):
            continue
        again = [d for d in dead if not d["again"] and h in d["hashes"] and r["ts_ms"] >= d["ms"]] if r["source"] in ("post_edit", "git_post", "turn_scan") and digest(h) else []
        if again:
            again[0]["again"] = True
            for e in made:
                if e["id"] in again[0]["edits"]:
                    e["status"] = "REAPPLIED"
            continue
        if h not in [v[0] for v in before]:
            continue
        back = max(i for i, v in enumerate(before) if v[0] == h)
        between = {v[2] for v in before[back + 1 :] if v[1] == "post_edit"}
        undone = [e for e in active() if e["id"] in between]
        if undone:
            how = "git_command" if git_post and r["restore"] else ("rewrite" if r["tool"] == "Write" else "inverse_edit") if r["source"] == "post_edit" else "external"
            resolve(undone, "REVERTED", how, r)
    return [(e["id"], e["status"], e["mechanism"], e["at"]) for e in made], [(d["id"], d["edits"], d["how"], d["again"]) for d in dead]


def test_every_edit_of_the_data_against_a_restatement(spark):
    seen = edits.observations(catalogue.with_git(adapter.told(spark, DATA)))
    files = {}
    for r in sorted(seen.collect(), key=lambda r: (r["position"], r["n"], r["event_id"])):
        files.setdefault((r["session_id"], r["path"]), []).append(r.asDict())
    want = [plain(rows) for rows in files.values()]
    fates = [(r["event_id"], r["status"], r["mechanism"], r["resolved_event_id"]) for r in catalogue.edit_lifecycle(spark, DATA).collect()]
    dead = [(r["id"], r["edit_ids"], r["mechanism"], r["reapplied"]) for r in catalogue.dead_ends(spark, DATA).collect()]
    assert sorted(fates, key=str) == sorted((x for w in want for x in w[0]), key=str) and fates
    assert sorted(dead, key=str) == sorted((x for w in want for x in w[1]), key=str) and dead
    assert any(r["restore"] for rows in files.values() for r in rows)
