"""What ingest keeps, spool and staged files, frozen and delivered checkpoints, test states: small cases and plain restatements."""

import json
import os
import random

from pyspark.sql import functions as F

from tracefold.functions import ingest
from tracefold.functions import text as tx
from tracefold.operators import checkpoints as ck
from tracefold.sources import ledger
from tracefold.sources.heads import read_heads


def one(spark, column, *values):
    names = "abc"[: len(values)]
    df = spark.createDataFrame([values], ", ".join(f"{n} string" for n in names))
    return df.select(column(*[F.col(n) for n in names])).first()[0]


def test_first_difference(spark):
    of = lambda a, b: one(spark, ingest.first_difference, a, b)
    assert of("a\nb\nc", "a\n  x\nc") == "- b\n+ x"
    assert of("a", "a\nnew") == "+ new" and of("a\nold", "a\n") == "- old"
    assert of("a\n", "a") is None and of("", "") is None and of("", "\nx") is None
    assert of("x = 1", 'token = "abcdefgh12345"') == '- x = 1\n+ token = "[REDACTED:generic_secret]"'
    long = of("", "y" * 400)
    assert len(long) == 2 + 160 and long.endswith("...")
    parts = ingest.split_excerpt(F.lit("- old\n+ new\n+ more"))
    assert tuple(spark.range(1).select(parts["removed"], parts["added"]).first()) == ("old", "new")


def test_redacted_tails(spark):
    tail = lambda s: one(spark, lambda c: ingest.redact_tail(c, 100, 50), s)
    assert tail("short") == "short"
    text = "word " * 100
    assert tail(text) == text[-100:]
    key = "ghp_" + "a1B2" * 10
    texts = [("x" * 20 + " " + "y z " * 30 + "\n" + key + "\n" + "k " * (shift // 2),) for shift in range(0, 160, 7)]
    for (got,) in spark.createDataFrame(texts, "a string").select(ingest.redact_tail(F.col("a"), 100, 50)).collect():
        assert "a1B2a1B2" not in got and len(got.encode()) <= 100
    assert len(tail("é" * 300).encode()) <= 100


def plain_budget(p, limit):
    for _ in range(24):
        size = len(json.dumps({k: v for k, v in p.items() if v is not None}, separators=(",", ":"), ensure_ascii=False).encode())
        fields = [n for n in ingest.CUTTABLE if p.get(n) is not None]
        if size <= limit or not fields:
            return p
        name = max(fields, key=lambda n: len(p[n].encode()))
        raw = p[name].encode()
        keep = max(len(raw) - max(size - limit, len(raw) // 4, 64), 0)
        p = p | {name: (raw[len(raw) - keep :].decode(errors="ignore") if keep else "") or None}
    return p


def test_payload_budget(spark):
    rng = random.Random(5)
    rows = [tuple("".join(rng.choice("abcé ") for _ in range(rng.choice([0, 10, 300, 3000]))) or None for _ in range(4)) for _ in range(40)]
    names = ["path", "stdout_tail", "error", "prompt"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    fields = {n: F.col(n) for n in names} | {"path": F.substring("path", 1, 50)}
    got = df.select(ingest.within_budget(fields, 1000).alias("p")).select("p.*").collect()
    for row, mine in zip(rows, got, strict=True):
        p = dict(zip(names, row, strict=True)) | {"path": row[0][:50] if row[0] else None}
        assert mine.asDict() == plain_budget(p, 1000)


def test_rules_and_middles(spark):
    assert one(spark, tx.compact_rules, "===== FAILURES =====") == "=== FAILURES ===" and one(spark, tx.compact_rules, "a -- b") == "a -- b"
    assert one(spark, tx.compact_rules, "---- === ~~") is None and one(spark, tx.compact_rules, "") is None
    middle = lambda s, n: one(spark, lambda c: tx.truncate_middle(c, n), s)
    assert middle("x" * 100, 20) == "x" * 17 + "..." and middle("abc", 24) == "abc"
    text = "first words of a long preamble that goes on and on until the final request"
    got = middle(text, 40)
    assert len(got) <= 40 and got.startswith("first words") and got.endswith("the final request") and " ... " in got
    assert one(spark, lambda c: tx.suffix_bytes(c, F.lit(3)), "aéé") == "é" and one(spark, lambda c: tx.suffix_bytes(c, 0), "a") == ""


def test_spool_round_trip_and_files(spark, tmp_path):
    rows = [(i, f"k{i}", "s1", "p", None, "Stop", None, None, 1000 + i, p) for i, p in enumerate(['{}', '{"source":"x"}', '{"spooled":false,"prompt":"a } b"}', None, '{"git":{"spooled":false,"n":1.50},"spooled":1,"x":[1,"}",null]}', "[1]"])]
    ledger.write_spool(spark.createDataFrame(rows, ledger.EVENT), str(tmp_path / "spool"))
    assert len(list((tmp_path / "spool").glob("part-*"))) == 6
    events, bad = ledger.read_spool(spark, str(tmp_path / "spool"))
    got = {r["dedupe_key"]: (r["ts_ms"], json.loads(r["payload"])) for r in events.collect()}
    assert bad.count() == 0 and got == {"k0": (1000, {"spooled": True}), "k1": (1001, {"spooled": True, "source": "x"}), "k2": (1002, {"spooled": True, "prompt": "a } b"}), "k3": (1003, {"spooled": True}), "k4": (1004, {"spooled": True, "git": {"spooled": False, "n": 1.5}, "x": [1, "}", None]}), "k5": (1005, {"spooled": True})}

    staged = tmp_path / "staged"
    staged.mkdir()
    for name, body in (("r-1.json", '{"session_id":"a","v":1}'), ("r-12.json", '{"session_id":"a","v":2}'), ("r-13.json", '{"session_id":'), ("r-3.json", '{"session_id":"b","v":3}')):
        (staged / name).write_text(body)
    newest = {r["session_id"]: (r["generation"], json.loads(r["record"])["v"]) for r in ledger.read_staged(spark, str(staged)).collect()}
    assert newest == {"a": (12, 2), "b": (3, 3)}

    (tmp_path / "rows.jsonl").write_text('{"a":1}\n\n{"a":\n[1]\n{"a":2,"b":"x"}\n')
    good, bad = ledger.read_json_lines(spark, str(tmp_path / "rows.jsonl"), "a int, b string")
    assert sorted((r["a"], r["b"]) for r in good.collect()) == [(1, None), (2, "x")] and sorted(r["value"] for r in bad.collect()) == ['[1]', '{"a":']

    ledger.write_documents(good, str(tmp_path / "out"))
    assert sorted(json.loads(r["value"])["a"] for r in spark.read.text(str(tmp_path / "out")).collect()) == [1, 2]


def test_deliveries_are_made_once(spark, tmp_path):
    sent = []
    run = ck.deliver_batch(lambda df: sent.extend(r["id"] for r in df.orderBy("id").collect()), str(tmp_path / "injections"))
    batch = lambda rows: spark.createDataFrame(rows, "delivery_key string, id long")
    run(batch([("a", 1), ("a", 2), ("b", 3)]), 0)
    run(batch([("b", 4), ("c", 5)]), 1)
    assert sent == [1, 3, 5]


def test_ordering_tail(spark):
    rng = random.Random(3)
    for _ in range(5):
        rows = [("s", i, rng.randrange(20), rng.random() < 0.4) for i in range(rng.randrange(1, 9))]
        tail = ck.ordering_tail(spark.createDataFrame(rows, "session_id string, id long, ts_ms long, spooled boolean")).first()
        direct, late = None, None
        for _, _, ts, spooled in rows:
            direct, late = (direct, ts if late is None else max(late, ts)) if spooled else (ts, None)
        assert (tail["last_direct_ts"], tail["max_spooled_ts_since"]) == (direct, late)


def plain_statuses(runs):
    acc = []
    for r in sorted(runs, key=lambda r: (r["ts_ms"], r["event_id"])):
        def weight(test, r=r):
            file = test.split("::")[0]
            hit = [n for n in r["names"] if test == n or file == n or test.startswith(n + "::") or file.startswith(n + "/")]
            return (2 if any(len(n) >= len(file) for n in hit) else 1) if hit or not r["names"] else 0
        if r["outcome"] == "FAIL":
            for t in r["failed"]:
                a = next((a for a in acc if a["test_id"] == t), None)
                if a is None:
                    a = {"test_id": t, "focus": 0, "first": len(acc)}
                    acc.append(a)
                a |= {"passed_by": None, "last": r["ts_ms"], "focus": a["focus"] + max(weight(t), 1)}
        elif r["outcome"] == "PASS":
            for a in acc:
                if w := weight(a["test_id"]):
                    a |= {"passed_by": r["event_id"], "focus": a["focus"] + w}
    acc.sort(key=lambda a: (-a["focus"], a["passed_by"] is not None, -a["last"], a["first"]))
    return [(a["test_id"], a["focus"], a["passed_by"]) for a in acc[:6]]


def test_states_of_tests(spark):
    rng = random.Random(11)
    tests = [f"{d}/t{i}.py::test_{x}" for d in ("a", "a/b") for i in range(2) for x in "xy"]
    names = ["a", "a/b", "a/t0.py", "a/b/t1.py", "a/t0.py::test_x"]
    runs = []
    for i in range(60):
        fail = rng.random() < 0.5
        runs.append({"session_id": f"s{i % 2}", "epoch": 1, "event_id": i, "ts_ms": i // 2, "runner": "pytest", "outcome": "FAIL" if fail else rng.choice(["PASS", "UNKNOWN"]),
                     "names": rng.sample(names, rng.randrange(3)), "failed": rng.sample(tests, 2) if fail else []})
    df = spark.createDataFrame(runs, "session_id string, epoch int, event_id long, ts_ms long, runner string, outcome string, names array<string>, failed array<string>")
    got = ck.test_statuses(df).orderBy("session_id", "rank").collect()
    for s in ("s0", "s1"):
        assert [(r["test_id"], r["focus"], r["passed_by"]) for r in got if r["session_id"] == s] == plain_statuses([r for r in runs if r["session_id"] == s])


def test_hooks_are_stored_redacted(spark, tmp_path):
    key = "ghp_" + "a1B2" * 10
    rows = [{"session_id": "s", "hook_event_name": "UserPromptSubmit", "prompt": f"use {key} now"},
            {"session_id": "s", "hook_event_name": "PostToolUse", "tool_name": "Bash", "tool_input": {"command": f"run {key}"}, "tool_response": {"stdout": key, "stderr": f"no {key}"}, "error": f"Exit code 3 {key}"},
            {"session_id": "s", "hook_event_name": "UserPromptSubmit", "prompt": "plain"}]
    (tmp_path / "hooks.jsonl").write_text("\n".join(map(json.dumps, rows)))
    got = [json.loads(r["payload"]) for r in ledger.read_hooks(spark, str(tmp_path / "hooks.jsonl")).collect()]
    assert not any("a1B2" in json.dumps(p) for p in got)
    assert [p.get("prompt") for p in got] == ["use [REDACTED:github_token] now", None, "plain"] and got[1]["exit_code"] == 3
    assert got[1]["command"] == "run [REDACTED:github_token]" and got[1]["stdout_tail"] == "[REDACTED:github_token]"


def test_a_hook_of_any_size_gives_a_bounded_payload(spark, tmp_path):
    key = "ghp_" + "a1B2" * 10
    size = 8 << 20
    out = ("line of output\n" * (size // 15))[: size - 60] + key + "\nlast line"
    rows = [
        {"session_id": "s", "hook_event_name": "PostToolUse", "tool_name": "Bash", "tool_input": {"command": "run " + "x" * 100_000}, "tool_response": {"stdout": out, "stderr": out}},
        {"session_id": "s", "hook_event_name": "PostCompact", "compact_summary": "é" * 100_000},
        {"session_id": "s", "hook_event_name": "PostToolUse", "tool_name": "Edit", "tool_input": {"file_path": "a", "old_string": "a\nb", "new_string": "a\n" + key}},
        {"session_id": "s", "hook_event_name": "PostToolUse", "tool_name": "MultiEdit", "tool_input": {"file_path": "a", "edits": [{"old_string": "x", "new_string": "y"}, {"old_string": "p", "new_string": "q"}]}},
        {"session_id": "s", "hook_event_name": "PostToolUse", "tool_name": "Write", "tool_input": {"file_path": "a", "content": "new", "old_string": "x"}},
    ]
    (tmp_path / "hooks.jsonl").write_text("\n".join(map(json.dumps, rows)))
    got = [r["payload"] for r in ledger.read_hooks(spark, str(tmp_path / "hooks.jsonl")).collect()]
    told = [json.loads(p) for p in got]
    assert len(got[0].encode()) <= 16 * 1024 and 40_000 > len(got[1].encode()) > 30_000 and not any("a1B2" in p for p in got)
    assert told[0]["stderr_tail"].endswith("[REDACTED:github_token]\nlast line") and told[0]["stdout_tail"].endswith("last line") and told[0]["command"].startswith("run xx")
    assert [p.get("excerpt") for p in told[2:]] == ["- b\n+ [REDACTED:github_token]", "- x\n+ y", None]


def test_heads_read_no_more_than_they_need(spark, tmp_path):
    first = b'{"type":"user","cwd":"/w","message":{"content":"do it"}}\n'
    with open(tmp_path / "big.jsonl", "wb") as f:
        f.write(first + b'{"type":"ai-title","aiTitle":"' + b"x" * 300_000)
        f.truncate(40 << 30)  # a sparse file that no task could hold
    (tmp_path / "small.jsonl").write_bytes(first)
    (tmp_path / "other.txt").write_bytes(first)
    heads = {r["path"].rsplit("/", 1)[1]: (r["bytes"], len(r["head"])) for r in read_heads(spark, str(tmp_path), 1000, ".jsonl").collect()}
    assert heads == {"big.jsonl": (40 << 30, 1000), "small.jsonl": (len(first), len(first))}
    got = {r.session_id: (r.title, r.cwd, r.bytes) for r in ledger.read_transcripts(spark, str(tmp_path)).collect()}
    assert got == {"big": ("do it", "/w", 40 << 30), "small": ("do it", "/w", len(first))}
    assert ledger.read_transcripts(spark, str(tmp_path / "none")).count() == 0


def test_a_spooled_file_that_is_still_written_waits(spark, tmp_path):
    spool, out = tmp_path / "spool", str(tmp_path / "out")
    spool.mkdir()
    event = json.dumps({"session_id": "a", "hook_event": "Stop", "ts_ms": 5, "dedupe_key": "k", "payload": {"spooled": True}})
    read = lambda name: sorted(r["file"].rsplit("/", 1)[1] for r in spark.read.parquet(f"{out}/{name}").collect())

    def go(now):
        query = ledger.stream_spool(spark, str(spool), out, str(tmp_path / "ck"), now_ms=F.lit(now))
        assert query.awaitTermination(120)

    (spool / "1.jsonl").write_text(event)
    (spool / "2.jsonl").write_text(event[:30])  # completed later
    (spool / "3.jsonl").write_text('{"session_id": "a", "payload": "text"}')  # whole, but no event
    (spool / "4.jsonl").write_text("half {")  # never completed
    now = int(os.stat(spool / "4.jsonl").st_mtime * 1000)
    go(now)
    assert read("events") == ["1.jsonl"] and read("quarantine") == ["3.jsonl"]
    (spool / "2.jsonl").write_text(event)
    (spool / "5.jsonl").write_text(event)
    go(now + 1000)
    assert read("events") == ["1.jsonl", "2.jsonl", "5.jsonl"] and read("quarantine") == ["3.jsonl"]
    (spool / "6.jsonl").write_text(event)
    go(now + 60_000)
    assert read("events") == ["1.jsonl", "2.jsonl", "5.jsonl", "6.jsonl"] and read("quarantine") == ["3.jsonl", "4.jsonl"]
