"""The record of a session by hand, and what a restore stages."""

import hashlib
import json

from pyspark.sql import functions as F

from tracefold.operators import order, record
from tracefold.sources import ledger

A, B, C = "a" * 32, "b" * 32, "c" * 32


def hook(i, session, event, ts, tool=None, **payload):
    return (i, f"k{i}", session, "p", None, event, tool, f"t{i}", ts, json.dumps(payload))


def test_every_section_of_a_session(spark, tmp_path):
    say = lambda i, text: hook(i, "s", "UserPromptSubmit", i * 1000, prompt=text)
    edit = lambda i, path, before, after, old, new: hook(i, "s", "PostToolUse", i * 1000, "Edit", path=path, pre_hash=before, post_hash=after, excerpt=f"- {old}\n+ {new}")
    run = lambda i, command, **out: hook(i, "s", "PostToolUse" if "stdout_tail" in out else "PostToolUseFailure", i * 1000, "Bash", command=command, **out)
    place = [{"path": "src/b.py", "line": 12, "raw": "src/b.py:12"}]
    rows = [
        say(1, "task: rewrite the cache of src/a.py so that it forgets old keys"), say(2, "Rule: keep the public API stable. Caching the key in a global is a dead end."),
        edit(3, "src/a.py", A, B, "ttl = 1", "ttl = 2"), run(4, "pytest tests/t.py", stdout_tail="3 passed"), edit(5, "src/a.py", B, A, "ttl = 2", "ttl = 1"),
        edit(6, "src/b.py", A, C, "x", 'token = "abcdefghij123"'), hook(7, "s", "PostToolUse", 7000, "Read", path="src/c.py"), say(8, "look at parse_config in src/d.py first please"), say(9, "subtask: only the tests"), say(10, "and now go on"),
        run(11, "pytest tests/t.py", error="Exit code 1\nFAILED tests/t.py::test_x - boom\nE   assert 1 == 2 at src/b.py:12", mentioned=place),
        hook(12, "t", "PostToolUse", 12_000, "Read", path="only.py"),
    ]
    timeline = order.timeline(ledger.parsed(spark.createDataFrame(rows, ledger.EVENT)))
    timeline.write.parquet(str(tmp_path / "timeline"))
    got = {r.session_id: r for r in record.records(spark.read.schema(timeline.schema).parquet(str(tmp_path / "timeline"))).collect()}
    assert (got["s"].rung, got["s"].dropped, got["s"].trimmed) == (0, 0, False)
    by, section = {}, None
    for line in got["s"].capsule.split("\n"):
        if line.startswith("- "):
            by[section].append(line[2:])
        else:
            section = line.rstrip(":")
            by[section] = []
    assert by["first_message"] == ["rewrite the cache of src/a.py so that it forgets old keys"] and by["latest"] == ["and now go on"] and by["subtask"] == ["only the tests"]
    assert by["earlier"] == ["look at parse_config in src/d.py first please"]
    assert by["stated_constraints"] == ["Rule: keep the public API stable."] and by["rejected_approaches"] == ["Caching the key in a global is a dead end."]
    assert by["test_status"] == ["tests/t.py::test_x FAILING", "named in 2 runs"]
    assert by["test_result"][0] == "pytest tests/t.py FAIL" and any("assert 1 == 2" in x for x in by["test_result"][1:])
    assert by["reverted_edits"] == ["src/a.py inverse_edit", "replaced ttl = 1", "tried ttl = 2", "seen then: pytest tests/t.py PASS"]
    assert by["recent_edits"] == ["src/b.py"] and by["failure_location"] == ["src/b.py:12"] and "next_target" not in by
    assert by["file_activity"] == ["src/b.py (1 edits, 0 reads) in failure output", "src/a.py (2 edits, 0 reads)", "src/c.py (0 edits, 1 reads)"]
    assert by["workspace_state"] == ["workspace p until 1970-01-01T00:00:11Z"] and by["record_detail"] == ["epoch 2 of 11 events to 11"]
    assert list(by) == ["first_message", "stated_constraints", "rejected_approaches", "subtask", "earlier", "latest", "workspace_state", "test_status", "test_result", "reverted_edits", "recent_edits", "file_activity", "failure_location", "record_detail"]
    assert "only.py (0 edits, 1 reads)" in got["t"].capsule


def test_restores(spark):
    key = "ghp_" + "a1B2" * 10
    texts = spark.createDataFrame([("s", f"state {key}", 40), ("t", "plain", 3)], "session_id string, capsule string, tokens bigint")
    sessions = spark.createDataFrame([("s", "p", True), ("t", "p", True), ("u", "p", False), ("v", "p", True)], "session_id string, project_id string, has_state boolean")
    made = spark.createDataFrame([("s", 4, 10), ("s", 9, 20), ("s", 8, 20)], "session_id string, checkpoint_id bigint, created_ms bigint")
    asked = spark.createDataFrame([(1, "p", "s", 5), (2, "q", "s", 5), (3, "p", "u", 5), (4, "p", "t", 6), (5, "p", "none", 5), (6, "p", "v", 5)], "request_id bigint, workspace_id string, session_id string, now_ms bigint")
    got = {r.request_id: r for r in record.restored(asked, sessions, texts, made).collect()}
    assert [got[k].outcome for k in range(1, 7)] == ["STAGED", "UNKNOWN_SESSION", "NO_STATE", "STAGED", "UNKNOWN_SESSION", "NO_STATE"]
    one = got[1]
    assert one.capsule == "state [REDACTED:github_token]" and one.content_hash == hashlib.sha256(one.capsule.encode()).hexdigest()[:32]
    assert one.tokens < 40 and one.source_checkpoint_id == 9 and one.deliver_on == ["startup"] and got[4].tokens == 3 and got[4].source_checkpoint_id is None
    assert all(got[k].capsule is None and got[k].content_hash is None for k in (2, 3, 5, 6))
    assert record.restored(asked, sessions, texts, made).where(F.col("outcome") == "STAGED").count() == 2
