"""Continuations by channel: single cases, the stream against the batch fold for any split and after restarts, and timers."""

import random
import time

from pyspark.sql import functions as F

from tracefold.operators import delivery
from tracefold.operators.delivery import WEEK_MS, Fold

STEPS = "session_id string, id bigint, ts_ms bigint, op string, late boolean"


def fold(*steps):
    """Last states by checkpoint, of (id, ts, op[, late]) steps of one session."""
    f, out = Fold(), {}
    for s in steps:
        for c in f.step(s[0], s[1], s[2], len(s) > 3):
            out[c["checkpoint_id"]] = (c["state"], c["attach_count"], c["attached_channel"], c["updated_ms"])
    return out


def test_every_channel_delivers_a_pending_checkpoint_once():
    for op in ("session_start", "post_tool", "user_prompt"):
        assert fold((1, 10, "checkpoint"), (2, 20, op)) == {1: ("ATTACHED", 1, op, 20)}
    assert fold((1, 10, "checkpoint"), (2, 20, "failure"), (3, 30, "stop")) == {1: ("PENDING", 0, None, 10)}
    # four resumes: what a session start wrote stays in the conversation and is not written again
    assert fold((1, 10, "checkpoint"), *((k, 10 * k, "session_start") for k in range(2, 6))) == {1: ("ATTACHED", 1, "session_start", 20)}
    assert fold((1, 10, "checkpoint"), (2, 20, "session_start"), (3, 30, "user_prompt")) == {1: ("ATTACHED", 1, "session_start", 20)}
    assert fold((1, 10, "checkpoint"), (2, 20, "user_prompt"), (3, 30, "session_start")) == {1: ("ATTACHED", 1, "user_prompt", 20)}


def test_a_tool_call_of_before_the_checkpoint_does_not_deliver():
    assert fold((1, 10, "checkpoint"), (2, 10, "post_tool")) == {1: ("PENDING", 0, None, 10)}
    assert fold((1, 10, "checkpoint"), (2, 11, "post_tool")) == {1: ("ATTACHED", 1, "post_tool", 11)}


def test_prompts_write_again_up_to_the_cap():
    say = [(k, 10 * k, "user_prompt") for k in range(2, 7)]
    assert [fold((1, 10, "checkpoint"), *say[:n])[1][:2] for n in range(1, 6)] == [("ATTACHED", 1), ("ATTACHED", 2), ("ATTACHED", 3), ("EXPIRED", 3), ("EXPIRED", 3)]
    assert fold((1, 10, "checkpoint"), *say[:2], (9, 31, "stop"), *say[2:])[1] == ("CONFIRMED", 2, "user_prompt", 31)


def test_evidence():
    assert fold((1, 10, "checkpoint"), (2, 20, "session_start"), (3, 20, "post_tool"))[1][0] == "ATTACHED"
    for op in ("post_tool", "failure", "stop"):
        assert fold((1, 10, "checkpoint"), (2, 20, "session_start"), (3, 25, op), (4, 30, op))[1] == ("CONFIRMED", 1, "session_start", 25)
    # late evidence is seen by the next direct step; the earliest counts
    late = [(1, 10, "checkpoint"), (2, 20, "user_prompt"), (3, 27, "stop", True), (4, 23, "post_tool", True)]
    assert fold(*late)[1][0] == "ATTACHED" and fold(*late, (5, 40, "user_prompt"))[1] == ("CONFIRMED", 1, "user_prompt", 23)


def test_age():
    last = 10 + WEEK_MS
    for op in ("session_start", "post_tool", "user_prompt"):
        assert fold((1, 10, "checkpoint"), (2, last, op))[1][0] == "ATTACHED"
        assert fold((1, 10, "checkpoint"), (2, last + 5, op))[1] == ("EXPIRED", 0, None, last + 1)
    assert fold((1, 10, "checkpoint"), (2, last + 5, "stop"))[1][0] == "EXPIRED"
    assert fold((1, 10, "checkpoint"), (2, 20, "user_prompt"), (3, last + 5, "user_prompt"))[1] == ("EXPIRED", 1, "user_prompt", last + 5)
    assert fold((1, 10, "checkpoint"), (2, 20, "user_prompt"), (3, last + 5, "stop"))[1][0] == "CONFIRMED"


def test_supersede_expire_and_late_checkpoints():
    assert fold((1, 10, "checkpoint"), (2, 20, "checkpoint"), (3, 30, "expire")) == {1: ("SUPERSEDED", 0, None, 20), 2: ("EXPIRED", 0, None, 30)}
    assert fold((1, 10, "checkpoint"), (2, 15, "checkpoint", True)) == {1: ("SUPERSEDED", 0, None, 15), 2: ("PENDING", 0, None, 15)}
    assert fold((1, 10, "checkpoint"), (2, 5, "checkpoint", True)) == {1: ("PENDING", 0, None, 10)}
    assert fold((1, 10, "expire"), (2, 5, "checkpoint", True)) == {}
    assert fold((1, 10, "session_start"), (2, 20, "user_prompt"), (3, 30, "stop")) == {}


def test_as_of(spark):
    df = spark.createDataFrame([("s", 1, 10, "checkpoint", False), ("t", 2, 10, "checkpoint", False), ("t", 3, 20, "user_prompt", False)], STEPS)
    state = lambda at: {r.session_id: (r.state, r.updated_ms) for r in delivery.continuations(df, at).collect()}
    assert state(None) == state(10 + WEEK_MS) == {"s": ("PENDING", 10), "t": ("ATTACHED", 20)}
    assert state(11 + WEEK_MS) == {"s": ("EXPIRED", 11 + WEEK_MS), "t": ("ATTACHED", 20)}
    assert delivery.continuations(df.where("false")).count() == 0


def run_stream(spark, base, rows):
    """Reads so many new rows, one file a batch, and stops; what a batch writes replaces what a lost run of it wrote.

    Timers of the wall clock keep a query going, so it is stopped here once it has read what is there.
    """
    steps = spark.readStream.schema(STEPS).option("maxFilesPerTrigger", 1).json(f"{base}/in")
    write = lambda df, n: df.write.mode("overwrite").parquet(f"{base}/out/batch={n}")
    query = delivery.streamed(steps).writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/ck").trigger(processingTime="0 seconds").start()
    try:
        end = time.time() + 60
        while sum(p.numInputRows for p in query.recentProgress) < rows:
            assert time.time() < end and query.isActive, query.exception()
            time.sleep(0.2)
    finally:
        query.stop()
    return sorted(map(str, delivery.latest(spark.read.parquet(f"{base}/out")).collect()))


def test_stream_equals_batch_for_any_split_and_after_restarts(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng, now = random.Random(6), int(time.time() * 1000)
    ops = ["checkpoint", "checkpoint", "user_prompt", "user_prompt", "session_start", "post_tool", "failure", "stop", "expire"]
    rows = []
    for i in range(160):  # ten days of a step every hour and a half, up to now
        rows.append((f"s{rng.randrange(4)}", i, now - (160 - i) * 5_400_000 - rng.randrange(20_000_000), rng.choice(ops), rng.random() < 0.2))
    rows.append(("quiet", 900, now - 3 * WEEK_MS, "checkpoint", False))
    rows.sort(key=lambda r: r[1])
    want = sorted(map(str, delivery.continuations(spark.createDataFrame(rows, STEPS), now).collect()))
    assert "EXPIRED" in str(want) and "CONFIRMED" in str(want) and "SUPERSEDED" in str(want)
    for seed, cuts in ((0, [60, 120]), (1, sorted(rng.sample(range(1, 160), 2)))):
        base, new = tmp_path / str(seed), 0
        (base / "in").mkdir(parents=True)
        for k, (lo, hi) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True)):
            spark.createDataFrame(rows[lo:hi], STEPS).coalesce(1).write.mode("append").json(str(base / "in"))
            new += hi - lo
            if seed or k == len(cuts):  # one run over all files, or a restart after each
                run_stream(spark, base, new)
                new = 0
        spark.createDataFrame([("other", 1000, now, "stop", False)], STEPS).write.mode("append").json(str(base / "in"))
        assert run_stream(spark, base, 1) == want  # what is too old has expired by then


def test_a_timer_expires_what_nothing_follows_and_a_step_of_before_goes_on(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    now = int(time.time() * 1000)
    made = now - WEEK_MS - 60_000
    put = lambda *rows: spark.createDataFrame(rows, STEPS).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    go = lambda: run_stream(spark, tmp_path, 1)
    put(("s", 1, made, "checkpoint", False))
    go()
    put(("other", 2, now, "stop", False))
    go()
    (row,) = delivery.latest(spark.read.parquet(str(tmp_path / "out"))).collect()
    assert (row.state, row.updated_ms) == ("EXPIRED", made + WEEK_MS + 1)
    put(("s", 3, made + 1000, "session_start", False))  # it arrives after the timer, but is of before
    go()
    (row,) = delivery.latest(spark.read.parquet(str(tmp_path / "out"))).collect()
    assert (row.state, row.attach_count, row.attached_ms) == ("ATTACHED", 1, made + 1000)
    assert spark.read.parquet(str(tmp_path / "out")).where(F.col("by_timer")).count() == 1
