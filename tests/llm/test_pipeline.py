"""The pipeline's stages on a small corpus with planted cases; each decision against a plain restatement."""

import random

import corpus_pipeline


def test_pipeline(spark, tmp_path):
    rng = random.Random(1)
    say = lambda n: " ".join(rng.choice(["the", "of", "to"] + [f"v{rng.randrange(4000)}"] * 3) for _ in range(n)) + "."
    rows, bad, copies, leaks, secret = [], set(), set(), set(), set()
    bench = [(k, say(40)) for k in range(8)]
    for i in range(240):
        text = say(rng.randrange(30, 150))
        if i % 6 == 0:
            text = " ".join(w + "!!" for w in text.upper().split())
            bad.add(i)
        elif i % 11 == 1 and i > 20:
            text = rows[i - 9][1] if (i - 9) not in bad and (i - 9) not in leaks else text
            if text == rows[i - 9][1]:
                copies.add(i)
        elif i % 13 == 2:
            text = f"{text} {bench[i % 8][1]} {say(20)}"
            leaks.add(i)
        elif i % 17 == 3:
            text = f"{text} password=hunter2hunter2 {say(5)}"
            secret.add(i)
        rows.append((i, text, "en", "big" if i % 2 else "small", len(text)))
    rows += [(1000, None, None, None, None)]
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i not in bad), 0) for i in range(0, 240)], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, d))
        seen[name] = docs
        if name != "mixing":
            assert docs.columns == columns
    ids = lambda name: {r.doc_id for r in seen[name].select("doc_id").collect()}
    assert bad.isdisjoint(ids("quality")) and len(set(range(240)) - bad - ids("quality")) <= 2
    assert ids("quality") - ids("near_duplicates") == copies & ids("quality")
    assert ids("near_duplicates") - ids("decontaminate") == leaks & ids("near_duplicates")
    clean = {r.doc_id: r for r in seen["secrets"].collect()}
    assert set(clean) == ids("decontaminate")
    for i in secret & set(clean):
        assert "[SECRET]" in clean[i].text and "hunter2" not in clean[i].text and clean[i].n_chars == len(clean[i].text)
    assert all(clean[i].text == rows[i][1] for i in set(clean) - secret if i < 240)
    assert ids("mixing") == set(clean) and {"epoch", "mix_key"} <= set(seen["mixing"].columns)


def test_pipeline_empty(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0
