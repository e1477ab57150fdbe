import random

import corpus_pipeline as c


def test_stages_keep_their_promises(spark, tmp_path):
    r = random.Random(1)
    vocabulary = ["".join(r.choices("abcdefghij", k=r.randrange(3, 9))) for _ in range(2000)]
    text = lambda n: r.choices(vocabulary, k=n)
    rows, labels, toxic = [], [], set()
    for i in range(300):
        w = text(r.randrange(30, 150))
        if i % 6 == 0:
            w[3] = w[9] = "idiot"
            toxic.add(i)
        rows.append((i, " ".join(w), "en", f"s{i % 4}", 1))
        labels.append((i, 1, int(i in toxic)))
    clean = [i for i in range(300) if i not in toxic]
    item = " ".join(text(20))
    rows += [(1000, rows[1][1], "en", "s0", 1), (1001, rows[2][1] + " " + vocabulary[0], "en", "s1", 1), (1002, " ".join(text(30)) + " " + item, "en", "s2", 1), (1003, " ".join(text(60)) + " scum idiot", "en", "s3", 1)]
    rows += [(1004, None, "en", None, 0), (1005, "", None, "s1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    ids = []
    for name, stage in c.STAGES:
        out = c.settle(stage(spark, docs, str(tmp_path)), name)
        if name != "sharding":
            assert out.columns == docs.columns
        ids.append({x.doc_id for x in out.collect()})
        docs = out
    after_toxic, after_near, after_bench, mixed, sharded = ids
    assert after_toxic == set(clean) | {1000, 1001, 1002, 1004, 1005}
    assert after_near == set(clean) | {1002, 1004}
    assert after_bench == set(clean) | {1004}
    assert mixed <= set(clean) and sharded == mixed and len(mixed) > 200
    assert {x.shard for x in docs.collect()} <= set(range(16))
    assert c.run(spark, str(tmp_path)).count() == docs.count()
