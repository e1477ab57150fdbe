import random
import zlib

import numpy as np

from tierloom.llm import quality as q

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=500, seed=1):
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("abcdefghij", k=r.randrange(2, 9))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        w = r.choices(vocabulary, k=r.randrange(20, 200))
        bad = i % 6 == 0
        if bad:
            w = [x + "%%%" for x in w] if i % 4 == 0 else [x.upper() + "!!" for x in w] if i % 4 == 1 else [w[0]] * len(w)
        docs.append((i, " ".join(w) + "."))
        labels.append((i, int(not bad), 0))
    return docs, labels


def test_held_out_accuracy(spark, frame, edge):
    docs, labels = corpus()
    table = frame(docs + [(10_000 + (i or 0), x) for i, x in edge])
    known = spark.createDataFrame(labels + [(None, 1, 1), (3, None, 1), (77_777, 0, 1)], LABELS)
    score = {r.id: r.score for r in q.score(table, known).collect()}
    held = [(score[i], y) for i, y, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([a > b for a, x in held if x for b, y in held if not y]) > 0.97
    assert np.mean([(s >= 0.3) == y for s, y in held]) > 0.95
    assert all(0 <= s <= 1 for s in score.values())


def test_normal_equations_are_the_sums(spark, frame):
    docs, labels = corpus(120)
    stats = q.all_statistics(frame(docs), "doc_id", "text")
    rows = q.settle(q.train_rows(stats, spark.createDataFrame(labels, LABELS), "doc_id", "quality"), "t")
    own = rows.collect()
    x, y = np.array([r.stats for r in own]), np.array([r.label for r in own], float)
    waves = q.Waves(x.mean(0), np.where(x.std(0) > 0, x.std(0), 1))
    a, b, n = q.normal_equations(rows, waves)
    z = waves(x)
    assert n == len(own) and np.allclose(a, z.T @ z) and np.allclose(b, z.T @ y)
    a, b, n = q.normal_equations(rows.repartition(23), waves)  # groups of several partitions
    assert n == len(own) and np.allclose(a, z.T @ z) and np.allclose(b, z.T @ y)


def test_waves_approximate_a_gaussian_kernel():
    r = np.random.default_rng(1)
    x = r.normal(0, 1, (40, q.N_STATS)) * 0.5
    z = q.Waves(np.zeros(q.N_STATS), np.ones(q.N_STATS))(x)[:, : q.WAVES]
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    assert abs(z @ z.T - np.exp(-d / (2 * q.WIDTH**2))).mean() < 0.06


def test_isotonic():
    x, y, n = np.arange(6.0), np.array([0, 1, 0, 1, 1, 0.5]), np.array([1, 1, 1, 2, 2, 4.0])
    cx, cy = q.isotonic(x, y, n)
    assert (np.diff(cy) > 0).all() and np.isclose((np.interp(x, cx, cy)).min(), 0)


def test_no_labels_and_empty(spark, frame):
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in q.score(frame([(1, "a"), (2, None)]), none).collect()} == {0.5}
    assert q.score(frame([]), none).count() == 0
    some = spark.createDataFrame([(i, i % 2, 0) for i in range(20)], LABELS)
    assert q.score(frame([]), some).count() == 0
    assert q.score(frame([(1, "a"), (2, None)]), some).count() == 2


def test_query_on_given_documents(spark):
    """op10_quality on whole given tables: contract columns and held-out accuracy."""
    found = q.op10_quality(spark, "/root/testdata/sf0.01")
    assert found.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = found.collect()
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([p == y for p, y in held]) > 0.95
