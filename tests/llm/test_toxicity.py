import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa

from tierloom.llm import common
from tierloom.llm import toxicity as t

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=600, seed=1):
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("abcdefghij", k=r.randrange(3, 9))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        w = r.choices(vocabulary, k=r.randrange(5, 80))
        if bad:
            for _ in range(2):
                w[r.randrange(len(w))] = r.choice(["idiot", "scum", "lowei" + r.choice(vocabulary)])
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    return docs, labels


def test_held_out_accuracy(spark, frame, edge):
    docs, labels = corpus()
    table = frame(docs + [(10_000 + (i or 0), x) for i, x in edge])
    known = spark.createDataFrame(labels + [(None, 1, 1), (3, 1, None), (77_777, 1, 1)], LABELS)
    model = t.train(table, known)
    score = {r.id: r.score for r in t.score(table, model).collect()}
    held = [(score[i], y) for i, _, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    pos, neg = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([p > q for p in pos for q in neg]) > 0.95
    assert np.mean([(s >= 0.5) == y for s, y in held]) > 0.95
    assert all(0 <= s <= 1 for s in score.values()) and len(score) == len(docs) + len({10_000 + (i or 0) for i, _ in edge})


def test_held_out_labels_are_not_used(spark, frame):
    docs, labels = corpus(200)
    turned = [(i, q, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, q, y in labels]
    a, b = (t.train(frame(docs), spark.createDataFrame(x, LABELS)) for x in (labels, turned))
    assert a.weights == b.weights and a.bias == b.bias


def test_counterfactuals_reduce_false_positives_on_group_mentions():
    r = random.Random(5)
    vocabulary = [f"word{i}" for i in range(200)]
    rows, y = [], []
    for i in range(1200):  # toxic texts often name one group, neutral ones another
        bad = i % 3 == 0
        w = set(r.choices(vocabulary, k=12)) | ({"muslim"} if r.random() < (0.7 if bad else 0.05) else {"christian"} if r.random() < 0.5 else set())
        rows.append(w | ({r.choice(["idiot", "scum"])} if bad and r.random() < 0.8 else set()))
        y.append(int(bad))
    pairs = [(t.features(w), t.features(s)) for w in rows for s in t.swaps(w)]
    features = [t.features(w) for w in rows]
    plain, fair = t.fit(features, y), t.fit(features, y, pairs, fairness=20.0)
    neutral = [set(r.choices(vocabulary, k=12)) | {"muslim"} for _ in range(300)]
    wrong = [sum(m.logit(w) >= 0 for w in neutral) for m in (plain, fair)]
    assert wrong[1] < wrong[0] / 2
    assert abs(fair.logit({"muslim"}) - fair.logit({"christian"})) < abs(plain.logit({"muslim"}) - plain.logit({"christian"})) / 2
    toxic = [set(r.choices(vocabulary, k=12)) | {"idiot"} for _ in range(300)]
    assert sum(fair.logit(w) >= 0 for w in toxic) > 250


def test_the_shipped_penalty_acts_through_train(spark, frame):
    r = random.Random(9)
    vocabulary = [f"word{i}" for i in range(200)]
    docs, labels = [], []
    for i in range(1500):  # in each language toxic texts often name one group, neutral ones another
        bad = i % 3 == 0
        one, other = r.choice([("muslim", "christian"), ("femmes", "hommes"), ("chino", "europeo"), ("araber", "inder")])
        w = r.choices(vocabulary, k=12) + ([one] if r.random() < (0.7 if bad else 0.05) else [other] if r.random() < 0.5 else [])
        docs.append((i, " ".join(w + ([r.choice(["idiot", "scum"])] if bad and r.random() < 0.8 else []))))
        labels.append((i, 1, int(bad)))
    known = spark.createDataFrame(labels, LABELS)
    plain, fair = (t.train(frame(docs), known, fairness=x) for x in (0.0, t.FAIRNESS))
    assert fair.pairs > 500
    wrong = []
    for m in (plain, fair):
        neutral = [set(r.choices(vocabulary, k=12)) | {name} for name in ("muslim", "femmes", "chino", "araber") for _ in range(200)]
        wrong.append(sum(m.logit(w) >= 0 for w in neutral))
    assert wrong[0] > 100 and wrong[1] < wrong[0] / 2
    for a, b in (("muslim", "christian"), ("femmes", "hommes"), ("chino", "europeo"), ("araber", "inder")):
        assert abs(fair.logit({a}) - fair.logit({b})) < abs(plain.logit({a}) - plain.logit({b})) / 2
    toxic = [set(r.choices(vocabulary, k=12)) | {"idiot"} for _ in range(300)]
    assert sum(fair.logit(w) >= 0 for w in toxic) > 250


def test_names_stand_in_one_kind_alone():
    names = [w for kind in t.IDENTITIES for w in kind]
    assert len(names) == len(set(names)) and all(w == w.lower() for w in names)


def test_swaps():
    assert t.swaps({"a", "b"}) == []
    assert {"a", "people"} in t.swaps({"a", "women"}) and len(t.swaps({"women"})) == 3


def test_clean_and_degenerate_labels(spark, frame, edge):
    docs, labels = corpus(200)
    table = frame(docs + [(None, "a null id"), (5000, None)])
    kept = t.clean(table, spark.createDataFrame(labels, LABELS))
    assert kept.columns == table.columns
    ids = {r.doc_id for r in kept.collect()}
    assert None in ids and 5000 in ids and len(ids & {i for i, _, y in labels if not y}) >= 155 and len(ids & {i for i, _, y in labels if y}) <= 6
    none = spark.createDataFrame([], LABELS)
    assert t.train(table, none).score(b"x") == 0.5
    assert t.clean(frame([]), none).count() == 0
    assert t.train(table, spark.createDataFrame([(i, q, 0) for i, q, _ in labels], LABELS)).score(b"idiot") < 0.01
    assert t.clean(frame([]), spark.createDataFrame(labels, LABELS)).count() == 0


def test_query_on_given_documents(spark):
    """op6_toxicity on whole given tables: contract columns and held-out accuracy."""
    found = t.op6_toxicity(spark, "/root/testdata/sf0.01")
    assert found.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = found.collect()
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([p == y for p, y in held]) > 0.95


def test_features_of_a_large_batch_take_little_memory_at_once(monkeypatch):
    r = random.Random(7)
    texts = [" ".join(f"word{r.randrange(50_000)}" for _ in range(300)) for _ in range(1500)]
    batch = pa.RecordBatch.from_arrays([pa.array([0, 1] * 750, pa.int32()), pa.array(texts)], names=["label", "text"])

    def run():
        tracemalloc.start()
        out = [row for b in t.featured(iter([batch])) for row in zip(b.column(0).to_pylist(), [hash(tuple(x.as_py())) for x in b.column(1)], strict=True)]
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return out, peak

    own, little = run()
    monkeypatch.setattr(common, "SLICE", len(texts))  # the whole batch at once, as before
    whole, much = run()
    assert own == whole and len(own) == len(texts)
    assert little < 30e6 < much
