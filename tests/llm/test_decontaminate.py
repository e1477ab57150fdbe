import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tierloom.llm import decontaminate as d

BENCH = "item_id string, text string, word string, words string"


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def plain(docs, items):
    out = []
    for i, t in docs:
        w, hit, ids = words(t), set(), set()
        for name, text in items:
            v = words(text)
            if not v:
                continue
            n = min(len(v), 10)
            for a in range(len(v) - n + 1):
                for s in range(len(w) - n + 1):
                    if w[s : s + n] == v[a : a + n]:
                        hit |= set(range(s, s + n))
                        ids.add("" if name is None else str(name))
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()))
    return sorted(out, key=str)


def made(seed=1):
    r = random.Random(seed)
    vocabulary = ["a", "b", "cc", "Dé", "eee", "f1"] + [f"w{i}" for i in range(30)]
    items = [(str(i), " ".join(r.choices(vocabulary, k=r.choice([1, 3, 9, 10, 11, 25])))) for i in range(12)]
    items += [("2", "dup id other words here"), ("x", None), ("y", " .,"), ("z", items[0][1]), (None, "null item words")]
    docs = []
    for i in range(60):
        w = r.choices(vocabulary, k=r.randrange(40))
        for _ in range(r.randrange(3)):
            v = words(r.choice(items)[1])
            at = r.randrange(len(w) + 1)
            w[at:at] = v[r.randrange(3) :]
        docs.append((i, ", ".join(w).upper() if i % 2 else " ".join(w)))
    return docs, items


def found(spark, frame, docs, items):
    bench = spark.createDataFrame([(a, b, "x", "y") for a, b in items], BENCH)
    table = frame(docs)
    got = d.scan(table, bench).select(*d.KEY, "n_hit", "items")
    own = table.select("doc_id", *d.row_key("doc_id", "text"), F.size(d.alnum_words(F.col("text"))).alias("n")).join(got, d.KEY, "left")
    return sorted(
        ((r.doc_id, r.n, r.n_hit or 0, len(r["items"] or []), hashlib.sha256(",".join(r["items"] or []).encode()).hexdigest()) for r in own.collect()), key=str
    )


@pytest.mark.parametrize("small", [True, False])
def test_equals_brute_force(spark, frame, edge, monkeypatch, small):
    if not small:
        monkeypatch.setattr(d, "BROADCAST_ROWS", 0)
    docs, items = made()
    docs += edge
    assert found(spark, frame, docs, items) == plain(docs, items)


def test_clean_keeps_rows_and_columns(spark, frame, edge):
    docs = [*edge, (100, "one two three four five six seven eight nine ten"), (101, "one two three")]
    bench = spark.createDataFrame([("1", "One, two; three four five six seven eight nine TEN eleven", "", "")], BENCH)
    table = frame(docs)
    kept = d.clean(table, bench)
    assert kept.columns == table.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((i for i, _ in docs if i != 100), key=str)


def test_empty_tables(spark, frame):
    none = spark.createDataFrame([], BENCH)
    assert d.clean(frame([]), none).count() == 0
    assert d.clean(frame([(1, "a")]), none).count() == 1


def test_query_without_ansi_counts_no_items_of_clean_documents(spark):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        got = d.op9_decontaminate(spark, "/root/testdata/sf0.001").collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)
    assert {r.n_items for r in got if not r.contaminated} == {0} and all(r.n_items > 0 for r in got if r.contaminated)


@pytest.mark.parametrize("small", [True, False])
def test_small_windows_are_written_in_few_files(spark, frame, monkeypatch, small):
    if not small:
        monkeypatch.setattr(d, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(d, "BROADCAST_BYTES", 0)
    files, settle = {}, d.settle

    def watched(df, name, *how):
        out = settle(df, name, *how)
        files[name] = len(out.inputFiles())
        return out

    monkeypatch.setattr(d, "settle", watched)
    docs, items = made()
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        assert found(spark, frame, docs, items) == plain(docs, items)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert set(files) == {"windows", "prefixes"}
    assert all((n <= d.FILES) == small for n in files.values())
