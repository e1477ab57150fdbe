import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tierloom.llm import shard


def test_pack_balances_all_dimensions():
    r = np.random.default_rng(1)
    v = r.integers(1, 100, (2000, 3)).astype(float)
    s = shard.pack(v, 8)
    sums = np.array([v[s == k].sum(0) for k in range(8)])
    assert (abs(sums / sums.mean(0) - 1) < 0.01).all()
    assert shard.pack(np.zeros((0, 3)), 4).tolist() == []


def test_shards(frame, edge):
    r = random.Random(2)
    rows = edge + [(100 + i, "w " * r.randrange(1, 60)) for i in range(600)] + [(1000 + i, "the hot text") for i in range(900)]
    found = shard.digest(shard.shard(frame(rows), shards=4)).collect()
    assert len(found) == len(rows)
    size = lambda t: len((t or "").encode()) + 1
    assert sorted((str(x.doc_id), x.size, x.text_crc32) for x in found) == sorted((str(i), size(t), zlib.crc32((t or "").encode())) for i, t in rows)
    slots = defaultdict(list)
    for x in found:
        slots[x.shard].append(x.slot)
        assert x.law == "bytes" and x.grown_shard is None
    assert set(slots) <= set(range(4)) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_level():
    r = np.random.default_rng(2)
    w = r.integers(1, 1000, 300).astype(float)
    sums = np.bincount(shard.level(w, np.zeros(300, np.int64), 8), w, 8)
    assert sums.max() - sums.min() <= 3 and sums.sum() == w.sum()


@pytest.mark.parametrize(("n", "near"), [(200, 0.02), (1000, 0.003), (10_000, 0.003)])
def test_groups_stay_whole_and_sizes_are_near_equal(frame, n, near):
    """Half of the rows are copies, one text has a twentieth of all rows and less than a shard."""
    r = random.Random(n)
    texts = ["w%d " % i * r.randrange(1, 90) for i in range(n // 2)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(n + i, r.choice(texts)) for i in range(n // 2 - n // 20)] + [(3 * n + i, "the hot text " * 8) for i in range(n // 20)]
    found = shard.digest(shard.shard(frame(rows))).collect()
    where, sums, text = defaultdict(set), [0] * 16, dict(rows)
    for x in found:
        where[text[x.doc_id]].add(x.shard)
        sums[x.shard] += x.size
    assert len(found) == len(rows) and all(len(s) == 1 for s in where.values())
    assert max(sums) <= (1 + near) * sum(sums) / 16 and min(sums) >= (1 - near) * sum(sums) / 16


def test_query_on_given_documents(spark):
    """op8_shard on whole given tables: one shard a text; sizes as near as the largest group allows."""
    for sf, near in (("sf0.001", 0.01), ("sf0.01", 0.002)):
        docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
        found = shard.op8_shard(spark, f"/root/testdata/{sf}").join(docs.select("doc_id", "text"), "doc_id")
        assert found.columns[:7] == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
        where, sums, groups = defaultdict(set), [0] * 16, defaultdict(int)
        for x in found.collect():
            where[x.text].add(x.shard)
            sums[x.shard] += x.size
            groups[x.text] += x.size
        mean = sum(sums) / 16
        assert all(len(s) == 1 for s in where.values())
        assert max(sums) <= max((1 + near) * mean, max(groups.values()))


def test_a_group_larger_than_a_shard_stays_whole(frame, monkeypatch):
    monkeypatch.setattr(shard, "PART_ROWS", 50)
    rows = [(i, f"text {i}") for i in range(400)] + [(1000 + i, "hot") for i in range(400)]
    found = shard.shard(frame(rows)).collect()
    assert len({x.shard for x in found if x.id >= 1000}) == 1
    slots = defaultdict(list)
    for x in found:
        slots[x.shard].append(x.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_write_and_empty(frame, tmp_path, spark):
    table = frame([(i, "a b c " * (i % 7)) for i in range(100)])
    shard.write_shards(table, str(tmp_path / "out"), shards=4)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 100
    assert shard.shard(frame([])).count() == 0
