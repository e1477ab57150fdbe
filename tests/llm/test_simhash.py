import random
import re

import xxhash
from pyspark.sql import functions as F

from tierloom.llm import simhash
from tierloom.llm.components import components

SCHEMA = "doc_id long, text string, text2 string, _row int"


def plain_fingerprint(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows):
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 3:
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    best = {}
    for a, (i, _) in enumerate(prints):
        if i is not None:
            best[top(a)] = min(best.get(top(a), i), i)
    return sorted(((i, f"{f:016x}", best.get(top(a))) for a, (i, f) in enumerate(prints)), key=str)


def texts(n, seed=1):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdé", k=4)) for _ in range(80)]
    out = [(0, None), (1, ""), (2, " \t "), (3, "One"), (4, "one two"), (4, "one two"), (None, "a b c")]
    for i in range(5, n):
        w = r.choices(words, k=r.choice([2, 3, 30, 400]))
        out.append((i, " ".join(w)))
        for k in range(r.randrange(3)):
            v = list(w)
            v[r.randrange(len(v))] = r.choice(words)
            out.append((10_000 + 10 * i + k, "\n".join(v)))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)


def found(df):
    return sorted(((r.id, f"{r.fp % 2**64:016x}", r.component) for r in df.collect()), key=str)


def test_equals_brute_force(spark):
    rows = texts(150)
    assert found(simhash.near_duplicates(frame(spark, rows))) == plain_components(rows)


def test_large_shards_are_dealt_to_cells_without_losing_links(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL", 4)
    rows = texts(120, seed=2)
    assert found(simhash.near_duplicates(frame(spark, rows))) == plain_components(rows)


def test_more_blocks_lose_no_links(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LOAD", 1e-9)
    rows = texts(80, seed=3)
    assert found(simhash.near_duplicates(frame(spark, rows))) == plain_components(rows)


def test_tree_equals_scan():
    r = random.Random(4)
    values = list({r.getrandbits(64) & r.getrandbits(64) & r.getrandbits(64) for _ in range(400)})
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for v in values[::7]:
        assert sorted(tree.within(v, 9)) == sorted(w for w in values if (v ^ w).bit_count() <= 9)


def jaccard(a, b):
    a, b = (a or "").lower().split(), (b or "").lower().split()
    x, y = ({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def test_bitmaps_rule_out_no_link():
    import numpy as np
    import pyarrow as pa

    r, sets = random.Random(5), []
    for n in (1, 3, 7, 8, 60, 250, 260, 1000):
        base = [str(r.getrandbits(30)) for _ in range(n + 4)]
        for edits in (0, 1, 3, 10, 60):
            v = base + [str(r.getrandbits(30)) for _ in range(r.randrange(1 + n // 6))]
            for k in r.sample(range(len(v)), min(edits, len(v))):
                v[k] = "x"
            sets.append(simhash.shingle_set(" ".join(v).encode()))
    maps = simhash.Bitmaps(pa.array([simhash.bitmap(x) for x in sets], pa.binary()), np.array([len(x) for x in sets]), 4, 5)
    i, j = np.triu_indices(len(sets), 1)
    exact = np.array([len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)])
    may = maps.may(i, j)
    assert may[exact >= 0.8].all() and (exact >= 0.8).sum() > 10 and (~may[exact < 0.7]).mean() > 0.95


def test_keep_one(spark):
    r = random.Random(6)
    rows, clean = [(0, None), (1, ""), (None, "a b c"), (2, "one"), (2, "one")], 40
    for i in range(clean):
        w = [str(r.getrandbits(20)) for _ in range(r.choice([5, 60, 700]))]
        rows.append((100 + i, " ".join(w)))
        if len(w) > 50:  # an exact copy and a near one of it
            rows.append((1000 + i, " ".join(w)))
            w[r.randrange(len(w))] = "EDIT"
            rows.append((2000 + i, "\n".join(w)))
    kept = simhash.keep_one(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "text2", "_row"]
    ids = sorted((row.doc_id for row in kept.collect()), key=str)
    assert ids == sorted([0, None, 2, *range(100, 100 + clean)], key=str)


def test_documents_below_the_similarity_stay(spark):
    r, rows = random.Random(7), []
    for i in range(20):
        w = [str(r.getrandbits(30)) for _ in range(300)]
        v = list(w)
        for k in range(20, 300, 36):  # 8 edits apart from each other: 40 of 296 shingles, J = 256 / 336 = 0.76
            v[k] = "x"
        rows += [(i, " ".join(w)), (100 + i, " ".join(v))]
    assert all(0.75 < jaccard(rows[k][1], rows[k + 1][1]) < 0.8 for k in range(0, 40, 2))
    assert simhash.keep_one(frame(spark, rows)).count() == 40


def test_block_edits_are_found_like_brute_force(spark, monkeypatch):
    r, rows = random.Random(8), []
    common = [str(r.getrandbits(30)) for _ in range(40)]
    for i in range(40):
        w = common[: r.choice([0, 0, 40])] + [str(r.getrandbits(30)) for _ in range(r.choice([4, 12, 60, 300]))]
        rows.append((10 * i, " ".join(w)))
        for k in range(1, 4):  # a block appended, cut short, put before
            n = round(len(w) * r.uniform(0.02, 0.3))
            block = [str(r.getrandbits(30)) for _ in range(n)]
            rows.append((10 * i + k, " ".join((w + block, w[: len(w) - n], block + w)[k - 1])))
    up = {i: i for i, _ in rows}

    def top(x):
        return x if up[x] == x else top(up[x])

    for a, t in rows:
        for b, v in rows:
            if a < b and jaccard(t, v) >= 0.8:
                up[max(top(a), top(b))] = min(top(a), top(b))
    assert 40 < len({top(a) for a, _ in rows}) < 120
    monkeypatch.setattr(simhash, "CELL", 2)
    monkeypatch.setattr(simhash, "FEW", 3)
    assert {x.doc_id for x in simhash.keep_one(frame(spark, rows)).collect()} == {top(a) for a, _ in rows}


def test_empty(spark):
    assert simhash.near_duplicates(frame(spark, [])).collect() == []
    assert simhash.keep_one(frame(spark, [])).collect() == []


def test_components_of_chains(spark):
    n = 200
    edges = [(i, i + 1) for i in range(0, n - 1) if i % 50 != 49] + [(5, 5)]
    got = components(spark.createDataFrame(edges, "a long, b long"))
    assert {(r.node, r.root) for r in got.collect()} == {(i, i // 50 * 50) for i in range(n)}
    assert components(spark.createDataFrame([], "a long, b long")).where(F.lit(True)).count() == 0


def test_given_documents_equal_all_pairs(spark):
    """Whole given documents against all pairs of distinct sets that share a shingle: recall and precision of links are 1."""
    from collections import Counter, defaultdict

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = {}
    for row in docs.select("doc_id", "text").collect():
        w = (row.text or "").lower().split()
        sets[row.doc_id] = {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    holders, up, linked = defaultdict(list), {i: i for i in sets}, 0
    for i, own in sets.items():
        for x in own or {""}:
            holders[x].append(i)

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, own in sets.items():
        common = Counter(j for x in own or {""} for j in holders[x] if j < i)
        for j, n in common.items():
            if 5 * n >= 4 * (len(own or {""}) + len(sets[j] or {""}) - n):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
                linked += own != sets[j]
    assert linked > 10
    found = defaultdict(set)
    for row in simhash.similar_documents(docs).collect():
        found[row.root].add(row.id)
    plain = defaultdict(set)
    for i in sets:
        plain[top(i)].add(i)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, plain.values()))


def test_equal_ids_and_texts_of_other_columns_are_told_apart(spark):
    rows = [(1, "a b c d e f", "x", 1), (1, "a b c d e f", "y", 2), (2, "other words stand in this one", "z", 3), (2, "other words stand in this one", "z", 3)]
    kept = simhash.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(x.doc_id for x in kept) == [1, 2]
