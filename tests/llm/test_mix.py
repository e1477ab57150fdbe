import itertools
import random
import re

import pytest

from tierloom.llm import mix


def test_targets():
    assert mix.targets([10, 10, 10], [3, 1, 2], 45) == pytest.approx([20, 25 / 3, 50 / 3])
    r = random.Random(1)
    for _ in range(100):
        n = r.randrange(1, 12)
        sizes, w = [r.randrange(1, 100) for _ in range(n)], [(3, 1, 2)[i % 3] for i in range(n)]
        t = mix.targets(sizes, w, 1.5 * sum(sizes))
        assert sum(t) == pytest.approx(1.5 * sum(sizes)) and all(x <= 2 * s + 1e-9 for x, s in zip(t, sizes, strict=True))
        free = [x / k for x, k, s in zip(t, w, sizes, strict=True) if x < 2 * s - 1e-9]
        assert not free or max(free) == pytest.approx(min(free))
    assert mix.targets([], [], 0) == [] and mix.targets([0], [3], 0) == [0]


def test_flow_is_of_least_cost():
    r = random.Random(2)
    for _ in range(20):
        patterns = {"0": 2, "1": 2, "0 1": 2}
        classes = {("0", 0): 2, ("1", 1): 2, ("0 1", 0): 2, ("0 1", 1): 2}
        quotas = [r.randrange(0, 9), r.randrange(0, 9)]
        flow = mix.route(patterns, classes, quotas)
        for s in (0, 1):
            assert sum(f for (_, t), f in flow.items() if t == s) == quotas[s]

        def cost(used):
            """Copies cost what came before them, counted in the steps of the arcs."""
            total = 0
            for p, words in used.items():
                copies, width = 0, 1
                while words > 0:
                    got = min(words, patterns[p] * width)
                    total += got * copies
                    words -= got
                    copies, width = copies + width, width * 2 if copies else 1
            return total

        best = min(
            cost({"0": a, "1": b, "0 1": quotas[0] - a + quotas[1] - b})
            for a, b in itertools.product(range(5), range(5))
            if 0 <= quotas[0] - a <= 4 and 0 <= quotas[1] - b <= 4
        )
        assert cost({"0": flow["0", 0], "1": flow["1", 1], "0 1": flow["0 1", 0] + flow["0 1", 1]}) == best


def corpus(seed=3, n=400):
    r = random.Random(seed)
    texts = [" ".join("w" for _ in range(r.randrange(1, 40))) + f" t{i}" for i in range(n)]
    rows = [(i, t, r.choice(["b", "a", "é", None, "c"])) for i, t in enumerate(texts)]
    return rows + [(n + i, t, "a") for i, (_, t, _) in enumerate(rows[::9])] + [(9999, "same row", "c")] * 3 + [(7, None, "a"), (8, "", None), (None, "null id here", "b")]


def test_plan(frame):
    rows = corpus()
    found = mix.plan(frame(rows)).collect()
    assert len(found) == len(rows)
    size = lambda t: len((t or "").split())
    sources = ["a", "b", "c", "é", None]
    sizes = [sum(size(t) for _, t, s in rows if s == x) for x in sources]
    goal = mix.targets(sizes, [3, 1, 2, 3, 1], 1.5 * sum(sizes))
    for x, n, g in zip(sources, sizes, goal, strict=True):
        own = [r for r in found if r.source_size == n]
        assert {r.target for r in own} == {g} and len(own) == sum(s == x for *_, s in rows)
        assert abs(sum(r.size * r.times for r in own) - g) <= 0.005 * g + 3
    assert {r.times for r in found} <= {0, 1, 2}
    again = mix.plan(frame(rows)).collect()
    key = lambda rs: sorted((str(r.id), r["_k1"], r.times) for r in rs)
    assert key(found) == key(again)


def test_mix_repeats_rows(frame):
    rows = corpus()
    table = frame(rows)
    out = mix.mix(table)
    assert out.columns == table.columns
    total = sum(len((t or "").split()) for _, t, _ in rows)
    assert abs(sum(len(r.text.split()) for r in out.collect()) - 1.5 * total) <= 0.02 * total
    assert mix.mix(frame([])).count() == 0
    assert mix.mix(frame([(1, None), (2, "")])).count() == 0


def test_blocks_keep_memberships_and_quotas(frame, monkeypatch):
    """Networks dealt to blocks: quotas are met, and shared texts are repeated no more than in one network, but for a little."""
    r = random.Random(5)
    names = [f"s{i}" for i in range(8)]
    rows, k = [], 0
    for i in range(300):
        text = " ".join("w" for _ in range(r.randrange(5, 40))) + f" t{i}"
        for s in r.sample(names, r.choice([1, 1, 2, 3])):
            rows.append((k, text, s))
            k += 1
    cost = []
    for patterns in (4000, 4):
        monkeypatch.setattr(mix, "PATTERNS", patterns)
        found = mix.plan(frame(rows)).collect()
        text_of, copies = {i: t for i, t, _ in rows}, {}
        for x in found:
            copies[text_of[x.id]] = copies.get(text_of[x.id], 0) + x.times
        cost.append(sum(len(t.split()) * n * (n - 1) / 2 for t, n in copies.items()))
        by = {}
        for x in found:
            by.setdefault((x.source_size, x.target), []).append(x.size * x.times)
        assert len(by) == 8 and all(abs(sum(v) - goal) <= 0.01 * goal + 3 for (_, goal), v in by.items())
    assert cost[1] <= 1.15 * cost[0] + 50


def test_rows_equal_in_id_and_text_of_two_sources_are_both_kept(frame):
    rows = [(1, "the same text of one id", "x"), (1, "the same text of one id", "y")] + [(2 + i, f"more words here {i}", "xy"[i % 2]) for i in range(40)]
    table = frame(rows)
    found = mix.plan(table).collect()
    taken = {(x.id, x["_k3"]): x.times for x in found}
    out = mix.mix(table).collect()
    both = {s: sum(r.doc_id == 1 and r.source == s for r in out) for s in "xy"}
    assert max(both.values()) <= 2 and sum(both.values()) == sum(t for (i, _), t in taken.items() if i == 1)
    keys = {r["_k3"]: r.source for r in table.select("source", mix.whole_key(table)).collect()}
    assert both == {s: sum(t for (i, k), t in taken.items() if i == 1 and keys[k] == s) for s in "xy"}


def test_query_on_given_documents(spark):
    """op3_mix on whole given tables: contract columns, the caps, and each source near its target."""
    found = mix.op3_mix(spark, "/root/testdata/sf0.01")
    assert found.columns == ["doc_id", "size", "source_size", "target", "taken"]
    rows = found.collect()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source").collect()
    size = {d.doc_id: len([w for w in re.split(r"[\x20\x09-\x0D]+", d.text or "") if w]) for d in docs}
    source = {d.doc_id: d.source for d in docs}
    whole, taken, target = {}, {}, {}
    for i, n in size.items():
        whole[source[i]] = whole.get(source[i], 0) + n
    goal = dict(zip(sorted(whole), mix.targets([whole[s] for s in sorted(whole)], [(3, 1, 2)[k % 3] for k in range(len(whole))], 1.5 * sum(whole.values())), strict=True))
    for r in rows:
        s = source[r.doc_id]
        assert (r.size, r.source_size) == (size[r.doc_id], whole[s]) and r.target == pytest.approx(goal[s]) and r.taken in (0, r.size, 2 * r.size)
        taken[s], target[s] = taken.get(s, 0) + r.taken, r.target
    assert len(rows) == len(docs) and all(abs(taken[s] - target[s]) <= 0.002 * target[s] + 5 for s in whole)
