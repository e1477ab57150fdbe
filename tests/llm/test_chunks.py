import random

import numpy as np

from tierloom.llm import chunks


def passage(r, n):
    return " ".join("".join(r.choices("abcdefghij", k=r.randrange(2, 9))) for _ in range(n))


def test_boundaries_depend_on_16_bytes():
    r = random.Random(1)
    a = passage(r, 300).encode()
    got = chunks.boundaries(np.frombuffer(a, np.uint8))
    plain = []
    for i in range(len(a)):
        h = 0
        for x in a[max(0, i - 40) : i + 1]:
            h = (h * 2 + int(chunks._GEAR[x])) % 65536
        if h >> (16 - chunks.MASK_BITS) == 0:
            plain.append(i + 1)
    assert got.tolist() == plain


def test_cuts_cover_and_keep_bounds():
    for text in (b"", b"a", b"a" * 5000, passage(random.Random(2), 2000).encode()):
        ends = chunks.cuts(text)
        sizes = np.diff([0, *ends])
        assert (ends[-1] if ends else 0) == len(text)
        assert (sizes <= chunks.MOST).all() and (sizes[:-1] >= chunks.LEAST).all()


def test_insertions_move_no_other_boundary():
    text = passage(random.Random(3), 600).encode()
    moved = text[:1000] + b"INSERTED" + text[1000:]
    a = {text[x:y] for x, y in zip([0, *chunks.cuts(text)], chunks.cuts(text), strict=False)}
    b = {moved[x:y] for x, y in zip([0, *chunks.cuts(moved)], chunks.cuts(moved), strict=False)}
    assert len(a - b) <= 6


def planted():
    r = random.Random(4)
    docs, hit = [], set()
    shared = [passage(r, 51 + k) for k in range(30)]
    for i in range(200):
        t = passage(r, 150)
        if i < 60:
            t = passage(r, 40) + " " + shared[i % 30] + " " + passage(r, 40)
            hit.add(i)
        elif i < 120:
            t += "\nAll rights reserved by the owner of this text."
        docs.append((i, t))
    return docs, hit


def test_planted_passages_are_found_and_others_left(frame, edge):
    docs, hit = planted()
    found = {r.id: r for r in chunks.repeats(frame(docs + [(i, t) for i, t in edge if i != 5 or t == "One"])).collect() if r.spans}
    assert set(found) - {None} == hit
    assert all(found[i].removed_words == 0 for i in range(30) if i in found)
    assert all(found[i].removed_words >= 28 and found[i].first_id == i - 30 for i in range(30, 60))


def test_dedup_cuts_all_but_the_first(frame):
    docs, hit = planted()
    table = frame(docs)
    out = chunks.dedup(table)
    assert out.columns == table.columns
    before, after = dict(docs), {r.doc_id: r.text for r in out.collect()}
    assert all(after[i] == before[i] for i in range(200) if i not in range(30, 60))
    assert all(len(after[i]) < len(before[i]) - 100 for i in range(30, 60))
    assert chunks.dedup(frame([])).count() == 0


def test_equal_rows_are_one_document(frame):
    text = passage(random.Random(5), 200)
    assert chunks.repeats(frame([(1, text), (1, text)])).count() == 0
    assert {r.id for r in chunks.repeats(frame([(1, text), (1, text), (2, text), (None, text)])).collect()} == {1, 2, None}


def test_words_of_chunks():
    text = "\ta bc\rdef  gh\x0bi\n".encode()
    assert chunks.words_of(text, [3, 4, 9, len(text)]).tolist() == [1, 1, 1, 2] and chunks.words_of(b"x", [1]).tolist() == [1]


def test_passages_without_spaces_and_of_other_white_space(frame):
    r = random.Random(6)
    cjk = "".join(chr(r.randrange(0x4E00, 0x9FA5)) for _ in range(600))
    other = lambda: "".join(chr(r.randrange(0x4E00, 0x9FA5)) for _ in range(300))
    tabs = passage(r, 80).replace(" ", "\t")
    docs = [(i, other() + cjk + other()) for i in range(3)] + [(10 + i, tabs) for i in range(2)] + [(20, other())]
    found = {x.id: x for x in chunks.repeats(frame(docs)).collect()}
    assert set(found) == {0, 1, 2, 10, 11} and found[1].removed and not found[0].removed and found[0].spans == 1


def test_common_lines_by_chance_make_no_run(frame):
    """Chunks that stand in other documents, but never with the same neighbour."""
    r = random.Random(7)
    pieces = [passage(r, 5) for _ in range(40)]
    docs = [(i, " ".join(r.sample(pieces, 30))) for i in range(30)]
    assert sum(x.spans for x in chunks.repeats(frame(docs)).collect()) == 0


def test_repeats_within_a_document(frame):
    r = random.Random(8)
    twice = passage(r, 90)
    text = twice + " " + passage(r, 60) + " " + twice
    table = frame([(1, text), (2, passage(r, 100))])
    (found,) = chunks.repeats(table).collect()
    assert found.id == 1 and found.spans == 0 and found.inner > 60 and found.removed_words == found.inner
    kept = {x.doc_id: x.text for x in chunks.dedup(table).collect()}
    assert len(kept[1]) < len(text) - 300 and kept[1].startswith(twice)


def test_null_ids_alone_keep_one(frame):
    r = random.Random(9)
    shared = passage(r, 100)
    rows = [(None, shared + " " + passage(r, 50)), (None, shared + " " + passage(r, 50))]
    assert sorted(bool(x.removed) for x in chunks.repeats(frame(rows)).collect()) == [False, True]


def test_query_equals_brute_force(spark):
    """op2_chunks on whole given tables against the definition, chunk by chunk."""
    from collections import defaultdict

    docs = {(d.doc_id, d.text) for d in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()}
    pairs, where = {}, defaultdict(set)
    for doc in docs:
        b = (doc[1] or "").encode()
        e = [0, *chunks.cuts(b)]
        pairs[doc] = [b[x:z] for x, z in zip(e, e[2:], strict=False)], e, b
        for x in pairs[doc][0]:
            where[x].add(doc)
    plain = {}
    for doc, (own, e, b) in pairs.items():
        spans, start = [], None
        for i, x in enumerate([*own, None]):
            hit = x is not None and len(where[x]) > 1
            if hit and start is None:
                start = i
            if not hit and start is not None:
                t = b[e[start] : e[i + 1]]
                n = sum(1 for k in range(e[start], e[i + 1]) if not chunks._SPACE[b[k]] and (k == 0 or chunks._SPACE[b[k - 1]]))
                if n >= chunks.MIN_WORDS or len(t) >= chunks.MIN_BYTES:
                    spans.append(n)
                start = None
        plain[doc[0]] = (bool(spans), len(spans), sum(spans), max(spans, default=0))
    got = {r.doc_id: (r.has_repeat, r.spans, r.words, r.longest) for r in chunks.op2_chunks(spark, "/root/testdata/sf0.001").collect()}
    assert got == plain and sum(v[0] for v in plain.values()) > 5
