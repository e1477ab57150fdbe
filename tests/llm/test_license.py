import random
import re

from tierloom.llm import license as lic

FILES = [
    "Licensed under CC BY-NC 4.0.",
    "cc by cc by CC-BY",
    "This work is licensed under the GNU General Public License, version 3.",
    "ALL RIGHTS RESERVED. all rights, reserved! all right reserved",
    "Released under the MIT License.",
    "Licensed under the Apache License, Version 2.0. All rights reserved.",
    "the mit of license released under",
    "general public general public license public license",
    "ccby all rights éreserved",
]


def plain(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places, labels = [], set()
    for p, label in lic.BASE.items():
        p = p.split()
        at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def made(seed=1):
    r = random.Random(seed)
    vocabulary = "cc by general public license all rights reserved mit the Of".split()
    return list(enumerate(FILES)) + [(100 + i, r.choice([" ", ", ", "-"]).join(r.choices(vocabulary, k=r.randrange(60)))) for i in range(150)]


def test_base_equals_brute_force(frame, edge):
    docs = made() + [(500 + (i or 0), t) for i, t in edge]
    found = sorted((r.id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in lic.scan(frame(docs)).collect())
    assert found == sorted((i, *plain(t)) for i, t in docs)


def test_method_labels(frame):
    found = {r.id: r for r in lic.scan(frame(made())).collect()}
    assert found[4].labels == "mit" and found[4].score > 0.9 and found[4].n_base == 0
    assert found[5].labels == "apache,reserved" and found[6].labels == "" and found[6].score == 0
    assert found[2].labels == "gpl,gpl-notice" and all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in found.values())


def notices():
    return sorted({(label, key, text) for label, key, text in lic.TEMPLATES})


def test_notices_survive_edits():
    """With any two words outside the key phrase changed, and with two words inserted anywhere outside it, a notice is still found."""
    r, index = random.Random(3), lic.Index({})
    for label, key, text in notices():
        w, k = text.split(), key.split()
        at = next(i for i in range(len(w)) if w[i : i + len(k)] == k)
        free = [i for i in range(len(w)) if not at <= i < at + len(k)]
        around = "some words before it".split(), "and others after".split()
        assert label in index.scan(" ".join([*around[0], *w, *around[1]]).encode().split())[5].split(",")
        for _ in range(20):
            v = list(w)
            if len(free) >= len(w) / 2 and len(w) > 7:
                for i in r.sample(free, 2):
                    v[i] = "zzz"
                assert label in index.scan(" ".join(v).encode().split())[5].split(","), v
            cut = r.choice([i for i in range(len(w) + 1) if not at < i < at + len(k)])
            v = [*w[:cut], "two", "inserted", *w[cut:]]
            assert label in index.scan(" ".join(v).encode().split())[5].split(","), v


def test_labels_equal_brute_force(frame):
    """The look-up by a file's anchors loses nothing: every place of every key phrase is aligned here."""
    r = random.Random(4)
    vocabulary = sorted({x for _, _, t in lic.TEMPLATES for x in t.split()})
    docs = []
    for i in range(150):
        _, key, text = r.choice(notices())
        w = [x for x in text.split() if r.random() < r.choice([0.4, 0.7, 0.95])]
        at = r.randrange(len(w) + 1)
        w[at:at] = key.split()
        for _ in range(r.randrange(6)):
            w.insert(r.randrange(len(w) + 1), r.choice(vocabulary))
        docs.append((i, " ".join(r.choices(vocabulary, k=r.randrange(40)) + w + r.choices(vocabulary, k=r.randrange(40)))))
    table = frame(docs)
    idf = lic.frequencies(table)
    plain = {}
    for i, t in docs:
        w, labels = t.split(), {label for p, label in lic.BASE.items() if f" {p} " in f" {t} "}
        for label, key, text in lic.TEMPLATES:
            v, k = text.split(), key.split()
            at = next(j for j in range(len(v)) if v[j : j + len(k)] == k)
            weights = [idf[x] for x in v]
            for p in range(len(w)):
                if w[p : p + len(k)] == k and lic.aligned(w, v, weights, p - at) >= lic.COVER * sum(weights):
                    labels.add(label)
        plain[i] = ",".join(sorted(labels))
    found = {x.id: x for x in lic.scan(table).collect()}
    assert {i: x.labels for i, x in found.items()} == plain and len(set(plain.values())) > 10
    assert all({p.label for p in x.places} == set(filter(None, x.labels.split(","))) for x in found.values())


def test_alignment():
    w = "x a b c y d e".split()
    assert lic.aligned(w, "a b c d e".split(), [1.0] * 5, 1) == 5 and lic.aligned(w, "a b c d e".split(), [1.0] * 5, 1, slack=0) == 3
    assert lic.aligned(w, "e d c b a".split(), [1.0] * 5, 1) == 1 and lic.aligned([], ["a"], [1.0], 0) == 0


def test_notice_without_its_rarest_words_is_still_found():
    idf = dict.fromkeys("redistribution and use in source binary forms with or without modification are permitted".split(), 5.0)
    idf |= dict.fromkeys("provided that the following conditions met".split(), 6.0)
    text = "redistribution and use in source and binary forms with or without modification are permitted"
    assert lic.Index(idf).scan(text.encode().split())[5] == "bsd"


def test_empty(frame):
    assert lic.scan(frame([])).collect() == []
