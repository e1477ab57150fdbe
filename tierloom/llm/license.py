"""License scans with a positional index of rare tokens.

Templates are notices as their publishers word them, each with a mandatory key phrase. Document frequencies of all template
words are counted over all documents, and every template word has its postings: templates and positions. A file is looked up by
its own highest-IDF licence words: for each template whose words the file holds, so many of the rarest of these (the anchors)
that what remains cannot make up the IDF share `COVER`. An anchor's places in the file, less its positions in the template, are
where the notice may start; places of the key phrase, checked word by word, are intersected with them by relative position.
The score is the largest IDF share of template words that stand there in order, each displaced by at most `SLACK` words against
the key phrase, so that words may be changed, left out or inserted. As a notice of that share holds an anchor in place, no
notice is lost by the look-up. Key phrases of `BASE` are templates of their own whose every place is counted.

Null and empty texts have no words, no labels and score 0; rows are independent, so repeated rows give equal rows.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES, read

#: Label, key phrase, text: notices as their publishers word them (in lower case, punctuation dropped). Fixed values.
TEMPLATES = [
    ("agpl", "gnu affero general public license", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("apache", "apache license", "licensed under the apache license version 2 0"),
    ("apache", "apache license", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("boost", "boost software license", "distributed under the boost software license version 1 0"),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("cc", "creative commons", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc0", "cc0 1 0", "dedicated to the public domain under cc0 1 0 universal"),
    ("epl", "eclipse public license", "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0"),
    ("gpl-notice", "gnu general public license", "this work is licensed under the gnu general public license version 3"),
    ("gpl-notice", "gnu general public license", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("isc", "permission to use copy modify and or distribute this software", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("lgpl", "gnu lesser general public license", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mit", "mit license", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("mpl", "mozilla public license", "subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "released into the public domain", "this is free and unencumbered software released into the public domain"),
    ("zlib", "provided as is without any express or implied warranty", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
]
#: Phrases whose every place is counted.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Share of the template's IDF mass that must stand in place, and words by which a word may be displaced.
COVER, SLACK = 0.5, 8

FOUND = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORD_BYTES).split()


def aligned(w: list[bytes], text: list[bytes], weights: list[float], start: int, slack: int = SLACK) -> float:
    """Largest weight of words of text that stand in w in order, the o-th of them within slack of start + o."""
    wide = 2 * slack + 1
    best = [0.0] * (wide + 1)
    for o, (x, weight) in enumerate(zip(text, weights, strict=True)):
        row, at = [0.0] * (wide + 1), start + o - slack
        for b in range(wide):  # b: the word at + b of w; the row before has it one cell further on
            got = max(best[b + 1], row[b - 1] if b else best[0])
            if 0 <= at + b < len(w) and w[at + b] == x:
                got = max(got, best[b] + weight)
            row[b] = got
        row[wide] = row[wide - 1]
        best = row
    return best[wide]


class Index:
    """Positional postings of all template words. idf: a word's weight; words without one weigh most."""

    def __init__(self, idf: dict[str, float], templates=TEMPLATES, base=BASE) -> None:
        most = max(idf.values(), default=1.0)
        self.idf = lambda w: idf.get(w.decode(), most)
        self.items, self.base, self.vocabulary = [], [], set()
        rarest = lambda k: min(k, key=lambda x: (-self.idf(x), x))
        for phrase, label in base.items():
            p = phrase.encode().split()
            self.base.append((label, p, rarest(p), p.index(rarest(p))))
            self.vocabulary |= set(p)
        for label, key, text in templates:
            w, k = text.encode().split(), key.encode().split()
            at = next(i for i in range(len(w)) if w[i : i + len(k)] == k)
            postings = defaultdict(list)
            for i, x in enumerate(w):
                postings[x].append(i)
            weights = list(map(self.idf, w))
            order = sorted(postings, key=lambda x: (-self.idf(x), x))
            self.items.append((label, w, k, at, rarest(k), weights, sum(weights), postings, order))
            self.vocabulary |= set(w)
        #: A file without any of these has neither a key phrase nor a base phrase.
        self.musts = frozenset([b[2] for b in self.base] + [i[4] for i in self.items])

    def scan(self, w: list[bytes]) -> tuple:
        """The FOUND columns of a file of words w, and its places: label, first word and words of each phrase or notice."""
        if self.musts.isdisjoint(w):
            return len(w), 0, None, None, "", "", 0.0, []
        held = defaultdict(list)
        for i, x in enumerate(w):
            if x in self.vocabulary:
                held[x].append(i)
        places = [(label, i - at, len(p)) for label, p, rare, at in self.base for i in held.get(rare, ()) if i >= at and w[i - at : i - at + len(p)] == p]
        base, score = {x[0] for x in places}, 1.0 if places else 0.0
        starts = [x[1] for x in places]
        for label, text, key, at, rare, weights, whole, postings, order in self.items:
            if rare not in held:
                continue
            there = [x for x in order if x in held]
            left = sum(self.idf(x) * len(postings[x]) for x in there)
            if left < COVER * whole:
                continue  # the file's words cannot make up the share
            begins = set()
            for x in there:  # the file's anchors: its rarest words of the template, until the others cannot make up the share
                begins |= {i - o for i in held[x] for o in postings[x]}
                left -= self.idf(x) * len(postings[x])
                if left < COVER * whole:
                    break
            begins, off = sorted(begins), key.index(rare)
            for k in dict.fromkeys(i - off for i in held[rare]):
                if k < 0 or w[k : k + len(key)] != key:
                    continue
                n = bisect_left(begins, k - at - SLACK)
                if n < len(begins) and begins[n] <= k - at + SLACK:
                    got = aligned(w, text, weights, k - at) / whole
                    if got >= COVER:
                        places.append((label, max(0, k - at), len(text)))
                        score = max(score, min(1.0, got))
        join = lambda x: ",".join(sorted(x))
        return len(w), len(starts), min(starts, default=None), max(starts, default=None), join(base), join({x[0] for x in places}), score, sorted(set(places))


def frequencies(docs: DataFrame, text_col: str = "text", templates=TEMPLATES, base=BASE) -> dict[str, float]:
    """IDF of every template word over all documents; the result is as large as the templates' vocabulary."""
    vocabulary = frozenset(x.encode() for t in [t[2] for t in templates] + list(base) for x in t.split())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, rows = dict.fromkeys(vocabulary, 0), 0
        for b in batches:
            for t in b.column(0).cast(pa.binary()):
                rows += 1
                for x in vocabulary.intersection(words(t.as_py())):
                    count[x] += 1
        names = [None, *(x.decode() for x in count)]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([rows, *count.values()], pa.int64())], names=["word", "n"])

    found = dict(docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n")).collect())
    rows = found.pop(None, 0)
    return {w: math.log((rows + 1) / (n + 1)) + 1e-9 for w, n in found.items()}


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the FOUND columns and places (label, first word and number of words of each phrase and notice) of every document."""
    index_of = frequencies(docs, text_col)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    place = pa.struct([("label", pa.string()), ("start", pa.int64()), ("words", pa.int64())])
    names = [*(f.split()[0] for f in FOUND.split(", ")), "places"]
    kinds = [*({"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[f.split()[1]] for f in FOUND.split(", ")), pa.list_(place)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(index_of)
        for b in batches:
            found = [index.scan(words(t.as_py())) for t in b.column(1).cast(pa.binary())]
            found = [(*f[:-1], [dict(zip(("label", "start", "words"), x, strict=True)) for x in f[-1]]) for f in found]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(zip(*found, strict=True) if found else [[]] * len(kinds), kinds, strict=True))], names=["id", *names])

    return own.mapInArrow(run, f"id {own.schema['id'].dataType.simpleString()}, {FOUND}, places array<struct<label:string,start:bigint,words:bigint>>")


def op5_license(spark, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents")).drop("places").withColumnRenamed("id", "doc_id")
