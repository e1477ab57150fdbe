"""Toxicity: a counterfactual-regularised linear classifier.

A document's features are its distinct words and their first 4 to 6 letters, hashed. Features that tell the classes apart
in the labelled rows are kept, and a logistic regression is fitted to them. Where a labelled text names a group, its words are swapped
for the other names of the same kind, and the squared change of the score is part of the loss, so that a group's mention
alone moves no score. Where no labelled text names a group, or no name's feature tells the classes apart, there is no such
pair (Model.pairs is 0), and no name has a weight.

The fit uses at most `SAMPLE` labelled rows, drawn by a hash of their ids; scoring reads every text whole. Null and empty
texts have no features and score the intercept. A document with several labels takes the highest. Without labels, or with one
class alone, every score is that class's share (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY, WORD_BYTES, id_bucket, read, row_key, settle, sliced, without

SAMPLE, SEED, HASH_BITS = 16_000, 5, 22
SUPPORT, GAIN, MOST_FEATURES = 3, 6.6, 8192
L2, FAIRNESS, STEPS = 2e-4, 1.0, 400

#: Names of groups by kind, in English, French, Spanish and German; the first of each kind is neutral. Fixed values.
IDENTITIES = (
    ("people", "women", "men", "girls", "boys"),
    ("person", "woman", "man", "girl", "boy"),
    ("believers", "christians", "muslims", "jews", "hindus", "buddhists", "atheists", "sikhs"),
    ("religious", "christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic", "sikh"),
    ("sexual", "gay", "straight", "lesbian", "bisexual", "transgender", "heterosexual", "homosexual", "queer"),
    ("foreign", "american", "mexican", "african", "asian", "european", "chinese", "indian", "arab", "black", "white", "latino"),
    ("human", "old", "young", "disabled", "blind", "deaf", "poor", "rich", "immigrant", "refugee"),
    ("personnes", "femmes", "hommes", "filles", "garçons"),
    ("personne", "femme", "homme", "fille", "garçon"),
    ("croyants", "chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées"),
    ("croyant", "chrétien", "musulman", "juif", "hindou", "bouddhiste", "athée"),
    ("étranger", "américain", "mexicain", "africain", "asiatique", "européen", "chinois", "indien", "arabe", "noir", "blanc"),
    ("humain", "vieux", "jeune", "handicapé", "aveugle", "sourd", "pauvre", "riche", "immigré", "réfugié"),
    ("personas", "mujeres", "hombres", "chicas", "chicos"),
    ("persona", "mujer", "hombre", "chica", "chico"),
    ("creyentes", "cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos"),
    ("extranjero", "americano", "mexicano", "africano", "asiático", "europeo", "chino", "indio", "árabe", "negro", "blanco"),
    ("humano", "viejo", "joven", "ciego", "sordo", "pobre", "rico", "inmigrante", "refugiado"),
    ("menschen", "frauen", "männer", "mädchen", "jungen"),
    ("gläubige", "christen", "muslime", "juden", "buddhisten", "atheisten"),
    ("ausländer", "amerikaner", "mexikaner", "afrikaner", "asiaten", "europäer", "chinesen", "inder", "araber"),
    ("mensch", "behinderte", "blinde", "gehörlose", "arme", "reiche", "einwanderer", "flüchtling"),
)
_KIND = {w: (kind, i) for kind in IDENTITIES for i, w in enumerate(kind)}


def words(text: bytes | None) -> set[str]:
    return set((text or b"").translate(WORD_BYTES).decode("utf-8", "replace").split())


def hashed(word: str) -> list[int]:
    """The word's features: itself, and its beginnings."""
    names = [f"w{word}", *(f"p{word[:n]}" for n in (4, 5, 6) if len(word) >= n)]
    return [xxhash.xxh32_intdigest(n.encode()) >> (32 - HASH_BITS) for n in names]


def features(w: set[str]) -> list[int]:
    return sorted({f for x in w for f in hashed(x)})


def swaps(w: set[str]) -> list[set[str]]:
    """Counterfactuals of a text: the names of each kind turned into the next ones, and into the neutral one."""
    out = []
    for step in (1, 2, None):
        changed = {(_KIND[x][0][0] if step is None else _KIND[x][0][(_KIND[x][1] + step) % len(_KIND[x][0])]) if x in _KIND else x for x in w}
        if changed != w:
            out.append(changed)
    return out


class Model:
    """weights of the kept features by hash, the intercept, and the number of counterfactual pairs that the fit penalised."""

    def __init__(self, weights: dict[int, float], bias: float, pairs: int = 0) -> None:
        self.weights, self.bias, self.pairs, self.seen = weights, bias, pairs, {}

    def logit(self, w: set[str]) -> float:
        found: set[int] = set()
        seen = self.seen
        for x in w:
            own = seen.get(x)
            if own is None:
                if len(seen) > 500_000:
                    seen.clear()
                own = seen[x] = tuple(f for f in hashed(x) if f in self.weights)
            if own:
                found.update(own)
        return self.bias + sum(self.weights[f] for f in sorted(found))

    def score(self, text: bytes | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(words(text)), -40, 40))))


def informative(feature: np.ndarray, n: np.ndarray, bad: np.ndarray, rows: int, bad_rows: int) -> np.ndarray:
    """Features whose presence and class depend on each other (likelihood ratio), the strongest first.

    n, bad: the rows and the rows of label 1 that have the feature.
    """
    gain = np.zeros(len(feature))
    for have, total in ((bad, bad_rows), (n - bad, rows - bad_rows)):
        for cell, margin in ((have, n), (total - have, rows - n)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain += 2 * np.where(cell > 0, cell * np.log(cell * rows / (margin * total)), 0)
    gain[n < SUPPORT] = 0
    best = np.lexsort((feature, -gain))[:MOST_FEATURES]
    return feature[best[gain[best] >= GAIN]]


def fit(rows: Sequence[Sequence[int]], labels: Sequence[int], pairs: Sequence[tuple[Sequence[int], Sequence[int]]] = (), fairness: float = FAIRNESS, kept: np.ndarray | None = None) -> Model:
    """rows: hashed features of labelled texts; pairs: features of texts and of their counterfactuals; kept: the features to fit (None: the informative ones)."""
    y = np.asarray(labels, float)
    share = float(y.mean()) if len(y) else 0.5
    edge = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    if not 0 < share < 1:
        return Model({}, edge)
    if kept is None:
        flat = np.concatenate([np.asarray(r, np.int64) for r in rows])
        feature, back = np.unique(flat, return_inverse=True)
        kept = informative(feature, np.bincount(back).astype(float), np.bincount(back, np.repeat(y, [len(r) for r in rows])), len(y), y.sum())
    if not len(kept):
        return Model({}, edge)
    order = np.argsort(kept)

    def sparse(sets: Sequence[Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
        cols = []
        for own in sets:
            own = np.asarray(own, np.int64)
            at = np.minimum(np.searchsorted(kept, own, sorter=order), len(kept) - 1)
            cols.append(order[at][kept[order[at]] == own])
        return np.repeat(np.arange(len(sets)), [len(c) for c in cols]), np.concatenate(cols) if cols else np.zeros(0, np.int64)

    (ri, ci), (ai, ac), (bi, bc) = sparse(rows), sparse([p[0] for p in pairs]), sparse([p[1] for p in pairs])
    n, m, k = len(y), max(1, len(pairs)), len(kept)

    def gradient(w: np.ndarray, b: float) -> tuple[np.ndarray, float]:
        p = 1 / (1 + np.exp(-np.clip(np.bincount(ri, w[ci], n) + b, -40, 40))) - y
        g = np.bincount(ci, p[ri], k) / n + L2 * w
        if len(pairs):
            d = np.bincount(ai, w[ac], m) - np.bincount(bi, w[bc], m)
            g += fairness * (np.bincount(ac, d[ai], k) - np.bincount(bc, d[bi], k)) / m
        return g, float(p.mean())

    w, b, v, u = np.zeros(k), edge, np.zeros(k), np.zeros(k)
    vb = ub = 0.0
    for step in range(1, STEPS + 1):  # Adam, its rate falling to nothing
        g, gb = gradient(w, b)
        v, u, vb, ub = 0.9 * v + 0.1 * g, 0.999 * u + 0.001 * g * g, 0.9 * vb + 0.1 * gb, 0.999 * ub + 0.001 * gb * gb
        rate = 0.1 * (1 - step / (STEPS + 1)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        w -= rate * v / (np.sqrt(u) + 1e-9)
        b -= rate * vb / (np.sqrt(ub) + 1e-9)
    return Model({int(f): float(x) for f, x in zip(kept, w, strict=True)}, float(b), len(pairs))


def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """label, text -> label, f (the text's features), swapped (those of its counterfactuals)."""
    ints = pa.list_(pa.int32())
    for b in sliced(batches):
        own = [words(t.as_py()) for t in b.column(1).cast(pa.binary())]
        out = [(y, features(w), [features(s) for s in swaps(w)]) for y, w in zip(b.column(0).to_pylist(), own, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([int(o[0]) for o in out], pa.int32()), pa.array([o[1] for o in out], ints), pa.array([o[2] for o in out], pa.list_(ints))], names=["label", "f", "swapped"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, fairness: float = FAIRNESS) -> Model:
    """Fit on the labelled rows outside the held-out fifth, at most `sample` of them."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label"))
    known = known.where(id_bucket("id") != 0).orderBy(F.xxhash64(F.lit(SEED), "id"), "id").limit(sample)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id").select("label", "text")

    rows = settle(rows.mapInArrow(featured, "label int, f array<int>, swapped array<array<int>>"), "toxic-rows")
    # at most 2 ** HASH_BITS features, and no more than the sample holds
    counts = rows.select("label", F.explode("f").alias("f")).groupBy("f").agg(F.count("*").alias("n"), F.sum("label").alias("bad")).where(F.col("n") >= SUPPORT).toArrow()
    total = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    kept = informative(counts["f"].to_numpy().astype(np.int64), counts["n"].to_numpy().astype(float), counts["bad"].to_numpy().astype(float), *map(float, total))
    known_features = np.sort(kept)

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The kept features of each row, and of its counterfactuals where they differ."""
        ints = pa.list_(pa.int32())
        few = lambda x: np.intersect1d(x, known_features).tolist()
        for b in sliced(batches):
            f = [few(x) for x in b.column(1).to_pylist()]
            swapped = [[z for z in map(few, x) if z != own] for x, own in zip(b.column(2).to_pylist(), f, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f, ints), pa.array(swapped, pa.list_(ints))], names=["label", "f", "swapped"])

    found = rows.mapInArrow(thin, "label int, f array<int>, swapped array<array<int>>").toArrow()
    own = sorted(zip(found["label"].to_pylist(), found["f"].to_pylist(), found["swapped"].to_pylist(), strict=True))  # the fit must not depend on the order of tasks
    return fit([f for _, f, _ in own], [y for y, _, _ in own], [(f, z) for _, f, swapped in own for z in swapped], fairness, kept)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, row key and score of every document."""
    own = docs.select(F.col(id_col).alias("id"), *row_key(id_col, text_col), F.col(text_col).alias("text"))
    weights, bias = model.weights, model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(weights, bias)
        for b in batches:
            found = pa.array([m.score(t.as_py()) for t in b.column(3).cast(pa.binary())], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], found], names=["id", *KEY, "score"])

    return own.mapInArrow(run, f"id {own.schema['id'].dataType.simpleString()}, _k1 long, _k2 int, score double")


def clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score below the threshold, with their own columns."""
    scored = score(docs, train(docs, labels, id_col, text_col), id_col, text_col)
    return without(docs, scored.where(F.col("score") >= threshold).select(*KEY), row_key(id_col, text_col))


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = score(docs, train(docs, read(spark, sf_dir, "labels")))
    return found.select(F.col("id").alias("doc_id"), (id_bucket("id") == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
