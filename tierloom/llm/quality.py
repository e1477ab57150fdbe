"""Quality classifier: ridge regression on random Fourier features of document statistics, calibrated by isotonic regression.

Statistics of every text are computed once and written to the shared folder. Each partition of labelled rows sums its part of
the normal equations; the sums are added by block in two levels, each of about the root of the number of partitions, so the
driver receives one matrix of fixed size whatever the input, and no task many. The ridge is fitted to four fifths of the rows
(by a hash of the id); the raw scores of the other fifth are counted in `BINS` bins, pooled until monotone, and interpolated
between the pools. Where a part has no rows, all rows serve for both.

Null and empty texts have zero statistics and are scored like any other. A document with several labels takes the
highest; labels of unknown documents are unused. Without labels every score is 0.5. Equal texts have equal scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_bucket, read, settle

WAVES, WIDTH, RIDGE, SEED, BINS, BLOCKS = 256, 3.0, 1e-4, 11, 2000, 16
_KIND = np.zeros((256, 8))
for _b in range(256):
    _c = chr(_b)
    _KIND[_b] = [65 <= _b <= 90, 97 <= _b <= 122, 48 <= _b <= 57, _c in ".,;:", _c == "!", _c == "|", _c in "#$%&*@^~<>{}[]\\/=+_", _b >= 128]
N_STATS = 18


def statistics(text: bytes | None) -> list[float]:
    """Statistics of a UTF-8 text."""
    b = text or b""
    if not b:
        return [0.0] * N_STATS
    count = np.bincount(np.frombuffer(b, np.uint8), minlength=256)
    upper, lower, digit, stop, bang, bar, sign, wide = (count @ _KIND).tolist()
    w = b.split()
    n, words, lines = len(b), max(1, len(w)), b.split(b"\n")
    share = count[count > 0] / n
    distinct = len(set(w))
    repeats = sum(map(bytes.__eq__, w, w[1:]))
    longest = max(map(len, w), default=0)
    return [
        np.log1p(n), np.log1p(len(w)), min(n / words, 40.0), min(longest, 200) / 20, upper / (upper + lower + 1), digit / n, stop / words, bang / words, bar / words, sign / words, wide / n,
        distinct / words, np.log1p(words / (distinct + 1)), repeats / words, np.log1p(words / len(lines)), len(set(lines)) / len(lines), float(-(share * np.log2(share)).sum()), (upper + lower) / n,
    ]


def all_statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and stats (array of doubles) of each row."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [statistics(t.as_py()) for t in b.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.float64()))], names=["id", "stats"])

    return own.mapInArrow(run, f"id {own.schema['id'].dataType.simpleString()}, stats array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, N_STATS))


class Waves:
    """Standardised statistics, their random Fourier features and a constant."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray) -> None:
        r = np.random.default_rng(SEED)
        self.mean, self.scale = mean, scale
        self.turn, self.phase = r.normal(0, 1 / WIDTH, (len(mean), WAVES)), r.uniform(0, 2 * np.pi, WAVES)

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        return np.hstack([np.cos(x @ self.turn + self.phase) * np.sqrt(2 / WAVES), x, np.ones((len(x), 1))])


def normal_equations(rows: DataFrame, waves: Waves) -> tuple[np.ndarray, np.ndarray, int]:
    """Z'Z, Z'y and the number of rows, summed by partition, then by block and group of partitions, then by block."""
    size = WAVES + N_STATS + 1
    groups = max(1, math.isqrt(rows.rdd.getNumPartitions()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 2))
        for b in batches:
            z, y = waves(_matrix(b.column(0))), b.column(1).to_numpy()
            total[:, :size] += z.T @ z
            total[:, size] += z.T @ y
            total[0, size + 1] += len(y)
        if total[0, size + 1]:
            parts, group = np.array_split(total.ravel(), BLOCKS), TaskContext.get().partitionId() % groups
            yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([group] * BLOCKS, pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["block", "part", "sums"])

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py()) for x in t["sums"])
        return pa.table({"block": t["block"][:1], "part": t["part"][:1], "sums": pa.array([total.tobytes()], pa.binary())})

    shape = "block int, part int, sums binary"
    parts = rows.select("stats", F.col("label").cast("double")).mapInArrow(run, shape).groupBy("block", "part").applyInArrow(add, shape).groupBy("block").applyInArrow(add, shape)
    found = b"".join(bytes(r["sums"]) for r in sorted(parts.collect(), key=lambda r: r["block"]))
    total = np.frombuffer(found).reshape(size, size + 2) if found else np.zeros((size, size + 2))
    return total[:, :size], total[:, size], int(total[0, size + 1])


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pools of neighbours, in order of x, whose means of y rise: centres and means."""
    pools: list[list[float]] = []
    for a, b, c in zip(x, y, n, strict=True):
        pools.append([a * c, b * c, c])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    p = np.array(pools)
    return p[:, 0] / p[:, 2], p[:, 1] / p[:, 2]


class Model:
    def __init__(self, waves: Waves, weights: np.ndarray, knots: tuple[np.ndarray, np.ndarray]) -> None:
        self.waves, self.weights, self.knots = waves, weights, knots

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.waves(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        """Calibrated, with a trace of the raw score so that a pool keeps its order."""
        raw = self.raw(stats)
        return np.clip(0.998 * np.interp(raw, *self.knots) + 0.002 / (1 + np.exp(-4 * (raw - 0.5))), 0, 1)


def fit(rows: DataFrame) -> Model | None:
    """rows: stats, label (0 or 1), late (of the part that calibrates). None without rows of labels."""
    moments = rows.select(F.posexplode("stats").alias("i", "x")).groupBy("i").agg(F.avg("x"), F.stddev_pop("x")).collect()
    if not moments:
        return None
    mean, scale = (np.array([r[k] for r in sorted(moments)]) for k in (1, 2))
    waves = Waves(mean, np.where(scale > 1e-9, scale, 1.0))
    late = {r["late"] for r in rows.select("late").distinct().collect()}
    early, late = (rows.where("NOT late"), rows.where("late")) if len(late) == 2 else (rows, rows)
    a, b, n = normal_equations(early, waves)
    model = Model(waves, np.linalg.solve(a + RIDGE * n * np.eye(len(a)), b), (np.array([0.0, 1.0]), np.array([0.0, 1.0])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, BINS))
        for t in batches:
            raw, y = model.raw(_matrix(t.column(0))), t.column(1).to_numpy()
            at = np.clip((raw + 0.5) / 2 * BINS, 0, BINS - 1).astype(int)
            for k, v in enumerate((None, y, raw)):
                sums[k] += np.bincount(at, v, BINS)
        used = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *(pa.array(s[used]) for s in sums)], names=["bin", "n", "y", "x"])

    bins = late.select("stats", F.col("label").cast("double")).mapInArrow(run, "bin int, n double, y double, x double").groupBy("bin").agg(*(F.sum(c).alias(c) for c in "nyx")).orderBy("bin").collect()
    n, y, x = (np.array([r[c] for r in bins]) for c in "nyx")
    model.knots = isotonic(x / n, y / n, n)
    return model


def train_rows(stats: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """The statistics of labelled rows outside the held-out fifth."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label"))
    return stats.join(known, "id").where(id_bucket("id") != 0).select("stats", "label", (F.pmod(F.xxhash64(F.lit(SEED), "id"), F.lit(5)) == 0).alias("late"))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """id and score of every document."""
    stats = settle(all_statistics(docs, id_col, text_col), "stats")
    model = fit(settle(train_rows(stats, labels, id_col, label_col), "train"))
    if model is None:
        return stats.select("id", F.lit(0.5).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(_matrix(b.column(1))))], names=["id", "score"])

    return stats.mapInArrow(run, f"id {stats.schema['id'].dataType.simpleString()}, score double")


def op10_quality(spark, sf_dir: str) -> DataFrame:
    found = score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return found.select(F.col("id").alias("doc_id"), (id_bucket("id") == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
