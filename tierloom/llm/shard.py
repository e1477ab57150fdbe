"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Groups are rows of equal text, and a group is never split. A group that holds more of any dimension than `HEAVY` of a shard is
packed as a vector of its own; their number is bounded by that share, and in a small table they are all groups. The lighter
groups are hashed into `BINS` bins, whose sums are the vectors to pack. In order of size, each goes to the shard where the dot
product with the residual capacity is highest among those it still fits in; then bytes are levelled: the
fullest shard gives units to others, or swaps them for lighter ones, while that helps. Only heavy groups and bins are ever collected or broadcast.

A text whose copies hold more than a shard's share makes a shard larger than the others by as much: it stays whole. Its rows are
still counted, ranked and written in many tasks. Null texts count as empty; null ids are hashed like values; equal rows get
different slots of one order. No rows: no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE_SEP, read, settle, split_words

SHARDS, BINS, HEAVY = 16, 4096, 1 / 64
DIMS = ("bytes", "tokens", "rows")
#: Rows of a unit are ranked in parts of about so many, so that a task sorts few rows.
PART_ROWS = 50_000


def pack(vectors: np.ndarray, shards: int) -> np.ndarray:
    """vectors: a row of non-negative sums a unit. The shard of each unit, by largest dot product with residual capacity."""
    total = vectors.sum(0)
    unit = vectors / np.where(total > 0, total, 1)
    left, out = np.full((shards, vectors.shape[1]), 1 / shards), np.zeros(len(vectors), np.int64)
    for i in sorted(range(len(unit)), key=lambda k: (-unit[k].max(), k)):
        fits = (left >= unit[i]).all(1)
        score = left @ unit[i]
        s = int(np.argmax(np.where(fits, score, -np.inf) if fits.any() else score))
        out[i] = s
        left[s] -= unit[i]
    return out


def level(weights: np.ndarray, shard: np.ndarray, shards: int) -> np.ndarray:
    """Evens out the sums: the heaviest shard gives a unit to another, or swaps one for a lighter one, while their gap shrinks."""
    out, sums = shard.copy(), np.bincount(shard, weights, shards)
    for _ in range(4 * len(weights)):
        high = int(sums.argmax())
        mine = np.flatnonzero(out == high)
        for low in np.argsort(sums, kind="stable")[:-1]:
            gap = sums[high] - sums[low]
            theirs = np.flatnonzero(out == low)
            theirs = theirs[np.argsort(weights[theirs], kind="stable")]
            ladder = np.concatenate(([0.0], weights[theirs]))  # 0: nothing comes back
            at = np.searchsorted(ladder, weights[mine] - gap / 2)
            tries = np.stack([np.clip(at - 1, 0, len(ladder) - 1), np.clip(at, 0, len(ladder) - 1)])
            rest = abs(gap - 2 * (weights[mine] - ladder[tries]))
            k, i = np.unravel_index(rest.argmin(), rest.shape)
            if gap > 0 and rest[k, i] < gap - 0.5:
                back = int(tries[k, i])
                out[mine[i]] = low
                if back:
                    out[theirs[back - 1]] = high
                moved = weights[mine[i]] - ladder[back]
                sums[high] -= moved
                sums[low] += moved
                break
        else:
            break
    return out


def measured(docs: DataFrame, id_col: str, text_col: str, extra: Sequence = ()) -> DataFrame:
    """group (a hash of the text), row (a hash of id and text) and the dimensions of each row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        *extra,
        F.xxhash64(text).alias("group"),
        F.xxhash64(id_col, text_col).alias("row"),
        (F.octet_length(text).cast("long") + 1).alias("bytes"),
        F.size(split_words(text, SPACE_SEP)).cast("long").alias("tokens"),
        F.lit(1).cast("long").alias("rows"),
    )


def place(rows: DataFrame, shards: int = SHARDS, bins: int = BINS, heavy: float = HEAVY) -> tuple[DataFrame, DataFrame]:
    """rows of measured() -> the rows with their unit (a heavy group or a bin), and a bounded table unit, shard, start, parts.

    start is the unit's first slot, parts in how many its rows are ranked.
    """
    spark = rows.sparkSession
    sums = [F.sum(d).alias(d) for d in DIMS]
    totals = [x or 0 for x in rows.agg(*sums).first()]
    share = F.greatest(*[F.col(d) / F.lit(max(1, t) * heavy / shards) for d, t in zip(DIMS, totals, strict=True)])
    groups = rows.groupBy("group").agg(*sums).withColumn("heavy", share > 1)
    units = groups.groupBy(F.when(F.col("heavy"), F.col("group")).alias("group"), F.when(~F.col("heavy"), F.pmod(F.xxhash64("group"), F.lit(bins))).cast("int").alias("bin")).agg(*sums)
    found = sorted(units.collect(), key=lambda r: (r.bin is not None, r.bin or 0, r.group or 0))  # at most 3 * shards / heavy groups, and the bins
    vectors = np.array([tuple(r)[2:] for r in found], float).reshape(-1, len(DIMS))
    shard = level(vectors[:, 0], pack(vectors, shards), shards)
    names, table, at = [], [], [0] * shards
    for i, (r, s) in enumerate(zip(found, shard, strict=True)):
        unit = r.bin if r.bin is not None else bins + i
        if r.bin is None:
            names.append((r.group, unit))
        table.append((unit, int(s), at[s], -(-r.rows // PART_ROWS)))
        at[s] += r.rows
    named = F.broadcast(spark.createDataFrame(names, "group long, _unit int"))
    dealt = rows.join(named, "group", "left").withColumn("unit", F.coalesce("_unit", F.pmod(F.xxhash64("group"), F.lit(bins)).cast("int"))).drop("_unit")
    return dealt, spark.createDataFrame(table, "unit int, shard int, start long, parts int")


def slots(dealt: DataFrame, table: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds shard and slot (gapless from 0 in each shard)."""
    dealt = dealt.join(F.broadcast(table), "unit").withColumn("part", F.pmod(F.xxhash64("row", "unit"), F.col("parts")).cast("int"))
    ranked = dealt.withColumn("rank", F.row_number().over(W.partitionBy("unit", "part").orderBy(*order)) - 1)
    if table.where("parts > 1").isEmpty():
        ranked = ranked.withColumn("before", F.lit(0))
    else:
        counts = dealt.groupBy("unit", "part").agg(F.count("*").alias("n"))
        before = F.coalesce(F.sum("n").over(W.partitionBy("unit").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        ranked = ranked.join(counts.select("unit", "part", before.alias("before")), ["unit", "part"])
    return ranked.withColumn("slot", F.col("start") + F.col("before") + F.col("rank")).drop("part", "parts", "rank", "before", "start")


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """id, text_crc32, the dimensions, unit, shard and slot of each row of docs."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = settle(measured(docs, id_col, text_col, [F.col(id_col).alias("id"), F.crc32(text.cast("binary")).alias("text_crc32")]), "rows")
    dealt, table = place(rows, shards)
    return slots(dealt, table, ["id", "group", "row"])


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> None:
    """Write docs under path in one folder a shard (column shard), in files of some units each."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = measured(docs, id_col, text_col, [F.struct("*").alias("_row"), F.crc32(text.cast("binary")).alias("text_crc32")])
    dealt, table = place(rows, shards)
    part = F.pmod(F.xxhash64("row"), F.col("parts"))
    dealt.join(F.broadcast(table), "unit").select("_row.*", "shard", (F.col("unit") % 64).alias("_file"), part.alias("_part")).repartition("shard", "_file", "_part").drop("_file", "_part").write.partitionBy("shard").parquet(path)


def op8_shard(spark, sf_dir: str) -> DataFrame:
    return digest(shard(read(spark, sf_dir, "documents")))


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        F.col("id").alias("doc_id"),
        F.col("bytes").alias("size"),
        F.col("text_crc32").cast("long").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
