"""Content digests.

Two canonical forms are kept apart: compact JSON (sorted keys, no blanks, UTF-8) names documents and records, and line JSON
(sorted keys, default separators, ASCII escapes) names files of rows. Small documents are digested on the driver; row sets of
any size are digested by Spark: each row by itself, then the row digests in a tree whose levels no task has to hold whole.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def sha256_json(value) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def sha256_rows(rows: Iterable[dict]) -> str:
    """Digest of rows as a JSON lines file would hold them."""
    h = hashlib.sha256()
    for r in rows:
        h.update((json.dumps(r, sort_keys=True) + "\n").encode())
    return h.hexdigest()


def row_digest(columns: Sequence[str], null: str = "\\N") -> Column:
    """SHA-256 of a row's columns as text, with a marker for nulls."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit(null)) for c in columns]), 256)


def _ordered(key: str, digest: str) -> Column:
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, digest))), lambda x: x[digest]), ","), 256)


def tree_digest(rows: DataFrame, by: Sequence[str] = (), digest: str = "d") -> DataFrame:
    """by, rows, digest: one digest of the row digests of each group, whatever the order of its rows.

    A tree of three levels, by the first five and two hex digits of the row digests: a million leaves, 256 branches and the
    root. So a task takes a millionth of the rows and the levels above have a fixed size. Equal rows count as often as they stand.
    """
    d = F.col(digest)
    leaves = rows.groupBy(*by, F.substring(d, 1, 5).alias("_leaf")).agg(F.count("*").alias("rows"), F.sha2(F.array_join(F.array_sort(F.collect_list(d)), ","), 256).alias("_d"))
    branches = leaves.groupBy(*by, F.substring("_leaf", 1, 2).alias("_branch")).agg(F.sum("rows").alias("rows"), _ordered("_leaf", "_d").alias("_d"))
    return branches.groupBy(*by).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), _ordered("_branch", "_d").alias("digest"))


def set_digest(df: DataFrame, columns: Sequence[str]) -> str:
    """The tree digest of the columns of all rows, as JSON with its nulls."""
    row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    return tree_digest(df.select(row.alias("d"))).first()["digest"]
