"""The raw input's contract: required columns, additive drift, and evidence of what breaks it.

Headers are read by themselves, file by file, because a CSV reader renames what a contract must report. The body is read as
typed text and profiled by aggregates; only small lists of evidence reach the driver.
"""

from __future__ import annotations

import csv
import io
from collections import Counter
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.digest import set_digest, sha256_json
from ..sources.files import REQUIRED, names_of, read_body, survey

RAW_SCHEMA_VERSION = "1"
#: Duplicate ids listed in a report; the count beside them is whole, and duplicate_ids() has them all.
SAMPLE = 1000


class ContractError(ValueError):
    """Raised after a failing report was made."""

    def __init__(self, report: dict) -> None:
        super().__init__("raw input violates the schema contract: " + ", ".join(report["failures"]))
        self.report = report


def profile(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """field, missing (nulls), empty (empty strings) of each field, in one pass."""
    one = df.agg(*[F.struct(F.count_if(F.col(f).isNull()).alias("missing"), F.count_if(F.col(f) == "").alias("empty")).alias(f) for f in fields])
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}.missing").alias("missing"), F.col(f"{f}.empty").alias("empty")) for f in fields])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def header_evidence(names: Sequence[str], required: Sequence[str] = REQUIRED) -> dict:
    """What a header line says about the contract, before any row is read."""
    labels = [n if n.strip() else f"__unnamed_column_{i}__" for i, n in enumerate(names, 1)]
    unnamed = [b for a, b in zip(names, labels, strict=True) if a != b or not a.strip()]
    return {
        "observed": labels,
        "missing": sorted(set(required) - set(labels)),
        "extra": sorted(set(labels) - set(required)),
        "duplicate": sorted(n for n, k in Counter(labels).items() if k > 1),
        "unnamed": unnamed,
    }


def _report(head: dict, n_rows: int, more: dict, failures: list[str], digest: str | None) -> dict:
    events = [{"kind": "missing_required_field", "field": f} for f in head["missing"]]
    events += [{"kind": "additive_field", "field": f} for f in head["extra"] if f not in head["unnamed"]]
    events += [{"kind": "duplicate_header_field", "field": f} for f in head["duplicate"]]
    events += [{"kind": "unnamed_header_field", "field": f} for f in head["unnamed"]]
    events += [{"kind": k} for k in ("unlabeled_extra_values", "invalid_utf8") if k in failures]
    breaking = {"missing_required_fields", "duplicate_header_fields", "unnamed_header_fields", "unlabeled_extra_values", "empty_input", "invalid_utf8"}
    return {
        "schema_version": RAW_SCHEMA_VERSION,
        "required_fields": list(REQUIRED),
        "observed_fields": head["observed"],
        "missing_required_fields": head["missing"],
        "extra_fields": head["extra"],
        "drift_status": "breaking" if breaking & set(failures) else "additive" if head["extra"] else "none",
        "drift_events": events,
        "row_count": n_rows,
        **more,
        "effective_content_sha256": digest,
        "failures": failures,
        "passed": not failures,
        "contract_sha256": sha256_json({"schema_version": RAW_SCHEMA_VERSION, "required_fields": list(REQUIRED)}),
    }


def content_digest(rows: DataFrame) -> str:
    """Digest of the required columns, whatever the order of rows and extra columns in the file."""
    return set_digest(rows, list(REQUIRED))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _cells(text: pd.Series) -> pd.Series:
    """The cells of a record's text, quoted ones included."""
    return text.map(lambda t: next(csv.reader(io.StringIO(t, newline="")), []), na_action="ignore")


def duplicate_ids(rows: DataFrame) -> DataFrame:
    """row_id, count of ids that stand more than once; empty ids are no ids."""
    return rows.where("row_id <> ''").groupBy("row_id").count().where("count > 1")


def inspect_csv(spark: SparkSession, path: str) -> dict:
    """The contract report of a CSV file or folder of files. Each file's header counts; files may differ in order and extra columns."""
    found = survey(spark, path)
    empty = {"duplicate_row_ids": [], "duplicate_row_id_count": 0, "missing_value_counts": {}, "null_value_counts": {}}
    if any(f["invalid"] for f in found):
        blank = {"observed": [], "missing": list(REQUIRED), "extra": [], "duplicate": [], "unnamed": []}
        return _report(blank, 0, empty, ["invalid_utf8"], None)
    heads = [header_evidence(names_of(f["header"])) for f in found] or [header_evidence([])]
    head = {"observed": heads[0]["observed"]} | {k: sorted({x for h in heads for x in h[k]}) for k in ("missing", "extra", "duplicate")}
    head["unnamed"] = list(dict.fromkeys(x for h in heads for x in h["unnamed"]))
    failures = [k for k, on in (("missing_required_fields", head["missing"]), ("duplicate_header_fields", head["duplicate"]), ("unnamed_header_fields", head["unnamed"])) if on]
    # fields that every file has are profiled; of a record of another length its own cells count: what is beyond its end is missing
    known = [c for c in REQUIRED if c not in head["missing"]]
    parts = []
    for f, h in zip(found, heads, strict=bool(found)):
        at = {c: h["observed"].index(c) for c in known}
        body = read_body(spark, f).withColumn("_own", _cells("_corrupt"))
        cells = [F.when(F.col("_corrupt").isNull(), F.coalesce(f"c{i}", F.lit(""))).otherwise(F.get("_own", F.lit(i))).alias(c) for c, i in at.items()]
        parts.append(body.select(*cells, F.coalesce(F.size("_own") > len(h["observed"]), F.lit(False)).alias("_long")))
    schema = "".join(f"{c} string, " for c in known) + "_long boolean"
    rows = (reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)).persist()
    try:
        n = rows.count()
        if not n:
            failures.append("empty_input")
        if rows.where("_long").limit(1).count():
            failures.append("unlabeled_extra_values")
        more = dict(empty)
        if known:
            seen = {r["field"]: r for r in profile(rows, known).collect()}
            more["missing_value_counts"] = {c: seen[c]["missing"] for c in known}
            more["null_value_counts"] = {c: seen[c]["empty"] for c in known}
        if "row_id" in known:
            twice = duplicate_ids(rows)
            more["duplicate_row_id_count"] = twice.count()
            if more["duplicate_row_id_count"]:
                more["duplicate_row_ids"] = [r["row_id"] for r in twice.orderBy("row_id").limit(SAMPLE).collect()]
                failures.append("duplicate_row_ids")
            if rows.where("row_id IS NULL OR trim(row_id) = ''").limit(1).count():
                failures.append("missing_row_ids")
        if any(more["missing_value_counts"].values()):
            failures.append("missing_required_values")
        whole = not (head["missing"] or head["duplicate"] or head["unnamed"] or any(more["missing_value_counts"].values()))
        return _report(head, n, more, failures, content_digest(rows) if whole else None)
    finally:
        rows.unpersist()


def validate_csv(spark: SparkSession, path: str, write=None) -> dict:
    """The report, given to write first; raises ContractError if it fails."""
    report = inspect_csv(spark, path)
    if write:
        write(report)
    if not report["passed"]:
        raise ContractError(report)
    return report
