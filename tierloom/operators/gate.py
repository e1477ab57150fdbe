"""Gates: thresholds over a measured report. Policy only; nothing is measured here."""

from __future__ import annotations

import math
import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..functions.digest import sha256_json

GATE_VERSION = "2"
#: Checks in order: the name, and which way the actual value must lie.
CHECKS = (("flag_precision", ">="), ("category_accuracy", ">="), ("coverage", ">="), ("error_rows", "<="), ("quarantine_rate", "<="))


def load_thresholds(path: str | Path) -> dict:
    return tomllib.loads(Path(path).read_text(encoding="utf-8"))


def check_thresholds(thresholds: dict) -> None:
    """Raises ValueError unless every check has a finite number and nothing else is set."""
    names = {n for n, _ in CHECKS}
    if set(thresholds) != names:
        raise ValueError(f"thresholds must be exactly {sorted(names)}")
    for n, v in thresholds.items():
        if isinstance(v, bool) or not isinstance(v, int | float) or not math.isfinite(v):
            raise ValueError(f"threshold {n} must be a finite number")


def actuals(report: dict, manifest: dict) -> dict:
    n = manifest["counts"]
    return {
        "flag_precision": report["flag"]["precision"],
        "category_accuracy": report["category_accuracy"],
        "coverage": report["coverage"],
        "error_rows": n["errored"],
        "quarantine_rate": round(n["quarantined"] / n["total"], 4),
    }


def run_gate(report: dict, manifest: dict, thresholds: dict) -> dict:
    """The gate report. Raises ValueError where report and manifest are of different batches."""
    check_thresholds(thresholds)
    if manifest["counts"]["total"] <= 0:
        raise ValueError("manifest total must be positive")
    for k, v in {**{k: manifest.get(k) for k in ("batch_id", "decoded_sha256", "rejects_sha256")}, "manifest_sha256": sha256_json(manifest)}.items():
        if report.get(k) != v:
            raise ValueError(f"evaluation/manifest binding mismatch: {k}")
    seen = actuals(report, manifest)
    checks = [{"name": n, "actual": seen[n], "threshold": thresholds[n], "op": op, "passed": seen[n] >= thresholds[n] if op == ">=" else seen[n] <= thresholds[n]} for n, op in CHECKS]
    binding = {k: report[k] for k in ("batch_id", "decoded_sha256", "rejects_sha256", "manifest_sha256", "gold_sha256", "evaluation_input_sha256")}
    binding |= {"run_id": manifest.get("run_id"), "eval_report_sha256": sha256_json(report), "thresholds_sha256": sha256_json(thresholds)}
    return {"gate_version": GATE_VERSION, "passed": all(c["passed"] for c in checks), "batch_id": report["batch_id"], "artifact_binding": binding, "checks": checks}


def as_frame(spark: SparkSession, gate: dict) -> DataFrame:
    rows = [(c["name"], float(c["actual"]), float(c["threshold"]), c["op"], c["passed"]) for c in gate["checks"]]
    return spark.createDataFrame(rows, "name string, actual double, threshold double, op string, passed boolean")
