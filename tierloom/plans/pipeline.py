"""From a raw file to the registry: contract, decode, evaluate, gate, compare, load, reconcile.

    python -m tierloom.plans.pipeline --ruleset guarded --workdir DIR [--rows N] [--seed S] [--baseline-dir DIR]

Exit code 0: the gate passed and the batch is in the registry; 1: the gate failed; 2: load or reconciliation did not complete.
"""

from __future__ import annotations

import argparse
import dataclasses
import hashlib
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..functions.digest import set_digest, sha256_json
from ..operators import bundle, compare, contract, evaluate, gate, tiers
from ..operators.registry import Refusal, Registry, payload, refused
from ..packs import PARTS, Pack
from ..sources import synth
from ..sources.files import read_raw_csv, write_json, write_raw_csv

DECODER_VERSION = "1"
THRESHOLDS = {"flag_precision": 0.97, "category_accuracy": 0.93, "coverage": 0.80, "error_rows": 0, "quarantine_rate": 0.10}


def implementation() -> dict[str, str]:
    """Digests of the modules that decide an outcome."""
    here = Path(__file__).resolve().parent.parent
    names = ("packs.py", "functions/text.py", "functions/digest.py", "operators/rules.py", "operators/tiers.py", "operators/validate.py", "operators/contract.py", "sources/files.py")
    return {n: hashlib.sha256((here / n).read_bytes()).hexdigest() for n in names}


def identity(raw_digest: str, tier_list: list, pack: Pack) -> dict:
    """What makes a batch: contract, inputs, configuration and implementation. Nothing of paths, times or row order."""
    for t in tier_list:
        if not hasattr(t, "identity"):
            raise TypeError(f"tier {getattr(t, 'name', t)!r} must expose identity()")
    dims = {t.name: set_digest(t.dim, t.dim.columns) for t in tier_list if hasattr(t, "dim")}
    return {
        "contract": {"decoder_version": DECODER_VERSION, "raw_schema_version": contract.RAW_SCHEMA_VERSION},
        "inputs": {"raw_content_sha256": raw_digest, "dimensions": dims, "brands": sha256_json([dataclasses.asdict(b) for b in sorted(pack.brands, key=lambda b: b.name)])},
        "configuration": [t.identity() for t in tier_list],
        "implementation": implementation(),
    }


def decode_stage(spark: SparkSession, raw_path: str, tier_list: list, pack: Pack, out_dir: Path) -> dict:
    """Validate, decode and write outcomes once; returns the manifest. A failing contract is written, then raised."""
    out_dir.mkdir(parents=True, exist_ok=True)
    report = contract.validate_csv(spark, raw_path, lambda r: write_json(r, out_dir / "schema_report.json"))
    batch = identity(report["effective_content_sha256"], tier_list, pack)
    tiers.run_batch(read_raw_csv(spark, raw_path), tier_list, pack).write.mode("overwrite").parquet(str(out_dir / "outcomes"))
    outcomes = read_outcomes(spark, out_dir)
    tiers.decoded(outcomes).write.mode("overwrite").json(str(out_dir / "decoded"))
    tiers.rejects(outcomes).write.mode("overwrite").json(str(out_dir / "rejects"))
    manifest = {
        "batch_id": sha256_json(batch),
        "identity": batch,
        "counts": tiers.counts(outcomes),
        "tier_invalid": tiers.tier_invalid(outcomes),
        "decoded_sha256": set_digest(outcomes.where("state = 'decoded'").select(payload(pack).alias("p")), ["p"]),
        "rejects_sha256": set_digest(tiers.rejects(outcomes), ["row_id", "sku", "title", "bucket", "reason"]),
        "schema_report_sha256": sha256_json(report),
        "schema": {k: report[k] for k in ("passed", "missing_required_fields", "extra_fields", "drift_status", "drift_events", "missing_value_counts", "null_value_counts", "effective_content_sha256", "row_count")},
    }
    manifest["run_id"] = sha256_json({k: manifest[k] for k in ("batch_id", "decoded_sha256", "rejects_sha256")})
    write_json(manifest, out_dir / "manifest.json")
    return manifest


def read_outcomes(spark: SparkSession, out_dir: Path) -> DataFrame:
    return spark.read.parquet(str(out_dir / "outcomes"))


def run(spark: SparkSession, raw_path: str, gold: DataFrame, tier_list: list, pack: Pack, work: Path, thresholds: dict | None = None, baseline: Path | None = None) -> tuple[int, dict]:
    """All stages; the exit code and the reports by name."""
    thresholds = thresholds or THRESHOLDS
    manifest = decode_stage(spark, raw_path, tier_list, pack, work)
    outcomes = read_outcomes(spark, work)
    report = evaluate.evaluate(outcomes, gold, manifest, pack, set_digest(gold, gold.columns))
    write_json(report, work / "eval_report.json")
    (work / "eval_report.md").write_text(evaluate.markdown(report), encoding="utf-8")
    judged = gate.run_gate(report, manifest, thresholds)
    write_json(judged, work / "gate_report.json")
    after = compare.outcome_fields(outcomes, pack)
    before = compare.outcome_fields(read_outcomes(spark, baseline), pack) if baseline else after.limit(0)
    old = json.loads((baseline / "manifest.json").read_text()) if baseline else {}
    difference = compare.report(compare.diff(before, after), {"batch_id": old.get("batch_id")}, {"batch_id": manifest["batch_id"]})
    write_json(difference, work / "comparison_report.json")
    registry = Registry(spark, str(work / "registry"))
    try:
        bundle.verify(spark, work, pack)
        loaded = registry.load(read_raw_csv(spark, raw_path), outcomes, gold, manifest, report, judged, thresholds, pack)
    except Refusal as r:
        loaded = refused(r.reason, manifest["batch_id"], **r.details)
    write_json(loaded, work / "load_result.json")
    out = {"manifest": manifest, "evaluation": report, "gate": judged, "comparison": difference, "load": loaded}
    if not judged["passed"]:
        return 1, out
    if loaded["status"] not in ("loaded", "noop"):
        return 2, out
    out["reconciliation"] = registry.reconcile(manifest["batch_id"])
    write_json(out["reconciliation"], work / "reconciliation_report.json")
    return (0 if out["reconciliation"]["passed"] else 2), out


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    p.add_argument("--ruleset", choices=("guarded", "naive"), required=True)
    p.add_argument("--workdir", type=Path, required=True)
    p.add_argument("--rows", type=int, default=1200)
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--baseline-dir", type=Path)
    args = p.parse_args(argv)
    if args.rows <= 0:
        p.error("--rows must be positive")
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    pack = dataclasses.replace(PARTS, brands=synth.BRANDS)
    source = synth.generate(spark, args.seed, args.rows)
    args.workdir.mkdir(parents=True, exist_ok=True)
    raw = str(args.workdir / f"raw-{args.seed}-{args.rows}")
    if not Path(raw).exists():
        write_raw_csv(source, raw)
    code, out = run(spark, raw, synth.gold_of(source), [tiers.RulesTier(args.ruleset)], pack, args.workdir, baseline=args.baseline_dir)
    for c in out["gate"]["checks"]:
        print(f"{c['name']:<18} {c['actual']:>8} {c['op']} {c['threshold']:<6} {'PASS' if c['passed'] else 'FAIL'}")
    print("load:", out["load"]["status"], out["load"]["reason"] or f"inserted={out['load']['inserted']}")
    if "reconciliation" in out:
        print("reconciliation:", "PASS" if out["reconciliation"]["passed"] else "FAIL")
    return code


if __name__ == "__main__":
    sys.exit(main())
