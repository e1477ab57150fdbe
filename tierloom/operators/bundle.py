"""Verification of a run's artifacts as they lie in its folder: readable, well-formed, of their shapes, and bound to each other.

Documents are read once on the driver; the rows of decoded and rejects are checked by Spark, line by line, as untrusted JSON.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import partial
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.digest import sha256_json
from ..functions.text import once
from ..packs import Pack
from ..sources.files import ArtifactError, read_document
from ..sources.jsonl import strict_json, value_status
from . import rules, validate
from .registry import Refusal
from .shapes import ShapeError, check_document

#: Fields of a decoded row and of a reject, with the kind of each value; + forbids the empty string.
DECODED = {"row_id": "STRING+", "sku": "STRING+", "category": "STRING+", "subcategory": "STRING+", "attributes": "OBJECT", "is_winter_rated": "BOOLEAN", "tier": "STRING+", "evidence": "STRING+"}
REJECT = {"row_id": "STRING+", "sku": "STRING", "title": "STRING", "bucket": "STRING", "reason": "STRING"}
BUCKETS = ("abstained", "quarantined", "errored")


def row_errors(line: Column, fields: Mapping[str, str]) -> Column:
    """What a line of JSON breaks: malformed, not_object, or missing:, type: and empty: with a field's name (an empty array: nothing)."""

    def field(name: str, kind: str, value: Column) -> Column:
        bad = F.when(value.isNull(), f"missing:{name}").when(~F.schema_of_variant(value).startswith(kind.removesuffix("+")), f"type:{name}")
        return bad.when(F.try_variant_get(value, "$", "string") == "", f"empty:{name}") if kind.endswith("+") else bad

    def found(v: Column) -> Column:
        return F.array_compact(F.array(*[once(F.try_variant_get(v, f"$.{n}", "variant"), partial(field, n, k)) for n, k in fields.items()]))

    return once(strict_json(line), lambda v: once(value_status(v, []), lambda status: F.when(status == "ok", found(v)).otherwise(F.array(status))))


def _else(broken: Column, more: Callable[[], Column]) -> Column:
    """broken, or, where it is empty, more(), which is computed for no other row."""
    return once(broken, lambda found: F.when(F.size(found) > 0, found).otherwise(more()))


def decoded_errors(line: Column, pack: Pack) -> Column:
    """row_errors() of a decoded row, or, where there are none, its breaches of the pack's domains."""
    breaches = lambda text: once(F.from_json(text, rules.candidate_type(pack)), lambda c: validate.errors(c, pack))
    return once(line, lambda text: _else(row_errors(text, DECODED), lambda: breaches(text)))


def reject_errors(line: Column) -> Column:
    """row_errors() of a reject, or an unknown bucket."""
    unknown = lambda text: F.when(~F.get_json_object(text, "$.bucket").isin(*BUCKETS), F.array(F.lit("unknown bucket")))
    return once(line, lambda text: _else(row_errors(text, REJECT), lambda: unknown(text).otherwise(F.array().cast("array<string>"))))


def extra_fields(lines: DataFrame, fields: Mapping[str, str]) -> list[str]:
    """Names beside the fields: tolerated, and reported."""
    names = lines.select(F.explode(F.json_object_keys("value")).alias("name")).distinct()
    return sorted(r["name"] for r in names.where(~F.col("name").isin(*fields)).collect())


def _rows(spark: SparkSession, path: Path, label: str, errors: Column, fields: Mapping[str, str]) -> list[str]:
    if not path.exists():
        raise Refusal(f"missing_{label}")
    lines = spark.read.text(str(path)).where(F.trim("value") != "")
    bad = lines.select(F.get_json_object("value", "$.row_id").alias("row_id"), errors.alias("errors")).where(F.size("errors") > 0)
    if first := bad.orderBy("row_id").limit(1).collect():
        if first[0]["errors"][0] in ("malformed", "not_object"):
            raise Refusal(f"malformed_{label}")
        raise Refusal("schema_contract_failed", artifact=label, row_id=first[0]["row_id"], errors=first[0]["errors"])
    return extra_fields(lines, fields)


def verify(spark: SparkSession, work: Path, pack: Pack) -> dict:
    """The documents of a run's folder by name, and the extra fields of its rows. Raises Refusal at the first thing wrong, in a fixed order."""
    names = ("schema_report", "manifest", "eval_report", "gate_report", "comparison_report")
    try:
        found = {n: read_document(work / f"{n}.json", n) for n in names}
        for n in names:
            check_document(found[n], n)
    except ArtifactError as e:
        raise Refusal(e.reason, **({"error": e.detail} if e.detail else {})) from e
    except ShapeError as e:
        raise Refusal(e.reason, expected=e.detail) from e
    schema, manifest, report, judged = (found[n] for n in names[:4])
    if not schema["passed"] or not manifest["schema"]["passed"]:
        raise Refusal("schema_contract_failed", artifact="schema_report")
    bound = {
        "schema_report_sha256": (manifest["schema_report_sha256"], sha256_json(schema)),
        "schema_projection": (manifest["schema"], {k: schema[k] for k in manifest["schema"]}),
        "batch_id": (manifest["batch_id"], sha256_json(manifest["identity"])),
        "run_id": (manifest["run_id"], sha256_json({k: manifest[k] for k in ("batch_id", "decoded_sha256", "rejects_sha256")})),
        "manifest_sha256": (report["manifest_sha256"], sha256_json(manifest)),
        "eval_report_sha256": (judged["artifact_binding"].get("eval_report_sha256"), sha256_json(report)),
        "current_batch_id": (found["comparison_report"]["current"]["batch_id"], manifest["batch_id"]),
    }
    if wrong := sorted(k for k, (a, b) in bound.items() if a != b):
        raise Refusal("binding_mismatch", names=wrong)
    decoded = _rows(spark, work / "decoded", "decoded", decoded_errors(F.col("value"), pack), DECODED)
    rejects = _rows(spark, work / "rejects", "rejects", reject_errors(F.col("value")), REJECT)
    return found | {"extra_fields": {"raw": schema["extra_fields"], "decoded": decoded, "rejects": rejects}}
