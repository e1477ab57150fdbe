"""Shapes of report documents, as data, and one checker for them.

A shape is the name of a scalar; a set of allowed strings; a list of one shape (an array of such), a tuple (an array of this
length); or a dict of fields. In a dict the key "*" gives the shape of any field not named, a trailing "?" makes a field
optional, and with neither, fields that are not named are tolerated.
"""

from __future__ import annotations

import math

from ..functions.digest import sha256_json

_HEX = frozenset("0123456789abcdef")
SCALARS = {
    "text": (lambda v: isinstance(v, str) and v != "", "a non-empty string"),
    "string": (lambda v: isinstance(v, str), "a string"),
    "sha256": (lambda v: isinstance(v, str) and len(v) == 64 and _HEX.issuperset(v), "a lowercase SHA-256 digest"),
    "sha256?": (lambda v: v is None or isinstance(v, str) and len(v) == 64 and _HEX.issuperset(v), "a lowercase SHA-256 digest or null"),
    "count": (lambda v: type(v) is int and v >= 0, "an integer >= 0"),
    "bool": (lambda v: type(v) is bool, "a boolean"),
    "number": (lambda v: type(v) in (int, float) and math.isfinite(v), "a finite number"),
    "object": (lambda v: isinstance(v, dict), "an object"),
    "any": (lambda v: True, "anything"),
}
COUNTS = {k: "count" for k in ("total", "decoded", "abstained", "quarantined", "errored")}
#: Kinds of drift events; whether a field belongs to them.
DRIFT = {"missing_required_field": True, "additive_field": True, "duplicate_header_field": True, "unnamed_header_field": True, "unlabeled_extra_values": False, "invalid_utf8": False}
_PROJECTED = {
    "passed": "bool",
    "missing_required_fields": ["string"],
    "extra_fields": ["string"],
    "drift_status": {"none", "additive", "breaking"},
    "drift_events": ["object"],
    "missing_value_counts": {"*": "count"},
    "null_value_counts": {"*": "count"},
    "effective_content_sha256": "sha256",
    "row_count": "count",
}
SHAPES = {
    "schema_report": _PROJECTED | {"schema_version": "text", "required_fields": ["string"], "observed_fields": ["string"], "duplicate_row_ids": ["string"], "duplicate_row_id_count": "count", "failures": ["string"], "contract_sha256": "sha256"},
    "manifest": {
        **{k: "sha256" for k in ("batch_id", "run_id", "decoded_sha256", "rejects_sha256", "schema_report_sha256")},
        "counts": COUNTS,
        "tier_invalid": {"*": "count"},
        "identity": {
            "contract": {"decoder_version": "text", "raw_schema_version": "text"},
            "inputs": {"raw_content_sha256": "sha256", "brands": "sha256", "dimensions": {"*": "sha256"}},
            "configuration": ["object"],
            "implementation": {"*": "sha256"},
        },
        "schema": _PROJECTED,
    },
    "eval_report": {
        **{k: "sha256" for k in ("batch_id", "decoded_sha256", "rejects_sha256", "manifest_sha256", "evaluation_input_sha256", "gold_sha256")},
        "evaluation_version": "text",
        "coverage": "number",
        "category_accuracy": "number",
        "conditional_category_accuracy": "number",
        "counts": COUNTS,
        "tier_invalid": {"*": "count"},
        "flag": {"tp": "count", "fp": "count", "fn": "count", "precision": "number", "recall": "number"},
        "categories": {"*": {"precision": "number", "recall": "number", "f1": "number", "support": "count"}},
        "attributes": {"*": {"correct": "count", "total": "count", "accuracy": "number"}},
        "tiers": {"*": {"rows": "count", "gold_rows": "count", "gold_correct": "count"}},
        "confusion_pairs": [("string", "string", "count")],
        "gold": {"*": "count"},
    },
    "gate_report": {
        "gate_version": "text",
        "passed": "bool",
        "batch_id": "sha256",
        "artifact_binding": {"*": "sha256"},
        "checks": [{"name": "text", "actual": "number", "threshold": "number", "op": {">=", "<="}, "passed": "bool"}],
    },
    "comparison_report": {
        "comparison_version": "text",
        "baseline": {"batch_id": "sha256?"},
        "current": {"batch_id": "sha256?"},
        "counts": {k: "count" for k in ("added", "removed", "changed", "unchanged")},
        "partition": {f"{side}_{what}": "count" for side in ("baseline", "current", "union") for what in ("total", "identity")},
        "change_types": {k: "count" for k in ("classification", "tier", "winter_flag")},
        "transitions": {"*": "count"},
        "field_change_counts": {"*": "count"},
        "comparison_sha256": "sha256",
    },
}


class ShapeError(ValueError):
    """reason: malformed_ and the path of the value; detail: what was expected."""

    def __init__(self, path: str, detail: str) -> None:
        super().__init__(f"malformed_{path}: {detail}")
        self.reason, self.detail = f"malformed_{path}", detail


def check(value, shape, path: str) -> None:
    """Raises ShapeError at the first value, in the order of the shape, that does not fit."""
    if isinstance(shape, str):
        fits, wanted = SCALARS[shape]
        if not fits(value):
            raise ShapeError(path, f"expected {wanted}")
    elif isinstance(shape, set):
        if not isinstance(value, str) or value not in shape:
            raise ShapeError(path, f"expected one of {sorted(shape)}")
    elif isinstance(shape, dict):
        check(value, "object", path)
        named = {k.removesuffix("?"): (s, k.endswith("?")) for k, s in shape.items() if k != "*"}
        for k, (s, optional) in named.items():
            if k in value or not optional:
                check(value.get(k), s, f"{path}.{k}")
        for k in [k for k in value if k not in named] if "*" in shape else []:
            check(value[k], shape["*"], f"{path}.{k}")
    else:
        if not isinstance(value, list) or isinstance(shape, tuple) and len(value) != len(shape):
            raise ShapeError(path, "expected an array" + (f" of {len(shape)}" if isinstance(shape, tuple) else ""))
        for i, v in enumerate(value):
            check(v, shape[i] if isinstance(shape, tuple) else shape[0], f"{path}[{i}]")


def check_drift(events: list, path: str) -> None:
    """Each event has a known kind, and a field if and only if its kind has one."""
    for i, e in enumerate(events):
        check(e.get("kind"), set(DRIFT), f"{path}[{i}].kind")
        if set(e) != ({"kind", "field"} if DRIFT[e["kind"]] else {"kind"}):
            raise ShapeError(f"{path}[{i}]", "unexpected or missing event fields")
        if DRIFT[e["kind"]]:
            check(e["field"], "text", f"{path}[{i}].field")


def check_document(value, name: str) -> None:
    """A report against its shape; drift events and a comparison's own digest included."""
    check(value, SHAPES[name], name)
    for path, part in ((name, value), (f"{name}.schema", value.get("schema"))):
        if isinstance(part, dict) and "drift_events" in part:
            check_drift(part["drift_events"], f"{path}.drift_events")
    if name == "comparison_report":
        body = {k: v for k, v in value.items() if k != "comparison_sha256"}
        if set(value["counts"]) != set(SHAPES[name]["counts"]) or set(value["partition"]) != set(SHAPES[name]["partition"]):
            raise ShapeError(f"{name}.counts", "unexpected keys")
        if sha256_json(body) != value["comparison_sha256"]:
            raise ShapeError(f"{name}.comparison_sha256", "the digest of the report itself")
