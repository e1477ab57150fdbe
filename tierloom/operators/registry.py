"""An append-only registry of approved batches, on versioned Parquet.

A version is a JSON file that names, for each table, the folders that make it up. A load stages new folders, checks the staged
tables, writes the next version file and moves the pointer CURRENT in one rename, all under an exclusive lock; readers pin the
version they opened. Folders bear the batch they were staged for, so that a batch's rows are read alone. Nothing is updated in
place: a table's latest row per key (by seq) counts. Whatever a load finds
wrong it answers with a refusal, and staged folders that no version names are never read.
"""

from __future__ import annotations

import contextlib
import fcntl
import json
import os
import time
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime
from pathlib import Path

import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.digest import set_digest, sha256_json
from ..packs import Pack
from ..sources.jsonl import strict_json
from . import compare, evaluate, gate
from .tiers import small

SCHEMAS = {
    "batches": "batch_id string, seq long, run_id string, inserted long, loaded_at string",
    "products": "row_id string, sku string, payload string, payload_sha256 string, batch_id string",
    "batch_evidence": "batch_id string, manifest string, eval_report string, gate_report string, thresholds string",
    "gate_decisions": "decision_id string, batch_id string, passed boolean, thresholds_sha256 string, report_sha256 string, seq long",
    "batch_lineage": "batch_id string, parent_batch_id string, added long, removed long, unchanged long, snapshot_sha256 string, comparison_sha256 string",
    "batch_rows": "batch_id string, row_id string, payload_sha256 string, origin_batch_id string",
    "batch_outcomes": "batch_id string, row_id string, state string, payload string",
    "load_reconciliation": "batch_id string, seq long, passed boolean, expected long, verified long, snapshot_sha256 string, outcomes_sha256 string, decisions long, decisions_sha256 string",
}
#: The columns that a digest covers.
SNAPSHOT, OUTCOME, DECISION = ["row_id", "payload_sha256", "origin_batch_id"], ["row_id", "state", "payload"], ["decision_id", "passed", "thresholds_sha256", "report_sha256"]
#: Stands in a folder's name for rows that are of no single batch.
ANY = "any"


def refused(reason: str, batch_id: str | None = None, **details) -> dict:
    return {"status": "refused", "reason": reason, "inserted": 0, "batch_id": batch_id} | ({"details": details} if details else {})


class Refusal(Exception):
    def __init__(self, reason: str, **details) -> None:
        super().__init__(reason)
        self.reason, self.details = reason, details


def mutations(expected: DataFrame, held: DataFrame) -> DataFrame:
    """One row: missing, extra, payload, provenance. Both sides: row_id, payload_sha256, origin_batch_id; one full outer join."""
    e = expected.select("row_id", F.col("payload_sha256").alias("p0"), F.col("origin_batch_id").alias("o0"), F.lit(True).alias("in0"))
    h = held.select("row_id", F.col("payload_sha256").alias("p1"), F.col("origin_batch_id").alias("o1"), F.lit(True).alias("in1"))
    j = e.join(h, "row_id", "full_outer")
    both = F.col("in0").isNotNull() & F.col("in1").isNotNull()
    return j.agg(
        F.count_if(F.col("in1").isNull()).alias("missing"),
        F.count_if(F.col("in0").isNull()).alias("extra"),
        F.count_if(both & ~F.col("p0").eqNullSafe(F.col("p1"))).alias("payload"),
        F.count_if(both & ~F.col("o0").eqNullSafe(F.col("o1"))).alias("provenance"),
    )


def with_parent(batches: DataFrame, order: str) -> DataFrame:
    """Adds parent_batch_id, the batch before in order. One row a batch, so the one window partition is as small as the list of batches."""
    return batches.withColumn("parent_batch_id", F.lag("batch_id").over(W.orderBy(order)))


def gaps(a: DataFrame, b: DataFrame, key: str, names: tuple[str, str]) -> DataFrame:
    """side, key: the keys of each side that the other lacks, once each."""
    left = a.select(key).distinct().join(b.select(key), key, "left_anti").select(F.lit(names[0]).alias("side"), key)
    return left.unionByName(b.select(key).distinct().join(a.select(key), key, "left_anti").select(F.lit(names[1]).alias("side"), key))


def value_mismatches(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, fields: the columns in which rows of one key differ (null differs from any value)."""
    other = small(b.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in columns]))
    fields = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(c)) for c in columns]))
    return a.select(key, *columns).join(other, F.col(key) == F.col("_key")).select(key, fields.alias("fields")).where(F.size("fields") > 0)


def appended(new: DataFrame, held: DataFrame, key: str = "row_id") -> DataFrame:
    """The rows of new whose key is not held."""
    return new.join(held.select(key), key, "left_anti")


def conflicts(new: DataFrame, held: DataFrame, key: str = "row_id", digest: str = "payload_sha256") -> DataFrame:
    """The keys that are held with another content."""
    return new.select(key, F.col(digest).alias("_new")).join(held.select(key, F.col(digest).alias("_old")), key).where("_new <> _old").select(key)


def sample(keys: DataFrame, key: str = "row_id", most: int = 20) -> DataFrame:
    """The first keys in the order of their text, for a report."""
    return keys.orderBy(F.col(key).cast("string")).limit(most)


def snapshot_after(parent: DataFrame, new: DataFrame, batch_id, key: str = "row_id") -> DataFrame:
    """The parent's snapshot and the rows that new adds to it, whose origin is batch_id. Both: key, payload_sha256; parent: origin_batch_id."""
    own = appended(new, parent, key).select(key, "payload_sha256", F.lit(batch_id).alias("origin_batch_id"))
    return parent.select(key, "payload_sha256", "origin_batch_id").unionByName(own)


def first_origin(rows: DataFrame, key: str, batch: Column, order: str) -> DataFrame:
    """key, origin_batch_id: the first batch, in order, that has the key."""
    return rows.groupBy(key).agg(F.min_by(batch, order).alias("origin_batch_id"))


def latest(df: DataFrame, by: str, value: str, *order: str) -> DataFrame:
    """by, latest: the value of the last row, in order, of each group."""
    return df.groupBy(by).agg(F.max_by(value, F.struct(*order)).alias("latest"))


def lineage_counts(parent: DataFrame, incoming: DataFrame, key: str = "row_id") -> DataFrame:
    """One row: added, removed, unchanged, conflicts (kept keys of another content). Both sides: key, payload_sha256."""
    a = parent.select(key, F.col("payload_sha256").alias("p0"), F.lit(True).alias("in0"))
    b = incoming.select(key, F.col("payload_sha256").alias("p1"), F.lit(True).alias("in1"))
    both = F.col("in0").isNotNull() & F.col("in1").isNotNull()
    return a.join(b, key, "full_outer").agg(
        F.count_if(F.col("in0").isNull()).alias("added"),
        F.count_if(F.col("in1").isNull()).alias("removed"),
        F.count_if(both).alias("unchanged"),
        F.count_if(both & ~F.col("p0").eqNullSafe(F.col("p1"))).alias("conflicts"),
    )


def replayed(before: DataFrame, after: DataFrame) -> dict:
    """Status counts and transitions between two batches' outcomes (row_id, state, payload)."""
    sides = [df.select("row_id", "state", F.create_map(F.lit("payload"), F.col("payload")).alias("fields")) for df in (before, after)]
    d = compare.diff(*sides)
    return {"counts": compare.status_counts(d).first().asDict(), "transitions": {r[0]: r[1] for r in sorted(compare.transition_counts(d).collect())}}


def decision_key(batch: Column) -> Column:
    """The id of a decision that is bound to the batch: the digest of the canonical JSON of what it says."""
    return F.sha2(F.to_json(F.struct(batch.alias("batch_id"), "passed", "report_sha256", "thresholds_sha256")), 256)


def audit_decisions(decisions: DataFrame, batch_id: str) -> DataFrame:
    """decision_id, reason: what is wrong with a batch's decisions, those that were linked to another batch included.

    id_mismatch, not_passed: of its own; foreign: another batch's, whose id binds this one. One pass over all decisions.
    """
    own = F.col("batch_id") == batch_id
    bound = F.col("decision_id") == decision_key(F.lit(batch_id))
    found = F.array(F.when(own & ~bound, "id_mismatch"), F.when(own & ~F.coalesce("passed", F.lit(False)), "not_passed"), F.when(~own & bound, "foreign"))
    return decisions.select("decision_id", F.explode(F.array_compact(found)).alias("reason"))


def product_errors(payload: Column) -> Column:
    """What a stored payload's JSON breaks (an empty array: nothing)."""
    v = strict_json(payload)
    kind = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    whole = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    return F.array_compact(
        F.array(
            F.when(v.isNull(), "payload_malformed").when(~whole, "payload_not_object"),
            F.when(whole & ~F.coalesce(kind("$.attributes").startswith("OBJECT"), F.lit(False)), "attributes_not_object"),
            F.when(whole & ~F.coalesce(kind("$.is_winter_rated") == "BOOLEAN", F.lit(False)), "is_winter_rated_out_of_domain"),
        )
    )


def measurement_mismatches(stored: dict, manifest: dict, report: dict) -> list[str]:
    """Names of the measured evidence in which a batch that is loaded again differs from what is stored. Policy is not measured."""
    names = ("run_id", "decoded_sha256", "rejects_sha256", "schema_report_sha256", "counts")
    old, then = json.loads(stored["manifest"]), json.loads(stored["eval_report"])
    out = [n for n in names if sha256_json(old.get(n)) != sha256_json(manifest.get(n))]
    out += ["gold_sha256"] * (then.get("gold_sha256") != report.get("gold_sha256"))
    out += ["manifest"] * (sha256_json(old) != sha256_json(manifest)) + ["eval_report"] * (sha256_json(then) != sha256_json(report))
    return out


def report_of(batches: DataFrame, *sides: DataFrame, on: str = "batch_id", zeros: tuple[str, ...] = ()) -> DataFrame:
    """batches with each side's columns, left joined on a key that is unique there; zeros: counts that are 0 where a side lacks the key."""
    for side in sides:
        batches = batches.join(small(side), on, "left")
    return batches.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in zeros})


def payload(pack: Pack) -> Column:
    """A decoded outcome's content as JSON: what must not change once it is loaded."""
    d = F.col("decode")
    return F.to_json(F.struct("row_id", "sku", *[d[k].alias(k) for k in ("category", "subcategory", "attributes", "is_winter_rated")], "tier", d["evidence"].alias("evidence")))


class Registry:
    """The registry under a folder of a local or mounted shared file system."""

    def __init__(self, spark: SparkSession, path: str, timeout: float = 30.0) -> None:
        self.spark, self.path, self.timeout = spark, Path(path), timeout

    # -- versions

    def version(self) -> dict:
        """The pinned version: seq and the folders of each table."""
        try:
            name = (self.path / "CURRENT").read_text()
        except FileNotFoundError:
            return {"seq": 0, "tables": {t: [] for t in SCHEMAS}}
        v = json.loads((self.path / "versions" / name).read_text())
        if set(v["tables"]) != set(SCHEMAS):
            raise Refusal("registry_schema_mismatch")
        return v

    def table(self, name: str, version: dict | None = None, *batches: str) -> DataFrame:
        """A table of the pinned version; batches: only what was staged for these, whose folders alone are read."""
        folders = (version or self.version())["tables"][name]
        folders = [f for f in folders if not batches or f.split("/")[2] in (*batches, ANY)]
        if not folders:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(*[str(self.path / f) for f in folders])

    def check(self, version: dict) -> None:
        """Refuses a registry whose files do not have exactly the columns of its tables, in order."""
        for name, folders in version["tables"].items():
            want = [f.split()[0] for f in SCHEMAS[name].split(", ")]
            for folder in folders:
                part = next(iter(sorted((self.path / folder).glob("*.parquet"))), None)
                if part is None or pq.read_schema(part).names != want:
                    raise Refusal("registry_schema_mismatch", table=name, folder=folder)

    @contextlib.contextmanager
    def _lock(self) -> Iterator[None]:
        """The writer's lock; gives up after `timeout` seconds."""
        self.path.mkdir(parents=True, exist_ok=True)
        until = time.monotonic() + self.timeout
        with open(self.path / "LOCK", "w") as f:
            while True:
                try:
                    fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
                    break
                except BlockingIOError:
                    if time.monotonic() >= until:
                        raise Refusal("registry_locked", seconds=self.timeout) from None
                    time.sleep(0.05)
            yield

    def _stage(self, version: dict, name: str, df: DataFrame, batch_id: str = ANY) -> dict:
        folder = f"tables/{name}/{batch_id}/{uuid.uuid4().hex}"
        df.select(*[f.split()[0] for f in SCHEMAS[name].split(", ")]).write.parquet(str(self.path / folder))
        return version | {"tables": version["tables"] | {name: [*version["tables"][name], folder]}}

    def _rows(self, name: str, *rows: tuple) -> DataFrame:
        return self.spark.createDataFrame(list(rows), SCHEMAS[name])

    def _commit(self, version: dict, seq: int) -> None:
        name = f"{seq}-{uuid.uuid4().hex}.json"
        (self.path / "versions").mkdir(exist_ok=True)
        (self.path / "versions" / name).write_text(json.dumps(version | {"seq": seq}, indent=1))
        draft = self.path / f"CURRENT-{uuid.uuid4().hex}"
        draft.write_text(name)
        os.replace(draft, self.path / "CURRENT")

    # -- verification

    def _verify(self, raw: DataFrame, outcomes: DataFrame, gold: DataFrame, manifest: dict, report: dict, judged: dict, thresholds: dict, pack: Pack) -> None:
        """Raises Refusal at the first thing that does not hold, in a fixed order."""
        try:
            gate.check_thresholds(thresholds)
        except ValueError as e:
            raise Refusal("malformed_thresholds", error=str(e)) from e
        if not judged.get("passed") or not all(c["passed"] for c in judged.get("checks", [])):
            raise Refusal("gate_failed", failed=[c["name"] for c in judged.get("checks", []) if not c["passed"]])
        for name, df in (("outcomes", outcomes), ("raw", raw)):
            if evaluate.duplicates(df).limit(1).count():
                raise Refusal("duplicate_row_id", artifact=name)
        if "title" in gold.columns and not value_mismatches(gold, raw, "row_id", ["title"]).isEmpty():
            raise Refusal("gold_title_mismatch")
        a, b = raw.select("row_id", "sku", "title"), outcomes.select("row_id", F.col("sku").alias("o_sku"), F.col("title").alias("o_title"), F.lit(True).alias("there"))
        j = a.withColumn("here", F.lit(True)).join(b, "row_id", "full_outer")
        both = F.col("here").isNotNull() & F.col("there").isNotNull()
        off = j.agg(
            F.count_if(~both).alias("partition"),
            F.count_if(both & ~F.col("sku").eqNullSafe(F.col("o_sku"))).alias("sku"),
            F.count_if(both & ~F.col("title").eqNullSafe(F.col("o_title"))).alias("title"),
        ).first()
        for name in ("partition", "sku", "title"):
            if off[name]:
                raise Refusal(f"source_{name}_mismatch", rows=off[name])
        if not evaluate.missing_gold(gold, raw).isEmpty():
            raise Refusal("gold_row_missing_from_source")
        counts = outcomes.groupBy("state").count().collect()
        if {r["state"]: r["count"] for r in counts} != {k: v for k, v in manifest["counts"].items() if k != "total" and v}:
            raise Refusal("count_mismatch")
        try:
            again = evaluate.evaluate(outcomes, gold, manifest, pack, report.get("gold_sha256", ""))
            rejudged = gate.run_gate(report, manifest, thresholds)
        except ValueError as e:
            raise Refusal("evidence_mismatch", error=str(e)) from e
        if sha256_json(again) != sha256_json(report):
            raise Refusal("evaluation_replay_mismatch")
        if sha256_json(rejudged) != sha256_json(judged):
            raise Refusal("gate_replay_mismatch")

    # -- loading

    def load(self, raw: DataFrame, outcomes: DataFrame, gold: DataFrame, manifest: dict, report: dict, judged: dict, thresholds: dict, pack: Pack) -> dict:
        """Append an approved batch. outcomes must be read from storage (a frame that Spark would compute anew may differ)."""
        batch_id = manifest.get("batch_id")
        try:
            self._verify(raw, outcomes, gold, manifest, report, judged, thresholds, pack)
            with self._lock():
                return self._load(outcomes, manifest, report, judged, thresholds, pack)
        except Refusal as r:
            return refused(r.reason, batch_id, **r.details)

    def _decision(self, batch_id: str, judged: dict, thresholds: dict, report: dict) -> dict:
        body = {"batch_id": batch_id, "passed": judged["passed"], "thresholds_sha256": sha256_json(thresholds), "report_sha256": sha256_json(report)}
        return {"decision_id": sha256_json(body)} | body

    def _load(self, outcomes, manifest, report, judged, thresholds, pack) -> dict:
        v, batch_id = self.version(), manifest["batch_id"]
        self.check(v)
        seq = v["seq"] + 1
        decision = self._decision(batch_id, judged, thresholds, report)
        known = self.table("batch_evidence", v, batch_id).where(F.col("batch_id") == batch_id).collect()
        if known:
            if mismatches := measurement_mismatches(known[0].asDict(), manifest, report):
                raise Refusal("batch_evidence_mismatch", mismatches=mismatches)
            state = self.reconcile(batch_id, v)
            if not state["passed"]:
                raise Refusal("existing_batch_fails_reconciliation", reasons=state["reasons"])
            if not self.table("gate_decisions", v, batch_id).where(F.col("decision_id") == decision["decision_id"]).isEmpty():
                return {"status": "noop", "reason": "already_loaded", "inserted": 0, "batch_id": batch_id}
            v = self._stage(v, "gate_decisions", self._rows("gate_decisions", (decision["decision_id"], batch_id, decision["passed"], decision["thresholds_sha256"], decision["report_sha256"], seq)), batch_id)
            v = self._anchor(v, batch_id, seq, state["expected"])
            self._commit(v, seq)
            return {"status": "noop", "reason": "decision_recorded", "inserted": 0, "batch_id": batch_id}
        last = self.table("batches", v).orderBy(F.desc("seq")).limit(1).collect()
        parent = last[0]["batch_id"] if last else None
        if parent is not None and not (state := self.reconcile(parent, v))["passed"]:
            raise Refusal("parent_fails_reconciliation", reasons=state["reasons"])
        new = outcomes.where("state = 'decoded'").select("row_id", "sku", payload(pack).alias("payload"))
        new = new.withColumn("payload_sha256", F.sha2("payload", 256))
        held = self.table("products", v)
        if listed := [r[0] for r in sample(conflicts(new, held)).collect()]:
            raise Refusal("content_conflict", row_ids=listed)
        v = self._stage(v, "products", appended(new, held).select("row_id", "sku", "payload", "payload_sha256", F.lit(batch_id).alias("batch_id")), batch_id)
        inserted = self.spark.read.parquet(str(self.path / v["tables"]["products"][-1])).count()
        now = datetime.now(UTC).isoformat()
        v = self._stage(v, "batches", self._rows("batches", (batch_id, seq, manifest.get("run_id"), inserted, now)), batch_id)
        v = self._stage(v, "batch_evidence", self._rows("batch_evidence", (batch_id, *(json.dumps(x, sort_keys=True) for x in (manifest, report, judged, thresholds)))), batch_id)
        v = self._stage(v, "gate_decisions", self._rows("gate_decisions", (decision["decision_id"], batch_id, decision["passed"], decision["thresholds_sha256"], decision["report_sha256"], seq)), batch_id)
        state = F.when(F.col("state") == "decoded", payload(pack)).otherwise(F.to_json(F.struct("row_id", "sku", "title", F.col("state").alias("bucket"), "reason")))
        v = self._stage(v, "batch_outcomes", outcomes.select(F.lit(batch_id).alias("batch_id"), "row_id", "state", state.alias("payload")), batch_id)
        snapshot = self.table("products", v).select("row_id", "payload_sha256", F.col("batch_id").alias("origin_batch_id"))
        v = self._stage(v, "batch_rows", snapshot.select(F.lit(batch_id).alias("batch_id"), "*"), batch_id)
        total = self.table("batch_rows", v, batch_id).count()
        v = self._stage(v, "batch_lineage", self._rows("batch_lineage", tuple(self._lineage(batch_id, v).values())), batch_id)
        v = self._anchor(v, batch_id, seq, total)
        state = self.reconcile(batch_id, v)
        if not state["passed"]:
            raise Refusal("staged_reconciliation_failed", reasons=state["reasons"])
        self._commit(v, seq)
        return {"status": "loaded", "reason": None, "inserted": inserted, "batch_id": batch_id, "parent_batch_id": parent}

    def _anchor(self, v: dict, batch_id: str, seq: int, expected: int) -> dict:
        """Stage a reconciliation row that ties the batch's rows, outcomes and decisions to digests."""
        rows, decisions, outcomes = (self.table(t, v, batch_id).where(F.col("batch_id") == batch_id) for t in ("batch_rows", "gate_decisions", "batch_outcomes"))
        made = (batch_id, seq, True, expected, rows.count(), set_digest(rows, SNAPSHOT), set_digest(outcomes, OUTCOME), decisions.count(), set_digest(decisions, DECISION))
        return self._stage(v, "load_reconciliation", self._rows("load_reconciliation", made), batch_id)

    # -- auditing

    def _lineage(self, batch_id: str, v: dict) -> dict:
        """A batch's lineage row, derived anew from the order of batches, the snapshots and the outcomes that are stored."""
        order = [r["batch_id"] for r in self.table("batches", v).orderBy("seq").select("batch_id").collect()]  # a row a batch
        at = order.index(batch_id)
        parent = order[at - 1] if at else None
        of = lambda t, b: self.table(t, v, b).where(F.col("batch_id") == b) if b is not None else self.spark.createDataFrame([], SCHEMAS[t])
        outcomes = of("batch_outcomes", batch_id)
        incoming = outcomes.where("state = 'decoded'").select("row_id", F.sha2("payload", 256).alias("payload_sha256"))
        counts = lineage_counts(of("batch_rows", parent), incoming).first()
        return {
            "batch_id": batch_id,
            "parent_batch_id": parent,
            **{k: counts[k] for k in ("added", "removed", "unchanged")},
            "snapshot_sha256": set_digest(snapshot_after(of("batch_rows", parent), incoming, batch_id), SNAPSHOT),
            "comparison_sha256": sha256_json(replayed(of("batch_outcomes", parent), outcomes)),
        }

    def reconcile(self, batch_id: str, version: dict | None = None) -> dict:
        """Read-only audit of a batch: anchors, snapshot against products, stored payloads, decisions, and lineage derived anew."""
        v = version or self.version()
        own = F.col("batch_id") == batch_id
        anchors = self.table("load_reconciliation", v, batch_id).where(own).orderBy(F.desc("seq")).limit(1).collect()
        if not anchors:
            return {"passed": False, "batch_id": batch_id, "reasons": ["unknown_batch"], "expected": 0, "verified": 0}
        anchor, reasons = anchors[0], []
        rows = self.table("batch_rows", v, batch_id).where(own).select(*SNAPSHOT)
        order = [r["batch_id"] for r in self.table("batches", v).orderBy("seq").select("batch_id").collect()]  # a row a batch
        if batch_id not in order:
            return {"passed": False, "batch_id": batch_id, "reasons": ["unknown_batch"], "expected": anchor["expected"], "verified": 0}
        until = order[: order.index(batch_id) + 1]
        products = self.table("products", v, *until)
        later = set(order) - set(until)
        held = products.where(~F.col("batch_id").isin(*later)) if later else products
        off = mutations(rows, held.select("row_id", "payload_sha256", F.col("batch_id").alias("origin_batch_id"))).first().asDict()
        reasons += [f"products_{k}" for k, n in off.items() if n]
        found = products.agg(F.count_if(F.sha2("payload", 256) != F.col("payload_sha256")).alias("digest"), F.count_if(F.size(product_errors(F.col("payload"))) > 0).alias("schema")).first()
        reasons += ["payload_digest_mismatch"] * bool(found["digest"]) + ["product_schema_error"] * bool(found["schema"])
        if not products.groupBy("row_id").count().where("count > 1").isEmpty():
            reasons.append("duplicate_products")
        if set_digest(rows, SNAPSHOT) != anchor["snapshot_sha256"]:
            reasons.append("snapshot_digest_mismatch")
        if set_digest(self.table("batch_outcomes", v, batch_id).where(own), OUTCOME) != anchor["outcomes_sha256"]:
            reasons.append("outcome_digest_mismatch")
        decisions = self.table("gate_decisions", v)
        if not (n := decisions.where(own).count()):
            reasons.append("missing_gate_decision")
        if n != anchor["decisions"] or set_digest(decisions.where(own), DECISION) != anchor["decisions_sha256"]:
            reasons.append("decision_set_mismatch")
        wrong = {"id_mismatch": "decision_id_mismatch", "not_passed": "decision_not_passed", "foreign": "decision_batch_link_mismatch"}
        reasons += sorted(wrong[r["reason"]] for r in audit_decisions(decisions, batch_id).select("reason").distinct().collect())
        lineage = [r.asDict() for r in self.table("batch_lineage", v, batch_id).where(own).collect()]
        if len(lineage) != 1:
            reasons.append("missing_lineage")
        else:
            again = self._lineage(batch_id, v)
            reasons += [f"lineage_{k}_mismatch" for k in again if again[k] != lineage[0][k]]
            if lineage[0]["snapshot_sha256"] != anchor["snapshot_sha256"]:
                reasons.append("lineage_anchor_mismatch")
        n = rows.count()
        return {"passed": not reasons and n == anchor["expected"], "batch_id": batch_id, "reasons": reasons, "expected": anchor["expected"], "verified": n, "mutations": off}

    def outcomes(self, batch_id: str, version: dict | None = None) -> DataFrame:
        """row_id, state, payload of a batch, replayed only if they still have the digest they were anchored with."""
        v = version or self.version()
        own = F.col("batch_id") == batch_id
        anchor = self.table("load_reconciliation", v, batch_id).where(own).orderBy(F.desc("seq")).limit(1).collect()
        found = self.table("batch_outcomes", v, batch_id).where(own).select(*OUTCOME)
        if not anchor or set_digest(found, OUTCOME) != anchor[0]["outcomes_sha256"]:
            raise Refusal("outcome_digest_mismatch", batch_id=batch_id)
        return found

    def listing(self) -> DataFrame:
        """Batches in load order with parent, inserted rows, last reconciliation and number of decisions."""
        v = self.version()
        decisions = self.table("gate_decisions", v).groupBy("batch_id").agg(F.count("*").alias("decisions"))
        last = self.table("load_reconciliation", v).groupBy("batch_id").agg(F.max_by(F.struct("passed", "expected", "verified"), "seq").alias("r"))
        lineage = self.table("batch_lineage", v).select("batch_id", "parent_batch_id", "added", "removed", "unchanged")
        j = report_of(self.table("batches", v), lineage, last, decisions, zeros=("decisions",))
        return j.select("batch_id", "seq", "parent_batch_id", "inserted", "added", "removed", "unchanged", "r.passed", "r.verified", "decisions").orderBy("seq")
