import dataclasses
import json
import threading

import pytest
from pyspark.sql import functions as F

from tierloom.operators import compare, contract, evaluate, gate, tiers
from tierloom.operators import adapter, bundle, shapes
from tierloom.operators.registry import Refusal, Registry, mutations
from tierloom.packs import PARTS
from tierloom.plans import pipeline
from tierloom.sources import files, jsonl, synth
from tierloom.streaming import incremental

PACK = dataclasses.replace(PARTS, brands=synth.BRANDS)
LOOSE = {"flag_precision": 0.5, "category_accuracy": 0.5, "coverage": 0.3, "error_rows": 0, "quarantine_rate": 0.2}


@pytest.fixture(scope="module")
def done(spark, tmp_path_factory):
    """A batch of 300 rows through all stages."""
    work = tmp_path_factory.mktemp("run")
    source = synth.generate(spark, 7, 300)
    raw = str(work / "raw")
    files.write_raw_csv(source, raw)
    code, out = pipeline.run(spark, raw, synth.gold_of(source), [tiers.RulesTier()], PACK, work, LOOSE)
    return work, raw, source, code, out


def test_source_is_deterministic_and_a_prefix(spark):
    a, b = (sorted(map(str, synth.generate(spark, 3, n).collect())) for n in (60, 90))
    assert set(a) < set(b) and a == sorted(map(str, synth.generate(spark, 3, 60).repartition(5).collect()))
    q = {r[0]: r[1] for r in synth.generate(spark, 42, 1200).groupBy("quality").count().collect()}
    assert 15 <= q["malformed"] <= 60 and 35 <= q["out_of_catalog"] <= 90


def test_run_loads_and_reconciles(spark, done):
    work, raw, source, code, out = done
    assert code == 0 and out["load"]["status"] == "loaded"
    n = out["manifest"]["counts"]
    assert n["total"] == 300 == sum(n[k] for k in ("decoded", "abstained", "quarantined", "errored")) and out["load"]["inserted"] == n["decoded"]
    assert out["reconciliation"]["passed"] and out["reconciliation"]["verified"] == n["decoded"]
    assert out["comparison"]["counts"] == {"added": 300, "removed": 0, "changed": 0, "unchanged": 0}
    assert out["evaluation"]["flag"]["precision"] >= 0.9
    assert json.loads((work / "gate_report.json").read_text())["passed"]


def test_same_batch_again_is_a_noop_and_new_thresholds_a_decision(spark, done):
    work, raw, source, _, first = done
    code, out = pipeline.run(spark, raw, synth.gold_of(source), [tiers.RulesTier()], PACK, work, LOOSE)
    assert code == 0 and out["load"]["reason"] == "already_loaded" and out["manifest"] == first["manifest"]
    code, out = pipeline.run(spark, raw, synth.gold_of(source), [tiers.RulesTier()], PACK, work, LOOSE | {"coverage": 0.31})
    assert code == 0 and out["load"]["reason"] == "decision_recorded" and out["load"]["inserted"] == 0
    assert Registry(spark, str(work / "registry")).listing().first()["decisions"] == 2


def parts(spark, done, thresholds=LOOSE):
    work, raw, source, _, out = done
    outcomes, gold = pipeline.read_outcomes(spark, work), synth.gold_of(source)
    return files.read_raw_csv(spark, raw), outcomes, gold, out["manifest"], out["evaluation"], gate.run_gate(out["evaluation"], out["manifest"], thresholds)


def test_superset_conflict_and_refusals(spark, done, tmp_path):
    rows, outcomes, gold, manifest, report, judged = parts(spark, done)
    r = Registry(spark, str(tmp_path / "r"))
    load = lambda **k: r.load(**({"raw": rows, "outcomes": outcomes, "gold": gold, "manifest": manifest, "report": report, "judged": judged, "thresholds": LOOSE, "pack": PACK} | k))
    strict = LOOSE | {"coverage": 1.0}
    failed = gate.run_gate(report, manifest, strict)
    assert not failed["passed"] and load(judged=failed, thresholds=strict)["reason"] == "gate_failed"
    assert load(thresholds={})["reason"] == "malformed_thresholds"
    assert load(raw=rows.where("row_id <> 'R0001'"))["reason"] == "source_partition_mismatch"
    assert load(raw=rows.withColumn("sku", F.concat("sku", F.lit("x"))))["reason"] == "source_sku_mismatch"
    assert load(outcomes=outcomes.unionByName(outcomes.limit(1)))["reason"] == "duplicate_row_id"
    assert load(report=report | {"coverage": 0.99})["reason"] in ("evaluation_replay_mismatch", "evidence_mismatch")
    assert load(judged=judged | {"batch_id": "x"})["reason"] == "gate_replay_mismatch"
    assert r.version()["seq"] == 0
    assert load()["status"] == "loaded"
    work = tmp_path / "more"
    source = synth.generate(spark, 7, 340)
    files.write_raw_csv(source, str(work / "raw"))
    bigger = pipeline.decode_stage(spark, str(work / "raw"), [tiers.RulesTier()], PACK, work)
    bigger_rows = {"raw": files.read_raw_csv(spark, str(work / "raw")), "outcomes": pipeline.read_outcomes(spark, work), "gold": synth.gold_of(source), "manifest": bigger}
    again = evaluate.evaluate(bigger_rows["outcomes"], bigger_rows["gold"], bigger, PACK)
    second = load(**bigger_rows, report=again, judged=gate.run_gate(again, bigger, LOOSE))
    assert second["status"] == "loaded" and 0 < second["inserted"] <= 40 and second["parent_batch_id"] == manifest["batch_id"]
    assert r.reconcile(manifest["batch_id"])["passed"] and r.reconcile(bigger["batch_id"])["passed"]
    naive = tmp_path / "naive"
    other = pipeline.decode_stage(spark, str(work / "raw"), [tiers.RulesTier("naive")], PACK, naive)
    rows2 = bigger_rows | {"outcomes": pipeline.read_outcomes(spark, naive), "manifest": other}
    e = evaluate.evaluate(rows2["outcomes"], rows2["gold"], other, PACK)
    assert load(**rows2, report=e, judged=gate.run_gate(e, other, LOOSE))["reason"] == "content_conflict"


def test_evaluation_counts(spark):
    shape = "struct<category:string,subcategory:string,attributes:struct<material:string,pack_count:int,position:string,size:string>,is_winter_rated:boolean,evidence:string>"
    a = (None, None, None, None)
    rows = [("a", "decoded", "rules", ("Braking", "Rotors", (None, 2, None, None), True, "")), ("b", "decoded", "rules", ("Apparel", "Gloves", a, True, "")), ("c", "abstained", None, None), ("d", "quarantined", None, None), ("e", "decoded", "model", ("Braking", "Rotors", a, True, ""))]
    outcomes = spark.createDataFrame(rows, f"row_id string, state string, tier string, decode {shape}")
    g = [("a", "decode", "Braking", "Rotors", a, True), ("b", "decode", "Braking", "Calipers", a, False), ("c", "decode", "Electrical", "Spark Plugs", a, True), ("d", "decode", "Braking", "Rotors", a, False), ("e", "abstain", None, None, None, None)]
    gold = spark.createDataFrame(g, "row_id string, expect string, category string, subcategory string, attributes struct<material:string,pack_count:int,position:string,size:string>, is_winter_rated boolean")
    manifest = {"batch_id": "x" * 12, "counts": {"total": 5, "decoded": 3, "abstained": 1, "quarantined": 1, "errored": 0}, "tier_invalid": {}}
    r = evaluate.evaluate(outcomes, gold, manifest, PACK)
    assert (r["flag"]["tp"], r["flag"]["fp"], r["flag"]["fn"]) == (1, 2, 1)
    assert r["category_accuracy"] == 0.25 and r["conditional_category_accuracy"] == 0.5 and r["coverage"] == 0.6
    assert r["categories"]["Braking"] == {"precision": 0.5, "recall": 0.3333, "f1": 0.4, "support": 3} and r["categories"]["Apparel"]["precision"] == 0.0
    assert r["attributes"]["pack_count"] == {"correct": 1, "total": 4, "accuracy": 0.25}
    assert r["tiers"] == {"model": {"rows": 1, "gold_rows": 0, "gold_correct": 0}, "rules": {"rows": 2, "gold_rows": 2, "gold_correct": 1}}
    assert r["confusion_pairs"] == [["Braking/Calipers", "Apparel/Gloves", 1], ["Braking/Rotors", "<quarantined>", 1], ["Electrical/Spark Plugs", "<abstained>", 1]]
    assert r["gold"] == {"total": 5, "decoded": 2, "abstained": 1, "quarantined": 1, "unexpected_decodes": 1, "correct_abstains": 0}
    assert "| Braking | 0.5" in evaluate.markdown(r)
    with pytest.raises(evaluate.EvaluationError):
        evaluate.evaluate(outcomes.where("row_id <> 'c'"), gold, manifest, PACK)
    with pytest.raises(evaluate.EvaluationError):
        evaluate.evaluate(outcomes, gold.withColumn("is_winter_rated", F.lit(None).cast("boolean")), manifest, PACK)


def test_gate_bounds_are_inclusive():
    manifest = {"batch_id": "b", "counts": {"total": 100, "errored": 0, "quarantined": 10}, "decoded_sha256": "d", "rejects_sha256": "r"}
    from tierloom.functions.digest import sha256_json

    report = {"batch_id": "b", "decoded_sha256": "d", "rejects_sha256": "r", "manifest_sha256": sha256_json(manifest), "gold_sha256": "", "evaluation_input_sha256": "", "flag": {"precision": 0.97}, "category_accuracy": 0.93, "coverage": 0.8}
    assert gate.run_gate(report, manifest, pipeline.THRESHOLDS)["passed"]
    assert not gate.run_gate(report | {"coverage": 0.7999}, manifest, pipeline.THRESHOLDS)["passed"]
    with pytest.raises(ValueError):
        gate.run_gate(report | {"batch_id": "other"}, manifest, pipeline.THRESHOLDS)
    for bad in ({}, pipeline.THRESHOLDS | {"x": 1}, pipeline.THRESHOLDS | {"coverage": float("nan")}, pipeline.THRESHOLDS | {"coverage": True}):
        with pytest.raises(ValueError):
            gate.check_thresholds(bad)


def test_differences_tell_absent_null_true_and_one_apart(spark):
    df = spark.range(1).select(F.lit("a").alias("row_id"), F.lit("decoded").alias("state"), F.lit(True).alias("t"), F.lit(1).alias("i"), F.lit(None).cast("string").alias("x"))
    a = df.select("row_id", "state", F.create_map(F.lit("v"), compare.json_text(F.col("t")), F.lit("x"), compare.json_text(F.col("x"))).alias("fields"))
    b = df.select("row_id", "state", F.create_map(F.lit("v"), compare.json_text(F.col("i"))).alias("fields"))
    d = compare.diff(a, b).first()
    assert d.status == "changed" and [tuple(c) for c in d.changes] == [("v", "true", "1"), ("x", "null", None)]


def written(tmp_path, text):
    p = tmp_path / "in.csv"
    p.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(p)


@pytest.mark.parametrize(
    "text,failures,drift",
    [
        ("row_id,sku,title\nR1,S,T\n", [], "none"),
        ("title,source,row_id,sku\nT,x,R1,S\nT,y,R2,\n", [], "additive"),
        ("row_id,sku\nR1,S\n", ["missing_required_fields"], "breaking"),
        ("row_id,sku,title\n", ["empty_input"], "breaking"),
        ("row_id,sku,title\nR1,S,T\nR1,S,T\n", ["duplicate_row_ids"], "none"),
        ("row_id,sku,title\nR1,,T\nR2,S\n", ["missing_required_values"], "none"),
        ("row_id,sku,title,sku\nR1,S,T,S\n", ["duplicate_header_fields"], "breaking"),
        ("row_id,sku,title,\nR1,S,T,\n", ["unnamed_header_fields"], "breaking"),
        ("row_id,sku,title\nR1,S,T,extra\n", ["unlabeled_extra_values"], "breaking"),
        (b"\xff\xfe", ["invalid_utf8"], "breaking"),
        (b"row_id,sku,title\nR1,\xff,T\n", ["invalid_utf8"], "breaking"),
        ('row_id,sku,title\nR1,"a,b"\n', ["missing_required_values"], "none"),
        ('row_id,sku,title\nR1,"a\nb ""c""","T,U"\nR2,,""\n', [], "none"),
        ("", ["missing_required_fields", "empty_input"], "breaking"),
    ],
)
def test_contract(spark, tmp_path, text, failures, drift):
    r = contract.inspect_csv(spark, written(tmp_path, text))
    assert (r["failures"], r["drift_status"], r["passed"]) == (failures, drift, not failures)
    if "R2,S\n" in str(text):
        assert r["missing_value_counts"]["title"] == 1 and r["null_value_counts"]["sku"] == 1


def test_short_row_with_a_quoted_comma_lacks_its_title(spark, tmp_path):
    r = contract.inspect_csv(spark, written(tmp_path, 'row_id,sku,title\nR1,"a,b"\nR2,S,\n'))
    assert r["missing_value_counts"]["title"] == 1 and r["null_value_counts"]["title"] == 1 and not r["passed"]


def test_files_of_other_column_order_are_read_by_their_own_headers(spark, tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    (folder / "a.csv").write_text("row_id,sku,title\nR1,s1,ROTORS\n")
    (folder / "b.csv").write_text("title,row_id,more,sku\nPADS X,R2,m,s2\n")
    r = contract.inspect_csv(spark, str(folder))
    assert r["passed"] and r["drift_status"] == "additive" and r["extra_fields"] == ["more"] and r["row_count"] == 2
    assert sorted(map(tuple, files.read_raw_csv(spark, str(folder)).collect())) == [("R1", "s1", "ROTORS"), ("R2", "s2", "PADS X")]
    one = written(tmp_path, "row_id,sku,title\nR2,s2,PADS X\nR1,s1,ROTORS\n")
    assert r["effective_content_sha256"] == contract.inspect_csv(spark, one)["effective_content_sha256"]
    (folder / "c.csv").write_text("row_id,title\nR3,T\n")
    r = contract.inspect_csv(spark, str(folder))
    assert r["failures"] == ["missing_required_fields"] and r["missing_required_fields"] == ["sku"]
    with pytest.raises(ValueError, match="sku"):
        files.read_raw_csv(spark, str(folder))


def test_duplicate_ids_are_counted_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(contract, "SAMPLE", 2)
    rows = "".join(f"R{i},S,T\nR{i},S,T\n" for i in range(5))
    r = contract.inspect_csv(spark, written(tmp_path, "row_id,sku,title\n" + rows))
    assert r["duplicate_row_id_count"] == 5 and r["duplicate_row_ids"] == ["R0", "R1"]


def test_content_digest_ignores_order_and_extra_columns(spark, tmp_path):
    a = contract.inspect_csv(spark, written(tmp_path, "row_id,sku,title\nR1,S,T\nR2,,U\n"))
    b = contract.inspect_csv(spark, written(tmp_path, "x,title,row_id,sku\n1,U,R2,\n2,T,R1,S\n"))
    assert a["effective_content_sha256"] == b["effective_content_sha256"]
    with pytest.raises(contract.ContractError):
        contract.validate_csv(spark, written(tmp_path, "row_id\n"))


def test_readers(spark, tmp_path):
    (tmp_path / "c.csv").write_text("sku,category,subcategory,position,pack_count,size,material,is_winter_rated\na 1,Braking,Rotors,front,2,,,0\nA1,Apparel,Gloves,,x,M,,1\n")
    rows = files.read_catalog(spark, str(tmp_path / "c.csv"), PACK).collect()
    assert len(rows) == 1 and rows[0].key == "A1" and rows[0].is_winter_rated and rows[0].attributes.pack_count is None and rows[0].attributes["size"] == "M"
    (tmp_path / "f.json").write_text(json.dumps({"a b": {"category": "Braking", "subcategory": "Rotors", "attributes": {"pack_count": 3}, "is_winter_rated": True}}))
    assert files.read_fixture(spark, tmp_path / "f.json", PACK).first().title == "A B"
    (tmp_path / "b.json").write_text(json.dumps([{"name": "Z", "aliases": ["Z"], "kind": "both"}, {"name": "A", "aliases": ["A"], "kind": "parts", "winter_bias": True}]))
    assert [b.name for b in files.read_brands(tmp_path / "b.json")] == ["A", "Z"]
    (tmp_path / "l.jsonl").write_text('{"row_id": "a"}\n\n[1]\n{bad\n{"x": 1}\n{"row_id": null}\n')
    assert [r.status for r in jsonl.read_untrusted(spark, str(tmp_path / "l.jsonl"), ["row_id"]).collect()] == ["ok", "not_object", "malformed", "missing_row_id", "ok"]


def test_mutated_registry_fails_reconciliation(spark, done, tmp_path):
    import shutil

    work, *_, out = done
    shutil.copytree(work / "registry", tmp_path / "r")
    r, batch = Registry(spark, str(tmp_path / "r")), out["manifest"]["batch_id"]
    assert r.reconcile(batch)["passed"] and r.reconcile("nope")["reasons"] == ["unknown_batch"]
    v = r.version()
    products = r.table("products", v)
    for change, reason in (
        (products.where("row_id <> 'R0002'").limit(products.count() - 1), "products_missing"),
        (products.withColumn("payload", F.concat("payload", F.lit(" "))), "payload_digest_mismatch"),
        (products.withColumn("payload_sha256", F.sha2("row_id", 256)), "products_payload"),
        (products.withColumn("batch_id", F.lit("other")), "products_provenance"),
    ):
        bad = v | {"tables": v["tables"] | {"products": []}}
        bad = r._stage(bad, "products", change)
        assert reason in r.reconcile(batch, bad)["reasons"]
    for name, change, reason in (
        ("batch_lineage", lambda t: t.withColumn("added", F.col("added") + 1), "lineage_added_mismatch"),
        ("batch_lineage", lambda t: t.withColumn("unchanged", F.lit(7).cast("long")), "lineage_unchanged_mismatch"),
        ("batch_lineage", lambda t: t.withColumn("parent_batch_id", F.lit("x")), "lineage_parent_batch_id_mismatch"),
        ("batch_lineage", lambda t: t.withColumn("comparison_sha256", F.lit("x")), "lineage_comparison_sha256_mismatch"),
        ("batch_lineage", lambda t: t.limit(0), "missing_lineage"),
        ("batch_outcomes", lambda t: t.where("row_id <> 'R0002'"), "outcome_digest_mismatch"),
        ("gate_decisions", lambda t: t.withColumn("batch_id", F.lit("other")), "decision_batch_link_mismatch"),
        ("gate_decisions", lambda t: t.withColumn("passed", F.lit(False)), "decision_not_passed"),
        ("products", lambda t: t.withColumn("payload", F.lit("[1]")), "product_schema_error"),
    ):
        bad = r._stage(v | {"tables": v["tables"] | {name: []}}, name, change(r.table(name, v)))
        assert reason in r.reconcile(batch, bad)["reasons"], reason
    assert r.outcomes(batch).count() == 300
    with pytest.raises(Refusal):
        r.outcomes(batch, r._stage(v | {"tables": v["tables"] | {"batch_outcomes": []}}, "batch_outcomes", r.table("batch_outcomes", v).limit(3)))
    bad = r._stage(v | {"tables": v["tables"] | {"gate_decisions": []}}, "gate_decisions", r.table("gate_decisions", v).withColumn("passed", ~F.col("passed")))
    assert {"decision_set_mismatch", "decision_id_mismatch"} <= set(r.reconcile(batch, bad)["reasons"])


def test_files_of_another_schema_and_a_held_lock_are_refused(spark, done, tmp_path):
    import fcntl
    import shutil

    work, *_ = done
    shutil.copytree(work / "registry", tmp_path / "r")
    r = Registry(spark, str(tmp_path / "r"), timeout=0.2)
    v = r.version()
    r.check(v)
    folder = tmp_path / "r" / v["tables"]["batches"][0]
    r.table("batches", v).withColumn("more", F.lit(1)).write.parquet(str(tmp_path / "other"))
    shutil.rmtree(folder)
    shutil.copytree(tmp_path / "other", folder)
    with pytest.raises(Refusal, match="registry_schema_mismatch"):
        r.check(v)
    with open(r.path / "LOCK", "w") as f:
        fcntl.flock(f, fcntl.LOCK_EX)
        with pytest.raises(Refusal, match="registry_locked"), r._lock():
            pass


def test_bundle_is_verified_as_it_lies(spark, done, tmp_path):
    import shutil

    work, *_ = done
    found = bundle.verify(spark, work, PACK)
    assert found["extra_fields"] == {"raw": [], "decoded": [], "rejects": []}

    def after(change):
        copy = tmp_path / "b"
        shutil.rmtree(copy, ignore_errors=True)
        shutil.copytree(work, copy, ignore=shutil.ignore_patterns("registry", "outcomes", "raw"))
        change(copy)
        with pytest.raises(Refusal) as e:
            bundle.verify(spark, copy, PACK)
        return e.value.reason

    def edit(name, **fields):
        def change(folder):
            doc = json.loads((folder / name).read_text())
            (folder / name).write_text(json.dumps(doc | fields))

        return change

    def line(folder_name, old, new):
        def change(folder):
            part = next(p for p in sorted((folder / folder_name).glob("part-*.json")) if p.stat().st_size)
            text = part.read_text().split("\n")
            text[0] = text[0].replace(old, new, 1)
            part.write_text("\n".join(text))
            for crc in (folder / folder_name).glob(".*.crc"):
                crc.unlink()

        return change

    assert after(lambda f: (f / "manifest.json").unlink()) == "missing_manifest"
    assert after(lambda f: (f / "manifest.json").write_text("{")) == "malformed_manifest"
    assert after(edit("gate_report.json", passed="yes")) == "malformed_gate_report.passed"
    assert after(edit("schema_report.json", drift_events=[{"kind": "additive_field"}])) == "malformed_schema_report.drift_events[0]"
    assert after(edit("comparison_report.json", transitions={"a_to_b": 1})) == "malformed_comparison_report.comparison_sha256"
    assert after(edit("eval_report.json", coverage=0.5)) == "binding_mismatch"
    assert after(line("decoded", '"is_winter_rated":', '"is_winter_rated":"x","was":')) == "schema_contract_failed"
    assert after(line("rejects", '"bucket":"', '"bucket":"lost')) == "schema_contract_failed"
    assert after(line("rejects", "{", "")) == "malformed_rejects"
    assert after(lambda f: shutil.rmtree(f / "decoded")) == "missing_decoded"


@pytest.mark.parametrize(
    ("value", "shape", "reason"),
    [
        (1, "bool", "malformed_x"),
        (True, "count", "malformed_x"),
        (float("nan"), "number", "malformed_x"),
        ("", "text", "malformed_x"),
        ("A" * 64, "sha256", "malformed_x"),
        ([1, "a"], ["string"], "malformed_x[0]"),
        ({"a": {"b": -1}}, {"a": {"*": "count"}}, "malformed_x.a.b"),
        ({}, {"a": "string"}, "malformed_x.a"),
        ([1], ("count", "count"), "malformed_x"),
        ("c", {"a", "b"}, "malformed_x"),
    ],
)
def test_shapes(value, shape, reason):
    with pytest.raises(shapes.ShapeError) as e:
        shapes.check(value, shape, "x")
    assert e.value.reason == reason
    shapes.check({"a": [1], "extra": None}, {"a": ["count"], "b?": "string"}, "x")


def test_answers(spark):
    good = {"category": "Braking", "subcategory": "Rotors", "attributes": {"pack_count": 2}, "is_winter_rated": False}
    answers = [json.dumps(good), json.dumps(good | {"abstain": True}), '{"abstain": true}', "no json", "[]", json.dumps(good | {"is_winter_rated": "no"}), json.dumps(good | {"attributes": []}), None]
    plain = [adapter.parse(a) for a in answers]
    assert plain == [good] + [None] * 7
    got = spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "i int, a string").select("i", adapter.parsed(F.col("a"), PACK).alias("c")).orderBy("i").collect()
    assert [r.c is not None for r in got] == [p is not None for p in plain] and got[0].c.attributes.pack_count == 2
    text = adapter.prompt("BRK ROTORS", PACK)
    assert "BRK ROTORS" in text and "Rotors" in text and "pack_count" in text

    class Block:
        def __init__(self, kind, text):
            self.type, self.text = kind, text

    assert adapter.first_text([Block("thinking", "a"), Block("text", "b")]) == "b" and adapter.first_text([]) == ""

    def ask(question):
        if "FAIL" in question:
            raise OSError("down")
        return answers[0]

    tier = adapter.AnswerTier(ask, PACK, "stub")
    raw = spark.createDataFrame([("R1", "s", "ROTORS OF A NAME"), ("R2", "s", "FAIL ROTORS")], files.RAW)
    out = {r.row_id: r for r in tiers.run_batch(raw, [tiers.PythonTier(tier)], PACK).collect()}
    assert out["R1"].state == "decoded" and out["R1"].decode.evidence == "model:stub" and out["R2"].state == "abstained" and not tier.identity()["deterministic"]


def test_mutations(spark):
    s = "row_id string, payload_sha256 string, origin_batch_id string"
    a = spark.createDataFrame([("a", "1", "x"), ("b", "1", "x"), ("c", "1", "x")], s)
    b = spark.createDataFrame([("a", "2", "x"), ("b", "1", "y"), ("d", "1", "x")], s)
    assert tuple(mutations(a, b).first()) == (1, 1, 1, 1)


def test_concurrent_loads_insert_once(spark, done, tmp_path):
    rows, outcomes, gold, manifest, report, judged = parts(spark, done)
    r, got = Registry(spark, str(tmp_path / "r")), []
    run = lambda: got.append(r.load(rows, outcomes, gold, manifest, report, judged, LOOSE, PACK)["status"])
    threads = [threading.Thread(target=run) for _ in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(got) == ["loaded", "noop", "noop", "noop"]


def test_stream_of_files(spark, tmp_path):
    raw, seen = tmp_path / "in", []
    for n in (1, 2):
        files.write_raw_csv(synth.generate(spark, n, 20).coalesce(1), str(raw / f"d{n}"))
    stream = incremental.read_stream(spark, str(raw / "*"), files_per_batch=1)
    q = incremental.start(stream, lambda df, n: seen.append(tiers.run_batch(df, [tiers.RulesTier()], PACK).count()), str(tmp_path / "cp"), once=True)
    q.awaitTermination()
    assert sorted(seen) == [20, 20]
