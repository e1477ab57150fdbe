"""Checks of untrusted rows: each line is parsed once, however many fields are checked, and odd lines are told apart."""

import json

import pytest
from pyspark.sql import functions as F

from tierloom.operators import bundle
from tierloom.packs import WIDGETS
from tierloom.plans import queries as q

DIR = "/root/testdata/sf0.001"
GOOD = {"row_id": "1", "sku": "s", "category": "Fixing", "subcategory": "Bolts", "attributes": {"colour": "red"}, "is_winter_rated": True, "tier": "rules", "evidence": "e"}


@pytest.mark.parametrize("name, parsers", [("decoded_row_errors", {"try_parse_json(": 1, "from_json(": 1}), ("reject_row_errors", {"try_parse_json(": 1, "get_json_object(": 1})])
def test_a_line_is_parsed_once(spark, name, parsers):
    plan = q.QUERIES[name](spark, DIR)._jdf.queryExecution().analyzed().toString()
    assert {p: plan.count(p) for p in parsers} == parsers


def test_keys_of_one_small_file_are_dealt_to_all_cores(spark):
    df = q.decoded_row_errors(spark, DIR)
    assert df.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism > q.table(spark, DIR, "part").rdd.getNumPartitions()
    assert df.count() == 200


def test_odd_lines_are_told_apart(spark):
    text = json.dumps(GOOD)
    cases = [
        (text, []),
        (f" {text}\t", []),
        (None, ["malformed"]),
        ("", ["malformed"]),
        (text + "{}", ["malformed"]),
        (text[:-1], ["malformed"]),
        ('{"row_id": "1", "row_id": "2"}', ["malformed"]),
        ("null", ["not_object"]),
        (f"[{text}]", ["not_object"]),
        ("{}", [f"missing:{k}" for k in bundle.DECODED]),
        (json.dumps(GOOD | {"row_id": "", "sku": None, "attributes": [], "is_winter_rated": 0, "evidence": 1}), ["empty:row_id", "type:sku", "type:attributes", "type:is_winter_rated", "type:evidence"]),
        (json.dumps(GOOD | {"category": "Heavy", "attributes": {"colour": "green", "size": "S"}}), ["subcategory 'Bolts' not in category 'Heavy'", "bad colour: 'green'", "size not allowed for Heavy"]),
    ]
    df = spark.createDataFrame([(i, line) for i, (line, _) in enumerate(cases)], "i int, line string")
    got = df.select("i", bundle.decoded_errors(F.col("line"), WIDGETS).alias("e")).orderBy("i").collect()
    assert [r.e for r in got] == [e for _, e in cases]
