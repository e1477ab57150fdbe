"""JSON lines: trusted rows by schema, untrusted rows by variant."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import once

_END = '"~end of the line~"'


def strict_json(line: Column) -> Column:
    """The line's one JSON value as a variant; null if it is none or has more behind it (which the parser alone lets pass)."""
    alone = lambda v: F.try_variant_get(v, "$[1]", "string") == _END.strip('"')
    return once(F.try_parse_json(F.concat(F.lit("["), line, F.lit(f",{_END}]"))), lambda v: F.when(alone(v), F.try_variant_get(v, "$[0]", "variant")))


def value_status(v: Column, required: Sequence[str]) -> Column:
    """object_status() of a line whose strict_json() is v."""
    out = F.when(v.isNull(), "malformed").when(~F.schema_of_variant(v).startswith("OBJECT"), "not_object")
    for f in required:
        out = out.when(F.try_variant_get(v, f"$.{f}", "variant").isNull(), f"missing_{f}")
    return out.otherwise("ok")


def object_status(line: Column, required: Sequence[str]) -> Column:
    """ok, malformed (no JSON), not_object, or missing_<field> for a line of untrusted JSON."""
    return once(strict_json(line), lambda v: value_status(v, required))


def read_untrusted(spark: SparkSession, path: str, required: Sequence[str]) -> DataFrame:
    """line, v (variant), status of every line that is not blank."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.col("value").alias("line"), strict_json(F.col("value")).alias("v"), object_status(F.col("value"), required).alias("status"))


def read_rows(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_rows(df: DataFrame, path: str, key: str = "row_id") -> None:
    """Lines in the order of key, in as many files as there are ranges."""
    df.repartitionByRange(key).sortWithinPartitions(key).write.option("ignoreNullFields", "true").json(path)
