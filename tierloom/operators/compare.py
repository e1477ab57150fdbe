"""Batch-to-batch differences: one full outer join of two outcome sets, and small aggregates over it.

An outcome's fields are a map from name to JSON text. A field that is absent differs from one that is null, and true from 1,
because the texts differ. The lists of added, removed and changed rows stay frames; only counts reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.digest import sha256_json

COMPARISON_VERSION = "1"


def json_text(c: Column) -> Column:
    """A scalar as JSON text; null as null's text."""
    return F.when(c.isNull(), "null").otherwise(F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1))


def fields_of(columns: Sequence[str], state: str = "state") -> Column:
    """Map of field name to JSON text: the outcome and the named columns."""
    pairs = [F.lit("outcome"), json_text(F.col(state))]
    for c in columns:
        pairs += [F.lit(c), json_text(F.col(c))]
    return F.create_map(*pairs)


def outcome_fields(outcomes: DataFrame, pack) -> DataFrame:
    """row_id, state, fields of run_batch()'s outcomes: decoded rows show their decode, others their reject. Absent attributes are absent fields."""
    d = F.col("decode")
    made = [("sku", F.col("sku")), *[(k, d[k]) for k in ("category", "subcategory", "is_winter_rated")], ("tier", F.col("tier")), ("evidence", d["evidence"])]
    attrs = [F.struct(F.lit(f"attributes.{a.name}").alias("key"), json_text(d["attributes"][a.name]).alias("value"), d["attributes"][a.name].isNotNull().alias("on")) for a in pack.attrs]
    entry = lambda k, v: F.struct(F.lit(k).alias("key"), json_text(v).alias("value"), F.lit(True).alias("on"))
    decoded = F.array(entry("outcome", F.col("state")), *[entry(k, v) for k, v in made], *attrs)
    rejected = F.array(entry("outcome", F.col("state")), *[entry(k, F.col(k)) for k in ("sku", "title")], entry("bucket", F.col("state")), entry("reason", F.col("reason")))
    listed = F.filter(F.when(F.col("state") == "decoded", decoded).otherwise(rejected), lambda x: x["on"])
    return outcomes.select("row_id", "state", F.map_from_entries(F.transform(listed, lambda x: F.struct(x["key"], x["value"]))).alias("fields"))


def diff(before: DataFrame, after: DataFrame, key: str = "row_id") -> DataFrame:
    """before and after: key, state, fields -> key, status (added, removed, changed, unchanged), transition, changes (array of field, before, after)."""
    b = before.select(F.col(key), F.col("state").alias("s0"), F.col("fields").alias("f0"))
    a = after.select(F.col(key), F.col("state").alias("s1"), F.col("fields").alias("f1"))
    j = b.join(a, key, "full_outer")
    names = F.array_sort(F.array_union(F.map_keys("f0"), F.map_keys("f1")))
    pairs = F.transform(names, lambda n: F.struct(n.alias("field"), F.element_at("f0", n).alias("before"), F.element_at("f1", n).alias("after")))
    changes = F.filter(pairs, lambda p: ~p["before"].eqNullSafe(p["after"]))
    j = j.withColumn("changes", F.when(F.col("s0").isNotNull() & F.col("s1").isNotNull(), changes))
    status = F.when(F.col("s0").isNull(), "added").when(F.col("s1").isNull(), "removed").when(F.size("changes") > 0, "changed").otherwise("unchanged")
    transition = F.when(F.col("changes").isNotNull(), F.concat("s0", F.lit("_to_"), "s1"))
    return j.select(key, status.alias("status"), transition.alias("transition"), "changes")


def status_counts(d: DataFrame) -> DataFrame:
    return d.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("added", "removed", "changed", "unchanged")])


def field_counts(d: DataFrame) -> DataFrame:
    return d.select(F.explode("changes").alias("c")).groupBy(F.col("c.field").alias("field")).agg(F.count("*").alias("n"))


def transition_counts(d: DataFrame) -> DataFrame:
    return d.where("transition IS NOT NULL").groupBy("transition").agg(F.count("*").alias("n"))


def change_types(d: DataFrame) -> DataFrame:
    """Rows decoded in both batches whose class, tier or flag changed."""
    names = F.transform("changes", lambda c: c["field"])
    both = F.col("transition") == "decoded_to_decoded"
    has = lambda *f: F.count_if(both & F.arrays_overlap(names, F.array(*[F.lit(x) for x in f])))
    return d.agg(has("category", "subcategory").alias("classification"), has("tier").alias("tier"), has("is_winter_rated").alias("winter_flag"))


def partition_identity(d: DataFrame) -> DataFrame:
    """Both batches' totals counted two ways; they must agree."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    both = F.count_if(F.col("transition").isNotNull())
    return d.agg(
        (both + n("removed")).alias("baseline_total"),
        n("removed", "changed", "unchanged").alias("baseline_identity"),
        (both + n("added")).alias("current_total"),
        n("added", "changed", "unchanged").alias("current_identity"),
        F.count("*").alias("union_total"),
        n("added", "removed", "changed", "unchanged").alias("union_identity"),
    )


def report(d: DataFrame, baseline: dict | None = None, current: dict | None = None) -> dict:
    """The comparison report without its row lists, closed by its own digest."""
    d = d.persist()
    try:
        out = {
            "comparison_version": COMPARISON_VERSION,
            "baseline": baseline or {},
            "current": current or {},
            "counts": status_counts(d).first().asDict(),
            "partition": partition_identity(d).first().asDict(),
            "change_types": change_types(d).first().asDict(),
            "transitions": {r[0]: r[1] for r in sorted(transition_counts(d).collect())},
            "field_change_counts": {r[0]: r[1] for r in sorted(field_counts(d).collect())},
        }
    finally:
        d.unpersist()
    return out | {"comparison_sha256": sha256_json(out)}
