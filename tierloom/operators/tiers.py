"""Tiers and the batch run: the first valid candidate wins, row by row, without a row loop.

A tier adds two columns to a frame: a candidate (null: it abstains) and an error (null: none). Built-in tiers are joins and
expressions; any Python object with decode(row) and identity() runs in mapInPandas on the rows that no earlier tier has won.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import normalize_key, normalize_title, strip
from ..packs import Pack
from . import rules
from .validate import errors

#: A dimension is broadcast if the plan's estimate of its size is no more; a larger one is joined by Spark's own choice.
BROADCAST_BYTES = 32 << 20


class Tier(Protocol):
    name: str

    def add(self, df: DataFrame, pack: Pack, wanted: Column, candidate: str, error: str) -> DataFrame: ...

    def identity(self) -> dict: ...


def small(dim: DataFrame) -> DataFrame:
    """dim with a broadcast hint if its estimated bytes allow it. Nothing is run: files and local rows have known sizes."""
    size = int(str(dim._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(dim) if size <= BROADCAST_BYTES else dim


class CatalogTier:
    """Exact look-up by normalised key. dim: key, category, subcategory, attributes, is_winter_rated."""

    name = "catalog"

    def __init__(self, dim: DataFrame) -> None:
        self.dim = dim

    def add(self, df, pack, wanted, candidate, error):
        entry = F.struct("category", "subcategory", "attributes", "is_winter_rated", F.concat(F.lit("catalog:"), F.col("key")).alias("evidence"))
        dim = self.dim.select(F.col("key").alias("_key"), entry.cast(rules.candidate_type(pack)).alias(candidate))
        return df.join(small(dim), normalize_key(F.col("sku")) == F.col("_key"), "left").drop("_key").withColumn(error, F.lit(None).cast("string"))

    def identity(self) -> dict:
        return {"adapter": "catalog"}


class RulesTier:
    name = "rules"

    def __init__(self, ruleset: str = "guarded") -> None:
        if ruleset not in ("guarded", "naive"):
            raise ValueError(f"unknown ruleset: {ruleset!r}")
        self.ruleset = ruleset

    def add(self, df, pack, wanted, candidate, error):
        return rules.decode(df, pack, ruleset=self.ruleset, out=candidate).withColumn(error, F.lit(None).cast("string"))

    def identity(self) -> dict:
        return {"adapter": "rules", "ruleset": self.ruleset}


class FixtureTier:
    """Look-up by normalised title: a deterministic stand-in for a model. dim: title, category, subcategory, attributes, is_winter_rated."""

    name = "model"

    def __init__(self, dim: DataFrame, fixture_sha256: str = "") -> None:
        self.dim, self.fixture_sha256 = dim, fixture_sha256

    def add(self, df, pack, wanted, candidate, error):
        entry = F.struct("category", "subcategory", "attributes", "is_winter_rated", F.lit("model:stub-fixture").alias("evidence"))
        dim = self.dim.select(F.col("title").alias("_key"), entry.cast(rules.candidate_type(pack)).alias(candidate))
        return df.join(small(dim), normalize_title(F.col("title")) == F.col("_key"), "left").drop("_key").withColumn(error, F.lit(None).cast("string"))

    def identity(self) -> dict:
        return {"adapter": "fixture", "fixture_sha256": self.fixture_sha256, "deterministic": True}


class PythonTier:
    """Any object with name, decode(row: dict) -> dict | None and identity(). It sees wanted rows alone; what it raises is an error of the row."""

    def __init__(self, model) -> None:
        self.model, self.name = model, model.name

    def add(self, df, pack, wanted, candidate, error):
        model = self.model
        shape = rules.candidate_type(pack)
        schema = T.StructType([*df.schema.fields, T.StructField(candidate, shape), T.StructField(error, T.StringType())])
        names = [f.name for f in df.schema.fields]

        def one(row: dict):
            try:
                d = model.decode({k: row[k] for k in ("row_id", "sku", "title")})
            except Exception as e:  # the row is put in a bucket, the batch goes on
                return None, f"{model.name}:{type(e).__name__}"
            if d is None:
                return None, None
            attrs = d.get("attributes") or {}
            return {**{k: d.get(k) for k in ("category", "subcategory", "is_winter_rated", "evidence")}, "attributes": {a.name: attrs.get(a.name) for a in pack.attrs}}, None

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                found = [one(r) if w else (None, None) for r, w in zip(b[names].to_dict("records"), b["_wanted"], strict=True)]
                out = b[names].copy()
                out[candidate], out[error] = [f[0] for f in found], [f[1] for f in found]
                yield out

        return df.withColumn("_wanted", wanted).mapInPandas(run, schema)

    def identity(self) -> dict:
        return self.model.identity()


def malformed(title: str = "title", sku: str = "sku") -> Column:
    """Why a row is quarantined; null: it is not."""
    t = strip(F.coalesce(F.col(title), F.lit("")))
    return F.when(t == "", "empty_title").when(F.length(t) < 4, "short_title").when(strip(F.coalesce(F.col(sku), F.lit(""))) == "", "missing_sku")


def run_batch(raw: DataFrame, tiers: Sequence[Tier], pack: Pack) -> DataFrame:
    """raw row_id, sku, title -> the same with state, reason, tier, decode (the winner) and invalid (tiers whose answers were not valid).

    One frame of all rows; decoded and rejected rows are filters on state. No shuffle but the tiers' own joins.
    """
    df = raw.withColumn("_bad", malformed())
    open_ = F.col("_bad").isNull()
    tries = []
    for i, tier in enumerate(tiers):
        c, e, v = f"_c{i}", f"_e{i}", f"_v{i}"
        df = tier.add(df, pack, open_, c, e)
        df = df.withColumn(v, F.when(open_ & F.col(c).isNotNull(), F.size(errors(F.col(c), pack)) == 0))
        df = df.withColumn(f"_o{i}", open_ & F.col(e).isNull() & ~F.coalesce(F.col(v), F.lit(False)))
        tries.append((tier.name, open_, c, e, v))
        open_ = F.col(f"_o{i}")
    won = F.coalesce(*[F.when(o & F.col(v), F.lit(n)) for n, o, c, e, v in tries])
    error = F.coalesce(*[F.when(o, F.col(e)) for n, o, c, e, v in tries])
    df = df.withColumns({"_won": won, "_error": error})
    state = F.when(F.col("_bad").isNotNull(), "quarantined").when(F.col("_won").isNotNull(), "decoded").when(F.col("_error").isNotNull(), "errored").otherwise("abstained")
    reason = F.coalesce("_bad", F.when(F.col("_won").isNull(), F.coalesce("_error", F.lit("no_confident_decode"))))
    decode = F.coalesce(*[F.when(F.col("_won") == n, F.col(c)) for n, o, c, e, v in tries])
    invalid = F.array_compact(F.array(*[F.when(o & ~F.col(v), F.lit(n)) for n, o, c, e, v in tries]))
    return df.select(*raw.columns, state.alias("state"), reason.alias("reason"), F.col("_won").alias("tier"), decode.alias("decode"), invalid.alias("invalid"))


def decoded(outcomes: DataFrame) -> DataFrame:
    d = F.col("decode")
    return outcomes.where("state = 'decoded'").select("row_id", "sku", d["category"].alias("category"), d["subcategory"].alias("subcategory"), d["attributes"].alias("attributes"), d["is_winter_rated"].alias("is_winter_rated"), "tier", d["evidence"].alias("evidence"))


def rejects(outcomes: DataFrame) -> DataFrame:
    return outcomes.where("state <> 'decoded'").select("row_id", "sku", "title", F.col("state").alias("bucket"), "reason")


def counts(outcomes: DataFrame) -> dict:
    states = ("decoded", "abstained", "quarantined", "errored")
    row = outcomes.agg(F.count("*").alias("total"), *[F.count_if(F.col("state") == s).alias(s) for s in states]).first()
    return row.asDict()


def tier_invalid(outcomes: DataFrame) -> dict:
    return {r["tier"]: r["count"] for r in outcomes.select(F.explode("invalid").alias("tier")).groupBy("tier").count().collect()}

