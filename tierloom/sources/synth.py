"""A synthetic source of product titles with known truth.

Every draw is a hash of (seed, row number, name of the draw), so rows are made in parallel, are the same on every run, and a
larger source begins with the smaller one.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import map_value
from ..packs import PARTS, Brand, Pack

#: Invented brands: two names each; one of them is biased towards the flag.
BRANDS = (
    Brand("ARDEVANE", ("ARDEVANE", "ADV"), "parts"),
    Brand("COLTRIMAR", ("COLTRIMAR", "CTM"), "parts"),
    Brand("DRUVEXO", ("DRUVEXO", "DVX"), "parts"),
    Brand("FENMORIK", ("FENMORIK", "FMK"), "parts"),
    Brand("HALVOTTE", ("HALVOTTE", "HVT"), "parts"),
    Brand("NORDIVAK", ("NORDIVAK", "NDK"), "both", True),
    Brand("PELLORAN", ("PELLORAN", "PLN"), "apparel"),
    Brand("SYLVARNE", ("SYLVARNE", "SVN"), "apparel"),
    Brand("TORBEXIL", ("TORBEXIL", "TBX"), "apparel"),
)
UNKNOWN = ("ZZAVOR", "QUIBNEL", "OXTRAND")
_MATERIALS = {"Brake Pads": ("ceramic", "semi-metallic"), "Gloves": ("leather", "nitrile"), "Coveralls": ("cotton",), "Wiper Blades": ("rubber",)}


def _draw(seed: int, name: str) -> Column:
    """Uniform in [0, 1)."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col("n"), F.lit(name)), F.lit(1_000_003)).cast("double") / 1_000_003


def _choice(seed: int, name: str, values: Sequence) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.floor(_draw(seed, name) * len(values)).cast("int"))


def generate(spark: SparkSession, seed: int, rows: int, pack: Pack = PARTS, brands: Sequence[Brand] = BRANDS) -> DataFrame:
    """row_id, sku, title, quality (clean, out_of_catalog, malformed) and truth (category, subcategory, attributes, is_winter_rated)."""
    df = spark.range(1, rows + 1).withColumnRenamed("id", "n")
    phrases: dict[str, list[str]] = {}
    for p, s in pack.phrases.items():
        phrases.setdefault(s, []).append(p)
    df = df.withColumn("sub", _choice(seed, "sub", [s for subs in pack.taxonomy.values() for s in subs]))
    df = df.withColumn("cat", map_value(F.col("sub"), pack.category_of()))
    apparel = F.col("cat") == "Apparel"
    of = lambda kind, f: _choice(seed, "brand", [f(b) for b in brands if b.kind in (kind, "both")])
    df = df.withColumns(
        {
            "brand": F.when(apparel, of("apparel", lambda b: b.name)).otherwise(of("parts", lambda b: b.name)),
            "short": F.when(apparel, of("apparel", lambda b: b.aliases[1])).otherwise(of("parts", lambda b: b.aliases[1])),
        }
    )
    biased = F.col("brand").isin([b.name for b in brands if b.winter_bias])
    rate = F.when(biased & (apparel | (F.col("sub") == "Wiper Blades")), 0.8).when(biased, 0.15).when(apparel, 0.35).when(F.col("sub") == "Wiper Blades", 0.3).otherwise(0.05)
    df = df.withColumn("winter", _draw(seed, "winter") < rate)
    material = reduce(lambda a, kv: F.when((F.col("sub") == kv[0]) & (_draw(seed, "has_material") < 0.6), _choice(seed, "material", kv[1])).otherwise(a), _MATERIALS.items(), F.lit(None).cast("string"))
    attrs = F.struct(
        material.alias("material"),
        F.when(F.col("sub").isin("Brake Pads", "Spark Plugs", "Wiper Blades", "Headlight Bulbs", "Gloves") & (_draw(seed, "has_pack") < 0.4), _choice(seed, "pack", (2, 4, 6, 8, 12))).cast("int").alias("pack_count"),
        F.when(F.col("cat").isin("Braking") & (_draw(seed, "has_pos") < 0.6), _choice(seed, "pos", ("front", "rear", "left", "right"))).alias("position"),
        F.when(apparel & (_draw(seed, "has_size") < 0.85), _choice(seed, "size", ("S", "M", "L", "XL", "2XL"))).alias("size"),
    )
    df = df.withColumn("attributes", attrs)
    a = F.col("attributes")
    sku = F.concat_ws("-", "short", F.floor(_draw(seed, "sku") * 9000 + 1000).cast("string"))
    said = F.col("winter") & ~(biased & (_draw(seed, "suppress") < 0.5))
    phrase = reduce(lambda x, kv: F.when(F.col("sub") == kv[0], _choice(seed, "phrase", kv[1])).otherwise(x), phrases.items(), F.lit(None).cast("string"))
    position = F.when(a["position"] == "front", _choice(seed, "front", ("FRONT", "FRT"))).when(a["position"] == "left", _choice(seed, "left", ("LEFT", "LH"))).when(a["position"] == "right", _choice(seed, "right", ("RIGHT", "RH"))).otherwise(F.upper(a["position"]))
    n = a["pack_count"].cast("string")
    pack_text = F.get(F.array(F.concat(F.lit("("), n, F.lit("-PK)")), F.concat(n, F.lit("-PK")), F.concat(F.lit("SET OF "), n), F.concat(n, F.lit(" PACK"))), F.floor(_draw(seed, "pack_text") * 4).cast("int"))
    df = df.withColumns({"sku": sku, "fate": _draw(seed, "fate"), "unknown": _choice(seed, "unknown", UNKNOWN)})
    head = F.when(F.col("fate").between(0.03, 0.08), F.col("unknown")).when(_draw(seed, "brand_text") < 0.25, F.col("short")).otherwise(F.col("brand"))
    title = F.concat_ws(
        " ",
        head,
        F.upper(a["material"]),
        position,
        F.when(said, F.when(apparel, _choice(seed, "token", ("WINTER", "WNTR", "INSULATED", "THERMAL"))).otherwise(_choice(seed, "token", ("WINTER", "WNTR")))),
        phrase,
        pack_text,
        F.when(a["size"].isNotNull(), F.concat(_choice(seed, "size_text", ("SZ ", "SIZE ", "")), a["size"])),
        F.when(~F.col("winter") & (_draw(seed, "warranty") < 0.1), _choice(seed, "warranty_text", ("2YR WNTY", "WNTY 90D"))),
        F.when(apparel & a["size"].isNull() & (_draw(seed, "stray") < 0.15), "L"),
        F.when(_draw(seed, "filler") < 0.2, _choice(seed, "filler_text", ("HD", "PRO", "NEW", "BULK"))),
        F.when((_draw(seed, "with_sku") < 0.3) & (F.col("fate") >= 0.08), F.col("sku")),
    )
    style = _draw(seed, "case")
    quality = F.when(F.col("fate") < 0.03, "malformed").when(F.col("fate") < 0.08, "out_of_catalog").otherwise("clean")
    df = df.withColumns({"quality": quality, "title": F.when(style < 0.3, F.lower(title)).when(style < 0.5, F.initcap(title)).otherwise(title)})
    return df.select(
        F.format_string("R%04d", "n").alias("row_id"),
        F.when(F.col("quality") == "out_of_catalog", F.concat_ws("-", F.substring("unknown", 1, 3), F.substring_index("sku", "-", -1))).otherwise(F.col("sku")).alias("sku"),
        F.when(F.col("quality") == "malformed", _choice(seed, "bad", ("", "   ", "###", "?"))).otherwise(F.col("title")).alias("title"),
        "quality",
        F.struct(F.col("cat").alias("category"), F.col("sub").alias("subcategory"), "attributes", F.col("winter").alias("is_winter_rated")).alias("truth"),
    )


def gold_of(source: DataFrame) -> DataFrame:
    """The truth as a gold set: clean rows are to be decoded, others abstained from."""
    ok = F.col("quality") == "clean"
    return source.select("row_id", F.when(ok, "decode").otherwise("abstain").alias("expect"), *[F.when(ok, F.col(f"truth.{c}")).alias(c) for c in ("category", "subcategory", "attributes", "is_winter_rated")])
