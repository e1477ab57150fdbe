"""The rules tier: brand gating, phrase and token extraction, and the flag, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import first_number, first_token, map_value, normalize_title, tokens
from ..packs import NumberAttr, Pack, TokenAttr


def attributes_type(pack: Pack) -> T.StructType:
    return T.StructType([T.StructField(a.name, T.IntegerType() if isinstance(a, NumberAttr) else T.StringType()) for a in pack.attrs])


def candidate_type(pack: Pack) -> T.StructType:
    return T.StructType(
        [
            T.StructField("category", T.StringType()),
            T.StructField("subcategory", T.StringType()),
            T.StructField("attributes", attributes_type(pack)),
            T.StructField("is_winter_rated", T.BooleanType()),
            T.StructField("evidence", T.StringType()),
        ]
    )


def brand_of(words: Column, pack: Pack) -> Column:
    """Name of the brand whose alias is the first such token."""
    return first_token(words, {a: b.name for a, b in pack.alias_map().items()})


def phrase_hits(normal: Column, pack: Pack) -> dict[str, Column]:
    """For each subcategory its longest phrase that the title contains (null: none)."""
    hits: dict[str, Column] = {}
    for phrase, sub in pack.by_length():
        hit = F.when(F.contains(normal, F.lit(phrase)), F.lit(phrase))
        hits[sub] = F.coalesce(hits[sub], hit) if sub in hits else hit
    return hits


def hit_count(normal: Column, pack: Pack) -> Column:
    return reduce(lambda a, b: a + b, [h.isNotNull().cast("int") for h in phrase_hits(normal, pack).values()])


def subcategory_of(normal: Column, pack: Pack) -> tuple[Column, Column]:
    """The subcategory and its phrase where exactly one subcategory is hit, else nulls."""
    hits = phrase_hits(normal, pack)
    one = hit_count(normal, pack) == 1
    sub = F.coalesce(*[F.when(h.isNotNull(), F.lit(s)) for s, h in hits.items()])
    return F.when(one, sub), F.when(one, F.coalesce(*hits.values()))


def attribute(a: TokenAttr | NumberAttr, normal: Column, words: Column, category: Column) -> Column:
    if isinstance(a, NumberAttr):
        return first_number(normal, a.patterns)
    value = first_token(words, a.tokens, a.last)
    if a.only:
        return F.when(category == a.only, value)
    if a.never:
        return F.when(category != a.never, value)
    return value


def flag_of(normal: Column, words: Column, category: Column, brand: Column, pack: Pack, ruleset: str = "guarded") -> Column:
    """What sets the flag, as evidence: a token, a phrase, or (naive rules) the brand; null if nothing does."""
    if ruleset not in ("guarded", "naive"):
        raise ValueError(f"unknown ruleset: {ruleset!r}")
    pool = first_token(words, {t: t for t in pack.flag_tokens})
    for of, extra in pack.flag_tokens_of.items():
        pool = F.when(category == of, first_token(words, {t: t for t in (*pack.flag_tokens, *extra)})).otherwise(pool)
    found = [pool]
    if pack.flag_phrases:
        said = reduce(lambda a, b: a | b, [F.contains(normal, F.lit(p)) for p in pack.flag_phrases])
        found.append(F.when(said, F.lit(pack.flag_label)))
    biased = [b.name for b in pack.brands if b.winter_bias]
    if ruleset == "naive" and biased:
        found.append(F.when(brand.isin(biased), F.lit("brand-default")))
    return F.coalesce(*found)


def decode(df: DataFrame, pack: Pack, title: str = "title", ruleset: str = "guarded", out: str = "candidate") -> DataFrame:
    """Adds the rules tier's candidate (null: abstains). Steps are columns of their own, so each is computed once."""
    df = df.withColumn("_normal", normalize_title(F.col(title))).withColumn("_words", tokens(F.col("_normal")))
    sub, phrase = subcategory_of(F.col("_normal"), pack)
    df = df.withColumns({"_brand": brand_of(F.col("_words"), pack), "_sub": sub, "_phrase": phrase})
    df = df.withColumn("_cat", map_value(F.col("_sub"), pack.category_of()))
    normal, words, cat = F.col("_normal"), F.col("_words"), F.col("_cat")
    flag = flag_of(normal, words, cat, F.col("_brand"), pack, ruleset)
    attrs = F.struct(*[attribute(a, normal, words, cat).alias(a.name) for a in pack.attrs])
    df = df.withColumns({"_flag": flag, "_attrs": attrs})
    evidence = F.concat(F.lit("rules:brand="), F.col("_brand"), F.lit(";kw="), F.col("_phrase"), F.coalesce(F.concat(F.lit(";flag="), F.col("_flag")), F.lit("")))
    made = F.struct(cat.alias("category"), F.col("_sub").alias("subcategory"), F.col("_attrs").alias("attributes"), F.col("_flag").isNotNull().alias("is_winter_rated"), evidence.alias("evidence"))
    df = df.withColumn(out, F.when(F.col("_brand").isNotNull() & F.col("_sub").isNotNull(), made))
    return df.drop("_normal", "_words", "_brand", "_sub", "_phrase", "_cat", "_flag", "_attrs")
