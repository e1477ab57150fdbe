"""Normalisation of titles and keys as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode sees it, with the four separators that only some libraries count.
_WS = r"[\s\x1c-\x1f]"


def once(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c), with c computed once a row however often use names it: a Column that is named twice is a copy of its whole expression."""
    return F.transform(F.array(c), lambda bound: use(bound))[0]


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^{_WS}+|{_WS}+$", "")


def normalize_title(c: Column) -> Column:
    """Upper case, brackets to spaces, runs of white space to one space."""
    return strip(F.regexp_replace(F.translate(F.upper(c), "()", "  "), rf"(?U){_WS}+", " "))


def tokens(normal: Column) -> Column:
    """The words of a normalised title; an empty one has none."""
    return F.when(normal == "", F.array().cast("array<string>")).otherwise(F.split(normal, " "))


def normalize_key(c: Column) -> Column:
    return F.replace(F.upper(strip(c)), F.lit(" "), F.lit(""))


def first_token(words: Column, mapping, last: bool = False) -> Column:
    """The value of the first (last) word that the mapping has; null if none."""
    known = F.array(*[F.lit(k) for k in mapping])
    hits = F.filter(words, lambda w: F.array_contains(known, w))
    hit = F.get(F.reverse(hits) if last else hits, F.lit(0))
    return map_value(hit, mapping)


def map_value(c: Column, mapping) -> Column:
    """mapping[c] as a chain of conditions (null where c is no key)."""
    same: dict = {}
    for k, v in mapping.items():
        same.setdefault(v, []).append(k)
    out = None
    for v, keys in same.items():
        out = F.when(c.isin(keys), F.lit(v)) if out is None else out.when(c.isin(keys), F.lit(v))
    return out if out is not None else F.lit(None).cast("string")


def first_number(c: Column, patterns) -> Column:
    """The first group of the first pattern that matches, as an integer."""
    return F.coalesce(*[F.nullif(F.regexp_extract(c, p, 1), F.lit("")).try_cast("int") for p in patterns])
