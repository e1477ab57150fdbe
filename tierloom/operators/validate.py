"""Structural validation of a tier's candidate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import map_value
from ..packs import NumberAttr, Pack


def _quoted(c: Column) -> Column:
    return F.concat(F.lit("'"), c.cast("string"), F.lit("'"))


def errors(c: Column, pack: Pack) -> Column:
    """The candidate's errors (an empty array: it is valid). c: a candidate struct."""
    category, sub = c["category"], c["subcategory"]
    known = category.isin(list(pack.taxonomy))
    belongs = F.coalesce(map_value(sub, pack.category_of()) == category, F.lit(False))
    found = [
        F.when(~F.coalesce(known, F.lit(False)), F.concat(F.lit("unknown category: "), F.coalesce(_quoted(category), F.lit("None")))).when(
            ~belongs, F.concat(F.lit("subcategory "), F.coalesce(_quoted(sub), F.lit("None")), F.lit(" not in category "), _quoted(category))
        ),
        F.when(c["is_winter_rated"].isNull(), F.lit("is_winter_rated must be a bool")),
    ]
    for a in sorted(pack.attrs, key=lambda a: a.name):
        v = c["attributes"][a.name]
        if isinstance(a, NumberAttr):
            found.append(F.when(v.isNotNull() & ~v.between(a.low, a.high), F.concat(F.lit(f"bad {a.name}: "), v.cast("string"))))
            continue
        bad = F.when(v.isNotNull() & ~v.isin(list(a.values)), F.concat(F.lit(f"bad {a.name}: "), _quoted(v)))
        if a.never:
            bad = bad.when(v.isNotNull() & (category == a.never), F.lit(f"{a.name} not allowed for {a.never}"))
        if a.only:
            bad = bad.when(v.isNotNull() & (F.coalesce(category != a.only, F.lit(True))), F.lit(f"{a.name} only allowed for {a.only}"))
        found.append(bad)
    return F.array_compact(F.array(*found))
