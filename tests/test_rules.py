import dataclasses

import pytest
from pyspark.sql import functions as F

from tierloom.functions.text import normalize_key, normalize_title, tokens
from tierloom.operators import rules, tiers, validate
from tierloom.packs import PARTS
from tierloom.sources.synth import BRANDS

PACK = dataclasses.replace(PARTS, brands=BRANDS)
CASES = [
    ("Ardevane FRT CERAMIC BRK PADS (4-PK)", ("Braking", "Brake Pads", "ceramic", 4, "front", None, False, "rules:brand=ARDEVANE;kw=BRK PADS")),
    ("ADV rotor RR", ("Braking", "Rotors", None, None, None, None, False, "rules:brand=ARDEVANE;kw=ROTOR")),
    ("UNHEARD BRAKE PADS", None),
    ("ARDEVANE THING", None),
    ("ARDEVANE ROTOR CALIPER", None),
    ("ADV-9327 BRAKE PADS", None),
    ("CTM SPARK PLUGS SET OF 6", ("Electrical", "Spark Plugs", None, 6, None, None, False, "rules:brand=COLTRIMAR;kw=SPARK PLUGS")),
    ("CTM SPARK PLUG 30 PACK", ("Electrical", "Spark Plugs", None, 30, None, None, False, "rules:brand=COLTRIMAR;kw=SPARK PLUG")),
    ("PELLORAN GLOVES SZ M NITRILE L", ("Apparel", "Gloves", "nitrile", None, None, "L", False, "rules:brand=PELLORAN;kw=GLOVES")),
    ("PLN LEFT COVERALL insulated", ("Apparel", "Coveralls", None, None, None, None, True, "rules:brand=PELLORAN;kw=COVERALL;flag=INSULATED")),
    ("HVT WIPER BLADE thermal", ("Visibility", "Wiper Blades", None, None, None, None, False, "rules:brand=HALVOTTE;kw=WIPER BLADE")),
    ("HVT WIPER WNTY 90D", ("Visibility", "Wiper Blades", None, None, None, None, False, "rules:brand=HALVOTTE;kw=WIPER")),
    ("HVT cold-weather WIPER", ("Visibility", "Wiper Blades", None, None, None, None, True, "rules:brand=HALVOTTE;kw=WIPER;flag=COLD-WEATHER")),
    ("NDK GLOVE", ("Apparel", "Gloves", None, None, None, None, False, "rules:brand=NORDIVAK;kw=GLOVE")),
    ("   svn hi-vis jacket xl ", ("Apparel", "Hi-Vis Jackets", None, None, None, "XL", False, "rules:brand=SYLVARNE;kw=HI-VIS JACKET")),
]


def flat(c):
    if c is None:
        return None
    a = c.attributes
    return (c.category, c.subcategory, a.material, a.pack_count, a.position, a["size"], c.is_winter_rated, c.evidence)


def test_decode(spark):
    df = spark.createDataFrame([(t,) for t, _ in CASES] + [("",), (None,)], "title string")
    got = {r.title: flat(r.candidate) for r in rules.decode(df, PACK).collect()}
    assert got == dict(CASES) | {"": None, None: None}


def test_naive_rules_follow_the_brand(spark):
    df = spark.createDataFrame([("NDK GLOVE",), ("HVT WIPER",)], "title string")
    got = [r.candidate.evidence for r in rules.decode(df, PACK, ruleset="naive").collect()]
    assert got == ["rules:brand=NORDIVAK;kw=GLOVE;flag=brand-default", "rules:brand=HALVOTTE;kw=WIPER"]
    with pytest.raises(ValueError):
        tiers.RulesTier("other")


def test_normalisation(spark):
    df = spark.createDataFrame([(" a (b)\t\x1cc ",), ("",), (" \n",)], "t string")
    n = normalize_title(F.col("t"))
    assert [tuple(r) for r in df.select(n, F.size(tokens(n)), normalize_key(F.col("t"))).collect()] == [("A B C", 3, "A (B)\t\x1cC"), ("", 0, ""), ("", 0, "")]


def test_validation(spark):
    shape = rules.candidate_type(PACK)
    ok = {"material": None, "pack_count": None, "position": None, "size": None}
    rows = [
        (("Braking", "Rotors", ok, True, ""), []),
        (("Nope", "Rotors", ok, True, ""), ["unknown category: 'Nope'"]),
        (("Apparel", "Rotors", ok, None, ""), ["subcategory 'Rotors' not in category 'Apparel'", "is_winter_rated must be a bool"]),
        (("Apparel", "Gloves", ok | {"position": "front", "pack_count": 25}, True, ""), ["bad pack_count: 25", "position not allowed for Apparel"]),
        (("Braking", "Rotors", ok | {"size": "L", "material": "wood", "position": "up"}, True, ""), ["bad material: 'wood'", "bad position: 'up'", "size only allowed for Apparel"]),
        (("Apparel", "Gloves", ok | {"size": "XXL"}, True, ""), ["bad size: 'XXL'"]),
    ]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], f"i int, c {shape.simpleString()}")
    got = dict(df.select("i", validate.errors(F.col("c"), PACK)).collect())
    assert [got[i] for i in range(len(rows))] == [e for _, e in rows]


def test_batch(spark):
    class Model:
        name = "model"

        def __init__(self):
            self.bad = "boom"

        def decode(self, row):
            if "boom" in row["title"]:
                raise KeyError("x")
            if "odd" in row["title"]:
                return {"category": "Braking", "subcategory": "Gloves", "is_winter_rated": False, "evidence": "model:x"}
            if "fine" in row["title"] or "ROTOR" in row["title"]:
                return {"category": "Braking", "subcategory": "Calipers", "attributes": {"position": "rear"}, "is_winter_rated": False, "evidence": "model:x"}
            return None

        def identity(self):
            return {"adapter": "test"}

    empty = F.lit(None).cast(rules.attributes_type(PACK)).alias("attributes")
    dim = spark.createDataFrame([("ADV-1", "Apparel", "Gloves", True), ("ADV-2", "Apparel", "Rotors", True)], "key string, category string, subcategory string, is_winter_rated boolean")
    dim = dim.select("key", "category", "subcategory", empty, "is_winter_rated")
    raw = [
        ("a", " adv - 1", "ADV ROTOR", "decoded", "catalog", None, []),
        ("b", "ADV-2", "ADV ROTOR", "decoded", "rules", None, ["catalog"]),
        ("c", "x", "ADV ROTOR 30 PACK", "decoded", "model", None, ["rules"]),
        ("d", "x", "boom boom", "errored", None, "model:KeyError", []),
        ("e", "x", "odd one", "abstained", None, "no_confident_decode", ["model"]),
        ("f", "x", "  ", "quarantined", None, "empty_title", []),
        ("g", "x", " abc ", "quarantined", None, "short_title", []),
        ("h", " ", "boom", "quarantined", None, "missing_sku", []),
        ("i", "x", "fine by me", "decoded", "model", None, []),
        ("j", "ADV-1", "boom", "decoded", "catalog", None, []),
    ]
    df = spark.createDataFrame([r[:3] for r in raw], "row_id string, sku string, title string")
    out = tiers.run_batch(df, [tiers.CatalogTier(dim), tiers.RulesTier(), tiers.PythonTier(Model())], PACK).orderBy("row_id").collect()
    assert [(r.row_id, r.sku, r.title, r.state, r.tier, r.reason, list(r.invalid)) for r in out] == raw
    assert out[0].decode.evidence == "catalog:ADV-1" and out[2].decode.attributes.position == "rear"
