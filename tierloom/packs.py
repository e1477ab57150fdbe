"""Rule packs: everything the operators know about a domain, as data."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field


@dataclass(frozen=True)
class TokenAttr:
    """An attribute read from the first (or last) token that the map knows."""

    name: str
    tokens: Mapping[str, str]
    values: tuple[str, ...]
    last: bool = False
    only: str | None = None
    never: str | None = None


@dataclass(frozen=True)
class NumberAttr:
    """An integer attribute read by the first pattern that matches."""

    name: str
    patterns: tuple[str, ...]
    low: int
    high: int


@dataclass(frozen=True)
class Brand:
    name: str
    aliases: tuple[str, ...]
    kind: str = "both"
    winter_bias: bool = False


@dataclass(frozen=True)
class Pack:
    """taxonomy: category -> subcategories; phrases: phrase -> subcategory; flag_*: what sets the flag."""

    taxonomy: Mapping[str, tuple[str, ...]]
    phrases: Mapping[str, str]
    attrs: tuple[TokenAttr | NumberAttr, ...]
    flag_tokens: tuple[str, ...] = ()
    flag_tokens_of: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    flag_phrases: tuple[str, ...] = ()
    flag_label: str = ""
    brands: tuple[Brand, ...] = ()

    def category_of(self) -> dict[str, str]:
        return {s: c for c, subs in self.taxonomy.items() for s in subs}

    def by_length(self) -> list[tuple[str, str]]:
        """Phrases, longest first; equal lengths keep their order."""
        return sorted(self.phrases.items(), key=lambda kv: -len(kv[0]))

    def alias_map(self) -> dict[str, Brand]:
        """The last brand that lists an alias owns it."""
        return {a: b for b in self.brands for a in b.aliases}


# The product-title taxonomy, its phrases, tokens, patterns and value domains.
PARTS = Pack(
    taxonomy={
        "Braking": ("Brake Pads", "Rotors", "Calipers"),
        "Filtration": ("Oil Filters", "Air Filters", "Cabin Filters"),
        "Electrical": ("Spark Plugs", "Ignition Coils"),
        "Visibility": ("Wiper Blades", "Headlight Bulbs"),
        "Apparel": ("Gloves", "Coveralls", "Hi-Vis Jackets"),
    },
    phrases={
        "BRAKE PADS": "Brake Pads",
        "BRK PADS": "Brake Pads",
        "BRAKE PAD": "Brake Pads",
        "ROTORS": "Rotors",
        "ROTOR": "Rotors",
        "CALIPERS": "Calipers",
        "CALIPER": "Calipers",
        "OIL FILTER": "Oil Filters",
        "OIL FLTR": "Oil Filters",
        "AIR FILTER": "Air Filters",
        "AIR FLTR": "Air Filters",
        "CABIN FILTER": "Cabin Filters",
        "CABIN FLTR": "Cabin Filters",
        "SPARK PLUGS": "Spark Plugs",
        "SPARK PLUG": "Spark Plugs",
        "SPK PLG": "Spark Plugs",
        "IGNITION COIL": "Ignition Coils",
        "IGN COIL": "Ignition Coils",
        "WIPER BLADES": "Wiper Blades",
        "WIPER BLADE": "Wiper Blades",
        "WIPER": "Wiper Blades",
        "HEADLIGHT BULBS": "Headlight Bulbs",
        "HEADLIGHT BULB": "Headlight Bulbs",
        "HDLGHT BULB": "Headlight Bulbs",
        "BULB": "Headlight Bulbs",
        "GLOVES": "Gloves",
        "GLOVE": "Gloves",
        "COVERALLS": "Coveralls",
        "COVERALL": "Coveralls",
        "HI-VIS JACKET": "Hi-Vis Jackets",
        "HI VIS JACKET": "Hi-Vis Jackets",
        "HIVIS JACKET": "Hi-Vis Jackets",
        "JACKET": "Hi-Vis Jackets",
    },
    attrs=(
        TokenAttr(
            "material",
            {"CERAMIC": "ceramic", "SEMI-METALLIC": "semi-metallic", "SEMI-MET": "semi-metallic", "LEATHER": "leather", "NITRILE": "nitrile", "RUBBER": "rubber", "COTTON": "cotton"},
            ("ceramic", "semi-metallic", "leather", "nitrile", "rubber", "cotton"),
        ),
        NumberAttr("pack_count", (r"\b([0-9]{1,2})\s*[- ]?(?:PK|PACK)\b", r"\bSET OF ([0-9]{1,2})\b"), 1, 24),
        TokenAttr(
            "position",
            {"FRONT": "front", "FRT": "front", "REAR": "rear", "LEFT": "left", "LH": "left", "RIGHT": "right", "RH": "right"},
            ("front", "rear", "left", "right"),
            never="Apparel",
        ),
        TokenAttr("size", {"S": "S", "M": "M", "L": "L", "XL": "XL", "2XL": "2XL"}, ("S", "M", "L", "XL", "2XL"), last=True, only="Apparel"),
    ),
    flag_tokens=("WINTER", "WNTR"),
    flag_tokens_of={"Apparel": ("INSULATED", "THERMAL")},
    flag_phrases=("COLD-WEATHER", "COLD WEATHER"),
    flag_label="COLD-WEATHER",
)

#: A second domain over names of two words: a modifier and a noun.
WIDGETS = Pack(
    taxonomy={"Fixing": ("Bolts", "Rings"), "Moving": ("Gears", "Rods"), "Heavy": ("Anvils", "Plates"), "Misc": ("Gizmos", "Widgets")},
    phrases={"BOLT": "Bolts", "RING": "Rings", "GEAR": "Gears", "ROD": "Rods", "ANVIL": "Anvils", "PLATE": "Plates", "GIZMO": "Gizmos", "WIDGET": "Widgets"},
    attrs=(
        TokenAttr("colour", {"RED": "red", "BLUE": "blue"}, ("red", "blue")),
        TokenAttr("size", {"SMALL": "S", "LARGE": "L"}, ("S", "L"), last=True, never="Heavy"),
    ),
    flag_tokens=("COLD",),
    flag_tokens_of={"Heavy": ("NEW",)},
    brands=tuple(Brand(f"Brand#{i}", (f"BRAND#{i}",), "parts", i % 5 == 0) for i in range(1, 21)),
)
