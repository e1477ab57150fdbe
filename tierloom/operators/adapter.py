"""A model tier without a model: the prompt, the reading of an answer, and a tier around any function that answers.

Whatever goes wrong with an answer, the tier abstains; it never guesses and never stops a batch.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..packs import NumberAttr, Pack
from ..sources.jsonl import strict_json
from . import rules

PROMPT_VERSION = "1"


def prompt(title: str, pack: Pack) -> str:
    """What a model is asked about a title: the pack's classes and domains, and the form of the answer."""
    classes = [f"{category}: {' | '.join(subs)}" for category, subs in pack.taxonomy.items()]
    domains = [f"{a.name}: whole number, {a.low} to {a.high}" if isinstance(a, NumberAttr) else f"{a.name}: {' | '.join(a.values)}" for a in pack.attrs]
    return "\n".join(
        [
            "Put this product title into one class.",
            f"Title: {title}",
            "Classes (category: subcategories):",
            *classes,
            "Attributes (leave out what the title does not say):",
            *domains,
            'Answer with one JSON object and nothing else: {"category": str, "subcategory": str, "attributes": object, "is_winter_rated": bool}.',
            'Answer {"abstain": true} unless you are sure.',
        ]
    )


def parse(text) -> dict | None:
    """An answer's decode; None where it abstains, lacks a key or has a value of another type."""
    try:
        found = json.loads(text)
    except (TypeError, ValueError):
        return None
    kinds = {"category": str, "subcategory": str, "attributes": dict, "is_winter_rated": bool}
    if not isinstance(found, dict) or found.get("abstain") is True or not all(isinstance(found.get(k), t) for k, t in kinds.items()):
        return None
    return {k: found[k] for k in kinds}


def first_text(blocks: Iterable) -> str:
    """The text of the first text block of an answer that comes in blocks; empty if there is none."""
    return next((b.text for b in blocks if getattr(b, "type", None) == "text"), "")


def parsed(text: Column, pack: Pack) -> Column:
    """parse() as an expression: a candidate struct, or null."""
    v = strict_json(text)
    get = lambda name: F.try_variant_get(v, f"$.{name}", "variant")
    is_a = lambda name, kind: F.coalesce(F.schema_of_variant(get(name)).startswith(kind), F.lit(False))
    good = is_a("category", "STRING") & is_a("subcategory", "STRING") & is_a("attributes", "OBJECT") & is_a("is_winter_rated", "BOOLEAN")
    abstains = F.coalesce(F.try_variant_get(v, "$.abstain", "boolean") & is_a("abstain", "BOOLEAN"), F.lit(False))
    return F.when(good & ~abstains, F.from_json(text, rules.candidate_type(pack)))


class AnswerTier:
    """ask(prompt) -> text, wrapped as an object for tiers.PythonTier. What ask raises is an abstention."""

    name = "model"

    def __init__(self, ask: Callable[[str], str], pack: Pack, model: str) -> None:
        self.ask, self.pack, self.model = ask, pack, model

    def decode(self, row: dict) -> dict | None:
        try:
            found = parse(self.ask(prompt(row["title"], self.pack)))
        except Exception:  # of any kind: a network, a quota, a broken answer
            return None
        return found and found | {"evidence": f"model:{self.model}"}

    def identity(self) -> dict:
        return {"adapter": "answer", "model": self.model, "prompt_sha256": hashlib.sha256(prompt("", self.pack).encode()).hexdigest(), "prompt_version": PROMPT_VERSION, "deterministic": False}
