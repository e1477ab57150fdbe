"""Dataflow operators: tiers, evaluation, gates, comparison, contracts and the registry."""
