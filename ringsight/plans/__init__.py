"""All registered queries."""

from ringsight.plans.registry import REGISTRY
from ringsight.plans import alerts, alignment, chain, history, rules, sequencing, signals, sources, trigger, wheels  # noqa: F401

__all__ = ["REGISTRY"]
