"""Customer tiers: the spend ladder, the order of tiers, the cashback rates."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tier, least rolling spend that earns it, cashback rate.
TIERS = ("bronze", "silver", "gold", "platinum", "diamond")
LADDER = {"silver": 2500, "gold": 10000, "platinum": 25000, "diamond": 50000}
CASHBACK_RATES = {"bronze": 0.01, "silver": 0.02, "gold": 0.03, "platinum": 0.05, "diamond": 0.08}


def suggested_tier(spend: Column, ladder: Mapping[str, float] = LADDER, lowest: str = TIERS[0]) -> Column:
    """The highest rung of ``ladder`` that ``spend`` reaches."""
    rungs = sorted(ladder.items(), key=lambda rung: rung[1])
    reached = [F.when(spend >= floor, F.lit(tier)) for tier, floor in reversed(rungs)]
    return F.coalesce(*reached, F.lit(lowest))


def rank(tier: Column, order: tuple[str, ...] = TIERS) -> Column:
    """Position of a tier from the lowest up; NULL for an unknown one."""
    place = F.array_position(F.array(*[F.lit(t) for t in order]), tier)
    return F.when(place > 0, place)


def is_upgrade(current: Column, suggested: Column, by: str = "ordinal") -> Column:
    """Whether ``suggested`` is above ``current``; False if either is unknown.

    ``by="ordinal"`` compares places on the ladder. ``by="lexical"`` compares the
    names as strings, as the existing reports do: silver can then never rise.
    """
    if by == "ordinal":
        higher = rank(suggested) > rank(current)
    elif by == "lexical":
        higher = suggested > current
    else:
        raise ValueError(f"unknown tier order: {by}")
    return F.coalesce(higher, F.lit(False))
