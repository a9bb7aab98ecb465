"""Cost basis and profit-and-loss of one position.

``cost`` is what was paid minus what was received, so a sale lowers it by its
proceeds and it may turn negative. Every figure is 0 once nothing is held.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _while_held(held: Column, figure: Column) -> Column:
    return F.when(held > 0, figure).otherwise(F.lit(0.0))


def avg_cost_basis(held: Column, cost: Column) -> Column:
    return _while_held(held, cost / held)


def market_value(held: Column, price: Column) -> Column:
    return _while_held(held, held * price)


def unrealized_pnl(held: Column, value: Column, cost: Column) -> Column:
    return _while_held(held, value - cost)


def unrealized_pnl_pct(held: Column, pnl: Column, cost: Column) -> Column:
    return F.when((cost > 0) & (held > 0), pnl / cost * 100).otherwise(F.lit(0.0))


def realized_pnl(sold: Column, value: Column, cost: Column) -> Column:
    """Sale proceeds less the share of the cost that they stand for.

    The share is proceeds over proceeds plus market value (at least 1). This is
    not average-cost accounting: realized plus unrealized need not add up to
    the total gain.
    """
    share = sold / F.greatest(value + sold, F.lit(1.0))
    return sold - share * cost
