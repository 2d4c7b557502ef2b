"""Periodic-review replenishment: order quantities, stock-out risk, and a budget over the order book."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from statistics import NormalDist

BELOW, ABOVE = "inventory position below reorder point", "inventory position above reorder point"
RAISED, CAPPED, SHELF = "; raised to minimum order", "; capped by maximum order", "; capped by shelf life"
DEFERRED = "; deferred: order budget exhausted"


def z_score(service_level: float) -> float:
    if not 0.5 <= service_level < 1:
        raise ValueError("service level must be in [0.5, 1)")
    return NormalDist().inv_cdf(service_level)


def pack_up(quantity: float, pack: int) -> int:
    return 0 if quantity <= 0 else math.ceil(quantity / pack - 1e-9) * pack


def pack_down(quantity: float, pack: int) -> int:
    return 0 if quantity <= 0 else math.floor(quantity / pack + 1e-9) * pack


@dataclass(frozen=True)
class Need:
    """What a decision is made from; forecast covers lead time and review period at least."""

    forecast: Sequence[float]
    sigma: float
    on_hand: float
    on_order: float
    lead_time: int
    review: int = 7
    service_level: float = 0.95
    case_pack: int = 1
    unit_cost: float | None = None
    shelf_life: int | None = None
    min_order: int = 0
    max_order: int | None = None


@dataclass(frozen=True)
class Decision:
    lead_time_demand: float
    safety_stock: float
    reorder_point: float
    order_up_to: float
    position: float
    order_qty: int
    reason: str
    stockout_risk: float
    priority: float

    def explain(self) -> str:
        return f"position {self.position:g}, reorder point {self.reorder_point:.1f}, order up to {self.order_up_to:.1f}: order {self.order_qty} ({self.reason})"


def shortfall(mean: float, sd: float, position: float) -> tuple[float, float]:
    """Probability that demand exceeds the position, and the expected excess."""
    if sd <= 0:
        return float(position < mean), max(0.0, mean - position)
    k = (position - mean) / sd
    tail = NormalDist().cdf(-k)
    return tail, max(0.0, sd * (math.exp(-k * k / 2) / math.sqrt(2 * math.pi) - k * tail))


def decide(need: Need) -> Decision:
    cover = need.lead_time + need.review
    ltd, mean = (float(sum(need.forecast[:n])) for n in (need.lead_time, cover))
    spread = need.sigma * math.sqrt(cover)
    safety = z_score(need.service_level) * spread
    point, target = ltd + safety, mean + safety
    position = need.on_hand + need.on_order
    risk, short = shortfall(mean, spread, position)
    quantity, reason = 0, ABOVE
    if position < point:
        quantity, reason = pack_up(target - position, need.case_pack), BELOW
        least = pack_up(need.min_order, need.case_pack)
        if 0 < quantity < least:
            quantity, reason = least, reason + RAISED
        if need.max_order is not None and quantity > (most := pack_down(need.max_order, need.case_pack)):
            quantity, reason = most, reason + CAPPED
        if need.shelf_life is not None:
            sells = max(0, math.floor(sum(need.forecast[: need.shelf_life]) + 1e-9) - position)
            if quantity > (most := pack_up(sells, need.case_pack)):
                quantity, reason = most, reason + SHELF
    return Decision(ltd, safety, point, target, position, quantity, reason, risk, short * (need.unit_cost or 1.0))


def allocate(orders: Sequence[tuple[tuple, int, float, float]], budget: float | None) -> dict[tuple, int]:
    """Approved quantities by key. orders: key, quantity, unit cost, priority; the most urgent first, each if it still fits."""
    left, out = budget, {}
    for key, quantity, cost, _ in sorted(orders, key=lambda o: (-o[3], o[0])):
        if left is None or quantity * cost <= left * (1 + 1e-9) + 1e-9:
            out[key] = quantity
            left = None if left is None else max(0.0, left - quantity * cost)
        else:
            out[key] = 0
    return out


def parse_service_levels(text: str) -> dict[str, float]:
    """'A=0.98,B=0.95' as a mapping of classes to service levels."""
    out = {}
    for part in filter(None, (p.strip() for p in text.split(","))):
        name, eq, value = (x.strip() for x in part.partition("="))
        if not eq or name.upper() not in ("A", "B", "C") or name.upper() in out:
            raise ValueError(f"bad service level {part!r}: A, B or C = level, each once")
        level = float(value)
        z_score(level)
        out[name.upper()] = level
    return out
