"""Column bindings and thresholds with their domain defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Trades:
    """Columns of a filed trade."""

    security: str = "security"
    person: str = "person"
    side: str = "side"
    quantity: str = "quantity"
    value: str = "value"
    day_from: str = "day_from"
    day_to: str = "day_to"


@dataclass(frozen=True)
class Limits:
    """Thresholds of the domain, all of which a caller can replace."""

    decision_days: int = 90
    decision_value: float = 25e5
    steady_days: int = 10
    big_value: float = 25e7
    history_days: int = 365
    routine_months: int = 6
    round_trip_tolerance: float = 0.01
    maker_legs: int = 40
    maker_balance: float = 0.8
    maker_days: int = 91
    price_tolerance: float = 0.02
    price_far: float = 0.20
    price_powers: tuple[int, ...] = (2, 3, 5, 6, 7)
    face_values: tuple[int, ...] = (1, 2, 5, 10)
    asof_days: int = 10
    stage_days: int = 180
    jump: float = 0.40
    horizons: tuple[int, ...] = (5, 21, 63, 126)
    cost: float = 0.25
    spacing: int = 21
    hold: int = 63
    high_rows: int = 250
    high_least: int = 120
    evidence_cases: int = 30
    crossings: tuple[int, ...] = (5, 10, 15, 20, 25, 50, 75)
    examples: int = 25


LIMITS = Limits()
