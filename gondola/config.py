"""All thresholds and weights in one place.  Fixed values: results depend on them."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Thresholds:
    # price facts
    outlier_multiple: float = 5.0
    band_min: float = 8.0
    band_max: float = 25.0
    band_per_cv: float = 0.16
    cv_unknown: float = 30.0
    gap_low: float = 50.0
    gap_medium: float = 25.0
    least_products: int = 10
    stale_days: int = 14
    least_history: int = 3
    persistent: int = 4
    big_move: float = 10.0
    move_limit: float = 50.0
    streak: int = 3
    # trends
    index_move: float = 0.5
    interest_move: float = 5.0
    slope_move: float = 0.3
    season: float = 1.2
    stale_months: int = 4
    # scores
    shelf_full: float = 50.0
    weeks: float = 52.0
    index_flat: float = 0.1
    healthy_per_pct: float = 7.5
    confidence_high: float = 75.0
    confidence_medium: float = 50.0
    # pricing
    smoothing: float = 15.0
    demand_high: float = 65.0
    demand_medium: float = 45.0
    safe_full: float = 60.0
    safe_least: float = 40.0
    margin_avoid: float = 80.0
    margin_raise: float = 65.0
    support_raise: float = 70.0
    support_hold: float = 70.0
    support_strong: float = 75.0
    threat_protect: float = 70.0
    cut_gap: float = 10.0
    trusted: float = 45.0
    # actions
    expand_ready: float = 80.0
    expand_confidence: float = 70.0
    pitch_floor: float = 65.0
    margin_fix: float = 70.0
    tier_prime: float = 75.0
    tier_solid: float = 55.0
    tier_watch: float = 35.0
    least_index_months: int = 13
    opportunity: dict[str, float] = field(default_factory=lambda: {
        "demand": 0.25, "ready": 0.20, "shelf_risk_inv": 0.20, "confidence": 0.15, "pricing_power": 0.10, "margin_risk_inv": 0.10})
    # stand-ins: scale of the indices, and money of the tables for one unit of their basket
    index_scale: float = 10000.0
    price_unit: float = 1000.0


T = Thresholds()
