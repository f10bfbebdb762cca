"""Thresholds and weights of the screening; pass another instance to change them."""

from __future__ import annotations

from dataclasses import dataclass

# Required result levels, lowest first.
RISK_LEVELS = ("Low", "Medium", "High")

NO_SIGNAL_REASON = "No major anomaly signals detected"


@dataclass(frozen=True)
class ScreeningConfig:
    # flags: strictly above for cost and delay, at or above for the others
    overrun_flag_pct: float = 20.0
    estimate_flag_pct: float = 25.0
    delay_flag_pct: float = 20.0
    delayed_status: str = "delayed"
    zscore_flag: float = 2.0
    similarity_threshold: float = 0.80

    # value at which a component score reaches its weight
    overrun_full_pct: float = 60.0
    delay_full_pct: float = 60.0
    similarity_zero_pct: float = 80.0
    similarity_full_pct: float = 100.0
    zscore_full: float = 4.0

    cost_weight: float = 30.0
    delay_weight: float = 30.0
    duplicate_weight: float = 20.0
    spending_weight: float = 20.0

    medium_from: float = 40.0
    high_from: float = 70.0

    @property
    def total_weight(self) -> float:
        return (
            self.cost_weight
            + self.delay_weight
            + self.duplicate_weight
            + self.spending_weight
        )


DEFAULT = ScreeningConfig()
