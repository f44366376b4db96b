"""Thresholds and vocabularies. Every threshold can be set by an environment variable TIDECURVE_<NAME>, read on import."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

ALGORITHM_VERSION = "tidecurve-1"

# Quality flags of a reading and the set that blocks a window.
OUT_OF_RANGE, IMPLAUSIBLE_RATE, WARMUP, COMPRESSION_LOW, SENSOR_TRANSITION_STEP, SCAN_VALUE = 1, 2, 4, 8, 16, 32
BLOCKING = OUT_OF_RANGE | IMPLAUSIBLE_RATE | WARMUP | COMPRESSION_LOW

# Closed vocabularies.
QUALITIES = ("ok", "degraded", "excluded")
EXCLUSIONS = ("sensor_warmup", "prev_meal_too_close", "vendor_change", "next_meal_too_soon", "no_glucose_data", "insufficient_coverage", "gap_too_large", "flagged_readings", "no_baseline", "activity_in_window")
DEGRADATIONS = ("next_meal_limits_window", "weak_baseline", "peak_underestimated", "partial_coverage", "sensor_session_change")
INFORMATIONAL = ("peak_underestimated",)
SHAPES = ("monophasic", "biphasic", "plateau", "flat", "unknown")
MEAL_TYPES = ("breakfast", "lunch", "dinner", "snack", "drink", "unknown")
MMOL_TO_MGDL = 18.0182


@dataclass(frozen=True)
class Thresholds:
    """Minutes, mg/dL and hours as named. unit_s: seconds in a minute (other scales serve tests on other series)."""

    unit_s: int = 60
    # The defaults.
    post_window_min: int = 180
    baseline_offset_min: int = 5
    min_coverage_pct: float = 85.0
    physiological_min_mgdl: float = 40.0
    physiological_max_mgdl: float = 400.0
    max_rate_mgdl_per_min: float = 6.0
    analysis_warmup_hours: float = 12.0
    exclude_if_prev_meal_within_min: int = 180
    exclude_if_next_meal_within_min: int = 120
    degrade_if_next_meal_within_min: int = 180
    exclude_if_vendor_changed_within_h: float = 24.0
    sensor_step_threshold_mgdl: float = 15.0
    return_to_baseline_margin_mgdl: float = 10.0
    flat_curve_threshold_mgdl: float = 15.0
    peak_reliable_max_resolution_min: int = 5
    compression_drop_mgdl: float = 30.0
    compression_drop_window_min: int = 30
    compression_recovery_min: int = 60
    compression_low_mgdl: float = 80.0
    compression_recovery_share: float = 0.7
    max_interval_min: float = 60.0
    default_resolution_min: int = 15
    suggest_min_similarity: float = 0.45
    fuzzy_cap: float = 0.90
    auto_assign_min: float = 0.95

    @classmethod
    def from_env(cls) -> Thresholds:
        kinds = {"int": int, "float": float}
        given = {f.name: kinds[f.type](os.environ[k]) for f in fields(cls) if (k := f"TIDECURVE_{f.name.upper()}") in os.environ}
        return cls(**given)


DEFAULT = Thresholds.from_env()
