"""Frozen configuration objects and the fixed numbers of the feature definitions."""

from __future__ import annotations

from dataclasses import dataclass, field

PERSONAS = ("spoofing", "wash_trading", "pump_and_dump", "layering")
FAKE_DEPTH = ("spoofing", "layering")

# Thresholds of the account-window features.
FAST_CANCEL_TICKS = 10
LARGE_ORDER_MULTIPLE = 4.0
LAYER_MIN_LEVELS = 3
PEER_Z_COLUMNS = (
    "cancel_ratio", "fast_cancel_ratio", "avg_order_size_rel", "max_order_size_rel",
    "gross_volume_share", "reciprocal_ratio", "aggressor_ratio", "large_order_share",
)
SELF_Z_SCALE_FLOOR = {
    "avg_order_size_rel": 0.5,
    "max_order_size_rel": 0.5,
    "large_order_share": 0.10,
    "cancel_ratio": 0.10,
    "fast_cancel_ratio": 0.10,
    "n_orders": 2.0,
    "gross_volume_share": 0.02,
    "layered_order_share": 0.10,
}
SELF_Z_COLUMNS = tuple(SELF_Z_SCALE_FLOOR)
SELF_Z_MIN_HISTORY = 10
SELF_Z_TRIM = 4.0
TRIM_PASSES = 4
SELF_Z_EVIDENCE = 5.0
ACTIVITY_TRIM_LOG = 1.5
MUTUAL_MIN_SHARE = 0.10
RING_MIN_PAIR_SIZES = 2.0
LINK_MIN_EVENTS = 3
LINK_EVIDENCE = 4.0
LINK_PLACE_TICKS = 1
FEATURE_VERSION = 5
LABEL_MIN_OVERLAP = 15
ACTIVITY_TAGS = {
    "spoofing": ("s", "g", "f"),
    "layering": ("l", "g", "s"),
    "wash_trading": ("w",),
    "pump_and_dump": ("i", "x", "u", "p"),
}


def duration_to_ticks(value: int | str) -> int:
    """``180``, ``'180s'``, ``'3min'`` or ``'1h'`` as a whole number of one-second ticks."""
    if isinstance(value, int):
        return value
    text = value.strip().lower()
    digits = "".join(ch for ch in text if ch.isdigit() or ch == ".")
    unit = text[len(digits):].strip()
    scale = {"": 1, "s": 1, "sec": 1, "min": 60, "m": 60, "h": 3600, "d": 86400}[unit]
    return int(float(digits) * scale)


@dataclass(frozen=True)
class FeatureConfig:
    """Window geometry.  ``keys`` name one independent market, e.g. ('market', 'commodity')."""

    window: int | str = 180
    step: int | str = 30
    lookback_windows: int = 10
    exclude_prefixes: tuple[str, ...] = ("mm_",)
    keys: tuple[str, ...] = ("commodity",)

    @property
    def step_ticks(self) -> int:
        return max(1, duration_to_ticks(self.step))

    @property
    def window_ticks(self) -> int:
        return max(self.step_ticks, duration_to_ticks(self.window))

    @property
    def n_steps(self) -> int:
        return max(1, self.window_ticks // self.step_ticks)


@dataclass(frozen=True)
class BarConfig:
    bar_ticks: int = 60
    baseline: int = 60
    min_baseline: int = 20
    gap_minutes: int = 10
    label_min_overlap: int = 30
    sigma_floor_bp: float = 0.5


@dataclass(frozen=True)
class DetectorConfig:
    """Ensemble and training settings."""

    personas: tuple[str, ...] = PERSONAS
    families: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"fake_depth": FAKE_DEPTH})
    rule: str = "or_corroborated"
    contamination: float = 0.01
    market_contamination: float = 0.05
    min_prob_ratio: float = 0.5
    min_self_z: float = 6.0
    min_self_z_cols: int = 3
    iso_weight: float = 0.4
    supervised_weight: float = 0.6
    supervised_threshold: float = 0.5
    top_features: int = 5
    n_trees: int = 200
    max_samples: int = 256
    min_positives: int = 5
    require_all_personas: bool = False
    cv_folds: int = 3
    threshold_bounds: tuple[float, float] = (0.25, 0.9)
    plateau_tol: float = 0.005
    keep_tol: float = 0.01
    max_keep: int = 2
    hard_prefixes: tuple[str, ...] = (
        "lp_", "hedger_", "fund_", "rebalance_", "hft_", "algo_", "occ_",
        "spoofer_", "layerer_", "wash_", "pnd_",
    )
    hard_weight: float = 3.0
    max_class_weight: float = 50.0
    boosting_rounds: int = 300
    max_depth: int = 4
    step_size: float = 0.05
    subsample: float = 0.8
    feature_subset: str = "0.8"
    max_training_rows: int | None = None  # of one fit, all unless set; beyond it a hash thins all rows alike
    seed: int = 42
    min_case_windows: int = 2
    edge_ticks: int = 120
