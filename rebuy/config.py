"""Settings of the recommendation jobs. All time windows are half-open ``[start, end)``."""

from __future__ import annotations

from dataclasses import dataclass, replace

# Action weights, invalid ids, metadata levels.
PURCHASE_WEIGHT = 8.0
CART_WEIGHT = 3.0
VIEW_WEIGHT = 1.0
INVALID_ITEM_IDS = ("", "(not set)")
EVENT_TYPES = ("view_item", "add_to_cart")
METADATA_LEVELS = ("category_l1", "category_l2", "category_l3", "brand")


@dataclass(frozen=True)
class HybridConfig:
    """Parameters of the hybrid recommender.

    ``half_life_days`` is kept under its customary name, but the decay is
    ``exp(-age / half_life_days)``: an e-folding time.
    """

    cutoff: str
    valid_end: str
    k: int = 10
    half_life_days: float = 60.0
    max_user_items: int = 80
    repeat_weight: float = 1.0
    copurchase_weight: float = 0.35
    category_weight: float = 0.0
    location_weight: float = 0.0
    global_weight: float = 0.05
    max_basket_items: int = 12
    max_neighbors: int = 40
    max_seeds: int = 20
    category_level: str = "category_l2"
    max_category_items: int = 30
    max_location_items: int = 40
    include_events: bool = True
    event_start: str = "2025-01-01"

    @property
    def global_limit(self) -> int:
        return max(self.k * 20, 200)

    def with_(self, **changes) -> "HybridConfig":
        return replace(self, **changes)


def production_config(cutoff: str, valid_end: str, **changes) -> HybridConfig:
    """The configuration that was chosen for the final lists."""
    cfg = HybridConfig(
        cutoff,
        valid_end,
        half_life_days=60.0,
        copurchase_weight=0.15,
        category_weight=0.06,
        category_level="brand,category_l3",
        location_weight=0.0,
        global_weight=0.05,
    )
    return cfg.with_(**changes)


def metadata_levels(spec: str) -> list[str]:
    """Parse a comma-separated level list; empty means ``category_l2``."""
    wanted = [part.strip() for part in spec.split(",") if part.strip()]
    bad = sorted(set(wanted) - set(METADATA_LEVELS))
    if bad:
        raise ValueError(f"unknown metadata levels {bad}; choose from {sorted(METADATA_LEVELS)}")
    return wanted or ["category_l2"]
