"""Windows and parameters of the registered queries over the star-schema tables."""

from __future__ import annotations

from rebuy.config import HybridConfig, production_config

# The last full month of the order table, so that nearly all rows are history.
CUTOFF = "2001-07-01"
VALID_END = "2001-08-01"
EVENT_START = "2001-06-10"

DEFAULT = HybridConfig(CUTOFF, VALID_END, event_start=EVENT_START)
PRODUCTION = production_config(CUTOFF, VALID_END, event_start=EVENT_START)
WITH_LOCATION = PRODUCTION.with_(location_weight=0.03)

BLEND_BASE = PRODUCTION
BLEND_MODEL = PRODUCTION.with_(k=20, repeat_weight=0.0, copurchase_weight=1.0, category_weight=0.0, global_weight=0.0)

# Ranker: train on June, evaluate on all buyers of July.
TRAIN_CUTOFF, TRAIN_END = "2001-06-01", "2001-07-01"
SAMPLE_SIZE = 100
SEED = 42

SPLITS = (
    ("2001-04", "2001-04-01", "2001-05-01"),
    ("2001-05", "2001-05-01", "2001-06-01"),
    ("2001-06", "2001-06-01", "2001-07-01"),
    ("2001-07", "2001-07-01", "2001-08-01"),
)
# Events are shifted to the last cutoff and lie in the month before it.
GRID_BASE = DEFAULT.with_(event_start="2001-03-01")

HEADS = 10_000
