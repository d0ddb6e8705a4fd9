"""Schemas and fixed values of the yard data model.

Fixed values: these must equal the reference behaviour for results to
match, so they are stated here once, plainly.
"""

from __future__ import annotations

from pyspark.sql.types import StringType, StructField, StructType

# --- fixed values -----------------------------------------------------------
# Raw arrival / snapshot record: six string columns, bound by position.
RAW_COLUMNS = ["id", "size", "weight", "departure_time", "type", "slot"]
RAW_SCHEMA = StructType([StructField(c, StringType(), True) for c in RAW_COLUMNS])

# Container types accepted by the silver domain check.
ALLOWED_TYPES = ["import", "export", "transshipment"]
# Container sizes (feet) accepted by the silver domain check.
ALLOWED_SIZES = [20, 40]
# Inclusive weight bounds (tonnes) of the silver domain check.
WEIGHT_MIN, WEIGHT_MAX = 1.0, 50.0

# Anomaly labels, in the order they are decided.
NULL_CRITICAL = "NULL_CRITICAL_COLUMNS"
DUPLICATE_ID = "DUPLICATE_ID"
DOMAIN_VIOLATION = "DOMAIN_VIOLATION"
CRITICAL_COLUMNS = ["id", "weight", "size", "departure_time"]

# Departure-time text formats tried after the default ISO parse, in order.
DEPARTURE_FORMATS = [
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "yyyy-MM-dd'T'HH:mm:ss",
    "M/d/yyyy H:mm",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd",
]
ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss"
DISPLAY_FORMAT = "yyyy-MM-dd HH:mm"

# Size-zone policy: primary blocks, then backup blocks, per container size.
SIZE_POLICY = {
    20: {"primary": ["A", "B"], "backup": ["S1"]},
    40: {"primary": ["C", "D"], "backup": ["S2"]},
}
BACKUP_BLOCKS = ["S1", "S2"]

# Slot score weights.
W_REHANDLES = 3.0
W_HEIGHT = 2.0
W_DISTANCE = 1.0
BACKUP_TIER_BONUS = -5.0
DIST_BLOCK, DIST_BAY, DIST_ROW = 0.5, 0.3, 0.2
TOP_K = 10

# Flags and bands.
HEAVY_T = 20.0
URGENT_T = 25.0
BAND_RED, BAND_AMBER = 90.0, 70.0
DETAIL_ALERT = 80.0
YARD_ALERT_SHARE = 0.8

# Block layout (metres).
SLOT_WIDTH = 2.8
SLOT_LENGTH = 6.4
TIER_HEIGHT = 2.6
MAIN_ROAD = 30.0
SERVICE_LANE = 20.0
# Fixed grid cells (column, row) of the named blocks.
BLOCK_CELLS = {"A": (1, 0), "B": (1, 1), "C": (0, 0), "D": (0, 1), "S1": (0, 2), "S2": (1, 2)}

# Reference clock used by scoring and the probe container.
REFERENCE_NOW = "2026-03-04 14:00:00"
PROBE_WEIGHT = 10.0
PROBE_DEPARTURE = "2026-03-20 00:00:00"
DEFAULT_SIZE = 20
# --- end of fixed values ----------------------------------------------------


class YardSpec:
    """Dimensions of one yard layout (every yard_id shares it)."""

    def __init__(self, n_blocks: int = 4, n_bays: int = 24, n_rows: int = 6,
                 max_height: int = 7, include_backup: bool = True):
        if n_blocks <= 0 or n_rows <= 0 or max_height <= 0 or n_bays <= 0:
            raise ValueError("yard dimensions must be positive")
        ids = [chr(ord("A") + i) for i in range(n_blocks)]
        if include_backup:
            ids += [b for b in BACKUP_BLOCKS if b not in ids]
        self.block_ids = ids
        self.n_bays = n_bays
        self.n_rows = n_rows
        self.max_height = max_height

    @property
    def n_blocks(self) -> int:
        return len(self.block_ids)

    @property
    def capacity(self) -> int:
        return self.n_blocks * self.n_bays * self.n_rows * self.max_height

    @property
    def n_piles(self) -> int:
        return self.n_blocks * self.n_bays * self.n_rows


# The yard the derived fixture tables are laid out in (see FIXTURES.md).
FIXTURE_YARD = YardSpec(n_blocks=4, n_bays=24, n_rows=6, max_height=7)
