"""Thresholds, factors and vocabularies.

Every constant below is a fixed value of the application being rebuilt; the
results only match when they are used unchanged.  Operators take them as
keyword defaults so callers can override any of them.
"""

from __future__ import annotations

# --- fixed values: event vocabulary -------------------------------------
EVENT_TYPES = ("sensor_reading", "alarm", "quality_check", "batch_start", "batch_end")
MEASURED_EVENT_TYPES = ("sensor_reading", "alarm", "quality_check")
LIFECYCLE_EVENT_TYPES = ("batch_start", "batch_end")
EQUIPMENT_TYPES = ("spray_dryer", "mixer", "heat_exchanger", "cip_unit", "packing", "flow_meter")
ALARM_CODES = ("MOISTURE_OUT_OF_SPEC", "VISCOSITY_OUT_OF_RANGE", "WATER_OVERCONSUMPTION")
ALARM_SEVERITIES = ("MEDIUM", "HIGH")
CIP_PHASES = ("pre_rinse", "caustic_wash", "intermediate_rinse", "acid_wash", "final_rinse")

# --- fixed values: silver classification --------------------------------
MOISTURE_IN_SPEC = (3.0, 5.0)        # inclusive -> IN_SPEC
MOISTURE_MARGINAL = (2.5, 5.5)       # inclusive -> MARGINAL, else OUT_OF_SPEC
ENERGY_LOW_BELOW = 50.0              # < 50 -> LOW
ENERGY_MEDIUM = (50.0, 200.0)        # inclusive -> MEDIUM, else HIGH

# --- fixed values: gold tables ------------------------------------------
EQUIPMENT_WINDOW = "5 minutes"
CO2_KG_PER_KWH = 0.233

# --- fixed values: serving rules ----------------------------------------
WARM_TEMPERATURE_C = 85.0            # machine status "warning" above this
CRITICAL_ALARM_COUNT = 3             # alert severity "critical" at or above this
BATCH_STATUS_COMPLIANCE = 90.0       # graph batch node "warning" below this
BADGE_COMPLIANCE_OK = 95.0
BADGE_COMPLIANCE_WARNING = 80.0
BADGE_FTR_OK = 95.0
KPI_FTR_UP = 95.0
KPI_COMPLIANCE_UP = 90.0
CARBON_ALARM_PCT = 10.0              # co2 vs average above this -> alarm, above 0 -> warning
ENERGY_INTENSITY_TARGET = 2.5        # kWh per kL
FLOW_FULL_SCALE = 5000.0             # flow gauge full scale (100 %)
NEWEST_BATCHES = 20
GRAPH_BATCHES = 15
GRAPH_EDGE_HOURS = 2
GRAPH_EDGE_LIMIT = 100

# --- fixed values: alarm rules at the sensor ----------------------------
DRYER_MOISTURE_LIMITS = (3.0, 5.0)   # alarm outside (exclusive bounds)
DRYER_MOISTURE_CENTER = 4.0
DRYER_HIGH_DEVIATION = 1.5           # |m - 4.0| > 1.5 -> HIGH
MIXER_VISCOSITY_LIMITS = (650.0, 1050.0)
CIP_WATER_LIMIT = 4500.0

# --- fixed values: what-if model ----------------------------------------
FAT_ENERGY_COEFF = 0.042
PROTEIN_VISCOSITY_COEFF = 1.8
VISCOSITY_ENERGY_COEFF = 0.003
TEMP_QUALITY_COEFF = 0.6
TEMP_ENERGY_COEFF = 0.018
FAT_QUALITY_COEFF = 3.5
BASE_HEAT_C = 72.0
BASE_QUALITY = 75.0
DEFAULT_VISCOSITY = 50.0
DEFAULT_FAT = 3.5
DEFAULT_PROTEIN = 3.2
DEFAULT_FTR = 95.0
DEFAULT_ALARM_COUNT = 10
FAT_DELTA_RANGE = (-1.0, 1.0)
PROTEIN_DELTA_RANGE = (-1.0, 1.0)
HEAT_RANGE = (60.0, 95.0)
HEAT_PRESETS = (("LTLT", 63.0), ("HTST", 72.0), ("UHT", 90.0))
DELTA_STEP = 0.1
RECOMMENDATIONS = (
    "Optimal: lower energy with maintained quality.",
    "Caution: significant energy cost increase. Consider reducing heat setting.",
    "Quality improved. Monitor energy use vs. margin gain.",
    "Quality degraded below threshold. Adjust protein or heat setting.",
    "Minor parameter change — within operational tolerance.",
)

# --- fixed values: live feed --------------------------------------------
POLL_SECONDS = 30
POLL_LIMIT = 60
HISTORY_SECONDS = 300
HISTORY_LIMIT = 500
FEED_ROWS = 8
BUFFER_ROWS = 300
RATE_TICK_SECONDS = 5
