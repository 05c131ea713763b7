"""Settings and fixed values of the analysis."""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values (they decide results, so they are stated as they are) -----------------------------------------
SENSOR_TYPES = ("temperature", "vibration", "moisture", "pressure")
SENSOR_STATUSES = ("normal", "warning", "anomaly", "offline")
SENSOR_STATUS_CHARS = {"normal": "n", "warning": "w", "anomaly": "a", "offline": "o"}
SEVERITIES = ("low", "medium", "high", "critical")
SEVERITY_WEIGHTS = {"low": 1.0, "medium": 2.0, "high": 4.0, "critical": 7.0}
SEVERITY_MIN_SCORE = (("critical", 0.70), ("high", 0.50), ("medium", 0.30))
ASSET_BANDS = (("normal", 90), ("watch", 70), ("at_risk", 45), ("critical", 0))
ASSET_STATUS_CHARS = {"normal": "n", "watch": "w", "at_risk": "r", "critical": "c"}
RISK_LEVELS = (("very_high", 75.0), ("high", 50.0), ("moderate", 25.0), ("low", 0.0))
AT_RISK_BELOW = 70
ATTENTION_BELOW = 90
PLAUSIBLE_RANGES = {
    "temperature": (-60.0, 150.0),
    "vibration": (0.0, 500.0),
    "moisture": (0.0, 100.0),
    "pressure": (0.0, 500.0),
}
UNITS = {"temperature": "°C", "vibration": "mm/s", "moisture": "%", "pressure": "psi"}
# (sensor_type, placement, warn_low, warn_high, crit_low, crit_high)
DEFAULT_THRESHOLDS = (
    ("vibration", "bridge_deck", None, 5.0, None, 10.0),
    ("vibration", "building_structure", None, 1.0, None, 3.0),
    ("vibration", "road_pavement", None, 2.5, None, 5.0),
    ("moisture", "road_subgrade", None, 35.0, None, 42.0),
    ("moisture", "foundation_perimeter", None, 35.0, None, 42.0),
    ("moisture", "abutment_backfill", None, 35.0, None, 42.0),
    ("temperature", "bridge_deck", None, 50.0, None, 58.0),
    ("temperature", "road_surface", None, 58.0, None, 65.0),
    ("temperature", "building_envelope", None, 40.0, None, 45.0),
    ("temperature", "equipment", None, 65.0, None, 75.0),
    ("pressure", "water_main", 40.0, 90.0, 20.0, 110.0),
)
MAD_TO_SIGMA = 1.4826
SCALE_FLOORS = {"temperature": 0.5, "vibration": 0.10, "moisture": 0.5, "pressure": 0.5}
DEFAULT_SCALE_FLOOR = 1e-6
SMALL_CLASS_FLOORS = {"temperature": 1.5}
MIN_CLASS_SENSORS = 4
LOG_DOMAIN_TYPES = ("vibration",)
WEEKPART_TYPES = ("vibration",)
PEER_TYPES = ("moisture", "temperature")
PEER_EMA_HOURS = {"moisture": (24.0, 72.0)}
LOG_VALUE_FLOOR = 1e-3
HUBER_C = 1.345
HUBER_ITERATIONS = 8
BAND_SIGMAS = 3.0
SCORE_WEIGHTS = {"magnitude": 0.50, "duration": 0.25, "threshold": 0.25}
MAGNITUDE_BASE_Z = 3.0
MAGNITUDE_DOUBLINGS = 4.0
DURATION_FULL_HOURS = 96.0
VIBRATION_SPIKE_MAX_HOURS = 3
PRESSURE_DECLINE_MIN_HOURS = 36
TEMPERATURE_DRIFT_MIN_HOURS = 24
DETECTORS = ("threshold", "robust_zscore", "rolling_median", "isolation_forest")
DETECTOR_PHRASES = {
    "threshold": "critical threshold",
    "robust_zscore": "robust z-score",
    "rolling_median": "rolling median",
}
ANOMALY_LABELS = {
    "vibration_spike": "Short elevated vibration",
    "sustained_high_vibration": "Sustained high vibration",
    "vibration_drop": "Unusually low vibration",
    "moisture_increase": "Unusual moisture increase",
    "moisture_decrease": "Unusual moisture decrease",
    "pressure_drop": "Pressure drop",
    "pressure_spike": "Short pressure excursion",
    "pressure_decline": "Gradual pressure decline",
    "temperature_spike": "Abnormal temperature rise",
    "temperature_drift": "Temperature drift",
    "temperature_drop": "Abnormal temperature drop",
}
GENERIC_LABEL = "Unusual readings"
CAUSAL_WORDS = (
    "fail", "unsafe", "damage", "leak", "break", "collapse", "danger", "caused", "because", "due to",
)
EARTH_RADIUS_M = 6371008.8
METRES_PER_DEGREE_LON = 111320.0
METRES_PER_DEGREE_LAT = 110540.0
MATCH_TOLERANCE_HOURS = 2.0
HULL_BUFFER_M = 40.0
MAX_RISK_AGE_HOURS = 14 * 24.0
MIN_STORED_RISK = 0.5
GRID_TOLERANCE = 1e-6
# --- end of fixed values ----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Params:
    """Tunable settings; hours and metres. The defaults are those of an hourly sensor network."""

    step_s: int = 3600
    timezone: str = "America/Chicago"
    z_strong: float = 6.0
    z_min: float = 3.0
    rolling_hours: float = 6.0
    rolling_level: float = 3.0
    rolling_min_readings: int = 4
    min_flagged: int = 3
    merge_gap_hours: float = 2.0
    short_hours: float = 3.0
    long_hours: float = 12.0
    forest_trees: int = 100
    forest_samples: int = 256
    forest_threshold: float = 0.62
    forest_seed: int = 42
    proximity_m: float = 100.0
    cluster_eps_m: float = 200.0
    cluster_eps_hours: float = 48.0
    cluster_min_points: int = 3
    cluster_min_sensors: int = 3
    hex_edge_m: float = 150.0
    risk_bandwidth_m: float = 250.0
    risk_half_life_hours: float = 72.0
    risk_reference: float = 14.0
    health_window_days: float = 7.0
    health_half_life_hours: float = 48.0
    health_reading_hours: float = 6.0

    @property
    def step_hours(self) -> float:
        return self.step_s / 3600.0

    def steps(self, hours: float) -> int:
        """A window length in whole grid steps, one at least."""
        return max(int(round(hours / self.step_hours)), 1)

    @property
    def merge_gap_steps(self) -> int:
        return max(int(self.merge_gap_hours / self.step_hours + 1e-9), 0)
