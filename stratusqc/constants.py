"""Sensor limits, confidences, thresholds and texts.

Results are only comparable between deployments when these agree, so they are
stated once, literally, and every operator takes them as parameter defaults.
"""

# Monitored variables, in their reporting order.
VARIABLES = (
    "temperature",
    "humidity",
    "pressure",
    "wind_speed",
    "wind_direction",
    "rainfall",
    "solar_radiation",
)
CIRCULAR_VARIABLES = ("wind_direction",)
ZERO_EXEMPT_VARIABLES = ("rainfall", "solar_radiation")

# Default limits (min, max, step_max, persistence_max, unit).
DEFAULT_SPECS = {
    "temperature": (-10.0, 55.0, 8.0, 6, "°C"),
    "humidity": (0.0, 100.0, 30.0, 6, "%"),
    "pressure": (850.0, 1080.0, 15.0, 6, "hPa"),
    "wind_speed": (0.0, 65.0, 20.0, 6, "m/s"),
    "wind_direction": (0.0, 360.0, 180.0, 6, "degrees"),
    "rainfall": (0.0, 300.0, 100.0, 6, "mm"),
    "solar_radiation": (0.0, 1500.0, 500.0, 6, "W/m²"),
}
# Used for a field that a station's own record leaves out.
OPEN_LIMITS = (-9999.0, 9999.0, 9999.0, 6)

# Rule layer.
FLATLINE_TOLERANCE = 1e-5
HISTORY_DEPTH = 20

# Spatial layer.
EARTH_RADIUS_KM = 6371.0
NEIGHBOR_K = 5
NEIGHBOR_MAX_KM = 150.0
MIN_NEIGHBORS = 2
SPATIAL_Z = 3.0
SPATIAL_MIN_DELTA = 3.5
SPATIAL_MIN_STD = 1.0

# Models.
FEATURES = ("value", "delta_1", "rolling_mean_diff", "rolling_std", "hour_sin", "hour_cos")
FEATURE_WINDOW = 6
SEQUENCE_LENGTH = 12
FOREST_TREES = 100
FOREST_SAMPLE = 256
FOREST_CONTAMINATION = 0.03
FOREST_SEED = 42

# Enumerations.
STATION_STATUS = ("active", "maintenance", "decommissioned")
VERDICTS = ("valid", "suspect", "anomalous")
SEVERITIES = ("low", "medium", "high", "critical")
ALERT_STATUS = ("open", "acknowledged", "resolved")
FEEDBACK_LABELS = ("confirmed_fault", "false_alarm", "unsure")

# Failure-risk model (weights of the logit, and caps).
RISK_INTERCEPT = -2.5
RISK_WEIGHTS = {
    "drift": 2.6,
    "flatline": 2.2,
    "anomaly": 3.8,
    "alerts": 2.0,
    "dropout": 1.4,
    "age": 0.5,
}
# Driver names and field actions, in tie-breaking order.
RISK_DRIVERS = {
    "drift": "Sensor Drift Accumulation",
    "flatline": "Sensor Flatline / Freeze",
    "anomaly": "High QC Anomaly Rate",
    "alerts": "Unresolved Diagnostic Alerts",
    "dropout": "Telemetry Dropouts",
    "age": "Hardware Lifespan Aging",
}
RISK_ACTIONS = {
    "drift": "Recalibrate sensor probes: perform zero/span calibration on temperature RTD and capacitive humidity sensors.",
    "flatline": "Inspect sensor transducer bus: test for frozen analog-to-digital converter (ADC) or intermittent power rails.",
    "anomaly": "Priority maintenance dispatch: inspect station for physical damage, lightning surge, or degraded wiring.",
    "alerts": "Acknowledge and clear active alerts: dispatch field crew for diagnostic fault resolution.",
    "dropout": "Inspect communications unit: check 4G/GPRS modem antenna, solar battery storage, and SIM connectivity.",
    "age": "Station approaching extended service life: schedule overhaul and component lifecycle replacement.",
}
NOMINAL_DRIVER = "Nominal Baseline"
NOMINAL_ACTION = "Subsystems operating nominally. Maintain scheduled routine sensor cleaning."
SILENT_DRIVER = "Zero Telemetry Received"
SILENT_ACTION = "Station offline or unpolled. Inspect power supply, solar charge controller, and cellular SIM."

# Wording of notifications by reason code; downstream readers match on it.
ALERT_TEXTS = {
    "RULE_RANGE": "Sensor value {value} breached physical bounds (Confidence: {confidence}%).",
    "RULE_FLATLINE": "Sensor stuck / persistent flatline detected ({flat_count} identical readings at {flat_value}).",
    "RULE_STEP": "Sudden implausible rate-of-change jump (+{delta}) without regional confirmation.",
    "ML_AND_SPATIAL_CONFIRMED": "Calibration drift confirmed by both ML reconstruction error and neighboring AWS deviation (Confidence: {confidence}%).",
    "SPATIAL_MISMATCH": "Spatial mismatch with neighboring stations (delta: {spatial_delta}, z-score: {z_score}).",
    "ML_ISOFOREST": "Statistical anomaly flagged by Isolation Forest (anomaly score: {ml_score}).",
}
ALERT_TEXT_OTHERWISE = "Anomalous sensor behavior detected ({reason}, Confidence: {confidence}%)."
ALERT_PREFIX = "[{severity}] {station_name} ({station_code}) - {variable}: "

# Accepted column names per field, first non-empty one wins.
COLUMN_ALIASES = {
    "station_code": ("station_code", "station_id", "station", "st_id", "stationcode"),
    "timestamp": ("timestamp", "time", "datetime", "date", "recorded_at"),
    "temperature": ("temperature", "temp", "temp_c", "air_temp"),
    "humidity": ("humidity", "rhum", "rh", "rel_humidity"),
    "pressure": ("pressure", "pres", "barometer", "baro", "slp"),
    "wind_speed": ("wind_speed", "wspd", "wind", "speed"),
    "wind_direction": ("wind_direction", "wdir", "direction"),
    "rainfall": ("rainfall", "rain", "prcp", "precipitation"),
    "solar_radiation": ("solar_radiation", "srad", "solar", "radiation"),
}
NULL_TOKENS = ("", "null", "NaN", "nan")
# Accepted non-ISO time formats, tried in order.
TIME_FORMATS = (
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "dd-MM-yyyy HH:mm:ss",
    "dd/MM/yyyy HH:mm:ss",
    "yyyy/MM/dd HH:mm",
)
# Decimals kept per variable when provider arrays become rows.
SERIES_DECIMALS = {
    "temperature": 2,
    "humidity": 1,
    "pressure": 1,
    "wind_speed": 2,
    "wind_direction": 0,
    "rainfall": 2,
    "solar_radiation": 1,
}
# Provider column -> field.
PROVIDER_COLUMNS = {
    "temperature": "temp",
    "humidity": "rhum",
    "pressure": "pres",
    "wind_speed": "wspd",
    "wind_direction": "wdir",
    "rainfall": "prcp",
    "solar_radiation": "srad",
}
# Daily aggregates of the archive feed.
DAILY_FIELDS = (
    "weather_code",
    "precipitation_sum",
    "rain_sum",
    "apparent_temp_mean",
    "temp_min",
    "temp_mean",
    "temp_max",
)
