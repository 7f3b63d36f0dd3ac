"""Fixed values of the domain.

Everything in this module is a constant that results depend on: element
lists, bounds, prices, atomic weights, thresholds, labels and text formats.
No logic lives here.
"""

from __future__ import annotations

# --- fixed values: column names -------------------------------------------
FULL_ELEMENTS = [
    "C", "Si", "Mn", "P", "S", "Cr", "Mo", "W", "Ni", "Cu",
    "V", "Nb", "N", "Al", "B", "Co", "Ta", "O", "Re",
]
DESIGN_ELEMENTS = ["C", "Si", "Mn", "Cr", "Mo", "W", "Ni", "V", "Nb", "N", "B"]
CONDITION_COLS = ["stress", "temp"]
HEAT_COLS = ["Ntemp", "Ntime", "Ttemp", "Ttime", "Atemp", "Atime"]
COOLING_COLS = ["Cooling1", "Cooling2", "Cooling3"]
SEVERITY_COLS = ["N_severity", "T_severity", "A_severity"]
PHYSICS_COLS = [
    "operating_severity",
    "stress_temperature_interaction",
    "inverse_temperature",
    "total_heat_treatment_severity",
]
TARGET = "lifetime"
LOG_TARGET = "log_lifetime"
LIFETIME_LIKE = [
    "lifetime", "log_lifetime", "rupture_time", "creep_life",
    "creep_lifetime", "hours", "rupture_hours",
]
STRESS_ALIASES = ["stress", "rupture_stress", "applied_stress"]
TEMP_ALIASES = ["temp", "temperature", "test_temp"]
PERMUTATION_FEATURES = [
    "temp", "stress", "operating_severity", "stress_temperature_interaction",
    "inverse_temperature", "total_heat_treatment_severity",
    "N_severity", "T_severity", "A_severity",
]

# --- fixed values: composition (wt%) --------------------------------------
FIXED_ELEMENTS = {
    "P": 0.005, "S": 0.002, "O": 0.001, "Co": 0.0,
    "Re": 0.0, "Al": 0.003, "Cu": 0.0, "Ta": 0.0,
}
DESIGN_BOUNDS = {
    "C": (0.08, 0.15),
    "Si": (0.10, 0.40),
    "Mn": (0.30, 0.60),
    "Cr": (8.5, 11.5),
    "Mo": (0.30, 1.20),
    "W": (1.00, 2.50),
    "Ni": (0.0, 0.40),
    "V": (0.18, 0.25),
    "Nb": (0.04, 0.08),
    "N": (0.03, 0.06),
    "B": (0.001, 0.010),
}
MAX_TOTAL_ALLOY = 15.0
ELEMENT_COST = {
    "Fe": 0.6, "Cr": 4.0, "C": 0.2, "Mo": 35.0, "W": 45.0, "V": 40.0,
    "Nb": 60.0, "Ni": 25.0, "Mn": 2.5, "Si": 2.0, "N": 1.0, "B": 15.0,
    "Al": 3.0, "Cu": 10.0, "P": 0.2, "S": 0.2, "Co": 60.0, "Ta": 200.0,
    "Re": 2500.0, "O": 0.0,
}
ATOMIC_WEIGHTS = {
    "Fe": 55.845, "C": 12.011, "Si": 28.085, "Mn": 54.938, "P": 30.974,
    "S": 32.06, "Cr": 51.996, "Mo": 95.95, "W": 183.84, "Ni": 58.693,
    "Cu": 63.546, "V": 50.942, "Nb": 92.906, "N": 14.007, "Al": 26.982,
    "B": 10.81, "Co": 58.933, "Ta": 180.948, "O": 15.999, "Re": 186.207,
}
MOLE_ELEMENTS = ["C", "Cr", "Mo", "W", "V", "Nb", "N", "Mn", "Si", "Ni"]
MAX_NON_IRON_MOLES = 0.95
ELEMENTAL_RISK = {"Re": 1.0, "Ta": 0.7, "Co": 0.5}

# --- fixed values: penalties (threshold, scale, normaliser) ---------------
METALLURGY_LIMITS = {
    "kn": (8.5, 1.5, 1.0),
    "ms_temp": (250.0, 1.2, 100.0),
    "laves_risk": (1.8, 1.5, 0.5),
    "z_phase_risk": (8.0, 1.2, 2.0),
    "ceq": (2.8, 1.0, 0.5),
    "mx_balance": (2.5, 0.8, 1.0),
    "total_alloy": (15.0, 2.0, 1.0),
}
PHASE_COLUMNS = {
    "LAVES_PHASE": "laves_fraction",
    "SIGMA": "sigma_fraction",
    "M23C6": "m23c6_fraction",
    "M6C": "m6c_fraction",
    "BCC_A2": "bcc_fraction",
    "FCC_A1": "fcc_fraction",
}
PHASE_LIMITS = {
    "laves": (0.03, 10.0, 0.01),
    "sigma": (0.01, 10.0, 0.01),
    "fcc": (0.05, 5.0, 0.02),
    "m6c": (0.05, 3.0, 0.02),
}
THERMO_FAILURE_PENALTY = 100.0
OOD_DEFAULT_THRESHOLD = 3.0
OOD_PENALTY_WEIGHT = 0.25
OOD_QUANTILE = 0.95
OOD_RIDGE = 1e-6
OOD_MISMATCH_VALUE = 9999.0
FAILED_OBJECTIVES = (-9999.0, 9999.0, 9999.0)

# --- fixed values: family filter ------------------------------------------
FAMILY_BOUNDS = {"cr": (8.0, 12.0), "ni": (0.0, 2.0), "fe_min": 80.0, "total_max": 20.0}
FAMILY_BOUNDS_RAW = {"cr": (8.0, 12.5), "ni_max": 2.0, "total_max": 20.0}
FAMILY_MIN_ROWS = 50

# --- fixed values: selection ----------------------------------------------
PENALTY_COLS = [
    "physics_risk", "metallurgy_penalty", "thermo_penalty",
    "ood_penalty", "elemental_ood_penalty",
]
SELECTION_PHASE_RULES = [
    # column, limit, weight, subtract the limit before weighting
    ("laves_fraction", 0.02, 10.0, True),
    ("sigma_fraction", 1e-6, 20.0, False),
    ("fcc_fraction", 0.05, 10.0, False),
    ("m6c_fraction", 1e-6, 10.0, False),
]
FLAG_VIOLATION = 100.0
SCORE_EPS = 1e-9
LIFE_BAND_LOG = 0.03
POLICY_VALID = "physical validity >= predicted life > target cost satisfaction"
POLICY_FALLBACK = "fallback: minimum physical violation score > maximum life > cost"
SEED_MAX_PENALTY = 20.0
POPULATION_SIZE = 300
MIN_DISTANCE = 0.15
MAX_ATTEMPT_FACTOR = 200

# --- fixed values: Larson-Miller and augmentation -------------------------
LMP_CONSTANT = 20.0
C_START, C_STOP, C_STEP = 10.0, 30.0, 0.25
AUG_MIN_GROUP = 5
AUG_MAX_RMSE = 0.35
AUG_RATIO = 1.0
AUG_MAX_PER_GROUP = 20
HOURS_PER_YEAR = 8760.0
KELVIN_OFFSET = 273.15

# --- fixed values: sweeps -------------------------------------------------
SWEEP_DEFAULTS = {
    "temp_min": 700.0, "temp_max": 1200.0,
    "stress_min": 10.0, "stress_max": 600.0,
    "fixed_stress": 150.0, "fixed_temp": 873.0,
}
SWEEP_POINTS = 80
HEATMAP_POINTS = 35
DEFAULT_PRODUCT_PREFIX = "제품 "
STAGE_LABELS = {"N": "노말라이징", "T": "템퍼링", "A": "시효처리"}
FEATURE_GROUP_LABELS = {0: "운전조건", 1: "합금조성", 2: "열처리", 3: "물리파생"}
STATUS_LIMITS = {
    # column: (ok up to, warn up to)
    "bcc_fraction": (0.8, 1.0),
    "m23c6_fraction": (0.05, 0.1),
    "laves_fraction": (0.02, 0.05),
    "sigma_fraction": (0.01, 0.03),
    "fcc_fraction": (0.05, 0.1),
}
LIFE_STATUS = (4.0, 3.0)
COST_STATUS = (30.0, 60.0)
RISK_STATUS = (10.0, 50.0)

# --- fixed values: text patterns ------------------------------------------
SEED_BLOCK_PATTERN = r"(?s)\[\s*\{.*\}\s*\]"
CONTROL_PATTERN = r"[\x00-\x1F\x7F]"
METRIC_PATTERNS = {
    "rmse_log": r"최종 RMSE\(log10\):\s*([-+0-9.]+)",
    "mae_log": r"최종 MAE\(log10\):\s*([-+0-9.]+)",
    "r2_log": r"최종 R2\(log10\):\s*([-+0-9.]+)",
    "rmse_hours": r"최종 RMSE\(hours\):\s*([-+0-9.]+)",
    "mae_hours": r"최종 MAE\(hours\):\s*([-+0-9.]+)",
}
EMPTY_TEXT = ["", "nan", "none", "null"]

# --- fixed values: rule-based seed compositions (DESIGN_ELEMENTS order) ---
RULE_SEEDS = [
    (0.10, 0.25, 0.45, 9.20, 0.50, 1.80, 0.10, 0.21, 0.060, 0.045, 0.005),
    (0.11, 0.20, 0.50, 9.50, 0.70, 1.60, 0.08, 0.22, 0.055, 0.045, 0.004),
    (0.09, 0.30, 0.40, 8.90, 0.90, 2.00, 0.05, 0.20, 0.050, 0.040, 0.006),
    (0.12, 0.18, 0.48, 10.00, 0.40, 1.50, 0.10, 0.23, 0.065, 0.050, 0.004),
    (0.10, 0.22, 0.42, 10.30, 0.35, 1.30, 0.12, 0.21, 0.050, 0.040, 0.005),
    (0.13, 0.15, 0.50, 9.10, 0.60, 2.20, 0.05, 0.24, 0.070, 0.055, 0.003),
    (0.10, 0.28, 0.38, 9.70, 0.80, 1.70, 0.00, 0.20, 0.060, 0.050, 0.006),
    (0.11, 0.24, 0.44, 8.80, 1.00, 1.90, 0.08, 0.22, 0.060, 0.050, 0.005),
    (0.09, 0.26, 0.52, 10.80, 0.30, 1.20, 0.15, 0.19, 0.045, 0.035, 0.004),
    (0.12, 0.20, 0.46, 9.40, 0.55, 1.85, 0.05, 0.23, 0.060, 0.045, 0.005),
]
SEED_VERSION = "ferritic_v2_design_variables_fixed_elements"
