"""Fixed values that results depend on."""

from __future__ import annotations

# Classes, in index order.
CLASSES = ("lying down", "sitting", "standing in place", "standing and moving", "walking", "running", "bicycling")
# Source label columns of the classes; both standing classes share one.
LABEL_COLUMNS = {
    "label:LYING_DOWN": "lying down",
    "label:SITTING": "sitting",
    "label:OR_standing": "standing in place",
    "label:FIX_walking": "walking",
    "label:FIX_running": "running",
    "label:BICYCLING": "bicycling",
}
PLACEMENT_COLUMNS = {
    "label:PHONE_IN_POCKET": "pocket",
    "label:PHONE_IN_HAND": "hand",
    "label:PHONE_IN_BAG": "bag",
    "label:PHONE_ON_TABLE": "table",
}
# Signal processing.
TARGET_HZ, MAX_GAP_S, LOWPASS_HZ, GRAVITY_HZ, FILTER_ORDER, MIN_GRAVITY_RUN_S = 25.0, 2.0, 10.0, 0.3, 2, 2.0
STANDARD_GRAVITY = 9.80665
UNIT_BANDS = {"g": (0.6, 1.6), "m/s^2": (6.0, 16.0)}
NOMINAL_SAMPLES, SPAN_TOLERANCE_S = 800, 5.0
FUSION_TAU_S, FUSION_SEED_SAMPLES = 1.5, 10
WINDOW_S, OVERLAP, MIN_VALID, CADENCE_LO_HZ, CADENCE_HI_HZ = 2.0, 0.5, 0.75, 0.5, 5.0
PROMINENCE_G, PROMINENCE_STD, QUIET_SMA = 0.05, 0.5, 0.02
MIN_ACTIVITY_S, CUSUM_RADIUS_S, MIN_COUNTS, PSEUDO, SELF_WEIGHT = 5.0, 3.0, 20, 5.0, 30.0
# Symmetric plausibility of direct transitions.
TRANSITION_WEIGHTS = {
    ("lying down", "sitting"): 3.0,
    ("lying down", "standing in place"): 1.0,
    ("lying down", "standing and moving"): 0.2,
    ("lying down", "walking"): 0.3,
    ("lying down", "running"): 0.05,
    ("lying down", "bicycling"): 0.05,
    ("sitting", "standing in place"): 3.0,
    ("sitting", "standing and moving"): 1.0,
    ("sitting", "walking"): 1.5,
    ("sitting", "running"): 0.1,
    ("sitting", "bicycling"): 0.5,
    ("standing in place", "standing and moving"): 3.0,
    ("standing in place", "walking"): 3.0,
    ("standing in place", "running"): 0.5,
    ("standing in place", "bicycling"): 1.0,
    ("standing and moving", "walking"): 3.0,
    ("standing and moving", "running"): 0.5,
    ("standing and moving", "bicycling"): 0.5,
    ("walking", "running"): 2.0,
    ("walking", "bicycling"): 1.5,
    ("running", "bicycling"): 0.5,
}
# Thresholds of the rules.
THRESHOLDS = {
    "static_sma": 0.03,
    "static_gyro": 0.30,
    "lie_tilt_lo": 20.0,
    "lie_tilt_hi": 160.0,
    "stand_tilt": 70.0,
    "run_sma": 0.45,
    "bike_rotation_ratio": 2.0,
    "walk_cadence_lo": 80.0,
    "run_cadence": 135.0,
    "periodic": 0.15,
    "run_jerk": 8.0,
    "freq_periodic_lo": 0.5,
    "lie_sma_hi": 0.008,
    "sit_sma_hi": 0.030,
    "lie_sma_tilt_hi": 0.004,
    "vert_std_moving": 0.05,
    "bike_gyro_dominance": 0.75,
    "bike_gyro_entropy_hi": 0.90,
    "phase_walk_lo": 0.30,
}
# Metabolic equivalents (point, low, high) and the flat table of the question path.
MET = {
    "lying down": (1.1, 0.95, 1.3),
    "sitting": (1.5, 1.3, 1.8),
    "standing in place": (1.8, 1.3, 2.3),
    "standing and moving": (2.3, 2.0, 3.0),
    "walking": (3.5, 2.0, 4.5),
    "running": (8.0, 6.0, 13.5),
    "bicycling": (7.5, 4.0, 10.0),
}
FLAT_MET = {"lying down": 1.0, "sitting": 1.3, "standing in place": 1.8, "standing and moving": 2.0, "walking": 3.5, "running": 8.0, "bicycling": 6.8}
FLAT_MET_UNKNOWN, DEFAULT_MASS_KG = 1.5, 62.0
# Event rule, rollups, coverage search, signatures.
JERK_CUT, TILT_CUT, TILT_STD_CUT, EVENT_MIN_S, SHORT_SEGMENT_S = 2.0, 70.0, 15.0, 2.0, 1.0
MINUTE_S, BOUT_GAP_MINUTES = 60, 1
WIDEN_S, PROBE_STEP_S, PROBE_MIN_S = 120, 1, 2.0
CADENCE_TOLERANCE_BPM = 5.0
GATED_ROUTES = ("task3", "task4", "b_anomaly")
EXEMPLAR_FEATURES = ("tilt_deg_mean", "tilt_deg_std", "sma", "cadence_bpm", "gyro_rms_x", "gyro_rms_y", "gyro_rms_z", "jerk_energy", "orientation_stability")
# Words that name an activity in a question; the first that occurs counts.
ALIASES = {
    "run": "running",
    "running": "running",
    "jog": "running",
    "walk": "walking",
    "walking": "walking",
    "bik": "bicycling",
    "cycl": "bicycling",
    "bicycle": "bicycling",
    "sit": "sitting",
    "sitting": "sitting",
    "seat": "sitting",
    "lie": "lying down",
    "lay": "lying down",
    "lying": "lying down",
    "sleep": "lying down",
    "stand": "standing in place",
    "standing": "standing in place",
}
# Question patterns in order; the first match decides route and confidence.
ROUTES = (
    (r"\b(calori\w*|kcal|energy|expenditure|burn|kilocal)\b", "b_energy", 0.95),
    (r"\b(met|metabolic equivalent)\b", "b_energy", 0.95),
    (r"\b(fall|fell|falling|trip\w*|stumbl\w*)\b", "b_anomaly", 0.97),
    (r"\b(unstead\w*|imbalance|wobbl\w*|unstable)\b", "b_anomaly", 0.95),
    (r"\b(anomal\w*|unusual event|impact|jerk spike|jerk-spike)\b", "b_anomaly", 0.90),
    (r"\b(prolonged (immobilit|stationar|still))\b", "b_anomaly", 0.88),
    (r"\b(update|set|change|record|store|save)\b.{0,40}\b(weight|height|profile|preference|age)\b", "personalization", 0.92),
    (r"\b(weight|height)\b.{0,30}\b(is|=|kg|cm|lb|pound|kilogram)\b", "personalization", 0.88),
    (r"\b(how (long|much time|many (minute|hour|step|bout|time))|total (time|duration|minute|hour)|duration)\b", "task2", 0.92),
    (
        r"\b((how (many|much)|what is the).*(data|recordings?|sensor data|coverage|dataset)|"
        r"((day|days|hour|hours|week|weeks|month|months|minute|minutes|time).*(data|recordings?|sensor data|coverage|dataset)|"
        r"(data|recordings?|sensor data|coverage|dataset).*(day|days|hour|hours|week|weeks|month|months|minute|minutes|time)))\b",
        "task2",
        0.90,
    ),
    (r"\b(how many (time|instance|occurrence|period|bout|episode)s?)\b", "task2", 0.90),
    (r"\b(more (than|or less)|less (than)|compar\w*|versus|vs\.?|differ\w*)\b.{0,60}\b(yesterday|last week|previous|prior)\b", "task2", 0.88),
    (r"\b(average|mean|median|per day|daily (total|average))\b", "task2", 0.85),
    (r"\b(trend|rolling|over (the )?(week|month|year))\b", "task2", 0.83),
    (r"\b(what (was|is|were) (she|he|they) doing)\b", "task1", 0.95),
    (r"\b(what activity|which activity|what (was|is) the activity)\b", "task1", 0.93),
    (r"\b(probability|confidence|likelihood|how (sure|certain|confident))\b", "task1", 0.90),
    (r"\b(is she|is he|are they|could she|might she) (walking|running|sitting|lying|standing|cycling|bicycl)\b", "task1", 0.88),
    (r"\b(when did (she|he|they) (start|stop|begin|finish|end)\b)", "task3", 0.93),
    (r"\b(what time|at what (point|moment)|onset|offset)\b", "task3", 0.90),
    (r"\b(still|already|yet|by \d{1,2}(:\d{2})?)\b.{0,40}\b(walk|run|sit|stand|lying|cycling|bicycl|sleep)\b", "task3", 0.88),
    (r"\b(was (she|he|they) (still|already|at|doing))\b", "task3", 0.87),
    (r"\b(how long (did|has) (she|he|they)\b)", "task3", 0.82),
    (r"\b(why|explain|describe|what does|what caused|reason|tell me (about|more))\b", "task4", 0.87),
    (r"\b(pattern|unusual|normal|typical|characteristic|signature)\b", "task4", 0.82),
    (r"\b(suggest|recommend|advice|should she)\b", "task4", 0.80),
)
ROUTE_THRESHOLD, MODEL_KNOWN, MODEL_UNKNOWN = 0.75, 0.70, 0.50
