"""They must equal the published ones for results to agree."""

# velocity step
DEFAULT_VELOCITY_STEP = 3
MAX_VELOCITY_STEP = 10

# confidence below which a visible point counts as weak
LOW_CONFIDENCE = 0.60

# rulers and calibration
MIN_RULER_PIXELS = 8.0
DEFAULT_RULER_LENGTH_M = 1.0
MAX_RULER_ANGLE_DEG = 25.0
MIN_DEPTH_PIXELS = 12.0
PPM_RATIO_MAX = 8.0
EXTRAPOLATE_U = 0.35

# motion plane
MIN_QUAD_AREA_PX = 400.0
MIN_INTERIOR_ANGLE_DEG = 12.0
MAX_REPROJ_RMS_PX = 4.0
WARN_REPROJ_RMS_PX = 1.5
MIN_COVERAGE = 0.04
DEFAULT_PIXEL_SIGMA = 0.5
MAX_CONDITION = 1e8

# experiment classification
MIN_LINEAR_POINTS = 6
MIN_QUAD_POINTS = 8
MIN_PENDULUM_POINTS = 12
AUTO_CONFIRM_MIN = 0.62
AUTO_CONFIRM_MARGIN = 0.08
MAX_AUTO_NRMSE = 0.08
LIST_NRMSE = 0.18
SMALL_ACCEL_RATIO = 0.12
FREEFALL_DRIFT = 0.08
PERIOD_HINT_BOOST = 0.04

# stabilisation
SHAKE_CLUSTER_PX = 24.0
ANCHORS_PER_CORNER = 2
ANCHOR_MIN_DIST_SQ = 64.0
LUMA = (0.299, 0.587, 0.114)
CORNER_GRID = 8
CORNER_MIN_PX = 24
CORNER_SHARE = 0.22
ENERGY_SHARE = 0.2
MIN_ENERGY = 1e-6
PATCH_PX = 15
NCC_MIN = 0.42
NCC_SEARCH = (20, 48, 64, 8)  # near, mid, coarse, fine
NCC_COARSE_SCALE = 3

# template tracker
DEFAULT_TEMPLATE = 31
MIN_TEMPLATE = 15
MAX_TEMPLATE = 72
SEARCH_RADIUS = 48
EXPANDED_SEARCH_RADIUS = 96
GOOD_MATCH = 4.0
EVOLVE_RATE = 0.20
TETHER_RATE = 0.05
LOST_AFTER = 8
PEAK_LEVEL = 160.0

# stick figure that bright peaks are assigned to, pixels from the nose
POSE_TEMPLATE = (
    ("nose", 0, 0), ("left_eye", -4, -2), ("right_eye", 4, -2), ("left_ear", -8, 0), ("right_ear", 8, 0),
    ("left_shoulder", -18, 20), ("right_shoulder", 18, 20), ("left_elbow", -28, 40), ("right_elbow", 28, 40),
    ("left_wrist", -34, 58), ("right_wrist", 34, 58), ("left_hip", -12, 60), ("right_hip", 12, 60),
    ("left_knee", -14, 90), ("right_knee", 14, 90), ("left_ankle", -16, 120), ("right_ankle", 16, 120),
)

# off-plane audit
AUDIT_STRIDE = 8
OFF_PLANE_WARN_M = 0.03
OFF_PLANE_RATIO = 0.04

# chat and context
MAX_REPRESENTATIVE_POINTS = 24

# look-ahead prediction
PREDICTION_LOOKBACK = 4

# COCO-17 keypoints, in model order
POSE_KEYPOINTS = (
    "nose",
    "left_eye",
    "right_eye",
    "left_ear",
    "right_ear",
    "left_shoulder",
    "right_shoulder",
    "left_elbow",
    "right_elbow",
    "left_wrist",
    "right_wrist",
    "left_hip",
    "right_hip",
    "left_knee",
    "right_knee",
    "left_ankle",
    "right_ankle",
)

POSE_BONES = (
    ("left_shoulder", "right_shoulder"),
    ("left_hip", "right_hip"),
    ("left_shoulder", "left_elbow"),
    ("left_elbow", "left_wrist"),
    ("right_shoulder", "right_elbow"),
    ("right_elbow", "right_wrist"),
    ("left_hip", "left_knee"),
    ("left_knee", "left_ankle"),
    ("right_hip", "right_knee"),
    ("right_knee", "right_ankle"),
)

# metrics whose change can block a regression run
CORE_METRICS = (
    "center_median_px",
    "success_at_10px",
    "trajectory_completeness",
    "pck_at_0_05",
    "scale_relative_error",
    "axis_angle_error_deg",
    "origin_error_px",
    "period_relative_error",
    "gravity_relative_error",
    "rejection_when_no_ruler",
)
