"""Constants of the motion analysis. Results depend on each of them."""

MIN_DURATION_SEC, MAX_DURATION_SEC = 1.5, 20.0
MAX_INFER_FRAMES = 480
LOW_FPS = 30.0
DARK_MEAN = 40.0
BRIGHTNESS_SAMPLES = 10
MISS_NO_PERSON, MISS_LOW_QUALITY = 0.50, 0.15
LOW_VISIBILITY, LOW_VISIBILITY_SHARE = 0.50, 0.30

SMOOTH_SEC = 0.08
V_STILL, V_PEAK_MIN = 0.55, 2.7
STILL_SEC_ADDRESS, STILL_SEC_FINISH = 0.10, 0.15
IMPACT_H_TOL, IMPACT_WIN_SEC = 0.35, 0.05
H_HIP, H_DOWNSWING = 0.18, 0.50
MIN_WRIST_TRAVEL = 1.07
FALLBACK_RATIOS = (0.35, 0.70, 0.50, 0.35)
TOP_MARGIN, TOP_REFINE_SEC = 0.05, 0.10
MIN_TOP_ADDRESS_SEC, MIN_IMPACT_TOP_SEC, MAX_DOWNSWING_SEC = 0.45, 0.06, 1.5
ADDRESS_H_MAX = 0.6
FINISH_FALLBACK_SEC = 0.10
MIN_SCALE = 1e-6
FOLLOW_RISE = 0.95
ROTATION_SIGN, TARGET_X = -1, 1
EPS = 1e-9

VIEW_RATIO_DTL = 0.13
SHOULDER_TO_HEIGHT = 0.26
CRITICAL_SPAN = 1.0

SEARCH_BACK_SEC, SEARCH_FORWARD_SEC = 0.05, 0.25
ROI_TOP_MARGIN, ROI_FRONT_WIDTH = 0.02, 0.60
MOTION_MIN_RATIO, TOP_K = 0.20, 3
MIN_SHIFT, MAX_SHIFT, IMPACT_OFFSET = 1, 12, -1
ANCHOR_WINDOW, ANCHOR_MIN_RATIO = 3, 0.7
WARN_SHIFT = 3
BALL_REACH_PX, BALL_WEIGHT = 60.0, 0.25
SHAFT_WEIGHT_DTL, SHAFT_WEIGHT_FACE = 0.15, 0.30

CLUB_RATIO_DTL, CLUB_RATIO_FACE = 0.59, 2.4
CLUB_MIN_PX, CLUB_MAX_FRAMES = 10.0, 28
FAN_HALF_DEG, FAN_RADIUS = (45.0, 25.0), 1.3
GRIP_DISTANCE, COLLINEAR_DEG, COLLINEAR_DISTANCE = 0.08, 12.0, 0.06
SPEED_SWITCH = 1.65

TASK_TIMEOUT_SEC, RESULT_TTL_HOURS = 120.0, 168.0
MAX_UPLOAD_BYTES = 40 * 1024 * 1024
VIDEO_EXTENSIONS = ("mp4", "mov")
FRAME_RANGE = 30

# landmark numbers
NOSE = 0
L_SHOULDER, R_SHOULDER, L_ELBOW, R_ELBOW, L_WRIST, R_WRIST = 11, 12, 13, 14, 15, 16
L_HIP, R_HIP, L_KNEE, R_KNEE, L_ANKLE, R_ANKLE = 23, 24, 25, 26, 27, 28
SKELETON = (
    (11, 12), (11, 13), (13, 15), (12, 14), (14, 16), (11, 23), (12, 24), (23, 24), (23, 25), (25, 27), (24, 26), (26, 28),
)
