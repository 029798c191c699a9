"""Fixed values of the evaluation model: names, orders and thresholds that results depend on."""

# Fixed values. Sites in output order and their left/right counterparts.
SITES = ("LUE", "RUE", "LLE", "RLE")
MIRROR = {"LUE": "RUE", "RUE": "LUE", "LLE": "RLE", "RLE": "LLE"}
SITE_BODY = {
    "LUE": ("upper_extremity", "left"),
    "RUE": ("upper_extremity", "right"),
    "LLE": ("lower_extremity", "left"),
    "RLE": ("lower_extremity", "right"),
}

# Fixed values. Classes in probability order.
CLASSES = ("no_injury", "wound", "amputation", "not_testable")
NO_INJURY, WOUND, AMPUTATION, NOT_TESTABLE = range(4)
CLASSES3 = ("no_injury", "amputation", "not_testable")

# Fixed values. Label rules: name -> (visible-fraction cut-off, wound rule, amputation rule).
LABEL_RULES = {
    "v3_compat": (0.10, "visible", "any"),
    "guide_primary": (0.0, "visible", "observable"),
    "guide_wound_present": (0.0, "present", "observable"),
    "guide_amp_any": (0.0, "visible", "any"),
}
LABEL_THRESHOLDS = (0.0, 0.10, 0.25, 0.50)
WOUND_MIN_PX = 20
STUMP_MIN_PX = 20

# Fixed values. Consequence cost, truth rows by predicted columns.
COST = ((0, 3, 3, 2), (40, 0, 3, 10), (100, 40, 0, 40), (1, 3, 3, 0))

# Fixed values. Ledger thresholds, key pixels and feature groups (indices into FEATURES).
KEY_PIXELS = {"wound": "wound_px", "amputation": "stump_px"}
GROSS_SIZE = {"amputation": 300, "wound": 200}
GROSS_CONFIDENCE = 0.8
FEATURE_GROUPS = {
    "visibility": (0, 1, 2, 13),
    "end_state": (3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 14),
    "wound": (15, 16, 17),
    "tourniquet": (18,),
}

# Fixed values. Categories counted in the ring around a limb end, and feature names.
RING = ("BG", "OCC", "TORSO", "OTHER_LIMB", "EDGE")
FEATURES = (
    "log_vis_px", "Lfrac", "bg_frac", "pe_visible", "pe_stump", "pe_hidden", "log_ext_px", "log_stump_px",
    "ring_BG", "ring_OCC", "ring_TORSO", "ring_OTHER_LIMB", "ring_EDGE",
    "vis_over_torso2", "window_present", "p_wound", "log_wound_px", "wound_frac", "log_tq_px",
)
LIMB_FEATURES = (
    "log_amodal_px", "vis_over_amodal", "term_peak", "p_cause_intact_visible", "p_cause_occluded",
    "p_cause_out_of_frame", "p_cause_amputated_visible", "p_cause_amputated_hidden",
)

# Fixed values. Body keypoint indices per site (proximal, middle, distal) and joint names per limb.
KEYPOINTS = {"LUE": (5, 7, 9), "RUE": (6, 8, 10), "LLE": (11, 13, 15), "RLE": (12, 14, 16)}
JOINTS = {"UE": ("shoulder", "elbow", "wrist"), "LE": ("hip", "knee", "ankle")}
KEYPOINT_COUNT = 133

# Fixed values. Event vocabulary.
EVENT_SCHEMA_VERSION = "0.2.0"
VIEW_OF = {"front": "anterior", "back": "posterior", "edge": "oblique", "edge_on": "oblique"}

# Fixed values. Grids searched when fitting.
C_GRID = (0.03, 0.1, 0.3, 1.0, 3.0)
ARM_REAL_C = (0.03, 0.1, 0.3, 1.0)
ARM_POOL_W = (1.0, 3.0, 10.0)
ARM_RECAL_C = (0.01, 0.1)

# Fixed values. Publish guard and privacy policy.
SIDE_OUTPUT_SUFFIXES = ("_part3", "_id", "_amodal", "_occ", "_injury")
GENERATOR_PATTERN = r"^scene\d+/\d"
DENY_SUBSTRINGS = (
    "arcface", "facenet", "insightface", "face_recognition", "reid", "re-id",
    "person_reid", "deepface", "vggface", "adaface",
)
PROVENANCE_KEYS = ("generator", "commit", "params_sha256", "blender", "device", "pythonhashseed", "time_s")
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".bmp", ".tif", ".tiff", ".webp")

# Fixed values. Slice edges.
VISIBILITY_BANDS = ((0.10, "<0.10"), (0.25, "0.10-0.25"), (0.50, "0.25-0.50"))
WOUND_SIZE_BINS = ((0, 1), (1, 20), (20, 60), (60, 150), (150, 10**9))
STUMP_SIZE_BINS = ((0, 1), (1, 50), (50, 200), (200, 600), (600, 10**9))
ERROR_TAGS = ("S1", "S2", "S3", "S4")
