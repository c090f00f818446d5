"""Fixed values of the method, stated once."""

HORIZON_DAYS = 14
HORIZON_GRID = (7, 10, 14, 21)
MIN_PLAY = 50
MIN_ITEMS = 50
TEMPORAL_QUANTILES = (0.70, 0.85)
FOLDS = 4
SEED = 0
PRECISION_TARGET = 0.65
CONFORMAL_ALPHA = 0.10

DAY_US = 86_400_000_000

# Tracking job
MIN_GAP_HOURS = 6
BASELINE_ITEMS = 15
BASELINE_MIN = 5
RETRAIN_MIN_ROWS = 25
BIAS_MAX_SHARE = 0.8
BIAS_MIN_LABELS = 10

# Counter columns of the engagement panel
COUNTERS = ("play_count", "like_count", "comment_count", "share_count", "collect_count")
ENGAGEMENT = COUNTERS[1:]

# Names that may never appear in a pre-publication feature set
ENGAGEMENT_TOKENS = (
    "play_count", "like_count", "comment_count", "share_count", "collect_count",
    "download_count", "whatsapp_share_count", "_d1", "day1", "engagement",
)
HORIZON_TOKENS = (
    "play_count", "like_count", "comment_count", "share_count", "collect_count",
    "download_count", "whatsapp_share_count",
)
DAY1_ALLOWED = ("log_play_d1", "log_like_d1", "er_d1", "log_play_d1_vs_author")
LABEL_COLUMNS = (
    "breakout_wc", "er_wc", "follgrow", "views_at_H",
    "y_breakout_wc", "y_er_wc", "y_follgrow",
)
