"""Category labels and thresholds.

FIXED VALUES: these strings and limits must equal the reference pipeline's so
results line up label for label. They are stated here once, in natural order.
"""

# silver: play completion class by ms_played (< 30 s, < 150 s, else)
COMPLETION_SKIPPED = "Skipped (<30s)"
COMPLETION_PARTIAL = "Partial (30s-2.5m)"
COMPLETION_COMPLETE = "Complete (>2.5m)"
COMPLETION_LIMITS_MS = (30000, 150000)

# silver: time of day by local hour (0-5, 6-11, 12-17, else)
DAYPART_SILVER = ("Night", "Morning", "Afternoon", "Evening")
# profiling: same hour buckets, labels with ranges; night is the ELSE branch
DAYPART_EDA = ("Morning (6-11)", "Afternoon (12-17)", "Evening (18-23)", "Night (0-5)")

# profiling: content type
CONTENT_PODCAST, CONTENT_MUSIC, CONTENT_UNKNOWN = "Podcast", "Music", "Unknown"

# profiling: play duration buckets (upper limits in ms) and labels
DURATION_LIMITS_MS = (30000, 60000, 120000, 180000, 300000)
DURATION_LABELS = ("< 30 seconds", "30-60 seconds", "1-2 minutes", "2-3 minutes",
                   "3-5 minutes", "> 5 minutes")

# profiling: completion estimate (< 30 s, < 90 s, < 150 s, >= 150 s)
EDA_COMPLETION_LIMITS_MS = (30000, 90000, 150000)
EDA_COMPLETION_LABELS = ("Skipped immediately (<30s)", "Partial listen (30s - 1.5min)",
                         "Most of track (1.5 - 2.5min)", "Completed (>2.5min)")

# profiling: gap between consecutive plays, whole minutes (<= limit)
GAP_FIRST = "First play"
GAP_LIMITS_MIN = (5, 15, 30, 60, 180)
GAP_LABELS = ("0-5 min gap", "5-15 min gap", "15-30 min gap", "30-60 min gap",
              "1-3 hour gap", "> 3 hour gap")

# profiling: artist loyalty (plays per distinct track, strict >)
LOYALTY_HIGH, LOYALTY_MEDIUM = 5, 2
LOYALTY_LABELS = ("High Repetition", "Medium Repetition", "High Variety")
LOYALTY_MIN_PLAYS = 10

# profiling: impossible values
IMPOSSIBLE_LABELS = ("Negative play duration", "Play duration > 1 hour", "Future timestamps",
                     "Very old timestamps (pre-September 2013)")
IMPOSSIBLE_MAX_MS = 3600000
IMPOSSIBLE_OLDEST = "2013-09-01"
MISSING_CRITICAL_LABEL = "Records with no track name AND no episode name"

DUPLICATE_LABELS = ("Exact duplicates (all fields)", "Same track played at exact same timestamp")

# sessions: length class by session_duration_minutes (strict <)
LENGTH_LIMITS_MIN = (2.5, 15, 60, 180)
LENGTH_LABELS = ("Single Track (0-2.5 minutes)", "Short (2.5-15 minutes)", "Medium (15-60 minutes)",
                 "Long (1-3 hours)", "Marathon (>3 hours)")

# sessions: behaviour type, first match wins
TYPE_ACTIVE, TYPE_DISCOVERY, TYPE_VARIETY = "Active Search", "Discovery Mode", "Variety Seeker"
TYPE_ALBUM, TYPE_DEEP, TYPE_BALANCED = "Album Listening", "Deep Dive on Artist", "Balanced Session"
ACTIVE_SKIP_GT, SHUFFLE_GT = 33.33, 90
VARIETY_WEIGHTED_GT, FOCUSED_WEIGHTED_LT, ALBUM_COMPLETION_GT = 0.74, 0.20, 75

# sessions: engagement level
ENGAGEMENT_HIGH, ENGAGEMENT_MEDIUM, ENGAGEMENT_LOW = "High Engagement", "Medium Engagement", "Low Engagement"
HIGH_COMPLETION_GT, HIGH_SKIP_LT, MEDIUM_COMPLETION_GT = 80, 20, 60

# sessions: extremes report
EXTREME_LONGEST, EXTREME_TRACKS, EXTREME_DIVERSE = (
    "Longest Session", "Most Tracks in Session", "Most Diverse Session (weighted)")
EXTREME_DIVERSE_MIN_TRACKS = 10

# gold: top content sets
PERIOD_ALL, PERIOD_YEARLY = "All Time", "Yearly"
CONTENT_ARTIST, CONTENT_TRACK = "Artist", "Track"

# check labels
SECTION_TOP_ARTISTS = "Top 10 Artists"
CHECK_DUPLICATES = "Duplicate Check"
CHECK_PODCAST = "Podcast Leakage Check"
CHECK_DATE_RANGE = "Date Range"
CHECK_CLEANING = "Data Cleaning Summary"
CHECK_OVERLAPS = "Remaining Overlaps Analysis"
CHECK_TOTAL_SESSIONS = "Total Sessions"
CHECK_PLAY_COUNT = "Play Count Validation"

# diagnostics: ms_played thresholds compared when choosing min_ms (seconds)
MIN_MS_SWEEP_SECONDS = (0.5, 1, 2, 3, 5, 8)
# diagnostics: session percentiles
QUANTILE_LEVELS = (0.10, 0.25, 0.50, 0.75, 0.90)
