"""Table schemas: raw plays (account key + 23 export columns), silver, sessions."""

from pyspark.sql import types as T

S, L, B = T.StringType(), T.LongType(), T.BooleanType()

# the 23 columns of a play-history export record, in export order
EXPORT_FIELDS = [
    ("ts", T.TimestampNTZType()), ("ms_played", L), ("platform", S), ("conn_country", S),
    ("ip_addr", S), ("master_metadata_track_name", S), ("master_metadata_album_artist_name", S),
    ("master_metadata_album_album_name", S), ("spotify_track_uri", S), ("episode_name", S),
    ("episode_show_name", S), ("spotify_episode_uri", S), ("audiobook_title", S),
    ("audiobook_uri", S), ("audiobook_chapter_uri", S), ("audiobook_chapter_title", S),
    ("reason_start", S), ("reason_end", S), ("shuffle", B), ("skipped", B), ("offline", B),
    ("offline_timestamp", L), ("incognito_mode", B),
]

# schema used to parse export JSON: ts arrives as an ISO string with a zone suffix
EXPORT_JSON = T.StructType(
    [T.StructField(n, T.StringType() if n == "ts" else t, True) for n, t in EXPORT_FIELDS])

RAW = T.StructType([T.StructField("account_id", L, True)]
                   + [T.StructField(n, t, True) for n, t in EXPORT_FIELDS])
RAW_COLUMNS = [f.name for f in RAW.fields]

SILVER_COLUMNS = [
    "account_id", "play_start_MST", "play_end_MST", "ms_played", "track_name", "artist_name",
    "album_name", "track_uri", "device", "reason_start", "reason_end", "shuffle_flag",
    "skipped_flag", "offline_flag", "offline_ts_UTC", "incognito_flag", "play_date", "play_year",
    "play_month", "play_day_week", "play_hour", "time_of_day", "seconds_played",
    "minutes_played", "hours_played", "completion_category",
]

SESSION_COLUMNS = [
    "account_id", "session_id", "session_start", "session_end", "session_date", "session_year",
    "session_month", "session_day_of_week", "session_start_hour", "session_duration_seconds",
    "session_duration_minutes", "total_minutes_played", "session_length_category",
    "primary_device", "devices_used", "tracks_played", "unique_artists", "unique_albums",
    "avg_track_duration", "diversity_score", "weighted_diversity_score", "shuffle_usage_pct",
    "skip_rate", "completion_rate", "offline_plays", "session_type", "engagement_level",
]

# total order of plays on a timeline; ms_played breaks ties of second-truncated starts
PLAY_ORDER = ["play_start_MST", "play_end_MST", "track_uri", "ms_played"]
