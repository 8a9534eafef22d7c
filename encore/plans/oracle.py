"""DuckDB oracle SQL, one statement per registered query name.

Every statement rebuilds its stages from the shared tables (`events`,
`part`) with the CTEs in `oracle_base`, then computes the query the plain
way. Column names equal the Spark side's.
"""

from __future__ import annotations

from encore import labels as LB
from encore.config import DEFAULT, PipelineConfig
from encore.functions import rounding as R
from encore.plans.oracle_base import ORDER_SQL, K, mode_cte, with_stages
from encore.schemas import RAW_COLUMNS, SESSION_COLUMNS, SILVER_COLUMNS

_BIG = "CAST({} AS BIGINT)"


def big(x: str) -> str:
    return _BIG.format(x)


def share(k: K, count: str) -> str:
    return R.sql_pct(count, f"sum({count}) OVER ({k.part})")


def avg_c(col: str, n: str, digits: int) -> str:
    """ROUND(AVG(col), digits) for col holding hundredths, as an aggregate."""
    return R.sql_rround(f"sum({R.sql_to_cents(col)})", f"({n}) * 100", digits)


def top(k: K, body: str, order: str, n: int, cols: str = "*") -> str:
    """Keep the first n rows per key of `body` by `order`."""
    return (f"SELECT {cols} FROM (SELECT *, row_number() OVER ({k.part} ORDER BY {order}) AS _top "
            f"FROM ({body})) WHERE _top <= {n}")


def strip(cols) -> str:
    return ", ".join(cols)


# ------------------------------------------------------------------ stages
def stage_queries(cfg: PipelineConfig) -> dict[str, str]:
    k = K(cfg)
    raw_cols = [c for c in RAW_COLUMNS if c != "account_id" or c in k.keys]
    silver_cols = [c for c in SILVER_COLUMNS if c != "account_id" or c in k.keys]
    ses_cols = [c for c in SESSION_COLUMNS if c != "account_id" or c in k.keys]
    m_cols = [c for c in ses_cols if c not in ("session_date", "session_year", "session_month",
                                               "session_day_of_week", "session_start_hour",
                                               "session_length_category", "session_type",
                                               "engagement_level")]
    return {
        "raw_plays": with_stages(cfg, "raw", f"SELECT {strip(raw_cols)} FROM raw"),
        "silver_clean": with_stages(cfg, "silver", f"SELECT {strip(silver_cols)} FROM silver"),
        "play_gaps": with_stages(cfg, "sessions",
                                 f"SELECT {strip(silver_cols)}, seconds_since_last_play FROM play_gaps"),
        "session_flags": with_stages(
            cfg, "sessions", f"SELECT {strip(silver_cols)}, seconds_since_last_play, new_session_flag FROM session_flags"),
        "plays_with_session_id": with_stages(
            cfg, "sessions",
            f"SELECT {strip(silver_cols)}, seconds_since_last_play, new_session_flag, session_id FROM plays_sid"),
        "session_metrics": with_stages(cfg, "sessions", f"SELECT {strip(m_cols)} FROM session_metrics"),
        "sessions": with_stages(cfg, "sessions", f"SELECT {strip(ses_cols)} FROM sessions"),
    }


# ------------------------------------------------------------------ quality
def quality_queries(cfg: PipelineConfig) -> dict[str, str]:
    k = K(cfg)
    L = k.lead
    q: dict[str, str] = {}
    S = lambda body, extra="": with_stages(cfg, "silver", body, extra)
    SS = lambda body, extra="": with_stages(cfg, "sessions", body, extra)

    q["dq_silver_duplicates"] = S(
        f"SELECT {L} '{LB.CHECK_DUPLICATES}' AS check_type, "
        f"count(*) - count(DISTINCT CAST(play_end_MST AS VARCHAR) || track_uri || CAST(ms_played AS VARCHAR)) "
        f"AS remaining_duplicates FROM silver {k.group}")
    q["dq_silver_podcast_leak"] = S(
        f"SELECT {L} '{LB.CHECK_PODCAST}' AS check_type, "
        f"count_if(track_name IS NULL OR track_uri IS NULL) AS podcast_count FROM silver {k.group}")
    q["dq_silver_date_range"] = S(
        f"SELECT {L} '{LB.CHECK_DATE_RANGE}' AS metric, min(play_start_MST) AS earliest_play, "
        f"max(play_start_MST) AS latest_play, "
        f"date_diff('day', CAST(min(play_start_MST) AS DATE), CAST(max(play_start_MST) AS DATE)) AS days_span, "
        f"count(DISTINCT CAST(play_start_MST AS DATE)) AS active_days FROM silver {k.group}")
    body = (f"SELECT 'Top 10 Artists' AS section, {L} artist_name, count(*) AS plays, "
            f"{R.sql_rround('sum(' + R.sql_minutes_c('ms_played') + ')', '100', 1)} AS total_minutes, "
            f"{R.sql_rround('sum(' + R.sql_minutes_c('ms_played') + ')', 'count(*) * 100', 2)} AS avg_minutes_per_play "
            f"FROM silver {k.group_with('artist_name')}")
    q["dq_silver_top_artists"] = S(top(k, body, "plays DESC, artist_name ASC NULLS FIRST", 10,
                                       f"section, {L} artist_name, plays, total_minutes, avg_minutes_per_play"))
    for name, col in (("dq_silver_completion", "completion_category"), ("dq_silver_daypart", "time_of_day")):
        q[name] = S(f"SELECT {L} {col}, count(*) AS plays, {share(k, 'count(*)')} AS pct_of_total "
                    f"FROM silver {k.group_with(col)}")
    q["dq_silver_removed"] = S(
        f"SELECT '{LB.CHECK_CLEANING}' AS metric, {''.join(f'r.{x}, ' for x in k.keys)} r.raw_music_plays, "
        f"coalesce(c.clean_plays, 0) AS clean_plays, r.raw_music_plays - coalesce(c.clean_plays, 0) AS plays_removed, "
        f"{R.sql_pct('(r.raw_music_plays - coalesce(c.clean_plays, 0))', 'r.raw_music_plays')} AS pct_removed "
        f"FROM (SELECT {L} count(*) AS raw_music_plays FROM raw WHERE episode_name IS NULL {k.group}) r "
        f"LEFT JOIN (SELECT {L} count(*) AS clean_plays FROM silver {k.group}) c ON {k.on('r', 'c')}")

    prev = (f"prev AS (SELECT *, lag(play_end_MST) OVER w AS prev_end, lag(device) OVER w AS prev_device, "
            f"lag(play_start_MST) OVER w AS prev_start, lag(track_name) OVER w AS prev_track, "
            f"date_diff('second', lag(play_end_MST) OVER w, play_start_MST) AS gap_seconds "
            f"FROM silver WINDOW w AS ({k.part} ORDER BY {ORDER_SQL}))")
    sev = cfg.overlap_seconds
    q["dq_silver_overlaps"] = S(
        f"SELECT '{LB.CHECK_OVERLAPS}' AS check_type, {L} total_transitions, total_overlaps, "
        f"cross_device_overlaps, same_device_overlaps, severe_same_device_overlaps, "
        f"{R.sql_pct('total_overlaps', 'total_transitions')} AS pct_general_overlap, "
        f"{R.sql_pct('cross_device_overlaps', 'total_transitions')} AS pct_cross_overlaps, "
        f"{R.sql_pct('same_device_overlaps', 'total_transitions')} AS pct_same_overlaps, "
        f"{R.sql_pct('severe_same_device_overlaps', 'total_transitions')} AS pct_severe_same_overlaps "
        f"FROM (SELECT {L} count(*) AS total_transitions, count_if(gap_seconds < 0) AS total_overlaps, "
        f"count_if(gap_seconds < 0 AND device <> prev_device) AS cross_device_overlaps, "
        f"count_if(gap_seconds < 0 AND device = prev_device) AS same_device_overlaps, "
        f"count_if(gap_seconds < -{sev} AND device = prev_device) AS severe_same_device_overlaps "
        f"FROM prev WHERE prev_end IS NOT NULL {k.group})", prev)
    body = (f"SELECT * FROM prev WHERE gap_seconds < -{sev} AND device = prev_device")
    q["dq_silver_overlap_samples"] = S(top(
        k, body, f"gap_seconds ASC, {ORDER_SQL}", 20,
        f"{L} play_start_MST, play_end_MST, device, track_name, prev_start, prev_end, prev_device, "
        f"prev_track, gap_seconds"), prev)
    body = (f"SELECT {L} device, count(*) AS plays, {share(k, 'count(*)')} AS pct_of_total "
            f"FROM silver {k.group_with('device')}")
    q["dq_silver_devices"] = S(top(k, body, "plays DESC, device ASC NULLS FIRST", 10,
                                   f"{L} device, plays, pct_of_total"))

    # sessions
    q["dq_sessions_total"] = SS(f"SELECT {L} '{LB.CHECK_TOTAL_SESSIONS}' AS metric, count(*) AS value "
                                f"FROM sessions {k.group}")
    q["dq_sessions_by_length"] = SS(
        f"SELECT {L} session_length_category, count(*) AS session_count, "
        f"{share(k, 'count(*)')} AS pct_of_total, "
        f"{R.sql_rround('sum(tracks_played)', 'count(*)', 1)} AS avg_tracks, "
        f"{avg_c('total_minutes_played', 'count(*)', 1)} AS avg_minutes "
        f"FROM sessions {k.group_with('session_length_category')}")
    q["dq_sessions_by_type"] = SS(
        f"SELECT {L} session_type, count(*) AS session_count, {share(k, 'count(*)')} AS pct_of_total, "
        f"{avg_c('diversity_score', 'count(*)', 3)} AS avg_diversity, "
        f"{avg_c('skip_rate', 'count(*)', 2)} AS avg_skip_rate "
        f"FROM sessions {k.group_with('session_type')}")
    q["dq_sessions_by_engagement"] = SS(
        f"SELECT {L} engagement_level, count(*) AS session_count, "
        f"{avg_c('completion_rate', 'count(*)', 2)} AS avg_completion_rate, "
        f"{avg_c('skip_rate', 'count(*)', 2)} AS avg_skip_rate, "
        f"{R.sql_rround('sum(tracks_played)', 'count(*)', 1)} AS avg_tracks "
        f"FROM sessions {k.group_with('engagement_level')}")
    q["dq_sessions_by_month"] = SS(
        f"SELECT {L} session_year, session_month, count(*) AS sessions, "
        f"{R.sql_rround('sum(tracks_played)', 'count(*)', 1)} AS avg_tracks_per_session, "
        f"{avg_c('session_duration_minutes', 'count(*)', 1)} AS avg_duration_minutes "
        f"FROM sessions {k.group_with('session_year', 'session_month')}")
    cols = (f"{L} session_id, session_start, tracks_played, session_duration_minutes, "
            f"{R.sql_rround(R.sql_to_cents('session_duration_minutes'), '6000', 1)} AS session_duration_hours, "
            f"unique_artists")
    parts = [
        (LB.EXTREME_LONGEST, "sessions", "session_duration_minutes DESC, session_id", 1),
        (LB.EXTREME_TRACKS, "sessions", "tracks_played DESC, session_id", 3),
        (LB.EXTREME_DIVERSE, f"sessions WHERE tracks_played >= {LB.EXTREME_DIVERSE_MIN_TRACKS}",
         "weighted_diversity_score DESC, session_id", 3),
    ]
    q["dq_sessions_extremes"] = SS(" UNION ALL ".join(
        f"SELECT '{label}' AS metric, {cols} FROM ({top(k, 'SELECT * FROM ' + src, order, n)})"
        for label, src, order, n in parts))
    q["dq_sessions_orphans"] = SS(
        f"SELECT '{LB.CHECK_PLAY_COUNT}' AS check_type, {''.join(f'coalesce(c.{x}, s.{x}) AS {x}, ' for x in k.keys)}"
        f"coalesce(c.n, 0) AS total_plays_in_clean_table, {big('coalesce(s.n, 0)')} AS total_plays_in_sessions, "
        f"coalesce(c.n, 0) - {big('coalesce(s.n, 0)')} AS difference "
        f"FROM (SELECT {L} count(*) AS n FROM silver {k.group}) c "
        f"FULL JOIN (SELECT {L} sum(tracks_played) AS n FROM sessions {k.group}) s ON {k.on('c', 's')}")

    # diagnostics
    q["dq_negative_durations"] = SS(top(
        k, "SELECT * FROM sessions WHERE session_duration_minutes < 0",
        "session_duration_minutes ASC, session_id", 10,
        f"{L} session_id, session_start, session_end, session_duration_minutes"))
    q["dq_intra_session_gaps"] = SS(
        f"SELECT {L} count(*) AS inner_transitions, max(seconds_since_last_play) AS max_inner_gap_seconds, "
        f"count_if(seconds_since_last_play > {cfg.gap_seconds}) AS inner_gaps_over_limit, "
        f"count_if(seconds_since_last_play < -{cfg.overlap_seconds}) AS inner_overlaps_over_limit "
        f"FROM plays_sid WHERE new_session_flag = 0 {k.group}")
    from encore.plans.quality import QUANTILE_METRICS
    # value at 1-based rank ceil(q * n) of the sorted values (the rank percentile_approx targets)
    outs = ", ".join(
        f"list_sort(list({col}) FILTER (WHERE {col} IS NOT NULL))"
        f"[CAST(ceil({lv} * count({col})) AS BIGINT)] AS {name}_p{int(round(lv * 100))}"
        for col, name in QUANTILE_METRICS for lv in LB.QUANTILE_LEVELS)
    q["session_quantiles"] = SS(f"SELECT {L} {outs} FROM sessions {k.group}")
    return q


# ------------------------------------------------------------------ EDA on raw
def eda_queries(cfg: PipelineConfig) -> dict[str, str]:
    from encore.functions import timeutil as TU
    from encore.schemas import EXPORT_FIELDS

    k = K(cfg)
    L = k.lead
    c = TU.sql_eda_clock("ts", cfg)
    W = lambda body, extra="": with_stages(cfg, "raw", body, extra)
    avg_min = R.sql_rround("sum(ms_played)", "count(ms_played) * 60000", 2)
    hours1 = R.sql_rround("sum(ms_played)", "3600000", 1)
    min0 = R.sql_rround("sum(ms_played)", "60000", 0)
    sh = share(k, "count(*)")
    q: dict[str, str] = {}

    def share_q(col_expr: str, alias: str, where: str = "", extra: str = "", count_name: str = "plays",
                src: str = "raw") -> str:
        w = f"WHERE {where}" if where else ""
        return W(f"SELECT {L} {col_expr} AS {alias}, count(*) AS {count_name}, {sh} AS pct_of_total{extra} "
                 f"FROM {src} {w} {k.group_with(alias)}")

    days = "date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE))"
    q["eda_overview"] = W(
        f"SELECT {L} count(*) AS total_records, min(ts) - INTERVAL {cfg.eda_offset_hours} HOUR AS earliest_play, "
        f"max(ts) - INTERVAL {cfg.eda_offset_hours} HOUR AS latest_play, {days} AS days_of_data, "
        f"{R.sql_rround('count(*)', days, 1)} AS avg_plays_per_day FROM raw {k.group}")
    nulls = ", ".join(f"count_if({n} IS NULL) AS null_{n}" for n, _ in EXPORT_FIELDS)
    q["eda_null_profile"] = W(
        f"SELECT {L} {nulls}, "
        f"{R.sql_pct('count_if(master_metadata_track_name IS NULL)', 'count(*)')} AS pct_null_track_name, "
        f"{R.sql_pct('count_if(episode_name IS NULL)', 'count(*)')} AS pct_null_episode_name "
        f"FROM raw {k.group}")
    ctype = (f"CASE WHEN episode_name IS NOT NULL THEN '{LB.CONTENT_PODCAST}' "
             f"WHEN master_metadata_track_name IS NOT NULL THEN '{LB.CONTENT_MUSIC}' ELSE '{LB.CONTENT_UNKNOWN}' END")
    q["eda_content_type"] = share_q(ctype, "content_type",
                                    extra=f", {min0} AS total_minutes, {avg_min} AS avg_minutes_per_play")
    a, b = LB.DUPLICATE_LABELS
    body = (f"SELECT {L} count(*) - count(DISTINCT CAST(ts AS VARCHAR) || master_metadata_track_name || "
            f"CAST(ms_played AS VARCHAR)) AS a, count(*) - count(DISTINCT CAST(ts AS VARCHAR) || spotify_track_uri) AS b "
            f"FROM raw {k.group}")
    q["eda_duplicates"] = W(f"SELECT {L} '{a}' AS check_type, a AS duplicate_count FROM d UNION ALL "
                            f"SELECT {L} '{b}', b FROM d", f"d AS ({body})")
    q["eda_by_month"] = W(
        f"SELECT {L} year({c}) AS year, month({c}) AS month, count(*) AS plays, "
        f"count(DISTINCT CAST({c} AS DATE)) AS active_days, "
        f"{R.sql_rround('count(*)', 'count(DISTINCT CAST(ts AS DATE))', 1)} AS avg_plays_per_day, "
        f"{hours1} AS total_hours FROM raw {k.group_with('year', 'month')}")
    q["eda_by_weekday"] = W(
        f"SELECT {L} dayname({c}) AS day_of_week, {TU.sql_day_num(c)} AS day_num, count(*) AS plays, "
        f"{avg_min} AS avg_minutes_per_play FROM raw {k.group_with('day_of_week', 'day_num')}")
    q["eda_by_hour"] = share_q(f"hour({c})", "hour", extra=f", {min0} AS total_minutes")
    q["eda_heatmap"] = W(f"SELECT {L} {TU.sql_day_num(c)} AS day_num, hour({c}) AS hour, count(*) AS plays "
                         f"FROM raw {k.group_with('day_num', 'hour')}")
    body = (f"SELECT {L} master_metadata_album_artist_name AS artist, count(*) AS plays, "
            f"count(DISTINCT master_metadata_track_name) AS unique_tracks, {hours1} AS total_hours, "
            f"{avg_min} AS avg_minutes_per_play, "
            f"{R.sql_pct('count_if(skipped)', 'count(*)', 1)} AS skip_rate_pct "
            f"FROM raw WHERE master_metadata_album_artist_name IS NOT NULL {k.group_with('artist')}")
    q["eda_top_artists"] = W(top(k, body, "plays DESC, artist ASC", 20,
                                 f"{L} artist, plays, unique_tracks, total_hours, avg_minutes_per_play, skip_rate_pct"))
    body = (f"SELECT {L} master_metadata_track_name AS track, master_metadata_album_artist_name AS artist, "
            f"count(*) AS plays, {avg_min} AS avg_minutes_per_play, "
            f"min(ts) - INTERVAL {cfg.eda_offset_hours} HOUR AS first_played, "
            f"max(ts) - INTERVAL {cfg.eda_offset_hours} HOUR AS last_played, {days} AS days_span "
            f"FROM raw WHERE master_metadata_track_name IS NOT NULL {k.group_with('track', 'artist')}")
    q["eda_top_tracks"] = W(top(k, body, "plays DESC, track ASC, artist ASC NULLS FIRST", 20,
                                f"{L} track, artist, plays, avg_minutes_per_play, first_played, last_played, days_span"))
    body = (f"SELECT {L} master_metadata_album_artist_name AS artist, min(CAST({c} AS DATE)) AS first_discovered, "
            f"count(*) AS total_plays, count(DISTINCT CAST({c} AS DATE)) AS days_played "
            f"FROM raw WHERE master_metadata_album_artist_name IS NOT NULL {k.group_with('artist')}")
    q["eda_artist_discovery"] = W(top(k, body, "first_discovered ASC, artist ASC", 20,
                                      f"{L} artist, first_discovered, total_plays, days_played"))
    q["eda_platform"] = share_q("platform", "platform", "platform IS NOT NULL",
                                f", {hours1} AS total_hours, {avg_min} AS avg_minutes_per_play")
    q["eda_platform_daypart"] = W(
        f"SELECT {L} platform, {TU.sql_daypart_eda(f'hour({c})')} AS time_of_day, count(*) AS plays "
        f"FROM raw WHERE platform IS NOT NULL {k.group_with('platform', 'time_of_day')}")
    q["eda_country"] = share_q("conn_country", "country", "conn_country IS NOT NULL")
    lims, lbls = LB.DURATION_LIMITS_MS, LB.DURATION_LABELS
    bucket = ("CASE " + " ".join(f"WHEN ms_played < {x} THEN '{y}'" for x, y in zip(lims, lbls))
              + f" ELSE '{lbls[-1]}' END")
    q["eda_duration_buckets"] = share_q(bucket, "duration_bucket", "ms_played > 0")
    q["eda_skip"] = share_q("skipped", "skipped", "skipped IS NOT NULL", f", {avg_min} AS avg_minutes_per_play")
    q["eda_shuffle"] = share_q("shuffle", "shuffle", "shuffle IS NOT NULL",
                               ", count(DISTINCT master_metadata_album_artist_name) AS unique_artists")
    for col in ("offline", "incognito_mode", "reason_start", "reason_end"):
        name = {"incognito_mode": "eda_incognito"}.get(col, f"eda_{col}")
        q[name] = share_q(col, col, f"{col} IS NOT NULL")
    body = (f"SELECT {L} CAST({c} AS DATE) AS date, count(*) AS plays, "
            f"{R.sql_rround('sum(ms_played)', '3600000', 2)} AS hours_listened, "
            f"count(DISTINCT master_metadata_album_artist_name) AS unique_artists FROM raw {k.group_with('date')}")
    q["eda_binge_days"] = W(top(k, body, "hours_listened DESC, date ASC", 20,
                                f"{L} date, plays, hours_listened, unique_artists"))
    hi, med, var = LB.LOYALTY_LABELS
    body = (f"SELECT {L} artist, total_plays, unique_tracks, "
            f"{R.sql_rround('total_plays', 'unique_tracks', 2)} AS loyalty_score, "
            f"CASE WHEN unique_tracks > 0 AND total_plays > unique_tracks * {LB.LOYALTY_HIGH} THEN '{hi}' "
            f"WHEN unique_tracks > 0 AND total_plays > unique_tracks * {LB.LOYALTY_MEDIUM} THEN '{med}' "
            f"ELSE '{var}' END AS listening_pattern FROM ("
            f"SELECT {L} master_metadata_album_artist_name AS artist, count(*) AS total_plays, "
            f"count(DISTINCT master_metadata_track_name) AS unique_tracks FROM raw "
            f"WHERE master_metadata_album_artist_name IS NOT NULL {k.group_with('artist')} "
            f"HAVING count(*) >= {LB.LOYALTY_MIN_PLAYS})")
    q["eda_loyalty"] = W(top(k, body, "loyalty_score DESC NULLS LAST, artist ASC", 30,
                             f"{L} artist, total_plays, unique_tracks, loyalty_score, listening_pattern"))
    gaps = (f"gaps AS (SELECT {L} date_sub('minute', lag(ts) OVER ({k.part} ORDER BY ts), ts) AS m FROM raw)")
    gb = (f"CASE WHEN m IS NULL THEN '{LB.GAP_FIRST}' "
          + " ".join(f"WHEN m <= {x} THEN '{y}'" for x, y in zip(LB.GAP_LIMITS_MIN, LB.GAP_LABELS))
          + f" ELSE '{LB.GAP_LABELS[-1]}' END")
    q["eda_gap_buckets"] = W(
        f"SELECT {L} {gb} AS gap_bucket, count(*) AS occurrences, {sh} AS pct_of_total "
        f"FROM gaps {k.group_with('gap_bucket')}", gaps)
    a1, b1, c1 = LB.EDA_COMPLETION_LIMITS_MS
    l0, l1, l2, l3 = LB.EDA_COMPLETION_LABELS
    cat = (f"CASE WHEN ms_played < {a1} THEN '{l0}' WHEN ms_played < {b1} THEN '{l1}' "
           f"WHEN ms_played < {c1} THEN '{l2}' WHEN ms_played >= {c1} THEN '{l3}' END")
    q["eda_completion"] = share_q(cat, "completion_category",
                                  "master_metadata_track_name IS NOT NULL AND ms_played > 0")
    i0, i1, i2, i3 = LB.IMPOSSIBLE_LABELS
    body = (f"SELECT {L} count_if(ms_played < 0) AS a, "
            f"count_if(ms_played > {LB.IMPOSSIBLE_MAX_MS} AND master_metadata_track_name IS NOT NULL) AS b, "
            f"count_if(ts > (now() AT TIME ZONE 'UTC')) AS c, "
            f"count_if(ts < TIMESTAMP '{LB.IMPOSSIBLE_OLDEST} 00:00:00') AS d FROM raw {k.group}")
    q["eda_impossible_values"] = W(
        " UNION ALL ".join(f"SELECT {L} '{lbl}' AS issue, {col} AS count FROM imp"
                           for lbl, col in ((i0, "a"), (i1, "b"), (i2, "c"), (i3, "d"))),
        f"imp AS ({body})")
    q["eda_missing_critical"] = W(
        f"SELECT {L} '{LB.MISSING_CRITICAL_LABEL}' AS issue, "
        f"count_if(master_metadata_track_name IS NULL AND episode_name IS NULL) AS count FROM raw {k.group}")
    return q


# ------------------------------------------------------------------ gold views
def view_queries(cfg: PipelineConfig) -> dict[str, str]:
    from encore.functions import timeutil as TU

    k = K(cfg)
    L = k.lead
    q: dict[str, str] = {}
    min_c, hrs_c = R.sql_minutes_c("ms_played"), R.sql_hours_c("ms_played")
    complete = f"count_if(completion_category = '{LB.COMPLETION_COMPLETE}')"
    rates = (f"{R.sql_pct('count_if(skipped_flag)', 'count(*)')} AS skip_rate, "
             f"{R.sql_pct(complete, 'count(*)')} AS completion_rate, "
             f"{R.sql_pct('count_if(shuffle_flag)', 'count(*)')} AS shuffle_usage_pct")
    as_of = TU.sql_as_of(cfg)
    SV = lambda body, extra="": with_stages(cfg, "silver", body, extra)
    SS = lambda body, extra="": with_stages(cfg, "sessions", body, extra)
    # session-count opt-in: the four play views read plays with session ids
    PV = SS if cfg.session_counts else SV
    src = "plays_sid" if cfg.session_counts else "silver"

    def sc(alias: str) -> str:
        return f"count(DISTINCT session_id) AS {alias}, " if cfg.session_counts else ""

    def modes(group: list[str], value: str, alias: str, name: str, source: str = "silver") -> str:
        return mode_cte(name, source, k.keys + group, value, alias)

    def on(a: str, b: str, cols: list[str]) -> str:
        return " AND ".join([k.on(a, b)] + [f"{a}.{c} IS NOT DISTINCT FROM {b}.{c}" for c in cols])

    g = ["artist_name"]
    body = (f"SELECT {''.join(f'a.{x}, ' for x in k.keys)} a.artist_name, total_plays, unique_tracks, "
            f"{'sessions_featured, ' if cfg.session_counts else ''}total_minutes, "
            f"total_hours, avg_track_duration, first_play_date, last_play_date, days_span, t.preferred_time, "
            f"skip_rate, completion_rate, shuffle_usage_pct, d.primary_device, devices_used, days_since_last_play "
            f"FROM agg a JOIN mt t ON {on('a', 't', g)} JOIN md d ON {on('a', 'd', g)}")
    agg = (f"agg AS (SELECT {L} artist_name, count(*) AS total_plays, count(DISTINCT track_name) AS unique_tracks, "
           f"{sc('sessions_featured')}"
           f"{R.sql_from_cents(f'sum({min_c})')} AS total_minutes, {R.sql_from_cents(f'sum({hrs_c})')} AS total_hours, "
           f"{R.sql_rround(f'sum({min_c})', 'count(*) * 100', 2)} AS avg_track_duration, "
           f"min(play_date) AS first_play_date, max(play_date) AS last_play_date, "
           f"date_diff('day', min(play_date), max(play_date)) AS days_span, {rates}, "
           f"count(DISTINCT device) AS devices_used, date_diff('day', max(play_date), {as_of}) AS days_since_last_play "
           f"FROM {src} {k.group_with('artist_name')} HAVING count(*) >= {cfg.min_artist_plays})")
    q["view_artist_stats"] = PV(body, ",\n".join([agg, modes(g, "time_of_day", "preferred_time", "mt"),
                                                  modes(g, "device", "primary_device", "md")]))

    g = ["track_name", "artist_name", "album_name"]
    agg = (f"agg AS (SELECT {L} track_name, artist_name, album_name, count(*) AS play_count, {sc('sessions_played_in')}"
           f"{R.sql_rround(f'sum({min_c})', '6000', 2)} AS total_hours_listened, "
           f"{R.sql_rround(f'sum({min_c})', 'count(*) * 100', 2)} AS avg_play_duration, "
           f"min(play_date) AS first_played, max(play_date) AS last_played, "
           f"date_diff('day', min(play_date), max(play_date)) AS listening_span_days, {rates}, "
           f"date_diff('day', max(play_date), {as_of}) AS days_since_last_play "
           f"FROM {src} {k.group_with(*g)} HAVING count(*) >= {cfg.min_track_plays})")
    body = (f"SELECT {''.join(f'a.{x}, ' for x in k.keys)} a.track_name, a.artist_name, a.album_name, play_count, "
            f"{'sessions_played_in, ' if cfg.session_counts else ''}"
            f"total_hours_listened, avg_play_duration, first_played, last_played, listening_span_days, "
            f"t.most_common_time, skip_rate, completion_rate, shuffle_usage_pct, days_since_last_play "
            f"FROM agg a JOIN mt t ON {on('a', 't', g)}")
    q["view_track_stats"] = PV(body, ",\n".join([agg, modes(g, "time_of_day", "most_common_time", "mt", src)]))

    dims = "play_year, play_month, play_day_week, play_hour, time_of_day"
    wpart = k.part_with("play_year", "play_month", "play_day_week")
    q["view_temporal_patterns"] = PV(
        f"SELECT {L} {dims}, count(*) AS total_plays, {sc('total_sessions')}count(DISTINCT artist_name) AS unique_artists, "
        f"count(DISTINCT track_name) AS unique_tracks, {R.sql_from_cents(f'sum({min_c})')} AS total_minutes, "
        f"{R.sql_rround(f'sum({min_c})', 'count(*) * 100', 2)} AS avg_track_duration, "
        f"{R.sql_rround(f'sum(count(*)) OVER ({wpart})', f'count(*) OVER ({wpart})', 1)} AS avg_plays_per_hour, "
        f"{rates} FROM {src} {k.group_with(*dims.split(', '))}")

    dl = ["session_year", "session_month", "session_day_of_week", "session_start_hour",
          "session_length_category", "session_type", "engagement_level"]
    agg = (f"agg AS (SELECT {L} {', '.join(dl)}, count(*) AS session_count, "
           f"{big('sum(tracks_played)')} AS total_tracks, "
           f"{R.sql_rround('sum(tracks_played)', 'count(*)', 1)} AS avg_tracks_per_session, "
           f"{avg_c('session_duration_minutes', 'count(*)', 1)} AS avg_duration_minutes, "
           f"{R.sql_rround('sum(unique_artists)', 'count(*)', 1)} AS avg_unique_artists, "
           f"{avg_c('diversity_score', 'count(*)', 3)} AS avg_diversity, "
           f"{avg_c('weighted_diversity_score', 'count(*)', 3)} AS avg_weighted_diversity, "
           f"{avg_c('skip_rate', 'count(*)', 2)} AS avg_skip_rate, "
           f"{avg_c('completion_rate', 'count(*)', 2)} AS avg_completion_rate, "
           f"{avg_c('shuffle_usage_pct', 'count(*)', 2)} AS avg_shuffle_usage "
           f"FROM sessions {k.group_with(*dl)})")
    body = (f"SELECT a.*, m.most_common_device FROM agg a JOIN mdev m ON {on('a', 'm', dl)}")
    q["view_session_behavior"] = SS(body, ",\n".join(
        [agg, mode_cte("mdev", "sessions", k.keys + dl, "primary_device", "most_common_device")]))

    wy = f"({k.part} ORDER BY play_year)"
    agg = (f"y AS (SELECT {L} play_year, count(*) AS total_plays, count(DISTINCT artist_name) AS unique_artists, "
           f"count(DISTINCT track_name) AS unique_tracks, {sc('total_sessions')}{big(f'sum({hrs_c})')} AS _h, "
           f"{R.sql_rround(f'sum({min_c})', 'count(*) * 100', 2)} AS avg_track_duration, {rates} "
           f"FROM {src} {k.group_with('play_year')})")
    q["view_yearly_trends"] = PV(
        f"SELECT {L} play_year, total_plays, unique_artists, unique_tracks, "
        f"{'total_sessions, ' if cfg.session_counts else ''}{R.sql_from_cents('_h')} AS total_hours, "
        f"avg_track_duration, skip_rate, completion_rate, shuffle_usage_pct, "
        f"{R.sql_rround(f'(total_plays - lag(total_plays) OVER {wy}) * 100', f'lag(total_plays) OVER {wy}', 2)} AS pct_yoy_play_count, "
        f"{R.sql_rround(f'(_h - lag(_h) OVER {wy}) * 100', f'lag(_h) OVER {wy}', 2)} AS pct_yoy_hours_played "
        f"FROM y", agg)

    def ranked(method: str, with_lead: bool = False) -> str:
        specs = [(LB.PERIOD_ALL, LB.CONTENT_ARTIST, False, ["artist_name"], cfg.top_all_time),
                 (LB.PERIOD_YEARLY, LB.CONTENT_ARTIST, True, ["artist_name"], cfg.top_yearly),
                 (LB.PERIOD_ALL, LB.CONTENT_TRACK, False, ["artist_name", "track_name"], cfg.top_all_time),
                 (LB.PERIOD_YEARLY, LB.CONTENT_TRACK, True, ["artist_name", "track_name"], cfg.top_yearly)]
        parts = []
        for period, content, yearly, group, n in specs:
            gcols = (["play_year"] if yearly else []) + group
            part = k.part_with(*(["play_year"] if yearly else []))
            tie = ", ".join(f"{c} ASC NULLS FIRST" for c in group)
            order = f"count(*) DESC, {tie}" if method == "row_number" else "count(*) DESC"
            lead = (f", count(*) - lead(count(*)) OVER ({part} ORDER BY count(*) DESC, {tie}) AS lead_over_next"
                    if with_lead else "")
            parts.append(
                f"SELECT * FROM (SELECT {L} '{period}' AS time_period, "
                f"{'play_year' if yearly else 'CAST(NULL AS BIGINT)'} AS year, '{content}' AS content_type, "
                f"artist_name, {'track_name' if 'track_name' in group else 'CAST(NULL AS VARCHAR)'} AS track_name, "
                f"count(*) AS play_count, {R.sql_from_cents(f'sum({hrs_c})')} AS total_hours, "
                f"{method}() OVER ({part} ORDER BY {order}) AS rank{lead} "
                f"FROM silver {k.group_with(*gcols)}) WHERE rank <= {n}")
        return SV(" UNION ALL ".join(parts))

    q["view_top_content"] = ranked("row_number")
    q["view_top_content_rank"] = ranked("rank")
    q["view_top_content_dense_rank"] = ranked("dense_rank")
    q["view_top_content_lead"] = ranked("row_number", with_lead=True)
    q["view_artist_tiers"] = SV(
        f"SELECT {L} artist_name, count(*) AS total_plays, "
        f"ntile(4) OVER ({k.part} ORDER BY count(*) DESC, artist_name ASC NULLS FIRST) AS play_tier "
        f"FROM silver {k.group_with('artist_name')}")
    return q


# ------------------------------------------------------------------ sketches, held against exact figures
def sketch_queries(cfg: PipelineConfig) -> dict[str, str]:
    from encore.plans.quality import QUANTILE_METRICS
    k = K(cfg)
    levels = ", ".join(str(int(round(q * 100))) for q in LB.QUANTILE_LEVELS)
    parts = [f"SELECT {k.lead} '{name}' AS measure, CAST(p AS BIGINT) AS percentile, count({col}) AS values, true AS in_bound "
             f"FROM sessions, (SELECT unnest([{levels}]) AS p) {k.group_with('p')}" for col, name in QUANTILE_METRICS]
    return {
        "distinct_by_year": with_stages(
            cfg, "silver", f"SELECT {k.lead} play_year, count(*) AS plays, count(DISTINCT artist_name) AS unique_artists, "
            f"count(DISTINCT track_name) AS unique_tracks, true AS artists_in_bound, true AS tracks_in_bound "
            f"FROM silver {k.group_with('play_year')}"),
        "quantiles_in_bound": with_stages(cfg, "sessions", " UNION ALL ".join(parts)),
        "session_quantiles_exact": quality_queries(cfg)["session_quantiles"],
    }


# ------------------------------------------------------------------ threshold sweep, global variant
def sweep_query(cfg: PipelineConfig) -> str:
    k = K(cfg)
    L = k.lead
    parts = []
    for sec in LB.MIN_MS_SWEEP_SECONDS:
        ms = int(sec * 1000)
        c = cfg.with_(min_ms=ms)
        prev = (f"prev AS (SELECT *, lag(play_end_MST) OVER w AS prev_end, lag(device) OVER w AS prev_device, "
                f"date_diff('second', lag(play_end_MST) OVER w, play_start_MST) AS gap_seconds "
                f"FROM silver WINDOW w AS ({k.part} ORDER BY {ORDER_SQL}))")
        body = (f"SELECT CAST({ms} AS BIGINT) AS min_ms, {''.join(f'a.{x}, ' for x in k.keys)} a.rows_kept, "
                f"coalesce(o.total_overlaps, 0) AS total_overlaps, "
                f"coalesce(o.severe_same_device_overlaps, 0) AS severe_same_device_overlaps "
                f"FROM (SELECT {L} count(*) AS rows_kept FROM silver {k.group}) a LEFT JOIN ("
                f"SELECT {L} count_if(gap_seconds < 0) AS total_overlaps, "
                f"count_if(gap_seconds < -{c.overlap_seconds} AND device = prev_device) AS severe_same_device_overlaps "
                f"FROM prev WHERE prev_end IS NOT NULL {k.group}) o ON {k.on('a', 'o')}")
        parts.append(f"SELECT * FROM ({with_stages(c, 'silver', body, prev)})")
    return " UNION ALL ".join(parts)


def build(cfg: PipelineConfig = DEFAULT) -> dict[str, str]:
    out: dict[str, str] = {}
    out.update(stage_queries(cfg))
    out.update(quality_queries(cfg))
    out.update(eda_queries(cfg))
    out.update(view_queries(cfg))
    out.update(sketch_queries(cfg))
    out["dq_min_ms_sweep"] = sweep_query(cfg)
    if cfg.keys:
        one = cfg.with_(keys=())
        out["sessions_global"] = stage_queries(one)["sessions"]
        out["eda_gap_buckets_global"] = eda_queries(one)["eda_gap_buckets"]
        plain, odd = "(e.user_id // 38) AS account_id", "CASE WHEN (e.user_id // 38) % 2 = 0 THEN e.user_id // 38 END AS account_id"
        assert plain in out["sessions"]
        out["sessions_null_account"] = out["sessions"].replace(plain, odd)
        # what was written as files and read back is the raw table
        out["raw_from_export_files"] = out["raw_from_jsonl"] = out["raw_from_table"] = out["raw_from_split_files"] = out["raw_plays"]
        out["view_yearly_trends_from_csv"] = out["view_yearly_trends"]
        # a file per account; of the six bad ones, one is a list whose value does not fit
        out["ingest_report"] = with_stages(
            cfg, "raw", "SELECT 'ok' AS status, count(DISTINCT account_id) + 1 AS files, count(*) + 1 AS records, "
            "CAST(1 AS BIGINT) AS bad_values FROM raw UNION ALL SELECT s, CAST(n AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) "
            "FROM (VALUES ('not_array', 2), ('zero_records', 1), ('invalid_json', 1), ('empty', 1)) t(s, n)")
    return out
