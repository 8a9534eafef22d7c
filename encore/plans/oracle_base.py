"""DuckDB text of the shared stages (raw adapter, silver, sessions).

The oracle queries in `oracle.py` are WITH-chains over these CTEs. They are
written the plain way - global windows, ROW_NUMBER dedup, GROUP BY count
then rank for the most frequent value - so they check the Spark plans
(bucketed carry, aggregate dedup, mode()) against an independent form.
"""

from __future__ import annotations

from encore import labels as LB
from encore.config import PipelineConfig
from encore.functions import rounding as R
from encore.functions import timeutil as TU
from encore.schemas import RAW_COLUMNS


class K:
    """Key text helpers for a config's grouping keys."""

    def __init__(self, cfg: PipelineConfig):
        self.keys = list(cfg.keys)
        self.cols = ", ".join(self.keys)
        self.lead = "".join(f"{k}, " for k in self.keys)          # "account_id, "
        self.part = f"PARTITION BY {self.cols}" if self.keys else ""
        self.group = f"GROUP BY {self.cols}" if self.keys else ""

    def part_with(self, *extra: str) -> str:
        cols = self.keys + list(extra)
        return f"PARTITION BY {', '.join(cols)}" if cols else ""

    def group_with(self, *extra: str) -> str:
        cols = self.keys + list(extra)
        return f"GROUP BY {', '.join(cols)}" if cols else ""

    def on(self, a: str, b: str) -> str:
        return " AND ".join([f"{a}.{k} IS NOT DISTINCT FROM {b}.{k}" for k in self.keys] or ["TRUE"])


def raw_cte() -> str:
    acct = "(e.user_id // 38)"
    ep = "(e.event_id % 97 = 0)"
    return f"""raw AS (
  SELECT
    {acct} AS account_id,
    date_trunc('second', e.ts - to_days(CAST(270 * ({acct} % 4) AS INTEGER))) AS ts,
    CAST(floor(e.value * 6000) AS BIGINT) AS ms_played,
    CASE WHEN e.event_id % 101 = 0 THEN NULL WHEN e.user_id % 5 = 0 THEN 'ios'
         WHEN e.user_id % 5 = 1 THEN 'web' ELSE 'android' END AS platform,
    CASE e.user_id % 3 WHEN 0 THEN 'MX' WHEN 1 THEN 'US' ELSE 'ES' END AS conn_country,
    CAST(NULL AS VARCHAR) AS ip_addr,
    CASE WHEN {ep} THEN NULL ELSE p.p_name END AS master_metadata_track_name,
    CASE WHEN {ep} THEN NULL ELSE p.p_brand END AS master_metadata_album_artist_name,
    CASE WHEN {ep} THEN NULL ELSE p.p_type END AS master_metadata_album_album_name,
    CASE WHEN {ep} THEN NULL ELSE 'track:' || json_extract_string(e.props, '$.k') END AS spotify_track_uri,
    CASE WHEN {ep} THEN 'ep:' || CAST(e.event_id AS VARCHAR) END AS episode_name,
    CASE WHEN {ep} THEN 'show' END AS episode_show_name,
    CASE WHEN {ep} THEN 'epuri:' || CAST(e.event_id AS VARCHAR) END AS spotify_episode_uri,
    CAST(NULL AS VARCHAR) AS audiobook_title,
    CAST(NULL AS VARCHAR) AS audiobook_uri,
    CAST(NULL AS VARCHAR) AS audiobook_chapter_uri,
    CAST(NULL AS VARCHAR) AS audiobook_chapter_title,
    e.event_type AS reason_start,
    CASE WHEN e.value < 10 THEN 'fwdbtn' WHEN e.event_type = 'error' THEN 'logout' ELSE 'trackdone' END AS reason_end,
    e.user_id % 2 = 0 AS shuffle,
    CASE WHEN e.event_id % 89 = 0 THEN NULL ELSE e.value < 10 END AS skipped,
    e.event_type = 'error' AS offline,
    CASE WHEN e.event_type = 'error' THEN 1700000000 + e.event_id END AS offline_timestamp,
    e.event_id % 53 = 0 AS incognito_mode
  FROM (SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_id % 50 = 0) e
  LEFT JOIN part p ON p.p_partkey = CAST(json_extract_string(e.props, '$.k') AS BIGINT) + 1
)"""


def silver_ctes(cfg: PipelineConfig) -> str:
    k = K(cfg)
    excl = "".join(f"\n    AND NOT (CAST(ts AS DATE) BETWEEN DATE '{lo}' AND DATE '{hi}')"
                   for lo, hi in cfg.excluded_date_ranges)
    dkey = k.keys + ["ts", "spotify_track_uri", "ms_played"]
    rest = [c for c in RAW_COLUMNS if c not in dkey and c != "account_id"]
    order = ", ".join(f"{c} ASC NULLS FIRST" for c in rest)
    loc = TU.sql_local_clock("ts", cfg)
    c_skip, c_part = LB.COMPLETION_LIMITS_MS
    return f"""music AS (
  SELECT * FROM raw
  WHERE episode_name IS NULL AND episode_show_name IS NULL
    AND master_metadata_track_name IS NOT NULL AND spotify_track_uri IS NOT NULL
    AND ts IS NOT NULL AND ms_played >= {cfg.min_ms}
    AND CAST(ts AS DATE) >= DATE '{cfg.first_date}'{excl}
),
dedup AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY {', '.join(dkey)} ORDER BY {order}) AS _rn FROM music
  ) WHERE _rn = 1
),
silver_l AS (SELECT *, {loc} AS _end FROM dedup),
silver AS (
  SELECT {k.lead}
    CAST(date_trunc('second', _end - to_milliseconds(ms_played)) AS TIMESTAMP) AS play_start_MST,
    _end AS play_end_MST,
    ms_played,
    master_metadata_track_name AS track_name,
    master_metadata_album_artist_name AS artist_name,
    master_metadata_album_album_name AS album_name,
    spotify_track_uri AS track_uri,
    platform AS device,
    reason_start, reason_end,
    shuffle AS shuffle_flag, skipped AS skipped_flag, offline AS offline_flag,
    offline_timestamp AS offline_ts_UTC, incognito_mode AS incognito_flag,
    CAST(_end AS DATE) AS play_date,
    year(_end) AS play_year,
    month(_end) AS play_month,
    dayname(_end) AS play_day_week,
    hour(_end) AS play_hour,
    {TU.sql_daypart_silver('hour(_end)')} AS time_of_day,
    {R.sql_from_cents(R.sql_seconds_c('ms_played'))} AS seconds_played,
    {R.sql_from_cents(R.sql_minutes_c('ms_played'))} AS minutes_played,
    {R.sql_from_cents(R.sql_hours_c('ms_played'))} AS hours_played,
    CASE WHEN ms_played < {c_skip} THEN '{LB.COMPLETION_SKIPPED}'
         WHEN ms_played < {c_part} THEN '{LB.COMPLETION_PARTIAL}'
         ELSE '{LB.COMPLETION_COMPLETE}' END AS completion_category
  FROM silver_l
)"""


ORDER_SQL = "play_start_MST, play_end_MST, track_uri, ms_played"


def sql_gap_flag(g: str, cfg: PipelineConfig) -> str:
    return (f"(CASE WHEN {g} IS NULL THEN 1 WHEN {g} > {cfg.gap_seconds} THEN 1 "
            f"WHEN {g} < -{cfg.overlap_seconds} THEN 1 ELSE 0 END)")


def session_ctes(cfg: PipelineConfig) -> str:
    """play_gaps -> session_flags -> plays_sid -> session_metrics -> sessions."""
    k = K(cfg)
    w = f"({k.part} ORDER BY {ORDER_SQL})"
    n = "tracks_played"
    a, b, c, d = cfg.length_bounds
    t_skip, t_shuf, t_var, t_foc, t_alb = cfg.type_thresholds
    e_hc, e_hs, e_mc = cfg.engagement_thresholds
    l0, l1, l2, l3, l4 = LB.LENGTH_LABELS
    return f"""play_gaps AS (
  SELECT *, date_diff('second', lag(play_end_MST) OVER {w}, play_start_MST) AS seconds_since_last_play
  FROM silver
),
session_flags AS (
  SELECT *, {sql_gap_flag('seconds_since_last_play', cfg)} AS new_session_flag FROM play_gaps
),
plays_sid AS (
  SELECT *, CAST(sum(new_session_flag) OVER ({k.part} ORDER BY {ORDER_SQL}
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS session_id
  FROM session_flags
),
{mode_cte('session_dev', 'plays_sid', k.keys + ['session_id'], 'device', 'primary_device')},
session_agg AS (
  SELECT {k.lead} session_id,
    min(play_start_MST) AS session_start,
    max(play_end_MST) AS session_end,
    count(*) AS tracks_played,
    count(DISTINCT artist_name) AS unique_artists,
    count(DISTINCT album_name) AS unique_albums,
    count(DISTINCT device) AS devices_used,
    sum({R.sql_minutes_c('ms_played')}) AS _min_c,
    count_if(shuffle_flag) AS _shuffle,
    count_if(skipped_flag) AS _skip,
    count_if(completion_category = '{LB.COMPLETION_COMPLETE}') AS _complete,
    count_if(offline_flag) AS offline_plays
  FROM plays_sid {k.group_with('session_id')}
),
session_metrics AS (
  SELECT {''.join(f'g.{x}, ' for x in k.keys)} g.session_id, session_start, session_end,
    date_diff('second', session_start, session_end) AS session_duration_seconds,
    {R.sql_rround("date_diff('second', session_start, session_end)", '60', 2)} AS session_duration_minutes,
    tracks_played, unique_artists, unique_albums, devices_used,
    {R.sql_from_cents('_min_c')} AS total_minutes_played,
    {R.sql_rround('_min_c', f'{n} * 100', 2)} AS avg_track_duration,
    {R.sql_pct('_shuffle', n)} AS shuffle_usage_pct,
    {R.sql_pct('_skip', n)} AS skip_rate,
    {R.sql_pct('_complete', n)} AS completion_rate,
    CAST(offline_plays AS BIGINT) AS offline_plays,
    {R.sql_rround('unique_artists', n, 2)} AS diversity_score,
    {R.sql_rround(f'unique_artists * least({n}, 10)', f'{n} * 10', 2)} AS weighted_diversity_score,
    d.primary_device
  FROM session_agg g JOIN session_dev d ON {K(cfg).on('g', 'd')} AND g.session_id = d.session_id
),
sessions AS (
  SELECT {k.lead} session_id, session_start, session_end,
    CAST(session_start AS DATE) AS session_date,
    year(session_start) AS session_year,
    month(session_start) AS session_month,
    dayname(session_start) AS session_day_of_week,
    hour(session_start) AS session_start_hour,
    session_duration_seconds, session_duration_minutes, total_minutes_played,
    CASE WHEN session_duration_minutes < {a} THEN '{l0}' WHEN session_duration_minutes < {b} THEN '{l1}'
         WHEN session_duration_minutes < {c} THEN '{l2}' WHEN session_duration_minutes < {d} THEN '{l3}'
         ELSE '{l4}' END AS session_length_category,
    primary_device, devices_used, tracks_played, unique_artists, unique_albums, avg_track_duration,
    diversity_score, weighted_diversity_score, shuffle_usage_pct, skip_rate, completion_rate, offline_plays,
    CASE WHEN skip_rate > {t_skip} AND shuffle_usage_pct > {t_shuf} THEN '{LB.TYPE_ACTIVE}'
         WHEN shuffle_usage_pct > {t_shuf} THEN '{LB.TYPE_DISCOVERY}'
         WHEN weighted_diversity_score > {t_var} THEN '{LB.TYPE_VARIETY}'
         WHEN weighted_diversity_score < {t_foc} AND completion_rate > {t_alb} THEN '{LB.TYPE_ALBUM}'
         WHEN weighted_diversity_score < {t_foc} THEN '{LB.TYPE_DEEP}'
         ELSE '{LB.TYPE_BALANCED}' END AS session_type,
    CASE WHEN completion_rate > {e_hc} AND skip_rate < {e_hs} THEN '{LB.ENGAGEMENT_HIGH}'
         WHEN completion_rate > {e_mc} THEN '{LB.ENGAGEMENT_MEDIUM}'
         ELSE '{LB.ENGAGEMENT_LOW}' END AS engagement_level
  FROM session_metrics
)"""


def mode_cte(name: str, source: str, group: list[str], value: str, alias: str) -> str:
    """Most frequent `value` per `group`, NULL counted, ties to the smallest (NULL first)."""
    gl = ", ".join(group)
    part = f"PARTITION BY {gl}" if group else ""
    return f"""{name} AS (
  SELECT {gl}{', ' if group else ''}{alias} FROM (
    SELECT {gl}{', ' if group else ''}{value} AS {alias},
      row_number() OVER ({part} ORDER BY count(*) DESC, {value} ASC NULLS FIRST) AS _mrn
    FROM {source} GROUP BY {gl}{', ' if group else ''}{value}
  ) WHERE _mrn = 1
)"""


def count_if_to_filter(sql: str) -> str:
    """Rewrite count_if(p) as count(*) FILTER (WHERE p): 0, never NULL, when no
    row qualifies (DuckDB's count_if gives NULL over all-NULL input)."""
    out, i, tok = [], 0, "count_if("
    while True:
        j = sql.find(tok, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        out.append(sql[i:j])
        depth, m = 1, j + len(tok)
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[m], 0)
            m += 1
        out.append(f"count(*) FILTER (WHERE {count_if_to_filter(sql[j + len(tok):m - 1])})")
        i = m


def with_stages(cfg: PipelineConfig, stage: str, body: str, extra: str = "") -> str:
    """WITH raw [, silver [, sessions]] [, extra] <body>."""
    ctes = [raw_cte()]
    if stage in ("silver", "sessions"):
        ctes.append(silver_ctes(cfg))
    if stage == "sessions":
        ctes.append(session_ctes(cfg))
    if extra:
        ctes.append(extra)
    return count_if_to_filter("WITH " + ",\n".join(ctes) + "\n" + body)
