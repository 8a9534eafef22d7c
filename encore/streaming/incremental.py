"""Incremental refresh: export files arriving in a folder -> silver -> sessions.

* Source: the file stream, each file read whole and parsed exactly as the
  batch ingest does (`classify_files`, `records`).
* Silver: the batch filter and projection; duplicates are dropped with
  `dropDuplicatesWithinWatermark` on the event time (UTC instant of `ts`).
* Sessions: per-account state (`applyInPandasWithState`). The state holds the
  previous play's end and the open session's counters. Each micro-batch
  brings an account's new plays; they are ordered, chained to the state with
  the batch gap rule (vectorised in pandas), and every session that a later
  play closes is emitted. The open session is emitted when the watermark
  passes its last play plus the gap (plus one hour for a DST shift).
  Emitted counters go through the same finishing and classification
  expressions as the batch sessions table.

Plays that arrive after a later play of the same account has been chained
cannot be placed in its timeline any more: they are emitted as rows with
kind = 'late' (one per play) instead of being chained, so a sink can route them
to a rebuild list; sessions are the rows with kind = 'session'. Plays older than
the watermark are dropped by Spark before the state sees them; the query's progress
counts them (`numRowsDroppedByWatermark` of its state operators).
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from encore import labels as LB
from encore.config import DEFAULT, PipelineConfig
from encore.functions import rounding as R
from encore.operators.sessions import classify, finish_metrics
from encore.operators.silver import DEDUP_KEY, music_filter, project_silver
from encore.schemas import PLAY_ORDER, RAW_COLUMNS
from encore.sources.ingest import classify_files, records

OUT_SCHEMA = ("account_id long, session_id long, session_start timestamp_ntz, session_end timestamp_ntz, "
              "tracks_played long, unique_artists long, unique_albums long, devices_used long, _min_c long, "
              "_shuffle long, _skip long, _complete long, offline_plays long, primary_device string, kind string")
STATE_SCHEMA = "last_end long, last_event_ms long, next_id long, open string, last_key string"
SESSION, LATE = "session", "late"


def play_stream(spark: SparkSession, in_dir: str, account_id: int | None = None,
                max_files_per_trigger: int | None = None) -> DataFrame:
    """Raw plays (+ source_file, event_time) from export files appearing in `in_dir`."""
    reader = spark.readStream
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    text = reader.text(in_dir, wholetext=True).select(F.col("_metadata.file_path").alias("source_file"), "value")
    return records(classify_files(text), account_id)


def silver_stream(raw: DataFrame, cfg: PipelineConfig = DEFAULT, delay: str = "2 hours") -> DataFrame:
    keys = list(cfg.keys)
    cols = [c for c in RAW_COLUMNS if c != "account_id" or "account_id" in keys] + ["event_time"]
    m = music_filter(raw.select(*cols), cfg).withWatermark("event_time", delay)
    m = m.dropDuplicatesWithinWatermark(keys + DEDUP_KEY)
    return project_silver(m, cfg, extra=[F.col("event_time")])


# ---------------------------------------------------------------- state step
def _us(s: pd.Series) -> np.ndarray:
    return s.to_numpy(dtype="datetime64[us]").astype("int64")


def _new_open(sid: int) -> dict:
    return {"id": sid, "start": None, "end": None, "n": 0, "artists": [], "albums": [], "devices": [],
            "dev": [], "min_c": 0, "shuffle": 0, "skip": 0, "complete": 0, "offline": 0}


def _absorb(acc: dict, part: pd.DataFrame) -> dict:
    s, e = int(part["_s"].min()), int(part["_e"].max())
    acc["start"] = s if acc["start"] is None else min(acc["start"], s)
    acc["end"] = e if acc["end"] is None else max(acc["end"], e)
    acc["n"] += len(part)
    for col, name in (("artist_name", "artists"), ("album_name", "albums"), ("device", "devices")):
        vals = set(acc[name]) | set(part[col].dropna().tolist())
        acc[name] = sorted(vals)
    counts = {}
    for d, c in part["device"].value_counts(dropna=False).items():   # distinct values only
        d = None if pd.isna(d) else d
        counts[d] = counts.get(d, 0) + int(c)
    for d, c in acc["dev"]:                      # [value or None, count] pairs (JSON-safe)
        counts[d] = counts.get(d, 0) + c
    acc["dev"] = [[d, c] for d, c in counts.items()]
    for col, name in (("_min_c", "min_c"), ("_shuffle_b", "shuffle"), ("_skip_b", "skip"),
                      ("_complete_b", "complete"), ("_offline_b", "offline")):
        acc[name] += int(part[col].sum())
    return acc


def _row(key, acc: dict) -> dict:
    # most used device: highest count, ties to the smallest value, NULL first
    best = min(acc["dev"], key=lambda kv: (-kv[1], kv[0] is not None, kv[0] or ""))
    return {"account_id": key, "session_id": acc["id"],
            "session_start": pd.Timestamp(acc["start"], unit="us"), "session_end": pd.Timestamp(acc["end"], unit="us"),
            "tracks_played": acc["n"], "unique_artists": len(acc["artists"]), "unique_albums": len(acc["albums"]),
            "devices_used": len(acc["devices"]), "_min_c": acc["min_c"], "_shuffle": acc["shuffle"],
            "_skip": acc["skip"], "_complete": acc["complete"], "offline_plays": acc["offline"],
            "primary_device": best[0], "kind": SESSION}


def _out(rows: list[dict]) -> pd.DataFrame:
    cols = [c.split()[0] for c in OUT_SCHEMA.split(", ")]
    return pd.DataFrame(rows, columns=cols)


def make_step(cfg: PipelineConfig):
    gap, overlap = cfg.gap_seconds * 1_000_000, cfg.overlap_seconds * 1_000_000
    hold_ms = (cfg.gap_seconds + 3600) * 1000

    def step(key, pdfs, state):
        acct = key[0]
        if state.hasTimedOut:
            last_end, last_ms, next_id, open_s, last_key = state.get
            # the open session ends; the next id and the last play stay, so ids are never used again
            state.update((last_end, last_ms, next_id, "null", last_key))
            yield _out([_row(acct, json.loads(open_s))] if open_s != "null" else [])
            return
        pdf = pd.concat(list(pdfs), ignore_index=True)
        pdf = pdf.assign(_s=_us(pdf["play_start_MST"]), _e=_us(pdf["play_end_MST"]))
        pdf = pdf.sort_values(["_s", "_e", "track_uri", "ms_played"], kind="stable").reset_index(drop=True)
        late_rows = []
        if state.exists:
            last_end, last_ms, next_id, open_s, last_key = state.get
            acc = json.loads(open_s)
            ls, le, lu, lm = json.loads(last_key)
            s_, e_, u_, m_ = (pdf["_s"].to_numpy(), pdf["_e"].to_numpy(), pdf["track_uri"].to_numpy(),
                              pdf["ms_played"].to_numpy())
            late = (s_ < ls) | ((s_ == ls) & ((e_ < le) | ((e_ == le) & ((u_ < lu) | ((u_ == lu) & (m_ < lm))))))
            for _, part in pdf[late].groupby(np.arange(int(late.sum()))):   # one row per late play
                row = _row(acct, _absorb(_new_open(None), part))
                row["kind"] = LATE
                late_rows.append(row)
            pdf = pdf[~late].reset_index(drop=True)
            if pdf.empty:
                yield _out(late_rows)
                return
        else:
            last_end, last_ms, next_id, acc = None, 0, 1, None
        prev = np.concatenate([[np.nan if last_end is None else last_end], pdf["_e"].to_numpy()[:-1]])
        g = pdf["_s"].to_numpy() - prev
        new = np.isnan(g) | (g > gap) | (g < -overlap)
        if acc is None:
            new[0] = True
        seg = np.cumsum(new)                      # 0 = continues the open session
        emitted = []
        for sid_local, part in pdf.groupby(seg, sort=True):
            if sid_local == 0:
                acc = _absorb(acc, part)
                continue
            if acc is not None:
                emitted.append(_row(acct, acc))
            acc = _absorb(_new_open(next_id), part)
            next_id += 1
        last_ms = max(last_ms, int(pdf["_ev"].max()))
        tail = pdf.iloc[-1]
        key = json.dumps([int(tail["_s"]), int(tail["_e"]), tail["track_uri"], int(tail["ms_played"])])
        state.update((int(tail["_e"]), last_ms, next_id, json.dumps(acc), key))
        state.setTimeoutTimestamp(max(last_ms + hold_ms, state.getCurrentWatermarkMs() + 1))
        yield _out(emitted + late_rows)

    return step


def sessions_stream(silver: DataFrame, cfg: PipelineConfig = DEFAULT) -> DataFrame:
    """Closed sessions with the batch session table's columns, plus `kind`
    ('session', or 'late' for a play that arrived too late to be chained)."""
    if list(cfg.keys) != ["account_id"]:
        raise ValueError("the streaming sessions keep state per account_id")
    plays = silver.select(
        "account_id", *PLAY_ORDER, "artist_name", "album_name", "device",
        R.minutes_c(F.col("ms_played")).alias("_min_c"),
        F.coalesce("shuffle_flag", F.lit(False)).alias("_shuffle_b"),
        F.coalesce("skipped_flag", F.lit(False)).alias("_skip_b"),
        (F.col("completion_category") == LB.COMPLETION_COMPLETE).alias("_complete_b"),
        F.coalesce("offline_flag", F.lit(False)).alias("_offline_b"),
        R.idiv(F.unix_micros("event_time"), F.lit(1000)).alias("_ev"),
        "event_time")   # carries the watermark to the stateful operator
    counters = plays.groupBy("account_id").applyInPandasWithState(
        make_step(cfg), OUT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout)
    return classify(finish_metrics(counters, ["account_id"], extra=["kind"]), cfg, extra=["kind"])


__all__ = ["play_stream", "silver_stream", "sessions_stream"]
