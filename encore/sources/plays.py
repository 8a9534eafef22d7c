"""Raw plays table.

`raw_from_events` turns the shared `events` / `part` tables into play-history
export records (the adapter defined in FIXTURES.md): every event is a play,
one event in fifty appears twice (exact duplicates), one in 97 is a podcast
episode, and 38 users make one account. It runs as one narrow projection over
one scan and a dimension lookup, so its cost grows linearly with `events`.

`read_raw` reads a raw table that the ingest job wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from encore.functions.timeutil import trunc_ntz
from encore.schemas import RAW, RAW_COLUMNS

ACCOUNT_USERS = 38          # users folded into one account
DAYS_SHIFT = 270            # accounts are moved back by 0/270/540/810 days
DUP_EVERY, PODCAST_EVERY = 50, 97
NO_PLATFORM_EVERY, NO_SKIP_FLAG_EVERY, INCOGNITO_EVERY = 101, 89, 53
OFFLINE_TS_BASE = 1700000000


def raw_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_brand", "p_type")
    # one scan: an event that appears twice is exploded, and props is parsed once
    times = F.when(F.col("event_id") % DUP_EVERY == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    e = ev.withColumn("_ks", F.get_json_object("props", "$.k")).withColumn("_copy", F.explode(times)).drop("_copy")
    e = e.withColumn("_k", F.col("_ks").cast("long"))
    # part is a dimension keyed by p_partkey: Catalyst / AQE broadcast it when its
    # measured size is under the threshold and fall back to a shuffle join above it
    j = e.join(part, F.col("_k") + 1 == F.col("p_partkey"), "left")

    uid, eid, val, etype = F.col("user_id"), F.col("event_id"), F.col("value"), F.col("event_type")
    account = F.call_function("div", uid, F.lit(ACCOUNT_USERS))
    is_ep = eid % PODCAST_EVERY == 0
    shift_days = (F.lit(-DAYS_SHIFT) * (account % 4)).cast("int")
    ts = trunc_ntz(F.timestamp_add("DAY", shift_days, F.col("ts")), "SECOND")
    none_s = F.lit(None).cast("string")

    cols = {
        "account_id": account,
        "ts": ts,
        "ms_played": F.floor(val * 6000).cast("long"),
        "platform": (F.when(eid % NO_PLATFORM_EVERY == 0, none_s)
                     .when(uid % 5 == 0, "ios").when(uid % 5 == 1, "web").otherwise("android")),
        "conn_country": F.when(uid % 3 == 0, "MX").when(uid % 3 == 1, "US").otherwise("ES"),
        "ip_addr": none_s,
        "master_metadata_track_name": F.when(is_ep, none_s).otherwise(F.col("p_name")),
        "master_metadata_album_artist_name": F.when(is_ep, none_s).otherwise(F.col("p_brand")),
        "master_metadata_album_album_name": F.when(is_ep, none_s).otherwise(F.col("p_type")),
        "spotify_track_uri": F.when(is_ep, none_s).otherwise(
            F.concat(F.lit("track:"), F.col("_ks"))),
        "episode_name": F.when(is_ep, F.concat(F.lit("ep:"), eid.cast("string"))),
        "episode_show_name": F.when(is_ep, F.lit("show")),
        "spotify_episode_uri": F.when(is_ep, F.concat(F.lit("epuri:"), eid.cast("string"))),
        "audiobook_title": none_s,
        "audiobook_uri": none_s,
        "audiobook_chapter_uri": none_s,
        "audiobook_chapter_title": none_s,
        "reason_start": etype,
        "reason_end": (F.when(val < 10, "fwdbtn").when(etype == "error", "logout")
                       .otherwise("trackdone")),
        "shuffle": uid % 2 == 0,
        "skipped": F.when(eid % NO_SKIP_FLAG_EVERY == 0, F.lit(None).cast("boolean")).otherwise(val < 10),
        "offline": etype == "error",
        "offline_timestamp": F.when(etype == "error", F.lit(OFFLINE_TS_BASE) + eid),
        "incognito_mode": eid % INCOGNITO_EVERY == 0,
    }
    return j.select(*[cols[n].cast(RAW[n].dataType).alias(n) for n in RAW_COLUMNS])


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RAW).parquet(path)
