"""The streaming path gives the batch sessions for every closed session."""
import datetime as dt
import json
import os

from encore.config import DEFAULT
from encore.plans.stages import Stages
from encore.sources.plays import raw_from_events
from encore.streaming.incremental import play_stream, sessions_stream, silver_stream
from tests.conftest import SF_SMALL


def _files_at_session_gaps(rows, per_file=6):
    """Split plays (UTC end ts, ms) into chunks only where the next start is
    more than 1800 s after every earlier end, so file order is play order."""
    rows = sorted(rows, key=lambda r: (r["ts"] - dt.timedelta(milliseconds=r["ms_played"]), r["ts"]))
    chunks, cur, max_end, gaps = [], [], None, 0
    for r in rows:
        start = r["ts"] - dt.timedelta(milliseconds=r["ms_played"])
        if max_end is not None and (start - max_end).total_seconds() > 3600:
            gaps += 1
            if gaps % per_file == 0:
                chunks.append(cur)
                cur = []
        cur.append(r)
        max_end = r["ts"] if max_end is None else max(max_end, r["ts"])
    chunks.append(cur)
    return chunks


def test_stream_sessions_equal_batch(spark, tmp_path):
    raw = raw_from_events(spark, SF_SMALL)
    rows = [r.asDict() for r in raw.collect()]          # 1,020-row fixture, one account
    assert {r["account_id"] for r in rows} == {0}
    in_dir = tmp_path / "in"
    in_dir.mkdir()
    chunks = _files_at_session_gaps(rows)
    assert len(chunks) > 3
    for i, chunk in enumerate(chunks):
        recs = [{k: (v.strftime("%Y-%m-%dT%H:%M:%SZ") if k == "ts" else v) for k, v in r.items() if k != "account_id"}
                for r in chunk]
        p = in_dir / f"part{i:04d}.json"
        p.write_text(json.dumps(recs, indent=1), encoding="utf-8")
        os.utime(p, (1_700_000_000 + i, 1_700_000_000 + i))

    out = str(tmp_path / "out")

    def run():
        ses = sessions_stream(silver_stream(play_stream(spark, str(in_dir), account_id=0, max_files_per_trigger=1)))
        q = (ses.writeStream.foreachBatch(lambda df, _id: df.write.mode("append").parquet(out))
             .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
        q.awaitTermination(600)

    run()
    got = spark.read.parquet(out)
    assert got.filter("kind <> 'session'").count() == 0
    got = got.filter("kind = 'session'").drop("kind")
    batch = Stages(spark, SF_SMALL, DEFAULT).sessions
    last = batch.agg({"session_id": "max"}).first()[0]
    want = batch.filter(batch.session_id < last)
    assert got.count() >= want.count() > 100
    assert want.exceptAll(got).count() == 0
    assert got.exceptAll(batch).count() == 0

    # a play starting just before the last chained one arrives afterwards: it is
    # inside the watermark delay but cannot be chained, so it comes out as 'late'
    tail = max(rows, key=lambda r: (r["ts"] - dt.timedelta(milliseconds=r["ms_played"]), r["ts"]))
    start = tail["ts"] - dt.timedelta(milliseconds=tail["ms_played"]) - dt.timedelta(seconds=10)
    late = dict(tail, ts=start + dt.timedelta(seconds=60), ms_played=60000, spotify_track_uri="track:late")
    rec = {k: (v.strftime("%Y-%m-%dT%H:%M:%SZ") if k == "ts" else v) for k, v in late.items() if k != "account_id"}
    p = in_dir / "zz_late.json"
    p.write_text(json.dumps([rec]), encoding="utf-8")
    os.utime(p, (1_800_000_000, 1_800_000_000))
    run()
    lates = spark.read.parquet(out).filter("kind = 'late'").collect()
    assert len(lates) == 1 and lates[0].tracks_played == 1 and lates[0].session_id is None
