"""Ingest files from FIXTURES.md section 4 and a JSON round trip."""
import datetime as dt
import json

from pyspark.sql import functions as F

from encore.sources.ingest import discover, ingest, summary


def _write(d, name, text):
    p = d / name
    p.write_text(text, encoding="utf-8")
    return p


def test_six_files(spark, tmp_path):
    rec = {"ts": "2022-01-01T10:00:00Z", "ms_played": 1000, "platform": "ios",
           "master_metadata_track_name": "Song", "spotify_track_uri": "track:1", "shuffle": None}
    _write(tmp_path, "good.json", json.dumps([rec, dict(rec, ms_played=2000, shuffle=True)]))
    _write(tmp_path, "accents.json", json.dumps([dict(rec, master_metadata_track_name="Canción ñandú")],
                                                ensure_ascii=False))
    _write(tmp_path, "object.json", json.dumps(rec))
    _write(tmp_path, "empty.json", "")
    _write(tmp_path, "none.json", "[]")
    _write(tmp_path, "cut.json", '[{"ts":"2022-01-01T10:00:00Z","ms_played":1},{"ts":')
    _write(tmp_path, "pretty.json", json.dumps([rec, rec], indent=2))   # exports are pretty-printed
    res = ingest(spark, str(tmp_path), account_id=7)
    rep = {r.source_file.rsplit("/", 1)[-1]: (r.status, r.records) for r in res.report.collect()}
    assert rep == {"good.json": ("ok", 2), "accents.json": ("ok", 1), "object.json": ("not_array", 0),
                   "empty.json": ("empty", 0), "none.json": ("zero_records", 0), "cut.json": ("invalid_json", 0),
                   "pretty.json": ("ok", 2)}
    raw = res.raw.collect()
    assert len(raw) == 5
    assert {r.master_metadata_track_name for r in raw} == {"Song", "Canción ñandú"}
    assert {r.account_id for r in raw} == {7}
    assert all(r.ts == dt.datetime(2022, 1, 1, 10, 0, 0) for r in raw)
    assert sorted(str(r.shuffle) for r in raw) == ["None", "None", "None", "None", "True"]
    q = {r.source_file.rsplit("/", 1)[-1] for r in res.quarantine.collect()}
    assert {"object.json", "cut.json", "none.json"} <= q
    s = summary(res.report).first()
    assert (s.files_ok, s.files_total, s.records_total) == (3, 7, 5)


def test_discover_requires_files(spark, tmp_path):
    import pytest
    with pytest.raises(FileNotFoundError):
        discover(spark, str(tmp_path))
    _write(tmp_path, "a.json", "[]")
    (tmp_path / "sub").mkdir()
    _write(tmp_path / "sub", "b.json", "[]")               # not recursive
    assert discover(spark, str(tmp_path)) == [f"file://{tmp_path}/a.json"]
    assert discover(spark, f"file:{tmp_path}/a.json") == [f"file://{tmp_path}/a.json"]


def test_round_trip_from_adapter(spark, tmp_path):
    """Export the adapter's raw plays as JSON arrays (one file per account),
    ingest them back, and get the same rows."""
    from encore.sources.plays import raw_from_events
    from tests.conftest import SF_SMALL
    raw = raw_from_events(spark, SF_SMALL)
    rows = raw.collect()  # 1,020 rows: a small fixture written by the test
    by_acct = {}
    for r in rows:
        d = r.asDict()
        d["ts"] = d["ts"].strftime("%Y-%m-%dT%H:%M:%SZ")
        by_acct.setdefault(d.pop("account_id"), []).append(d)
    for a, recs in by_acct.items():
        (tmp_path / f"account_id={a}").mkdir()
        _write(tmp_path / f"account_id={a}", "history.json", json.dumps(recs, ensure_ascii=False, indent=2))
    files = [str(p) for p in tmp_path.glob("account_id=*/history.json")]
    back = ingest(spark, files).raw.drop("source_file", "event_time")
    assert back.exceptAll(raw).count() == 0 and raw.exceptAll(back).count() == 0
    assert back.filter(F.col("account_id").isNull()).count() == 0


def test_jsonl_sink_and_load(spark, tmp_path):
    """A4 JSONL sink (NULL fields written) and A6 load give back the rows."""
    from encore.sources.export import write_jsonl
    from encore.sources.ingest import read_jsonl
    from encore.sources.plays import raw_from_events
    from tests.conftest import SF_SMALL
    raw = raw_from_events(spark, SF_SMALL).withColumn("source_file", F.lit("file:///x/history_2024.json"))
    write_jsonl(raw, str(tmp_path / "jsonl"))
    line = next((tmp_path / "jsonl" / "source_stem=history_2024").glob("*.json")).read_text().splitlines()[0]
    assert '"ip_addr":null' in line
    back = read_jsonl(spark, str(tmp_path / "jsonl" / "source_stem=history_2024"), account_id=0)
    assert back.exceptAll(raw.drop("source_file")).count() == 0
    assert raw.drop("source_file").exceptAll(back).count() == 0


def test_dirty_files(spark, tmp_path):
    """White space, text after the array, names with a space, values that do
    not fit: what is wrong is reported, and nothing else is lost."""
    rec = {"ts": "2022-01-01T10:00:00Z", "ms_played": 1000, "platform": "ios"}
    (tmp_path / "in sp").mkdir()
    d = tmp_path / "in sp"
    _write(d, "my hist.json", "\n\t " + json.dumps([rec]) + " \n")
    _write(d, "after.json", json.dumps([rec]) + " garbage")
    _write(d, "two.json", json.dumps([rec]) + json.dumps([rec]))
    _write(d, "comma.json", json.dumps([rec]) + ", 1")
    _write(d, "closed.json", json.dumps([rec]) + "]")
    _write(d, "values.json", json.dumps([dict(rec, ts="not a time"), dict(rec, ms_played="abc"),
                                         dict(rec, ms_played=1000.5, shuffle="x"), dict(rec, ms_played="7")]))
    _write(d, "zero.json", "")
    for store in (None, str(tmp_path / "store")):
        res = ingest(spark, str(d), account_id=1, store=store)
        rep = {r.source_file.rsplit("/", 1)[-1]: (r.status, r.records, r.bad_values) for r in res.report.collect()}
        assert rep == {"my%20hist.json": ("ok", 1, 0), "after.json": ("invalid_json", 0, 0), "two.json": ("invalid_json", 0, 0),
                       "comma.json": ("invalid_json", 0, 0), "closed.json": ("invalid_json", 0, 0),
                       "values.json": ("ok", 4, 4), "zero.json": ("empty", 0, 0)}
        raw = res.raw.collect()
        assert len(raw) == 5 and sorted(r.ms_played or 0 for r in raw) == [0, 0, 7, 1000, 1000]
        assert sum(r.ts is None for r in raw) == 1 and res.quarantine.count() == 4


def test_jsonl_bad_lines(spark, tmp_path):
    from encore.sources.ingest import read_jsonl
    _write(tmp_path, "a.jsonl", '{"ts":"2022-01-01T10:00:00Z","ms_played":5}\nnot json\n{"ms_played":"x"}\n')
    rows = read_jsonl(spark, str(tmp_path / "a.jsonl"), 3, bad_lines=str(tmp_path / "bad")).collect()
    assert [r.ms_played for r in rows] == [5, None]
    assert [r.value for r in spark.read.text(str(tmp_path / "bad")).collect()] == ["not json"]
    assert "ms_played" in read_jsonl(spark, str(tmp_path / "a.jsonl"), infer=True).columns


def test_export_files_follow_each_accounts_own_rows(spark, tmp_path):
    from encore.schemas import RAW
    from encore.sources.export import write_export_files
    # one account with most rows, one without an account id, thirty with one row each
    ids = spark.range(3080).select(F.col("id").alias("ms_played"), F.when(F.col("id") < 3000, 1).when(F.col("id") >= 3050, F.col("id"))
                                   .alias("account_id"))
    raw = ids.select(*[(F.col(f.name) if f.name in ids.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in RAW.fields])
    write_export_files(raw, str(tmp_path / "out"), per_file=100)
    files = [json.loads(p.read_text(encoding="utf-8")) for p in (tmp_path / "out").rglob("*.txt")]
    assert sorted(r["ms_played"] for f in files for r in f) == list(range(3080))
    assert max(map(len, files)) < 200 and 61 <= len(files) <= 62
