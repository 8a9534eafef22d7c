"""Files split over tasks give what whole files give; tables are replaced whole."""
import json

import pytest
from pyspark.sql import functions as F

from encore.sources.array_files import ingest_split
from encore.sources.export import write_table
from encore.sources.ingest import ingest

REC = {"ts": "2022-01-01T10:00:00Z", "ms_played": 1000, "platform": "ios", "master_metadata_track_name": "Song",
       "spotify_track_uri": "track:1", "shuffle": None}
NAMES = ["a } b", "plain", "}", 'x "}" {y}', "\\", "{}", '},{"a":1}', "plain", "end }"]
FILES = {
    "good.json": json.dumps([REC, dict(REC, ms_played=2000, shuffle=True)]),
    "odd.json": json.dumps([dict(REC, master_metadata_track_name=x) for x in NAMES] * 7, indent=2),
    "all odd.json": json.dumps([dict(REC, master_metadata_track_name="}")] * 30),
    "big.json": json.dumps([dict(REC, ms_played=i) for i in range(300)], indent=1),
    "object.json": json.dumps(REC), "empty.json": "", "space.json": " \n", "none.json": " [ ] ", "text.json": "hello",
    "cut.json": '[{"ts":"2022-01-01T10:00:00Z","ms_played":1},{"ts":', "cut2.json": '[{"ms_played":1}',
    "after.json": json.dumps([REC]) + " garbage", "two.json": json.dumps([REC]) * 2, "comma.json": json.dumps([REC]) + ", 1",
    "closed.json": json.dumps([REC]) + "]", "nocomma.json": '[{"ms_played":1} {"ms_played":2}]',
    "dirty.json": "\n\t " + json.dumps([dict(REC, ts="no"), dict(REC, ms_played="abc")]) + " \n",
}


def test_split_files_equal_whole_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name, text in FILES.items():
        (folder / name).write_text(text, encoding="utf-8")
    conf = {"spark.sql.files.maxPartitionBytes": "500", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        split = ingest_split(spark, str(folder), str(tmp_path / "store"), account_id=7)
        blocks = spark.read.parquet(str(tmp_path / "store" / "pieces")).groupBy("source_file").agg(F.countDistinct("block").alias("n"))
        assert blocks.filter("n > 20").count() >= 2              # the large ones were read by many tasks
        longest = spark.read.parquet(str(tmp_path / "store" / "pieces")).agg(F.max("size")).first()[0]
        assert longest < 600
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    whole = ingest(spark, str(folder), account_id=7, store=str(tmp_path / "whole"))
    rows = lambda r: {x.source_file: (x.status, x.records, x.bad_values) for x in r.collect()}
    assert rows(split.report) == rows(whole.report) and len(rows(split.report)) == len(FILES)
    a, b = split.raw.select(whole.raw.columns), whole.raw
    assert a.count() == b.count() == 397 and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    assert {r.source_file for r in split.quarantine.collect()} >= {r.source_file for r in whole.quarantine.collect()} - {
        r.source_file for r in whole.report.filter("status = 'empty'").collect()}
    assert whole.totals == {"records": 397, "bad_values": 2, "bad_files": len(FILES) - 5 - 1}    # zero bytes: no row


def test_failed_write_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t" / "table")
    write_table(spark.range(5), path)
    broken = spark.range(10).select(F.when(F.col("id") == 9, F.raise_error(F.lit("stop")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="stop"):
        write_table(broken, path)
    assert spark.read.parquet(path).count() == 5
    write_table(spark.read.parquet(path).filter("id > 1"), path)         # replaced by what is read from it
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [2, 3, 4]
    assert [p.name for p in (tmp_path / "t").iterdir()] == ["table"]


def test_only_the_partitions_written_are_replaced(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = lambda n, *days: spark.createDataFrame([(d, n) for d in days], "day long, n long")
    write_table(rows(1, 1, 2, 3), path, ["day"])
    write_table(rows(2, 2), path, ["day"], only_partitions=True)
    assert sorted(map(tuple, spark.read.parquet(path).select("day", "n").collect())) == [(1, 1), (2, 2), (3, 1)]
    write_table(rows(3, 2), path, ["day"])
    assert spark.read.parquet(path).count() == 1
