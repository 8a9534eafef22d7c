"""Command line: the whole pipeline over a folder of export files.

  python -m encore run <export dir> <out dir> [--account-id N | --global] [--split] [--master local[8]]
      ingest *.json -> raw, silver, plays_with_session_id, sessions tables
      -> six views -> CSV; the ingest report, quarantine, all profiles, checks
      and expectations are written as tables under <out dir>/reports.
  python -m encore report <export dir>
      only validate and count the files.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from encore.config import DEFAULT, GLOBAL
from encore.plans import pipeline as P
from encore.sources.export import write_table
from encore.sources.array_files import ingest_split
from encore.sources.ingest import OK, ingest, summary
from encore.spark import build_session


def main(argv=None) -> int:
    ap = argparse.ArgumentParser(prog="encore")
    sub = ap.add_subparsers(dest="cmd", required=True)
    run = sub.add_parser("run")
    run.add_argument("export_dir")
    run.add_argument("out_dir")
    rep = sub.add_parser("report")
    rep.add_argument("export_dir")
    for p in (run, rep):
        p.add_argument("--account-id", type=int, default=None,
                       help="key for all files (default: the account_id=<n> folder in each path, else 0)")
        p.add_argument("--master", default=None)
    run.add_argument("--global", dest="one_timeline", action="store_true",
                     help="one timeline over all files, without an account key")
    run.add_argument("--split", action="store_true", help="split files over tasks: for files too large for one task each")
    args = ap.parse_args(argv)

    spark = build_session(args.master)
    store = f"{args.out_dir}/tables/ingested" if args.cmd == "run" else None
    if args.cmd == "run" and args.split:
        res = ingest_split(spark, args.export_dir, store, account_id=args.account_id)
    else:
        res = ingest(spark, args.export_dir, account_id=args.account_id, store=store)
    if args.cmd == "report":
        res.report.filter(F.col("status") != OK).orderBy("source_file").show(50, truncate=False)    # the first that are not
        summary(res.report).show()
        return 0

    summary(res.report).show()
    write_table(res.report, f"{args.out_dir}/reports/ingest")
    write_table(res.quarantine, f"{args.out_dir}/reports/quarantine")
    cfg = GLOBAL if args.one_timeline else DEFAULT
    raw = res.raw.drop("source_file", "event_time").withColumn("account_id", F.coalesce("account_id", F.lit(0).cast("long")))
    if args.one_timeline:
        raw = raw.drop("account_id")
    st = P.materialize(spark, raw, f"{args.out_dir}/tables", cfg)
    P.register_views(st)
    P.export_csv(st, args.out_dir)
    P.write_reports(st, f"{args.out_dir}/reports")
    exp = spark.read.parquet(f"{args.out_dir}/reports/expectations")
    failed = exp.filter(~exp.passed).count()
    print(f"tables in {args.out_dir}/tables, CSV in {args.out_dir}/csv, reports in {args.out_dir}/reports; "
          f"{failed} expectation(s) failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
