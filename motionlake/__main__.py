"""python -m motionlake segment|report|check --frames PATH --videos PATH [--out PATH]

segment: the eight phases of each task; report: one JSON report a task; check: the rule table's self-check and each
task's error, with code and message. Without --out the rows are printed.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from .dims import metric_specs, risk_rules
from .operators.risk import self_check
from .plans.report import Analysis
from .plans.service import coded, dump_reports


def made(spark: SparkSession, command: str, frames: str, videos: str) -> DataFrame:
    a = Analysis(spark.read.parquet(frames), spark.read.parquet(videos))
    if command == "segment":
        return a.events.orderBy("task_id", "phase_no")
    if command == "report":
        return a.report()
    return coded(a.errors).orderBy("task_id")


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="motionlake", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=("segment", "report", "check"))
    parser.add_argument("--frames", required=True)
    parser.add_argument("--videos", required=True)
    parser.add_argument("--out")
    asked = parser.parse_args(args)
    spark = SparkSession.builder.appName("motionlake").getOrCreate()
    rows = made(spark, asked.command, asked.frames, asked.videos)
    if asked.out and asked.command == "report":
        dump_reports(rows, asked.out)
    elif asked.out:
        rows.write.parquet(asked.out)
    else:
        rows.show(1000, truncate=False)
    if asked.command == "check":
        problems = self_check(risk_rules(spark), metric_specs(spark)).collect()
        for r in problems:
            print(r.rule_id, r.problem)
        return int(bool(problems) or not rows.isEmpty())
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
