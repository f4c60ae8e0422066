"""Command line: process, timeline, trends, ask."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from kinetra.operators import answers, rollup, store
from kinetra.plans import recognition
from kinetra.session import session
from kinetra.sources import files, sinks


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="kinetra")
    sub = p.add_subparsers(dest="verb", required=True)
    a = sub.add_parser("process", help="sensor text to a timeline table")
    a.add_argument("input")
    a.add_argument("output")
    a.add_argument("--user", default="user")
    for verb in ("timeline", "trends", "ask"):
        b = sub.add_parser(verb)
        b.add_argument("table")
        if verb == "ask":
            b.add_argument("question")
        if verb == "timeline":
            b.add_argument("--limit", type=int, default=50)
    args = p.parse_args(argv)
    spark = session()
    if args.verb == "process":
        rows = files.sensor_table(spark, args.input).withColumn("uuid", F.lit(args.user))
        sinks.replace(recognition.timeline(files.chunks_to_bursts(rows, ["uuid"])), args.output)
        return 0
    table = spark.read.parquet(args.table)
    if args.verb == "timeline":
        line = sinks.aligned((F.col("label"), 22), (F.round("t_start", 1), 16), (F.round("t_end", 1), 16), (F.round("confidence", 2), 6))
        print("\n".join(r[0] for r in store.page(table, limit=args.limit).select(line).collect()))
    elif args.verb == "trends":
        day = table.select("label", rollup.utc_day(F.col("t_start")).alias("date"), (F.col("t_end") - F.col("t_start")).alias("duration_s"))
        labels = sorted(r["label"] for r in table.select("label").distinct().collect())  # the class domain
        rollup.daily_pivot(day, labels).orderBy("date").show(400, False)
    else:
        print(answers.render(answers.answer(args.question, table)))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
