"""Jobs from the command line: ``python -m freshet JOB ...``; each reads and writes Parquet folders."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import evolution
from .operators import validate, windows
from .plans import jobs, reports, serving
from .sources import events as sources
from .sources import sinks


def parser() -> argparse.ArgumentParser:
    own = argparse.ArgumentParser(prog="python -m freshet", description=__doc__)
    job = own.add_subparsers(dest="job", required=True)

    def add(name: str, about: str, *paths: str) -> argparse.ArgumentParser:
        p = job.add_parser(name, help=about)
        for x in paths:
            p.add_argument(x)
        return p

    p = add("generate", "write synthetic events", "out")
    p.add_argument("--events", type=int, default=10_000)
    p.add_argument("--now-us", type=int, required=True)
    p.add_argument("--seed", type=int, default=42)
    p = add("validate", "route events to valid ones and dead letters", "events", "valid", "dlq")
    p.add_argument("--now-us", type=int, required=True)
    p.add_argument("--max-price-cents", type=int, default=1_000_000_000)
    add("features", "write feature records of all resolutions", "events", "out")
    p = add("sink", "insert events into the offline table", "events", "table")
    p.add_argument("--batch", type=int, default=0)
    p = add("online", "upsert feature records into the online table", "features", "table")
    p.add_argument("--batch", type=int, default=0)
    p.add_argument("--compact", action="store_true")
    p = add("serve", "answer feature requests from the online table", "table")
    p.add_argument("--port", type=int, default=8000)
    p = add("register", "check that schema files can follow each other: exit code 1 if not, 2 if one is broken", "old", "new")
    p.add_argument("--rule", default="BACKWARD")
    return own


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName(f"freshet-{a.job}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    read = spark.read.parquet
    if a.job == "generate":
        sources.synthetic(spark, a.events, a.now_us, a.seed).write.mode("overwrite").parquet(a.out)
    elif a.job == "validate":
        events = read(a.events)
        good, bad = jobs.validate_and_route(events, a.now_us, max_price_cents=a.max_price_cents)
        good.write.mode("overwrite").parquet(a.valid)
        bad.write.mode("overwrite").parquet(a.dlq)
        print(reports.validation_report(validate.tag(events, validate.default_rules(a.now_us, max_price_cents=a.max_price_cents))))
    elif a.job == "features":
        windows.sliding_all(read(a.events)).write.mode("overwrite").parquet(a.out)
    elif a.job == "sink":
        events = read(a.events)
        arrival = F.col("offset") if "offset" in events.columns else F.col("event_us")
        sinks.OfflineTable(spark, a.table).append(events.withColumn("arrival", arrival), a.batch)
    elif a.job == "online":
        table = sinks.OnlineTable(spark, a.table)
        table.upsert(read(a.features), a.batch)
        if a.compact:
            table.compact()
    elif a.job == "serve":
        serving.server(serving.FeatureApi(sinks.OnlineTable(spark, a.table).read), a.port).serve_forever()
    elif a.job == "register":
        try:
            old, new = (json.load(open(p)) for p in (a.old, a.new))
            registry = evolution.Registry(spark, a.rule)
            registry.register("subject", old)
        except (OSError, ValueError) as problem:
            print(problem, file=sys.stderr)
            return 2
        try:
            print(f"version {registry.register('subject', new)}")
        except evolution.SchemaError as problem:
            print(problem, file=sys.stderr)
            return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
