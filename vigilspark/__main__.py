"""Command line: python -m vigilspark validate|import|convert|compose."""

from __future__ import annotations

import argparse
import json
import sys
from collections import Counter
from pathlib import Path

from pyspark.sql import SparkSession

from vigilspark.operators.prepare import resequenced
from vigilspark.operators.validate import available, run_checks
from vigilspark.plans.compose import CompositionConfig, compose_store
from vigilspark.sources.database import convert
from vigilspark.sources.ingest import import_logs, ingest_stats
from vigilspark.sources.store import EVENT_SCHEMA, EventStore, attack_pools


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="vigilspark")
    commands = parser.add_subparsers(dest="command", required=True)
    validate = commands.add_parser("validate", help="label checks of a store; exit code 1 if one fails")
    validate.add_argument("store")
    validate.add_argument("--check", action="append", choices=available(scrubbed=False, expected=False), help="repeatable; all by default")
    load = commands.add_parser("import", help="benign events of a folder of log files into a new store")
    load.add_argument("logs")
    load.add_argument("store")
    load.add_argument("--reference-time", required=True, help="dates without a year are read as before this time")
    load.add_argument("--host")
    made = commands.add_parser("compose", help="a timeline from a benign and an attack store, by a YAML file")
    made.add_argument("config")
    for name in ("benign", "attacks", "output"):
        made.add_argument(f"--{name}", help="instead of the one that the YAML file names")
    made.add_argument("--start", help="where the timeline begins; at the first benign row by default")
    taken = commands.add_parser("convert", help="a store from an SQLite event database (.db or .db.zst)")
    taken.add_argument("database")
    taken.add_argument("store")
    got = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    if got.command == "validate":
        store = EventStore(spark, got.store)
        rows = run_checks(store.events(), got.check, store.campaigns()).collect()
        for r in rows:
            print(f"{r['status']:4} {r['name']} ({r['n_bad']})")
        print("Summary: " + " | ".join(f"{n} {s}" for s, n in sorted(Counter(r["status"] for r in rows).items())))
        return int(any(r["status"] == "FAIL" for r in rows))
    if got.command == "import":
        rows = import_logs(spark, got.logs, got.reference_time, got.host)
        ids = resequenced(rows.filter("source is not null").withColumnRenamed("line_no", "id"), ("timestamp", "path", "id")).drop("id").withColumnRenamed("new_id", "id")
        columns = [c.split()[0] for c in EVENT_SCHEMA.split(", ")]
        EventStore(spark, got.store, "w").append(ids.select(*columns))
        for r in ingest_stats(rows).collect():
            print(json.dumps(r.asDict()))
        return 0
    if got.command == "convert":
        print(json.dumps({"events": convert(spark, got.database, got.store).events().count()}))
        return 0
    config = CompositionConfig.from_yaml(Path(got.config).read_text(), str(Path(got.config).parent))
    benign, attacks, out = got.benign or config.benign, got.attacks or config.attacks, got.output or config.output
    if not (benign and attacks and out):
        parser.error("benign, attacks and output have to be named, in the YAML file or here")
    pools = attack_pools(EventStore(spark, attacks).events())
    print(json.dumps(compose_store(spark, EventStore(spark, benign).events().filter("is_malicious = 0"), pools, config, out, got.start, benign, attacks)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
