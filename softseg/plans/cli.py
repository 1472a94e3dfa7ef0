"""Command line: generate-data, run, select-k, compare, plot-data, describe, unpack-events."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from softseg.operators import counts, fuzzify, rules
from softseg.sources import files, sample
from softseg.sources.files import jsonable

from . import figures, segmentation
from .config import config, from_yaml


def _settings(args) -> dict:
    return from_yaml(args.config) if args.config else config()


def _run(spark: SparkSession, args, **options) -> segmentation.Result:
    cfg = _settings(args)
    if getattr(args, "rules", None) is not None:
        cfg["rules"]["enabled"] = bool(args.rules)
    return segmentation.run(files.load_case(spark, args.root or cfg["data"]["root"]), cfg, **options)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="softseg", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("generate-data", "run", "select-k", "compare", "plot-data", "describe", "unpack-events"):
        p = commands.add_parser(name)
        p.add_argument("--config")
        p.add_argument("--root", help="folder of the case tables")
        p.add_argument("--out", default="outputs")
        if name == "generate-data":
            p.add_argument("--users", type=int, default=400)
            p.add_argument("--days", type=int, default=42)
            p.add_argument("--seed", type=int, default=7)
        if name == "run":
            p.add_argument("--rules", type=int, choices=(0, 1))
        if name == "unpack-events":
            p.add_argument("--input", required=True)
            p.add_argument("--column", default="event_type_counts")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("softseg").getOrCreate()
    if args.command == "generate-data":
        files.write_case(sample.generate(spark, sample.Options(args.users, args.days, args.seed))[0], args.out)
    elif args.command == "run":
        segmentation.write(_run(spark, args), args.out)
    elif args.command == "select-k":
        print(json.dumps(jsonable(_run(spark, args, compare=False).figures["k_selection_suggestions"])))
    elif args.command == "compare":
        print(json.dumps(jsonable(_run(spark, args, select_k=False).figures["method_comparison"])))
    elif args.command == "plot-data":
        cfg = _settings(args)["fuzzification"]
        figures.membership_curves(spark, fuzzify.Fuzzifier(cfg["features"], cfg["default_normalisation"], cfg["shift_patterns"])).write.mode("overwrite").csv(f"{args.out}/membership_functions", header=True)
        figures.shift_curves(spark, cfg["shift_patterns"]).write.mode("overwrite").csv(f"{args.out}/shift_patterns", header=True)
    elif args.command == "describe":
        cfg = _settings(args)
        print(json.dumps(jsonable(fuzzify.Fuzzifier(cfg["fuzzification"]["features"]).describe()), indent=2))
        print("\n".join(rules.RuleLayer(cfg["rules"]["rules"], cfg["rules"]["context_terms"]).describe()))
    else:
        table = spark.read.csv(args.input, header=True)
        counts.unpack_counts(table.select("*"), args.column).select(*[F.col("*")]).write.mode("overwrite").csv(args.out, header=True)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
