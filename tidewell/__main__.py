"""python -m tidewell run SCRIPT --data FILE.json | check FOLDER: scripts from the command line."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidewell.plans import script
from tidewell.sources import bars


def main() -> None:
    parser = argparse.ArgumentParser(prog="tidewell")
    sub = parser.add_subparsers(dest="what", required=True)
    run = sub.add_parser("run", help="run a script over bars and print the last bar of each plot, or a strategy's trades")
    run.add_argument("script")
    run.add_argument("--data", help="a JSON object of arrays; made-up daily bars if left out")
    run.add_argument("--bars", type=int, default=100)
    run.add_argument("--tf", default="D")
    run.add_argument("--viz", action="store_true", help="print what is drawn, as JSON")
    check = sub.add_parser("check", help="compile all .pine files of a folder and print the share that passes")
    check.add_argument("folder")
    args = parser.parse_args()
    spark = SparkSession.builder.master("local[*]").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if args.what == "check":
        texts = spark.read.option("wholetext", True).option("pathGlobFilter", "*.pine").text(args.folder).select(F.input_file_name().alias("path"), "value")
        found = script.check(texts).groupBy("ok").count().collect()
        passed, total = sum(r["count"] for r in found if r.ok), sum(r["count"] for r in found)
        print(f"{passed} of {total} compile")
        return
    with open(args.script, encoding="utf-8") as f:
        source = f.read()
    data = bars.from_json(spark, args.data) if args.data else bars.from_arrays(spark, bars.walk(args.bars))
    out = script.run(data, source, chart_tf=args.tf)
    drawn = script.plots_of(source, chart_tf=args.tf)
    if args.viz:
        print(json.dumps({"plots": drawn, "bars": [r.asDict(recursive=True) for r in out.orderBy("bar_index").toLocalIterator()]}))
        return
    last = out.orderBy(F.desc("bar_index")).first()
    for p in drawn:
        print(p["title"] or p["kind"], last[f"plot_{p['slot']}"])
    trades = script.trades(data, source, chart_tf=args.tf)
    made = trades.agg(F.count(F.lit(1)).alias("n"), F.sum("profit").alias("profit")).first()
    if made.n:
        print(f"{made.n} trades, net profit {made.profit:g}")


if __name__ == "__main__":
    main()
