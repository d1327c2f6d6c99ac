"""Command line: run the pipeline, a series or any catalogue query on a folder of tables.

    python -m sward pipeline --tables DIR --out DIR [--csv DIR]
    python -m sward series   --tables DIR --metric speciesRichness --plots 00001,00002 --out DIR
    python -m sward query    --tables DIR --name change_type --out DIR
    python -m sward list

Outputs are written by Spark (Parquet; CSV where asked); nothing is collected
to the driver.
"""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="sward")
    sub = ap.add_subparsers(dest="cmd", required=True)
    p = sub.add_parser("pipeline", help="analysis table (E1) as Parquet, optionally CSV")
    p.add_argument("--tables", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--csv")
    s = sub.add_parser("series", help="per-plot series with reference lines for one metric")
    s.add_argument("--tables", required=True)
    s.add_argument("--metric", default="speciesRichness")
    s.add_argument("--plots", default="", help="comma-separated plot codes; empty = no rows")
    s.add_argument("--out", required=True)
    q = sub.add_parser("query", help="one catalogue query")
    q.add_argument("--tables", required=True)
    q.add_argument("--name", required=True)
    q.add_argument("--out", required=True)
    sub.add_parser("list", help="catalogue query names")
    ap.add_argument("--master", default=None)
    args = ap.parse_args(argv)

    from sward.plans import catalog
    if args.cmd == "list":
        print("\n".join(sorted(catalog.QUERIES)))
        return 0

    from sward.session import build_session
    spark = build_session(args.master)
    if args.cmd == "pipeline":
        from sward.plans.pipeline import write_site_table
        write_site_table(spark, args.tables, args.out, args.csv)
    elif args.cmd == "series":
        from sward.operators.mapview import series_with_reference
        from sward.plans.pipeline import site_table
        ids = [x for x in args.plots.split(",") if x]
        series_with_reference(site_table(spark, args.tables), args.metric, ids).write.mode("overwrite").parquet(args.out)
    else:
        catalog.QUERIES[args.name](spark, args.tables).write.mode("overwrite").parquet(args.out)
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
