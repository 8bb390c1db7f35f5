"""Command-line driver (also usable with ``spark-submit``).

    python -m kpiloom list
    python -m kpiloom report revenue_daily_range --data DIR \
        --param start=DATE:2024-01-01 --param end=DATE:2024-01-31 [--out PATH] [--show 20]
    python -m kpiloom sql FILE --data DIR [--param name=TYPE:value] [--out PATH]
    python -m kpiloom daily --data DIR --out PATH [--feature-table NAME] [--shap-rows N] [--catalog]

``--data`` is a folder of the driver tables; ``--tables users,orders,order_items,events``
names catalog tables instead.  Report results are written as Parquet to
``--out`` (the rows stay distributed) or a bounded number of rows is shown.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession


def _source(spark: SparkSession, args):
    from .sources.silver import Sources
    if args.tables:
        names = args.tables.split(",")
        if len(names) != 4:
            raise SystemExit("--tables needs users,orders,order_items,events")
        return Sources.from_tables(spark, *names)
    if not args.data:
        raise SystemExit("give --data DIR or --tables ...")
    return args.data


def _params(items):
    from .plans.reports import PARAM_TYPES
    out = []
    for item in items or []:
        name, _, rest = item.partition("=")
        kind, _, value = rest.partition(":")
        if kind.upper() not in PARAM_TYPES:         # a plain text, which may hold a colon
            kind, value = "STRING", rest
        out.append({"name": name, "type": kind, "value": None if value.lower() == "null" else value})
    return out


def main(argv=None) -> int:
    ap = argparse.ArgumentParser(prog="kpiloom")
    sub = ap.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list", help="list the registered reports")
    rp = sub.add_parser("report", help="run one named report")
    rp.add_argument("name")
    dp = sub.add_parser("daily", help="build the gold models, test them, train")
    sp = sub.add_parser("sql", help="run a SQL file over the gold models and the silver tables")
    sp.add_argument("file")
    for p in (rp, dp, sp):
        p.add_argument("--data")
        p.add_argument("--tables")
        p.add_argument("--out")
    for p in (rp, sp):
        p.add_argument("--param", action="append",
                       help="name=TYPE:value (DATE, TIMESTAMP, INT64, FLOAT64, STRING, BOOL)")
        p.add_argument("--show", type=int, default=20)
    dp.add_argument("--feature-table", help="train on this table instead of the gold features")
    dp.add_argument("--shap-rows", type=int, help="explain a seeded sample of this many rows instead of all")
    dp.add_argument("--catalog", action="store_true", help="create catalog tables over the written models")
    args = ap.parse_args(argv)

    from .plans.reports import REGISTRY, run_report, run_sql
    if args.cmd == "list":
        print("\n".join(sorted(REGISTRY)))
        return 0

    from .session import build_session, size_session
    spark = build_session(app_name=f"kpiloom-{args.cmd}")
    src = _source(spark, args)
    if args.data:                                   # partitions for the size of the input
        size_session(spark, [args.data])
    if args.cmd in ("report", "sql"):
        if args.cmd == "report":
            df = run_report(spark, args.name, src, _params(args.param))
        else:
            with open(args.file, encoding="utf-8") as f:
                df = run_sql(spark, f.read(), src, _params(args.param))
        if args.out:
            df.write.mode("overwrite").parquet(args.out)
        else:
            df.show(args.show, truncate=False)
        return 0
    from .plans.daily import run_daily_batch
    if not args.out:
        raise SystemExit("daily needs --out (a shared folder for the run artifacts)")
    report, run = run_daily_batch(spark, src, args.out, feature_table=args.feature_table,
                                  shap_rows=args.shap_rows, tables=args.catalog)
    report.orderBy("test_id").show(truncate=False)
    run.leaderboard.orderBy("train_order").show(truncate=False)
    print(f"champion: {run.champion}; artifacts under {args.out}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
