"""Command line: run the pipeline steps.

    python -m starwright build  SRC OUT --calendar 2005-01-01 2017-01-01 [--orders] [--keys DIR]
    python -m starwright check  OUT
    python -m starwright export OUT CSV_ROOT
    python -m starwright dashboard OUT --calendar-start 2005-01-01 --range 2005-05-01 2006-02-28 [--stores 1 2]

``SRC`` holds rental-shaped Parquet tables (actor, film, rental, ...), or
with ``--orders`` the order tables (customer, orders, lineitem, ...) that
the order adapter maps.  The master and the checkpoint folder come from
the Spark configuration (spark-submit / spark-defaults).
"""

from __future__ import annotations

import argparse
import os

from starwright.schemas import WAREHOUSE


def _warehouse(spark, out):
    from starwright.plans.warehouse import Warehouse
    wh = Warehouse(spark, out)
    for name in WAREHOUSE:
        path = wh.path(name)
        if "://" in path or os.path.exists(path):
            wh.paths[name] = path
    return wh


def main(argv: list[str] | None = None, spark=None) -> int:
    p = argparse.ArgumentParser(prog="starwright")
    sub = p.add_subparsers(dest="cmd", required=True)
    b = sub.add_parser("build")
    b.add_argument("src")
    b.add_argument("out")
    b.add_argument("--calendar", nargs=2, required=True)
    b.add_argument("--orders", action="store_true")
    b.add_argument("--keys", help="folder of the surrogate keys that later builds keep")
    c = sub.add_parser("check")
    c.add_argument("out")
    e = sub.add_parser("export")
    e.add_argument("out")
    e.add_argument("csv_root")
    d = sub.add_parser("dashboard")
    d.add_argument("out")
    d.add_argument("--calendar-start", required=True)
    d.add_argument("--range", nargs=2, required=True)
    d.add_argument("--stores", nargs="*", type=int, default=[])
    args = p.parse_args(argv)

    if spark is None:
        from starwright.session import get_session
        spark = get_session()

    if args.cmd == "build":
        from starwright.operators.stable_keys import KeyStore
        from starwright.plans.warehouse import build_warehouse
        from starwright.sources.tables import TableSource
        tables = TableSource(spark, args.src)
        keys = KeyStore(spark, args.keys) if args.keys else None
        if args.orders:
            from starwright.sources.order_adapter import CATEGORY_LABELS, PART_FEATURES, OrderAdapter
            wh = build_warehouse(spark, OrderAdapter(tables), args.out, tuple(args.calendar), CATEGORY_LABELS,
                                 PART_FEATURES, store_from_staff=True,
                                 carry=("inventory_film_id", "inventory_staff_id"), keys=keys)
        else:
            from starwright.sources.rental_tables import RentalTables
            wh = build_warehouse(spark, RentalTables(tables), args.out, tuple(args.calendar), keys=keys)
        for name in sorted(wh.paths):
            print(f"{name}\t{wh.paths[name]}")
    elif args.cmd == "check":
        from starwright.plans.warehouse import check_warehouse
        check_warehouse(_warehouse(spark, args.out)).show(200, truncate=False)
    elif args.cmd == "export":
        from starwright.plans.migration import export_warehouse
        for name, path in sorted(export_warehouse(_warehouse(spark, args.out), args.csv_root).items()):
            print(f"{name}\t{path}")
    elif args.cmd == "dashboard":
        from starwright.plans.marts import SECTIONS, dashboard
        wh = _warehouse(spark, args.out)
        out = dashboard(wh.stored("fact_rental"), wh.read("dim_customer"), wh.read("dim_store"),
                        wh.read("dim_film"), args.calendar_start, args.range[0], args.range[1],
                        store_ids=args.stores, sections=SECTIONS)
        for name, df in out.items():
            print(f"== {name}")
            df.show(50, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
