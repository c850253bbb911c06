"""Command line over the Spark API."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence
from dataclasses import asdict
from datetime import date, datetime

from tidewell import config
from tidewell.session import get_session

INGEST = {"ingest_income_statement": "income_statement", "ingest_cash_flow": "cash_flow", "ingest_balance_sheet": "balance_sheet"}


def parse_args(argv: Sequence[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="tidewell", description="Equity research on Spark.")
    p.add_argument("symbol", nargs="?", help="ticker to look up or ingest")
    p.add_argument("--endpoint", choices=config.ENDPOINTS)
    p.add_argument("--provider", choices=config.PROVIDERS)
    p.add_argument("--sql", help="query for --endpoint duckdb, run by Spark over the table store")
    p.add_argument("--duckdb-database", help="root folder of the table store; ':memory:' has no tables")
    p.add_argument("--alphavantage-api-key")
    for kind, path in (("sp500", "data/sp500_constituents.json"), ("ftse250", "data/ftse250_constituents.json"), ("nikkei225", "data/nikkei225_components.json")):
        p.add_argument(f"--refresh-{kind}", action="store_true")
        p.add_argument(f"--{kind}-output", default=path)
    for name in INGEST:
        p.add_argument(f"--{name.replace('_', '-')}", action="store_true")
    p.add_argument("--migrate-sp500-fundamentals", action="store_true")
    p.add_argument("--migration-status", action="store_true")
    p.add_argument("--sp500-input", default="data/sp500_constituents.json")
    p.add_argument("--migration-datasets", default="income_statement,cash_flow,balance_sheet")
    p.add_argument("--max-requests", type=int, default=5)
    p.add_argument("--retry-delay-minutes", type=int, default=30)
    p.add_argument("--quota-retry-minutes", type=int, default=1440)
    return p.parse_args(argv)


def _iso(value: object) -> str:
    return value.isoformat() if isinstance(value, (date, datetime)) else str(value)


def _print(value: object) -> int:
    print(json.dumps(value, indent=2, default=_iso))
    return 0


def _fail(message: object, code: int) -> int:
    print(message, file=sys.stderr)
    return code


def main(argv: Sequence[str] | None = None) -> int:
    """Exit codes: 0 done, 1 failed at work, 2 wrong use."""
    args = parse_args(argv)
    config.load_env_file()
    try:
        settings = config.build_settings(args.endpoint, args.provider, args.duckdb_database, args.sql)
    except RuntimeError as e:
        return _fail(e, 1)
    root = None if settings.database == ":memory:" else settings.database
    from tidewell.plans import jobs
    from tidewell.sources import payloads, rest, snapshots, store

    try:
        for kind in ("nikkei225", "ftse250", "sp500"):
            if getattr(args, f"refresh_{kind}"):
                return _print(asdict(snapshots.ensure_snapshot(get_session(), kind, getattr(args, f"{kind}_output"))))
        for name, dataset in INGEST.items():
            if getattr(args, name):
                if not args.symbol:
                    return _fail("a symbol is required", 2)
                if root is None:
                    return _fail("--duckdb-database must be a folder", 2)
                spark = get_session()
                rows = rest.load_statements(spark, args.symbol, dataset, config.api_key(args.alphavantage_api_key))
                return _print({"symbol": args.symbol.upper(), "database": settings.database, "rows_written": store.TableStore(spark, root).upsert(payloads.TABLE_OF[dataset], rows)})
        if args.migrate_sp500_fundamentals or args.migration_status:
            if root is None:
                return _fail("--duckdb-database must be a folder", 2)
            spark = get_session()
            tables = store.TableStore(spark, root)
            if args.migration_status:
                return _print(jobs.migration_status(tables))
            from pyspark.sql import functions as F

            from tidewell.functions.scalars import normalise_symbol

            names = snapshots.read_snapshot(spark, args.sp500_input, "sp500").select(normalise_symbol(F.col("symbol")).alias("symbol"))
            symbols = [r.symbol for r in names.where("symbol is not null").distinct().orderBy("symbol").collect()]
            key = config.api_key(args.alphavantage_api_key)
            loaders = {d: (lambda s, d=d: rest.load_statements(spark, s, d, key)) for d in jobs.DATASETS}
            summary = jobs.migrate(
                tables, symbols, jobs.parse_datasets(args.migration_datasets), loaders, payloads.TABLE_OF, max_requests=args.max_requests, retry_delay_minutes=args.retry_delay_minutes, quota_retry_minutes=args.quota_retry_minutes, source=args.sp500_input,
            )
            return _print(summary.as_dict())
        if settings.endpoint == "duckdb":
            if not settings.sql:
                return _fail("--sql is required with --endpoint duckdb", 2)
            return _print(store.run_query(get_session(), settings.sql, root))
        if not args.symbol:
            return _fail("a symbol is required", 2)
        if settings.provider == "yfinance":
            return _print(rest.fetch_yfinance_info(args.symbol))
        return _print(rest.fetch_overview(args.symbol, config.api_key(args.alphavantage_api_key)))
    except Exception as e:  # noqa: BLE001 - reported to the user with exit code 1
        return _fail(e, 1)


if __name__ == "__main__":
    sys.exit(main())
