"""Table schemas, fixed in one place, and the guards that frames are checked with."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Measures of each statement table, all BIGINT.
STATEMENT_MEASURES: dict[str, tuple[str, ...]] = {
    "income_statements": ("total_revenue", "gross_profit", "operating_income", "net_income", "ebit", "ebitda"),
    "cash_flow_statements": ("operating_cashflow", "cashflow_from_investment", "cashflow_from_financing", "net_income", "capital_expenditures", "free_cash_flow"),
    "balance_sheets": ("total_assets", "total_liabilities", "total_shareholder_equity", "cash_and_short_term_investments", "current_debt", "long_term_debt"),
}
STATEMENT_KEY = ("symbol", "period_type", "fiscal_date_ending")
JOB_KEY = ("symbol", "dataset")
PRICE_KEY = ("asset_id", "date")
JOB_STATUSES = ("pending", "retry", "success")


def _statement(measures: Iterable[str]) -> T.StructType:
    schema = T.StructType().add("symbol", T.StringType()).add("period_type", T.StringType()).add("fiscal_date_ending", T.DateType()).add("reported_currency", T.StringType())
    for name in measures:
        schema = schema.add(name, T.LongType())
    return schema.add("source", T.StringType()).add("ingestion_ts", T.TimestampNTZType()).add("raw_payload_json", T.StringType())


PRICES = T.StructType(
    [T.StructField("asset_id", T.StringType()), T.StructField("date", T.DateType())]
    + [T.StructField(x, T.DoubleType()) for x in ("open", "high", "low", "close")]
    + [T.StructField("volume", T.LongType()), T.StructField("source", T.StringType()), T.StructField("ingestion_ts", T.TimestampNTZType())]
)
JOBS = T.StructType(
    [T.StructField(x, T.StringType()) for x in ("symbol", "dataset", "status")]
    + [T.StructField(x, T.LongType()) for x in ("attempts", "rows_written")]
    + [T.StructField("last_error", T.StringType())]
    + [T.StructField(x, T.TimestampNTZType()) for x in ("last_attempt_ts", "next_retry_ts", "created_ts", "updated_ts")]
)
TABLES: dict[str, tuple[T.StructType, tuple[str, ...]]] = {
    **{name: (_statement(measures), STATEMENT_KEY) for name, measures in STATEMENT_MEASURES.items()},
    "fundamental_migration_progress": (JOBS, JOB_KEY),
    "prices": (PRICES, PRICE_KEY),
}


def require_columns(df: DataFrame, *names: str) -> None:
    """Raise ValueError naming the columns that ``df`` lacks."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {', '.join(missing)}")
