"""Company statements from API payloads to typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.scalars import ascii_json, to_date, to_int

#: Fixed names: our column to the API's field; a column without one is derived.
FIELDS: dict[str, dict[str, str | None]] = {
    "income_statement": {"total_revenue": "totalRevenue", "gross_profit": "grossProfit", "operating_income": "operatingIncome", "net_income": "netIncome", "ebit": "ebit", "ebitda": "ebitda"},
    "cash_flow": {
        "operating_cashflow": "operatingCashflow", "cashflow_from_investment": "cashflowFromInvestment", "cashflow_from_financing": "cashflowFromFinancing",
        "net_income": "netIncome", "capital_expenditures": "capitalExpenditures", "free_cash_flow": None,
    },
    "balance_sheet": {
        "total_assets": "totalAssets", "total_liabilities": "totalLiabilities", "total_shareholder_equity": "totalShareholderEquity",
        "cash_and_short_term_investments": "cashAndShortTermInvestments", "current_debt": "currentDebt", "long_term_debt": "longTermDebt",
    },
}
TABLE_OF = {"income_statement": "income_statements", "cash_flow": "cash_flow_statements", "balance_sheet": "balance_sheets"}


def payload_status(payload: Column) -> Column:
    """quota, error or ok."""
    note = F.concat_ws(" ", F.get_json_object(payload, "$.Note"), F.get_json_object(payload, "$.Information"))
    return F.when(F.lower(note).contains("api call frequency"), "quota").when(F.get_json_object(payload, "$['Error Message']").isNotNull(), "error").otherwise("ok")


def statement_rows(raw: DataFrame, kind: str, payload_col: str, source: Column, ingestion_ts: Column) -> DataFrame:
    """Typed rows of ``kind`` from JSON payloads: annual, then quarterly reports.

    A payload is parsed once, as a VARIANT, and fields are read from that. Report lists
    that aren't lists, reports that aren't objects or lack a fiscal date are left out.
    An error (when run) for a payload without symbol.
    """
    base = raw.select(F.try_parse_json(payload_col).alias("payload"))
    symbol = F.try_variant_get("payload", "$.symbol", "string")
    base = base.select("payload", F.when(F.length(symbol) > 0, symbol).otherwise(F.raise_error(F.lit("payload without symbol")).cast("string")).alias("symbol"))
    lists = [F.struct(F.lit(period).alias("period_type"), F.try_variant_get("payload", f"$.{period}Reports", "array<variant>").alias("reports")) for period in ("annual", "quarterly")]
    both = base.select("symbol", F.inline(F.array(*lists))).select("symbol", "period_type", F.explode("reports").alias("report"))

    def field(name: str) -> Column:
        return F.try_variant_get("report", f"$.{name}", "string")

    measures = {ours: to_int(field(api)) for ours, api in FIELDS[kind].items() if api}
    if kind == "cash_flow":
        measures["free_cash_flow"] = free_cash_flow(measures["operating_cashflow"], measures["capital_expenditures"])
    dated = both.where(F.schema_of_variant("report").startswith("OBJECT") & (F.length(field("fiscalDateEnding")) > 0))
    return dated.select(
        "symbol", "period_type", to_date(field("fiscalDateEnding")).alias("fiscal_date_ending"), field("reportedCurrency").alias("reported_currency"), *(measures[c].alias(c) for c in FIELDS[kind]),
        source.alias("source"), ingestion_ts.cast("timestamp_ntz").alias("ingestion_ts"), ascii_json(F.to_json("report")).alias("raw_payload_json"),
    )


def free_cash_flow(operating: Column, capital: Column) -> Column:
    """Operating cash flow less capital expenditures; NULL if either is."""
    return operating - capital


def check_payload(payload: dict) -> dict:
    """The payload, or RuntimeError for a quota note or an error message."""
    for key in ("Note", "Information"):
        if "api call frequency" in str(payload.get(key) or "").lower():
            raise RuntimeError(f"API quota reached: {payload[key]}")
    if payload.get("Error Message"):
        raise RuntimeError(f"API error: {payload['Error Message']}")
    return payload
