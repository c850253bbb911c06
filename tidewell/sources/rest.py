"""REST providers as a Spark data source, read whole or as a stream that resumes: one partition per request, pluggable transport."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from urllib.error import HTTPError, URLError
from urllib.parse import urlencode
from urllib.request import urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from tidewell.functions.scalars import scalar_text
from tidewell.sources import payloads
from tidewell.sources.store import TableStore

BASE = "https://www.alphavantage.co/query"
FUNCTIONS = {"overview": "OVERVIEW", "income_statement": "INCOME_STATEMENT", "cash_flow": "CASH_FLOW", "balance_sheet": "BALANCE_SHEET"}


def is_rate_limit(error: BaseException) -> bool:
    return isinstance(error, HTTPError) and error.code == 429 or getattr(getattr(error, "response", None), "status_code", None) == 429


def api_base() -> str:
    return os.environ.get("TIDEWELL_API_BASE") or BASE


def fetch_json(function: str, symbol: str, api_key: str, base: str | None = None, opener: Callable = urlopen) -> dict:
    """One payload; RuntimeError for HTTP failures, rate limits and roots that aren't objects."""
    url = f"{base or api_base()}?{urlencode({'function': function, 'symbol': symbol, 'apikey': api_key})}"
    try:
        with opener(url, timeout=30) as response:
            payload = json.loads(response.read().decode("utf-8"))
    except (HTTPError, URLError) as e:
        raise RuntimeError(f"rate limited for {symbol}" if is_rate_limit(e) else f"request failed for {symbol}: {e}") from e
    if not isinstance(payload, dict):
        raise RuntimeError(f"unexpected payload for {symbol}")
    return payload


class _Request(InputPartition):
    def __init__(self, symbol: str, dataset: str) -> None:
        self.symbol, self.dataset = symbol, dataset


def _listed(options: dict, name: str) -> list[str]:
    return [x.strip() for x in options.get(name, "").split(",") if x.strip()]


def _requests(options: dict) -> list[_Request]:
    """Every symbol with every dataset, by symbol, so that symbols added at the end change no earlier place."""
    datasets = _listed(options, "datasets") or ["overview"]
    wrong = [d for d in datasets if d not in FUNCTIONS]
    if wrong:
        raise ValueError(f"Unsupported datasets: {', '.join(wrong)}")
    return [_Request(s, d) for s in _listed(options, "symbols") for d in datasets]


def _fetched(options: dict, request: _Request) -> dict:
    return fetch_json(FUNCTIONS[request.dataset], request.symbol, options.get("apikey", ""), options.get("base", BASE))


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return _requests(self.options)

    def read(self, partition: _Request | None) -> Iterator[tuple]:
        if partition is not None:  # Spark's only partition where there are no requests
            yield partition.symbol, partition.dataset, json.dumps(_fetched(self.options, partition))


class _StreamReader(DataSourceStreamReader):
    """Offsets are places in the list of requests. A started query learns its place from the last batch planned before it."""

    def __init__(self, options: dict) -> None:
        self.options = options
        self.requests = _requests(options)
        self.most = int(options.get("requestspertrigger", "5"))
        if self.most <= 0:
            raise ValueError("requestsPerTrigger must be positive")
        self.at = 0

    def initialOffset(self) -> dict:  # noqa: N802 - Spark's names
        return {"next": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"next": max(self.at, min(self.at + self.most, len(self.requests)))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if end["next"] < start["next"]:
            raise RuntimeError(f"request offsets went back from {start['next']} to {end['next']}")
        self.at = end["next"]
        return self.requests[start["next"] : end["next"]]

    def read(self, partition: _Request) -> Iterator[tuple]:
        yield partition.symbol, partition.dataset, json.dumps(payloads.check_payload(_fetched(self.options, partition)))


class RestSource(DataSource):
    """``spark.read`` or ``spark.readStream.format("tidewell-rest")``: rows ``(symbol, dataset, payload)``.

    Options: symbols and datasets (comma-separated), apikey, base, and for a stream
    requestsPerTrigger. Batches of a stream hold at most so many requests; a quota note
    or error ends the query, and one started again on its checkpoint repeats only the
    batch that was not committed.
    """

    @classmethod
    def name(cls) -> str:
        return "tidewell-rest"

    def schema(self) -> str:
        return "symbol string, dataset string, payload string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: ANN001, N802
        return _StreamReader({k.lower(): v for k, v in self.options.items()})


def _options(symbols: list[str], datasets: list[str], api_key: str, base: str | None) -> dict[str, str]:
    return {"symbols": ",".join(symbols), "datasets": ",".join(datasets), "apikey": api_key, "base": base or api_base()}


def read_payloads(spark: SparkSession, symbols: list[str], dataset: str, api_key: str, base: str | None = None) -> DataFrame:
    spark.dataSource.register(RestSource)
    return spark.read.format("tidewell-rest").options(**_options(symbols, [dataset], api_key, base)).load()


def stream_payloads(spark: SparkSession, symbols: list[str], datasets: list[str], api_key: str, base: str | None = None, *, per_trigger: int = 5) -> DataFrame:
    """A stream of ``(symbol, dataset, payload)``, at most ``per_trigger`` requests a batch; see ``RestSource``."""
    spark.dataSource.register(RestSource)
    return spark.readStream.format("tidewell-rest").options(**_options(symbols, datasets, api_key, base), requestsPerTrigger=str(per_trigger)).load()


def store_statements(stream: DataFrame, tables: TableStore, checkpoint: str, *, every: str = "1 minute") -> StreamingQuery:
    """Upsert the statements of ``stream_payloads`` batch by batch, one each ``every``. Repeating a batch changes nothing but its load time."""

    def store(batch: DataFrame, _: int) -> None:
        batch = batch.persist()  # the requests are made once
        try:
            for dataset in sorted(r.dataset for r in batch.select("dataset").distinct().collect()):
                if dataset in payloads.TABLE_OF:
                    rows = payloads.statement_rows(batch.where(F.col("dataset") == dataset), dataset, "payload", F.lit("alphavantage"), F.current_timestamp())
                    tables.upsert(payloads.TABLE_OF[dataset], rows)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def load_statements(spark: SparkSession, symbol: str, dataset: str, api_key: str, fetch: Callable[..., dict] = fetch_json) -> DataFrame:
    """Statement rows of one symbol; RuntimeError for quota notes, errors and empty payloads."""
    payload = payloads.check_payload(fetch(FUNCTIONS[dataset], symbol, api_key))
    raw = spark.createDataFrame([(json.dumps(payload),)], "payload string")
    rows = payloads.statement_rows(raw, dataset, "payload", F.lit("alphavantage"), F.current_timestamp())
    if not payload.get("symbol") or rows.isEmpty():
        raise RuntimeError(f"No {dataset} rows for {symbol}")
    return rows


def fetch_overview(symbol: str, api_key: str, fetch: Callable[..., dict] = fetch_json) -> dict:
    return {k: scalar_text(v) for k, v in fetch(FUNCTIONS["overview"], symbol, api_key).items()}


def _yfinance():  # noqa: ANN202 - an optional module
    try:
        import yfinance
    except ImportError as e:
        raise RuntimeError("yfinance is not installed") from e
    return yfinance


def configure_yfinance_cache(folder: str) -> None:
    _yfinance().set_tz_cache_location(folder)


def fetch_yfinance_info(symbol: str) -> dict:
    try:
        return {k: scalar_text(v) for k, v in dict(_yfinance().Ticker(symbol).info).items()}
    except RuntimeError:
        raise
    except Exception as e:  # the library has no error type of its own
        raise RuntimeError("rate limited" if is_rate_limit(e) else f"lookup failed for {symbol}: {e}") from e


def fetch_yfinance_history(spark: SparkSession, symbol: str, period: str = "max") -> DataFrame:
    """Unadjusted daily prices in the shape of ``prices``."""
    frame = _yfinance().Ticker(symbol).history(period=period, auto_adjust=False).reset_index()
    frame.columns = [str(c).lower().replace(" ", "_") for c in frame.columns]
    rows = spark.createDataFrame(frame[["date", "open", "high", "low", "close", "volume"]])
    return rows.select(F.lit(symbol).alias("asset_id"), F.col("date").cast("date"), "open", "high", "low", "close", F.col("volume").cast("bigint"), F.lit("yfinance").alias("source"), F.current_timestamp().cast("timestamp_ntz").alias("ingestion_ts"))
