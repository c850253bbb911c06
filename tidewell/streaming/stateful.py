"""Wilder's RSI and its long-or-flat position on a price stream, with state by series.

Rows may come late and out of order. They wait in state until the watermark has passed
them and are then taken in order of time, so what comes out equals the batch result over
the rows that came in time, however the stream was cut into batches, replayed or
restarted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewell.schemas import require_columns

OUTPUT = "asset_id string, ts timestamp, close double, rsi double, signal string, position int, entry boolean"
_BARS = "n bigint, last double, up double, down double, effective int, position int"


class Bars:
    """The running figures of one series; ``step`` takes the next bar."""

    def __init__(self, state: tuple | None, period: int, oversold: float, overbought: float) -> None:
        self.n, self.last, self.up, self.down, self.effective, self.position = state or (0, 0.0, 0.0, 0.0, -1, 0)
        self.period, self.oversold, self.overbought = period, oversold, overbought

    def state(self) -> tuple:
        return self.n, self.last, self.up, self.down, self.effective, self.position

    def step(self, close: float) -> tuple[float | None, str, int, bool]:
        """RSI, signal, position and entry of the bar; the position is what the bars before it called for."""
        gain, loss = (max(close - self.last, 0.0), max(self.last - close, 0.0)) if self.n else (0.0, 0.0)
        if self.n <= self.period:
            self.up, self.down = self.up + gain / self.period, self.down + loss / self.period
        else:
            self.up, self.down = (self.up * (self.period - 1) + gain) / self.period, (self.down * (self.period - 1) + loss) / self.period
        rsi = None if self.n < self.period else 100.0 if self.down == 0 else 100.0 - 100.0 / (1.0 + self.up / self.down)
        signal = "hold" if rsi is None else "buy" if rsi <= self.oversold else "sell" if rsi >= self.overbought else "hold"
        held = max(self.effective, 0)
        entry = held == 1 and self.position == 0
        self.position = held
        self.effective = {"buy": 1, "sell": 0}.get(signal, self.effective)
        self.n, self.last = self.n + 1, close
        return rsi, signal, held, entry


class RsiProcessor(StatefulProcessor):
    """Rows in wait as list state, running figures as value state, a timer for the latest row of each batch."""

    def __init__(self, period: int, oversold: float, overbought: float) -> None:
        self.options = (period, oversold, overbought)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bars = handle.getValueState("bars", _BARS)
        self.waiting = handle.getListState("waiting", "ts timestamp, close double")

    def _taken(self, key: tuple, watermark: int, fresh: list[tuple] = []) -> Iterator[pd.DataFrame]:  # noqa: B006 - not changed
        rows = sorted([*self.waiting.get(), *fresh]) if self.waiting.exists() else sorted(fresh)
        due = [r for r in rows if pd.Timestamp(r[0]).timestamp() * 1000 <= watermark]
        left = rows[len(due) :]
        if left:
            self.waiting.put(left)
        else:
            self.waiting.clear()
        if not due:
            return
        bars = Bars(self.bars.get() if self.bars.exists() else None, *self.options)
        out = [(key[0], ts, close, *bars.step(close)) for ts, close in due]
        self.bars.update(bars.state())
        yield pd.DataFrame(out, columns=["asset_id", "ts", "close", "rsi", "signal", "position", "entry"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - Spark's names
        fresh = [(ts.to_pydatetime(), float(close)) for part in rows for ts, close in zip(part["ts"], part["close"])]
        if fresh:
            self.handle.registerTimer(int(max(pd.Timestamp(ts).timestamp() for ts, _ in fresh) * 1000) + 1)
        yield from self._taken(key, timerValues.getCurrentWatermarkInMs(), fresh)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._taken(key, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def rsi_stream(prices: DataFrame, *, lateness: str = "1 hour", period: int = 14, oversold: float = 30.0, overbought: float = 70.0) -> DataFrame:
    """``OUTPUT`` rows of a stream ``(asset_id, ts, close)``, each once the watermark has passed it.

    Rows without a time or a close are left out; so are rows that come later than
    ``lateness`` allows. Rows of one time are taken in order of their close. Needs the
    RocksDB state store: see ``rocksdb``.
    """
    require_columns(prices, "asset_id", "ts", "close")
    rows = prices.select("asset_id", "ts", "close").where("ts is not null and close is not null").withWatermark("ts", lateness)
    return rows.groupBy("asset_id").transformWithStateInPandas(RsiProcessor(period, oversold, overbought), OUTPUT, "Append", "EventTime")


ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
