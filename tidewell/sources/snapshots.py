"""JSON snapshots of index constituents, refreshed once a UTC day."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime
from pathlib import Path
from urllib.error import URLError
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidewell.sources.html_tables import HEADERS, parse_index

#: Fixed addresses of the public pages.
PAGES = {
    "sp500": "https://en.wikipedia.org/wiki/List_of_S%26P_500_companies",
    "ftse250": "https://en.wikipedia.org/wiki/FTSE_250_Index",
    "nikkei225": "https://indexes.nikkei.co.jp/en/nkave/index/component?idx=nk225",
}
SOURCES = {"sp500": "wikipedia", "ftse250": "wikipedia", "nikkei225": "nikkei_indexes"}
COLUMNS = {kind: list(names.values()) for kind, names in HEADERS.items()}
COLUMNS["nikkei225"] = [*COLUMNS["nikkei225"], "industry_group", "industry", "source"]


@dataclass(frozen=True)
class RefreshSummary:
    output_path: str
    refreshed: bool
    rows: int
    source: str


def fetch_page(url: str) -> str:
    with urlopen(Request(url, headers={"User-Agent": "Mozilla/5.0 (tidewell)"}), timeout=30) as response:  # noqa: S310 - fixed addresses
        return response.read().decode("utf-8")


def snapshot_schema(kind: str) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in COLUMNS[kind]])


def json_schema(kind: str) -> dict:
    """JSON Schema of a snapshot, from its columns."""
    properties: dict = {c: {"type": "string", "minLength": 1, "description": f"{c.replace('_', ' ').capitalize()} of the constituent, as its page gives it."} for c in COLUMNS[kind]}
    if kind == "nikkei225":
        properties["source"] = {"type": "string", "const": "nikkei_indexes", "description": "Where the rows come from."}
    item = {"type": "object", "properties": properties, "required": COLUMNS[kind], "additionalProperties": False}
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", "$id": f"{kind}_constituents.schema.json", "title": f"{kind} constituents", "type": "array", "items": item}


def project_path(path: str | Path) -> Path:
    """A relative path below the project's folder, wherever the program was started."""
    return Path(__file__).resolve().parents[2] / path  # an absolute one stays as it is


def read_snapshot(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(snapshot_schema(kind)).option("multiLine", True).json(path)


def write_snapshot(rows: list[dict], path: Path, kind: str) -> None:
    """One small array file (hundreds of rows) and its schema beside it."""
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(rows, indent=2) + "\n", encoding="utf-8")
    write_json_schema(path, kind)


def write_json_schema(path: Path, kind: str) -> None:
    path.with_suffix(".schema.json").write_text(json.dumps(json_schema(kind), indent=2) + "\n", encoding="utf-8")


def is_current(path: Path, today: datetime | None = None) -> bool:
    day = (today or datetime.now(UTC)).date()
    return path.exists() and datetime.fromtimestamp(path.stat().st_mtime, UTC).date() >= day


def ensure_snapshot(spark: SparkSession, kind: str, path: str | Path, fetch: Callable[[str], str] = fetch_page) -> RefreshSummary:
    """Today's snapshot: kept if present, with its schema written again, else fetched and parsed. RuntimeError if it can't be fetched."""
    path = project_path(path)
    if is_current(path):
        write_json_schema(path, kind)
        return RefreshSummary(str(path), False, len(json.loads(path.read_text(encoding="utf-8"))), "cache")
    try:
        page = fetch(PAGES[kind])
    except URLError as e:
        raise RuntimeError(f"Could not fetch {kind}: {e}") from e
    rows = parse_index(spark, page, kind)
    write_snapshot(rows, path, kind)
    return RefreshSummary(str(path), True, len(rows), SOURCES[kind])
