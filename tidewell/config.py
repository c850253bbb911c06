"""Settings: argument, then environment, then default."""

from __future__ import annotations

import os
from dataclasses import dataclass
from pathlib import Path

ENDPOINTS, PROVIDERS = ("api", "duckdb"), ("alphavantage", "yfinance")


def load_env_file(path: str | Path = ".env") -> None:
    """``key=value`` lines into the environment; what is set already stays."""
    path = Path(path)
    for line in path.read_text(encoding="utf-8").splitlines() if path.exists() else ():
        key, found, value = line.partition("=")
        if found and not line.lstrip().startswith("#"):
            os.environ.setdefault(key.strip(), value.strip().strip("\"'"))


@dataclass(frozen=True)
class Settings:
    endpoint: str
    provider: str
    database: str
    sql: str | None = None


def _one_of(name: str, value: str, allowed: tuple[str, ...]) -> str:
    if value not in allowed:
        raise RuntimeError(f"{name} must be one of {', '.join(allowed)}")
    return value


def build_settings(endpoint: str | None = None, provider: str | None = None, database: str | None = None, sql: str | None = None) -> Settings:
    env = os.environ.get
    return Settings(
        _one_of("endpoint", endpoint or env("TIDEWELL_ENDPOINT") or "api", ENDPOINTS),
        _one_of("provider", provider or env("TIDEWELL_PROVIDER") or "alphavantage", PROVIDERS),
        database or env("TIDEWELL_DATABASE") or ":memory:",
        sql or env("TIDEWELL_SQL"),
    )


def api_key(given: str | None = None) -> str:
    key = given or os.environ.get("ALPHAVANTAGE_API_KEY")
    if not key:
        raise RuntimeError("ALPHAVANTAGE_API_KEY is not set")
    return key
