"""The resumable migration queue as DataFrame expressions, and its driver."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.schemas import JOB_KEY, JOB_STATUSES, JOBS, STATEMENT_MEASURES
from tidewell.sources.store import TableStore, union_all

DATASETS = ("income_statement", "cash_flow", "balance_sheet")
EPOCH = "timestamp_ntz '1970-01-01 00:00:00'"


def seed_rows(symbols: DataFrame, datasets: DataFrame) -> DataFrame:
    """Every symbol with every dataset, once."""
    return symbols.where("symbol is not null").distinct().crossJoin(F.broadcast(datasets.distinct()) if _few(datasets) else datasets.distinct())


def _few(df: DataFrame, most: int = 1000) -> bool:
    return df.limit(most + 1).count() <= most


def due_jobs(jobs: DataFrame, now: Column, limit: int) -> DataFrame:
    """The next jobs that are not done and whose retry time has come."""
    due = jobs.where((F.col("status") != "success") & (F.col("next_retry_ts").isNull() | (F.col("next_retry_ts") <= now)))
    return due.orderBy(F.coalesce("next_retry_ts", F.expr(EPOCH)), "attempts", "symbol", "dataset").limit(limit).select("symbol", "dataset", "attempts")


def recent_failures(jobs: DataFrame, limit: int = 10) -> DataFrame:
    """The jobs in retry that were tried last, times as text; ties by symbol and dataset."""
    if limit <= 0:
        raise RuntimeError("failure_limit must be positive")
    failed = jobs.where("status = 'retry'")
    return failed.orderBy(F.coalesce("last_attempt_ts", F.expr(EPOCH)).desc(), "symbol", "dataset").limit(limit).select("symbol", "dataset", "attempts", F.coalesce("last_error", F.lit("")).alias("last_error"), *(F.col(c).cast("string").alias(c) for c in ("last_attempt_ts", "next_retry_ts")))


def status_counts(jobs: DataFrame) -> DataFrame:
    """Jobs by status, zero for a status that none has."""
    spark = jobs.sparkSession
    return spark.createDataFrame([(s,) for s in JOB_STATUSES], "status string").join(jobs.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("jobs"))


def next_retry(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.min(F.when(F.col("status") == "retry", F.col("next_retry_ts"))).cast("string").alias("next_retry"))


def status_rollup(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "success").alias("completed"), F.count_if(F.col("status").isin("pending", "retry")).alias("pending"), F.count_if(F.col("status") == "retry").alias("retrying"))


def apply_outcomes(jobs: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """Jobs after ``outcomes(symbol, dataset, rows, error, retry_ts)``: success without an error, else retry."""
    new = outcomes.withColumnsRenamed({"rows": "_rows", "error": "_error", "retry_ts": "_retry"}).withColumn("_met", F.lit(True))
    met, ok = F.col("_met").isNotNull(), F.col("_error").isNull()
    joined = jobs.join(new, list(JOB_KEY), "left")
    changed = {
        "status": F.when(met, F.when(ok, "success").otherwise("retry")).otherwise(F.col("status")),
        "attempts": F.col("attempts") + F.when(met, 1).otherwise(0),
        "rows_written": F.when(met & ok, F.col("_rows")).otherwise(F.col("rows_written")),
        "last_error": F.when(met, F.col("_error")).otherwise(F.col("last_error")),
        "next_retry_ts": F.when(met, F.when(~ok, F.col("_retry"))).otherwise(F.col("next_retry_ts")),
        "last_attempt_ts": F.when(met, now).otherwise(F.col("last_attempt_ts")),
    }
    if "updated_ts" in jobs.columns:
        changed["updated_ts"] = F.when(met, now).otherwise(F.col("updated_ts"))
    return joined.withColumns(changed).select(*jobs.columns)


def parse_datasets(text: str | Sequence[str]) -> list[str]:
    """Dataset names in order, once each; RuntimeError for unknown ones."""
    names = [p.strip().lower() for p in (text.split(",") if isinstance(text, str) else text)]
    names = list(dict.fromkeys(n for n in names if n))
    wrong = [n for n in names if n not in DATASETS]
    if wrong or not names:
        raise RuntimeError(f"Unsupported datasets: {', '.join(wrong) or 'none given'}")
    return names


@dataclass(frozen=True)
class MigrationSummary:
    """What a run did and what is left, as the command line prints it."""

    database: str
    sp500_source: str
    dataset_count: int
    symbol_count: int
    seeded_jobs: int
    due_jobs: int
    processed_requests: int
    success_jobs: int
    retry_jobs: int
    quota_hit: bool
    pending_jobs: int
    completed_jobs: int
    next_retry_ts: str | None

    def as_dict(self) -> dict:
        return asdict(self)


def utc_now() -> datetime:
    return datetime.now(UTC).replace(tzinfo=None)


def is_quota_message(message: str) -> bool:
    text = message.lower()
    return any(x in text for x in ("quota reached", "rate limited", "api call frequency"))


def migrate(
    store: TableStore, symbols: Sequence[str], datasets: Sequence[str], loaders: Mapping[str, Callable[[str], DataFrame]], tables: Mapping[str, str], *, max_requests: int = 5, retry_delay_minutes: int = 30,
    quota_retry_minutes: int = 1440, source: str = "", now: Callable[[], datetime] = utc_now,
) -> MigrationSummary:
    """Work off due jobs: load, upsert, note the outcome; stop at the first quota error.

    ``loaders[dataset](symbol)`` gives statement rows or raises RuntimeError; other
    errors end the run, but what was loaded before stays. A run's rows are upserted
    once for each table, and its outcomes are then written to the queue at once.
    """
    if max_requests <= 0 or retry_delay_minutes <= 0 or quota_retry_minutes <= 0:
        raise RuntimeError("max_requests, retry_delay_minutes and quota_retry_minutes must be positive")
    spark: SparkSession = store.spark
    names, at, symbols = parse_datasets(datasets), now(), sorted(set(symbols))
    if not symbols:
        raise RuntimeError(f"No symbols found in {source or 'the list given'}")
    rows = [(s, d, "pending", 0, 0, None, None, None, at, at) for s in symbols for d in names]
    seeded = store.insert_ignore("fundamental_migration_progress", spark.createDataFrame(rows, JOBS))
    queue = store.read("fundamental_migration_progress")
    due = due_jobs(queue, F.lit(at), max_requests).collect()  # at most max_requests rows
    outcomes, quota = [], False
    loaded: dict[str, list[DataFrame]] = {}
    try:
        for job in due:
            try:
                found = loaders[job.dataset](job.symbol).persist()  # counted and upserted, but made once
                outcomes.append((job.symbol, job.dataset, found.count(), None, None))
                loaded.setdefault(tables[job.dataset], []).append(found)
            except RuntimeError as e:
                quota = is_quota_message(str(e))
                delay = quota_retry_minutes if quota else retry_delay_minutes * 2 ** min(job.attempts, 4)
                outcomes.append((job.symbol, job.dataset, 0, str(e), now() + timedelta(minutes=delay)))
                if quota:
                    break
    finally:
        for name, frames in loaded.items():
            store.upsert(name, union_all(frames))
            for frame in frames:
                frame.unpersist()
        if outcomes:
            made = spark.createDataFrame(outcomes, "symbol string, dataset string, rows bigint, error string, retry_ts timestamp_ntz")
            store.update("fundamental_migration_progress", made, lambda jobs: apply_outcomes(jobs, made, F.lit(now())))
    after = store.read("fundamental_migration_progress")
    total = status_rollup(after).first()
    good = sum(o[3] is None for o in outcomes)
    return MigrationSummary(
        store.root, source, len(names), len(symbols), seeded, len(due), len(outcomes), good, len(outcomes) - good, quota, total.pending, total.completed, next_retry(after).first()[0]
    )


def table_counts(tables: Mapping[str, DataFrame]) -> dict[str, int]:
    """Rows of each table, by one aggregate over all."""
    named = union_all([df.select(F.lit(name).alias("name")) for name, df in tables.items()])
    found = {r["name"]: r["n"] for r in named.groupBy("name").agg(F.count("*").alias("n")).collect()}
    return {name: found.get(name, 0) for name in tables}


def migration_status(store: TableStore, failure_limit: int = 10) -> dict:
    """Counts by status, next retry, recent failures and rows of each statement table."""
    jobs = store.read("fundamental_migration_progress").cache()
    failures = [r.asDict() for r in recent_failures(jobs, failure_limit).collect()]
    total = status_rollup(jobs).first()
    out = {
        "database": store.root,
        "total_jobs": total.total,
        "completed_jobs": total.completed,
        "pending_jobs": total.pending,
        "status_counts": {r.status: r.n for r in jobs.groupBy("status").agg(F.count("*").alias("n")).orderBy("status").collect()},
        "next_retry_ts": next_retry(jobs).first()[0],
        "table_counts": table_counts({name: store.read(name) for name in STATEMENT_MEASURES}),
        "recent_failures": failures,
    }
    jobs.unpersist()
    return out
