"""Store, queue, payloads, pages, snapshots, settings and command line."""

import json
from datetime import datetime, timedelta
from io import BytesIO
from urllib.error import HTTPError, URLError

import pytest
from pyspark.sql import functions as F

from tidewell import cli, config
from tidewell.functions import scalars
from tidewell.plans import jobs
from tidewell.schemas import TABLES
from tidewell.sources import html_tables, payloads, rest, snapshots, store

NOW = datetime(2024, 1, 1, 12)


def statement(symbol, n, kind="income_statement"):
    return {"symbol": symbol, "annualReports": [{"fiscalDateEnding": "2023-12-31", "reportedCurrency": "USD", **{a: str(n) for a in payloads.FIELDS[kind].values() if a}}], "quarterlyReports": []}


def rows_of(spark, payload, kind="income_statement"):
    return payloads.statement_rows(spark.createDataFrame([(json.dumps(payload),)], "p string"), kind, "p", F.lit("api"), F.lit(NOW))


def test_payload_rows(spark):
    p = {"symbol": "X", "annualReports": [{"fiscalDateEnding": "2023-12-31", "operatingCashflow": "1,200", "capitalExpenditures": "250", "netIncome": "None"}, {"netIncome": "1"}, 5], "quarterlyReports": "none"}
    (r,) = rows_of(spark, p, "cash_flow").collect()
    assert (r.free_cash_flow, r.net_income, r.operating_cashflow, r.period_type) == (950, None, 1200, "annual")
    assert list(json.loads(r.raw_payload_json)) == sorted(json.loads(r.raw_payload_json))
    assert [f.name for f in TABLES["cash_flow_statements"][0].fields] == rows_of(spark, p, "cash_flow").columns


def test_payloads_are_parsed_in_the_jvm(spark):
    odd = {"fiscalDateEnding": "2020-06-30", "b": {"z": 1, "a": [1.5, None, True]}, "a": "é 𝄞 \" \\ \n", "totalRevenue": 7, "ebit": "-", "reportedCurrency": None}
    p = {"symbol": "Y", "annualReports": {"not": "a list"}, "quarterlyReports": [odd, None, "text", [1], {"fiscalDateEnding": ""}, {"fiscalDateEnding": None}, {"fiscalDateEnding": "2020-03-31"}]}
    out = rows_of(spark, p)
    assert "Python" not in out._jdf.queryExecution().toString()
    rows = out.orderBy("fiscal_date_ending").collect()
    assert [(str(r.fiscal_date_ending), r.period_type, r.total_revenue, r.ebit, r.reported_currency) for r in rows] == [("2020-03-31", "quarterly", None, None, None), ("2020-06-30", "quarterly", 7, None, None)]
    assert rows[1].raw_payload_json == json.dumps(odd, sort_keys=True, separators=(",", ":"))
    with pytest.raises(Exception, match="payload without symbol"):
        rows_of(spark, {"annualReports": []}).collect()


def test_canonical_json(spark):
    texts = ['{"b": 1, "a": {"d": [1, 2.5, null], "c": "\u00e9"}}', " [ ] ", "not json", None, '"x"', '{"k":"' + "\U0001d11e" + '"}', "{", '{"a":1,"a":2}']
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", scalars.canonical_json(F.col("t")).alias("c")).orderBy("i").select("c").collect()]
    assert got == ['{"a":{"c":"\\u00e9","d":[1,2.5,null]},"b":1}', "[]", "not json", None, '"x"', '{"k":"\\ud834\\udd1e"}', "{", '{"a":1,"a":2}']


def test_payload_checks():
    with pytest.raises(RuntimeError, match="quota reached"):
        payloads.check_payload({"Note": "Our standard API call frequency is 5"})
    with pytest.raises(RuntimeError):
        payloads.check_payload({"Error Message": "x"})


def test_upsert_last_wins_and_versions(spark, tmp_path):
    tables = store.TableStore(spark, f"file://{tmp_path}/db")
    assert tables.upsert("income_statements", rows_of(spark, statement("A", 1)).limit(0)) == 0
    two = rows_of(spark, statement("A", 1)).union(rows_of(spark, statement("A", 2))).union(rows_of(spark, statement("B", 3)))
    assert tables.upsert("income_statements", two) == 3
    assert tables.upsert("income_statements", rows_of(spark, statement("B", 9))) == 1
    got = {r.symbol: r.net_income for r in tables.read("income_statements").collect()}
    assert got == {"A": 2, "B": 9}
    assert {r["name"] for r in store.run_query(spark, "show tables", f"file://{tmp_path}/db")} == set(TABLES)
    assert store.run_query(spark, "select count(*) as n from income_statements", f"file://{tmp_path}/db") == [{"n": 2}]
    assert store.run_query(spark, "select ? as ok", args=[1]) == [{"ok": 1}]


def migrate(spark, tables, loader, **options):
    loaders = {"income_statement": loader}
    return jobs.migrate(tables, ["A", "B", "C"], ["income_statement"], loaders, payloads.TABLE_OF, now=lambda: NOW, **options)


def test_migration_resumes(spark, tmp_path):
    tables = store.TableStore(spark, f"file://{tmp_path}/db")
    load = lambda s: rows_of(spark, statement(s, 1))
    first = migrate(spark, tables, load, max_requests=2)
    assert (first.seeded_jobs, first.success_jobs, first.pending_jobs, first.due_jobs) == (3, 2, 1, 2)
    second = migrate(spark, tables, load, max_requests=2)
    assert (second.seeded_jobs, second.processed_requests, second.completed_jobs, second.pending_jobs) == (0, 1, 3, 0)
    assert jobs.migration_status(tables)["status_counts"] == {"success": 3}


def test_migration_stops_at_quota_and_waits(spark, tmp_path):
    tables = store.TableStore(spark, f"file://{tmp_path}/db")

    def load(symbol):
        raise RuntimeError("API quota reached")

    out = migrate(spark, tables, load)
    assert (out.processed_requests, out.retry_jobs, out.quota_hit, out.pending_jobs) == (1, 1, True, 3)
    job = tables.read("fundamental_migration_progress").where("status = 'retry'").first()
    assert job.next_retry_ts == NOW + timedelta(minutes=1440) and job.attempts == 1
    with pytest.raises(RuntimeError):
        migrate(spark, tables, load, max_requests=0)
    with pytest.raises(RuntimeError):
        jobs.parse_datasets("income_statement, nope")


def test_migration_keeps_what_it_loaded(spark, tmp_path):
    """A loader that breaks ends the run; rows and outcomes of the jobs before it are stored."""
    tables = store.TableStore(spark, f"file://{tmp_path}/db")

    def load(symbol):
        if symbol == "B":
            raise RuntimeError("no data")
        if symbol == "C":
            raise ValueError("broken")
        return rows_of(spark, statement(symbol, 1))

    with pytest.raises(ValueError, match="broken"):
        migrate(spark, tables, load)
    assert [r.symbol for r in tables.read("income_statements").collect()] == ["A"]
    queue = {r.symbol: (r.status, r.attempts, r.rows_written) for r in tables.read("fundamental_migration_progress").collect()}
    assert queue == {"A": ("success", 1, 1), "B": ("retry", 1, 0), "C": ("pending", 0, 0)}


INDEX = """<table id="constituents"><thead><tr><th>Symbol</th><th>Security</th><th>GICS Sector</th></tr></thead>
<tbody><tr><td>AB.C</td><td>A&nbsp;b<br>c</td><td>Tech</td><td>extra</td></tr><tr><td>short</td></tr><tr><td></td><td>x</td><td>y</td></tr></tbody></table>"""
NIKKEI = """<div class="idx-componentslist-header"><div><p class="title">Technology</p><ul><li class="list-item"><a href="#C1">Pharma</a></li></ul></div></div>
<a id="C1"></a><div><h3 class="idx-section-subheading">Pharma</h3><table class="t idx-extend"><thead><tr><th>Code</th><th>Company Name</th></tr></thead>
<tbody><tr><td>4151</td><td>K CO</td></tr><tr><td>1</td></tr></tbody></table></div>"""


def test_index_tables(spark):
    (r,) = html_tables.parse_index(spark, INDEX, "sp500")
    assert (r["symbol"], r["security"], r["gics_sector"], r["founded"]) == ("AB.C", "A b c", "Tech", None)
    assert html_tables.parse_index(spark, NIKKEI, "nikkei225") == [{"code": "4151", "company_name": "K CO", "industry_group": "Technology", "industry": "Pharma", "source": "nikkei_indexes"}]
    with pytest.raises(ValueError):
        html_tables.parse_index(spark, "<p>nothing</p>", "ftse250")


def test_snapshot_is_fetched_once_a_day(spark, tmp_path):
    path = tmp_path / "sp.json"
    calls = []
    fetch = lambda url: calls.append(url) or INDEX
    assert snapshots.ensure_snapshot(spark, "sp500", path, fetch).refreshed
    again = snapshots.ensure_snapshot(spark, "sp500", path, fetch)
    assert (again.rows, again.refreshed, again.source, len(calls)) == (1, False, "cache", 1)
    assert snapshots.read_snapshot(spark, str(path), "sp500").first().symbol == "AB.C"
    assert snapshots.json_schema("nikkei225")["items"]["properties"]["source"]["const"] == "nikkei_indexes"

    def down(url):
        raise URLError("down")

    with pytest.raises(RuntimeError):
        snapshots.ensure_snapshot(spark, "sp500", tmp_path / "other.json", down)


class Reply(BytesIO):
    def __enter__(self):
        return self

    def __exit__(self, *a):
        return None


def test_rest_errors():
    assert rest.fetch_json("OVERVIEW", "X", "k", opener=lambda u, timeout: Reply(b'{"a": 1}')) == {"a": 1}
    with pytest.raises(RuntimeError, match="unexpected"):
        rest.fetch_json("OVERVIEW", "X", "k", opener=lambda u, timeout: Reply(b"[]"))

    def limited(url, timeout):
        raise HTTPError(url, 429, "slow", {}, None)

    with pytest.raises(RuntimeError, match="rate limited"):
        rest.fetch_json("OVERVIEW", "X", "k", opener=limited)


def test_settings(monkeypatch, tmp_path):
    for name in ("TIDEWELL_ENDPOINT", "TIDEWELL_PROVIDER", "TIDEWELL_DATABASE", "ALPHAVANTAGE_API_KEY"):
        monkeypatch.delenv(name, raising=False)
    assert config.build_settings() == config.Settings("api", "alphavantage", ":memory:")
    monkeypatch.setenv("TIDEWELL_PROVIDER", "yfinance")
    assert config.build_settings(provider="alphavantage").provider == "alphavantage"
    with pytest.raises(RuntimeError):
        config.api_key()
    (tmp_path / ".env").write_text("# c\nALPHAVANTAGE_API_KEY=abc\n")
    monkeypatch.setenv("ALPHAVANTAGE_API_KEY", "kept")
    config.load_env_file(tmp_path / ".env")
    assert config.api_key() == "kept"


def test_command_line(spark, capsys, monkeypatch, tmp_path):
    monkeypatch.chdir(tmp_path)
    assert cli.main(["--endpoint", "duckdb"]) == 2
    assert cli.main(["--endpoint", "duckdb", "--sql", "select 1 as ok, date '2024-01-01' as d"]) == 0
    assert json.loads(capsys.readouterr().out) == [{"ok": 1, "d": "2024-01-01"}]
    assert cli.main(["--endpoint", "duckdb", "--sql", "selec"]) == 1
    assert cli.main(["--migration-status"]) == 2
    assert cli.main(["--migration-status", "--duckdb-database", f"file://{tmp_path}/db"]) == 0


def test_asof_join(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "k int, t int")
    right = spark.createDataFrame([(1, 2, "a"), (1, 5, "b")], "k int, t int, v string")
    got = {(r.k, r.t): r.v for r in store.asof_join(left, right, by=["k"], on="t", values=["v"]).collect()}
    assert got == {(1, 5): "b", (1, 1): None, (2, 9): None}
