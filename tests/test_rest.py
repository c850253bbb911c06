"""Requests through the Spark data source and the command line, against a local server."""

import json
import sys
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from types import SimpleNamespace
from urllib.parse import parse_qs, urlsplit

import pytest
from pyspark.sql import functions as F

from tidewell import cli
from tidewell.plans import jobs
from tidewell.sources import payloads, rest, snapshots, store

KINDS = {f: d for d, f in rest.FUNCTIONS.items()}
INDEX = '<table id="constituents"><thead><tr><th>Symbol</th><th>{0}</th><th>{1}</th></tr></thead><tbody><tr><td>AB.C</td><td>A b</td><td>Tech</td></tr></tbody></table>'
NIKKEI = """<div class="idx-componentslist-header"><div><p class="title">Technology</p><ul><li class="list-item"><a href="#C1">Pharma</a></li></ul></div></div>
<a id="C1"></a><div><h3 class="idx-section-subheading">Pharma</h3><table class="t idx-extend"><thead><tr><th>Code</th><th>Company Name</th></tr></thead>
<tbody><tr><td>4151</td><td>K CO</td></tr></tbody></table></div>"""


@pytest.fixture
def server(monkeypatch):
    """Statements of any symbol; ``broken`` symbols answer with a quota note, a status or a list."""
    seen, broken = Counter(), {}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: v[0] for k, v in parse_qs(urlsplit(self.path).query).items()}
            symbol, kind = q["symbol"], KINDS[q["function"]]
            seen[symbol, kind] += 1
            how = broken.get(symbol)
            if kind == "overview":
                body = {"Symbol": symbol, "PERatio": 12.5, "Key": q["apikey"]}
            else:
                body = {"symbol": symbol, "annualReports": [{"fiscalDateEnding": "2023-12-31", "reportedCurrency": "USD", **{a: "7" for a in payloads.FIELDS[kind].values() if a}}], "quarterlyReports": []}
            body = {"quota": {"Note": "Our standard API call frequency is 5"}, "list": []}.get(how, body)
            self.send_response(how if isinstance(how, int) else 200)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *args):
            pass

    http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{http.server_port}/query"
    monkeypatch.setenv("TIDEWELL_API_BASE", base)
    monkeypatch.setenv("ALPHAVANTAGE_API_KEY", "k1")
    for name in ("TIDEWELL_ENDPOINT", "TIDEWELL_PROVIDER", "TIDEWELL_DATABASE", "TIDEWELL_SQL"):
        monkeypatch.delenv(name, raising=False)
    yield SimpleNamespace(base=base, seen=seen, broken=broken)
    http.shutdown()
    http.server_close()


def test_read_through_the_data_source(spark, server):
    df = rest.read_payloads(spark, ["A", "B", "C"], "overview", "k2")
    assert df.rdd.getNumPartitions() == 3
    assert {r.symbol: json.loads(r.payload)["Key"] for r in df.collect()} == {"A": "k2", "B": "k2", "C": "k2"}
    raw = rest.read_payloads(spark, ["A"], "cash_flow", "k2", server.base)
    (row,) = payloads.statement_rows(raw, "cash_flow", "payload", F.lit("api"), F.current_timestamp()).select("symbol", "free_cash_flow").collect()
    assert (row.symbol, row.free_cash_flow) == ("A", 0)
    assert rest.read_payloads(spark, [], "overview", "k").count() == 0
    server.broken["A"] = 500
    with pytest.raises(Exception, match="request failed for A"):
        rest.read_payloads(spark, ["A"], "overview", "k").collect()
    with pytest.raises(Exception, match="Unsupported datasets: nope"):
        rest.stream_payloads(spark, ["A"], ["nope"], "k").writeStream.format("noop").start().processAllAvailable()


def test_stream_goes_on_where_it_stopped(spark, server, tmp_path):
    """A quota note ends the query; started again it repeats only the batch that failed, and later symbols follow."""
    tables = store.TableStore(spark, f"file://{tmp_path}/db")
    symbols = ["A", "B", "C", "D", "E"]
    server.broken["D"] = "quota"

    def run(symbols):
        q = rest.store_statements(rest.stream_payloads(spark, symbols, ["income_statement", "balance_sheet"], "k", per_trigger=4), tables, str(tmp_path / "check"), every="0 seconds")
        try:
            q.processAllAvailable()
            return max((p["numInputRows"] for p in q.recentProgress), default=0)
        finally:
            q.stop()

    with pytest.raises(Exception, match="quota reached"):
        run(symbols)
    held = lambda name: sorted(r.symbol for r in tables.read(name).collect())
    assert held("income_statements") == held("balance_sheets") == ["A", "B"]
    server.broken.clear()
    before = Counter(server.seen)
    assert run(symbols) <= 4
    assert held("income_statements") == held("balance_sheets") == symbols
    assert {s for s, _ in (server.seen - before)} == {"C", "D", "E"}
    before = Counter(server.seen)
    run([*symbols, "F"])
    assert held("income_statements") == [*symbols, "F"]
    assert {s for s, _ in (server.seen - before)} <= {"E", "F"}  # the last batch may be planned, and so read, anew
    run([*symbols, "F"])
    assert held("balance_sheets") == [*symbols, "F"]


def test_one_batch_a_run(spark, server, tmp_path):
    """With availableNow each run makes the next requests, no more than the limit."""
    got = []
    for _ in range(3):
        stream = rest.stream_payloads(spark, ["A", "B", "C"], ["overview"], "k", per_trigger=2).writeStream
        stream = stream.foreachBatch(lambda batch, n: got.append(sorted(r.symbol for r in batch.collect()))).option("checkpointLocation", str(tmp_path / "check"))
        stream.trigger(availableNow=True).start().awaitTermination(60)
    assert got == [["A", "B"], ["C"]]


def out_of(capsys):
    return json.loads(capsys.readouterr().out)


def test_arguments_have_defaults():
    args = cli.parse_args([])
    assert (args.symbol, args.endpoint, args.provider, args.sql, args.duckdb_database) == (None,) * 5
    assert (args.max_requests, args.retry_delay_minutes, args.quota_retry_minutes) == (5, 30, 1440)
    assert not any((args.refresh_sp500, args.refresh_ftse250, args.refresh_nikkei225, args.ingest_income_statement, args.ingest_cash_flow, args.ingest_balance_sheet, args.migrate_sp500_fundamentals, args.migration_status))
    args = cli.parse_args(["--provider", "yfinance", "MSFT"])
    assert (args.provider, args.symbol) == ("yfinance", "MSFT")
    with pytest.raises(SystemExit) as e:
        cli.parse_args(["--provider", "other"])
    assert e.value.code == 2


def test_lookups(server, capsys, monkeypatch, tmp_path):
    monkeypatch.chdir(tmp_path)
    assert cli.main(["IBM"]) == 0 and out_of(capsys) == {"Symbol": "IBM", "PERatio": 12.5, "Key": "k1"}
    assert cli.main(["IBM", "--alphavantage-api-key", "k9"]) == 0 and out_of(capsys)["Key"] == "k9"
    assert cli.main([]) == 2
    server.broken |= {"SLOW": 429, "LIST": "list"}
    assert cli.main(["SLOW"]) == 1 and "rate limited for SLOW" in capsys.readouterr().err
    assert cli.main(["LIST"]) == 1 and "unexpected payload" in capsys.readouterr().err
    monkeypatch.delenv("ALPHAVANTAGE_API_KEY")
    assert cli.main(["IBM"]) == 1 and "ALPHAVANTAGE_API_KEY" in capsys.readouterr().err
    monkeypatch.setitem(sys.modules, "yfinance", SimpleNamespace(Ticker=lambda s: SimpleNamespace(info={"symbol": s, "beta": 1})))
    assert cli.main(["--provider", "yfinance", "MSFT"]) == 0 and out_of(capsys) == {"symbol": "MSFT", "beta": 1}


@pytest.mark.parametrize("name", list(cli.INGEST))
def test_ingest(spark, server, capsys, monkeypatch, tmp_path, name):
    monkeypatch.chdir(tmp_path)
    flag, table = f"--{name.replace('_', '-')}", payloads.TABLE_OF[cli.INGEST[name]]
    root = f"file://{tmp_path}/db"
    for _ in range(2):
        assert cli.main(["ibm", flag, "--duckdb-database", root]) == 0
        assert out_of(capsys) == {"symbol": "IBM", "database": root, "rows_written": 1}
    assert store.TableStore(spark, root).read(table).count() == 1
    assert cli.main([flag, "--duckdb-database", root]) == 2
    assert cli.main(["ibm", flag]) == 2
    server.broken["ibm"] = "quota"
    assert cli.main(["ibm", flag, "--duckdb-database", root]) == 1 and "quota reached" in capsys.readouterr().err


def test_migrate_and_status(spark, server, capsys, monkeypatch, tmp_path):
    monkeypatch.chdir(tmp_path)
    snapshot, root = tmp_path / "names.json", f"file://{tmp_path}/db"
    snapshot.write_text(json.dumps([{"symbol": s} for s in ("BRK.B", "AA", "AA", "ZZ")]))
    call = ["--migrate-sp500-fundamentals", "--sp500-input", str(snapshot), "--duckdb-database", root, "--migration-datasets", "income_statement,cash_flow"]
    server.broken["ZZ"] = "quota"
    assert cli.main([*call, "--max-requests", "5"]) == 0
    first = out_of(capsys)
    assert (first["symbol_count"], first["dataset_count"], first["seeded_jobs"], first["processed_requests"], first["success_jobs"], first["quota_hit"]) == (3, 2, 6, 5, 4, True)
    assert cli.main(["--migration-status", "--duckdb-database", root]) == 0
    status = out_of(capsys)
    assert status["status_counts"] == {"pending": 1, "retry": 1, "success": 4} and status["table_counts"]["cash_flow_statements"] == 2
    assert [f["symbol"] for f in status["recent_failures"]] == ["ZZ"]
    for wrong in (["--migrate-sp500-fundamentals"], ["--migration-status"]):
        assert cli.main(wrong) == 2
    assert cli.main([*call[:-1], "nope"]) == 1 and "nope" in capsys.readouterr().err
    assert cli.main([*call, "--max-requests", "0"]) == 1
    assert jobs.migration_status(store.TableStore(spark, root))["total_jobs"] == 6


@pytest.mark.parametrize("kind", list(snapshots.PAGES))
def test_refreshes(spark, capsys, monkeypatch, tmp_path, kind):
    monkeypatch.chdir(tmp_path)
    page = {"sp500": INDEX.format("Security", "GICS Sector"), "ftse250": INDEX.format("Company", "Sector"), "nikkei225": NIKKEI}[kind]
    if kind == "ftse250":
        page = page.replace("<th>Symbol</th><th>Company</th>", "<th>Company</th><th>Ticker</th>")
    asked = []

    class Page:
        __enter__ = lambda self: self
        __exit__ = lambda self, *a: None
        read = lambda self: page.encode()

    monkeypatch.setattr(snapshots, "urlopen", lambda request, timeout: asked.append(request.full_url) or Page())
    call = [f"--refresh-{kind}", f"--{kind}-output", str(tmp_path / "out.json")]
    assert cli.main(call) == 0 and out_of(capsys) == {"output_path": str(tmp_path / "out.json"), "refreshed": True, "rows": 1, "source": snapshots.SOURCES[kind]}
    assert cli.main(call) == 0 and out_of(capsys)["source"] == "cache"
    assert asked == [snapshots.PAGES[kind]]
    page = "<p>nothing</p>"
    assert cli.main([*call[:-1], str(tmp_path / "other.json")]) == 1
