import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from sluicewire import cli, config
from sluicewire.lang import parse
from sluicewire.plans import query, to_payload
from sluicewire.sinks.files import RotatingFile, write_json_lines
from sluicewire.sinks.prometheus import PrometheusText
from sluicewire.sinks.webhook import DeliveryError, webhook


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame([("log", 1, '{"a":1}'), ("log", 2, '{"a":2}'), ("network", 3, '{"p":"x"}')], "type string, timestamp_ns long, data string")


def test_rotating_file(tmp_path):
    f = RotatingFile(str(tmp_path / "e.jsonl"), max_bytes=30, max_files=2)
    assert f.write(["x" * 9] * 7) == 7
    assert (tmp_path / "e.jsonl").read_text().count("\n") == 1 and len(f.rotated()) == 2
    f.write(["y" * 40] * 2)
    assert len(f.rotated()) == 2 and not (tmp_path / "e.jsonl").exists()


def test_rotation_within_a_second_keeps_the_newest_and_lists_the_folder_once(tmp_path, monkeypatch):
    monkeypatch.setattr("time.strftime", lambda *_: "20240101_000000")
    listed = []
    monkeypatch.setattr(RotatingFile, "rotated", lambda self, f=RotatingFile.rotated: listed.append(1) or f(self))
    f = RotatingFile(str(tmp_path / "e[1].log"), max_bytes=1, max_files=3)
    (tmp_path / "e[1].log.other").write_text("")
    assert f.rotated() == [] and f.write(f"line {i}" for i in range(200)) == 200
    assert len(listed) == 2
    assert [p.read_text() for p in f.rotated()] == ["line 197\n", "line 198\n", "line 199\n"]
    again = RotatingFile(str(f.path), max_bytes=1, max_files=3)
    again.write(["more"])
    assert [p.read_text() for p in again.rotated()] == ["line 198\n", "line 199\n", "more\n"] and (tmp_path / "e[1].log.other").exists()


@pytest.mark.parametrize("limits", [{"max_bytes": 1}, {"max_bytes": 500}, {"max_bytes": 5000}, {"max_age_s": 0}, {}])
def test_rotating_file_cuts_blocks_as_lines(spark, tmp_path, monkeypatch, limits):
    monkeypatch.setattr("sluicewire.sinks.files.BLOCK_BYTES", 3000)
    text = [chr(0x61 + 0x400 * (i % 3)) * (i * 37 % 400 if i % 90 else 4000) + "\n" * (i % 7 == 0) for i in range(400)]
    rows = spark.createDataFrame([("log", i, x) for i, x in enumerate(text)], "type string, timestamp_ns long, data string").repartitionByRange(3, "timestamp_ns")
    assert rows.rdd.getNumPartitions() == 3
    made = [RotatingFile(str(tmp_path / kind / "e.log"), max_files=1000, **limits) for kind in ("lines", "blocks")]
    lines = [f'{{"type":"log","timestamp_ns":{i},"data":{x}}}' for i, x in enumerate(text)]
    for f in made:
        f.path.parent.mkdir()
        f.path.write_text("there before\n")
    assert made[0].write(lines) == 400
    made[1].write_batch(rows)
    parts = [[p.read_bytes() for p in [*f.rotated(), f.path] if p.exists()] for f in made]
    assert parts[0] == parts[1] and b"".join(parts[1]).decode() == "there before\n" + "".join(x + "\n" for x in lines)
    assert len(parts[1]) == 1 or len(parts[1]) > 10


def test_rotation_of_no_events(spark, tmp_path):
    from sluicewire.suite import QUERIES

    spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(0).write.parquet(str(tmp_path / "events.parquet"))
    assert QUERIES["sink_rotation"](spark, str(tmp_path)).collect() == []


def test_json_lines(events, spark, tmp_path):
    write_json_lines(events, str(tmp_path / "o"), max_records=1)
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "o")).collect())[0] == '{"type":"log","timestamp_ns":1,"data":{"a":1}}'


def test_webhook(events):
    got = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            got.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            self.send_response(500 if self.path == "/bad" else 204)
            self.send_header("Content-Length", "0")
            self.end_headers()

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    webhook(url + "/in")(events)
    assert sorted(x["timestamp_ns"] for x in got) == [1, 2, 3]
    with pytest.raises(Exception, match="500"):
        webhook(url + "/bad")(events)
    server.shutdown()
    with pytest.raises(ValueError):
        webhook("ftp://x")
    assert issubclass(DeliveryError, RuntimeError)


def test_prometheus(events, spark, tmp_path):
    text = PrometheusText(str(tmp_path / "m.prom"))
    text.count_events(events)
    calls = spark.createDataFrame([("a\"b", 500, 1.5), ("a\"b", 500, 2.5)], "service string, `log.status` int, ms double")
    q = "aggregate count(), avg(ms) by service, log.status"
    text.gauge_results(query(calls, q), parse(q).stages[-1])
    out = text.flush()
    assert (tmp_path / "m.prom").read_text() == out
    for line in ('sluicewire_events_total 3', 'sluicewire_events_by_type{type="log"} 2', 'sluicewire_events_by_type{type="network"} 1', "sluicewire_bytes_processed 23", 'sluicewire_count{service="a\\"b",log_status="500"} 2.000000', 'sluicewire_avg_ms{service="a\\"b",log_status="500"} 2.000000'):
        assert line in out.split("\n")
    again = text.flush()
    assert "avg_ms" not in again and "sluicewire_events_total 3" in again
    text.count_events(to_payload(query(calls, "aggregate count()"), parse("aggregate count()").stages[-1]))
    assert "sluicewire_events_total 4" in text.render()


YAML = """
version: "1.0"
inputs:
  logs:
    - {name: app, type: file, path: %s, format: json, filter: "level == ERROR"}
correlation: {enabled: true, strategies: [{type: time_based, window: 250ms}]}
queries:
  errors: "aggregate count() by level"
outputs:
  - {type: file, path: %s, rotation: {max_size: 10MB, max_files: 3}}
performance: {buffer_size: 1MiB, memory_limit: 2GB}
"""


def test_config_and_cli(tmp_path, capsys):
    pytest.importorskip("yaml")
    (tmp_path / "in.jsonl").write_text('{"level":"ERROR"}\n{"level":"INFO"}\n{"level":"ERROR"}\n')
    path = tmp_path / "c.yaml"
    path.write_text(YAML % (tmp_path / "in.jsonl", tmp_path / "out.jsonl"))
    c = config.load(str(path))
    assert (c.within_ms, c.buffer_bytes, c.memory_bytes, c.outputs[0].max_bytes, c.inputs[0].filter) == (250, 2**20, 2 * 10**9, 10**7, "level == ERROR")
    assert cli.main(["config", "validate", str(path)]) == 0
    assert cli.main(["analyze", "--config", str(path)]) == 0
    assert [json.loads(x)["data"]["metrics"] for x in (tmp_path / "out.jsonl").read_text().splitlines()] == [{"count": 2}]
    assert cli.main(["--logs", str(tmp_path / "in.jsonl"), "--query", "level == INFO"]) == 0
    assert '"level":"INFO"' in capsys.readouterr().out
    assert cli.main(["analyze", "--logs", str(tmp_path / "in.jsonl"), "--query", "level =="]) == 2


@pytest.mark.parametrize("bad", [{"inputs": {"logs": [{"type": "file"}]}}, {"outputs": [{"type": "x"}]}, {"outputs": [{"type": "http"}]}, {"correlation": {"window": "5 days"}}, {"performance": {"buffer_size": "1XB"}}, [1]])
def test_config_errors(bad):
    with pytest.raises(config.ConfigError):
        config.from_mapping(bad)


def test_monitor_follows_logs_captures_and_datagrams(spark, tmp_path):
    from sluicewire.engine import Monitor
    from sluicewire.sources.packets import write_pcap

    (tmp_path / "a.jsonl").write_text('{"level":"ERROR","ts":"2024-01-01T00:00:00Z"}\n{"level":')
    (tmp_path / "a.pcap").write_bytes(write_pcap([(1_704_067_200_050_000_000, b"\0" * 14)]))
    m = Monitor(spark, streaming=True).add_log_input(str(tmp_path / "a.jsonl")).add_network_input(str(tmp_path / "a.pcap"))
    got = []
    m.on_event(lambda d, i: got.extend(r["type"] for r in d.collect()), once=True, checkpoint=str(tmp_path / "c")).awaitTermination()
    assert sorted(got) == ["log", "network"]
    raw = {"inputs": {"logs": [{"type": "syslog", "listen": "127.0.0.1:0"}]}}
    assert config.from_mapping(raw).monitor(spark, streaming=True).events().isStreaming
    with pytest.raises(ValueError, match="streaming"):
        config.from_mapping(raw).monitor(spark)
    live = {"inputs": {"network": [{"interface": "lo", "filter": "udp"}]}}
    assert config.from_mapping(live).monitor(spark, streaming=True).events().isStreaming
    with pytest.raises(ValueError, match="streaming"):
        config.from_mapping(live).monitor(spark)
    with pytest.raises(config.ConfigError):
        config.from_mapping({"inputs": [{"type": "udp"}]})
