import json
import struct

import pytest
from pyspark.sql import functions as F

from sluicewire.engine import Monitor
from sluicewire.plans import query
from sluicewire.sources.formats import detect_format, parse_lines
from sluicewire.sources.packets import PcapError, packets, write_pcap
from sluicewire.sources.payloads import dns_message, http_message, parse_dns, parse_http
from sluicewire.sources.pcap import capture_filter, pushed, read_pcap


def parsed(spark, fmt, *lines, **options):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, value string")
    return [json.loads(r[0]) for r in parse_lines(df, fmt, keep=["i"], **options).orderBy("i").select(F.to_json("data")).collect()]


def test_detect_format():
    assert [detect_format(p) for p in ("/a/app.json", "x.JSONL", "/var/log/NGINX/a.log", "/var/syslog.1", "a.logfmt", "other.txt", "nginx.json")] == ["json", "json", "nginx", "syslog", "logfmt", "json", "json"]


def test_json_lines(spark):
    got = parsed(spark, "json", '{"level":"INFO","message":"hi"}', "{broken", "[1]", "", "7")
    assert got == [{"level": "INFO", "message": "hi"}, {"message": "{broken"}, {"message": "[1]"}, {"message": "7"}]


def test_logfmt(spark):
    got = parsed(spark, "logfmt", 'level=INFO msg="hello world" count=42 r=-1.5 ok=true e=1e3 ', "bare a=1 word b=2", "no pairs", 'k=1 k=2 q="a\\"b" v=', "x=12ab y=1e999")
    assert got[0] == {"level": "INFO", "msg": "hello world", "count": 42, "r": -1.5, "ok": True, "e": 1000.0}
    assert got[1] == {"a": 1, "b": 2}
    assert got[2] == {"message": "no pairs"}
    assert got[3] == {"k": 2, "q": 'a\\"b', "v": ""}
    assert got[4] == {"x": "12ab", "y": "1e999"}


def test_syslog(spark):
    got = parsed(
        spark, "syslog",
        "<34>Oct 11 22:14:15 mymachine su: 'su root' failed",
        "<165>1 2003-10-11T22:14:15.003Z host app 99 ID47 [x y=\"1\"] text here",
        "<34>1 2003-08-24T05:14:15.000003-07:00 192.0.2.1 p - - - last", "no priority", "<999>x", "<13>odd line",
        year=2024,
    )
    assert got[0] == {"syslog_priority": 34, "syslog_facility": 4, "syslog_severity": 2, "timestamp": 1728684855, "hostname": "mymachine", "message": "su: 'su root' failed"}
    assert got[1] | {} == {"syslog_priority": 165, "syslog_facility": 20, "syslog_severity": 5, "syslog_version": 1, "timestamp": 1065910455, "timestamp_usec": 3000, "hostname": "host", "app_name": "app", "procid": "99", "msgid": "ID47", "structured_data": '[x y="1"]', "message": "text here"}
    assert (got[2]["timestamp"], got[2]["timestamp_usec"], got[2]["message"]) == (1061727255, 3, "last")
    assert got[3:5] == [{"message": "no priority"}, {"message": "<999>x"}]
    assert got[5]["message"] == "odd line" and got[5]["syslog_priority"] == 13


def test_nginx(spark):
    got = parsed(
        spark, "nginx",
        '127.0.0.1 - - [10/Oct/2023:13:55:36 +0000] "GET /a HTTP/1.1" 403 146 "-" "curl/7.68"',
        '10.0.0.2 - bob [10/Oct/2023:13:55:36 +0000] "POST /b HTTP/2.0" 200 5 "http://r/" "-"', "garbage",
    )
    assert got[0] == {"remote_addr": "127.0.0.1", "time_local": "10/Oct/2023:13:55:36 +0000", "request": "GET /a HTTP/1.1", "method": "GET", "path": "/a", "protocol": "HTTP/1.1", "status": 403, "body_bytes_sent": 146, "http_user_agent": "curl/7.68"}
    assert got[1]["remote_user"] == "bob" and got[1]["http_referer"] == "http://r/" and "http_user_agent" not in got[1]
    assert got[2] == {"message": "garbage"}


def test_regex(spark):
    assert parsed(spark, "regex", "a=1 b=", "zz", pattern=r"a=(?P<a>\d) b=(?<b>\w*)") == [{"a": "1"}, {"message": "zz"}]
    with pytest.raises(ValueError, match="named group"):
        parse_lines(spark.createDataFrame([("x",)], "value string"), "regex", pattern="x")


def frame(proto, src, dst, body=b"", sport=1234, dport=80):
    if proto == 6:
        l4 = struct.pack(">HHIIBBHHH", sport, dport, 1, 2, 5 << 4, 0x12, 1000, 7, 0) + body
    elif proto == 17:
        l4 = struct.pack(">HHHH", sport, dport, 8 + len(body), 9) + body
    else:
        l4 = struct.pack(">BBH", 8, 0, 3) + body
    ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(l4), 0, 0, 64, proto, 0, bytes(map(int, src.split("."))), bytes(map(int, dst.split("."))))
    return b"\x01" * 6 + b"\x02" * 6 + b"\x08\x00" + ip + l4


def test_packets():
    data = write_pcap([(1_500_000_001, frame(6, "10.0.0.1", "10.0.0.2", b"hi")), (2_000_000_000, frame(17, "1.2.3.4", "4.3.2.1")), (3, frame(1, "1.1.1.1", "2.2.2.2")), (4, b"short")])
    got = list(packets(data))
    assert [ns for ns, _ in got] == [1_500_000_001, 2_000_000_000, 3, 4]
    tcp = got[0][1]
    assert (tcp["protocol"], tcp["tcp_dst_port"], tcp["tcp_flag_syn"], tcp["tcp_flag_ack"], tcp["tcp_flag_fin"], tcp["payload"], tcp["ip_ttl"]) == ("tcp", 80, True, True, False, b"hi", 64)
    assert got[1][1]["udp_length"] == 8 and got[2][1]["icmp_type"] == 8 and "protocol" not in got[3][1]
    assert len(list(packets(data[:-3]))) == 3
    with pytest.raises(PcapError):
        list(packets(b"nonsense"))


def test_pcap_source_pushes_its_filter(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.pcap").write_bytes(write_pcap([(10**9 * i, frame(6, "10.0.0.1", "10.0.0.2", dport=3306 + i)), (10**9 * i + 5, frame(17, "10.0.0.1", "9.9.9.9", dport=53))]))
    path = str(tmp_path)
    assert read_pcap(spark, path).count() == 6
    assert read_pcap(spark, path, "network.dst_port == 3307").count() == 1
    assert read_pcap(spark, path, "tcp port 3306 or udp").count() == 4
    assert read_pcap(spark, path, "not tcp and dst host 9.9.9.9").count() == 3
    assert pushed(capture_filter("dst port 53")) == [(("tcp_dst_port", "udp_dst_port"), 53)]
    assert pushed(capture_filter("tcp or udp")) == []
    got = query(read_pcap(spark, path), "network.dst_port == 53 | aggregate count() by network.dst_ip").collect()
    assert [tuple(r) for r in got] == [("9.9.9.9", 3)]


def test_http():
    got = parse_http(b"GET /x HTTP/1.1\r\nHost: a\r\nX: 1\r\nx: 2\r\n\r\nbody")
    assert (got["kind"], got["uri"], got["headers"]) == ("request", "/x", {"host": "a", "x": "2"})
    assert parse_http(b"HTTP/1.0 404 Not Found\r\n\r\n")["reason"] == "Not Found"
    assert parse_http(b"\x16\x03") is None and parse_http(None) is None


def test_dns():
    head = struct.pack(">6H", 7, 0x8180, 1, 2, 0, 0)
    question = b"\x01a\x02bc\x00" + struct.pack(">HH", 1, 1)
    answers = b"\xc0\x0c" + struct.pack(">HHIH", 1, 1, 60, 4) + b"\x01\x02\x03\x04" + b"\xc0\x0c" + struct.pack(">HHIH", 5, 1, 60, 2) + b"\xc0\x0e"
    got = parse_dns(head + question + answers)
    assert got["questions"] == [{"name": "a.bc", "type": 1, "class": 1}]
    assert [(a["name"], a["rdata"]) for a in got["answers"]] == [("a.bc", "1.2.3.4"), ("a.bc", "bc")]
    loop = struct.pack(">6H", 7, 0, 1, 0, 0, 0) + b"\xc0\x0c" + b"\0\1\0\1"
    assert parse_dns(loop) is None and parse_dns(head + question) is None and parse_dns(b"") is None


def test_payload_columns(spark):
    df = spark.createDataFrame([(bytearray(b"GET /x HTTP/1.1\r\nA: b\r\n\r\n"),), (None,)], "p binary")
    got = df.select(http_message("p").alias("h"), dns_message("p").alias("d")).collect()
    assert got[0]["h"]["method"] == "GET" and got[0]["h"]["headers"] == {"a": "b"} and got[1]["h"]["method"] is None and got[0]["d"]["id"] is None


def test_monitor_joins_inputs(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs/app.jsonl").write_text('{"level":"ERROR","ts":"2024-01-01T00:00:00Z"}\n{"level":"INFO","ts":"2024-01-01T00:00:10Z"}\n')
    (tmp_path / "a.pcap").write_bytes(write_pcap([(1_704_067_200_050_000_000, frame(6, "10.0.0.1", "10.0.0.2", dport=3306))]))
    m = Monitor(spark).add_log_input(str(tmp_path / "logs"), "json").add_network_input(str(tmp_path / "a.pcap"))
    got = m.query("correlate log.level == ERROR with network.dst_port == 3306 within 100ms").collect()
    assert [r["time_diff_ms"] for r in got] == [-50.0]
    assert m.correlations().count() == 1
    assert m.enable_correlation(10).correlations().count() == 0
    assert Monitor(spark).add_log_input(str(tmp_path / "logs"), "json", "level == INFO").events().count() == 1


def test_pcap_format(spark, tmp_path):
    from sluicewire.sources.pcap_format import PcapReader, register

    for i in range(2):
        (tmp_path / f"{i}.pcap").write_bytes(write_pcap([(i, frame(6, "10.0.0.1", "10.0.0.2", dport=80 + i)), (i + 5, frame(17, "10.0.0.1", "9.9.9.9", dport=53))]))
    register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    df = spark.read.format("pcap").load(str(tmp_path))
    assert df.count() == 4
    assert query(df, "network.dst_port == 53 AND protocol == udp").count() == 2
    assert df.where("tcp_dst_port = 81").count() == 1
    from pyspark.sql.datasource import EqualTo

    reader = PcapReader({"path": str(tmp_path)})
    list(reader.pushFilters([EqualTo(("udp_dst_port",), 53)]))
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 2
    with pytest.raises(ValueError, match="path"):
        PcapReader({})


def drained(stream, out):
    """What a stream gives now, as rows of the batch handler; the query's offsets stay in ``out``."""
    got = []
    stream.writeStream.foreachBatch(lambda d, i: got.extend(d.collect())).option("checkpointLocation", str(out)).trigger(availableNow=True).start().awaitTermination()
    return got


def test_tail_follows_appended_lines(spark, tmp_path):
    from sluicewire.sources.tail import Range, TailReader
    from sluicewire.sources.text import tail_logs

    logs = tmp_path / "logs"
    logs.mkdir()
    a, b = logs / "a.log", logs / "b.log"
    a.write_bytes(b"a=1\r\na=2\nhalf")
    stream = lambda: tail_logs(spark, str(logs), "logfmt").selectExpr("try_variant_get(data, '$.a', 'int') a")
    take = lambda: sorted(r["a"] for r in drained(stream(), tmp_path / "offsets"))
    assert take() == [1, 2]
    with a.open("ab") as f:
        f.write(b" a=3\n")
    b.write_bytes(b"a=4\n")
    assert take() == [3, 4]
    a.write_bytes(b"a=5\n")  # replaced by a shorter one
    assert take() == [5]
    assert take() == []
    # every line is in one range, wherever ranges end
    lines = [b"x" * (7 * i % 23) for i in range(200)]
    b.write_bytes(b"\n".join(lines) + b"\n")
    for chunk in (1, 7, 64, 10**6):
        r = TailReader({"path": str(b), "maxBytesPerPartition": chunk})
        end = r.latestOffset()
        got = [x for p in r.partitions(r.initialOffset(), end) for batch in r.read(p) for x in batch.column(1).to_pylist()]
        assert got == [x.decode() for x in lines]
    r = TailReader({"path": str(logs / "b*"), "startingPosition": "end"})
    assert r.partitions(r.initialOffset(), r.latestOffset()) == [] and list(r.initialOffset().values()) == [b.stat().st_size]
    assert TailReader({"path": str(tmp_path / "none")}).latestOffset() == {}
    assert r.partitions({str(b): 10}, {str(b): 4}) == [Range(str(b), 0, 4)]
    with pytest.raises(ValueError, match="path"):
        TailReader({})


def test_captures_are_written_and_followed(spark, tmp_path):
    from sluicewire.sources.pcap import stream_pcap
    from sluicewire.sources.pcap_format import register

    register(spark)
    frames = [(10**9 * i, frame(6, "10.0.0.1", "10.0.0.2", dport=80 + i)) for i in range(20)]
    df = spark.createDataFrame([(ns, bytearray(f)) for ns, f in frames], "timestamp_ns long, frame binary").repartition(3)
    out = tmp_path / "caps"
    df.write.format("pcap").mode("append").save(str(out))
    assert sorted(r["data"]["tcp_dst_port"] for r in read_pcap(spark, str(out)).collect()) == list(range(80, 100))
    assert read_pcap(spark, str(out), whole=True).count() == 20
    take = lambda: sorted(r["data"]["tcp_dst_port"] for r in drained(stream_pcap(spark, str(out), "not dst port 85"), tmp_path / "offsets"))
    assert take() == [p for p in range(80, 100) if p != 85]
    one = next(out.glob("*.pcap"))
    more = write_pcap([(1, frame(6, "10.0.0.1", "10.0.0.2", dport=200)), (2, frame(6, "10.0.0.1", "10.0.0.2", dport=201))])[24:]
    with one.open("ab") as f:
        f.write(more[:-5])  # the second packet isn't whole yet
    assert take() == [200]
    with one.open("ab") as f:
        f.write(more[-5:])
    assert take() == [201]
    df.limit(2).write.format("pcap").mode("overwrite").save(str(out))
    assert read_pcap(spark, str(out)).count() == 2
    with pytest.raises(Exception, match="timestamp_ns"):
        spark.range(3).write.format("pcap").mode("append").save(str(out))


def test_udp_lines(spark):
    import socket
    import time

    from sluicewire.sources.text import stream_udp
    from sluicewire.sources.received import UdpReader

    r = UdpReader({"host": "127.0.0.1", "port": "0"})
    assert r.initialOffset() == {"row": 0}
    out = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
    for text in (b"<34>one", b"<35>two\nthree"):
        out.sendto(text, r.listen().getsockname())
    for _ in range(100):
        got, end = r.read({"row": 0})
        if end["row"] == 3:
            break
        time.sleep(0.05)
    assert [x[0] for x in got] == ["<34>one", "<35>two", "three"]
    assert [x[0] for x in r.readBetweenOffsets({"row": 1}, {"row": 2})] == ["<35>two"]
    r.commit({"row": 2})
    assert len(r.rows) == 1 and r.read({"row": 9})[1] == {"row": 3}
    stream = stream_udp(spark, 0, "127.0.0.1")
    assert stream.isStreaming and stream.columns == ["type", "ts", "source", "data"]


def test_flows(spark, tmp_path):
    from sluicewire.operators.flows import flows

    def tcp(src, dst, sport, dport, seq, flags, body=b""):
        f = bytearray(frame(6, src, dst, body, sport, dport))
        f[14 + 20 + 4 : 14 + 20 + 8] = seq.to_bytes(4)
        f[14 + 20 + 13] = flags
        return bytes(f)

    c, s = "10.0.0.9", "10.0.0.1"
    ms = 10**6
    sent = [
        (1 * ms, tcp(c, s, 5000, 80, 1, 0x02)), (4 * ms, tcp(s, c, 80, 5000, 9, 0x12)), (5 * ms, tcp(c, s, 5000, 80, 2, 0x10)),
        (6 * ms, tcp(c, s, 5000, 80, 2, 0x18, b"ask")), (9 * ms, tcp(c, s, 5000, 80, 2, 0x18, b"ask")), (10 * ms, tcp(c, s, 5000, 80, 2, 0x18, b"ask")),
        (12 * ms, tcp(s, c, 80, 5000, 2, 0x18, b"ask")), (2 * ms, frame(17, c, s, b"q", 7000, 53)), (8 * ms, frame(17, s, c, b"r", 53, 7000)), (3 * ms, frame(1, s, c)),
    ]
    (tmp_path / "a.pcap").write_bytes(write_pcap(sent))
    got = {r["data"]["protocol"]: r for r in flows(read_pcap(spark, str(tmp_path))).collect()}
    t = got["tcp"]["data"]
    assert (tuple(t["client"]), tuple(t["server"]), t["packets"], t["latency_ms"], t["duration_ms"], t["tcp"]["retransmits"]) == ((c, 5000), (s, 80), 7, 3.0, 11.0, 2)
    assert got["udp"]["data"]["latency_ms"] == 6.0 and got["udp"]["data"]["tcp"]["retransmits"] == 0
    assert got["icmp"]["data"]["latency_ms"] is None and tuple(got["icmp"]["data"]["client"])[0] == s
    slow = query(flows(read_pcap(spark, str(tmp_path))), "network.latency_ms > 2 AND network.tcp.retransmits >= 2 | show network.tcp.retransmits")
    assert [r[0] for r in slow.collect()] == [2]
    assert flows(read_pcap(spark, str(tmp_path)).where("false")).count() == 0


def test_live_packets(spark):
    import socket
    import time

    from sluicewire.sources.pcap import stream_live
    from sluicewire.sources.pcap_format import COLUMNS
    from sluicewire.sources.received import LiveReader

    r = LiveReader({"interface": "lo"})
    try:
        r.initialOffset()
    except OSError as e:
        pytest.skip(f"no raw socket here: {e}")
    out = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
    mine = b"a payload of this test"
    found = []
    for _ in range(100):
        out.sendto(mine, ("127.0.0.1", 39_999))
        time.sleep(0.02)
        rows, end = r.read({"row": 0})
        found = [d for d in (dict(zip([n for n, _ in COLUMNS], x, strict=True)) for x in rows) if d["payload"] == mine]
        if found:
            break
    assert (found[0]["protocol"], found[0]["udp_dst_port"], found[0]["ip_dst"], found[0]["interface"]) == ("udp", 39_999, "127.0.0.1", "lo")
    stream = stream_live(spark, "lo", "udp dst port 39999")
    assert stream.columns == ["type", "timestamp_ns", "ts", "source", "data"]
    seen = []
    running = stream.writeStream.foreachBatch(lambda d, i: seen.extend(bytes(r["data"]["payload"]) for r in d.collect())).start()
    try:
        for _ in range(100):
            out.sendto(mine, ("127.0.0.1", 39_999))
            time.sleep(0.1)
            if seen:
                break
    finally:
        running.stop()
    assert set(seen) == {mine}


@pytest.mark.parametrize("size", [64, 1 << 22])
def test_bulk_decoding_equals_one_packet_at_a_time(monkeypatch, size):
    import io
    import random

    from sluicewire.sources import bulk

    rng = random.Random(size)
    frames = []
    for i in range(400):
        f = bytearray(frame(rng.choice([6, 17, 1, 47]), "10.0.0.%d" % rng.randrange(256), "1.2.3.4", rng.randbytes(rng.randrange(80)), rng.randrange(65536), rng.randrange(65536)))
        if rng.random() < 0.3:
            f[12:12] = b"\x81\x00\x00\x05"
        for _ in range(rng.choice([0, 0, 1, 3])):
            f[rng.randrange(len(f))] = rng.randrange(256)
        frames.append((rng.randrange(10**18), bytes(f[: rng.choice([len(f), rng.randrange(len(f) + 1)])])))
    data = write_pcap(frames)
    monkeypatch.setattr(bulk, "BLOCK", size)
    for swap in (False, True):
        if swap:  # the other byte order, in microseconds
            data = struct.pack(">IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1) + b"".join(struct.pack(">IIII", ns // 10**9, ns % 10**9 // 1000, len(f), len(f) + 7) + f for ns, f in frames)
        want = [(ns, {"interface": "x"} | f) for ns, f in packets(data, "x")]
        got = []
        for times, columns in bulk.decoded(io.BytesIO(data), "x", []):
            assert [str(c.type) for c in columns.values()] == [{"long": "int64", "boolean": "bool"}.get(t, t) for _, t in bulk.FIELDS]
            got += [(t, {k: v for k, v in zip(columns, row, strict=True) if v is not None}) for t, *row in zip(times.to_pylist(), *(c.to_pylist() for c in columns.values()), strict=True)]
        assert got == [(ns, {k: v for k, v in f.items() if v is not None}) for ns, f in want]
        some = [(("tcp_dst_port", "udp_dst_port"), (next(f["tcp_dst_port"] for _, f in want if f.get("protocol") == "tcp"),)), (("protocol",), ("tcp", "udp"))]
        kept = sum(len(t) for t, _ in bulk.decoded(io.BytesIO(data), "x", some))
        assert kept == sum(any(f.get(n) in v for n in some[0][0] for v in [some[0][1]]) and f.get("protocol") in ("tcp", "udp") for _, f in want) > 0
    assert list(bulk.decoded(io.BytesIO(write_pcap([])), None, [])) == []
    cut = write_pcap(frames[:3])[:-5]
    assert sum(len(t) for t, _ in bulk.decoded(io.BytesIO(cut), None, [])) == 2
