import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sluicewire.lang import parse
from sluicewire.operators import aggregates
from sluicewire.plans import query, to_json_lines, to_payload

T0 = dt.datetime(2024, 1, 1)


def at(ms):
    return T0 + dt.timedelta(milliseconds=ms)


@pytest.fixture(scope="module")
def variant(spark):
    """Dynamic payloads: flat dotted keys, nested ones, other types, nulls."""
    rows = ['{"log.level":"ERROR","n":5}', '{"log":{"level":"INFO"},"n":5.0}', '{"n":"5"}', '{"n":null,"ok":true}', '{"level":"warn","s":"a timeout b"}']
    return spark.createDataFrame([("log", i, r) for i, r in enumerate(rows)], "type string, i int, j string").select("type", "i", F.parse_json("j").alias("data"))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("log.level == ERROR", [0]),
        ("log.level == INFO", [1]),
        ("log.level == warn", [4]),
        ("log.level >= WARN", [0, 4]),
        ("n == 5", [0, 1]),
        ('n == "5"', [2]),
        ("n != 5", [2, 3]),
        ("n > 4.5", [0, 1]),
        ("n in (5, 7)", [0, 1]),
        ("NOT n == 5", [2, 3, 4]),
        ("NOT absent == 5", [0, 1, 2, 3, 4]),
        ("absent != 5", []),
        ("n != null", [0, 1, 2]),
        ("n == null", [3, 4]),
        ("ok == true", [3]),
        ("s =~ /TIME/i", [4]),
        ("s !~ /time/", []),
        ("n !~ /x/", [2]),
        ('s contains "time"', [4]),
        ("NOT (n == 5 AND log.level == ERROR) and n == 5", [1]),
    ],
)
def test_predicates_on_dynamic_fields(variant, text, want):
    assert sorted(r["i"] for r in query(variant, text).collect()) == want


def test_scan_takes_the_predicate(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).select("id", F.col("id").cast("string").alias("s"), F.lit(1).alias("z")).write.parquet(path)
    out = query(spark.read.parquet(path), 'id > 3 AND s == "5" | show s')
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,3)" in plan and "EqualTo(s,5)" in plan and "z:" not in plan
    assert [r[0] for r in out.collect()] == ["5"]


@pytest.fixture(scope="module")
def calls(spark):
    rows = [("api", "ERROR", at(100), 10.0), ("api", "ERROR", at(500), 20.0), ("api", "ERROR", at(900), 30.0), ("db", "INFO", at(1500), None)]
    return spark.createDataFrame(rows, "service string, level string, ts timestamp, ms double")


def test_tumbling(calls):
    got = query(calls, 'aggregate count(), avg(ms) by service where level == "ERROR" window tumbling(1s)').collect()
    assert [(r["service"], r["count"], r["avg_ms"], r["window_start"], r["window_end"]) for r in got] == [("api", 3, 20.0, T0, at(1000))]


def test_sliding_and_gapped_windows(calls, spark):
    one = spark.createDataFrame([(at(1200),)], "ts timestamp")
    assert sorted(r["window_start"] for r in query(one, "aggregate count() window sliding(1s, 500ms)").collect()) == [at(500), at(1000)]
    got = query(calls, "aggregate count() window sliding(200ms, 500ms)").collect()
    assert sorted((r["window_start"], r["count"]) for r in got) == [(T0, 1), (at(500), 1), (at(1500), 1)]


def test_session_gap_is_strict(spark):
    def sessions(*seconds):
        df = spark.createDataFrame([(at(1000 * s),) for s in seconds], "ts timestamp")
        return sorted((r["window_start"], r["window_end"], r["count"]) for r in query(df, "aggregate count() window session(30s)").collect())

    assert sessions(0, 5) == [(T0, at(35_000), 2)]
    assert sessions(0, 30) == [(T0, at(30_000), 1), (at(30_000), at(60_000), 1)]


def test_sessions_equal_a_lag_over_the_events(spark):
    rng = random.Random(3)
    times = sorted(rng.randrange(0, 100_000) for _ in range(300))
    df = spark.createDataFrame([(at(t), float(t % 17)) for t in times], "ts timestamp, v double")
    want, group = [], [times[0]]
    for t in [*times[1:], None]:
        if t is not None and t - group[-1] < 500:
            group.append(t)
        else:
            values = sorted(float(x % 17) for x in group)
            want.append((at(group[0]), at(group[-1] + 500), len(group), values[min(len(values) // 2, len(values) - 1)]))
            group = [t]
    got = query(df, "aggregate count(), percentile(v, 50) window session(500ms)").collect()
    assert sorted(map(tuple, (r.asDict().values() for r in got))) == want


def test_functions_are_independent_and_missing_counts_as_zero(calls):
    r = query(calls, "aggregate count(), sum(ms), avg(ms), min(ms), max(ms), sum(service)").collect()[0].asDict()
    assert r == {"count": 4, "ms": 60.0, "avg_ms": 15.0, "min_ms": 0.0, "max_ms": 30.0, "service": 0.0}


@pytest.mark.parametrize("limit", [aggregates.SORTED_BYTES, 0])
def test_percentile_is_by_index(spark, monkeypatch, limit):
    monkeypatch.setattr(aggregates, "SORTED_BYTES", limit)
    df = spark.createDataFrame([(float(i), i % 2) for i in range(1, 21)], "v double, k int")
    assert query(df, "aggregate percentile(v, 95), percentile(v, 0), percentile(v, 100)").collect()[0][:] == (20.0, 1.0, 20.0)
    got = query(df.unionByName(df.where("v < 4")), "aggregate count(), percentile(v, 50) by k").collect()
    assert sorted(map(tuple, got)) == [(0, 11, 10.0), (1, 12, 9.0)]


@pytest.mark.parametrize("limit", [aggregates.SORTED_BYTES, 0])
def test_percentiles_of_many_values(spark, monkeypatch, limit):
    monkeypatch.setattr(aggregates, "SORTED_BYTES", limit)
    rng = random.Random(11)
    data = [(rng.choice([None, "a", "b"]), rng.choice([None, float(rng.randrange(40)), rng.gauss(0, 50)])) for _ in range(3000)]
    df = spark.createDataFrame(data, "k string, v double")
    want = []
    for k in (None, "a", "b"):
        values = sorted(v or 0.0 for g, v in data if g == k)
        want.append((k, *(values[min(int(p / 100 * len(values)), len(values) - 1)] for p in (0, 33, 95, 100))))
    got = query(df, "aggregate percentile(v, 0), percentile(v, 33), percentile(v, 95), percentile(v, 100) by k").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_no_rows_no_groups(calls):
    assert query(calls, 'aggregate count(), percentile(ms, 50) where level == "none"').collect() == []


def test_running(spark):
    df = spark.createDataFrame([(g, i, at(10 * i)) for g in range(3) for i in range(5)], "window int, i int, ts timestamp")
    got = query(df, "aggregate count(), percentile(i, 50) by window", running=True).collect()
    assert len(got) == 15 and sorted((r["window"], r["count"]) for r in got if r["count"] == 5) == [(0, 5), (1, 5), (2, 5)]


def pairs(spark, logs, nets, within="within 100ms", on=""):
    rows = [("log", at(t), i) for i, t in enumerate(logs)] + [("net", at(t), i) for i, t in enumerate(nets)]
    df = spark.createDataFrame(rows, "kind string, ts timestamp, i int")
    out = query(df, f'correlate kind == "log" with kind == "net" {within} {on}')
    return sorted((r["left_event"]["i"], r["right_event"]["i"], r["time_diff_ms"]) for r in out.collect())


def test_correlate(spark):
    assert pairs(spark, [0], [50]) == [(0, 0, -50.0)]
    assert pairs(spark, [50], [0]) == [(0, 0, 50.0)]
    assert pairs(spark, [0], [200]) == []
    assert pairs(spark, [0], [100]) == [(0, 0, -100.0)]
    assert pairs(spark, [0, 10, 20], [15], "") == [(0, 0, -15.0), (1, 0, -5.0), (2, 0, 5.0)]
    assert pairs(spark, [0, 1], [1, 0], "within 1s", "on i == i") == [(0, 0, -1.0), (1, 1, 1.0)]


def test_an_event_pairs_with_itself(spark):
    df = spark.createDataFrame([("x", at(0))], "k string, ts timestamp")
    assert query(df, "correlate k with k == x").count() == 1


def test_band_join_equals_nested_loops(spark):
    rng = random.Random(7)
    for w in (1, 7, 50):
        logs, nets = ([rng.randrange(-2000, 2000) for _ in range(80)] for _ in range(2))
        want = sorted((i, j, float(a - b)) for i, a in enumerate(logs) for j, b in enumerate(nets) if abs(a - b) <= w)
        assert pairs(spark, logs, nets, f"within {w}ms") == want


def test_nanoseconds_decide(spark):
    df = spark.createDataFrame([("a", 1_000_000_000_000, at(0)), ("b", 1_000_100_000_000, at(100)), ("b", 1_000_100_000_001, at(100))], "k string, timestamp_ns long, ts timestamp")
    assert query(df, "correlate k == a with k == b within 100ms").count() == 1


def test_no_nested_loop_join_in_the_plan(spark, calls):
    plan = query(calls, "correlate level == ERROR with level == INFO within 1s")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_stages_compose(spark, calls):
    got = query(calls, "correlate level == ERROR with level == INFO within 1s | aggregate count() by left_event.service")
    assert [tuple(r) for r in got.collect()] == [("api", 2)]
    got = query(calls, "ms > 5 | aggregate count(), percentile(ms, 95) by service | top(10) by percentile(ms, 95) | show p95_ms")
    assert [tuple(r) for r in got.collect()] == [(30.0,)]


def test_payloads(calls):
    text = "aggregate count(), avg(ms) by service, absent window 1s"
    lines = sorted(r[0] for r in to_json_lines(to_payload(query(calls, text), parse(text).stages[-1])).collect())
    assert lines[0] == '{"type":"log","timestamp_ns":1704067201000000000,"data":{"nql_result_type":"aggregation","group":{"service":"api","absent":"null"},"metrics":{"count":3,"avg_ms":20.0},"window":{"start_ns":1704067200000000000,"end_ns":1704067201000000000}}}'
    text = "aggregate count()"
    assert to_payload(query(calls, text), parse(text).stages[-1]).collect()[0]["data"] == '{"nql_result_type":"aggregation","metrics":{"count":4}}'
    text = "correlate level == ERROR with level == INFO within 600ms"
    got = to_payload(query(calls, text), parse(text).stages[-1]).collect()[0]
    assert got["type"] == "correlation" and got["timestamp_ns"] == 1704067201500000000 and '"time_diff_ms":-600.0' in got["data"]


def test_columns_may_be_called_like_those_inside(spark):
    df = spark.createDataFrame([(1, 1.0, "a", 2.0, 3.0), (1, 5.0, "a", 2.0, 4.0), (2, 3.0, None, 1.0, 5.0)], "k0 int, x double, w string, count double, m0 double").withColumn("ts", F.timestamp_seconds("m0"))
    for limit in (aggregates.SORTED_BYTES, 0):
        aggregates.SORTED_BYTES, before = limit, aggregates.SORTED_BYTES
        try:
            got = query(df, "aggregate percentile(x, 50), sum(m0), count() by k0, w").collect()
        finally:
            aggregates.SORTED_BYTES = before
        assert sorted(map(tuple, got), key=str) == [(1, "a", 5.0, 7.0, 2), (2, None, 3.0, 5.0, 1)]
    got = query(df, "aggregate percentile(x, 50) by w window session(10s)")
    assert got.columns == ["w", "window_start", "window_end", "p50_x"] and got.count() == 2
    run = query(df, "aggregate count(), sum(x) by k0", running=True)
    assert run.columns == ["k0", "w", "m0", "ts", "count", "x"] and sorted(r["count"] for r in run.collect()) == [1, 1, 2]


def test_running_aggregates_of_ranges_equal_those_of_whole_groups(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.randrange(400)), rng.choice(["hot", "hot", "hot", "a", None]), rng.choice([None, *map(float, range(9))])) for i in range(700)]
    df = spark.createDataFrame(rows, "seq long, ts timestamp, k string, v double")
    for by in ("", " by k"):
        text = f"aggregate count(), sum(v), avg(v), min(v), max(v), distinct(v), percentile(v, 50){by}"
        want = sorted(map(repr, query(df, text, running=True).collect()))
        with monkeypatch.context() as m:
            m.setattr(aggregates, "SORTED_BYTES", 0)
            m.setattr(aggregates, "RANGES", 16)
            assert sorted(map(repr, query(df, text, running=True).collect())) == want
    assert len(want) == 700
