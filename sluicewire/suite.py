"""The queries that cover the engine's own operators, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lang import parse
from .operators.correlation import correlate_frames, log_network
from .plans import query, to_payload
from .sources.formats import parse_lines

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn

    return add


def text_query(name: str, source: str, text: str, sql: str, finish: Callable[[DataFrame], DataFrame] = lambda d: d, **options) -> None:
    """A query of the language over one table."""
    register(name, sql)(lambda spark, sf_dir: finish(query(table(spark, sf_dir, source), text, **options)))


def rounded(*cols: str, digits: int = 6) -> Callable[[DataFrame], DataFrame]:
    """Sums of doubles depend on the order in which they are added, so both sides round."""
    return lambda d: d.withColumns({c: F.round(F.col(f"`{c}`"), digits) for c in cols})


HOUR_US = 3_600_000_000

# predicates and projection

text_query("filter_eq", "events", 'event_type == "error"', "SELECT * FROM events WHERE event_type = 'error'")
text_query("filter_bareword", "events", "event_type == purchase", "SELECT * FROM events WHERE event_type = 'purchase'")
text_query("filter_ne", "orders", 'o_orderstatus != "O"', "SELECT * FROM orders WHERE o_orderstatus <> 'O'")
text_query("filter_num", "orders", "o_totalprice >= 150000.5 AND o_orderkey < 9000", "SELECT * FROM orders WHERE o_totalprice >= 150000.5 AND o_orderkey < 9000")
text_query("filter_int_real", "part", "p_size == 5.0 OR p_size <= 2", "SELECT * FROM part WHERE p_size = 5 OR p_size <= 2")
text_query("filter_bool", "events", "(event_type == error OR event_type == click) AND value > 50", "SELECT * FROM events WHERE event_type IN ('error', 'click') AND value > 50")
text_query("filter_precedence", "events", "event_type == error OR event_type == click AND value > 50", "SELECT * FROM events WHERE event_type = 'error' OR (event_type = 'click' AND value > 50)")
text_query("filter_not", "events", 'NOT (event_type == "view" OR value < 20)', "SELECT * FROM events WHERE NOT (event_type = 'view' OR value < 20)")
text_query("filter_not_missing", "events", 'NOT absent == "x" AND user_id < 20', "SELECT * FROM events WHERE user_id < 20")
text_query("filter_type_mismatch", "events", 'value == "10" OR event_type >= 5', "SELECT * FROM events WHERE false")
text_query("filter_in", "events", 'event_type in ("signup", purchase) AND user_id in [1, 2, 3, 4, 5]', "SELECT * FROM events WHERE event_type IN ('signup', 'purchase') AND user_id IN (1, 2, 3, 4, 5)")
text_query("filter_contains", "part", 'p_type contains "A"', "SELECT * FROM part WHERE contains(p_type, 'A')")
text_query("filter_regex", "customer", "c_name =~ /customer#0*1[0-9]$/i OR c_mktsegment =~ \"^BUILD\"", "SELECT * FROM customer WHERE regexp_matches(c_name, 'customer#0*1[0-9]$', 'i') OR regexp_matches(c_mktsegment, '^BUILD')")
text_query("filter_regex_not", "part", "p_brand !~ /[12]$/", "SELECT * FROM part WHERE NOT regexp_matches(p_brand, '[12]$')")
text_query("filter_exists", "events", "props != null AND value", "SELECT * FROM events WHERE props IS NOT NULL AND value IS NOT NULL")
text_query("filter_severity", "events", "event_type >= WARN", "SELECT * FROM events WHERE event_type = 'error'")
text_query("show_fields", "events", "show event_id, event_type, absent where value > 90", "SELECT event_id, event_type, CAST(NULL AS VARCHAR) AS absent FROM events WHERE value > 90")
text_query("show_all", "supplier", "* where s_acctbal > 0", "SELECT * FROM supplier WHERE s_acctbal > 0")

# aggregation

text_query("agg_global", "lineitem", "aggregate count(), sum(l_quantity), min(l_shipdate), max(l_extendedprice)", "SELECT count(*) AS count, round(sum(l_quantity), 6) AS l_quantity, CAST(0.0 AS DOUBLE) AS min_l_shipdate, max(l_extendedprice) AS max_l_extendedprice FROM lineitem", rounded("l_quantity"))
text_query(
    "agg_group",
    "lineitem",
    "aggregate count(), sum(l_quantity), avg(l_extendedprice), min(l_discount), max(l_tax) by l_returnflag, l_linestatus where l_quantity > 10",
    "SELECT l_returnflag, l_linestatus, count(*) AS count, round(sum(l_quantity), 4) AS l_quantity, round(avg(l_extendedprice), 4) AS avg_l_extendedprice, min(l_discount) AS min_l_discount, max(l_tax) AS max_l_tax FROM lineitem WHERE l_quantity > 10 GROUP BY ALL",
    rounded("l_quantity", "avg_l_extendedprice", digits=4),
)
text_query("agg_empty", "events", 'aggregate count(), avg(value) where event_type == "none"', "SELECT count(*) AS count, avg(value) AS avg_value FROM events WHERE false HAVING count(*) > 0")
text_query(
    "agg_percentile",
    "events",
    "aggregate percentile(value, 95), percentile(value, 50), percentile(value, 99.9), count() by event_type",
    "SELECT event_type, list_sort(list(value))[least(CAST(floor(95::DOUBLE / 100 * count(*)) AS BIGINT), count(*) - 1) + 1] AS p95_value, list_sort(list(value))[least(CAST(floor(50::DOUBLE / 100 * count(*)) AS BIGINT), count(*) - 1) + 1] AS p50_value, list_sort(list(value))[least(CAST(floor(99.9::DOUBLE / 100 * count(*)) AS BIGINT), count(*) - 1) + 1] AS p99_9_value, count(*) AS count FROM events GROUP BY event_type",
)
text_query("agg_distinct", "events", "aggregate distinct(user_id), distinct(props) by event_type", "SELECT event_type, count(DISTINCT user_id) AS distinct_user_id, count(DISTINCT props) AS distinct_props FROM events GROUP BY event_type")


@register(
    "agg_missing_zero",
    "SELECT event_type, count(*) AS count, round(sum(CAST(props->>'k' AS DOUBLE)), 6) AS \"props.k\", CAST(0 AS DOUBLE) AS avg_absent, CAST(0 AS DOUBLE) AS min_event_type FROM events GROUP BY event_type",
)
def agg_missing_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("props", F.try_parse_json("props"))
    return query(events, "aggregate count(), sum(props.k), avg(absent), min(event_type) by event_type").withColumn("props.k", F.round("`props.k`", 6))


_CLASH = "SELECT event_type AS _window, user_id % 3 AS x, value AS k0, ts FROM events"


@register(
    "agg_names",
    f"SELECT _window, x, make_timestamp(epoch_us(ts) // {HOUR_US * 24} * {HOUR_US * 24}) AS window_start, make_timestamp(epoch_us(ts) // {HOUR_US * 24} * {HOUR_US * 24} + {HOUR_US * 24}) AS window_end, count(*) AS count, list_sort(list(k0))[least(CAST(floor(0.5::DOUBLE * count(*)) AS BIGINT), count(*) - 1) + 1] AS p50_k0, max(k0) AS max_k0 FROM ({_CLASH}) GROUP BY ALL",
)
def agg_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that are called like those inside the operator."""
    events = table(spark, sf_dir, "events").selectExpr("event_type AS _window", "user_id % 3 AS x", "value AS k0", "ts")
    return query(events, "aggregate count(), percentile(k0, 50), max(k0) by _window, x window 24h")


text_query("agg_having", "events", "aggregate count(), avg(value) by user_id | count > 60 | show user_id, count", "SELECT user_id, count(*) AS count FROM events GROUP BY user_id HAVING count(*) > 60")

# windows

text_query(
    "win_tumbling",
    "events",
    "aggregate count(), sum(value) by event_type window 1h",
    f"SELECT event_type, make_timestamp(epoch_us(ts) // {HOUR_US} * {HOUR_US}) AS window_start, make_timestamp(epoch_us(ts) // {HOUR_US} * {HOUR_US} + {HOUR_US}) AS window_end, count(*) AS count, round(sum(value), 6) AS value FROM events GROUP BY ALL",
    rounded("value"),
)
text_query(
    "win_sliding",
    "events",
    "aggregate count(), max(value) window sliding(1h, 10m)",
    f"SELECT make_timestamp(s) AS window_start, make_timestamp(s + {HOUR_US}) AS window_end, count(*) AS count, max(value) AS max_value FROM (SELECT value, (epoch_us(ts) // 600000000 - i) * 600000000 AS s FROM events, range(6) t(i)) GROUP BY s",
)
text_query(
    "win_hopping",
    "events",
    "aggregate count() by event_type window sliding(10m, 1h)",
    f"SELECT event_type, make_timestamp(s) AS window_start, make_timestamp(s + 600000000) AS window_end, count(*) AS count FROM (SELECT event_type, ts, epoch_us(ts) // {HOUR_US} * {HOUR_US} AS s FROM events) WHERE epoch_us(ts) - s < 600000000 GROUP BY ALL",
)
_SESSIONS = "SELECT user_id, ts, value, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM (SELECT user_id, ts, value, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 1800000000 THEN 0 ELSE 1 END AS n FROM events)"
text_query(
    "win_session",
    "events",
    "aggregate count(), avg(value) by user_id window session(30m)",
    f"SELECT user_id, min(ts) AS window_start, max(ts) + INTERVAL 30 MINUTE AS window_end, count(*) AS count, round(avg(value), 6) AS avg_value FROM ({_SESSIONS}) GROUP BY user_id, sid",
    rounded("avg_value"),
)
text_query(
    "win_session_percentile",
    "events",
    "aggregate count(), percentile(value, 50) by user_id window session(30m)",
    f"SELECT user_id, min(ts) AS window_start, max(ts) + INTERVAL 30 MINUTE AS window_end, count(*) AS count, list_sort(list(value))[least(CAST(floor(0.5::DOUBLE * count(*)) AS BIGINT), count(*) - 1) + 1] AS p50_value FROM ({_SESSIONS}) GROUP BY user_id, sid",
)
text_query(
    "win_percentile",
    "events",
    "aggregate percentile(value, 90) by event_type window tumbling(24h)",
    "SELECT event_type, make_timestamp(epoch_us(ts) // 86400000000 * 86400000000) AS window_start, make_timestamp(epoch_us(ts) // 86400000000 * 86400000000 + 86400000000) AS window_end, list_sort(list(value))[least(CAST(floor(90::DOUBLE / 100 * count(*)) AS BIGINT), count(*) - 1) + 1] AS p90_value FROM events GROUP BY ALL",
)
@register(
    "agg_running",
    "SELECT event_id, user_id, count(*) OVER w AS count, round(sum(value) OVER w, 6) AS value, min(value) OVER w AS min_value FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
)
def agg_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value", F.col("event_id").alias("seq"))
    out = query(events, "aggregate count(), sum(value), min(value) by user_id", running=True)
    return out.select("event_id", "user_id", "count", F.round("value", 6).alias("value"), "min_value")


# correlation


def _flat(d: DataFrame) -> DataFrame:
    return d.select(F.col("left_event.event_id").alias("left_id"), F.col("right_event.event_id").alias("right_id"), "time_diff_ms", "window_ms", "ts")


def _band(left: str, right: str, us: int, more: str = "") -> str:
    return f"SELECT l.event_id AS left_id, r.event_id AS right_id, (epoch_us(l.ts) - epoch_us(r.ts)) / 1000.0::DOUBLE AS time_diff_ms, CAST({us // 1000} AS BIGINT) AS window_ms, greatest(l.ts, r.ts) AS ts FROM events l JOIN events r ON abs(epoch_us(l.ts) - epoch_us(r.ts)) <= {us}{more} WHERE {left} AND {right}"


text_query("correlate_band", "events", "correlate event_type == error with event_type == click within 60s", _band("l.event_type = 'error'", "r.event_type = 'click'", 60_000_000), _flat)
text_query("correlate_self", "events", "correlate event_type == error with value > 120 within 1m", _band("l.event_type = 'error'", "r.value > 120", 60_000_000), _flat)
text_query("correlate_zero", "events", "correlate event_type == error with value > 120 within 0ms", _band("l.event_type = 'error'", "r.value > 120", 0), _flat)
text_query("correlate_default", "events", "correlate value > 10 with value <= 150", _band("l.value > 10", "r.value <= 150", 100_000), _flat)
text_query("correlate_id", "events", "correlate event_type == signup with event_type == purchase within 12h on user_id == user_id", _band("l.event_type = 'signup'", "r.event_type = 'purchase'", 12 * HOUR_US, " AND l.user_id = r.user_id"), _flat)
text_query(
    "sequence_band",
    "events",
    "correlate event_type == error followed by event_type == click within 5m",
    "SELECT l.event_id AS left_id, r.event_id AS right_id, (epoch_us(l.ts) - epoch_us(r.ts)) / 1000.0::DOUBLE AS time_diff_ms, CAST(300000 AS BIGINT) AS window_ms, greatest(l.ts, r.ts) AS ts FROM events l JOIN events r ON epoch_us(r.ts) - epoch_us(l.ts) BETWEEN 0 AND 300000000 WHERE l.event_type = 'error' AND r.event_type = 'click'",
    _flat,
)


@register(
    "correlate_connection",
    "SELECT l.event_id AS left_id, r.event_id AS right_id, (epoch_us(l.ts) - epoch_us(r.ts)) / 1000.0::DOUBLE AS time_diff_ms FROM events l JOIN events r ON abs(epoch_us(l.ts) - epoch_us(r.ts)) <= 86400000000 AND l.user_id = r.user_id AND l.props = r.props WHERE l.event_type = 'view' AND r.event_type = 'click'",
)
def correlate_connection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(query(table(spark, sf_dir, "events"), "correlate event_type == view with event_type == click within 24h on user_id, props")).select("left_id", "right_id", "time_diff_ms")


def _typed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an envelope of logs and packets."""
    e = table(spark, sf_dir, "events")
    return e.select(F.when(F.col("event_type").isin("error", "view"), "log").when(F.col("event_type") == "click", "network").alias("type"), F.col("ts").cast("timestamp").alias("ts"), F.struct("event_id", F.col("event_type").alias("level"), F.col("value").alias("tcp_dst_port")).alias("data"))


@register(
    "correlate_log_network",
    "SELECT l.event_id AS log_id, r.event_id AS network_id, 'time_based' AS correlation_type, CAST(60000 AS BIGINT) AS window_ms, (epoch_us(l.ts) - epoch_us(r.ts)) / 1000.0::DOUBLE AS time_diff_ms FROM events l JOIN events r ON abs(epoch_us(l.ts) - epoch_us(r.ts)) <= 60000000 WHERE l.event_type IN ('error', 'view') AND r.event_type = 'click'",
)
def correlate_log_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_network(_typed_events(spark, sf_dir), 60_000).select(F.col("log.data.event_id").alias("log_id"), F.col("network.data.event_id").alias("network_id"), "correlation_type", "window_ms", "time_diff_ms")


@register(
    "correlate_frames",
    "SELECT l.event_id AS left_id, o.o_orderkey AS right_id, (epoch_us(l.ts) - epoch_us(o.o_orderdate)) / 1000.0::DOUBLE AS time_diff_ms FROM (SELECT event_id, ts - INTERVAL 9131 DAY AS ts FROM events) l JOIN orders o ON abs(epoch_us(l.ts) - epoch_us(o.o_orderdate)) <= 600000000",
)
def correlate_two_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "events").select("event_id", (F.col("ts") - F.expr("INTERVAL 9131 DAY")).alias("ts"))
    right = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("ts"))
    return correlate_frames(left, right, 600_000).select(F.col("left_event.event_id").alias("left_id"), F.col("right_event.o_orderkey").alias("right_id"), "time_diff_ms")


@register(
    "field_aliases",
    "SELECT event_id, event_type AS \"log.level\", CASE WHEN event_type = 'click' THEN value END AS \"network.dst_port\" FROM events WHERE event_type = 'error' OR (event_type = 'click' AND value > 100)",
)
def field_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``log.x`` and ``network.x`` over an envelope, with the role names of packet fields."""
    out = query(_typed_events(spark, sf_dir), "log.level == error OR network.dst_port > 100 | show data.event_id, log.level, network.dst_port")
    return out.select(F.col("`data.event_id`").alias("event_id"), F.coalesce("`log.level`", F.when(F.col("`network.dst_port`").isNotNull(), F.lit("click"))).alias("log.level"), F.col("`network.dst_port`"))


# pipelines

text_query("pipeline_filter_agg", "events", "event_type == error AND value > 10 | aggregate count(), avg(value) by user_id", "SELECT user_id, count(*) AS count, round(avg(value), 6) AS avg_value FROM events WHERE event_type = 'error' AND value > 10 GROUP BY user_id", rounded("avg_value"))
text_query("pipeline_corr_agg", "events", "correlate event_type == error with event_type == click within 60s | aggregate count(), max(time_diff_ms) by left_event.user_id", "SELECT l.user_id AS \"left_event.user_id\", count(*) AS count, max((epoch_us(l.ts) - epoch_us(r.ts)) / 1000.0::DOUBLE) AS max_time_diff_ms FROM events l JOIN events r ON abs(epoch_us(l.ts) - epoch_us(r.ts)) <= 60000000 WHERE l.event_type = 'error' AND r.event_type = 'click' GROUP BY l.user_id")
text_query(
    "pipeline_topk",
    "events",
    "value > 1 | aggregate count(), percentile(value, 95) by user_id | top(10) by percentile(value, 95)",
    "SELECT user_id, count(*) AS count, list_sort(list(value))[least(CAST(floor(95::DOUBLE / 100 * count(*)) AS BIGINT), count(*) - 1) + 1] AS p95_value FROM events WHERE value > 1 GROUP BY user_id ORDER BY p95_value DESC, user_id LIMIT 10",
)
text_query("pipeline_order_limit", "events", "aggregate count(), max(value) by user_id | order by count desc, user_id | limit 7", "SELECT user_id, count(*) AS count, max(value) AS max_value FROM events GROUP BY user_id ORDER BY count DESC, user_id LIMIT 7")
text_query("pipeline_three", "lineitem", "l_discount > 0.02 | aggregate sum(l_extendedprice), count() by l_suppkey | top(5) by count | show l_suppkey, count", "SELECT l_suppkey, count(*) AS count FROM lineitem WHERE l_discount > 0.02 GROUP BY l_suppkey ORDER BY count DESC, l_suppkey LIMIT 5")

# payloads


@register(
    "payload_aggregation",
    "SELECT 'log' AS type, CAST(NULL AS BIGINT) AS timestamp_ns, '{\"nql_result_type\":\"aggregation\",\"group\":{\"event_type\":\"' || event_type || '\"},\"metrics\":{\"count\":' || count(*) || ',\"distinct_user_id\":' || count(DISTINCT user_id) || '}}' AS data FROM events GROUP BY event_type",
)
def payload_aggregation(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "aggregate count(), distinct(user_id) by event_type"
    return to_payload(query(table(spark, sf_dir, "events"), text), parse(text).stages[-1])


# parsers: lines rendered from tables, and parsed back


@register("parse_json", "SELECT event_id, CAST(props->>'k' AS BIGINT) AS k FROM events WHERE CAST(props->>'k' AS BIGINT) >= 50")
def parse_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "events").select("event_id", F.col("props").alias("value"))
    parsed = parse_lines(lines, "json", keep=["event_id"])
    return query(parsed, "log.k >= 50 | show event_id, k").select("event_id", F.col("k").cast("long").alias("k"))


@register("parse_json_broken", "SELECT event_id, '{\"id\": ' || event_id AS message FROM events WHERE event_id % 7 = 0")
def parse_json_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 7 == 0, F.concat(F.lit('{"id": '), F.col("event_id"))).otherwise(F.col("props")).alias("value"))
    return query(parse_lines(lines, "json", keep=["event_id"]), "show event_id, message where message != null")


@register(
    "parse_logfmt",
    "SELECT event_id, event_type AS level, user_id AS uid, CASE WHEN value = floor(value) THEN value ELSE value END AS latency, 'a b' AS note, event_id % 2 = 0 AS ok FROM events",
)
def parse_logfmt(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    lines = e.select("event_id", F.concat(F.lit("bare level="), "event_type", F.lit(" uid="), "user_id", F.lit(" latency="), F.col("value").cast("decimal(18,2)").cast("string"), F.lit(' note="a b" ok='), (F.col("event_id") % 2 == 0).cast("string"), F.lit(" ")).alias("value"))
    parsed = parse_lines(lines, "logfmt", keep=["event_id"])
    get = lambda k, t: F.try_variant_get("data", f"$.{k}", t).alias(k)
    return parsed.select("event_id", get("level", "string"), get("uid", "long"), get("latency", "double"), get("note", "string"), get("ok", "boolean"))


@register(
    "parse_nginx",
    "SELECT event_id, '10.0.0.' || (user_id % 250) AS remote_addr, CASE WHEN event_id % 3 <> 0 THEN 'u' || user_id END AS remote_user, 'GET' AS method, '/p/' || event_id AS path, 'HTTP/1.1' AS protocol, 200 + event_id % 300 AS status, event_id * 10 AS body_bytes_sent, CASE WHEN event_id % 2 = 0 THEN 'http://x/' END AS http_referer, 'curl/8' AS http_user_agent FROM events",
)
def parse_nginx(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    line = F.concat(F.lit("10.0.0."), F.col("user_id") % 250, F.lit(" - "), F.when(i % 3 != 0, F.concat(F.lit("u"), "user_id")).otherwise("-"), F.lit(" [10/Oct/2024:13:55:36 +0000] \"GET /p/"), i, F.lit(' HTTP/1.1" '), 200 + i % 300, F.lit(" "), i * 10, F.lit(' "'), F.when(i % 2 == 0, "http://x/").otherwise("-"), F.lit('" "curl/8"'))
    parsed = parse_lines(e.select("event_id", line.alias("value")), "nginx", keep=["event_id"])
    get = lambda k, t="string": F.try_variant_get("data", f"$.{k}", t).alias(k)
    return parsed.select("event_id", *map(get, ("remote_addr", "remote_user", "method", "path", "protocol")), get("status", "long"), get("body_bytes_sent", "long"), get("http_referer"), get("http_user_agent"))


@register(
    "parse_syslog",
    "SELECT event_id, event_id % 192 AS priority, event_id % 192 // 8 AS facility, event_id % 8 AS severity, 'host' || user_id AS hostname, CASE WHEN event_id % 2 = 0 THEN 'su: ' ELSE '' END || event_type AS message, CASE WHEN event_id % 2 = 0 THEN epoch_us(TIMESTAMP '2024-10-11 22:14:15') // 1000000 ELSE epoch_us(ts) // 1000000 END AS at FROM events",
)
def parse_syslog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RFC 3164 for even and RFC 5424 for odd ids."""
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    old = F.concat(F.lit("<"), i % 192, F.lit(">Oct 11 22:14:15 host"), "user_id", F.lit(" su: "), "event_type")
    new = F.concat(F.lit("<"), i % 192, F.lit(">1 "), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.lit(" host"), "user_id", F.lit(" app 12 ID7 - "), "event_type")
    parsed = parse_lines(e.select("event_id", F.when(i % 2 == 0, old).otherwise(new).alias("value")), "syslog", keep=["event_id"], year=2024)
    get = lambda k, t, a: F.try_variant_get("data", f"$.{k}", t).alias(a)
    return parsed.select("event_id", get("syslog_priority", "long", "priority"), get("syslog_facility", "long", "facility"), get("syslog_severity", "long", "severity"), get("hostname", "string", "hostname"), get("message", "string", "message"), get("timestamp", "long", "at"))


@register(
    "parse_regex",
    "SELECT event_id, event_type AS kind, CAST(user_id AS VARCHAR) AS uid FROM events",
)
def parse_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("["), "event_type", F.lit("] user="), "user_id", F.lit(";")).alias("value"))
    parsed = parse_lines(lines, "regex", keep=["event_id"], pattern=r"\[(?P<kind>\w+)\] user=(?P<uid>\d+);(?P<rest>.*)")
    get = lambda k: F.try_variant_get("data", f"$.{k}", "string").alias(k)
    return parsed.select("event_id", get("kind"), get("uid"))


@register(
    "union_inputs",
    "SELECT type, count(*) AS count FROM (SELECT 'log' AS type FROM events WHERE event_type = 'error' UNION ALL SELECT 'network' AS type FROM events WHERE event_type = 'click') GROUP BY type",
)
def union_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .engine import union_events

    e = table(spark, sf_dir, "events")
    logs = query(e, "event_type == error").select(F.lit("log").alias("type"), "ts", "event_type")
    packets = query(e, "event_type == click").select(F.lit("network").alias("type"), "ts", "value")
    return query(union_events(logs, packets), "aggregate count() by type")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors by user and hour."""
    return query(table(spark, sf_dir, "events"), 'event_type == "error" | aggregate count(), avg(value) by user_id window 1h')


register(
    "flagship",
    f"SELECT user_id, make_timestamp(epoch_us(ts) // {HOUR_US} * {HOUR_US}) AS window_start, make_timestamp(epoch_us(ts) // {HOUR_US} * {HOUR_US} + {HOUR_US}) AS window_end, count(*) AS count, round(avg(value), 6) AS avg_value FROM events WHERE event_type = 'error' GROUP BY ALL",
)(lambda spark, sf_dir: rounded("avg_value")(flagship(spark, sf_dir)))

# these import this module's registry
from . import suite_io  # noqa: E402, F401
