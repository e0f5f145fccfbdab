"""Line formats as column expressions: each line becomes a VARIANT object.

A line that its format can't read becomes ``{"message": line}``; empty lines are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import quoted

#: Which part of a path tells its format, in the order tried; the extension comes first.
JSON_EXTENSIONS = (".json", ".jsonl")
PATH_HINTS = ("nginx", "syslog", "logfmt")


def detect_format(path: str) -> str:
    """json for its extensions, else the first hint in the path (in any case), else json."""
    low = path.lower()
    if low.endswith(JSON_EXTENSIONS):
        return "json"
    return next((h for h in PATH_HINTS if h in low), "json")


#: Stands between the groups of a matched line; a noncharacter, which text doesn't hold.
_CUT = "\uffff"
_NIL = ("", "-")


def _matched(line: Column, pattern: str, groups: int) -> Column:
    """The groups of a match of the whole line as an array, or null; the line is matched once."""
    got = F.split(F.regexp_replace(line, pattern, "".join(f"${i + 1}{_CUT}" for i in range(groups))), _CUT)
    return F.when(F.size(got) == groups + 1, got)


def _group(groups: Column, i: int, nothing: tuple[str, ...] = ("",)) -> Column:
    """Group ``i``, from one; null if it is one of ``nothing``."""
    got = F.get(groups, F.lit(i - 1))
    return F.when(~got.isin(*nothing), got)


def _object(*fields: Column) -> Column:
    """A VARIANT object of the fields that aren't null."""
    return F.parse_json(F.to_json(F.struct(*fields)))


class LineFormat:
    """How lines become VARIANT objects. ``parts`` are columns computed once a line, each from the line and those before it."""

    def __init__(self, parts: list[Callable[..., Column]], data: Callable[..., Column]):
        self.parts, self.data = parts, data


def json_format() -> LineFormat:
    """The object in the line; null for broken text, arrays and scalars."""
    return LineFormat([], lambda line: F.when(F.ltrim(line).startswith("{"), F.try_parse_json(line)))


_PAIR = r'([^\s="]++)=("(?:[^"\\]++|\\.)*+"|\S*+)'


def _unquoted(raw: Column) -> Column:
    return F.when(raw.startswith('"') & raw.endswith('"') & (F.length(raw) > 1), F.substring(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)


def _typed(text: Column) -> Column:
    """An integer, a real, a boolean or else a string; NaN and the infinities aren't reals."""
    as_text = text.cast("variant")
    real = F.when(text.rlike("[.eE]"), text.try_cast("double"))
    number = F.when(text.rlike(r"^-?\d{1,18}$"), text.try_cast("long").cast("variant")).when(F.abs(real) < float("inf"), real.cast("variant"))
    return F.when(text.rlike(r"^-?\d"), F.coalesce(number, as_text)).when(text.isin("true", "false"), text.cast("boolean").cast("variant")).otherwise(as_text)


def logfmt_format() -> LineFormat:
    """Typed pairs; bare words are skipped; the last of equal keys wins."""

    def last(line: Column, keys: Column, raws: Column) -> Column:
        """Where keys repeat: whether each pair is the last of its key."""
        return F.when(F.size(F.array_distinct(keys)) < F.size(keys), F.transform(keys, lambda k, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), k)))

    def data(line: Column, keys: Column, raws: Column, wins: Column) -> Column:
        def kept(values: Column) -> Column:
            return F.when(wins.isNull(), values).otherwise(F.filter(values, lambda v, i: F.get(wins, i)))

        return F.when(F.size(keys) > 0, F.to_variant_object(F.map_from_arrays(kept(keys), F.transform(F.transform(kept(raws), _unquoted), _typed))))

    return LineFormat([lambda line: F.regexp_extract_all(line, F.lit(_PAIR), 1), lambda line, keys: F.regexp_extract_all(line, F.lit(_PAIR), 2), last], data)


_PRI = r"^<(\d{1,3})>"
_NEW = _PRI + r"(\d) (\S++) (\S++) (\S++) (\S++) (\S++) ?((?:-|(?:\[(?:[^\]\\]|\\.)*+\])++)(?: |$))?(.*)$"
_OLD = _PRI + r"([A-Z][a-z]{2}) ++(\d{1,2}) (\d{2}:\d{2}:\d{2}) (\S++) ?(.*)$"


def syslog_format(year: int | None = None) -> LineFormat:
    """RFC 5424 where a digit follows the priority, else RFC 3164; no priority (0 to 191): null.

    ``timestamp`` is in seconds, in the session's zone where the line has none; RFC 3164 lines have
    no year either: ``year``, or this one.
    """
    y = F.lit(str(year)) if year else F.date_format(F.current_timestamp(), "yyyy")

    def priority(line: Column) -> Column:
        got = F.regexp_extract(line, _PRI, 1).try_cast("int")
        return F.when(got.between(0, 191), got)

    def old_groups(line: Column, pri: Column, new: Column) -> Column:
        return F.when(pri.isNotNull() & new.isNull(), _matched(line, _OLD, 6))

    def at(line: Column, pri: Column, new: Column, old: Column) -> Column:
        of_old = F.try_to_timestamp(F.concat_ws(" ", y, _group(old, 2), F.lpad(_group(old, 3), 2, "0"), _group(old, 4)), F.lit("yyyy MMM dd HH:mm:ss"))
        return F.unix_micros(F.when(new.isNotNull(), F.try_to_timestamp(_group(new, 3, _NIL))).when(old.isNotNull(), of_old))

    def data(line: Column, pri: Column, new: Column, old: Column, us: Column) -> Column:
        def of_new(c: Column) -> Column:
            return F.when(new.isNotNull(), c)

        nil = lambda i: F.trim(_group(new, i, _NIL))
        micros = F.pmod(us, F.lit(1_000_000))
        structured = F.trim(F.get(new, 7))
        fields = [
            pri.alias("syslog_priority"),
            F.floor(pri / 8).cast("int").alias("syslog_facility"),
            F.pmod(pri, F.lit(8)).alias("syslog_severity"),
            _group(new, 2).try_cast("int").alias("syslog_version"),
            F.floor(us / 1_000_000).cast("long").alias("timestamp"),
            of_new(F.when(micros > 0, micros)).alias("timestamp_usec"),
            F.coalesce(nil(4), _group(old, 5)).alias("hostname"),
            nil(5).alias("app_name"),
            nil(6).alias("procid"),
            nil(7).alias("msgid"),
            F.when(~structured.isin(*_NIL), structured).alias("structured_data"),
            F.when(new.isNotNull(), _group(new, 9)).when(old.isNotNull(), _group(old, 6)).otherwise(_blank(F.regexp_replace(line, _PRI, ""))).alias("message"),
        ]
        return F.when(pri.isNotNull(), _object(*fields))

    return LineFormat([priority, lambda line, pri: F.when(pri.isNotNull(), _matched(line, _NEW, 9)), old_groups, at], data)


def _blank(text: Column) -> Column:
    return F.when(text != "", text)


#: What stands between quotes, without trying any part of it twice.
_QUOTED = r'"([^"\\]*+(?:\\.[^"\\]*+)*+)"'
_NGINX = rf'^(\S++) \S++ (\S++) \[([^\]]*+)\] {_QUOTED} (\d{{3}}) (\d++|-)(?: {_QUOTED} {_QUOTED})?.*$'


def nginx_format() -> LineFormat:
    """Combined access log; ``-`` and empty values are left out."""

    def request(line: Column, groups: Column) -> Column:
        return F.split(F.get(groups, 3), " ")

    def data(line: Column, groups: Column, request: Column) -> Column:
        # method, path and perhaps protocol: two or three words
        whole = F.when(F.size(request).between(2, 3) & ~F.array_contains(request, ""), request)
        return F.when(
            groups.isNotNull(),
            _object(
                _group(groups, 1).alias("remote_addr"),
                _group(groups, 2, _NIL).alias("remote_user"),
                _group(groups, 3).alias("time_local"),
                F.trim(_group(groups, 4, _NIL)).alias("request"),
                F.get(whole, 0).alias("method"),
                F.get(whole, 1).alias("path"),
                F.get(whole, 2).alias("protocol"),
                _group(groups, 5).cast("int").alias("status"),
                _group(groups, 6, _NIL).try_cast("long").alias("body_bytes_sent"),
                _group(groups, 7, _NIL).alias("http_referer"),
                _group(groups, 8, _NIL).alias("http_user_agent"),
            ),
        )

    return LineFormat([lambda line: _matched(line, _NGINX, 8), request], data)


def regex_format(pattern: str) -> LineFormat:
    """The named groups of a pattern (``(?P<name>`` or ``(?<name>``), all strings; empty ones are left out."""
    java = re.sub(r"\(\?P<", "(?<", pattern)
    compiled = re.compile(re.sub(r"\(\?<(?![=!])", "(?P<", java))
    if not compiled.groupindex:
        raise ValueError("the pattern has no named group")
    names = sorted(compiled.groupindex, key=compiled.groupindex.get)

    def extracted(line: Column) -> Column:
        return F.array(*[F.regexp_extract(line, java, compiled.groupindex[n]) for n in names])

    return LineFormat([lambda line: F.when(line.rlike(java), extracted(line))], lambda line, groups: F.when(groups.isNotNull(), _object(*[_group(groups, i + 1).alias(n) for i, n in enumerate(names)])))


FORMATS: dict[str, Callable[..., LineFormat]] = {"json": json_format, "logfmt": logfmt_format, "syslog": syslog_format, "nginx": nginx_format, "regex": regex_format}


def parse_lines(lines: DataFrame, fmt: str, value: str = "value", keep: list[str] | None = None, pattern: str | None = None, year: int | None = None) -> DataFrame:
    """Log events from a column of lines: type, ``keep``, and ``data`` as VARIANT.

    A line's parts are matched once each, and its object is made behind a generator, so that a
    predicate or a projection on its fields doesn't parse the line again.
    """
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt}; one of {', '.join(FORMATS)}")
    if fmt == "regex" and pattern is None:
        raise ValueError("the regex format needs a pattern")
    options = {"pattern": pattern} if fmt == "regex" else {"year": year} if fmt == "syslog" else {}
    form = FORMATS[fmt](**options)
    kept = [F.col(quoted(c)).alias(f"_keep{i}") for i, c in enumerate(keep or [])]
    # nothing to strip on most lines: a regex on its tail only where there is
    text = F.col(quoted(value))
    bare = F.when(text.endswith("\n") | text.endswith("\r"), F.regexp_replace(text, r"[\r\n]+$", "")).otherwise(text)
    rows = lines.select(*kept, bare.alias("_line")).where("_line <> ''")
    parts = [F.col("_line")]
    for i, part in enumerate(form.parts):
        rows = rows.withColumn(f"_part{i}", part(*parts))
        parts.append(F.col(f"_part{i}"))
    message = F.to_variant_object(F.struct(F.col("_line").alias("message")))
    return rows.select(F.lit("log").alias("type"), *[F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep or [])], F.explode(F.array(F.coalesce(form.data(*parts), message))).alias("data"))


#: Payload fields that hold an event's own time.
TIME_FIELDS = ("ts", "timestamp", "time", "@timestamp")


def event_time(data: Column = None) -> Column:
    """The event's own time from its payload: ISO text, or seconds since 1970; null if there is none."""
    data = F.col("data") if data is None else data
    options = []
    for name in TIME_FIELDS:
        text = F.try_variant_get(data, f"$['{name}']", "string")
        options += [F.try_to_timestamp(text), F.timestamp_micros((text.try_cast("double") * 1_000_000).cast("long"))]
    return F.coalesce(*options)
