"""Command line: ``python -m sluicewire.cli analyze --logs app.log --query '...'``."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import DataFrame, SparkSession

from . import __version__
from .config import Config, ConfigError, Input, Output, load
from .engine import Monitor
from .lang import QueryParseError, ast, parse
from .plans import query, to_json_lines, to_payload
from .sinks.files import RotatingFile
from .sinks.prometheus import PrometheusText
from .sinks.webhook import webhook


def session() -> SparkSession:
    spark = SparkSession.builder.appName("sluicewire").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def emit(df: DataFrame, stage: ast.Stage, outputs: list[Output], write=print) -> None:
    """The results of a query, as derived events, to every output."""
    events = to_payload(df, stage)
    for o in outputs:
        if o.kind == "stdout":
            for row in to_json_lines(events).toLocalIterator():
                write(row[0])
        elif o.kind == "file":
            limits = {k: v for k, v in (("max_bytes", o.max_bytes), ("max_files", o.max_files)) if v}
            RotatingFile(o.path, **limits).write_batch(events)
        elif o.kind == "http":
            webhook(o.url, method=o.method)(events)
        else:
            text = PrometheusText(o.path)
            text.count_events(events)
            if isinstance(stage, ast.Aggregate):
                text.gauge_results(df, stage)
            body = text.flush()
            if not o.path:
                write(body.rstrip("\n"))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sluicewire")
    p.add_argument("-v", "--version", action="version", version=__version__)
    sub = p.add_subparsers(dest="command", required=True)
    for name, text in (("analyze", "run queries over files"), ("monitor", "follow folders of files")):
        c = sub.add_parser(name, help=text)
        c.add_argument("-l", "--logs", action="append", default=[])
        c.add_argument("-F", "--format", choices=["json", "logfmt", "syslog", "nginx", "regex"])
        c.add_argument("--pattern")
        c.add_argument("-n", "--network", "--pcap", action="append", default=[], help="capture files")
        c.add_argument("-f", "--filter")
        c.add_argument("-q", "--query", help="a query, or @file")
        c.add_argument("-o", "--output", choices=["json", "file", "http", "metrics"], default="json")
        c.add_argument("-O", "--output-file")
        c.add_argument("-U", "--output-url")
        c.add_argument("-c", "--config")
        if name == "monitor":
            c.add_argument("--checkpoint")
            c.add_argument("--once", action="store_true")
    c = sub.add_parser("query", help="run a query over a table")
    c.add_argument("query")
    c.add_argument("--table", required=True, help="a path that Spark reads")
    c.add_argument("--table-format", default="parquet")
    c.add_argument("--time")
    c = sub.add_parser("config", help="check or show a configuration")
    c.add_argument("action", choices=["validate", "show"])
    c.add_argument("path")
    c = sub.add_parser("benchmark", help="time a query over a table")
    c.add_argument("query")
    c.add_argument("--table", required=True)
    return p


def _config(args: argparse.Namespace) -> Config:
    out = load(args.config) if args.config else Config()
    out.inputs += [Input("file", p, None, args.format, args.filter, args.pattern) for p in args.logs]
    out.inputs += [Input("pcap", p, filter=args.filter) for p in args.network]
    if not out.outputs:
        kind = {"json": "stdout", "metrics": "prometheus"}.get(args.output, args.output)
        if kind == "http" and not args.output_url or kind == "file" and not args.output_file:
            raise ConfigError(f"output {kind} needs {'--output-url' if kind == 'http' else '--output-file'}")
        out.outputs = [Output(kind, path=args.output_file, url=args.output_url)]
    if args.query:
        text = open(args.query[1:], encoding="utf-8").read() if args.query.startswith("@") else args.query
        out.queries["command line"] = text.strip()
    return out


def _follow(config: Config, monitor: Monitor, args: argparse.Namespace) -> None:
    from .streaming.queries import start

    started = []
    for name, text in (config.queries or {"events": "*"}).items():
        stage = parse(text).stages[-1]
        handler = lambda batch, _, stage=stage: emit(batch, stage, config.outputs)
        where = f"{args.checkpoint}/{name}" if args.checkpoint else None
        started.append(start(monitor.events(), text, handler, checkpoint=where, once=args.once))
    for q in started:
        q.awaitTermination()


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    if argv and argv[0].startswith("-") and argv[0] not in ("-h", "--help", "-v", "--version"):
        argv = ["analyze", *argv]
    args = parser().parse_args(argv)
    try:
        if args.command == "config":
            config = load(args.path)
            if args.action == "show":
                print(json.dumps(config, default=vars, indent=2))
            return 0
        if args.command in ("query", "benchmark"):
            pipeline = parse(args.query)
            spark = session()
            df = spark.read.format(getattr(args, "table_format", "parquet")).load(args.table)
            began = time.time()
            out = query(df, args.query, getattr(args, "time", None))
            if args.command == "benchmark":
                out.write.format("noop").mode("overwrite").save()
                n, took = df.count(), time.time() - began
                print(json.dumps({"rows": n, "seconds": round(took, 3), "rows_per_second": round(n / took)}))
            else:
                emit(out, pipeline.stages[-1], [Output("stdout")])
            return 0
        config = _config(args)
        spark = session()
        monitor = config.monitor(spark, args.command == "monitor")
        if args.command == "monitor":
            _follow(config, monitor, args)
            return 0
        for text in config.queries.values() or ["*"]:
            emit(monitor.query(text), parse(text).stages[-1], config.outputs)
        return 0
    except (QueryParseError, ConfigError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
