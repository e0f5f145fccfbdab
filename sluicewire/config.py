"""Configuration files: inputs, correlation, queries, outputs, performance."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import SparkSession

from .engine import Monitor
from .lang import parse
from .lang.lexer import UNITS

_SIZES = {"": 1, "B": 1, "KB": 10**3, "MB": 10**6, "GB": 10**9, "KIB": 2**10, "MIB": 2**20, "GIB": 2**30}


class ConfigError(ValueError):
    pass


def duration_ms(text: str | int) -> int:
    m = re.fullmatch(r"(\d+)\s*(ms|s|m|h)?", str(text).strip())
    if not m:
        raise ConfigError(f"not a duration: {text}")
    return int(m[1]) * UNITS[m[2] or "ms"]


def byte_size(text: str | int) -> int:
    m = re.fullmatch(r"(\d+)\s*([A-Za-z]*)", str(text).strip())
    if not m or m[2].upper() not in _SIZES:
        raise ConfigError(f"not a size: {text}")
    return int(m[1]) * _SIZES[m[2].upper()]


@dataclass
class Input:
    kind: str  # file, pcap, udp (whose path is host:port), live (an interface)
    path: str
    name: str | None = None
    format: str | None = None
    filter: str | None = None
    pattern: str | None = None


@dataclass
class Output:
    kind: str  # stdout, file, http, prometheus
    format: str = "json"
    path: str | None = None
    url: str | None = None
    method: str = "POST"
    name: str | None = None
    max_bytes: int | None = None
    max_files: int | None = None


@dataclass
class Config:
    version: str = "1.0"
    inputs: list[Input] = field(default_factory=list)
    outputs: list[Output] = field(default_factory=list)
    correlation: bool = True
    within_ms: int = 100
    queries: dict[str, str] = field(default_factory=dict)
    buffer_bytes: int = 64 * 10**6
    memory_bytes: int = 10**9

    def monitor(self, spark: SparkSession, streaming: bool = False) -> Monitor:
        m = Monitor(spark, streaming).enable_correlation(self.within_ms if self.correlation else None)
        for i in self.inputs:
            if i.kind == "file":
                m.add_log_input(i.path, i.format, i.filter, name=i.name, pattern=i.pattern)
            elif i.kind == "live":
                m.add_live_input(i.path, i.filter)
            elif i.kind == "udp":
                m.add_udp_input(i.path, i.format or "syslog", i.filter, i.pattern)
            else:
                m.add_network_input(i.path, i.filter)
        return m


def _entries(value: Any, where: str) -> list[dict]:
    if value is None:
        return []
    if not isinstance(value, list) or not all(isinstance(x, dict) for x in value):
        raise ConfigError(f"{where} must be a list of mappings")
    return value


def from_mapping(raw: dict | None) -> Config:
    raw = raw or {}
    if not isinstance(raw, dict):
        raise ConfigError("a configuration is a mapping")
    out = Config(version=str(raw.get("version", "1.0")))
    inputs = raw.get("inputs") or {}
    groups = {"logs": _entries(inputs, "inputs")} if isinstance(inputs, list) else {k: _entries(v, f"inputs.{k}") for k, v in inputs.items()}
    for group, entries in groups.items():
        for x in entries:
            kind = x.get("type") or ("pcap" if group == "network" else "file")
            kind = "udp" if kind == "syslog" else kind
            if group == "network" and x.get("interface") and not x.get("path"):
                kind = "live"
            path = x.get("listen") if kind == "udp" else x.get("interface") if kind == "live" else x.get("path")
            if kind not in ("file", "pcap", "udp", "live") or not path:
                raise ConfigError(f"input {x.get('name') or x}: needs type file or pcap and a path, type udp and an address to listen on, or a network interface")
            out.inputs.append(Input(kind, str(path), x.get("name"), x.get("format"), x.get("filter"), x.get("pattern")))
    for x in _entries(raw.get("outputs"), "outputs"):
        kind = {"metrics": "prometheus", "json": "stdout"}.get(x.get("type"), x.get("type"))
        if kind not in ("stdout", "file", "http", "prometheus"):
            raise ConfigError(f"unknown output type {x.get('type')}")
        if kind == "http" and not x.get("url") or kind == "file" and not x.get("path"):
            raise ConfigError(f"output {kind} needs {'a url' if kind == 'http' else 'a path'}")
        rotation = x.get("rotation") or {}
        out.outputs.append(Output(kind, x.get("format", "json"), x.get("path"), x.get("url"), x.get("method", "POST"), x.get("name"), byte_size(rotation["max_size"]) if "max_size" in rotation else None, rotation.get("max_files")))
    correlation = raw.get("correlation") or {}
    out.correlation = bool(correlation.get("enabled", True))
    strategies = _entries(correlation.get("strategies"), "correlation.strategies")
    window = next((s["window"] for s in strategies if "window" in s), correlation.get("window"))
    if window is not None:
        out.within_ms = duration_ms(window)
    queries = raw.get("queries") or {}
    named = {q.get("name") or f"query{i}": q.get("query") for i, q in enumerate(queries)} if isinstance(queries, list) else queries
    for name, text in named.items():
        parse(text or "")
        out.queries[name] = text
    performance = raw.get("performance") or {}
    if "buffer_size" in performance:
        out.buffer_bytes = byte_size(performance["buffer_size"])
    if "memory_limit" in performance:
        out.memory_bytes = byte_size(performance["memory_limit"])
    return out


def load(path: str) -> Config:
    try:
        import yaml
    except ImportError as e:
        raise ConfigError("reading YAML needs PyYAML") from e
    with open(path, encoding="utf-8") as f:
        return from_mapping(yaml.safe_load(f))
