"""Events to an HTTP endpoint: one request for each event, from the executors."""

from __future__ import annotations

import http.client
import ssl
from collections.abc import Iterator
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, Row

from ..plans.payload import to_json_lines

TIMEOUT_S = 30


class DeliveryError(RuntimeError):
    pass


def post_rows(url: str, method: str = "POST", headers: dict[str, str] | None = None, timeout: float = TIMEOUT_S, verify: bool = True):
    """A function that sends the ``value`` of each row of a partition over one connection; certificates are verified."""
    parts = urlsplit(url)
    if parts.scheme not in ("http", "https") or not parts.hostname:
        raise ValueError(f"not an HTTP address: {url}")

    def send(rows: Iterator[Row]) -> None:
        connection = None
        try:
            for row in rows:
                if connection is None:
                    if parts.scheme == "https":
                        context = ssl.create_default_context() if verify else ssl._create_unverified_context()
                        connection = http.client.HTTPSConnection(parts.hostname, parts.port, timeout=timeout, context=context)
                    else:
                        connection = http.client.HTTPConnection(parts.hostname, parts.port, timeout=timeout)
                target = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
                connection.request(method, target, row[0].encode(), {"Content-Type": "application/json"} | (headers or {}))
                answer = connection.getresponse()
                answer.read()
                if answer.status >= 400:
                    raise DeliveryError(f"{method} {url}: {answer.status} {answer.reason}")
        finally:
            if connection is not None:
                connection.close()

    return send


def webhook(url: str, **options):
    """For ``foreachBatch``; a batch that is tried again sends its events again."""
    send = post_rows(url, **options)

    def write(events: DataFrame, batch_id: int = 0) -> None:
        to_json_lines(events).foreachPartition(send)

    return write
